"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by the set of sources they belong to. Between these patterns and the
sources a small flow network is solved on the driver: a pattern offers its tokens once at no
cost, again at a rising cost (so repetition is spread evenly), and every source takes up to its
quota. Then documents are laid out in a seeded order within their pattern, in slots of a
bounded number of rows, and those under the pattern's flow are taken.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import columns_of, row_hash, settle

WORD = r"[^\x20\x09-\x0D]+"
# Sets of sources the driver may hold.
MAX_PATTERNS = 100_000


def _local_table(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """Rows of the driver as a local relation. Rows given as a list would be read by Python workers of a kind of their own."""
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds.items())}))


def word_count(name: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def cyclic_weights(sources: list, weights: tuple = (3, 1, 2)) -> dict:
    """Weights in turn for sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Tokens each source should give: ``share`` of all tokens by weight, at most ``most`` times
    its own; what is cut there is shared out again by weight until no source is above."""
    total, found, free = share * sum(sizes.values()), {}, dict(weights)
    while free:
        level = (total - sum(found.values())) / sum(free.values())
        above = [s for s, w in free.items() if level * w > most * sizes[s]]
        if not above:
            found |= {s: level * w for s, w in free.items()}
            break
        for s in above:
            found[s] = most * sizes[s]
            del free[s]
    return found


def min_cost_flow(capacity: dict, quotas: dict, repeats: int = 2) -> dict:
    """Tokens from each pattern to each source: {(pattern, source): tokens}.

    ``capacity`` maps a pattern (a tuple of sources) to its tokens, which are on offer ``repeats``
    times at a cost of 0, 1, 2 ... a token. As much as possible of the quotas is met, at the least
    cost. Only the offers cost, and a path that adds flow never takes an offer back, so the flow is
    made as large as it can be with the offers of one cost after the other: for each, shortest
    paths by their number of arcs, all those of one length at a time.
    """
    to: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[], []]  # arcs by node; the arc back is at index ^ 1
    start, end = 0, 1

    def node() -> int:
        out.append([])
        return len(out) - 1

    def arc(a: int, b: int, most: int) -> int:
        to.extend((b, a))
        left.extend((most, 0))
        out[a].append(len(to) - 2)
        out[b].append(len(to) - 1)
        return len(to) - 2

    sources = {s: node() for s in sorted(quotas, key=repr)}
    offers, links = [], {}
    for p, tokens in sorted(capacity.items(), key=lambda x: repr(x[0])):
        at = node()
        offers.append((arc(start, at, 0), tokens))
        for s in p:
            if s in sources:
                links[p, s] = arc(at, sources[s], repeats * tokens)
    for s, at in sources.items():
        arc(at, end, quotas[s])
    for _ in range(repeats):
        for i, tokens in offers:
            left[i] += tokens
        while (level := _levels(to, left, out, start))[end] >= 0:
            _fill(to, left, out, level, start, end)
    return {link: left[i ^ 1] for link, i in links.items() if left[i ^ 1]}


def _levels(to: list, left: list, out: list, start: int) -> list[int]:
    """How many arcs each node is from the start, -1 where none with room lead."""
    level = [-1] * len(out)
    level[start], queue = 0, deque([start])
    while queue:
        x = queue.popleft()
        for i in out[x]:
            if left[i] and level[to[i]] < 0:
                level[to[i]] = level[x] + 1
                queue.append(to[i])
    return level


def _fill(to: list, left: list, out: list, level: list, start: int, end: int) -> None:
    """Adds flow along paths that lead one level on with each arc, until each has a full arc."""
    tried, path, x = [0] * len(out), [], start
    while True:
        if x == end:
            amount = min(left[i] for i in path)
            for i in path:
                left[i] -= amount
                left[i ^ 1] += amount
            full = next(n for n, i in enumerate(path) if not left[i])
            x = to[path[full] ^ 1]
            del path[full:]
        elif tried[x] < len(out[x]):
            i = out[x][tried[x]]
            if left[i] and level[to[i]] == level[x] + 1:
                path.append(i)
                x = to[i]
            else:
                tried[x] += 1
        elif path:
            x = to[path.pop() ^ 1]
            tried[x] += 1
        else:
            return


@dataclass
class Mix:
    """A solved mix. ``taken``: (doc_id, members, size, copies, taken_for), one row per document, with a
    source for each copy in taken_for. ``tokens`` and ``wanted``: what each source has and should
    give. ``ends``: for each set of sources, how many whole laps over its documents are taken and
    the place of the last document of the lap that is not whole, with the copies taken there."""

    taken: DataFrame
    tokens: dict
    wanted: dict
    ends: DataFrame


def _members(members: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))


def _place(docs: DataFrame, size: Column, seed: int) -> Column:
    """Where a document stands in the seeded order of its set of sources. Only rows that are equal
    in all columns have one place."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    more = row_hash(docs)
    return F.struct(key.alias("key"), doc_id.alias("id"), more.alias("more"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))


def mix(
    docs: DataFrame, members: Column, size: Column, quotas, repeats: int = 2, seed: int = 42,
) -> Mix:
    """Which documents a mix takes, how often and for which source.

    ``members`` is an array of the sources a document belongs to (null and empty: none; a null
    source is a source of its own), ``size`` its tokens (null: 0). ``quotas`` maps sources to
    tokens, or is a function from the tokens of each source to that. The tokens taken of a set of
    sources differ from its flow by less than one document; no document is taken more than
    ``repeats`` times.

    Rows with a null doc_id take part; repeated rows count as documents of their own. A document
    without tokens may be taken and adds nothing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow = settle(docs.select(
        F.col("doc_id").cast("bigint"), _members(members).alias("members"), _place(docs, size, seed).alias("place")
    ).groupBy("members", "place", "doc_id").agg(F.count("*").alias("n")), "sizes").withColumn("size", F.col("place.size"))
    found = narrow.groupBy("members").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    capacity = {tuple(r.members): r.tokens for r in found}
    tokens: dict = {}
    for p, n in capacity.items():
        for s in p:
            tokens[s] = tokens.get(s, 0) + n
    wanted = quotas(tokens) if callable(quotas) else quotas
    flow = min_cost_flow(capacity, {s: round(q) for s, q in wanted.items()}, repeats)

    rows = []
    for p in capacity:
        shares, at = [], 0
        for s in p:
            if n := flow.get((p, s), 0):
                at += n
                shares.append((at, s))
        rows.append((list(p), capacity[p], at, shares))
    shares_kind = pa.list_(pa.struct([("at", pa.int64()), ("source", pa.string())]))
    plan = _local_table(spark, rows, members=pa.list_(pa.string()), total=pa.int64(), flow=pa.int64(), shares=shares_kind)

    # As many slots as a slot has rows: neither window grows faster than the root of the documents.
    bits = math.ceil(math.log2(max([1, *(r.n for r in found)])) / 2)
    slotted = narrow.withColumn("slot", F.shiftright("place.key", 63 - bits)).withColumn("tokens", F.col("size") * F.col("n"))
    within = Window.partitionBy("members", "slot").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    of_slot = slotted.groupBy("members", "slot").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("members").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    of_slot = of_slot.select("members", "slot", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("slot_at"))
    placed = slotted.withColumn("at", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(of_slot, ["members", "slot"]).join(F.broadcast(plan), "members")
    # Equal rows are one row with a number up to here.
    placed = placed.withColumn("one", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    start = F.col("slot_at") + F.col("at") + F.col("one") * F.col("size")
    # Twice the middle of a document's tokens; one without tokens belongs to what is before it.
    middle = lambda lap: 2 * (lap * F.col("total") + F.col("start")) + F.when(F.col("size") > 0, F.col("size")).otherwise(-1)
    laps = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda lap: (middle(lap) < 2 * F.col("flow")) & (F.col("flow") > 0))
    source_of = lambda lap: F.filter("shares", lambda e: middle(lap) < 2 * e["at"])[0]["source"]
    placed = placed.withColumn("start", start).withColumn("laps", laps).withColumn("copies", F.size("laps"))
    taken = placed.select("doc_id", "members", "size", "copies", F.transform("laps", source_of).alias("taken_for"))
    # Copies never rise along the order. The end is the last place with more copies than whole laps give.
    whole = F.least(F.floor(F.col("flow") / F.greatest("total", F.lit(1))), F.lit(repeats))
    places = placed.groupBy("members", "place").agg(F.sum("copies").alias("copies"), F.max("copies").alias("most"), F.first(whole).alias("whole"))
    ends = places.groupBy("members").agg(F.max("whole").cast("int").alias("whole"), F.max("most").alias("most"), F.max(
        F.when(F.col("most") > F.col("whole"), F.struct("place", "copies"))
    ).alias("end"))
    return Mix(taken, tokens, wanted, ends)


def apply_mix(docs: DataFrame, members: Column, size: Column, ends: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` as often as a mix takes them. ``ends`` has a row for each set of sources
    (at most MAX_PATTERNS); texts are filtered where they are read and not shuffled. Rows with a null
    doc_id or text are taken like others, rows equal in all columns together as often as the mix takes
    them; an empty table gives an empty result."""
    held = docs.select(
        F.struct(*columns_of(docs)).alias("row"), _members(members).alias("members"), _place(docs, size, seed).alias("place")
    ).join(F.broadcast(ends), "members")
    copies = F.when(F.col("place") < F.col("end.place"), F.col("most")).otherwise(F.col("whole"))
    at_end = F.coalesce(F.col("place") == F.col("end.place"), F.lit(False))
    plain = held.where(~at_end).withColumn("copies", copies)
    # Equal rows at the end of a lap: of one for each set of sources, so many as the mix takes of them all.
    last = held.where(at_end).groupBy("members").agg(F.first("row").alias("row"), F.first("end.copies").cast("int").alias("copies"))
    rows = plain.select("row", "copies").unionAll(last.select("row", "copies"))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def mix_by_source(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42) -> Mix:
    """A mix of documents with one source each. Sizes are words; null texts have none, a null
    source is a source. See ``mix`` for the rest."""
    return mix(
        docs, F.array("source"), word_count(),
        lambda tokens: targets(tokens, cyclic_weights(list(tokens), weights), share, most), most, seed,
    )


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of ``mix_by_source``, one row per document."""
    found = mix_by_source(docs, **options)
    sizes = _local_table(
        docs.sparkSession, [([s], n, float(found.wanted[s])) for s, n in found.tokens.items()],
        members=pa.list_(pa.string()), source_size=pa.int64(), target=pa.float64(),
    )
    return found.taken.join(F.broadcast(sizes), "members").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """``docs`` as ``mix_by_source`` takes them: documents it leaves out go, others may come twice. Nulls,
    repeated rows and an empty table are as in ``apply_mix``."""
    ends = settle(mix_by_source(docs, seed=seed, **options).ends, "ends")
    return apply_mix(docs, F.array("source"), word_count(), ends, seed)
