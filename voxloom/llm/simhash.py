"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from one pass over the texts. From then on rows are narrow: equal
fingerprints are one row, and fingerprints that may be within ``radius`` bits share a key.
For that the 64 bits are cut into ``radius + 2`` blocks; two fingerprints within the radius
agree on at least two whole blocks, so each pair of blocks gives one key. Fingerprints of
one key are compared bit plane by bit plane, many lanes to a machine word. A key with many
fingerprints is cut into tiles, and only edges that join two parts of a tile leave the task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import columns_of, components, settle, text_bytes, values

SEED = 42
# Fingerprints of one key compared in a task at once.
TILE = 4096
# Below this many, groups are compared together.
SMALL = 48


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of the bits of the shingles' hashes; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        ends = starts + lengths - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, more: dict | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed 64-bit number; and beside
    them the bigint columns ``more`` by name."""
    more = more or {}
    names = ["doc_id", "fp", *more]

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, shingle) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *batch.columns[2:]], names=names
            )

    given = docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("text"), *(c.alias(n) for n, c in more.items()))
    return given.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def planes_of(values: np.ndarray) -> np.ndarray:
    """The 64 bit planes of some fingerprints, each packed into bytes."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def _lanes_within(planes, radius: int):
    """Lanes of which at most ``radius`` planes are set. ``planes`` yields arrays of equal
    shape; counting stops as soon as every lane is beyond the radius."""
    digits: list = []
    over = None
    for step, x in enumerate(planes):
        if over is None:
            digits = [np.zeros_like(x) for _ in range(radius.bit_length())]
            over = np.zeros_like(x)
        carry = x
        for i, digit in enumerate(digits):  # add one bit to the vertical counters
            digits[i], carry = digit ^ carry, digit & carry
        over |= carry
        if step % 8 == 7 and np.all(_beyond(digits, over, radius) == 255):
            return np.zeros_like(over)
    return ~_beyond(digits, over, radius)


def _beyond(digits: list, over, radius: int):
    """Lanes whose counter is above ``radius`` or has run over."""
    above, equal = over.copy(), ~np.zeros_like(over)
    for i in reversed(range(len(digits))):
        if radius >> i & 1:
            equal &= digits[i]
        else:
            above |= equal & digits[i]
            equal &= ~digits[i]
    return above


def pairs_within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) are within the radius."""
    planes = planes_of(left ^ right)
    return np.unpackbits(_lanes_within(iter(planes), radius), bitorder="little")[: len(left)].astype(bool)


def matches(query: int, planes: np.ndarray, count: int, radius: int) -> np.ndarray:
    """Indices of the fingerprints behind ``planes`` within the radius of ``query``."""
    flipped = (planes[b] if not query >> b & 1 else ~planes[b] for b in range(64))
    return np.flatnonzero(np.unpackbits(_lanes_within(flipped, radius), bitorder="little")[:count])


class Forest:
    """Joins nodes and remembers only the edges that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y] if y in self.up else y
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _edges_of_small(groups: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    values = np.concatenate(groups)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    forest = Forest()
    for shift in range(1, max(len(g) for g in groups)):
        at = np.flatnonzero(group[shift:] == group[:-shift])
        left, right = values[at], values[at + shift]
        hit = pairs_within(left, right, radius)
        for a, b in zip(left[hit].tolist(), right[hit].tolist()):
            forest.join(a, b)
    return forest.edges


def _edges_of_large(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    planes, forest, values = planes_of(right), Forest(), right.tolist()
    label = np.arange(len(right))
    for query in left.tolist():
        hit = matches(query, planes, len(right), radius)
        if not len(hit):
            continue
        first = values[hit[0]]
        forest.join(query, first)
        labels = label[hit]
        if (labels != labels[0]).any():  # parts of this tile that the query joins
            for other in np.unique(labels).tolist():  # `first` itself may have any of the labels
                forest.join(first, values[other])
            label[np.isin(label, labels)] = labels.min()
    return forest.edges


def links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect all pairs within ``radius`` bits.

    ``distinct`` has a column fp without repeats.
    """
    blocks = radius + 2
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    start = [sum(width[:i]) for i in range(blocks)]
    mask = [((1 << w) - 1) << s for w, s in zip(width, start)]
    as_long = [m - (1 << 64) if m >> 63 else m for m in mask]
    keys = [
        F.struct(F.lit(t).alias("part"), F.col("fp").bitwiseAND(F.lit(as_long[i] | as_long[j])).alias("key"))
        for t, (i, j) in enumerate(combinations(range(blocks), 2))
    ]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.part", "k.key")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["part", "key"])
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int")
    met = met.select(
        "part", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    ).select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    side = lambda c: F.sort_array(F.collect_list(F.when(F.col("own") == F.col(c), F.col("fp"))))
    grouped = met.groupBy("part", "key", "i", "j").agg(side("i").alias("left"), side("j").alias("right"))
    return grouped.select((F.col("i") == F.col("j")).alias("same"), "left", "right").mapInArrow(
        lambda batches: _compare(batches, radius), "a bigint, b bigint"
    ).distinct()


def _compare(batches, radius: int):
    for batch in batches:
        small, edges = [], []
        for same, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            left, right = (np.array(x, np.int64).view(np.uint64) for x in (left, right))
            if same and len(left) < SMALL:
                small.append(left)
            else:
                edges += _edges_of_large(left, right, radius)
        if small:
            edges += _edges_of_small(small, radius)
        found = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def with_components(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``distinct`` and the ``component`` of each fp: the smallest fingerprint that links reach."""
    found = components(links(distinct.select("fp"), radius), "a", "b")
    return distinct.join(found, distinct.fp == found.node, "left").select(
        *distinct.columns, F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` bits reach. Null
    and empty texts have fingerprint 0 and link like others; texts of fewer than ``shingle``
    words are one shingle. Rows with a null doc_id get a row too, and name no component.
    Repeated rows stay. Other columns are ignored. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, shingle), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    named = with_components(distinct, radius)
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_print = named.join(least, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, where null comes after all
    others, then of the smallest fingerprint, then by hashes of the text and of the other columns. Null and
    empty texts are one component; of rows equal in all columns one stays. An empty table gives an empty result."""
    others = [c for c, name in zip(columns_of(docs), docs.columns) if name != "text"]
    marks = {
        "text_hash": F.xxhash64(text_bytes()), "text_check": F.xxhash64(F.lit(1), text_bytes()),
        "others_hash": F.xxhash64(F.to_json(F.struct(F.col("text").isNull().alias("no_text"), F.struct(*others).alias("others")))),
    }
    prints = settle(fingerprints(docs, shingle, marks), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "fp", *marks)
    distinct = settle(prints.groupBy("fp").agg(F.min(place).alias("place")), "distinct")
    chosen = with_components(distinct, radius).groupBy("component").agg(F.min("place").alias("place"))
    keys = ["unnamed", "id", *marks]
    id_ = F.col("doc_id").cast("bigint")
    rows = docs.select(
        F.struct(*columns_of(docs)).alias("row"), id_.isNull().alias("unnamed"), F.coalesce(id_, F.lit(0)).alias("id"),
        *(c.alias(n) for n, c in marks.items()),
    )
    # Only rows equal in all columns share these keys.
    return rows.join(chosen.select(*(f"place.{k}" for k in keys)), keys, "left_semi").dropDuplicates(keys).select("row.*")
