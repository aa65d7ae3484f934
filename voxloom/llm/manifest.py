"""A Merkle manifest of a table: one hash for the whole, and a short proof for each document.

Documents are leaves. Those of a language make a tree in the order of their ids, and the roots of the
languages make one more tree. Only every few levels of a tree are stored (checkpoints). A proof needs the levels
between as well: they are made again for one aligned subtree at a time from the nodes stored below it, give the siblings of
its nodes, and are dropped. What lies above a subtree is the proof of its top node, which comes from the
next stored level, so proofs are put together from the root down.

A subtree has a fixed, small number of nodes, whatever the language. Leaves get their places without a sort of a whole
language: they are stored in order by ranges, and ranges are added up. Equal rows are one run of leaves, however many.
All hashing and folding is done by Spark's own functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import settle

FANOUT = 2
# Levels from one stored level to the next: a subtree has FANOUT ** STEP nodes below its top.
STEP = 6
# Runs of leaves that one task puts in order.
RANGE_ROWS = 1 << 18
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


class Forest(NamedTuple):
    """Trees with every ``step``-th level stored.

    runs: tree, first, copies, node, height and the columns of the leaves; levels: (tree, pos, node, height)
    of each stored level above the leaves, in which the last one holds the roots.
    """

    runs: DataFrame
    levels: list[DataFrame]
    fanout: int
    step: int


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """Hash of a row: each value as its UTF-8 length, a colon and itself; null as a dash."""
    parts = []
    for value in values:
        written = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-")))
    return digest(F.concat(*parts))


def placed(leaves: DataFrame, order: list[str], fanout: int) -> DataFrame:
    """Equal ``leaves`` as one run each: first (its place in the tree, from 0), copies, and the height of the tree.

    ``order`` begins with tree. Runs are written in order by ranges; the number of the range and the place in it give an id
    that ascends, and the leaves of the ranges before are added up, one row for each tree in a range.
    """
    runs = settle(leaves.groupBy(*leaves.columns).agg(F.count("*").alias("copies")), "leaves")
    ranges = -(-max(runs.count(), 1) // RANGE_ROWS)
    ordered = runs.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = settle(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("range", F.shiftright("at", 33))

    before = lambda window: F.coalesce(
        F.sum("copies").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sums = ordered.groupBy("tree", "range").agg(F.sum("copies").alias("copies"))
    in_tree = Window.partitionBy("tree")
    size = F.sum("copies").over(in_tree)
    height = F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda h: F.pow(F.lit(float(fanout)), h) < size))
    starts = sums.select("tree", "range", before(in_tree.orderBy("range")).alias("start"), height.alias("height"))
    in_range = Window.partitionBy("tree", "range").orderBy("at")
    counted = ordered.withColumn("first", before(in_range)).join(starts, ["tree", "range"])
    return counted.withColumn("first", F.col("first") + F.col("start")).drop("at", "range", "start")


def _run_of(nodes: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(nodes, start + 1, length), "")


def _above(nodes: Column, fanout: int) -> Column:
    """The level above: one hash of each run of ``fanout`` nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / fanout).cast("int") - 1)
    return F.transform(runs, lambda r: digest(_run_of(nodes, r * fanout, F.lit(fanout))))


def _levels(nodes: Column, rise: Column, fanout: int) -> Column:
    """``rise`` levels above a subtree's nodes and the nodes themselves, as an array of arrays."""
    steps = F.slice(F.sequence(F.lit(0), F.lit(62)), F.lit(1), rise)
    return F.aggregate(steps, F.array(nodes), lambda known, _: F.concat(known, F.array(_above(F.element_at(known, -1), fanout))))


def _rise(base: int, step: int) -> Column:
    """Levels of the tree from a stored level up to the next, or to the root."""
    return F.greatest(F.lit(0), F.least(F.lit(step), F.col("height") - base)).cast("int")


def _subtrees(forest: Forest, stored: int, carried: list[str]) -> DataFrame:
    """(tree, sub, height, nodes, members): the aligned subtrees on a stored level, with at most fanout ** step nodes each.

    ``members`` keep the columns of the level; on the lowest one a run of equal leaves has one for each subtree it reaches.
    """
    width = forest.fanout ** forest.step
    if stored:
        level = forest.levels[stored - 1].withColumns({"first": F.col("pos"), "copies": F.lit(1).cast("bigint")})
    else:
        level = forest.runs
    end = F.col("first") + F.col("copies") - 1
    sub = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(end / width)))
    within = level.withColumns({"end": end}).select("tree", "height", "first", "end", "node", *carried, sub.alias("sub"))
    member = F.struct(
        F.greatest(F.col("first"), F.col("sub") * width).alias("first"),
        F.least(F.col("end"), F.col("sub") * width + (width - 1)).alias("last"), "node", *carried,
    )
    grouped = within.withColumn("member", member).groupBy("tree", "sub").agg(
        F.max("height").alias("height"), F.collect_list("member").alias("members")
    )
    grouped = grouped.withColumn("members", F.sort_array("members"))
    nodes = F.flatten(F.transform("members", lambda m: F.array_repeat(m["node"], (m["last"] - m["first"] + 1).cast("int"))))
    return grouped.withColumn("nodes", nodes)


def build(leaves: DataFrame, order: list[str], *, fanout: int = FANOUT, step: int = STEP) -> Forest:
    """Trees over ``leaves`` (tree, node, and what tells leaves apart), in ``order``, which begins with tree."""
    forest = Forest(settle(placed(leaves, order, fanout), "runs"), [], fanout, step)
    highest = forest.runs.agg(F.max("height")).first()[0] or 0
    for stored in range(max(1, -(-highest // step))):
        below = _subtrees(forest, stored, [])
        top = F.element_at(F.element_at(_levels(F.col("nodes"), _rise(stored * step, step), fanout), -1), -1)
        level = below.select("tree", F.col("sub").alias("pos"), top.alias("node"), "height")
        forest.levels.append(settle(level, "level"))
    return forest


def proofs(forest: Forest, above: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, pos, node, path, the carried columns and those of ``above``) for each leaf.

    A path has for each level the siblings before and after the node on the way, up to the root. ``above`` (tree, path
    and more) is what follows at the root of each tree. Each of several equal leaves has a path of its own.
    """
    fanout, step = forest.fanout, forest.step
    known = [name for name in above.columns if name != "tree"]
    paths = forest.levels[-1].join(above, "tree").select("tree", "pos", *known)
    for stored in reversed(range(len(forest.levels))):
        kept = carried if stored == 0 else []
        opened = _subtrees(forest, stored, kept).join(paths.withColumnRenamed("pos", "sub"), ["tree", "sub"])
        opened = opened.withColumn("levels", _levels(F.col("nodes"), _rise(stored * step, step), fanout))
        nodes = opened.withColumn("member", F.explode("members"))
        nodes = nodes.withColumn("pos", F.explode(F.sequence("member.first", "member.last")))
        place = (F.col("pos") - F.col("sub") * fanout ** step).cast("int")

        def siblings(level: Column, height: Column) -> Column:
            own = F.floor(place / F.pow(F.lit(float(fanout)), height)).cast("int")  # noqa: B023
            start = own - own % fanout
            before, after = _run_of(level, start, own - start), _run_of(level, own + 1, start + fanout - 1 - own)
            return F.struct(before.alias("before"), after.alias("after"))

        below_top = F.slice("levels", F.lit(1), F.size("levels") - 1)  # what is beside the top node is in its own path
        paths = nodes.select(
            "tree", "pos", F.col("member.node").alias("node"), *[F.col("member")[c].alias(c) for c in kept],
            *[c for c in known if c != "path"], F.concat(F.transform(below_top, siblings), "path").alias("path"),
        )
        paths = paths if stored == 0 else paths.drop("node")
    return paths


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf up and from left to right."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path lead to."""
    return F.aggregate(path, node, lambda below, level: digest(F.concat(level["before"], below, level["after"])))


def document_manifest(
    docs: DataFrame, *, claims: dict[str, Column] | None = None, fanout: int = FANOUT, step: int = STEP
) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``claims`` are columns as somebody else states them. folded_root is what the document with its claims and the proof of the
    true one leads to; verified tells whether that is the root. Null ids and null languages come first; rows
    with one id are in the order of their leaves, and equal rows each have a place. An empty table gives an
    empty result. Columns beside the five that are hashed may have any name and kind; they are not looked at.
    """
    claims = claims or {}
    stated = [claims.get(name, F.col(name)) for name in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # the null language sorts first
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf([F.col(c) for c in FIELDS]).alias("node"), leaf(stated).alias("claimed"))
    forest = build(leaves, ["tree", "doc_id", "node", "claimed"], fanout=fanout, step=step)

    languages = forest.levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    top = build(languages, ["tree", "name"], fanout=fanout, step=step)
    root = top.levels[-1].select("node").first()  # one row
    end = F.array().cast("array<struct<before:string,after:string>>")
    whole = top.levels[-1].select("tree", end.alias("path"))
    above = proofs(top, whole, ["name"]).select(
        F.col("name").alias("tree"), "path", F.col("node").alias("subroot"),
        F.lit(root["node"] if root else None).cast("string").alias("root"),
    )
    found = proofs(forest, above, ["doc_id", "claimed"])
    return found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
