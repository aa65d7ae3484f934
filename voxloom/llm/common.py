"""What several operators share: cut lineage, text as bytes, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from voxloom.session import scratch_path


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back.

    Later jobs do not compute it again, and a lost executor takes none of it along.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that this Python worker holds but does not use goes back to the system. A worker lives on after its task, beside
    those of other stages and the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(run):
    """A function over the batches of a task that gives memory back at its end."""
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def text_bytes(name: str = "text") -> Column:
    """A text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _holds_map(kind.elementType)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns. Maps, which Spark does not hash, go by their JSON."""
    columns = zip(columns_of(docs), docs.schema.fields)
    return F.xxhash64(*(F.to_json(F.struct(c.alias("c"))) if _holds_map(f.dataType) else c for c, f in columns))


def hashed_share(key: Column, rows: int, total: int) -> Column:
    """Whether a row belongs to a fixed sample of about ``rows`` of ``total``: by a hash of ``key``, so without a sort."""
    share = min(1.0, rows / max(total, 1))
    return F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + (share == 1.0))


def values(column):
    """The values of an Arrow column one by one: texts are not held as a list beside the batch."""
    for value in column:
        yield value.as_py()


# Bytes of the values that are worked on together in a task.
PORTION_BYTES = 4 << 20


def portions(column, size: int | None = None):
    """Slices of a binary Arrow column, one value at least and below ``size`` bytes otherwise."""
    upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = done = 0
    while start < len(column):
        stop = max(int(np.searchsorted(upto, done + (size or PORTION_BYTES), side="right")), start + 1)
        yield column.slice(start, stop - start)
        start, done = stop, upto[stop - 1]


def _star(pairs: DataFrame) -> tuple[int, object]:
    """A count and an order-free sum that tell one set of pairs from another."""
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges`` that has a smaller node in its component.

    Components are named after their smallest node; that node itself has no row. Alternates
    large and small stars (each node tells its larger neighbours, then its smaller ones,
    the smallest node it knows), which needs about log(n) rounds. Every round is written to
    the shared folder. Edges are only joined with one row per node, so a node with very many
    neighbours is a skewed join that can be split.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    pairs = settle(pairs, "edges")
    seen = _star(pairs)
    while seen[0]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = settle(small.unionAll(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _star(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


# Copies of one row that a task writes out at a time.
COPIES_AT_ONCE = 1 << 16


def copies(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``number``; the column ``times`` goes.

    A row that is repeated very often is cut into shares first, which are dealt over the tasks.
    """
    share = F.explode(F.sequence(F.lit(0), F.expr(f"({times} - 1) div {COPIES_AT_ONCE}")))
    shares = rows.select("*", share.alias("_share"))
    shares = shares.repartition(*[c for c in shares.columns if c != times])
    first = F.col("_share").cast("bigint") * COPIES_AT_ONCE
    last = F.least(F.col(times), first + COPIES_AT_ONCE) - 1
    return shares.select(*[c for c in rows.columns if c != times], F.explode(F.sequence(first, last)).alias(number))
