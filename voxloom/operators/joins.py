"""Joining a large clip table with a table that has one row per language."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only after its rows and bytes have been found to be within these limits.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
# Above them both sides are shuffled, with every language spread over this many tasks
# where its size is not known.
SALTS = 64
# Names up to this many become a literal filter, which prunes partition folders. They are a part of
# the settled selection, so they are few enough for the driver anyway.
LITERAL_NAMES = 50_000


def settle(df: DataFrame) -> tuple[DataFrame, int]:
    """A small table computed once and kept as a local relation, with its number of rows.

    A selection that is used several times is then not derived again, and Catalyst knows
    its exact size. A table beyond the limits is returned as it is, with one row more than
    BROADCAST_ROWS.
    """
    rows = df.limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS or rows.nbytes > BROADCAST_BYTES:
        return df, BROADCAST_ROWS + 1
    return df.sparkSession.createDataFrame(rows, schema=df.schema), rows.num_rows


def one_of(column: str, names: list[str]) -> Column:
    """Whether a column holds one of many names, as a filter that reaches the scan.

    The list is parsed as one expression, as thousands of single literals would each be a call to the JVM;
    names are written as bytes, which need no quoting.
    """
    if not names:
        return F.lit(False)
    quoted = column.replace("`", "``")
    return F.expr(f"`{quoted}` IN (" + ", ".join(f"CAST(X'{name.encode().hex()}' AS STRING)" for name in names) + ")")


def local_table(df_or_spark, columns: dict[str, list], schema) -> DataFrame:
    """A small table of the caller's own values."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.createDataFrame(pa.table(columns), schema=schema)


def attach(
    facts: DataFrame, dim: DataFrame, on: str | list[str], dim_rows: int, spread_by: str = "clip_id", salts: int = SALTS
) -> DataFrame:
    """Inner join of clips with a table of at most ``dim_rows`` rows.

    A table within the limit is broadcast. A larger one is shuffled; since one
    language may own a third of all clips, its clips are spread over ``salts``
    tasks by a hash of the clip, and the language row is repeated for each.
    """
    if dim_rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dim), on)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts)).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*([on] if isinstance(on, str) else on), "_salt"]).drop("_salt")
