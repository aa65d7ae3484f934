"""The language catalog on disk: tab-separated text, one row per subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.columns import strip
from voxloom.schemas import CATALOG_COLUMNS, CATALOG_SCHEMA


# Quotes are doubled within quoted text, as Python's and other CSV writers do it.
TEXT_OPTIONS = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Read a catalog. Text is trimmed; a missing or malformed number is an error.

    Numbers are looked over when the catalog is opened, once: a query that uses none of them
    would not notice a bad one.
    """
    raw = (
        spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in CATALOG_SCHEMA]))
        .options(mode="FAILFAST", enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        .options(**TEXT_OPTIONS).csv(path)
    )
    text = [f.name for f in CATALOG_SCHEMA if isinstance(f.dataType, T.StringType)]
    numbers = [f for f in CATALOG_SCHEMA if f.name not in text]
    wrong = F.concat_ws(", ", *[
        F.when(F.col(f.name).try_cast(f.dataType).isNull(), F.concat(F.lit(f"{f.name}="), F.coalesce(f.name, F.lit("")))) for f in numbers
    ])
    bad = raw.select(*[F.col(c) for c in raw.columns], wrong.alias("wrong")).where("wrong <> ''").first()
    if bad is not None:
        raise ValueError(f"catalog row {bad['subset']!r} without a number: {bad['wrong']}")
    return raw.select(*[
        strip(F.coalesce(f.name, F.lit(""))).alias(f.name) if f.name in text else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in CATALOG_SCHEMA
    ])


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Write a catalog in subset order, with a header in every part."""
    (
        catalog.select(*CATALOG_COLUMNS).orderBy("subset")
        .write.options(emptyValue="", nullValue="", **TEXT_OPTIONS).csv(path)
    )
