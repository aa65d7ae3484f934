"""Filters, lookups and totals over the language catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.columns import country_name, exact_sum, round_to, split_size
from voxloom.operators.ranking import select_top


def filter_catalog(
    catalog: DataFrame,
    *,
    min_hours: float = 0.0,
    max_hours: float | None = None,
    min_clips: int = 0,
    countries: Iterable[str] | None = None,
    split: str = "train",
    require_split: bool = True,
) -> DataFrame:
    """Languages within the given strength, in the given countries, with clips in ``split``.

    Both hour bounds are inclusive. Country codes are compared in upper case.
    """
    available = split_size(split)
    kept = catalog.where((F.col("hours") >= min_hours) & (F.col("clips") >= min_clips))
    if max_hours is not None:
        kept = kept.where(F.col("hours") <= max_hours)
    codes = [code.upper() for code in countries or []]
    if codes:
        kept = kept.where(F.col("country").isin(codes))
    if require_split and split != "all":
        kept = kept.where(available > 0)
    return kept


def entry_records(catalog: DataFrame) -> DataFrame:
    """Catalog rows with the display name of their country."""
    return catalog.withColumn("country_name", country_name(F.col("country")))


def countries(catalog: DataFrame) -> DataFrame:
    """Distinct country codes, sorted."""
    return catalog.select("country").distinct().orderBy("country")


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """One row: languages, hours to one decimal, countries."""
    return catalog.agg(
        F.count("*").alias("languages"),
        round_to(exact_sum(F.col("hours")), 1).alias("total_hours"),
        F.count_distinct("country").alias("countries"),
    )


def list_languages(
    catalog: DataFrame,
    *,
    min_hours: float = 0.0,
    max_hours: float | None = None,
    min_clips: int = 0,
    countries: Iterable[str] | None = None,
    top: int | None = None,
    proportional: bool = True,
    max_per_country: int | None = None,
) -> DataFrame:
    """Listing of the languages that match, strongest first, empty splits included."""
    pool = filter_catalog(
        catalog, min_hours=min_hours, max_hours=max_hours, min_clips=min_clips,
        countries=countries, require_split=False,
    )
    if top:
        pool = select_top(pool, top, proportional=proportional, max_per_country=max_per_country)
    name = country_name(F.col("country"))
    return pool.select(
        "subset", "language", "country",
        F.when(name != F.col("country"), name).otherwise(F.lit("")).alias("country_name"),
        "hours", "clips",
    ).orderBy(F.desc("hours"), "subset")
