"""Choosing languages: by strength, balanced over countries, or by name.

Every selection carries ``position``, the 1-based place of a language in it. Equal
hours are ranked by subset name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.joins import local_table
from voxloom.schemas import CATALOG_COLUMNS


def _strongest_first():
    return [F.desc("hours"), F.asc("subset")]


def _take(ranked: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows in an order, numbered. The numbering window sees those ``n`` rows only."""
    first = ranked.orderBy(*order).limit(max(n, 0))
    position = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return first.withColumn("position", position).select("position", *CATALOG_COLUMNS)


def select_top(
    catalog: DataFrame,
    n: int,
    *,
    proportional: bool = True,
    max_per_country: int | None = None,
    fill: bool = False,
) -> DataFrame:
    """Up to ``n`` languages with the most hours, no more than ``max_per_country`` from a country.

    ``proportional`` deals them out in rounds: languages are ordered by their rank within
    their country first, and within a round by the hours of the country's best language. The
    last round is the one after the smallest country (or the cap) is used up, whether or not
    ``n`` is reached; ``fill=True`` lifts that and only stops at ``n``.
    """
    if max_per_country is not None and max_per_country < 0:
        raise ValueError("max_per_country must not be negative")
    if not proportional and max_per_country is None:
        return _take(catalog, n, *_strongest_first())

    per_country = n if max_per_country is None else min(n, max_per_country)
    in_country = Window.partitionBy("country").orderBy(*_strongest_first())
    # No country can give more than per_country languages. As a bound on row_number this
    # also runs before the shuffle, so a country with most of the catalog stays small.
    ranked = catalog.withColumn("depth", F.row_number().over(in_country)).where(F.col("depth") <= per_country)
    if not proportional:
        return _take(ranked, n, *_strongest_first())

    if not fill:
        sizes = catalog.groupBy("country").agg(F.count("*").alias("size"))
        capped = F.col("size") if max_per_country is None else F.least("size", F.lit(max_per_country))
        shortest = sizes.agg(F.min(capped)).scalar()
        ranked = ranked.where(F.col("depth") <= shortest + 1)
    visited = ranked.withColumns({
        "lead_hours": F.first("hours").over(in_country),
        "lead_subset": F.first("subset").over(in_country),
    })
    return _take(visited, n, F.asc("depth"), F.desc("lead_hours"), F.asc("lead_subset"))


def name_list(names: str | Iterable[str]) -> list[str]:
    """Names from a list or from comma-separated text; blanks are trimmed and empty ones skipped."""
    parts = names.split(",") if isinstance(names, str) else names
    return [name.strip() for name in parts if name.strip()]


def unknown_names(catalog: DataFrame, names: str | Iterable[str]) -> DataFrame:
    """Names that are no subset of the catalog."""
    wanted = name_list(names)
    asked = local_table(catalog, {"subset": wanted}, "subset string").distinct()
    return asked.join(catalog.select("subset").where(F.col("subset").isin(wanted)), "subset", "left_anti")


def pick_languages(catalog: DataFrame, names: str | Iterable[str], *, strict: bool = True) -> DataFrame:
    """Languages by name, in the given order, repeats kept.

    An unknown name is an error, or is left out when not ``strict``.
    """
    wanted = name_list(names)
    if strict:
        missing = sorted(row.subset for row in unknown_names(catalog, wanted).collect())
        if missing:
            raise KeyError(f"unknown subset: {', '.join(missing)}")
    asked = local_table(
        catalog, {"position": list(range(1, len(wanted) + 1)), "subset": wanted},
        "position bigint, subset string",
    )
    # At most one catalog row per requested name is left, whatever the catalog's size.
    known = catalog.where(F.col("subset").isin(wanted))
    return asked.join(known, "subset").select("position", *CATALOG_COLUMNS)
