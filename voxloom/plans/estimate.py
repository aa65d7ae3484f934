"""What a request will give: clips and hours per language, totals, shortfall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.columns import avg_clip_seconds, country_name, exact_sum, round_to, split_size
from voxloom.operators.sampling import check_caps

# Less than this share of a request counts as a shortfall.
MET = 0.98
# Languages the summary of a shortfall names.
NAMED = 6


def plan_samples(
    selection: DataFrame,
    *,
    per_language: int | None = None,
    max_seconds: float | None = None,
    min_clip_seconds: float | None = None,
    max_clip_seconds: float | None = None,
    split: str = "train",
) -> DataFrame:
    """Estimated clips and audio per language under the caps, one row per selected language.

    Clips are taken to have the mean length of their language, moved into the length
    window. The digit filter and the spread of lengths are left out of account, so this
    is an upper estimate.
    """
    check_caps(per_language, max_seconds)
    mean = avg_clip_seconds()
    lowest = F.lit(float(min_clip_seconds or 0.0))
    highest = F.lit(float("inf") if max_clip_seconds is None else float(max_clip_seconds))
    clip_seconds = F.when(mean > 0, F.least(F.greatest(mean, lowest), highest)).otherwise(F.lit(0.0))

    bounds = [F.col("available")]
    if per_language is not None:
        bounds.append(F.lit(per_language).cast("bigint"))
    if max_seconds is not None:
        fits = F.greatest(F.lit(1).cast("bigint"), F.rint(F.lit(float(max_seconds)) / F.col("_clip")).cast("bigint"))
        bounds.append(F.when(F.col("_clip") > 0, fits).otherwise(F.col("available")))
    planned = F.least(*bounds) if len(bounds) > 1 else bounds[0]

    audio = round_to(F.col("planned") * F.col("_clip"), 1)
    if max_seconds is not None:
        audio = round_to(F.least(audio, F.col("available") * F.col("_clip")), 1)
    return (
        selection.withColumns({
            "country_name": country_name(F.col("country")),
            "split": F.lit(split),
            "available": split_size(split),
            "_clip": clip_seconds,
        })
        .withColumn("planned", planned)
        .withColumn("planned_seconds", audio)
        .withColumn("planned_hours", round_to(F.col("planned_seconds") / 3600, 2))
        .drop("_clip")
    )


def plan_view(plan: DataFrame, *, brief: bool = False) -> DataFrame:
    """The columns of a plan people look at, under the names they know."""
    shown = [
        F.col("language"), F.col("country_name").alias("country"), F.col("iso"), F.col("hours"),
        F.col("available").alias("in_split"), F.col("planned").alias("to_pull"),
    ]
    if brief:
        return plan.select(*shown, F.col("planned_hours").alias("est_h"))
    return plan.select(*shown[:4], "clips", *shown[4:], F.col("planned_hours").alias("est_hours"), "subset")


def plan_totals(plan: DataFrame) -> DataFrame:
    """One row: languages, countries, planned clips and hours."""
    return plan.agg(
        F.count("*").alias("languages"),
        F.count_distinct("country").alias("countries"),
        F.coalesce(F.sum("planned"), F.lit(0)).alias("planned_clips"),
        round_to(exact_sum(F.col("planned_hours")), 2).alias("planned_hours"),
    )


def even_budget(total_hours: float | None, max_hours_per_lang: float | None, languages: int) -> float | None:
    """Seconds each language may have: an even share of the total, else its own limit; 0 means no limit."""
    if total_hours:
        return total_hours * 3600 / max(1, languages)
    return max_hours_per_lang * 3600 if max_hours_per_lang else None


def even_budget_table(selection: DataFrame, total_hours: float) -> DataFrame:
    """The even share as a one-row table: (languages, seconds_each)."""
    return selection.agg(F.count("*").alias("languages")).withColumn(
        "seconds_each", F.lit(float(total_hours)) * 3600 / F.greatest(F.lit(1), F.col("languages"))
    )


def _limiting(seconds_each: float | None):
    return F.lit(False) if seconds_each is None else F.col("planned_seconds") < F.lit(seconds_each * MET)


def shortfall(plan: DataFrame, seconds_each: float | None) -> DataFrame:
    """One row for each language that limits a plan: (position, language, planned_seconds, missing_seconds)."""
    missing = F.lit(float(seconds_each or 0.0)) - F.col("planned_seconds")
    return plan.where(_limiting(seconds_each)).select("position", "language", "planned_seconds", missing.alias("missing_seconds"))


def shortfall_summary(plan: DataFrame, requested_hours: float, seconds_each: float | None) -> DataFrame:
    """One row: hours requested and planned, whether that falls short, how many languages limit it,
    and the first six of these as text, with '…' when there are more. ``shortfall`` has them all.
    """
    limiting = _limiting(seconds_each)
    # The named languages are a top-k: no list ever holds more than six entries.
    first = plan.where(limiting).orderBy("position").limit(NAMED).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "language"))), lambda e: e["language"]), ", ")
        .alias("names")
    ).scalar()
    totals = plan.agg(
        round_to(exact_sum(F.col("planned_hours")), 2).alias("planned_hours"),
        F.count_if(limiting).alias("limiting"),
    )
    short = F.col("planned_hours") < F.lit(float(requested_hours)) * MET
    names = F.concat(first, F.when(F.col("limiting") > NAMED, F.lit("…")).otherwise(F.lit("")))
    return totals.select(
        F.lit(float(requested_hours)).alias("requested_hours"),
        "planned_hours",
        short.alias("short"),
        "limiting",
        F.when(short, names).otherwise(F.lit("")).alias("limited_by"),
    )
