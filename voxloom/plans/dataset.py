"""Building the clip table of a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.columns import seconds, ticks
from voxloom.operators.clips import (
    apply_schema, clip_window, clip_window_stream, drop_digit_text, id_column, source_view, standardise,
)
from voxloom.operators.joins import LITERAL_NAMES, attach, one_of, settle
from voxloom.operators.ranking import pick_languages
from voxloom.operators.sampling import check_caps, draw
from voxloom.schemas import STANDARD_COLUMNS
from voxloom.sources.clips import in_split


def of_selection(clips: DataFrame, selection: DataFrame, rows: int) -> DataFrame:
    """Clips of the selected subsets only.

    A selection of up to LITERAL_NAMES becomes a literal filter, so other partition folders are never opened.
    """
    subsets = selection.select("subset")
    if rows <= LITERAL_NAMES:
        return clips.where(one_of("subset", sorted({row.subset for row in subsets.collect() if row.subset is not None})))
    return attach(clips, subsets.distinct(), "subset", rows, id_column(clips))


def selected(selection, catalog: DataFrame | None = None, *, strict: bool = True) -> DataFrame:
    """A selection as a table: catalog rows as they are, or names looked up in ``catalog``."""
    if isinstance(selection, DataFrame):
        return selection
    if catalog is None:
        raise ValueError("languages given by name need a catalog to look them up in")
    return pick_languages(catalog, selection, strict=strict)


def build_dataset(
    clips: DataFrame,
    selection: DataFrame | str | list[str],
    *,
    catalog: DataFrame | None = None,
    split: str = "train",
    per_language: int | None = None,
    max_seconds: float | None = None,
    min_clip_seconds: float | None = None,
    max_clip_seconds: float | None = None,
    schema: str | None = None,
    seed: int = 42,
    as_stream: bool = False,
    keep_crossing: bool = False,
    internals: bool = False,
) -> DataFrame:
    """Clips of all selected languages, filtered, capped per language and in one layout.

    ``clips`` is a source table with subset, split, clip_id or id, audio, and transcript
    and duration under any accepted name. ``selection`` has catalog columns, and
    ``position`` where order or repeats matter: a language selected twice comes twice. It may
    also be names of subsets, which are looked up in ``catalog``; unknown ones are an error.

    Filters come first, so dropped clips never count toward a cap. ``as_stream`` follows
    the rules of the capped row-by-row pull: clips of unknown length count as 0 seconds
    and pass a window from 0, and splits are drawn one after the other. ``keep_crossing``
    keeps the clip that crosses a budget, where stopping before it may be nearer.

    With ``internals`` the columns position, clip_id and split stay, which exports need.
    """
    check_caps(per_language, max_seconds)
    selection, rows = settle(selected(selection, catalog))
    if rows == 0:
        raise ValueError("the selection is empty")
    wanted = of_selection(in_split(clips, split), selection, rows)
    window = clip_window_stream if as_stream else clip_window
    usable = drop_digit_text(window(wanted, min_clip_seconds, max_clip_seconds))
    drawn = draw(
        source_view(usable, measure=not as_stream), per_language=per_language, max_seconds=max_seconds,
        nearest=not keep_crossing, ordered_splits=as_stream, seed=seed, unfiltered=wanted,
    )
    built = standardise(drawn, selection, rows)
    if internals:
        return built
    return apply_schema(built.select(*STANDARD_COLUMNS), schema)


def build_subset(clips: DataFrame, catalog: DataFrame, subset: str, **options) -> DataFrame:
    """``build_dataset`` for one language of the catalog."""
    entry = catalog.where(F.col("subset") == subset)
    small, rows = settle(entry)
    if rows == 0:
        raise KeyError(f"unknown subset: {subset}")
    return build_dataset(clips, small, **options)


def build_summary(built: DataFrame) -> DataFrame:
    """One row: clips and languages built."""
    return built.agg(F.count("*").alias("clips"), F.count_distinct("subset").alias("languages"))


def build_summary_by_language(built: DataFrame) -> DataFrame:
    """Clips and seconds built per language."""
    return built.groupBy("subset", "language").agg(
        F.count("*").alias("clips"), seconds(F.sum(ticks(F.col("length")))).alias("seconds")
    )
