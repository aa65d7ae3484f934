"""A whole selection as one batch job: filter, select, plan, guard, build, export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from voxloom.operators.catalog import filter_catalog
from voxloom.operators.clips import apply_schema
from voxloom.operators.joins import settle
from voxloom.operators.ranking import name_list, pick_languages, select_top
from voxloom.plans.dataset import build_dataset, build_summary
from voxloom.plans.estimate import even_budget, plan_samples, plan_totals, shortfall, shortfall_summary
from voxloom.schemas import MANIFEST_FILES, STANDARD_COLUMNS
from voxloom.sinks.datasets import (
    laid_out_by_subset, read_dataset, write_dataset, write_manifest_csv, write_parquet,
)
from voxloom.sinks.manifests import export_manifests

TABLE_FORMATS = ("disk", "parquet", "csv")


@dataclass(frozen=True)
class SelectionConfig:
    """Everything a selection job is told. ``languages`` overrides ``top`` and the filters."""

    top: int | None = None
    languages: str | list[str] | None = None
    proportional: bool = True
    max_per_country: int | None = None
    min_hours: float = 0.0
    max_hours: float | None = None
    min_clips: int = 0
    countries: str | None = None
    split: str = "train"
    total_hours: float | None = None
    per_language: int | None = None
    max_hours_per_lang: float | None = None
    min_clip_seconds: float | None = 3.0
    max_clip_seconds: float | None = 15.0
    seed: int = 42
    schema: str = "default"
    formats: str | list[str] = "disk"
    as_stream: bool | None = None
    allow_full: bool = False
    dry_run: bool = False


@dataclass(frozen=True)
class SelectionResult:
    selection: DataFrame
    seconds_each: float | None
    plan: DataFrame
    totals: DataFrame
    shortfall: DataFrame | None
    limiting: DataFrame | None = None
    built: DataFrame | None = None
    summary: DataFrame | None = None
    written: dict[str, str] = field(default_factory=dict)


def check_formats(formats: str | list[str]) -> list[str]:
    names = list(dict.fromkeys(name_list(formats)))
    unknown = [name for name in names if name not in TABLE_FORMATS and name not in MANIFEST_FILES]
    if unknown:
        raise ValueError(f"unknown format: {', '.join(unknown)}")
    return names


def choose_languages(catalog: DataFrame, config: SelectionConfig) -> DataFrame:
    if config.languages:
        return pick_languages(catalog, config.languages)
    if not config.top:
        raise ValueError("the job needs a number of languages (top) or their names (languages)")
    pool = filter_catalog(
        catalog, min_hours=config.min_hours, max_hours=config.max_hours, min_clips=config.min_clips,
        countries=config.countries.split(",") if config.countries else None, split=config.split,
    )
    return select_top(pool, config.top, proportional=config.proportional, max_per_country=config.max_per_country)


def run_selection(clips: DataFrame, catalog: DataFrame, config: SelectionConfig, out: str) -> SelectionResult:
    """Plan a selection and, unless it is a dry run, build and write it below ``out``.

    A source with a folder for each subset is written as it is scanned, so its audio is not
    shuffled; small samples then have small files. The build is written once, as a dataset with the internal columns; all other formats
    are made from that, so sampling and filtering run once and manifests read no audio.
    ``schema`` shapes tables, not manifests. A pull without any cap is refused unless
    ``allow_full``.
    """
    formats = check_formats(config.formats)
    selection, languages = settle(choose_languages(catalog, config))
    if languages == 0:
        raise ValueError("no languages match these filters")
    seconds_each = even_budget(config.total_hours, config.max_hours_per_lang, languages)
    plan = plan_samples(
        selection, per_language=config.per_language, max_seconds=seconds_each,
        min_clip_seconds=config.min_clip_seconds, max_clip_seconds=config.max_clip_seconds, split=config.split,
    )
    requested = config.total_hours or (config.max_hours_per_lang or 0.0) * languages
    result = SelectionResult(
        selection, seconds_each, plan, plan_totals(plan),
        shortfall_summary(plan, requested, seconds_each) if requested else None,
        shortfall(plan, seconds_each) if requested else None,
    )
    if config.dry_run:
        return result

    capped = config.per_language is not None or seconds_each is not None
    if not capped and not config.allow_full:
        raise ValueError("without a cap on any language this would copy the whole source; allow_full=True permits it")
    as_stream = capped if config.as_stream is None else config.as_stream

    spark, out = clips.sparkSession, out.rstrip("/")
    dataset = f"{out}/dataset"
    write_dataset(
        build_dataset(
            clips, selection, split=config.split, per_language=config.per_language, max_seconds=seconds_each,
            min_clip_seconds=config.min_clip_seconds, max_clip_seconds=config.max_clip_seconds,
            seed=config.seed, as_stream=as_stream, internals=True,
        ),
        dataset, gather=not laid_out_by_subset(clips),
    )
    built = read_dataset(spark, dataset)
    shaped = apply_schema(built.select(*STANDARD_COLUMNS), config.schema)
    manifests = [name for name in formats if name in MANIFEST_FILES]
    # Numbered once for all layouts.
    written = export_manifests(built, manifests, out, seed=config.seed, ordered_splits=as_stream) if manifests else {}
    for name in formats:
        if name == "disk" and shaped.columns == STANDARD_COLUMNS:
            written[name] = dataset
        elif name == "disk":
            write_parquet(shaped, f"{out}/dataset_{config.schema}")
            written[name] = f"{out}/dataset_{config.schema}"
        elif name == "parquet":
            write_parquet(shaped, f"{out}/parquet")
            written[name] = f"{out}/parquet"
        elif name == "csv":
            write_manifest_csv(shaped, f"{out}/manifest_csv")
            written[name] = f"{out}/manifest_csv"
    return SelectionResult(
        selection, seconds_each, plan, result.totals, result.shortfall, result.limiting, built, build_summary(built), written
    )
