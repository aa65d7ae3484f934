"""Choosing and building speech training sets from large clip tables, on Spark."""

from voxloom.operators.catalog import (
    catalog_totals, countries, entry_records, filter_catalog, list_languages,
)
from voxloom.operators.clips import (
    apply_schema, clip_window, clip_window_stream, concat_splits, drop_digit_text, standardise,
)
from voxloom.operators.numbering import number_clips, speaker_ids
from voxloom.operators.ranking import pick_languages, select_top, unknown_names
from voxloom.operators.refresh import refresh_catalog, refresh_files
from voxloom.operators.sampling import draw, holdout_split, sample_ranks
from voxloom.plans.dataset import build_dataset, build_subset, build_summary, build_summary_by_language
from voxloom.plans.estimate import (
    even_budget, plan_samples, plan_totals, plan_view, shortfall, shortfall_summary,
)
from voxloom.plans.job import SelectionConfig, SelectionResult, run_selection
from voxloom.schemas import COUNTRY_NAMES, MANIFEST_FILES, STANDARD_COLUMNS, TRAINING_SCHEMAS
from voxloom.sinks.datasets import (
    read_dataset, read_manifest_csv, write_dataset, write_manifest_csv, write_parquet,
)
from voxloom.sinks.manifests import export_manifest, export_manifests, manifest_lines, speaker_lines
from voxloom.sources.catalog import load_catalog, write_catalog
from voxloom.sources.clips import read_clips
from voxloom.streaming.clips import stream_admit, stream_clips, stream_dataset, stream_filter

