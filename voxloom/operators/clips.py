"""Clip filters and column layouts. All of these are narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.columns import has_channels, has_digit, has_samples, one_channel, split_name, waveform_length
from voxloom.operators.joins import attach
from voxloom.schemas import STANDARD_COLUMNS, TRAINING_SCHEMAS
from voxloom.sources.clips import duration_column, in_split, text_column


def clip_window(
    clips: DataFrame, min_clip_seconds: float | None = None, max_clip_seconds: float | None = None
) -> DataFrame:
    """Clips within a length window, both ends included.

    With either bound set, clips of unknown length (null or NaN) are dropped. A source
    without a duration column is left alone.
    """
    recorded = duration_column(clips.columns)
    if recorded is None or (min_clip_seconds is None and max_clip_seconds is None):
        return clips
    lowest = float("-inf") if min_clip_seconds is None else float(min_clip_seconds)
    highest = float("inf") if max_clip_seconds is None else float(max_clip_seconds)
    # NaN sorts above every number, so the upper bound, always present, drops it.
    length = F.col(recorded)
    return clips.where(length.isNotNull() & (length >= lowest) & (length <= highest))


def clip_window_stream(
    clips: DataFrame, min_clip_seconds: float | None = None, max_clip_seconds: float | None = None
) -> DataFrame:
    """The window as a stream of clips applies it: an unknown length counts as 0, NaN passes."""
    recorded = duration_column(clips.columns)
    length = F.coalesce(F.col(recorded).cast("double"), F.lit(0.0)) if recorded else F.lit(0.0)
    if min_clip_seconds is not None:
        clips = clips.where((length >= float(min_clip_seconds)))
    if max_clip_seconds is not None:
        clips = clips.where((length <= float(max_clip_seconds)) | F.isnan(length))
    return clips


def drop_digit_text(clips: DataFrame) -> DataFrame:
    """Drop clips whose transcript holds a digit: such text tends to be aligned badly."""
    transcript = text_column(clips.columns)
    return clips if transcript is None else clips.where(~has_digit(F.col(transcript)))


def concat_splits(clips: DataFrame) -> DataFrame:
    """All known splits of a table as one: a single scan, not a union of three."""
    return in_split(clips, "all")


def id_column(clips: DataFrame) -> str:
    """The column that tells clips apart: clip_id, or id where there is none by that name."""
    return "clip_id" if "clip_id" in clips.columns else "id"


def source_view(clips: DataFrame, measure: bool = True) -> DataFrame:
    """Source columns under their standard names: clip_id, subset, split, audio, text, length.

    clip_id must be set and unique within a subset and split: it fixes the random order.
    Without a duration column clips are measured on their samples, or count as 0 if not to
    be measured. Decoded audio of several channels is mixed down to one.
    """
    if "audio" not in clips.columns:
        raise ValueError(f"clips have no 'audio' column (found {clips.columns})")
    kind = clips.schema["audio"].dataType
    if has_channels(kind):
        mixed = F.struct(one_channel(F.col("audio"), kind).alias("array"), F.col("audio.sampling_rate").alias("sampling_rate"))
        clips = clips.withColumn("audio", F.when(F.col("audio").isNotNull(), mixed))
    transcript, recorded = text_column(clips.columns), duration_column(clips.columns)
    if recorded:
        length = F.coalesce(F.col(recorded).cast("double"), F.lit(0.0))
    elif measure and has_samples(clips.schema["audio"].dataType):
        length = waveform_length(F.col("audio.array"), F.col("audio.sampling_rate"))
    else:
        length = F.lit(0.0)
    return clips.select(
        F.col(id_column(clips)).cast("string").alias("clip_id"),
        "subset",
        split_name(F.col("split")).alias("split"),
        "audio",
        (F.col(transcript) if transcript else F.lit("")).alias("text"),
        length.alias("length"),
    )


def standardise(clips: DataFrame, selection: DataFrame, selection_rows: int) -> DataFrame:
    """Clips in the standard layout, labelled by the catalog and not by the source.

    ``clips`` is a source table or its ``source_view``.
    """
    labels = [c for c in ("position", "subset", "language", "country", "iso") if c in selection.columns]
    labelled = attach(source_view(clips), selection.select(*labels), "subset", selection_rows)
    kept = [c for c in ("position", "clip_id", "split") if c in labelled.columns]
    return labelled.select(*kept, *STANDARD_COLUMNS)


def apply_schema(clips: DataFrame, schema: str | None = None) -> DataFrame:
    """Reshape the standard layout for a training framework; absent columns are left out."""
    name = schema or "default"
    if name not in TRAINING_SCHEMAS:
        raise ValueError(f"unknown schema {schema!r}; choose from {', '.join(TRAINING_SCHEMAS)}")
    layout = TRAINING_SCHEMAS[name]
    if layout is None:
        return clips
    return clips.select(*[F.col(old).alias(new) for new, old in layout.items() if old in clips.columns])
