"""The same filters and caps on clips that keep arriving.

Filtering alone is stateless and runs as an ordinary streaming DataFrame. So does a capped
pull of the files that are there: a draw is told by its last clip, which a job on narrow columns finds
before the stream starts. Caps on clips that keep arriving need to
know what earlier micro-batches admitted. That state is one row per language, kept in two
small tables that take turns; each micro-batch is an ordinary
distributed draw that starts from the last one. A language with most of the clips is thus split
over tasks like any other data, where a per-key state function would pass all of it
through one task.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from decimal import Decimal
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxloom.functions.columns import TICKS, tick_limit, ticks
from voxloom.operators.clips import (
    apply_schema, clip_window_stream, drop_digit_text, source_view, standardise,
)
from voxloom.operators.joins import settle
from voxloom.operators.sampling import check_caps, draw, last_places, up_to
from voxloom.plans.dataset import of_selection, selected
from voxloom.schemas import STANDARD_COLUMNS
from voxloom.sources.clips import in_split

FILES_PER_BATCH = 1_000
STATE_SCHEMA = f"subset string, taken_clips bigint, taken_ticks {TICKS}"


def stream_clips(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """A folder of clip files as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_filter(
    clips: DataFrame,
    selection: DataFrame,
    *,
    split: str = "train",
    min_clip_seconds: float | None = None,
    max_clip_seconds: float | None = None,
) -> DataFrame:
    """Clips of the selected languages in the standard layout, as they arrive.

    Works on streaming and batch tables alike. Subsets without a catalog row are skipped.
    """
    selection, rows = settle(selection)
    wanted = of_selection(in_split(clips, split), selection, rows)
    usable = clip_window_stream(wanted, min_clip_seconds, max_clip_seconds)
    return standardise(source_view(drop_digit_text(usable), measure=False), selection, rows)


def _stored(read) -> DataFrame | None:
    """The table that ``read`` opens, or None where there is no such folder."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _state_at(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """What was admitted up to and including a micro-batch.

    The states of even and of odd micro-batches have a folder each. A micro-batch reads the one that it
    does not write, so it can be repeated, and older states are overwritten.
    """
    if epoch < 0:
        return spark.createDataFrame([], STATE_SCHEMA)
    kept = spark.read.schema(f"{STATE_SCHEMA}, epoch bigint").parquet(f"{path}/turn={epoch % 2}")
    if kept.where(F.col("epoch") == epoch).isEmpty():
        raise ValueError(f"{path} does not hold the state of micro-batch {epoch}")
    return kept.where(F.col("subset").isNotNull()).drop("epoch")


def _keep_state(state: DataFrame, path: str, epoch: int) -> None:
    """Write the state of a micro-batch. A row without a subset shows that it is there, if empty."""
    mark = state.sparkSession.createDataFrame([(None, 0, Decimal(0))], STATE_SCHEMA)
    state.unionByName(mark).withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/turn={epoch % 2}")


def _same_settings(spark: SparkSession, path: str, settings: str) -> None:
    """Store the settings of a first start; a later one must have the same."""
    stored = _stored(lambda: spark.read.text(path))
    kept = None if stored is None else stored.first()
    if kept is None:
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif kept[0] != settings:
        raise ValueError(f"{path} has other settings: {kept[0]}")


def stream_admit(
    spark: SparkSession,
    path: str,
    clip_schema: T.StructType,
    selection: DataFrame | str | list[str],
    out: str,
    *,
    catalog: DataFrame | None = None,
    split: str = "train",
    per_language: int | None = None,
    max_seconds: float | None = None,
    min_clip_seconds: float | None = None,
    max_clip_seconds: float | None = None,
    seed: int = 42,
    files_per_batch: int = FILES_PER_BATCH,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Admit arriving clips until each language has its clip count or its seconds.

    Clips are admitted as they arrive; within a micro-batch in split order, then draw order. The clip that
    crosses a budget stays, so a language ends at most one clip over it. Results are in
    ``out``/clips. Without another ``trigger`` the query takes in all files present and
    stops; started again on the same ``out`` it goes on with new ones.

    Each micro-batch only names its files. They are read by the draw itself, which prunes
    columns and the languages that are already full. Clips are written under
    the number of the micro-batch and replaced when it is repeated after a failure; one that admits
    nothing leaves no folder. Of the states two are kept, so neither grows while all languages are full.
    The settings are kept beside the state: ``out`` is refused with others, as what it holds
    was admitted under the first ones.
    """
    check_caps(per_language, max_seconds)
    selection, rows = settle(selected(selection, catalog, strict=False))
    _same_settings(spark, f"{out}/settings", json.dumps({
        "path": path, "split": split, "per_language": per_language, "max_seconds": max_seconds, "seed": seed,
        "window": [min_clip_seconds, max_clip_seconds],
        "subsets": selection.agg(F.count("*"), F.sum(F.xxhash64("subset").cast("decimal(38,0)")).cast("string")).first(),
    }))
    repeats = selection.groupBy("subset").agg(F.count("*").alias("_repeats"))
    state_path, clips_path = f"{out}/state", f"{out}/clips"

    open_clips = F.lit(True) if per_language is None else F.col("taken_clips") < per_language
    open_ticks = F.lit(True) if max_seconds is None else F.col("taken_ticks") < tick_limit(max_seconds)

    def admit(batch: DataFrame, epoch: int) -> None:
        # At most files_per_batch names, which come percent-encoded.
        names = [unquote(row.file_path) for row in batch.distinct().collect()]
        before = _state_at(spark, state_path, epoch - 1)
        if not names:
            _keep_state(before, state_path, epoch)
            return
        clips = spark.read.schema(clip_schema).option("basePath", path).parquet(*names)
        full = before.where(~(open_clips & open_ticks)).select("subset")
        wanted = of_selection(in_split(clips, split), selection.join(full, "subset", "left_anti"), rows)
        usable = drop_digit_text(clip_window_stream(wanted, min_clip_seconds, max_clip_seconds))
        admitted = draw(
            source_view(usable, measure=False), per_language=per_language, max_seconds=max_seconds,
            nearest=False, ordered_splits=True, seed=seed, unfiltered=wanted, taken=before,
        )
        # Only the folder of this micro-batch is replaced, and made only if there are rows.
        standardise(admitted, selection, rows).withColumn("epoch", F.lit(epoch)).write.partitionBy("epoch").option(
            "partitionOverwriteMode", "dynamic"
        ).mode("overwrite").parquet(clips_path)
        written = _stored(lambda: spark.read.parquet(f"{clips_path}/epoch={epoch}"))
        if written is None:
            _keep_state(before, state_path, epoch)
            return
        # A language selected twice has its clips twice in the output but takes them once.
        added = (
            written.groupBy("subset")
            .agg(F.count("*").alias("_clips"), F.sum(F.greatest(ticks(F.col("length")), F.lit(0).cast(TICKS))).alias("_ticks"))
            .join(repeats, "subset")
            .select(
                "subset",
                F.expr("_clips div _repeats").alias("taken_clips"),
                (F.col("_ticks") / F.col("_repeats").cast("decimal(10,0)")).cast(TICKS).alias("taken_ticks"),
            )
        )
        state = before.unionByName(added).groupBy("subset").agg(
            F.sum("taken_clips").alias("taken_clips"), F.sum("taken_ticks").cast(TICKS).alias("taken_ticks")
        )
        _keep_state(state, state_path, epoch)

    arriving = stream_clips(spark, path, clip_schema, files_per_batch).select(F.col("_metadata.file_path"))
    return (
        arriving.writeStream.foreachBatch(admit)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_dataset(
    spark: SparkSession,
    path: str,
    clip_schema: T.StructType,
    selection: DataFrame | str | list[str],
    *,
    catalog: DataFrame | None = None,
    schema: str | None = None,
    split: str = "train",
    per_language: int | None = None,
    max_seconds: float | None = None,
    min_clip_seconds: float | None = None,
    max_clip_seconds: float | None = None,
    seed: int = 42,
    files_per_batch: int = FILES_PER_BATCH,
    as_of: datetime | None = None,
) -> DataFrame:
    """What is to be had from the files present, under caps, as a streaming table; nothing is written.

    The draw takes train, then val, then test clips, and keeps the clip that crosses a budget, however
    the files are dealt over micro-batches. ``selection`` may be names, of which unknown ones are skipped.

    The last clip of each language is found here, once, on narrow columns. The stream itself
    keeps no state: each clip is compared with the last one of its language, so a pull of any size goes on
    from its checkpoint after a failure. Files changed after ``as_of`` (now, if not given) are no part of
    it, in the draw and in the stream; a pull that is started again gives the ``as_of`` of its first start.
    For clips that keep arriving see ``stream_admit``.
    """
    check_caps(per_language, max_seconds)
    selection, rows = settle(selected(selection, catalog, strict=False))
    as_of = as_of or datetime.now(timezone.utc)

    def usable(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
        present = clips.where(F.col("_metadata.file_modification_time") <= F.lit(as_of))
        wanted = of_selection(in_split(present, split), selection, rows)
        kept = drop_digit_text(clip_window_stream(wanted, min_clip_seconds, max_clip_seconds))
        return source_view(kept, measure=False), wanted

    pulled, _ = usable(stream_clips(spark, path, clip_schema, files_per_batch))
    if per_language is not None or max_seconds is not None:
        present, wanted = usable(spark.read.schema(clip_schema).parquet(path))
        ends, languages, largest = last_places(
            present, per_language=per_language, max_seconds=max_seconds, nearest=False, ordered_splits=True, seed=seed, unfiltered=wanted
        )
        pulled = up_to(pulled, ends, languages, largest, seed=seed, ordered_splits=True)
    return apply_schema(standardise(pulled, selection, rows).select(*STANDARD_COLUMNS), schema)
