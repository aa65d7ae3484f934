"""Numbers that run over a whole export: clip index and speaker ids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.columns import speaker_label
from voxloom.operators.joins import attach, settle
from voxloom.operators.sampling import HELPERS, refuse_audio, slot_digits, slot_of, with_sample_order

# Clips one task numbers at a time; they carry their transcripts.
NUMBERED_ROWS = 1 << 16


def _export_order(clips: DataFrame, seed: int, ordered_splits: bool) -> tuple[DataFrame, list[str], list[str]]:
    """Clips with the columns an export is ordered by: selection, if there is one, then draw order.

    The last list orders clips of a group: ids may come again in another split or subset.
    """
    groups = (["position"] if "position" in clips.columns else []) + (["_rank"] if ordered_splits else [])
    ties = ["_key", "_id", "_split", "_length", *[c for c in ("subset", "_prefix") if c in clips.columns]]
    return with_sample_order(clips, seed, ordered_splits), groups, ties


def number_clips(clips: DataFrame, *, seed: int = 42, ordered_splits: bool = False) -> DataFrame:
    """Add ``idx``, the 0-based place of a clip in the whole export.

    A row number over all clips would sort them in one task. Instead clips are numbered
    within slots of the draw order, of about NUMBERED_ROWS clips each, and the starts of
    the slots come from counts: of the slots of a stretch, of the stretches of a group, and
    of the groups, which are one for each language (and split, where splits are in order).
    A table with audio is refused.
    """
    refuse_audio(clips)
    ordered, groups, ties = _export_order(clips, seed, ordered_splits)
    # Every group has as many slots as its own size asks for: a small one has just one.
    sizes = ordered.groupBy(*groups).agg(F.count("*").alias("_size")) if groups else ordered.agg(F.count("*").alias("_size"))
    largest = sizes.agg(F.coalesce(F.max("_size"), F.lit(0))).first()[0]
    digits = slot_digits(largest, NUMBERED_ROWS)
    if digits and groups:
        sizes, count = settle(sizes)
        own = F.ceil(F.log(F.greatest(F.col("_size") / NUMBERED_ROWS, F.lit(1.0))) / math.log(16)).cast("int")
        ordered = attach(ordered, sizes.select(*groups, own.alias("_digits")), groups, count, "_id")
        ordered = ordered.withColumn("_slot", F.substr("_key", F.lit(1), F.col("_digits"))).drop("_digits")
    else:
        ordered = ordered.withColumn("_slot", slot_of(F.col("_key"), digits))
    slot = [*groups, "_slot"]

    def running(column: str, window):
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    stretch = [*groups, "_stretch"]
    counts = ordered.groupBy(*slot).agg(F.count("*").alias("_n")).withColumn("_stretch", F.substring("_slot", 1, digits // 2))
    stretches = counts.groupBy(*stretch).agg(F.sum("_n").alias("_n"))
    in_group = Window.partitionBy(*groups).orderBy("_stretch") if groups else Window.orderBy("_stretch")
    stretches = stretches.select(*stretch, running("_n", in_group).alias("_stretch_at"))
    if groups:
        at = counts.groupBy(*groups).agg(F.sum("_n").alias("_n")).select(*groups, running("_n", Window.orderBy(*groups)).alias("_group_at"))
        stretches = stretches.join(at, groups).withColumn("_stretch_at", F.col("_stretch_at") + F.col("_group_at"))
    starts = counts.withColumn("_at", running("_n", Window.partitionBy(*stretch).orderBy("_slot"))).join(stretches, stretch).select(
        *slot, (F.col("_at") + F.col("_stretch_at")).alias("_start")
    )

    in_slot = Window.partitionBy(*slot).orderBy(*ties)
    numbered = ordered.withColumn("_row", F.row_number().over(in_slot)).join(starts, slot)
    idx = (F.col("_start") + F.col("_row") - 1).cast("bigint")
    return numbered.withColumn("idx", idx).drop(*HELPERS, "_slot", "_row", "_start")


def speaker_ids(clips: DataFrame, *, seed: int = 42, ordered_splits: bool = False) -> DataFrame:
    """Speakers with dense ids by first appearance in the export: (speaker, sid).

    The first place of each speaker is a partial minimum; only the speakers themselves,
    one row each, are put in order.
    """
    ordered, groups, ties = _export_order(clips, seed, ordered_splits)
    subset = F.col("subset") if "subset" in clips.columns else F.lit(None).cast("string")
    firsts = ordered.groupBy(speaker_label(F.col("language"), subset).alias("speaker")).agg(
        F.min(F.struct(*groups, *ties)).alias("_first")
    )
    sid = F.row_number().over(Window.orderBy("_first")) - 1
    return firsts.select("speaker", sid.cast("bigint").alias("sid"))
