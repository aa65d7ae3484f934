"""Manifests for text-to-speech trainers, one folder per layout."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.columns import language_code, one_line, speaker_label
from voxloom.operators.joins import BROADCAST_ROWS, attach, settle
from voxloom.operators.numbering import number_clips, speaker_ids
from voxloom.schemas import MANIFEST_FILES, SPEAKER_FILE
from voxloom.session import scratch_path

# One task sorts and writes a file, so its size is bounded in bytes: transcripts may be of any length.
BYTES_PER_FILE = 128 << 20
# Beside its text, a line costs a sort about this much.
LINE_BYTES = 32
# The bytes of lines are added up in at most this many blocks of equally many lines. It also bounds the number of files:
# part names have five digits, and their order is that of the lines.
BLOCKS = 10_000


def check_layout(layout: str) -> str:
    if layout not in MANIFEST_FILES:
        raise ValueError(f"unknown manifest layout {layout!r}; choose from {', '.join(MANIFEST_FILES)}")
    return layout


def manifest_rows(clips: DataFrame, *, seed: int = 42, ordered_splits: bool = False) -> DataFrame:
    """The fields manifests are made of: idx, uid, text, speaker, iso. Audio is not read."""
    has = lambda name: F.col(name) if name in clips.columns else F.lit(None).cast("string")
    fields = clips.select(
        *[c for c in ("position", "split") if c in clips.columns],
        "clip_id",
        (F.col("subset") if "subset" in clips.columns else F.lit("clip")).alias("_prefix"),
        one_line(has("text")).alias("text"),
        speaker_label(has("language"), has("subset")).alias("speaker"),
        language_code(has("iso")).alias("iso"),
    )
    numbered = number_clips(fields, seed=seed, ordered_splits=ordered_splits)
    # %06d pads short indexes and keeps long ones whole.
    return numbered.select(
        "idx", F.format_string("%s_%06d", "_prefix", "idx").alias("uid"), "text", "speaker", "iso"
    )


def _lines(rows: DataFrame, layout: str, speakers: DataFrame | None) -> DataFrame:
    """(idx, value) of one layout from ``manifest_rows``; ``speakers`` where the layout needs them."""
    wav = F.concat(F.lit("wavs/"), F.col("uid"), F.lit(".wav"))
    if layout == "vits":
        speakers, speaker_rows = settle(speakers)
        rows = attach(rows, speakers, "speaker", speaker_rows, "uid")
        parts = [wav, F.col("sid").cast("string"), "text"]
    else:
        parts = {
            "ljspeech": ["uid", "text", "text"],
            "piper": ["uid", "speaker", "text"],
            "melo": [wav, "speaker", "iso", "text"],
        }[layout]
    return rows.select("idx", F.concat_ws("|", *parts).alias("value"))


def manifest_lines(
    clips: DataFrame, layout: str, *, seed: int = 42, ordered_splits: bool = False, speakers: DataFrame | None = None
) -> DataFrame:
    """(idx, value): the lines of one manifest. Transcripts are verbatim; '|' is not escaped.

    ``speakers`` are the ``speaker_ids`` of the same clips, for the layout that needs them,
    if they are at hand.
    """
    check_layout(layout)
    if layout == "vits" and speakers is None:
        speakers = speaker_ids(clips, seed=seed, ordered_splits=ordered_splits)
    return _lines(manifest_rows(clips, seed=seed, ordered_splits=ordered_splits), layout, speakers)


def speakers_of(rows: DataFrame) -> DataFrame:
    """``speaker_ids`` read from numbered rows: a speaker's first index is known there."""
    firsts = rows.groupBy("speaker").agg(F.min("idx").alias("_first"))
    sid = F.row_number().over(Window.orderBy("_first")) - 1  # one row for each speaker
    return firsts.select("speaker", sid.cast("bigint").alias("sid"))


def speaker_lines(speakers: DataFrame) -> DataFrame:
    """(sid, value): speaker id, tab, speaker."""
    return speakers.select("sid", F.concat_ws("\t", F.col("sid").cast("string"), "speaker").alias("value"))


def _row_bytes() -> Column:
    """Bytes of a row of ``manifest_rows`` as a line of the longest layout, which has the transcript twice."""
    names = ["uid", "speaker", "iso", "text", "text"]
    return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(name), F.lit(0)).cast("bigint") for name in names])


def _files(sizes: DataFrame, by: str, count: int) -> tuple[DataFrame, int, int]:
    """The file of each block of lines, (_block, _file), with the number of lines in a block and of files.

    ``sizes`` has ``by``, which numbers ``count`` lines from 0, and the ``_bytes`` of each. A file has the blocks that start within
    its BYTES_PER_FILE, so it is longer by less than one block. Only blocks, one row each, are put in order and come to the driver.
    """
    per_block = max(1, math.ceil(count / BLOCKS))
    blocks = sizes.groupBy(F.floor(F.col(by) / per_block).alias("_block")).agg(F.sum(F.col("_bytes") + LINE_BYTES).alias("_bytes"))
    before = F.sum("_bytes").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    file = F.floor(F.coalesce(before, F.lit(0)) / BYTES_PER_FILE).cast("int")
    found = blocks.select("_block", file.alias("_file"))
    known = found.toArrow()
    files = max(known["_file"].to_pylist(), default=0) + 1
    return sizes.sparkSession.createDataFrame(known, schema=found.schema), per_block, files


def _write_in_order(lines: DataFrame, by: str, cut: tuple[DataFrame, int, int], path: str) -> None:
    # ``by`` numbers the lines from 0, so the file of a line is known without sampling.
    blocks, per_block, files = cut
    placed = lines.withColumn("_block", F.floor(F.col(by) / per_block)).join(F.broadcast(blocks), "_block")
    placed.repartitionById(files, "_file").sortWithinPartitions(by).select("value").write.text(path)


def export_manifests(
    clips: DataFrame, layouts: list[str], path: str, *, seed: int = 42, ordered_splits: bool = False
) -> dict[str, str]:
    """Write the manifests of several layouts below ``path``/layout and return their folders by layout.

    Clips are scanned, shuffled and numbered once. The numbered rows, which have no audio, are kept in the scratch folder;
    line count, speaker ids and the lines of every layout are read from them. All layouts are cut into files at the same lines.

    Each manifest is a folder of text parts; read in name order they are the file.
    Every layout has a folder of its own, since two of them name their manifest alike.
    """
    folders = {layout: f"{path.rstrip('/')}/{check_layout(layout)}" for layout in layouts}
    kept = scratch_path(clips.sparkSession, "numbered")
    numbered = manifest_rows(clips, seed=seed, ordered_splits=ordered_splits)
    numbered.write.parquet(kept)
    rows = clips.sparkSession.read.schema(numbered.schema).parquet(kept)
    cut = _files(rows.select("idx", _row_bytes().alias("_bytes")), "idx", rows.count())
    for layout, folder in folders.items():
        speakers, speaker_count = settle(speakers_of(rows)) if layout == "vits" else (None, 0)
        _write_in_order(_lines(rows, layout, speakers), "idx", cut, f"{folder}/{MANIFEST_FILES[layout]}")
        if speakers is not None:
            speaker_count = speaker_count if speaker_count <= BROADCAST_ROWS else speakers.count()
            named = speaker_lines(speakers)
            cut_speakers = _files(named.select("sid", F.octet_length("value").alias("_bytes")), "sid", speaker_count)
            _write_in_order(named, "sid", cut_speakers, f"{folder}/{SPEAKER_FILE}")
    return folders


def export_manifest(
    clips: DataFrame, layout: str, path: str, *, seed: int = 42, ordered_splits: bool = False
) -> str:
    """``export_manifests`` of one layout; returns its folder."""
    return export_manifests(clips, [layout], path, seed=seed, ordered_splits=ordered_splits)[layout]
