"""One runnable query per operator, over the whole of the given tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import standins as st
import voxloom as vx
from voxloom.functions import columns as c
from voxloom.operators.clips import source_view
from voxloom.operators.joins import settle
from voxloom.operators.numbering import number_clips
from voxloom.plans.estimate import even_budget_table
from voxloom.session import scratch_path
from voxloom.sources.clips import duration_column, in_split, text_column

FOUND: dict = {}

PLAN = {"per_language": 200, "max_seconds": 1800.0, "min_clip_seconds": 3.0, "max_clip_seconds": 15.0}
BUILD = {"per_language": 20, "max_seconds": 120.0, "min_clip_seconds": 1.0, "max_clip_seconds": 30.0}


def query(name: str):
    def register(run):
        FOUND[name] = run
        return run
    return register


def path_of_audio(clips: DataFrame) -> DataFrame:
    """Audio shown by its path: results are compared as plain values."""
    return clips.withColumn("audio", F.col("audio.path"))


def doc_view(spark, sf, split="all", usable=True) -> DataFrame:
    clips = in_split(st.doc_clips(spark, sf), split)
    return source_view(vx.drop_digit_text(clips) if usable else clips)


def doc_selection(spark, sf) -> DataFrame:
    return vx.select_top(vx.filter_catalog(st.doc_catalog(spark, sf), min_clips=2), 12, max_per_country=4)


def doc_built(spark, sf, **options) -> DataFrame:
    return vx.build_dataset(st.doc_clips(spark, sf), doc_selection(spark, sf), **{**BUILD, **options})


def every_language(catalog: DataFrame) -> DataFrame:
    """The whole catalog as a selection, strongest languages first."""
    return vx.select_top(catalog, 1_000_000, proportional=False)


def doc_whole(spark, sf, **options) -> DataFrame:
    """All languages and splits, without caps."""
    return vx.build_dataset(st.doc_clips(spark, sf), every_language(st.doc_catalog(spark, sf)), split="all", **options)


# --- catalog ---------------------------------------------------------------

@query("catalog_refresh")
def _(spark, sf):
    return st.item_catalog(spark, sf)


@query("catalog_refresh_labels")
def _(spark, sf):
    # Suppliers and nations are listed. Nations have no clips, and labels are known for the
    # suppliers of the first nations only.
    labels = st.item_labels(spark, sf)
    nations = st.table(spark, sf, "nation").select(F.col("n_name").alias("subset"))
    known = labels.where(F.length("country") == 2)
    return vx.refresh_catalog(st.item_clips(spark, sf), known, listed=labels.select("subset").unionAll(nations))


# Clips one task writes, and so those of a file.
CLIPS_PER_FILE = 1_000_000


def dealt_over_files(clips: DataFrame, fewest: int, total: int) -> DataFrame:
    """Some of ``total`` clips, dealt over as many files as those ask for. A file holds a stretch of subsets, so it adds few rows to a ledger."""
    return clips.repartitionByRange(max(fewest, math.ceil(total / CLIPS_PER_FILE)), "subset", "id")


@query("catalog_refresh_files")
def _(spark, sf):
    # Half of the files come first. Then one of them is changed, and the others come.
    path, ledger = scratch_path(spark, "clips"), scratch_path(spark, "ledger")
    clips = st.item_clips(spark, sf)
    total = clips.count()
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    dealt_over_files(clips.where(half).withColumn("duration", F.lit(7.0)), 3, total).write.parquet(f"{path}/part=0")
    vx.refresh_files(spark, path, ledger, use_samples=False)
    dealt_over_files(clips.where(half), 2, total).write.mode("overwrite").parquet(f"{path}/part=0")
    dealt_over_files(clips.where(~half), 3, total).write.parquet(f"{path}/part=1")
    return vx.refresh_files(spark, path, ledger, st.item_labels(spark, sf), use_samples=False)


@query("catalog_refresh_samples")
def _(spark, sf):
    # Lengths come from the numbers of samples stored beside the audio.
    path = scratch_path(spark, "waves")
    vx.write_dataset(st.waveforms(spark, sf), path)
    return vx.refresh_catalog(vx.read_dataset(spark, path))


@query("catalog_scan")
def _(spark, sf):
    path = scratch_path(spark, "padded")
    padded = [F.concat(F.lit(" "), F.col(n), F.lit("  ")).alias(n) for n in ("subset", "language", "iso", "country")]
    rows = st.item_catalog(spark, sf).select(*padded, "clips", "hours", "train", "val", "test")
    rows.write.options(sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return vx.load_catalog(spark, path)


ODD_PREFIX = 'Nd\'i "North", '


@query("catalog_roundtrip")
def _(spark, sf):
    return st.stored_item_catalog(spark, sf, prefix=ODD_PREFIX)


@query("split_size")
def _(spark, sf):
    sizes = [c.split_size(s).alias(f"in_{s}") for s in ("train", "val", "test", "all")]
    return st.item_catalog(spark, sf).select("subset", *sizes)


@query("country_name")
def _(spark, sf):
    return vx.entry_records(st.item_catalog(spark, sf))


@query("avg_clip_seconds")
def _(spark, sf):
    return st.item_catalog(spark, sf).select("subset", c.avg_clip_seconds().alias("avg_seconds"))


@query("filter_hours")
def _(spark, sf):
    return vx.filter_catalog(st.item_catalog(spark, sf), min_hours=4.0, max_hours=4.3)


@query("filter_min_clips")
def _(spark, sf):
    return vx.filter_catalog(st.item_catalog(spark, sf), min_clips=600)


@query("filter_countries")
def _(spark, sf):
    return vx.filter_catalog(st.item_catalog(spark, sf), countries=["gh", "NG", "nation_7"])


@query("filter_require_split")
def _(spark, sf):
    return vx.filter_catalog(st.doc_catalog(spark, sf), split="test")


@query("filter_catalog")
def _(spark, sf):
    return vx.filter_catalog(
        st.doc_catalog(spark, sf), min_hours=0.01, max_hours=50.0, min_clips=5, countries=["en", "fr"], split="val"
    )


@query("countries")
def _(spark, sf):
    return vx.countries(st.item_catalog(spark, sf))


@query("catalog_totals")
def _(spark, sf):
    return vx.catalog_totals(st.item_catalog(spark, sf))


# --- selection -------------------------------------------------------------

@query("top_n")
def _(spark, sf):
    return vx.select_top(st.item_catalog(spark, sf), 20, proportional=False)


@query("top_n_capped")
def _(spark, sf):
    return vx.select_top(st.item_catalog(spark, sf), 30, proportional=False, max_per_country=2)


@query("top_n_balanced")
def _(spark, sf):
    return vx.select_top(st.item_catalog(spark, sf), 60, max_per_country=3)


@query("top_n_balanced_filled")
def _(spark, sf):
    return vx.select_top(st.item_catalog(spark, sf), 60, max_per_country=3, fill=True)


@query("list_languages")
def _(spark, sf):
    return vx.list_languages(st.item_catalog(spark, sf), min_hours=1.0, top=40, max_per_country=2)


PICKED = "sup_7, sup_3,,sup_7 ,sup_9"


@query("pick_languages")
def _(spark, sf):
    return vx.pick_languages(st.item_catalog(spark, sf), PICKED)


@query("pick_lenient")
def _(spark, sf):
    return vx.pick_languages(st.item_catalog(spark, sf), PICKED + ",sup_0,nobody", strict=False)


@query("unknown_names")
def _(spark, sf):
    return vx.unknown_names(st.item_catalog(spark, sf), PICKED + ",sup_0,nobody,nobody,Sup_7")


# --- planning --------------------------------------------------------------

def item_plan(spark, sf, **options) -> DataFrame:
    return vx.plan_samples(every_language(st.item_catalog(spark, sf)), **{**PLAN, **options})


@query("plan_samples")
def _(spark, sf):
    return vx.plan_samples(st.item_catalog(spark, sf), **PLAN)


@query("plan_view")
def _(spark, sf):
    return vx.plan_view(item_plan(spark, sf))


@query("plan_totals")
def _(spark, sf):
    return vx.plan_totals(item_plan(spark, sf))


@query("shortfall")
def _(spark, sf):
    return vx.shortfall(item_plan(spark, sf, per_language=None, max_seconds=5400.0), 5400.0)


@query("shortfall_summary")
def _(spark, sf):
    return vx.shortfall_summary(item_plan(spark, sf, per_language=None, max_seconds=5400.0), 150.0, 5400.0)


@query("even_budget")
def _(spark, sf):
    return even_budget_table(vx.pick_languages(st.item_catalog(spark, sf), PICKED), 24.0)


# --- clips -----------------------------------------------------------------

@query("clip_scan")
def _(spark, sf):
    path = scratch_path(spark, "clips")
    vx.write_dataset(source_view(st.doc_clips(spark, sf)), path)
    clips = vx.read_clips(spark, path, subsets=["src1_en", "src2_fr", "src3_de"], split="train")
    return clips.select("clip_id", "subset", "split", "length")


@query("resolve_columns")
def _(spark, sf):
    docs = st.doc_clips(spark, sf).withColumnRenamed("duration", "Duration_Seconds")
    text, length = text_column(docs.columns), duration_column(docs.columns)
    return docs.select(
        F.col("id").alias("clip_id"), F.lit(text).alias("text_column"), F.lit(length).alias("duration_column"),
        F.length(text).cast("bigint").alias("text_length"), F.col(length).alias("length"),
    )


@query("split_normalise")
def _(spark, sf):
    items = st.item_clips(spark, sf)
    return items.groupBy(c.split_name(F.col("split")).alias("split")).agg(F.count("*").alias("clips"))


@query("concat_splits")
def _(spark, sf):
    return vx.concat_splits(st.doc_clips(spark, sf)).select("id", "subset", c.split_name(F.col("split")).alias("split"))


def items_with_gaps(spark, sf) -> DataFrame:
    """Items whose length is unknown wherever the quantity is 7."""
    return st.item_clips(spark, sf).withColumn("duration", F.nullif("duration", F.lit(7.0)))


@query("clip_window")
def _(spark, sf):
    return vx.clip_window(items_with_gaps(spark, sf), 3.0, 15.0).select("id", "subset", "duration")


@query("clip_window_stream")
def _(spark, sf):
    return vx.clip_window_stream(items_with_gaps(spark, sf), None, 15.0).select("id", "subset", "duration")


@query("digit_filter")
def _(spark, sf):
    return vx.drop_digit_text(st.doc_clips(spark, sf)).select("id", "transcript")


@query("standardise")
def _(spark, sf):
    catalog, rows = settle(st.doc_catalog(spark, sf))
    return path_of_audio(vx.standardise(st.doc_clips(spark, sf), catalog, rows))


@query("waveform_length")
def _(spark, sf):
    return source_view(st.waveforms(spark, sf)).select("clip_id", "subset", "length")


@query("waveform_downmix")
def _(spark, sf):
    two = F.struct(F.array("audio.array", F.reverse("audio.array")).alias("array"), F.col("audio.sampling_rate").alias("sampling_rate"))
    view = source_view(st.waveforms(spark, sf).withColumn("audio", two))
    mono = view.select(F.col("clip_id").cast("bigint").alias("vec_id"), F.col("audio.array").alias("mono"))
    return mono.select("vec_id", F.posexplode("mono").alias("place", "sample")).select(
        "vec_id", F.col("place").cast("bigint").alias("place"), "sample"
    )


@query("oneline_text")
def _(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", c.one_line(F.col("text")).alias("line"))


@query("speaker_label")
def _(spark, sf):
    # Sources without a number in their name stand for a missing language.
    language = F.regexp_replace("source", "^src1.*$", "")
    subset = F.when(F.col("lang") != "de", F.col("lang"))
    return st.table(spark, sf, "documents").select("doc_id", c.speaker_label(language, subset).alias("speaker"))


@query("schema_asr")
def _(spark, sf):
    return path_of_audio(doc_whole(spark, sf, schema="asr"))


@query("schema_whisper")
def _(spark, sf):
    return path_of_audio(doc_whole(spark, sf, schema="whisper"))


@query("schema_common_voice")
def _(spark, sf):
    return path_of_audio(doc_whole(spark, sf, schema="common_voice"))


# --- draws -----------------------------------------------------------------

@query("sample_order")
def _(spark, sf):
    return vx.sample_ranks(doc_view(spark, sf).drop("audio")).select("clip_id", "subset", "split", "rn", "cum")


@query("clip_cap")
def _(spark, sf):
    return vx.draw(doc_view(spark, sf), per_language=5).select("clip_id", "subset", "split", "length")


@query("duration_budget")
def _(spark, sf):
    clips = source_view(st.item_clips(spark, sf))
    return vx.draw(clips, max_seconds=600.0).select("clip_id", "subset", "length")


@query("duration_budget_stream")
def _(spark, sf):
    clips = source_view(st.item_clips(spark, sf))
    return vx.draw(clips, max_seconds=600.0, nearest=False).select("clip_id", "subset", "length")


@query("cap_and_budget")
def _(spark, sf):
    clips = source_view(vx.drop_digit_text(vx.clip_window(st.doc_clips(spark, sf), 1.0, 15.0)))
    return vx.draw(clips, per_language=8, max_seconds=30.0).select("clip_id", "subset", "split", "length")


@query("ordered_split_draw")
def _(spark, sf):
    clips = source_view(st.item_clips(spark, sf))
    drawn = vx.draw(clips, per_language=260, max_seconds=6000.0, nearest=False, ordered_splits=True)
    return drawn.select("clip_id", "subset", "split", "length")


@query("holdout_split")
def _(spark, sf):
    return vx.holdout_split(doc_view(spark, sf, usable=False), 0.1).select("clip_id", "subset", "split", "fold")


# --- builds ----------------------------------------------------------------

@query("build_subset")
def _(spark, sf):
    built = vx.build_dataset(
        st.item_clips(spark, sf), st.item_catalog(spark, sf), split="all",
        per_language=40, max_seconds=600.0, min_clip_seconds=3.0, max_clip_seconds=45.0, internals=True,
    )
    return path_of_audio(built)


@query("build_dataset")
def _(spark, sf):
    return path_of_audio(doc_built(spark, sf, internals=True))


@query("build_summary")
def _(spark, sf):
    return vx.build_summary_by_language(doc_whole(spark, sf))


@query("clip_uid")
def _(spark, sf):
    selection = every_language(st.item_catalog(spark, sf))
    built = vx.build_dataset(st.item_clips(spark, sf), selection, split="all", internals=True)
    uid = F.format_string("%s_%06d", "subset", "idx").alias("uid")
    return number_clips(built.drop("audio")).select("clip_id", "position", "idx", uid)


@query("speaker_ids")
def _(spark, sf):
    return vx.speaker_ids(doc_export(spark, sf))


# --- sinks -----------------------------------------------------------------

def doc_export(spark, sf) -> DataFrame:
    """All documents in the standard layout, as an uncapped export has them."""
    catalog, rows = settle(every_language(st.doc_catalog(spark, sf)))
    return vx.standardise(in_split(st.doc_clips(spark, sf), "all"), catalog, rows)


def manifest_query(layout: str, file: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        folder = vx.export_manifest(doc_export(spark, sf), layout, scratch_path(spark, "manifest"))
        return spark.read.text(f"{folder}/{file}").select(F.col("value").alias("line"))
    return run


for _layout, _file in vx.MANIFEST_FILES.items():
    FOUND[f"manifest_{_layout}"] = manifest_query(_layout, _file)
FOUND["speakers_vits"] = manifest_query("vits", "speakers.txt")


@query("manifests_together")
def _(spark, sf):
    # All layouts of one numbering.
    folders = vx.export_manifests(doc_export(spark, sf), list(vx.MANIFEST_FILES), scratch_path(spark, "manifests"))
    read = [
        spark.read.text(f"{folder}/{vx.MANIFEST_FILES[layout]}").select(F.lit(layout).alias("layout"), F.col("value").alias("line"))
        for layout, folder in folders.items()
    ]
    return reduce(DataFrame.unionAll, read)


@query("manifest_csv")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    clips = doc_export(spark, sf)
    vx.write_manifest_csv(clips, path)
    return vx.read_manifest_csv(spark, path, clips.drop("audio").schema)


@query("parquet_roundtrip")
def _(spark, sf):
    path = scratch_path(spark, "parquet")
    vx.write_parquet(doc_export(spark, sf), path)
    return path_of_audio(spark.read.parquet(path))


@query("dataset_roundtrip")
def _(spark, sf):
    path = scratch_path(spark, "dataset")
    vx.write_dataset(doc_export(spark, sf), path)
    return path_of_audio(vx.read_dataset(spark, path))


@query("selection_job")
def _(spark, sf):
    config = vx.SelectionConfig(
        top=12, max_per_country=4, min_clips=2, total_hours=0.4, per_language=20,
        min_clip_seconds=1.0, max_clip_seconds=30.0, formats="disk,piper",
    )
    result = vx.run_selection(st.doc_clips(spark, sf), st.doc_catalog(spark, sf), config, scratch_path(spark, "job"))
    return path_of_audio(result.built)


# --- streams ---------------------------------------------------------------

def arriving(spark, sf) -> tuple:
    """Documents written out as clip files, to be read as a stream."""
    path = scratch_path(spark, "arriving")
    clips = st.doc_clips(spark, sf)
    clips.repartition(16, "id").write.parquet(path)
    return path, clips.schema, doc_selection(spark, sf)


STREAM = {"min_clip_seconds": 1.0, "max_clip_seconds": 30.0}


@query("stream_filter")
def _(spark, sf):
    # Several micro-batches: a filter does not depend on how files arrive.
    path, schema, selection = arriving(spark, sf)
    out = scratch_path(spark, "filtered")
    filtered = vx.stream_filter(vx.stream_clips(spark, path, schema, files_per_batch=3), selection, **STREAM)
    filtered.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "progress")
    ).trigger(availableNow=True).start().awaitTermination()
    return path_of_audio(spark.read.schema(filtered.schema).parquet(out))


@query("stream_admit")
def _(spark, sf):
    path, schema, selection = arriving(spark, sf)
    out = scratch_path(spark, "admitted")
    vx.stream_admit(
        spark, path, schema, selection, out, split="all", per_language=20, max_seconds=120.0, **STREAM
    ).awaitTermination()
    return path_of_audio(spark.read.parquet(f"{out}/clips").drop("epoch"))


@query("stream_dataset")
def _(spark, sf):
    # The draw is that over all files, however they are dealt over micro-batches.
    path, schema, selection = arriving(spark, sf)
    pulled = vx.stream_dataset(
        spark, path, schema, selection, schema="common_voice", split="all", max_seconds=120.0, files_per_batch=3, **STREAM
    )
    out = scratch_path(spark, "pulled")
    pulled.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "progress")
    ).trigger(availableNow=True).start().awaitTermination()
    return path_of_audio(spark.read.schema(pulled.schema).parquet(out))
