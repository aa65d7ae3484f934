import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

import voxloom as vx

TABLE = "id string, audio struct<bytes: binary, path: string>, text string, duration double, subset string, split string"


def rows(subsets, start, count):
    return [
        (f"{s}-{i}", (b"a", f"{s}/{i}"), "7 words" if i % 5 == 0 else "words", None if i % 7 == 0 else 1.0 + i % 4, s,
         ("train", "validation", "test")[i % 3])
        for s in subsets for i in range(start, start + count)
    ]


def arrive(spark, path, subsets, start, count):
    spark.createDataFrame(rows(subsets, start, count), TABLE).coalesce(1).write.mode("append").partitionBy("subset").parquet(path)


def schema_of(spark):
    return spark.createDataFrame([], TABLE).schema


def key(df):
    return sorted((r.subset, r.audio.path, r.length) for r in df.collect())


def pull(spark, tmp_path, *args, name="pulled", **options):
    """What a pull delivers, by way of a file sink."""
    stream = vx.stream_dataset(spark, *args, **options)
    assert stream.isStreaming
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_without_caps_stream_and_batch_agree(spark, catalog, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, ["twi_twi", "aba_one", "unlisted"], 0, 30)
    window = {"min_clip_seconds": 0.0, "max_clip_seconds": 3.0}
    args = (spark, tmp_path, path, schema_of(spark), catalog)
    pulled = pull(*args, **window)
    filtered = vx.stream_filter(spark.read.schema(schema_of(spark)).parquet(path), catalog, **window)
    assert key(pulled) == key(filtered) and filtered.count() > 10
    assert "unlisted" not in {r.subset for r in pulled.collect()}
    arrive(spark, path, ["twi_twi"], 100, 10)
    again = vx.stream_filter(spark.read.schema(schema_of(spark)).parquet(path), catalog, **window)
    assert key(pull(*args, name="again", **window)) == key(again)


def test_filter_as_a_stream(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, path, ["twi_twi", "unlisted"], 0, 30)
    query = vx.stream_filter(vx.stream_clips(spark, path, schema_of(spark)), catalog).writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = vx.stream_filter(spark.read.schema(schema_of(spark)).parquet(path), catalog)
    assert key(spark.read.parquet(out)) == key(batch) and batch.count() > 3


@pytest.mark.parametrize("caps", [{"per_language": 7}, {"max_seconds": 20.0}, {"per_language": 9, "max_seconds": 14.0}], ids=str)
@pytest.mark.parametrize("files", [1, 3])
def test_pull_is_the_draw_over_all_files(spark, catalog, tmp_path, caps, files):
    path = str(tmp_path / "in")
    for start in range(0, 60, 60 // files):
        arrive(spark, path, ["twi_twi", "aba_one"], start, 60 // files)
    pulled = pull(spark, tmp_path, path, schema_of(spark), catalog, split="all", files_per_batch=2, **caps)
    usable = vx.stream_filter(spark.read.schema(schema_of(spark)).parquet(path), catalog, split="all")
    assert key(pulled) == key(vx.draw(usable, nearest=False, ordered_splits=True, **caps))


def test_train_comes_first_whenever_it_arrived(spark, catalog, tmp_path):
    path = str(tmp_path / "in")
    for split, start in (("test", 0), ("train", 10)):
        made = [(f"{split}-{i}", (b"a", split), "words", 1.0, "twi_twi", split) for i in range(start, start + 5)]
        spark.createDataFrame(made, TABLE).coalesce(5).write.mode("append").partitionBy("subset").parquet(path)
    pulled = pull(spark, tmp_path, path, schema_of(spark), catalog, split="all", per_language=5, files_per_batch=1)
    assert [r.audio.path for r in pulled.collect()] == ["train"] * 5


def test_one_micro_batch_is_the_batch_draw(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, path, ["twi_twi", "aba_one"], 0, 60)
    got = admitted(spark, path, catalog, out, per_language=9, max_seconds=14.0)
    assert key(got) == key(pull(spark, tmp_path, path, schema_of(spark), catalog, split="all", per_language=9, max_seconds=14.0))


def test_a_pull_goes_on_from_its_checkpoint(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for start in range(0, 60, 10):
        arrive(spark, path, ["twi_twi", "aba_one"], start, 10)
    as_of, caps = datetime.now(timezone.utc), {"split": "all", "per_language": 9, "max_seconds": 18.0}

    def start():
        stream = vx.stream_dataset(spark, path, schema_of(spark), catalog, files_per_batch=1, as_of=as_of, **caps)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress")
        return stream, writer

    first = start()[1].trigger(processingTime="0 seconds").start()
    while first.lastProgress is None:
        time.sleep(0.1)
    first.stop()  # somewhere in the middle
    arrive(spark, path, ["twi_twi"], 100, 50)  # too late for this pull
    stream, writer = start()
    writer.trigger(availableNow=True).start().awaitTermination()
    usable = vx.stream_filter(spark.read.schema(schema_of(spark)).parquet(path).where(F.col("id").rlike("-.{1,2}$")), catalog, split="all")
    expected = vx.draw(usable, nearest=False, ordered_splits=True, per_language=9, max_seconds=18.0)
    assert key(spark.read.schema(stream.schema).parquet(out)) == key(expected)


def test_state_stays_small_over_many_micro_batches(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), tmp_path / "out"
    for start in range(0, 40, 4):
        arrive(spark, path, ["twi_twi"], start, 4)
    got = admitted(spark, path, catalog, str(out), per_language=6, files_per_batch=1)
    assert got.count() == 6
    assert len(list((out / "checkpoint" / "commits").glob("[0-9]*"))) == 10
    assert len(list((out / "state").glob("turn=*"))) == 2
    # Once the language is full no micro-batch leaves a folder.
    assert len(list((out / "clips").glob("epoch=*"))) <= 3


def test_a_repeated_micro_batch_gives_the_same_rows(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), tmp_path / "out"
    for start in range(0, 24, 8):
        arrive(spark, path, ["twi_twi", "aba_one"], start, 8)
    options = {"per_language": 10, "files_per_batch": 1}
    first = sorted((r.epoch, r.clip_id) for r in admitted(spark, path, catalog, str(out), **options).collect())
    commits = sorted((out / "checkpoint" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)  # as if it had failed after its last write
    again = sorted((r.epoch, r.clip_id) for r in admitted(spark, path, catalog, str(out), **options).collect())
    assert again == first


def admitted(spark, path, selection, out, **options):
    vx.stream_admit(spark, path, schema_of(spark), selection, out, split="all", **options).awaitTermination()
    return spark.read.parquet(f"{out}/clips")


def test_caps_hold_across_micro_batches_and_restarts(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    caps = {"per_language": 25, "max_seconds": 60.0, "files_per_batch": 1}
    for start in (0, 8, 16):
        arrive(spark, path, ["twi_twi", "aba_one"], start, 8)
    first = {r.audio.path for r in admitted(spark, path, catalog, out, **caps).collect()}
    # Everything that fits is admitted in the order it came: all usable clips of the first files.
    usable = vx.stream_filter(spark.read.schema(schema_of(spark)).parquet(path), catalog, split="all")
    assert first == {r.audio.path for r in usable.collect()}
    arrive(spark, path, ["twi_twi", "aba_one", "bel_two"], 24, 40)
    again = admitted(spark, path, catalog, out, **caps)
    again_paths = [r.audio.path for r in again.collect()]
    assert first <= set(again_paths) and len(set(again_paths)) == len(again_paths)
    for row in again.groupBy("subset").agg(F.count("*").alias("n"), F.sum("length").alias("s"), F.max("length").alias("m")).collect():
        assert row.n <= 25 and row.s < 60.0 + row.m
        assert row.n == 25 or row.s >= 60.0
    arrive(spark, path, ["twi_twi"], 100, 20)
    assert sorted(r.audio.path for r in admitted(spark, path, catalog, out, **caps).collect()) == sorted(again_paths)


def test_other_settings_are_refused(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, path, ["twi_twi"], 0, 30)
    admitted(spark, path, catalog, out, per_language=5)
    for other in ({"per_language": 12}, {"per_language": 5, "seed": 7}):
        with pytest.raises(ValueError, match="settings"):
            admitted(spark, path, catalog, out, **other)
    with pytest.raises(ValueError, match="settings"):
        admitted(spark, path, vx.pick_languages(catalog, "twi_twi"), out, per_language=5)


def test_repeated_language_counts_once(spark, catalog, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, path, ["twi_twi"], 1, 4)
    arrive(spark, path, ["twi_twi"], 11, 30)
    picked = vx.pick_languages(catalog, "twi_twi,twi_twi")
    got = admitted(spark, path, picked, out, per_language=6, max_seconds=1000.0, files_per_batch=1)
    assert got.count() == 12 and got.select("audio.path").distinct().count() == 6


def test_odd_folder_names(spark, tmp_path):
    path = str(tmp_path / "in put")
    odd = "a b%20c:d=é"
    arrive(spark, path, [odd], 1, 3)
    selection = spark.createDataFrame([(odd, "L", "XX", "x", 3)], "subset string, language string, country string, iso string, clips bigint")
    got = admitted(spark, path, selection, str(tmp_path / "out"), per_language=2)
    assert [r.subset for r in got.collect()] == [odd, odd]


def test_schema_and_negative_caps(spark, catalog, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, ["twi_twi"], 1, 4)
    args = (spark, path, schema_of(spark), catalog)
    assert vx.stream_dataset(*args, per_language=2, schema="asr").columns == ["audio", "text"]
    with pytest.raises(ValueError):
        vx.stream_dataset(*args, per_language=-2)


def test_names_are_looked_up_and_unknown_ones_skipped(spark, catalog, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, ["twi_twi", "aba_one"], 0, 30)
    got = pull(spark, tmp_path, path, schema_of(spark), "nobody, twi_twi", catalog=catalog)
    assert {r.subset for r in got.collect()} == {"twi_twi"}
    assert pull(spark, tmp_path, path, schema_of(spark), ["nobody"], name="none", catalog=catalog, schema="asr", per_language=3).collect() == []
    clips = spark.read.schema(schema_of(spark)).parquet(path)
    assert {r.subset for r in vx.build_dataset(clips, ["aba_one"], catalog=catalog).collect()} == {"aba_one"}
    with pytest.raises(KeyError):
        vx.build_dataset(clips, "aba_one,nobody", catalog=catalog)
    with pytest.raises(ValueError):
        vx.build_dataset(clips, "aba_one")
