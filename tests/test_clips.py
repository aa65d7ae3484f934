import pytest
from pyspark.sql import functions as F

import voxloom as vx
from voxloom.functions import columns as c
from voxloom.operators import joins
from voxloom.operators.clips import source_view
from voxloom.schemas import STANDARD_COLUMNS
from voxloom.sources.clips import duration_column, read_clips, text_column

SOURCE = (
    "id string, audio struct<array: array<float>, sampling_rate: int>, text string, duration double, source string, "
    "jw_code string, iso639_3 string, subset string, split string"
)


def waves(seconds, rate=16000):
    return ([0.0] * int(rate * seconds), rate)


@pytest.fixture(scope="module")
def source(spark):
    rows = [
        ("w_1", waves(1.0), "mbë órò", 1.0, "w", "aba", "aba", "aba_one", "train"),
        ("w_2", waves(2.0), "ebá ewu", 2.0, "w", "aba", "aba", "aba_one", "train"),
        ("w_3", waves(0.5), "jɔ vivi", 0.5, "w", "aba", "aba", "aba_one", "train"),
    ]
    return spark.createDataFrame(rows, SOURCE)


def lengths(df):
    return sorted(row.length for row in df.collect())


def test_build_has_the_standard_layout_and_catalog_labels(source, catalog):
    built = vx.build_subset(source, catalog, "aba_one")
    assert built.columns == STANDARD_COLUMNS
    row = built.where("length = 1.0").first()
    assert (row.language, row.country, row.iso, row.subset, row.text) == ("Abba", "CI", "aba", "aba_one", "mbë órò")
    assert len(row.audio.array) == 16000


def test_length_is_measured_without_a_duration_column(source, catalog):
    assert lengths(vx.build_subset(source.drop("duration"), catalog, "aba_one")) == [0.5, 1.0, 2.0]
    assert lengths(vx.build_subset(source.drop("duration"), catalog, "aba_one", as_stream=True)) == [0.0, 0.0, 0.0]


def test_clip_cap(source, catalog):
    assert vx.build_subset(source, catalog, "aba_one", per_language=2).count() == 2


@pytest.mark.parametrize(
    ("low", "high", "kept"), [(0.8, 1.5, [1.0]), (1.0, None, [1.0, 2.0]), (None, 1.0, [0.5, 1.0])]
)
def test_length_window(source, catalog, low, high, kept):
    window = {"min_clip_seconds": low, "max_clip_seconds": high}
    for as_stream in (False, True):
        assert lengths(vx.build_subset(source, catalog, "aba_one", as_stream=as_stream, **window)) == kept


def test_audio_is_required(source, catalog):
    with pytest.raises(ValueError, match="audio"):
        vx.build_subset(source.drop("audio"), catalog, "aba_one")


def test_unknown_or_empty_selection(source, catalog):
    with pytest.raises(KeyError):
        vx.build_subset(source, catalog, "nobody")
    with pytest.raises(ValueError):
        vx.build_dataset(source, catalog.where("false"))


def test_repeated_language_comes_twice(source, catalog):
    picked = vx.pick_languages(catalog, "aba_one,twi_twi,aba_one")
    built = vx.build_dataset(source, picked, per_language=2, internals=True)
    assert sorted((r.position for r in built.collect())) == [1, 1, 3, 3]


def test_unknown_lengths_batch_and_stream(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 0.0), ("d", 3.0), ("e", 15.0), ("f", 15.5)],
                               "id string, duration double")
    ids = lambda d: "".join(sorted(r.id for r in d.collect()))
    assert ids(vx.clip_window(df, 3.0, 15.0)) == "de"
    assert ids(vx.clip_window(df, 3.0)) == "def"
    assert ids(vx.clip_window(df, None, 3.0)) == "cd"
    assert ids(vx.clip_window(df)) == "abcdef"
    assert ids(vx.clip_window_stream(df, 3.0, 15.0)) == "bde"
    assert ids(vx.clip_window_stream(df, None, 3.0)) == "abcd"
    assert ids(vx.clip_window_stream(df, 0.0, None)) == "abcdef"
    bare = df.drop("duration")
    assert vx.clip_window(bare, 3.0).count() == 6
    assert vx.clip_window_stream(bare, 3.0).count() == 0


def test_digits_of_any_script(spark):
    texts = ["abc 1", "٣ x", "፩ x", "x²", "none", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "sentence string")
    assert [r.sentence for r in vx.drop_digit_text(df).collect()] == texts[2:]
    assert vx.drop_digit_text(df.withColumnRenamed("sentence", "other")).count() == 7


def test_column_names_by_preference_and_spelling():
    assert text_column(["Sentence", "translation", "id"]) == "Sentence"
    assert text_column(["translation", "TEXT"]) == "TEXT"
    assert text_column(["words"]) is None
    assert duration_column(["audio_length", "Duration"]) == "Duration"
    assert duration_column([]) is None


def test_no_transcript_column_gives_empty_text(source, catalog):
    assert {r.text for r in vx.build_subset(source.drop("text"), catalog, "aba_one").collect()} == {""}


def test_split_names(spark, source, catalog):
    splits = ["train", "val", "validation", "dev", "test", "extra"]
    df = source.limit(1).select(*[x for x in source.columns if x not in ("id", "split")]).join(
        spark.createDataFrame([(s, s) for s in splits], "id string, split string")
    )
    ids = lambda split: sorted(r.clip_id for r in vx.build_subset(df, catalog, "aba_one", split=split, internals=True).collect())
    assert ids("train") == ["train"]
    assert ids("val") == ["dev", "val", "validation"]
    assert ids("all") == ["dev", "test", "train", "val", "validation"]
    with pytest.raises(KeyError):
        ids("validation")


@pytest.mark.parametrize(
    ("schema", "columns"),
    [("asr", ["audio", "text"]), ("whisper", ["audio", "sentence"]), (None, STANDARD_COLUMNS), ("default", STANDARD_COLUMNS),
     ("common_voice", ["audio", "sentence", "language", "country", "length"])],
)
def test_training_schemas(source, catalog, schema, columns):
    built = vx.build_subset(source, catalog, "aba_one", schema=schema)
    assert built.columns == columns
    short = vx.apply_schema(vx.build_subset(source, catalog, "aba_one").drop("audio"), schema)
    assert short.columns == [x for x in columns if x != "audio"]


def test_unknown_schema(source):
    with pytest.raises(ValueError, match="unknown schema"):
        vx.apply_schema(source, "nope")


def test_waveform_length(spark):
    rows = [([0.0] * 8, 16), ([0.0] * 3, 7), ([], 16), ([0.0], 0), ([0.0], None), (None, 16)]
    df = spark.createDataFrame(rows, "a array<float>, r int")
    found = [r.s for r in df.select(c.waveform_length(F.col("a"), F.col("r")).alias("s")).collect()]
    assert found == [0.5, 0.429, 0.0, 0.0, 0.0, 0.0]


def test_downmix(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0], [3.0, 0.0, -3.0]],), ([[4.0, 5.0]],)], "ch array<array<float>>")
    assert [r.m for r in df.select(c.downmix(F.col("ch")).alias("m")).collect()] == [[2.0, 1.0, 0.0], [4.0, 5.0]]


def test_stored_clips_keep_number_like_names(spark, source, tmp_path):
    path = str(tmp_path / "clips")
    named = source.withColumn("subset", F.lit("007"))
    named.write.partitionBy("subset", "split").parquet(path)
    assert read_clips(spark, path, subsets=["007"], split="train").count() == 3
    assert read_clips(spark, path, subsets=["7"]).count() == 0
    assert read_clips(spark, path, split="val").count() == 0


def test_large_selections_are_joined_the_other_way(spark, source, catalog, monkeypatch):
    many = source.unionByName(source.withColumns({"id": F.concat("id", F.lit("x")), "subset": F.lit("twi_twi")}))
    def result():
        built = vx.build_dataset(many, catalog, per_language=2, max_seconds=2.4, internals=True)
        return sorted((r.subset, r.clip_id, r.length) for r in built.collect()), built
    small, _ = result()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    monkeypatch.setattr("voxloom.plans.dataset.LITERAL_NAMES", 0)
    large, built = result()
    assert large == small and len(small) > 2
    assert "explode" in built._jdf.queryExecution().analyzed().toString()


def test_source_view_takes_its_own_result(source):
    once = source_view(source)
    assert source_view(once).collect() == once.collect()


def test_summaries(source, catalog):
    built = vx.build_subset(source, catalog, "aba_one")
    assert tuple(vx.build_summary(built).first()) == (3, 1)
    assert tuple(vx.build_summary_by_language(built).first()) == ("aba_one", "Abba", 3, 3.5)
