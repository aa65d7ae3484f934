import glob

import pytest

import voxloom as vx
from voxloom.sinks import manifests
from voxloom.functions import columns as c
from pyspark.sql import functions as F

BUILT = (
    "position bigint, clip_id string, split string, audio struct<bytes: binary, path: string>, text string, "
    "language string, country string, length double, iso string, subset string"
)


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        (p, f"{s}{i}", "train", (b"x", "p"), f"sentence {i}", name, "GH", 1.0, s, f"{s}_{s}")
        for p, s, name in [(1, "twi", "Twi"), (2, "gaa", "Ga")] for i in range(3)
    ]
    return spark.createDataFrame(rows, BUILT)


def lines(folder):
    parts = sorted(glob.glob(f"{folder}/part-*"))
    return [line for part in parts for line in open(part, encoding="utf-8").read().splitlines()]


def test_layouts(built, tmp_path):
    folder = {name: vx.export_manifest(built, name, str(tmp_path)) for name in vx.MANIFEST_FILES}
    ljspeech = lines(folder["ljspeech"] + "/metadata.csv")
    assert len(ljspeech) == 6
    for number, line in enumerate(ljspeech):
        uid, first, second = line.split("|")
        assert uid == f"{'twi_twi' if number < 3 else 'gaa_gaa'}_{number:06d}" and first == second
    assert [line.split("|")[1] for line in lines(folder["piper"] + "/metadata.csv")] == ["Twi"] * 3 + ["Ga"] * 3
    vits = lines(folder["vits"] + "/filelist.txt")
    assert vits[0].startswith("wavs/twi_twi_000000.wav|0|sentence ") and vits[5].startswith("wavs/gaa_gaa_000005.wav|1|")
    assert lines(folder["vits"] + "/speakers.txt") == ["0\tTwi", "1\tGa"]
    melo = lines(folder["melo"] + "/metadata.list")
    assert melo[0].split("|")[:3] == ["wavs/twi_twi_000000.wav", "Twi", "TWI"]


def test_repeated_language_is_numbered_on(built, tmp_path):
    twice = built.where("position = 1").unionByName(built.where("position = 1").withColumn("position", F.lit(7).cast("bigint")))
    folder = vx.export_manifest(twice, "piper", str(tmp_path))
    assert [line.split("|")[0] for line in lines(folder + "/metadata.csv")] == [f"twi_twi_{i:06d}" for i in range(6)]


def test_missing_columns_have_stand_ins(built, tmp_path):
    bare = built.select("clip_id", "text")
    folder = vx.export_manifest(bare, "melo", str(tmp_path))
    assert lines(folder + "/metadata.list")[0].startswith("wavs/clip_000000.wav|spk||sentence ")


def test_unknown_layout(built, tmp_path):
    with pytest.raises(ValueError):
        vx.export_manifest(built, "nope", str(tmp_path))


def test_text_on_one_line(spark):
    texts = [" a\r\nb\tc ", " x y　", "a|b", None, "", " \x85\x1c "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r.t for r in df.orderBy("i").select(c.one_line(F.col("t")).alias("t")).collect()]
    assert found == ["a  b c", "x y", "a|b", "", "", ""]


def test_speaker_labels(spark):
    df = spark.createDataFrame([("L", "s"), ("", "s"), (None, "s"), (None, ""), ("", None)], "l string, s string")
    assert [r.x for r in df.select(c.speaker_label(F.col("l"), F.col("s")).alias("x")).collect()] == ["L", "s", "s", "spk", "spk"]


def test_long_indexes_are_not_cut(spark):
    df = spark.createDataFrame([("s", 12345678)], "p string, i bigint")
    assert df.select(F.format_string("%s_%06d", "p", "i")).first()[0] == "s_12345678"


def test_manifest_csv_keeps_every_text(spark, tmp_path):
    texts = ['say "hi", you', "back\\slash", "line\r\nbreak", " outer ", "", None, "tab\t|", "\\N is text" , "é"]
    rows = [(1, str(i), "train", (b"", ""), t, "L", "GH", 1.5, "iso", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, BUILT)
    vx.write_manifest_csv(df, str(tmp_path / "csv"))
    back = vx.read_manifest_csv(spark, str(tmp_path / "csv"), df.drop("audio").schema)
    assert "audio" not in back.columns
    assert {r.clip_id: r.text for r in back.collect()} == {str(i): t for i, t in enumerate(texts)}


def test_dataset_keeps_number_like_subsets(spark, built, tmp_path):
    path = str(tmp_path / "dataset")
    vx.write_dataset(built.withColumn("subset", F.lit("0042")), path)
    back = vx.read_dataset(spark, path)
    assert back.count() == 6 and {r.subset for r in back.collect()} == {"0042"}
    assert sorted(back.columns) == sorted(built.columns)


def test_all_layouts_share_one_numbering(built, tmp_path, monkeypatch):
    numbered = []
    plain = manifests.number_clips
    monkeypatch.setattr(manifests, "number_clips", lambda *a, **k: numbered.append(1) or plain(*a, **k))
    folders = vx.export_manifests(built, list(vx.MANIFEST_FILES), str(tmp_path / "all"))
    assert numbered == [1] and list(folders) == list(vx.MANIFEST_FILES)
    for layout, file in vx.MANIFEST_FILES.items():
        by_clips = [r.value for r in vx.manifest_lines(built, layout).orderBy("idx").collect()]
        assert lines(f"{folders[layout]}/{file}") == by_clips


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    # Few lines, some of them long: a file is bounded by what its lines hold, not by their number.
    monkeypatch.setattr(manifests, "BYTES_PER_FILE", 4000)
    rows = [(1, f"c{i:03}", "train", (b"x", "p"), "long " * 200 if i % 3 else "short", f"L{i % 7}", "GH", 1.0, "iso", "s") for i in range(120)]
    clips = spark.createDataFrame(rows, BUILT)
    folders = vx.export_manifests(clips, list(vx.MANIFEST_FILES), str(tmp_path / "bytes"))
    speakers = lines(f"{folders['vits']}/speakers.txt")
    for layout, file in vx.MANIFEST_FILES.items():
        sizes = [len(open(part, encoding="utf-8").read()) for part in glob.glob(f"{folders[layout]}/{file}/part-*")]
        assert len(sizes) > 20 and max(sizes) < 4000 + 2100  # one line more at most
        assert lines(f"{folders[layout]}/{file}") == [r.value for r in vx.manifest_lines(clips, layout).orderBy("idx").collect()]
    assert [line.split("\t")[0] for line in speakers] == [str(i) for i in range(7)]


def test_blocks_of_lines_are_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifests, "BYTES_PER_FILE", 100)
    monkeypatch.setattr(manifests, "BLOCKS", 4)
    rows = [(1, f"c{i:03}", "train", (b"x", "p"), "t" * i, "L", "GH", 1.0, "iso", "s") for i in range(50)]
    clips = spark.createDataFrame(rows, BUILT)
    folder = vx.export_manifest(clips, "piper", str(tmp_path / "blocks"))
    assert len(glob.glob(f"{folder}/metadata.csv/part-*")) == 4
    assert lines(f"{folder}/metadata.csv") == [r.value for r in vx.manifest_lines(clips, "piper").orderBy("idx").collect()]
    empty = vx.export_manifest(clips.where("false"), "vits", str(tmp_path / "none"))
    assert lines(f"{empty}/filelist.txt") == lines(f"{empty}/speakers.txt") == []
