import pyarrow.parquet as pq
from pyspark.sql import functions as F

import queries
import standins as st
import voxloom as vx
from voxloom.operators import refresh

CLIPS = "subset string, split string, duration double"


def test_counts_hours_and_split_names(spark):
    rows = [("a", "train", 1800.0), ("a", "dev", 1800.0), ("a", "validation", None), ("a", "val", 0.0), ("a", "extra", 36.0),
            ("b", "test", 54.0)]
    found = {r.subset: r for r in vx.refresh_catalog(spark.createDataFrame(rows, CLIPS)).collect()}
    assert tuple(found["a"])[4:] == (5, 1.01, 1, 3, 0)
    assert tuple(found["b"]) == ("b", "b", "", "", 1, round(54 / 3600, 2), 0, 0, 1)


def test_listed_subsets_and_labels(spark, catalog):
    clips = spark.createDataFrame([("twi_twi", "train", 3600.0), ("new", "train", 3600.0)], CLIPS)
    listed = spark.createDataFrame([("twi_twi",), ("new",), ("aba_one",)], "subset string")
    found = {r.subset: tuple(r) for r in vx.refresh_catalog(clips, catalog, listed).collect()}
    assert found == {
        "twi_twi": ("twi_twi", "Twi", "twi", "GH", 1, 1.0, 1, 0, 0),
        "new": ("new", "new", "", "", 1, 1.0, 1, 0, 0),
        "aba_one": ("aba_one", "Abba", "aba", "CI", 0, 0.0, 0, 0, 0),
    }


def test_samples_come_before_recorded_durations(spark):
    schema = "subset string, split string, duration double, audio struct<array: array<float>, sampling_rate: int>"
    rows = [("a", "train", 3600.0, ([0.0] * 36, 1)), ("a", "train", 3600.0, (None, 16)), ("a", "train", 1800.0, ([0.0], 0)),
            ("a", "train", None, None)]
    df = spark.createDataFrame(rows, schema)
    assert vx.refresh_catalog(df).first().hours == 1.51
    assert vx.refresh_catalog(df, use_samples=False).first().hours == 2.5
    assert vx.refresh_catalog(df.drop("duration")).first().hours == 0.01


def test_long_sums_are_whole(spark):
    rows = [("s", str(i), "train", n) for i, n in enumerate([3e9, 9.3e10, float("inf"), float("nan"), None])]
    clips = spark.createDataFrame(rows, "subset string, id string, split string, duration double")
    assert vx.refresh_catalog(clips).first().hours == round((3e9 + 9.3e10) / 3600, 2)


FILES = "id string, audio struct<bytes: binary, path: string>, duration double, subset string, split string"


def store(spark, path, name, rows):
    clips = [(str(i), (b"", ""), d, s, split) for i, (s, split, d) in enumerate(rows)]
    spark.createDataFrame(clips, FILES).coalesce(1).write.mode("overwrite").partitionBy("subset").parquet(f"{path}/{name}")


def test_refresh_of_changed_files_equals_a_whole_one(spark, catalog, tmp_path, monkeypatch):
    path, ledger = str(tmp_path / "batch é"), str(tmp_path / "ledger")
    scanned = []
    plain = refresh._added_up
    monkeypatch.setattr(refresh, "_added_up", lambda clips, use: scanned.append(len(clips.inputFiles())) or plain(clips, use))

    def check(files):
        found = vx.refresh_files(spark, path, ledger, catalog, catalog.select("subset"))
        whole = vx.refresh_catalog(spark.read.option("recursiveFileLookup", False).parquet(path), catalog, catalog.select("subset"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
        assert scanned == files
        scanned.clear()

    for part in range(2):
        store(spark, path, f"part={part}", [("twi_twi", "train", 3600.0), ("a b", "dev", 1800.5 + part), ("a b", "other", None)])
    check([4])
    store(spark, path, "part=2", [("twi_twi", "test", 720.0), ("aba_one", "train", 36.0)])
    check([2])
    check([])
    store(spark, path, "part=0", [("twi_twi", "train", 100.0)])  # one file is changed, one is gone
    check([1])
    monkeypatch.setattr(refresh, "BROADCAST_ROWS", 0)  # as with very many changed files
    store(spark, path, "part=1", [("aba_one", "val", 50.0), ("twi_twi", "train", 7.0)])
    check([5])
    assert {f.name for f in (tmp_path / "ledger").iterdir()} == {"last", "turn=0", "turn=1"}


def test_a_refresh_that_failed_is_done_again(spark, tmp_path):
    path, ledger = str(tmp_path / "clips"), tmp_path / "ledger"
    store(spark, path, "part=0", [("a", "train", 3600.0)])
    vx.refresh_files(spark, path, str(ledger))
    store(spark, path, "part=1", [("a", "train", 3600.0)])
    spark.createDataFrame([("broken",)], "file string").write.parquet(str(ledger / "turn=0"))  # written, but not told
    assert vx.refresh_files(spark, path, str(ledger)).first().hours == 2.0


def test_stored_sample_counts_spare_reading_samples(spark, tmp_path):
    schema = "subset string, split string, duration double, audio struct<array: array<array<float>>, sampling_rate: int>"
    rows = [("a", "train", 3600.0, ([[0.0] * 36] * 2, 1)), ("a", "train", 3600.0, (None, 16)), ("a", "train", 1800.0, ([[0.0]], 0)),
            ("a", "train", None, None), ("a", "train", 36.0, ([], 4))]
    clips = spark.createDataFrame(rows, schema)
    vx.write_dataset(clips, str(tmp_path / "clips"))
    stored = vx.read_dataset(spark, str(tmp_path / "clips"))
    refreshed = vx.refresh_catalog(stored)
    assert refreshed.collect() == vx.refresh_catalog(clips).collect()
    plan = refreshed._jdf.queryExecution().executedPlan().toString()
    assert "sampling_rate" in plan and "array" not in plan.split("ReadSchema")[1]


def test_files_of_the_query_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    n, sf, scratch = 4000, str(tmp_path / "sf"), tmp_path / "scratch"
    line = ["id AS l_orderkey", "id % 7 AS l_partkey", "IF(id % 3 = 0, 0, id % 400) AS l_suppkey", "CAST(id % 5 AS int) AS l_linenumber",
            "CAST(id % 50 AS double) AS l_quantity", "substring('NRA', 1 + int(id % 3), 1) AS l_returnflag"]
    spark.range(n).selectExpr(*line).write.parquet(f"{sf}/lineitem.parquet")
    spark.range(400).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(0 AS int) AS s_nationkey").write.parquet(f"{sf}/supplier.parquet")
    spark.range(1).selectExpr("CAST(0 AS int) AS n_nationkey", "'NATION_0' AS n_name").write.parquet(f"{sf}/nation.parquet")
    monkeypatch.setattr(queries, "CLIPS_PER_FILE", 200)
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(scratch / name))

    found = queries.FOUND["catalog_refresh_files"](spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, st.item_catalog(spark, sf).collect()))
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in (scratch / "clips").rglob("*.parquet")]
    assert sum(sizes) == n and max(sizes) <= 2 * 200  # the largest subset, a third of the clips, is split too
    # A subset lies in few files, so the ledger does not grow with files times subsets.
    ledger = spark.read.parquet(str(scratch / "ledger" / "turn=0"))
    pairs = st.item_clips(spark, sf).select("subset", "split").distinct().count()
    assert ledger.where(F.col("clips").isNotNull()).count() <= 2 * pairs + 6 * len(sizes)
