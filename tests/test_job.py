import pytest
from pyspark.sql import functions as F

import voxloom as vx
from voxloom.schemas import STANDARD_COLUMNS

TABLE = "id string, audio struct<bytes: binary, path: string>, text string, duration double, subset string, split string"


@pytest.fixture(scope="module")
def clips(spark):
    rows = [
        (f"{s}-{i}", (b"", f"{s}/{i}"), "digit 1" if i % 10 == 9 else f"words of {s}", 2.0 + i % 14, s, "train")
        for s in ("twi_twi", "bel_two", "aba_one") for i in range(40)
    ]
    return spark.createDataFrame(rows, TABLE).cache()


def run(clips, catalog, tmp_path, **options):
    return vx.run_selection(clips, catalog, vx.SelectionConfig(**options), str(tmp_path / "out"))


def test_dry_run_builds_nothing(clips, catalog, tmp_path):
    result = run(clips, catalog, tmp_path, top=3, per_language=50, dry_run=True)
    assert result.plan.count() == 3 and result.built is None and not (tmp_path / "out").exists()


def test_total_hours_are_shared_evenly(clips, catalog, tmp_path):
    result = run(clips, catalog, tmp_path, top=4, max_per_country=2, total_hours=12.0, dry_run=True)
    assert result.seconds_each == 3.0 * 3600


def test_asking_for_too_much_is_reported(clips, catalog, tmp_path):
    result = run(clips, catalog, tmp_path, languages="ewi_few", total_hours=20.0, dry_run=True)
    row = result.shortfall.first()
    assert row.short and row.limited_by == "Ewi"


def test_refusals(clips, catalog, tmp_path):
    with pytest.raises(ValueError, match="cap"):
        run(clips, catalog, tmp_path, top=3)
    with pytest.raises(ValueError, match="top"):
        run(clips, catalog, tmp_path, per_language=3)
    with pytest.raises(ValueError, match="match"):
        run(clips, catalog, tmp_path, top=3, min_hours=1000.0, per_language=3)
    with pytest.raises(KeyError):
        run(clips, catalog, tmp_path, languages="nobody", per_language=3)
    with pytest.raises(ValueError, match="zip"):
        run(clips, catalog, tmp_path, top=1, per_language=3, formats="disk,zip")


def test_formats(spark, clips, catalog, tmp_path):
    result = run(clips, catalog, tmp_path, languages="twi_twi,aba_one", per_language=10,
                 formats="disk, parquet,csv,ljspeech,vits", schema="whisper")
    rows = result.built.collect()
    assert len(rows) == 20 and all(3.0 <= r.length <= 15.0 and "1" not in r.text for r in rows)
    assert tuple(result.summary.first()) == (20, 2)
    for table in ("parquet", "disk"):
        assert spark.read.parquet(result.written[table]).columns == ["audio", "sentence"]
    # Manifests have their transcripts whatever schema the tables are in.
    manifest = spark.read.text(result.written["ljspeech"] + "/metadata.csv")
    assert manifest.count() == 20 and manifest.where(F.col("value").endswith("|words of twi_twi")).count() == 10
    assert set(result.written) == {"disk", "parquet", "csv", "ljspeech", "vits"}
    assert set(STANDARD_COLUMNS) <= set(result.built.columns)


def test_full_pull(clips, catalog, tmp_path):
    result = run(clips, catalog, tmp_path, languages="twi_twi", allow_full=True)
    assert result.built.count() == clips.where("subset = 'twi_twi' and duration between 3 and 15 and text not like '%1'").count()
