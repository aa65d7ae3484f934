import csv
import glob

import pytest
from pyspark.sql import functions as F

import voxloom as vx
from conftest import CATALOG_ROWS
from voxloom.functions import columns as c
from voxloom.schemas import CATALOG_COLUMNS, CATALOG_SCHEMA

HEADER = "\t".join(CATALOG_COLUMNS)


def names(df):
    return sorted(row.subset for row in df.collect())


def test_round_trip_is_sorted_and_whole(spark, catalog, tmp_path):
    path = str(tmp_path / "catalog")
    vx.write_catalog(catalog.orderBy(F.desc("subset")), path)
    assert [tuple(r) for r in vx.load_catalog(spark, path).orderBy("subset").collect()] == CATALOG_ROWS


def write(tmp_path, *rows):
    path = tmp_path / "catalog.tsv"
    path.write_text("\n".join((HEADER, *rows)) + "\n", encoding="utf-8")
    return str(path)


def test_text_is_trimmed_and_empty_text_stays_empty(spark, tmp_path):
    path = write(tmp_path, " a_b \tÉwé \t\t \t 3\t0.5\t3\t0\t0")
    row = vx.load_catalog(spark, path).first()
    assert (row.subset, row.language, row.iso, row.country, row.clips) == ("a_b", "Éwé", "", "", 3)


@pytest.mark.parametrize("row", ["a\tA\ta\tGH\tmany\t1.0\t1\t0\t0", "a\tA\ta\tGH\t1\t\t1\t0\t0"])
def test_bad_or_missing_number_is_an_error(spark, tmp_path, row):
    with pytest.raises(Exception):
        vx.load_catalog(spark, write(tmp_path, row)).collect()


def test_bad_number_is_found_whatever_is_asked(spark, tmp_path):
    path = write(tmp_path, "a\tA\ta\tGH\tabc\t1.0\t1\t0\t0", "b\tB\tb\tGH\t1\t1.0\t1\t0\t0")
    for ask in (lambda df: df.count(), lambda df: vx.countries(df).collect()):
        with pytest.raises(ValueError, match="clips=abc"):
            ask(vx.load_catalog(spark, path))


ODD_TEXT = ['Nd\'i "North" x', 'back\\slash', '"quoted"', "tab\tin it", "a\\\"b"]


def test_quoted_text_of_other_writers(spark, tmp_path):
    path = tmp_path / "catalog.tsv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, delimiter="\t").writerows([CATALOG_COLUMNS, *[[f"s{i}", t, "i", "GH", 1, 1.0, 1, 0, 0] for i, t in enumerate(ODD_TEXT)]])
    found = {r.subset: r.language for r in vx.load_catalog(spark, str(path)).collect()}
    assert found == {f"s{i}": t for i, t in enumerate(ODD_TEXT)}


def test_quoted_text_is_written_for_other_readers(spark, tmp_path):
    rows = [(f"s{i}", t, "i", "GH", 1, 1.0, 1, 0, 0) for i, t in enumerate(ODD_TEXT)]
    vx.write_catalog(spark.createDataFrame(rows, CATALOG_SCHEMA), str(tmp_path / "out"))
    back = {}
    for part in glob.glob(str(tmp_path / "out" / "part-*")):
        with open(part, newline="", encoding="utf-8") as lines:
            back |= {r["subset"]: r["language"] for r in csv.DictReader(lines, delimiter="\t")}
    assert back == {r[0]: r[1] for r in rows}


def test_wrong_header_is_an_error(spark, tmp_path):
    path = tmp_path / "catalog.tsv"
    path.write_text(HEADER.replace("clips\thours", "hours\tclips") + "\na\tA\ta\tGH\t1.5\t1\t1\t0\t0\n")
    with pytest.raises(Exception):
        vx.load_catalog(spark, str(path)).collect()


def test_hours_bounds_are_inclusive(catalog):
    assert names(vx.filter_catalog(catalog, min_hours=11.24, max_hours=20.30)) == ["bel_two", "cor_tie", "dun_tie"]


def test_countries_are_upper_cased_but_not_trimmed(catalog):
    assert names(vx.filter_catalog(catalog, countries=["gh"])) == ["bel_two", "twi_twi"]
    assert names(vx.filter_catalog(catalog, countries=[" gh"])) == []
    assert len(names(vx.filter_catalog(catalog, countries=[]))) == 6


def test_require_split(catalog):
    assert names(vx.filter_catalog(catalog, split="test")) == ["aba_one", "bel_two", "twi_twi"]
    assert len(names(vx.filter_catalog(catalog, split="test", require_split=False))) == 7
    assert len(names(vx.filter_catalog(catalog, split="all"))) == 7
    with pytest.raises(KeyError):
        vx.filter_catalog(catalog, split="validation")


def test_min_clips(catalog):
    assert names(vx.filter_catalog(catalog, min_clips=1776)) == ["aba_one", "bel_two", "twi_twi"]


def test_country_names_fall_back_to_the_code(catalog):
    found = {r.country: r.country_name for r in vx.entry_records(catalog).collect()}
    assert found["GH"] == "Ghana" and found["CI"] == "Côte d'Ivoire" and found["XX"] == "XX"
    listed = {r.country: r.country_name for r in vx.list_languages(catalog).collect()}
    assert listed["GH"] == "Ghana" and listed["XX"] == ""


def test_listing_is_by_hours_and_keeps_empty_splits(catalog):
    assert [r.subset for r in vx.list_languages(catalog).collect()] == [
        "twi_twi", "bel_two", "cor_tie", "dun_tie", "aba_one", "ewi_few", "zul_non"
    ]


def test_totals_and_countries(catalog):
    assert tuple(vx.catalog_totals(catalog).first()) == (7, 98.2, 5)
    assert [r.country for r in vx.countries(catalog).collect()] == ["CI", "GH", "KE", "NG", "XX"]
    assert vx.countries(catalog.where("false")).collect() == []
    assert tuple(vx.catalog_totals(catalog.where("false")).first()) == (0, 0.0, 0)


def test_avg_clip_seconds(catalog):
    found = {r.subset: r.a for r in catalog.select("subset", c.avg_clip_seconds().alias("a")).collect()}
    assert found["twi_twi"] == pytest.approx(50.32 * 3600 / 17140)
    assert found["zul_non"] == 0.0


def test_split_size(catalog):
    sizes = [c.split_size(s).alias(s + "_") for s in ("train", "val", "test", "all")]
    assert tuple(catalog.where("subset = 'bel_two'").select(*sizes).first()) == (6038, 441, 429, 6908)
