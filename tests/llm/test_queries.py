"""The registered queries on the smallest tables, against plain versions of what they return."""

import os
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from test_pair_operators import plain_components, plain_fingerprint
from test_row_operators import plain_counts, plain_spans
from test_suffix_dedup import brute

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF_DIR}/documents.parquet'").fetchall()


def rows(spark, name):
    return entry_points.queries()[name](spark, SF_DIR).collect()


def test_all_are_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in entry_points.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry_points.queries()


def test_repeats(spark, docs):
    found = rows(spark, "op1_suffix_dedup")
    assert sorted(map(tuple, found), key=repr) == brute([d[:2] for d in docs])


def test_personal_data(spark, docs):
    found = {r.doc_id: r for r in rows(spark, "op2_pii")}
    for i, text, *_ in docs:
        assert [found[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [len(v) for v in plain_spans(text or "").values()]


def test_fingerprints(spark, docs):
    found = {r.doc_id: r for r in rows(spark, "op8_simhash")}
    prints = {d[0]: plain_fingerprint(d[1]) for d in docs}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    least = plain_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert {i: r.component_id for i, r in found.items()} == least


def test_quality(spark, docs):
    found = {r.doc_id: r for r in rows(spark, "op10_quality_rules")}
    for i, text, *_ in docs:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)


def test_folds_and_scores(spark, docs):
    for name, parts, held in (("op3_toxicity", 5, 0), ("op7_language_id", 3, 1)):
        found = rows(spark, name)
        assert sorted(r.doc_id for r in found) == sorted(d[0] for d in docs)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and 0 <= r.score <= 1 for r in found)


def test_vectors_and_sizes(spark, docs):
    vectors = duckdb.sql(f"select count(*) from '{SF_DIR}/embeddings.parquet'").fetchall()[0][0]
    assert len(rows(spark, "op5_embedding_dedup")) == vectors
    sizes = {r.doc_id: r["size"] for r in rows(spark, "op9_mixing")}
    assert sizes == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in docs}
    assert {r.doc_id for r in rows(spark, "op6_best_fit_packing")} == set(sizes)
    counts = rows(spark, "op4_token_counts")
    assert sum(r.n_docs for r in counts) == len(docs)


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    frames, table = {}, spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = table.columns
    for name, stage in cp.STAGES:
        table = cp.settle(stage(spark, table, SF_DIR), "stage")
        frames[name] = table
        assert name == "packing" or table.columns == names
    kept = {r.doc_id for r in rows(spark, "op10_quality_rules") if r.kept}
    assert {r.doc_id for r in frames["quality"].collect()} == kept
    prints = {r.doc_id: plain_fingerprint(r.text) for r in frames["quality"].collect()}
    least = plain_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert sorted(r.doc_id for r in frames["near_duplicates"].collect()) == sorted(set(least.values()))
    clean = frames["personal_data"].collect()
    assert sorted(r.doc_id for r in clean) == sorted(set(least.values()))
    assert all(not any(plain_spans(r.text).values()) and r.n_chars == len(r.text) for r in clean)
    mixed = [r.doc_id for r in frames["mixture"].collect()]
    assert set(mixed) <= {r.doc_id for r in clean} and max(map(mixed.count, mixed)) <= 2
    packed = frames["packing"].collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(mixed)
    assert cp.ORACLE_SQL is None and len(rows(spark, "pipeline")) == len(packed)


@pytest.mark.parametrize("name", ["op11_resampling", "op12_exact_dedup", "op13_manifest"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = con.execute(entry_points.oracle_sql()[name])
    columns, expected = [c[0] for c in found.description], found.fetchall()
    df = entry_points.queries()[name](spark, SF_DIR)
    assert df.columns == columns and sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)
