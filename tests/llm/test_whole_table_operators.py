"""Resampling, exact deduplication and the manifest against SQL and plain versions, with awkward rows."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import common, exact_dedup, manifest, resampling
from voxloom.llm.oracles import ORACLES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Lorem ipsum dolor, sit amet! " * 30_000
ROWS = [
    (1, "Some words that come TWICE", "en", "a", 26), (2, "some words that come twice", "en", "a", 26),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, "Ünï CÖDE", "de", "b", 8), (6, "ünï cÖde", "de", None, 8),
    (7, LONG, "en", "a", len(LONG)), (8, "... --- !!!", "", "a", 11), (None, "no id", "fr", "a", 5), (None, "no id", "fr", "a", 5),
    (None, None, None, None, None), (9, "twice the same row", "en", "a", 18), (9, "twice the same row", "en", "a", 18),
    (9, "the same id", "en", "a", 11), (-3, "below zero", "en", "a", 10), (10, "n_chars is null", "en", "a", None),
    *[(100 + i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(15 + i % 20)), "en" if i % 3 else "es", "c", i) for i in range(120)],
]
TARGET = [(0, "w1 w2 w3 w4 w5"), (1, None), (2, "Lorem IPSUM"), (3, "w1 w2")]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def awkward(docs):
    """The same documents with extra columns named like those the operators use themselves."""
    extra = {c: F.lit(7) for c in ("salt", "digest", "n", "copy", "keep_id", "tree", "node", "pos", "first", "codes", "rank", "score", "a.b")}
    return docs.withColumns(extra).withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))


def by_sql(name, rows=ROWS, target=TARGET):
    con = duckdb.connect()
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    con.register("documents", pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text", "lang", "source", "n_chars"]))
    con.register("benchmark", pa.table([pa.array(c, k) for c, k in zip(zip(*target), kinds)], names=["item_id", "text"]))
    found = con.execute(ORACLES[name])
    return [c[0] for c in found.description], sorted(found.fetchall(), key=repr)


def same(df, name, **tables):
    columns, rows = by_sql(name, **tables)
    assert df.columns == columns
    assert sorted(map(tuple, df.collect()), key=repr) == rows


def tampered():
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(odd, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def test_resampling_like_sql(spark):
    target = spark.createDataFrame(TARGET, "item_id bigint, text string")
    same(resampling.resample(awkward(documents(spark)), target), "op11_resampling")


def test_resampling_features():
    words = resampling.collapsed("  The-QUICK\x00brown\tÄx é2 ".encode()).decode()
    assert words == "the quick brown Äx é2"
    runs = [" ".join(words.split()[i:i + k]) for i in range(5) for k in (1, 2, 3) if i + k <= 5]
    assert list(resampling.crcs(words.encode())) == [zlib.crc32(r.encode()) for r in runs]
    assert list(resampling.crcs(b"")) == [] and list(resampling.crcs(b"one")) == [zlib.crc32(b"one")]


@pytest.mark.parametrize("rows", [[], ROWS])
def test_resampling_of_little(spark, rows):
    nothing = spark.createDataFrame([], "text string")
    found = resampling.resample(documents(spark, rows), nothing, percent=100, min_words=0).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, len(rows) + 1))
    order = sorted(found, key=lambda r: r["rank"])
    keys = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys)
    assert all(r["rank"] is None for r in resampling.resample(documents(spark, rows), nothing, percent=0).collect())


def test_resampling_leans_towards_target(spark):
    docs = [(i, " ".join((["red", "green", "blue"] if i % 4 == 0 else ["one", "two", "three"]) * 10), "en", "a", 1) for i in range(400)]
    drawn = resampling.resample(documents(spark, docs), spark.createDataFrame([("red green blue red",)], "text string"), percent=10)
    assert {r.doc_id % 4 for r in drawn.where("rank is not null").collect()} == {0}


def test_exact_copies_like_sql(spark):
    same(exact_dedup.duplicate_groups(awkward(documents(spark))), "op12_exact_dedup")
    assert exact_dedup.duplicate_groups(documents(spark, [])).count() == 0


def test_exact_copies_with_colliding_digests(spark):
    """Texts that share a digest stay apart, whatever the salt."""
    rows = ROWS + [(500 + i, "hot", "en", "a", 3) for i in range(300)]
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    found = exact_dedup.duplicate_groups(documents(spark, rows), salts=5, digest=weak)
    columns, expected = by_sql("op12_exact_dedup", rows)
    narrow = sorted(map(tuple, found.drop("text_sha256").collect()), key=repr)
    assert narrow == sorted((r[:4] for r in expected), key=repr)


def test_kept_rows(spark):
    docs = awkward(documents(spark))
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    expected = [r for r in by_sql("op12_exact_dedup")[1] if r[3]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in expected), key=repr)


def test_many_equal_rows_are_cut_into_shares(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES_AT_ONCE", 10)
    rows = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "k string, n bigint")
    found = sorted(map(tuple, common.copies(rows, "n", "i").collect()))
    assert found == [(k, i) for k, n in (("a", 25), ("b", 1), ("c", 10)) for i in range(n)]


def test_manifest_like_sql(spark):
    same(manifest.document_manifest(awkward(documents(spark)), claims=tampered()), "op13_manifest")
    assert manifest.document_manifest(documents(spark, [])).count() == 0
    alone = manifest.document_manifest(documents(spark, ROWS[:1])).first()
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.verified


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout):
    """(doc_id, leaf, subroot, root, proof) by lists."""
    def tree(nodes):
        """The root, and for each node the siblings on its way up."""
        at, paths = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for path, i in zip(paths, at):
                run = i - i % fanout
                path.append("".join(nodes[j] for j in range(run, min(run + fanout, len(nodes))) if j != i))
            nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
            at = [i // fanout for i in at]
        return nodes[0], paths

    written = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_lang = {}
    for doc_id, text, lang, source, n_chars in rows:
        by_lang.setdefault(lang, []).append((doc_id, h(*map(written, (doc_id, source, lang, n_chars, text)))))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    for leaves in by_lang.values():
        leaves.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    trees = [tree([leaf for _, leaf in by_lang[lang]]) for lang in langs]
    root, above = tree([subroot for subroot, _ in trees])
    return sorted((
        (doc_id, leaf, subroot, root, h(*path, *up))
        for lang, (subroot, paths), up in zip(langs, trees, above) for (doc_id, leaf), path in zip(by_lang[lang], paths)
    ), key=repr)


@pytest.mark.parametrize("fanout, step, ranges", [(2, 6, 1 << 18), (2, 2, 20), (3, 2, 20), (7, 1, 20)])
def test_manifest_of_any_shape(spark, monkeypatch, fanout, step, ranges):
    monkeypatch.setattr(manifest, "RANGE_ROWS", ranges)
    rows = ROWS + [(9, "twice the same row", "en", "a", 18)] * 40  # a run that reaches over subtrees
    found = manifest.document_manifest(documents(spark, rows), fanout=fanout, step=step).collect()
    assert sorted((tuple(r[:5]) for r in found), key=repr) == plain_manifest(rows, fanout)
    assert all(r.verified and r.folded_root == r.root for r in found)


def test_manifest_tells_changed_rows(spark):
    found = manifest.document_manifest(documents(spark), claims=tampered()).collect()
    changed = {r[0] for r in ROWS if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert changed and {r.doc_id for r in found if not r.verified} == changed
