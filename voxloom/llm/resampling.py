"""Importance resampling of documents towards a target distribution.

Documents and target texts are compared by hashed n-grams. A text is lower-cased and its separators
are collapsed to single spaces; one overlapped scan with a boundary lookbehind then emits the spans
of one, two and three words that start at each word, whose CRC names a bucket. Buckets that the target
uses more than the documents do weigh a document up. Gumbel noise from a hash of the id is
added to the weight, so that the highest scores are a seeded draw without replacement.

Texts are scanned once: what later steps need is the bucket of each feature, two bytes each, stored in
the shared folder. Only the bucket counts, one number for each bucket, come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import copies, settle, text_bytes, values

# Every byte outside 0-9, a-z and the bytes of longer characters separates words.
SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# The span of a word, and those of the words after it. Scanned overlapped, so once from every word.
FEATURES = regex.compile(rb"(?<![^ ])([^ ]++)( [^ ]++)?( [^ ]++)?")
BUCKETS = 10_000
# Parts the range of drawn scores is cut into; their counts are added up one after the other.
SPANS = 1 << 16


def crcs(words: bytes):
    """CRC-32 of all runs of one to three words of a text with single spaces, repeats included.

    The CRC of a longer run goes on from that of the run before its last word.
    """
    for found in FEATURES.finditer(words, overlapped=True):
        one, two, three = found.groups()
        crc = zlib.crc32(one)
        yield crc
        if two is not None:
            crc = zlib.crc32(two, crc)
            yield crc
            if three is not None:
                yield zlib.crc32(three, crc)


def collapsed(text: bytes) -> bytes:
    """The words of a UTF-8 text, A-Z lower-cased, with single spaces between them."""
    return SEPARATORS.sub(b" ", text.lower()).strip(b" ")


def features(texts: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``keep`` columns, n_words, and as ``codes`` the bucket of each feature of ``text``, stored once."""
    code = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        for batch in batches:
            words, codes = [], []
            for text in values(batch.column(batch.num_columns - 1)):
                spaced = collapsed(text)
                words.append(spaced.count(b" ") + 1 if spaced else 0)
                found = np.fromiter(crcs(spaced), dtype=np.uint32)
                codes.append((found % buckets).astype(code).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(codes, pa.binary())],
                names=[*keep, "n_words", "codes"],
            )

    kept = ", ".join(f"`{name}` {texts.schema[name].dataType.simpleString()}" for name in keep)
    schema = f"{kept + ', ' if kept else ''}n_words bigint, codes binary"
    return settle(texts.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema), "features")


def bucket_counts(coded: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket: added up in tasks, then in Spark."""
    code = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for codes in values(batch.column(0)):
                counts += np.bincount(np.frombuffer(codes, dtype=code), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    sums = coded.select("codes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, dtype=object)  # whole numbers of any size
    for row in sums.toLocalIterator():  # at most one row for each bucket
        found[row.bucket] = row.n
    return found


def gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket adds to a weight: thousandths of the log ratio of its two shares, each count one up."""
    buckets, all_ours, all_target = len(ours), float(ours.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (all_ours + buckets) / ((float(s) + 1) * (all_target + buckets))))
        for s, t in zip(ours, target)
    ], dtype=np.int64)


def noise(key: str, seed: int) -> int:
    """Thousandths of Gumbel noise, from a hash of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(coded: DataFrame, bucket_gains: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of all rows, stored."""
    code = np.dtype("<u2" if len(bucket_gains) <= 1 << 16 else "<u4")

    def run(batches):
        for batch in batches:
            sizes, weights, scores = [], [], []
            for key, codes in zip(values(batch.column("key")), values(batch.column("codes"))):
                found = np.frombuffer(codes, dtype=code)
                sizes.append(len(found))
                weights.append(int(bucket_gains[found].sum()))
                scores.append(weights[-1] + noise(key, seed))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), *[pa.array(c, pa.int64()) for c in (sizes, weights, scores)]],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    kind = coded.schema["doc_id"].dataType.simpleString()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    return settle(coded.select("doc_id", "n_words", "codes", key).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"
    ), "scores")


def ranked(rows: DataFrame, eligible: Column, drawn: int) -> DataFrame:
    """All ``rows`` with ``rank``: places 1 to ``drawn`` of the eligible by score, then smaller doc_id; else null.

    No task sorts all of them. Counts of each score are added up in two steps, over parts of the
    range of scores and within a part, which are both bounded; only rows of one score are sorted together.
    Equal rows are one with a number until they are ranked.
    """
    nothing = rows.withColumn("rank", F.lit(None).cast("bigint"))
    if drawn == 0:
        return nothing
    counts = settle(rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")), "score_counts")
    low, high = counts.agg(F.min("score"), F.max("score")).first()
    width = max(1024, (high - low) // SPANS + 1)
    spanned = counts.withColumn("span", F.expr(f"({high} - score) div {width}"))
    before = lambda window: F.coalesce(
        F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    spans = spanned.groupBy("span").agg(F.sum("n").alias("n"))  # at most SPANS rows
    spans = spans.select("span", before(Window.orderBy("span")).alias("span_at"))
    places = spanned.join(spans, "span").select(
        "score", (F.col("span_at") + before(Window.partitionBy("span").orderBy(F.desc("score")))).alias("at")
    ).where(F.col("at") < drawn)  # scores of which at least one row is drawn
    places = settle(places, "score_places")
    lowest = places.agg(F.min("score")).first()[0]

    inside = eligible & (F.col("score") >= lowest)
    equal = rows.where(inside).groupBy(*rows.columns).agg(F.count("*").alias("n")).join(places, "score")
    in_score = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), *[c for c in rows.columns if c not in ("doc_id", "score")])
    numbered = copies(equal.withColumn("at", F.col("at") + before(in_score)), "n", "copy")
    rank = F.col("at") + F.col("copy") + 1
    top = numbered.select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))
    return nothing.where(~F.coalesce(inside, F.lit(False))).unionByName(top)


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, seed: int = 42
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, rank and n_words; a rank tells that it is drawn.

    ``docs`` has doc_id and text, ``target`` has text. Of the N documents with at least ``min_words`` words the
    floor(percent*N/100) of highest score are drawn, ties to the smaller doc_id, null ids last. A null or empty text has no
    features and weight 0. A null id is hashed like an empty one. Repeated rows count each time; an
    empty ``docs`` gives an empty table, an empty ``target`` only lowers buckets by their use. Other columns are not looked at.
    """
    coded = features(docs, ["doc_id"], buckets)
    weights = gains(bucket_counts(coded, buckets), bucket_counts(features(target, [], buckets), buckets))
    rows = scored(coded, weights, seed)
    eligible = F.col("n_words") >= min_words
    found = ranked(rows, eligible, percent * rows.where(eligible).count() // 100)
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
