"""Toxicity by gradient-boosted trees over dense features.

A bounded sample of labelled rows is what anything is learned from, in three folds: a lexicon of
words and word beginnings with their log odds, then boosted trees on features that use the
lexicon, then an isotonic calibration of the trees' output. Scoring is one pass over all texts
for the features, and expressions for the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import hashed_share, settle, text_of, values
from voxloom.llm.language_id import fold

# About so many labelled rows are learned from, chosen by a hash of their id.
FIT_ROWS = 40_000
# Words in the lexicon, the surest first.
LEXICON_WORDS = 20_000
STEM = 5
NEAR = 6
# Second person in the languages looked after.
SECOND_PERSON = frozenset("you your yours u ya du dich dir dein deine ihr euch tu te toi ton vous votre ti usted ustedes vosotros vos".split())
_WORD = re.compile(r"[^\W\d_]+(?:[*@$#!0-9][^\W\d_]+)*")
_UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": ""})
FEATURES = (
    "hits", "hit_odds", "most_odds", "stem_hits", "near_second_person", "masked_hits", "capitals", "shouted",
    "exclamations", "punctuation", "masked", "stretched", "words",
)


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> tuple:
    """The FEATURES of a text: densities are by word or by character."""
    tokens = _WORD.findall(text)
    n, chars = max(len(tokens), 1), max(len(text), 1)
    low = [t.lower() for t in tokens]
    hits = [i for i, w in enumerate(low) if w in words]
    odds = [words[low[i]] for i in hits]
    masked = [i for i, w in enumerate(low) if not w.isalpha()]
    unmasked = [i for i in masked if low[i] not in words and low[i].translate(_UNMASK) in words]
    stem_hits = sum([w[:STEM] in stems for w in low])
    near = 0
    for i in hits + unmasked:
        near += any(w in SECOND_PERSON for w in low[max(0, i - NEAR) : i + NEAR + 1])
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum([len(t) > 2 and t.isupper() for t in tokens])
    marks = text.count("!") + text.count("?")
    plain = sum(map(text.count, ".,;:"))
    stretched = sum([len(w) > 3 and any(c * 3 in w for c in set(w[1:-1])) for w in low if len(set(w)) < len(w) - 1])
    return (
        len(hits) / n * 100, sum(odds) / n, max(odds, default=0.0), stem_hits / n * 100, near / n * 100, len(unmasked) / n * 100,
        capitals / chars, shouted / n, marks / chars, plain / chars, len(masked) / n, stretched / n, float(np.log1p(len(tokens))),
    )


@dataclass
class Toxicity:
    """What is learned; ``trees`` is None where the labels say too little, and ``rate`` stands in."""

    words: dict
    stems: dict
    trees: object
    calibration: object
    rate: float


def _with_features(rows: DataFrame, words: dict, stems: dict, keep: list[str]) -> DataFrame:
    """``keep`` and the features of the column text, whole."""
    shared = rows.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches):
        words, stems = shared.value
        for batch in batches:
            found = [features(t, words, stems) for t in values(batch.column(0))]
            table = np.array(found, np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(table[:, i]) for i in range(len(FEATURES)))], names=[*keep, *FEATURES]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{f} double" for f in FEATURES])
    return rows.select(text_of().alias("text"), *keep).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic, part): about ``rows`` labelled documents outside the held-out fold, or
    all where there are fewer.

    They are chosen by a hash of the id, so about ``rows`` ids are broadcast and no text is shuffled. Contradicting labels of an id count as toxic; null ids and labels are left out.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    ).where(fold(F.col("doc_id"), 5) != 0)
    chosen = settle(chosen, "labels")
    chosen = settle(chosen.where(hashed_share(F.col("doc_id"), rows, chosen.count())), "chosen")
    texts = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)).cast("int")
    return texts.join(F.broadcast(chosen), "doc_id").withColumn("part", part)


def lexicon(rows: DataFrame, size: int = LEXICON_WORDS) -> tuple[dict, dict]:
    """Words and word beginnings that are met in toxic documents far more often, with log odds."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("token")
    total = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, other = total[0] or 0, total[1] or 0
    out = []
    words = rows.select("doc_id", "toxic", token)
    for name, tokens in (("word", words), ("stem", words.where(F.length("token") > STEM).select("doc_id", "toxic", F.substring("token", 1, STEM).alias("token")).distinct())):
        least = max(3, 0.002 * toxic)
        counts = tokens.groupBy("token").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= least)
        odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (other + 1))
        surest = counts.withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("odds") * F.sqrt("a")), "token").limit(size)
        out.append({r.token: r.odds for r in surest.collect()})
    return out[0], out[1]


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, rounds: int = 12, depth: int = 3, seed: int = 42) -> Toxicity:
    """Learn from about ``rows`` labelled documents: half for the lexicon, a quarter each for the
    trees and the calibration."""
    sample = settle(labelled_sample(docs, labels, rows), "labelled")
    words, stems = lexicon(sample.where("part < 2"))
    known = settle(_with_features(sample.where("part >= 2"), words, stems, ["toxic", "part"]), "features")
    count = {(r.part, r.toxic): r.n for r in known.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    rate = (sum(n for (_, t), n in count.items() if t) + 0.5) / (sum(count.values()) + 1) if count else 0.0
    if not (count.get((2, 0)) and count.get((2, 1))):
        return Toxicity(words, stems, None, None, rate)
    trees = GBTClassifier(
        featuresCol="vector", labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32, minInstancesPerNode=5,
    ).fit(_vector(known.where("part = 2")))
    calibration = None
    if count.get((3, 0)) and count.get((3, 1)):
        output = _raw(trees, known.where("part = 3")).select("raw", F.col("toxic").cast("double"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(output)
    return Toxicity(words, stems, trees, calibration, rate)


def _raw(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(_vector(rows)).withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score, predicted) for every row, from the text alone.

    The calibrated score has steps; a hundredth of the trees' own output orders texts within a step.
    Null and empty texts are scored by the features of an empty text. Repeated rows and rows with
    a null doc_id get rows of their own; an empty table gives an empty result.
    """
    rows = _with_features(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), model.words, model.stems, ["doc_id"])
    if model.trees is None:
        scored = rows.withColumn("score", F.lit(model.rate))
    else:
        scored = _raw(model.trees, rows)
        level = F.col("raw")
        if model.calibration is not None:
            scored = model.calibration.setPredictionCol("level").transform(scored)
            level = F.col("level")
        scored = scored.withColumn("score", F.least(F.greatest(0.99 * level + 0.01 * F.col("raw"), F.lit(0.0)), F.lit(1.0)))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of all rows by what the labels outside one fold of the ids say, plus ``held_out``.
    A null doc_id is in no fold."""
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
