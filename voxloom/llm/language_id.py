"""Language identification by error-correcting output codes.

Every language has a codeword. For each of its bits a binary classifier of hashed character
n-grams tells the languages with a 1 from those with a 0; all of them follow from one table of
n-gram counts by language, which Spark adds up over all training documents. A second pass over
these measures how often each classifier is right for each language. Decoding weights the loss
of each bit by that, takes the nearest codeword, and flags texts that are nearly as near to
another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import text_of, values

BUCKETS = 1 << 15
# Languages the driver may hold counts of, BUCKETS each.
MAX_LANGUAGES = 200
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # not a fraction or a raised digit
_SPACE = np.array([b if chr(b).isalpha() or b > 127 else 32 for b in range(256)], np.uint8)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def grams(text: str) -> np.ndarray:
    """Buckets of the three-byte n-grams of a lower-cased text, all that is no letter being space."""
    raw = _SPACE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761) >> np.uint32(32 - 15)).astype(np.int32)


def codewords(count: int, seed: int = 42) -> np.ndarray:
    """Codewords of -1 and 1, one row for each language.

    Few languages have all splits in two there are; more have random splits, of 200 draws the
    one whose nearest codewords are farthest apart.
    """
    if count <= 5:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(count)] for s in range(1, 2 ** max(count - 1, 1))]
        return np.array(splits, np.int8).T
    rng, bits, best, least = np.random.default_rng(seed), math.ceil(10 * math.log2(count)), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (count, bits))
        code = code[:, np.abs(code.sum(axis=0)) < count]  # a bit that splits nothing tells nothing
        near = ((code.shape[1] - code.astype(int) @ code.T) // 2 + np.eye(count, dtype=int) * bits).min()
        if near > least:
            best, least = code, near
    return best


@dataclass
class Codes:
    """Languages, their codewords, n-gram weights of each bit, and how far each bit is to be
    trusted for each language."""

    languages: list
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Mean weight of the text's n-grams for each bit."""
        found = grams(text)
        return self.weights[found].mean(axis=0, dtype=np.float64) if len(found) else np.zeros(self.words.shape[1])

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """The nearest codeword by weighted logistic loss, its share of belief, and the next one's."""
        loss = (self.trust * np.logaddexp(0, -4 * self.words * margins)).sum(axis=1)
        belief = np.exp(loss.min() - loss) ** 4
        belief /= belief.sum()
        order = np.argsort(-belief, kind="stable")
        return int(order[0]), float(belief[order[0]]), float(belief[order[1]]) if len(order) > 1 else 0.0


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches):
        counts: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                np.add(own, np.bincount(grams(text), minlength=BUCKETS), out=own)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                names=["language", "bucket", "n"],
            )

    return docs.mapInArrow(run, "language string, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def _trusted(docs: DataFrame, codes: Codes) -> np.ndarray:
    """Share of each language's documents for which each bit is right, rows summing to 1."""
    at = {name: i for i, name in enumerate(codes.languages)}
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    bits = codes.words.shape[1]

    def run(batches):
        right = np.zeros((len(at), bits + 1), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = at[lang]
                right[i, :bits] += shared.value.margins(text) * shared.value.words[i] > 0
                right[i, bits] += 1
        rows, columns = np.nonzero(right)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(right[rows, columns])], names=["i", "j", "n"]
        )

    total = np.zeros((len(at), bits + 1))
    for r in docs.mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        total[r.i, r.j] = r.n
    share = (total[:, :bits] + 1) / (total[:, bits:] + 2)
    return share / share.sum(axis=1, keepdims=True)


def train(docs: DataFrame) -> Codes | None:
    """Codes from the columns text and lang of all of ``docs``; None without a language.

    BUCKETS counts for each language, of which there may be MAX_LANGUAGES, come to the driver.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), text_of().alias("text"))
    table = _counted(known).toArrow()
    names = sorted(set(table.column("language").to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return None
    at = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS))
    counts[[at[x] for x in table.column("language").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    shares = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    words = codewords(len(names))
    weights = np.zeros((BUCKETS, words.shape[1]), np.float32)
    for j in range(words.shape[1]):
        one, other = words[:, j] > 0, words[:, j] < 0
        if one.any() and other.any():
            weights[:, j] = np.log(shares[one].mean(axis=0) / shares[other].mean(axis=0))
    codes = Codes(names, words, weights, np.full(words.shape, 1 / words.shape[1]))
    codes.trust = _trusted(known, codes)
    return codes


def identify(docs: DataFrame, codes: Codes | None, ambiguous_gap: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row.

    ``score`` is the belief in the language among those learned; ``ambiguous`` says that the next
    one's is less than ``ambiguous_gap`` lower. Texts that are null or have no letter are ``und``
    with score 0, as all are if nothing was learned. Only text is looked at; repeated rows and rows
    with a null doc_id get rows of their own; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        codes = shared.value
        for batch in batches:
            rows = []
            for text in values(batch.column(1)):
                if codes is None or not _LETTER.search(text):
                    rows.append((UNKNOWN, 0.0, False))
                else:
                    best, score, following = codes.decode(codes.margins(text))
                    rows.append((codes.languages[best], score, score - following < ambiguous_gap))
            columns = list(zip(*rows)) or [()] * 3
            kinds = [pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, ambiguous boolean"
    )


def identify_held_out(docs: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """``identify`` with codes learned from the documents outside one fold of the ids, plus
    ``held_out``. A null doc_id is in no fold: nothing is learned from it, and it is not held out."""
    codes = train(docs.where(fold(F.col("doc_id"), parts) != held))
    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))
    return identify(docs, codes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
