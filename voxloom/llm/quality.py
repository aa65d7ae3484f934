"""Quality rules and n-gram perplexity.

The language model is a modified Kneser-Ney model of character classes, one for each value of
``lang``. Spark counts the n-grams of all documents; discounts, continuation counts and back-off
weights follow from that table by grouping. Characters are mapped to 64 classes, so a model has
at most 64 ** ORDER n-grams, which bounds what is broadcast: sorted arrays of n-gram codes with
their log probabilities. Documents are scored by it, and those whose perplexity is outside their
language's band are rejected. A second lower band is of what the perplexity gains by the order of
the words, against that of the same words in random order. A second upper band is of the perplexity
by word pairs (``word_model``), whose n-grams grow with the corpus and stay spread over tasks. It has
no lower band: low values there are those of copies, which are not junk. The bands come from the half
of a language's documents that lie closest together, so junk moves them little.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxloom.llm.common import columns_of, giving_back, portions, settle, text_bytes, values
from voxloom.llm.word_model import BLOCK_WORDS, SCORED_WORDS, among, hashed_words, settle_alone, word_entropy

CLASSES = 64
ORDER = 3
# Languages with a model of their own, those with most text; a model is below 64 ** ORDER * 12 bytes (3 MB).
# All others go by the model of all languages together. Each language has its own bands.
MAX_LANGUAGES = 200
# Bands of log perplexity reach so many times as far from the centre as the closest half of the documents does,
# and at least so far; likewise the band of word order. They are wider for short texts, by the root of 1 + SHORT / words.
BAND_WIDTH, BAND_LEAST, SHORT = 6.0, 0.5, 100
ORDER_WIDTH, ORDER_LEAST = 4.0, 0.2
WORD_WIDTH, WORD_LEAST = 4.0, 0.5
BIN, BINS = 0.01, 10_000
# Languages whose counts a task holds at once.
COUNTED_AT_ONCE = 32
# N-grams of a language that a task counts at once.
CODES_AT_ONCE = 200_000
# The model of all languages together, and the characters of which each block goes by the better of two models.
POOLED, BLOCK = "\x01", 64
SYMBOLS = b"#*$%&|<>"
# Bytes that begin no character of a word: white space and the later bytes of a character.
NO_CHARACTERS = b" \t\n\r\v\f" + bytes(range(0x80, 0xC0))
MIN_WORDS, MAX_REPEATED = 50, 50


def _class_table() -> np.ndarray:
    """Class of each code point below 128. 0: a text's ends; 1: white space; then letters,
    capitals by half alphabets, digits and signs. Later code points are 44 to 63 by their number."""
    table = np.full(128, 43, np.uint8)
    for c in " \t\n\r\v\f":
        table[ord(c)] = 1
    for i in range(26):
        table[97 + i] = 2 + i
        table[65 + i] = 28 + i // 13
    for c in "0123456789":
        table[ord(c)] = 30
    for i, c in enumerate(".,;:!?'\"-|/()"):
        table[ord(c)] = 31 + i % 12
    return table


TABLE = _class_table()
SOUNDS = np.array([2 <= c <= 30 or c >= 44 for c in range(CLASSES)])


def classes(text: bytes) -> np.ndarray:
    """Classes of a text's characters, between the classes of its ends."""
    if text.isascii():
        found = TABLE[np.frombuffer(text, np.uint8)]
    else:
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        found = np.where(points < 128, TABLE[np.minimum(points, 127)], 44 + points % 20).astype(np.uint8)
    ends = np.zeros(ORDER - 1, np.uint8)
    return np.concatenate((ends, found, ends[:1]))


def codes(found: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-grams of some classes as numbers, the earliest class in the highest bits."""
    out = found[: max(len(found) - order + 1, 0)].astype(np.int32)
    for i in range(1, order):
        out <<= 6
        out |= found[i : i + len(out)]
    return out


def language() -> F.Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(language, code, n): counts of the n-grams of all texts, added up in each task first, for the
    MAX_LANGUAGES languages with most of them; and those of all languages together under POOLED."""

    def packed(counts):
        for lang, n in counts.items():
            code = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(n[code])],
                names=["language", "code", "n"],
            )

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def count(lang):
            if waiting[lang]:
                counts[lang] += np.bincount(np.concatenate(waiting[lang]), minlength=CLASSES**ORDER)
            waiting[lang], sizes[lang] = [], 0

        def all_counted():
            for lang in counts:
                count(lang)
            yield from packed(counts)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                if lang not in counts:
                    if len(counts) == COUNTED_AT_ONCE:
                        yield from all_counted()
                    counts[lang], waiting[lang], sizes[lang] = np.zeros(CLASSES**ORDER, np.int64), [], 0
                found = codes(classes(text))
                waiting[lang].append(found)
                sizes[lang] += len(found)
                if sizes[lang] >= CODES_AT_ONCE:
                    count(lang)
        yield from all_counted()

    found = docs.select(language().alias("language"), text_bytes().alias("text")).mapInArrow(run, "language string, code int, n bigint")
    counts = settle(found.groupBy("language", "code").agg(F.sum("n").alias("n")), "ngrams")
    most = counts.groupBy("language").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "language").limit(MAX_LANGUAGES)
    own = counts.where(F.col("language").isin([r.language for r in most.collect()]))
    return own.unionAll(counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("language"), "code", "n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """A modified Kneser-Ney model: (language, length, code, logp, backoff).

    For each n-gram its interpolated log probability after its context, and the log of the
    weight its own continuations leave to shorter contexts (null where it has none).
    """
    of_length = {order: counts.select("language", "code", F.col("n").cast("double").alias("n"))}
    for k in range(order - 1, 0, -1):  # continuation counts: how many classes come before
        tail = F.col("code").bitwiseAND(F.lit((1 << 6 * k) - 1))
        of_length[k] = of_length[k + 1].groupBy("language", tail.alias("code")).agg(F.count("*").cast("double").alias("n"))
    lower = None
    weights = {}
    probabilities = {}
    for k in range(1, order + 1):
        table = of_length[k].withColumn("context", F.shiftright("code", 6))
        met = [F.sum(F.when(F.col("n") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        n = [F.col(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.when(n[0] + 2 * n[1] > 0, n[0] / (n[0] + 2 * n[1])).otherwise(0.5)
        discount = lambda i: F.when((n[i - 1] > 0) & (n[i] > 0), F.greatest(F.lit(0.1), i - (i + 1) * y * n[i] / n[i - 1])).otherwise(0.5 * i).alias(f"d{i}")
        discounts = table.groupBy("language").agg(*met).select("language", discount(1), discount(2), discount(3))
        table = table.join(F.broadcast(discounts), "language").withColumn(
            "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        )
        of_context = table.groupBy("language", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left"))
        table = table.join(of_context, ["language", "context"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if lower is None:
            probability = table.withColumn("p", own + F.col("left") / CLASSES)
        else:
            shorter = F.col("code").bitwiseAND(F.lit((1 << 6 * (k - 1)) - 1))
            probability = table.withColumn("shorter", shorter).join(
                lower.select("language", F.col("code").alias("shorter"), F.col("p").alias("q")), ["language", "shorter"]
            ).withColumn("p", own + F.col("left") * F.col("q"))
        lower = settle(probability.select("language", "code", "p"), f"order{k}")
        probabilities[k], weights[k - 1] = lower, of_context.select("language", F.col("context").alias("code"), "left")
    out = None
    for k in range(0, order + 1):
        p = probabilities[k].select("language", "code", F.log("p").alias("logp")) if k else None
        w = weights[k].select("language", "code", F.log("left").alias("backoff")) if k < order else None
        rows = w.select("language", "code", F.lit(None).cast("double").alias("logp"), "backoff") if p is None else (
            p.withColumn("backoff", F.lit(None).cast("double")) if w is None else p.join(w, ["language", "code"], "full")
        )
        rows = rows.select("language", F.lit(k).alias("length"), "code", "logp", "backoff")
        out = rows if out is None else out.unionAll(rows)
    return out


def sorted_arrays(model: DataFrame) -> dict:
    """The model as sorted arrays of codes with values beside them: {language: {length: arrays}}.

    At most 64 ** ORDER rows for each of MAX_LANGUAGES languages come to the driver.
    """
    names = [r[0] for r in model.where("length = 0").select("language").distinct().collect()]
    out: dict = {name: {} for name in names}
    table = model.toArrow()
    lang = np.array(table.column("language").to_pylist(), object)
    length, code = table.column("length").to_numpy(), table.column("code").to_numpy()
    values = [table.column(c).to_numpy().astype(np.float32) for c in ("logp", "backoff")]
    for name in names:
        for k in range(ORDER + 1):
            at = np.flatnonzero((lang == name) & (length == k))
            at = at[np.argsort(code[at])]
            out[name][k] = (code[at].astype(np.int32), values[0][at], values[1][at])
    return out


def _by_code(arrays, length: int, column: int) -> np.ndarray:
    """Values of all n-grams of a length, by their code; NaN where there are none."""
    out = np.full(CLASSES**length, np.nan, np.float32)
    out[arrays[0]] = arrays[1 + column]
    return out


def log_probabilities(model: dict) -> np.ndarray:
    """Log probability of every possible last class, by n-gram code: the longest n-gram that is
    there, with the back-off weights of the longer contexts."""
    every = np.arange(CLASSES**ORDER, dtype=np.int32)
    out = np.full(len(every), -math.log(CLASSES), np.float32)
    for k in range(ORDER + 1):
        if k:
            left = _by_code(model[k - 1], k - 1, 1)[every >> 6 & ((1 << 6 * (k - 1)) - 1)]
            out += np.nan_to_num(left, nan=0.0)
            own = _by_code(model[k], k, 0)[every & ((1 << 6 * k) - 1)]
            out = np.where(np.isnan(own), out, own)
    return out


def repeated_words(words: list[bytes], window: int = 3, at: np.ndarray | None = None) -> int:
    """Words in windows that are found twice or more, the first ones included. ``at`` are the places of windows among
    which are all that come twice; else all are looked at."""
    at = np.arange(len(words) - window + 1) if at is None else at
    if len(at) < 2:
        return 0
    there = np.zeros(len(words), bool)
    for i in range(window):
        there[at + i] = True
    ids: dict[bytes, int] = {}
    number = np.zeros(len(words), np.int64)
    number[there] = [ids.setdefault(words[i], len(ids)) for i in np.flatnonzero(there).tolist()]
    key = number[at]
    for i in range(1, window):  # ranks of longer and longer windows
        key = key * len(ids) + number[at + i]
        if i < window - 1:
            key = np.unique(key, return_inverse=True)[1] if len(ids) ** (i + 2) > 2**62 else key
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[at[twice] + i] = True
    return int(covered.sum())


def may_repeat(lengths: np.ndarray, words: np.ndarray, window: int = 3):
    """For each text the places of windows of words that may come twice in it, by the hashes of all their words, one text
    after another. Windows at no such place come once."""
    key = np.zeros(max(len(words) - window + 1, 0), np.uint64)
    for i in range(window):
        key = (key ^ key >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(key)]
    ends = np.cumsum(lengths)
    for start, end in zip((ends - lengths).tolist(), (ends - window + 1).tolist()):
        own = key[start : max(end, start)]
        by_key = np.sort(own)
        same = by_key[1:] == by_key[:-1]
        yield np.flatnonzero(among(own, by_key[1:][same])) if same.any() else np.zeros(0, np.int64)


def _counts(text: bytes, n_words: int | None = None, at: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """Counts of the base rules. If known, ``n_words`` and the places ``at`` of windows of words that may come twice."""
    if n_words is None or len(at):
        words = text.split()
        n_words, n_repeated = len(words), repeated_words(words, at=at)
    else:
        n_repeated = 0
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    characters, n_symbols = len(text.translate(None, NO_CHARACTERS)), len(text) - len(text.translate(None, SYMBOLS))
    return n_words, characters, n_symbols, repeated, n_repeated


def word_ends(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last class of each word in a text's classes."""
    blank = found <= 1
    change = np.flatnonzero(blank[1:] != blank[:-1])  # a text's ends are blank
    return change[::2] + 1, change[1::2]


def spoken(found: np.ndarray, starts: np.ndarray | None = None) -> int:
    """Words with a letter or digit, from a text's classes."""
    starts = word_ends(found)[0] if starts is None else starts
    return int(np.count_nonzero(np.logical_or.reduceat(SOUNDS[found], starts))) if len(starts) else 0


def nats(found: np.ndarray, own: np.ndarray, pooled: np.ndarray) -> float:
    """What a text costs by its language's model; blocks in another language go by that of all languages."""
    starts = np.arange(0, len(found), BLOCK)
    return -float(np.maximum(*(np.add.reduceat(m.take(found).astype(np.float64), starts) for m in (own, pooled))).sum())


def after_blank(model: np.ndarray) -> np.ndarray:
    """Log probabilities of each class after each other one and a blank."""
    return model.reshape(CLASSES, CLASSES, CLASSES)[:, 1].astype(np.float64)


def order_gain(found: np.ndarray, models: list[np.ndarray], ends: tuple | None = None) -> float:
    """What the order of a text's words gains by the better model: the mean log probability of a word's first class
    after the last class of the word before it, above its mean over all pairs of the text's words. Models are whole ones or
    what ``after_blank`` makes of them."""
    starts, stops = word_ends(found) if ends is None else ends
    last, first = found[stops[:-1]], found[starts[1:]]
    if not len(last):
        return 0.0
    of_last, of_first = (np.bincount(x, minlength=CLASSES) / len(x) for x in (last, first))
    return max(float(p[last, first].mean() - of_last @ p @ of_first) for p in (m if m.ndim == 2 else after_blank(m) for m in models))


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, entropy double, word_order double, digest string"


def measures(docs: DataFrame, model: dict, carry: bool = False) -> DataFrame:
    """doc_id, language and the MEASURES of every row: the counts of the base rules, the log
    perplexity, the gain by word order and the text's MD5. With ``carry``, all its columns in a struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "language", *[m.split()[0] for m in MEASURES.split(", ")], *["row"] * carry]
    known: dict = {}

    def of(lang):
        for name in (lang, POOLED):
            if name not in known and name in shared.value:
                whole = log_probabilities(shared.value[name])
                known[name] = whole, after_blank(whole)
        return list(zip(known.get(lang, known[POOLED]), known[POOLED]))

    def measured(lang, text, n_words, at):
        (whole, pairs), found = of(lang), classes(text)
        ends = word_ends(found)
        cost = nats(codes(found), *whole) / max(spoken(found, ends[0]), 1)
        return *_counts(text, n_words, at), cost, order_gain(found, pairs, ends), hashlib.md5(text).hexdigest()

    def run(batches):
        for batch in batches:
            rows = []
            langs = iter(batch.column(1).to_pylist())
            for part in portions(batch.column(2)):
                n, words = hashed_words(part)
                rows += [measured(next(langs), text, k, at) for text, k, at in zip(values(part), n.tolist(), may_repeat(n, words))]
            columns = list(zip(*rows)) or [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, *batch.columns[3:]], names=names)

    row = [F.struct(*columns_of(docs)).alias("row")] * carry
    given = docs.select(F.col("doc_id").cast("bigint"), language().alias("language"), text_bytes().alias("bytes"), *row)
    schema = StructType.fromDDL(f"doc_id bigint, language string, {MEASURES}")
    return given.mapInArrow(giving_back(run), schema.add("row", docs.schema) if carry else schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _closest_half(bins: pd.DataFrame) -> pd.DataFrame:
    """Centre and reach of the shortest stretch of bins that holds half of the documents; of several, the first."""
    bins = bins.sort_values("bin")
    at, n = bins["bin"].to_numpy(), bins["n"].to_numpy()
    upto = n.cumsum()
    end = np.searchsorted(upto, upto - n + (upto[-1] + 1) // 2)
    starts = np.flatnonzero(end < len(at))
    i = starts[np.argmin(at[end[starts]] - at[starts])]
    j = end[i]
    middle = at[np.searchsorted(upto, upto[i] - n[i] + (upto[j] - upto[i] + n[i]) / 2)]
    found = [(middle + 0.5) * BIN, (middle - at[i]) * BIN, (at[j] - middle) * BIN]
    return pd.DataFrame([[bins["language"].iloc[0], bins["measure"].iloc[0], *found]], columns=["language", "measure", "centre", "below", "above"])


def closest_halves(measured: DataFrame, *names: str) -> DataFrame:
    """(language, measure, centre, below, above) of some measures, from all documents that pass the base rules. Exact
    to a bin of BIN; a language has at most BINS bins for each measure, whatever the number of documents."""
    of = lambda m: F.struct(F.lit(m).alias("measure"), F.floor(F.least(F.greatest(m, F.lit(-BINS * BIN / 2)), F.lit(BINS * BIN / 2)) / BIN).alias("bin"))
    each = measured.where(~base_failed()).select("language", F.explode(F.array(*map(of, names))).alias("b"))
    bins = each.groupBy("language", F.col("b.measure").alias("measure"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("language", "measure").applyInPandas(
        _closest_half, "language string, measure string, centre double, below double, above double"
    )


def bands(measured: DataFrame, width: float = BAND_WIDTH, least: float = BAND_LEAST) -> DataFrame:
    """(language, median, below, above, order_median, order_below): centre and reach of the bands of log perplexity
    and word order."""
    one = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return closest_halves(measured, "entropy", "word_order").groupBy("language").agg(
        one("entropy", "centre").alias("median"),
        F.greatest(width * one("entropy", "below"), F.lit(least)).alias("below"),
        F.greatest(width * one("entropy", "above"), F.lit(least)).alias("above"),
        one("word_order", "centre").alias("order_median"),
        F.greatest(ORDER_WIDTH * one("word_order", "below"), F.lit(ORDER_LEAST)).alias("order_below"),
    )


def word_bands(measured: DataFrame) -> DataFrame:
    """(language, word_median, word_above): centre and upper reach of the band of log perplexity by word pairs."""
    return closest_halves(measured, "word_entropy").select(
        "language", F.col("centre").alias("word_median"), F.greatest(WORD_WIDTH * F.col("above"), F.lit(WORD_LEAST)).alias("word_above")
    )


def shortness() -> F.Column:
    """How much wider bands are for short texts."""
    return F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))


def judge(docs: DataFrame, carry: bool = False, width: float = BAND_WIDTH, block_words: int = BLOCK_WORDS, scored_words: int = SCORED_WORDS) -> DataFrame:
    """Counts of the base rules, ``kept``, perplexity by classes and by word pairs, gain by word order and the
    language's bands for every row. With ``carry``, also the row itself in a struct ``row``, but no perplexity by
    word pairs and no rows that it rejects.

    Kept rows pass the base rules and have perplexities and a gain within the bands. Null texts count
    as empty (no words, rejected); a null language is a language of its own; languages beyond the
    MAX_LANGUAGES with most text go by the model of all together, each with its own bands; repeated
    rows and rows with a null doc_id are judged like others. An empty table gives an empty result.
    """
    model = sorted_arrays(settle(kneser_ney(ngram_counts(docs)), "model"))
    words = settle_alone(word_entropy(docs, block_words=block_words, scored_words=scored_words), "word_entropy")
    measured = settle(measures(docs, model).join(words, "digest", "left"), "measured")
    found = settle(bands(measured, width).join(word_bands(measured), "language"), "bands")
    high = F.coalesce(F.col("word_entropy") > F.col("word_median") + shortness() * F.col("word_above"), F.lit(False))
    if carry:  # whole rows meet only the few texts that the band of word pairs rejects
        rejected = measured.join(found, "language").where(~base_failed() & high).select("language", "digest").distinct()
        rows = measures(docs, model, True).join(settle(rejected, "rejected"), ["language", "digest"], "left_anti").withColumn("word_entropy", F.lit(None).cast("double"))
    else:
        rows = measured
    inside = (
        (F.col("entropy") >= F.col("median") - shortness() * F.col("below")) & (F.col("entropy") <= F.col("median") + shortness() * F.col("above"))
        & (F.col("word_order") >= F.col("order_median") - shortness() * F.col("order_below")) & ~high
    )
    joined = rows.join(found, "language", "left").withColumn("base_failed", base_failed())
    return joined.select(
        "doc_id", *[m.split()[0] for m in MEASURES.split(", ")][:5], "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        "entropy", F.exp("entropy").alias("perplexity"), "median", "below", "above", "word_order", "order_median", "order_below",
        "word_entropy", F.exp("word_entropy").alias("word_perplexity"), "word_median", "word_above", "language", *["row"] * carry,
    )


def kept_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, scored_words: int = SCORED_WORDS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns: repeated rows as often as they come,
    rows with a null doc_id like others. Null and empty texts go; an empty table gives an empty result."""
    return judge(docs, carry=True, block_words=block_words, scored_words=scored_words).where("kept").select("row.*")
