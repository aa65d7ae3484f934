"""How surprising a text's words are: a modified Kneser-Ney model of word pairs.

Spark counts the word pairs of all texts, hashed to 64 bits (32 for each word). Pairs are dealt to
hash ranges by their first word, each range is a sorted array of pair hashes with counts beside it,
and words are looked up there by the texts, not the model sent to the texts: what is gathered grows
with the input, and no task or driver holds all of it.

Texts are taken in blocks. A block asks each range once for its distinct pairs, which also is how
they are counted, and gets their counts and those of their first words back. Each text is judged by
the model of all other rows: its own counts are taken off, as a text that is in the model would
never be a surprise. A word's lower-order probability is that of the number of different words
before it; a word never met elsewhere has a share of what the discounts leave.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import give_back, giving_back, hashed_share, portions, settle, text_bytes, values

# Words of the texts that are taken together, and the distinct ones among them.
BLOCK_WORDS = 4_500_000
# Words that are scored at once: of whole texts, so one at least.
SCORED_WORDS = 500_000
# Ranges of pair hashes, at least; a session with more shuffle partitions has as many ranges. Four ranges to one of words.
RANGES = 64
# The most frequent words of a sample of about HOT_ROWS texts: the pairs they start are dealt over all ranges.
# This changes only who counts what, never a result.
HOT_WORDS, HOT_ROWS = 1000, 20_000
START = 0  # stands before a text's first word

ROW = "kind string, block string, slot int, a binary, b binary, c binary, d binary, e binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 5]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


def table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], names=NAMES)


def row(kind: str, block: str = "", slot: int = 0, *parts: bytes) -> tuple:
    return (kind, block, slot, *parts, *[None] * (5 - len(parts)))


def word_hash(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) or 1


PRIMES = [np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]


def _mixed(hashes: np.ndarray, added: np.ndarray, bits: int, prime: np.uint32) -> np.ndarray:
    hashes = hashes + added
    return (hashes << np.uint32(bits) | hashes >> np.uint32(32 - bits)) * prime


def word_hashes(words: pa.Array) -> np.ndarray:
    """``word_hash`` of each word, those below 16 bytes at once, length by length: XXH32 takes them by 4 bytes, then by single ones."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    fours = np.ndarray((max(len(raw) - 3, 0),), "<u4", raw.data, strides=(1,)) if len(raw) > 3 else None
    lengths = np.minimum(np.diff(ends), 16).astype(np.uint8)
    order = np.argsort(lengths, kind="stable")
    upto = np.cumsum(np.bincount(lengths, minlength=17))
    out = np.empty(len(words), np.uint32)
    for n in range(16):
        at = order[upto[n - 1] if n else 0 : upto[n]]
        starts = ends[:-1][at]
        found = np.full(len(at), PRIMES[4] + np.uint32(n), np.uint32)
        for i in range(n // 4 * len(at[:1])):
            found = _mixed(found, fours[starts + 4 * i] * PRIMES[2], 17, PRIMES[3])
        for i in range(n // 4 * 4, n * len(at[:1])):
            found = _mixed(found, raw[starts + i].astype(np.uint32) * PRIMES[4], 11, PRIMES[0])
        for bits, prime in ((15, PRIMES[1]), (13, PRIMES[2])):
            found = (found ^ found >> np.uint32(bits)) * prime
        out[at] = found ^ found >> np.uint32(16)
    data = memoryview(raw)
    for i in order[upto[15] :].tolist():
        out[i] = xxhash.xxh32_intdigest(data[ends[i] : ends[i + 1]])
    return np.maximum(out, 1)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the hashes of all their words, one text after another."""
    texts = texts.cast(pa.binary())
    plain = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)  # only ASCII signs are looked at
    parts = pc.ascii_split_whitespace(plain)
    words = parts.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(there.to_numpy(zero_copy_only=False))))
    ends = parts.offsets.to_numpy()
    return np.diff(upto[ends - ends[0]]), word_hashes(words.filter(there))


def run_starts(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where each number starts in sorted ones."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(sorted_numbers), 1), bool), sorted_numbers[1:] != sorted_numbers[:-1])))


def distinct(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ones of some numbers below 2 ** ``bits``, and which of them each number is. Numbers are sorted
    with their places behind them where both fit in 64 bits."""
    places = len(numbers).bit_length()
    if bits + places > 64:
        return np.unique(numbers, return_inverse=True)
    both = numbers.astype(np.uint64) << np.uint64(places) | np.arange(len(numbers), dtype=np.uint64)
    both.sort()
    place = (both & np.uint64((1 << places) - 1)).astype(np.int64)
    both >>= np.uint64(places)
    starts = run_starts(both)
    which = np.empty(len(numbers), np.uint32)
    which[place] = np.repeat(np.arange(len(starts), dtype=np.uint32), np.diff(starts, append=len(both)))
    return both[starts].astype(numbers.dtype), which


def spread(hashes: np.ndarray, slots: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(slots)


def by_slot(slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by slot that keeps the order within, and where each slot starts in it."""
    order = np.argsort(slot.astype(np.uint16 if slots <= 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(slot[order], np.arange(slots + 1, dtype=np.uint64))


def pair_slots(pairs: np.ndarray, hot: np.ndarray, ranges: int) -> np.ndarray:
    """The ranges of sorted pairs."""
    first = pairs >> np.uint64(32)
    starts = run_starts(first)
    n = np.diff(starts, append=len(first))
    first = first[starts]
    return np.where(np.repeat(among(first, hot), n), spread(pairs ^ pairs >> np.uint64(29), ranges), np.repeat(spread(first, ranges), n))


class Block:
    """Some texts: their digests, numbers of words, and the hashes of their words."""

    def __init__(self, digests: list[bytes], lengths: np.ndarray, words: np.ndarray):
        self.digests, self.lengths, self.words = digests, lengths, words
        self.name = hashlib.md5(b"".join(digests)).hexdigest()

    def pairs(self) -> np.ndarray:
        """The hash of each word and the one before it."""
        return after(self.words, self.lengths, 32)

    def packed(self) -> tuple[bytes, ...]:
        return *pack_words(self.words), pack(self.lengths), b"".join(self.digests)


def after(words: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Each word number, with that of the word before it, or START, in higher bits."""
    out = words.astype(np.uint64)
    before = np.concatenate((np.zeros(min(len(out), 1), np.uint64), out[:-1]))
    starts = np.cumsum(lengths) - lengths
    before[starts[lengths > 0]] = START
    before <<= np.uint64(bits)
    out |= before
    return out


def renumbered(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and the hash of each so that frequent words have small numbers and equally frequent ones go by hash."""
    order = np.lexsort((hashes, -np.bincount(ids, minlength=len(hashes))))
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    return number[ids], hashes[order]


def pack_words(words: np.ndarray) -> tuple[bytes, bytes]:
    hashes, ids = distinct(words, 32)
    ids, hashes = renumbered(ids, hashes)
    return pack(steps(hashes)), pack(ids)


def unpack_words(hashes: bytes, ids: bytes) -> np.ndarray:
    return np.cumsum(unpack(hashes, np.uint32), dtype=np.uint32)[unpack(ids, np.uint32)]


def blocks(batches, block_words: int):
    """Blocks of the texts of a task, in their order; texts of no words are left out."""
    digests, lengths, words, size = [], [], [], 0
    for batch in batches:
        for part in portions(batch.column(0)):
            n, hashes = hashed_words(part)
            own = [hashlib.md5(text).digest() for text, k in zip(values(part), n.tolist()) if k]
            n = n[n > 0]
            upto = np.cumsum(n)
            start = 0
            while start < len(n):
                done = upto[start] - n[start]
                stop = min(int(np.searchsorted(upto, done + block_words - size)) + 1, len(n))
                digests += own[start:stop]
                lengths.append(n[start:stop])
                words.append(hashes[done : upto[stop - 1]])
                size += int(upto[stop - 1] - done)
                if size >= block_words:
                    yield Block(digests, np.concatenate(lengths), np.concatenate(words))
                    digests, lengths, words, size = [], [], [], 0
                start = stop
    if digests:
        yield Block(digests, np.concatenate(lengths), np.concatenate(words))


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the HOT_WORDS words that come most often in a sample, and of START."""
    texts = docs.select(text_bytes().alias("text"))
    sample = texts.where(hashed_share(F.col("text"), HOT_ROWS, docs.count())).select(
        F.explode(F.split(F.col("text").cast("string"), "[\\x20\\x09-\\x0D]+")).alias("word")
    )
    most = sample.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(HOT_WORDS)
    return np.unique(np.array([START, *[word_hash(r.word.encode()) for r in most.collect()]], np.uint64))


def among(numbers: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which numbers are among some sorted ones."""
    if not len(those):
        return np.zeros(len(numbers), bool)
    return those[np.minimum(np.searchsorted(those, numbers), len(those) - 1)] == numbers


def _ask(hot: np.ndarray, ranges: int, block_words: int):
    """For each block and range, the block's distinct pairs there with counts; likewise its words."""
    word_slots = ranges // 4

    def run(batches):
        for block in blocks(batches, block_words):
            pairs, n = np.unique(block.pairs(), return_counts=True)
            order, ends = by_slot(pair_slots(pairs, hot, ranges), ranges)
            rows = []
            for slot in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                at = order[ends[slot] : ends[slot + 1]]
                first, second = (pairs[at] >> np.uint64(32)).astype(np.uint32), pairs[at].astype(np.uint32)
                rows.append(row("pairs", block.name, slot, pack(steps(first)), *pack_words(second), pack(n[at])))
            words = np.sort(block.words)
            words = words[run_starts(words)]
            order, ends = by_slot(spread(words, word_slots), word_slots)
            for slot in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                rows.append(row("words", block.name, slot, pack(steps(words[order[ends[slot] : ends[slot + 1]]]))))
            del pairs, n
            yield from table(rows).to_batches()

    return run


def totals(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted first words: each one, and (total, pairs met once, twice, more often)."""
    starts = run_starts(first)
    words = first[starts]
    met = [counts, counts == 1, counts == 2, counts > 2]
    return words, np.stack([np.add.reduceat(m.astype(np.int64), starts) for m in met]) if len(words) else np.zeros((4, 0), np.int64)


def times_met(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3 and 4, how many there are, and their sum."""
    return np.array([*((counts == i).sum() for i in (1, 2, 3, 4)), len(counts), counts.sum()], np.int64)


def _count_range(hot: np.ndarray, ranges: int):
    """A range: the sorted array of its pairs with counts. Answers go to the blocks that asked; for each
    word the number of words before it goes on to the ranges of words."""
    word_slots = ranges // 4

    def run(key, group):
        if key[0].as_py() == "words":
            return group
        slot, names = key[1].as_py(), group.column("block").to_pylist()
        asked = []
        for a, b, c in zip(*(group.column(x) for x in "abc")):
            first = np.cumsum(unpack(a.as_py(), np.uint32), dtype=np.uint32).astype(np.uint64)
            asked.append(first << np.uint64(32) | unpack_words(b.as_py(), c.as_py()))
        pairs = np.sort(np.concatenate(asked))
        pairs = pairs[run_starts(pairs)]
        counts = np.zeros(len(pairs), np.int64)
        asked = [np.searchsorted(pairs, own).astype(np.uint32 if len(pairs) < 1 << 32 else np.int64) for own in asked]
        for own, n in zip(asked, group.column("d")):
            counts[own] += unpack(n.as_py(), np.int64)  # a block's pairs are distinct
        firsts = pairs >> np.uint64(32)
        words, of_word = totals(firsts, counts)
        hot_words = among(words, hot)
        of_words = np.diff(run_starts(firsts), append=len(firsts))
        often, number = np.repeat(hot_words, of_words), np.repeat(np.arange(len(words), dtype=np.uint32), of_words)
        rows = [row("met", "", slot, times_met(counts).tobytes())]
        for name, own in zip(names, asked):
            told = number[own]
            told = told[run_starts(told)]
            told = told[~hot_words[told]]
            rows.append(row("counts", name, slot, pack(counts[own]), *(pack(x[told]) for x in of_word)))
        for kind, these, numbers in (
            ("before", *(lambda w, k: (w, [k]))(*np.unique(pairs.astype(np.uint32), return_counts=True))),
            ("hot", *(lambda w, k: (w, list(k)))(*totals(firsts[often], counts[often]))),
        ):
            order, ends = by_slot(spread(these, word_slots), word_slots)
            for i in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                at = order[ends[i] : ends[i + 1]]
                rows.append(row(kind, "", i, pack(these[at].astype(np.uint32)), *(pack(x[at].astype(np.int64)) for x in numbers)))
        return table(rows)

    return run


def _count_words(key, group):
    """A range of words: how many different words come before each, told to the blocks that asked; and
    the totals of the frequent first words."""
    slot, kinds = key[0].as_py(), np.array(group.column("kind").to_pylist())
    part = lambda kind: group.filter(pa.array(kinds == kind))
    numbers = lambda t, c, k: np.concatenate([np.zeros(0, k), *(unpack(x.as_py(), k) for x in t.column(c))])
    rows = []
    before, often = part("before"), part("hot")
    words, at = np.unique(numbers(before, "a", np.uint32), return_inverse=True)
    n = np.bincount(at, weights=numbers(before, "b", np.int64), minlength=len(words)).astype(np.int64)
    rows.append(row("met_before", "", slot, times_met(n).tobytes()))
    if len(often):
        first, at = np.unique(numbers(often, "a", np.uint32), return_inverse=True)
        sums = [np.bincount(at, weights=numbers(often, c, np.int64), minlength=len(first)).astype(np.int64) for c in "bcde"]
        rows.append(row("hot", "", slot, first.tobytes(), *(x.tobytes() for x in sums)))
    asks = part("words")
    for name, a in zip(asks.column("block").to_pylist(), asks.column("a")):
        own = np.cumsum(unpack(a.as_py(), np.uint32), dtype=np.uint32)
        rows.append(row("befores", name, slot, pack(n[np.searchsorted(words, own)])))
    return table(rows)


def discounts(met: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more."""
    n = [0, *met[:4].tolist()]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
    return np.array([0.0, *(max(0.1, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3))])


def left_over(met: np.ndarray) -> float:
    """The sum of all discounts."""
    return float(met[:2] @ discounts(met)[1:3] + (met[4] - met[0] - met[1]) * discounts(met)[3])


def surprise(lengths, which, counts, first, of_first, word, befores, met, met_before) -> np.ndarray:
    """The mean of -log p of each text's words, by the model of all other rows.

    ``which`` are the numbers of the texts' pairs, one text after another; ``counts``, ``first`` and ``word`` tell the
    count of each pair and the numbers of its words in ``of_first`` and ``befores``.
    """
    d, e = discounts(met), discounts(met_before)
    less = lambda n, by: by[np.minimum(n, 3)]
    text = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    bits = len(counts).bit_length()
    both, own = np.unique(text << bits | which, return_counts=True)
    text, at = both >> bits, both & ((1 << bits) - 1)
    others = counts[at] - own
    first = first[at]
    starts = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (first[1:] != first[:-1])])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))
    left = less(np.arange(1, 4), d) @ of_first[1:][:, first[starts]] - np.add.reduceat(less(counts[at], d) - less(others, d), starts)
    total = of_first[0][first[starts]] - np.add.reduceat(own, starts)
    word = word[at]
    before = befores[word]
    bits = len(befores).bit_length()
    alone = others == 0  # pairs of no other row
    _, of_text = distinct(text << bits | word, bits + len(lengths).bit_length())
    before -= np.bincount(of_text, weights=alone).astype(np.int64)[of_text]
    shorter = (np.maximum(before - less(before, e), 0) + left_over(met_before) / (met_before[4] + 1)) / met_before[5]
    p = np.where(total[of] > 0, (np.maximum(others - less(others, d), 0) + left[of] * shorter) / np.maximum(total[of], 1), shorter)
    return -np.bincount(text, weights=own * np.log(np.maximum(p, 1e-300)), minlength=len(lengths)) / lengths


def _judge(hot: np.ndarray, ranges: int, scored_words: int, hot_words: np.ndarray, hot_totals: np.ndarray, met: np.ndarray, met_before: np.ndarray):
    word_slots = ranges // 4

    def run(group):
        found = judged(group)
        give_back()
        return found

    def judged(group):
        rows = {kind: [] for kind in ("texts", "counts", "befores")}
        for r in group.to_pylist():
            rows[r["kind"]].append(r)
        if not rows["texts"] or not rows["counts"]:
            raise RuntimeError("the texts came in other blocks when read again; write them to a table first")
        texts = rows["texts"][0]
        digests, lengths = [texts["d"][i : i + 16] for i in range(0, len(texts["d"]), 16)], unpack(texts["c"], np.int64)
        hashes, ids = np.cumsum(unpack(texts["a"], np.uint32), dtype=np.uint32), unpack(texts["b"], np.uint32)
        order = np.argsort(hashes)
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        words, bits = hashes[order], len(order).bit_length()  # START, then the words by their hashes
        if len(rows["texts"]) > 1:  # blocks of the same texts ask alike, and are told the same
            rows["counts"] = list({r["slot"]: r for r in rows["counts"]}.values())
            rows["befores"] = list({r["slot"]: r for r in rows["befores"]}.values())
        pairs, which = distinct(after(number[ids], lengths, bits), 2 * bits)
        first, word = (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64) - 1
        hashes = np.concatenate((np.array([START], np.uint64), words.astype(np.uint64)))
        del ids, pairs
        order, _ = by_slot(pair_slots(hashes[first] << np.uint64(32) | hashes[word + 1], hot, ranges), ranges)
        told = sorted(rows["counts"], key=lambda r: r["slot"])
        counts = np.empty(len(first), np.int64)
        counts[order] = np.concatenate([unpack(r["a"], np.int64) for r in told])
        starts = run_starts(first)
        all_firsts = hashes[first[starts]]
        first = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(first)))
        seldom = ~among(all_firsts, hot)
        firsts = all_firsts[seldom]
        by, _ = by_slot(spread(firsts, ranges), ranges)
        of_first = np.zeros((4, len(all_firsts)), np.int64)
        for i, c in enumerate("bcde"):
            of_first[i, np.flatnonzero(seldom)[by]] = np.concatenate([unpack(r[c], np.int64) for r in told])
        of_first[:, ~seldom] = hot_totals[:, np.searchsorted(hot_words, all_firsts[~seldom])]
        order, _ = by_slot(spread(words, word_slots), word_slots)
        befores = np.empty(len(words), np.int64)
        befores[order] = np.concatenate([unpack(r["a"], np.int64) for r in sorted(rows["befores"], key=lambda r: r["slot"])])
        del rows, told
        upto = np.cumsum(lengths)
        ends = [0, *np.searchsorted(upto, np.arange(scored_words, upto[-1], scored_words)).tolist(), len(upto)]
        found = np.concatenate([
            surprise(lengths[a:b], which[upto[a] - lengths[a] : upto[b - 1]], counts, first, of_first, word, befores, met, met_before)
            for a, b in zip(ends, ends[1:]) if b > a
        ])
        return pa.table({"digest": pa.array([x.hex() for x in digests], pa.string()), "word_entropy": found})

    return run


def settle_alone(df: DataFrame, name: str) -> DataFrame:
    """``df`` settled; the files its shuffles left are removed when it is written, not some time later."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, None)
    conf.set(setting, "true")
    try:
        return settle(df, name)
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)


def word_entropy(docs: DataFrame, ranges: int | None = None, block_words: int = BLOCK_WORDS, scored_words: int = SCORED_WORDS) -> DataFrame:
    """(digest, word_entropy): for each different text with a word its MD5, lowercase hex, and the mean
    of -log p of its words by a modified Kneser-Ney model of the word pairs of all other rows.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no row; copies of a text count for
    each other and have one row. An empty table gives an empty result. ``docs`` is read twice and must give the same
    rows in the same order, as a table does.
    """
    spark = docs.sparkSession
    ranges = ranges or max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = frequent_words(docs)
    texts = docs.select(text_bytes().alias("text"))
    asked = texts.mapInArrow(giving_back(_ask(hot, ranges, block_words)), ROW)
    counted = settle_alone(asked.groupBy("kind", "slot").applyInArrow(_count_range(hot, ranges), ROW), "pairs")
    words = counted.where(F.col("kind").isin("before", "words", "hot")).groupBy("slot").applyInArrow(_count_words, ROW)
    words = settle_alone(words, "words")
    read = lambda t, kind: [r.a for r in t.where(F.col("kind") == kind).select("a").collect()]
    met, met_before = (
        sum((np.frombuffer(a, np.int64) for a in read(t, kind)), np.zeros(6, np.int64))
        for t, kind in ((counted, "met"), (words, "met_before"))
    )
    often = words.where("kind = 'hot'").collect()
    hot_words = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r.a, np.uint32) for r in often)]).astype(np.uint64)
    hot_totals = np.concatenate([np.zeros((4, 0), np.int64), *(np.stack([np.frombuffer(r[c], np.int64) for c in "bcde"]) for r in often)], axis=1)
    by = np.argsort(hot_words)

    def again(batches):
        for block in blocks(batches, block_words):
            yield from table([row("texts", block.name, 0, *block.packed())]).to_batches()

    told = counted.where("kind = 'counts'").unionAll(words.where("kind = 'befores'")).unionAll(texts.mapInArrow(giving_back(again), ROW))
    judged = told.groupBy("block").applyInArrow(_judge(hot, ranges, scored_words, hot_words[by], hot_totals[:, by], met, met_before), "digest string, word_entropy double")
    return judged.groupBy("digest").agg(F.max("word_entropy").alias("word_entropy"))
