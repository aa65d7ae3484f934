import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxloom.llm import common, quality, word_model


def words_of(text):
    return ["", *re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def plain_discounts(counts):
    n = [sum(c == i for c in counts) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
    return [0.0] + [max(0.1, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]


def plain_entropies(texts):
    """By dictionaries: for each text the counts of all others are made anew, discounts are those of all."""
    def counted(some):
        counts = {}
        for t in some:
            for pair in zip(words_of(t), words_of(t)[1:]):
                counts[pair] = counts.get(pair, 0) + 1
        return counts

    def befores(counts):
        out = {}
        for _, w in counts:
            out[w] = out.get(w, 0) + 1
        return out

    every = counted(texts)
    d, met = plain_discounts(every.values()), befores(every)
    e = plain_discounts(met.values())
    left = sum(e[min(n, 3)] for n in met.values())
    out = {}
    for i, text in enumerate(texts):
        words = words_of(text)
        if len(words) == 1:
            continue
        others = counted(texts[:i] + texts[i + 1 :])
        before, total, saved = befores(others), {}, {}
        for (v, _), n in others.items():
            total[v] = total.get(v, 0) + n
            saved[v] = saved.get(v, 0) + d[min(n, 3)]
        nats = 0.0
        for v, w in zip(words, words[1:]):
            n, m = others.get((v, w), 0), before.get(w, 0)
            p = (max(m - e[min(m, 3)], 0) + left / (len(met) + 1)) / len(every)
            if total.get(v):
                p = (max(n - d[min(n, 3)], 0) + saved[v] * p) / total[v]
            nats -= math.log(p)
        out[hashlib.md5(text.encode()).hexdigest()] = nats / (len(words) - 1)
    return out


def some_texts(rng, n):
    words = ["".join(rng.choice("abcdéñ") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    return [" ".join(rng.choices(words, range(60, 0, -1), k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("block, hot, parts", [(4_000_000, 1000, 3), (60, 5, 2), (1, 0, 1)])
def test_against_dictionaries(spark, monkeypatch, block, hot, parts):
    monkeypatch.setattr(word_model, "HOT_WORDS", hot)
    rng = random.Random(4)
    texts = [*some_texts(rng, 50), "one", "one", "x\x1cy z  \n\tlast\x85", "a a a a a a a a", "only here only here"]
    texts += [texts[0], texts[1], texts[1]]
    table = spark.createDataFrame([(t,) for t in [*texts, None, "", " \n"]], "text string").repartition(parts)
    table = spark.createDataFrame(table.collect(), table.schema).coalesce(parts)
    found = {r.digest: r.word_entropy for r in word_model.word_entropy(table, ranges=16, block_words=block, scored_words=30).collect()}
    expected = plain_entropies(texts)
    assert set(found) == set(expected)
    for digest, value in expected.items():
        assert found[digest] == pytest.approx(value, rel=1e-9)


def test_no_texts(spark):
    empty = spark.createDataFrame([], "text string")
    assert word_model.word_entropy(empty).count() == 0
    assert word_model.word_entropy(spark.createDataFrame([(None,), ("",)], "text string")).count() == 0


@pytest.mark.parametrize("numbers", [[], [7], [0, 1, 1, 255, 256, 2**31, 2**32 - 1]])
def test_packing(numbers):
    for kind in (np.uint32, np.int64):
        given = np.array(numbers, kind)
        assert word_model.unpack(word_model.pack(given), kind).tolist() == numbers


def test_words_of_no_other_text_are_rejected(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    made = lambda n, some: " ".join(rng.choices(some, range(len(some), 0, -1), k=n))
    rows = [(i, made(rng.randint(60, 200), words), "en") for i in range(300)]
    letters = "".join(words)
    for i in range(20):  # letters as often as in the others, words of its own
        own = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(150)]
        rows.append((1000 + i, made(120, own), "en"))
    found = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 290


def test_copies_are_kept(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, range(400, 0, -1), k=rng.randint(60, 200))) for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate(texts + [t for t in texts[:4] for _ in range(5)])]
    found = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    copied = [r for r in found if r.doc_id < 4 or r.doc_id >= 200]
    assert all(r.word_entropy < r.word_median - r.word_above and r.kept for r in copied)
    assert sum(r.kept for r in found) >= 215


def test_portions_change_no_kept_row(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, range(400, 0, -1), k=rng.randint(40, 200))) for _ in range(60)]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").coalesce(1)
    whole = sorted(quality.kept_documents(table).collect())
    assert len(whole) > 40
    assert sorted(quality.kept_documents(table, block_words=300, scored_words=40).collect()) == whole


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    steps = []
    monkeypatch.setattr(common, "give_back", lambda: steps.append("back"))

    def run(batches):
        for batch in batches:
            yield batch
        steps.append("end")

    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert steps == ["end", "back"]
    monkeypatch.undo()
    common.give_back()


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])


def test_short_words_are_hashed_without_a_call_for_each(monkeypatch):
    rng = random.Random(2)
    short = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(50)).encode() for _ in range(40)]
    called = []
    plain = word_model.xxhash.xxh32_intdigest
    monkeypatch.setattr(word_model.xxhash, "xxh32_intdigest", lambda word: called.append(bytes(word)) or plain(word))
    assert len(list(word_model.blocks([batch_of([*short, b"here 0123456789abcdef"])], 1000))) == 3
    assert called == [b"0123456789abcdef"]


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_word_hashes(kind):
    rng = random.Random(3)
    word = lambda n: bytes(rng.choice([c for c in range(1, 256) if not bytes([c]).isspace()]) for _ in range(n))
    texts = [b"", b" ", b"x", b" \t\v\fa  b\r\n", *(b" ".join(word(n) for _ in range(3)) for n in range(1, 40)), b"\xff\xfe\x00 \x1c\x85 y"]
    for given in (texts, texts[:2], texts[7:8]):
        n, hashes = word_model.hashed_words(pa.array([b"before", *given], kind)[1:])
        assert n.tolist() == [len(t.split()) for t in given]
        assert hashes.tolist() == [word_model.word_hash(w) for t in given for w in t.split()]


@pytest.mark.parametrize("bits", [20, 62])
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_distinct(bits, n):
    numbers = np.random.default_rng(n).integers(0, 300, n).astype(np.uint64) << np.uint64(bits - 9)
    found, which = word_model.distinct(numbers, bits)
    assert found.tolist() == sorted(set(numbers.tolist())) and found[which].tolist() == numbers.tolist()


def test_blocks_do_not_depend_on_portions(monkeypatch):
    texts = [t.encode() for t in some_texts(random.Random(6), 60)] + [b"", b" ", b"last"]
    found = []
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(common, "PORTION_BYTES", size)
        assert b"".join(t for part in common.portions(batch_of(texts).column(0)) for t in part.to_pylist()) == b"".join(texts)
        blocks = list(word_model.blocks([batch_of(texts[:25]), batch_of(texts[25:])], 100))
        assert sum(len(b.digests) for b in blocks) == len(texts) - 2
        found.append([(b.name, b.lengths.tolist(), b.words.tolist()) for b in blocks])
    assert found[0] == found[1] == found[2]
    size, ends = 0, []
    for t in filter(bytes.strip, texts):
        size += len(t.split())
        if size >= 100:
            ends, size = [*ends, size], 0
    assert [sum(lengths) for _, lengths, _ in found[0]] == ends + [size] * (size > 0)


@pytest.mark.parametrize("alike", [False, True])
def test_repeated_windows_by_hashes(alike):
    """With words that all share a hash every window may come twice; the count stays that of the words."""
    rng = random.Random(8)
    texts = ["", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z w x y z", *(" ".join(rng.choices("abcdefgh", k=k)) for k in range(40))]
    texts = [t.encode() for t in texts]
    n, words = word_model.hashed_words(pa.array(texts, pa.binary()))
    places = list(quality.may_repeat(n, np.ones_like(words) if alike else words))
    for text, k, at in zip(texts, n.tolist(), places, strict=True):
        windows = list(zip(*(text.split()[i:] for i in range(3))))
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert quality._counts(text, k, at) == quality._counts(text)
        assert quality._counts(text)[4] == len(covered)
        assert alike or [i for i, w in enumerate(windows) if windows.count(w) > 1] == at.tolist()
