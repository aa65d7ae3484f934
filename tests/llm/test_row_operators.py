"""Operators on single documents and on whole-corpus counts, against plain versions."""

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxloom.llm import language_id, mixing, packing, pii, quality, token_counts, toxicity
from voxloom.llm.queries import tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, language string, row string, size string, salt string"
WORDS = "the a of and tion ing reed stone water house garden little river morning".split()


def made(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, made(rng, rng.choice([3, 60, 400])), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s10"])) for i in range(60)]
    out += [
        (100, None, "en", "s1"), (101, "", None, None), (102, " \n\t", "fr", None), (None, made(rng, 70), "en", "s2"),
        (103, "wörd " * 9000, "de", "s1"), (104, "x" * 50_000, "en", "s1"), (105, "1 2 3", "en", None), (106, None, None, None),
    ]
    return out + [out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, "l", "r", "s", "t") for r in rows], DOCS).repartition(3).cache()


# --- personal data -----------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(6000):
        t = "".join(rng.choice("0123456789.+- ()@ab.1.2.3-4 ") for _ in range(60))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("4111 1111 1111 1111", "a@b", "x.y@a-b.co.uk,é@q.r", "+1 (555) 555-0101.", "999.1.1.1 10.0.0.1.9", "1" * 60_000, "+" * 50_000, "@" * 50_000, "a." * 20_000 + "@"):
        assert pii.base_spans(t) == plain_spans(t) if len(t) < 1000 else pii.base_spans(t) is not None


def test_spans_over_documents(spark):
    rng = random.Random(5)
    texts = []
    for i in range(80):
        t = made(rng, 20)
        if i % 2:
            t += rng.choice([" mail an.bo@host.org now", " call +1 (555) 555-0123 please", " from 10.2.3.4 came", " card 4111 1111 1111 1111 ok"]) + made(rng, 5)
        texts.append(t)
    texts += [None, "", "tel +1 (269) 555-3296 452413226 end", "write to jo.hn (at) mail (dot) org today"]
    table = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[1]), (1, texts[1])], "doc_id bigint, text string")
    found = pii.find_spans(table).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        t = texts[1] if r.doc_id is None else texts[r.doc_id] or ""
        base = plain_spans(t)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        line = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    clean = [r for r in found if r.doc_id is not None and r.doc_id < 80 and r.doc_id % 2 == 0]
    assert all(r.spans == "" for r in clean)
    hidden = pii.redact(table).collect()
    assert len(hidden) == len(found) and not any("@" in (r.text or "") for r in hidden)
    assert [r.text for r in hidden if r.doc_id == 80] == [None]
    assert pii.find_spans(table.limit(0)).count() == 0


@pytest.mark.parametrize("mark", ["(at)", "(AT)", "[At]"])
def test_written_out_addresses_beside_a_plain_one(mark):
    hidden = f"JOHN {mark} EXAMPLE (DOT) COM"
    for text in (f"write {hidden} today", f"an.bo@host.org or {hidden} today"):
        at = text.index(hidden)
        assert ("email", at, at + len(hidden)) in pii.candidates(text, pii.base_spans(text))


def test_reliabilities_are_found():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.8, 0.65])
    vote = np.where(rng.random((4000, 3)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    rows, n = np.unique(vote, axis=0, return_counts=True)
    found, _ = pii.expectation_maximisation(rows.astype(float), n.astype(float))
    assert np.abs(found - right).max() < 0.06


# --- token counts and packing ------------------------------------------------

def test_histogram_answers_every_limit(docs, rows):
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    sums = token_counts.token_counts(docs, ranks, public_tokenizers.PATTERN)
    encode = token_counts.encoding(ranks, public_tokenizers.PATTERN).encode_ordinary
    lengths = sorted(len(encode(r[1] or "")) for r in rows)
    found = {r.length: r for r in sums.collect()}
    assert sorted(found) == sorted(set(lengths))
    for n, r in found.items():
        longer = [x for x in lengths if x > n]
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (lengths.count(n), len(longer), sum(longer))
        assert (r.truncated_tokens, r.total_tokens) == (sum(min(x, n) for x in lengths), sum(lengths))
    for limit in (0, 5, 100, 1000, 10**6):
        assert token_counts.truncated_total(sums, limit).first().tokens == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.length_quantile(sums, q).first().length == lengths[math.ceil(q * len(lengths)) - 1]
    assert token_counts.token_counts(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


ODD = ["İstanbul ΣΑΣ naïve", "it's don't 12ab__ x\xa0y", "a\x1cb", "<|endoftext|> hi", "éa", "中文 abc", "x\x7fy", "ÀÉß×÷ 'Sa", "a\x0bb \x85 c", "I'LL we'Re", ""]


def test_word_encoder_is_the_tokenizer(rows):
    path = tokenizer("word_bpe_49k.json")
    plain, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    for t in ODD + [r[1] or "" for r in rows]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [4096, 64])
def test_packing(docs, rows, limit):
    path = tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    found = packing.pack_documents(docs, path, limit=limit, with_ids=True).collect()
    expected = []
    for d, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = np.array(ids[at : at + limit], "<u4").tobytes()
            expected.append((d, k, at, len(part) // 4, zlib.crc32(part), part))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found], key=repr) == sorted(expected, key=repr)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    assert len(places) <= 1.1 * sum(e[3] for e in expected) / limit + 1
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_sum_of_squares_is_least_at_each_step():
    rng = random.Random(3)
    lengths = [rng.randint(1, 40) for _ in range(200)]
    bins, offsets = packing.sum_of_squares(lengths, 40)
    gaps = {}
    for s, b, o in zip(lengths, bins, offsets):
        def after(bin_):
            new = {**gaps, bin_: gaps.get(bin_, 40) - s}
            counts = [list(new.values()).count(g) for g in set(new.values()) if g]
            return sum(c * c for c in counts)
        fits = [x for x, g in gaps.items() if g >= s] + [len(gaps)]
        assert after(b) == min(map(after, fits))
        assert o == 40 - gaps.get(b, 40)
        gaps[b] = gaps.get(b, 40) - s


# --- mixing ------------------------------------------------------------------

def test_mix_by_source(docs, rows):
    found = mixing.mixed_sizes(docs)
    result = sorted(map(tuple, found.collect()), key=repr)
    assert result == sorted(map(tuple, mixing.mixed_sizes(docs.coalesce(1)).collect()), key=repr)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, _, s in rows:
        total[s] = total.get(s, 0) + size(t)
    weights = dict(zip(["s1", "s10", "s2", None], [3, 1, 2, 3]))
    wanted = mixing.targets(total, weights)
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(total.values()))
    by_target, largest = {}, max(size(r[1]) for r in rows)
    for d, n, source_size, target, taken, copies in result:
        assert taken in (0, n, 2 * n) and copies in (0, 1, 2)
        by_target.setdefault((source_size, target), []).append(taken)
    assert sorted(by_target) == sorted((total[s], wanted[s]) for s in total)
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= largest
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sorted(size(r.text) for r in mixed.collect()) == sorted(n for _, n, _, _, _, c in result for _ in range(c))


def test_a_mix_starts_no_python_workers(docs):
    # Rows given as a list would be read through Python workers, which then stand beside those of other stages.
    for found in (mixing.mixed_sizes(docs), mixing.mix_by_source(docs).ends):
        plan = found._jdf.queryExecution().toString()
        assert "LocalRelation" in plan and "ExistingRDD" not in plan


def plain_targets(sizes, weights, most=2.0):
    """Water level by bisection."""
    total = 1.5 * sum(sizes.values())
    low, high = 0.0, total + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * sizes[s], level * w) for s, w in weights.items()) < total:
            low = level
        else:
            high = level
    return {s: min(most * sizes[s], high * w) for s, w in weights.items()}


def test_targets_are_the_water_level():
    rng = random.Random(1)
    for n in (1, 3, 9):
        sizes = {f"s{i}": rng.randint(1, 1000) ** 2 for i in range(n)}
        weights = mixing.cyclic_weights(list(sizes))
        found = mixing.targets(sizes, weights)
        assert found == {s: pytest.approx(t, rel=1e-9) for s, t in plain_targets(sizes, weights).items()}


def test_flow_of_overlapping_sources(spark):
    capacity = {("a",): 100, ("a", "b"): 50, ("b",): 10, (): 7}
    flow = mixing.min_cost_flow(capacity, {"a": 120, "b": 60, "c": 5})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 120
    assert sum(v for (_, s), v in flow.items() if s == "b") == 60
    # 160 tokens once and only 20 again, wherever.
    assert sum(max(0, sum(v for (p, _), v in flow.items() if p == q) - capacity[q]) for q in capacity) == 20
    table = spark.createDataFrame([(i, "w " * 5, m) for i in range(40) for m in (["a"], ["a", "b"], ["b"], None)], "doc_id bigint, text string, m array<string>")
    found = mixing.mix(table, F.col("m"), F.lit(5), {"a": 300, "b": 350})
    given = [s for r in found.taken.collect() for s in r.taken_for]
    assert (5 * given.count("a"), 5 * given.count("b")) == (300, 350)


# --- quality -----------------------------------------------------------------

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    repeated = {w for w in windows if windows.count(w) > 1} if len(words) < 600 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in repeated for j in range(3)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)


@pytest.mark.parametrize("text", [
    None, "", "a b c", "a b c a b c", "é ü\n\n \né ü\né ü", "# $5 <b> a|b\x85c", "x\x1cy z", "l\nl\nl \n\tl\n \n ", "a b a b a b a b",
    "q w e " * 40, "one two three four one two three",
])
def test_base_counts(text):
    assert quality._counts((text or "").encode()) == plain_counts(text)


def plain_kneser_ney(counts, order):
    """Modified Kneser-Ney probabilities by dictionaries: {context + class: probability}."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    lower = {(): 1 / quality.CLASSES}
    out = {}
    for k in range(1, order + 1):
        n = [sum(c == i for c in tables[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0] + [max(0.1, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]
        total, left = {}, {}
        for g, c in tables[k].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            left[g[:-1]] = left.get(g[:-1], 0) + d[min(c, 3)]
        out[k] = {}
        for g, c in tables[k].items():
            below = out[k - 1][g[1:]] if k > 1 else lower[()]
            out[k][g] = max(c - d[min(c, 3)], 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * below
    return out


def test_language_model_is_kneser_ney(spark):
    rng = random.Random(2)
    texts = [made(rng, 30) for _ in range(12)]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    counts = {}
    for t in texts:
        c = quality.classes(t.encode()).tolist()
        for i in range(len(c) - 2):
            counts[tuple(c[i : i + 3])] = counts.get(tuple(c[i : i + 3]), 0) + 1
    expected = plain_kneser_ney(counts, 3)
    model = quality.sorted_arrays(quality.kneser_ney(quality.ngram_counts(table)))["en"]
    for k in (1, 2, 3):
        codes, logp, _ = model[k]
        own = ~np.isnan(logp)
        found = {tuple(int(c) >> 6 * (k - 1 - i) & 63 for i in range(k)): p for c, p in zip(codes[own], logp[own])}
        assert set(found) == set(expected[k])
        for g, p in found.items():
            assert math.exp(p) == pytest.approx(expected[k][g], rel=1e-4)
    every = np.exp(quality.log_probabilities(model).astype(float)).reshape(64, 64, 64)
    assert np.allclose(every.sum(axis=2), 1, atol=1e-3)


def test_judgement(docs, rows):
    found = quality.judge(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        n = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert quality.judge(docs.limit(0)).count() == 0


def test_strange_texts_are_rejected(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, made(rng, rng.randint(60, 200), words), "en") for i in range(300)]
    junk = [(1000 + i, made(rng, 120, words).upper().replace(" ", "!! "), "en") for i in range(6)]
    junk += [(1100 + i, " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in made(rng, 120, words).split()), "en") for i in range(6)]
    table = spark.createDataFrame(rows + junk, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in quality.judge(table).where("kept").collect()}
    assert not kept & {j[0] for j in junk}
    assert len(kept) >= 290


def sentences(rng, n, words):
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append(made(rng, rng.randint(5, 14), words).capitalize() + rng.choice([".", ".", "?"]))
    return " ".join(out)


def test_shuffled_words_are_rejected(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, sentences(rng, rng.randint(80, 300), words), "en") for i in range(300)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split()))), "en") for i, t, _ in rows[:60]]
    table = spark.createDataFrame(rows + mixed, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in quality.judge(table).where("kept").collect()}
    assert sum(i >= 1000 for i in kept) <= 6
    assert sum(i < 1000 for i in kept) >= 290


def plain_order_gain(found, model):
    """By the definition: every pair of words for the mean in random order."""
    runs = re.findall("[^ab]+", "".join(chr(97 + c) for c in found))
    p = model.reshape(64, 64, 64)
    cost = lambda u, v: float(p[ord(u[-1]) - 97, 1, ord(v[0]) - 97])
    there = [cost(u, v) for u, v in zip(runs, runs[1:])]
    every = [cost(u, v) for u in runs[:-1] for v in runs[1:]]
    return sum(there) / len(there) - sum(every) / len(every) if there else 0.0


@pytest.mark.parametrize("text", ["", "one", "  two words ", "A b. C d\n\ne f, G", "x " * 50, "é ü. Ñ 1 2 % $"])
def test_order_gain(text):
    models = [np.random.default_rng(k).normal(size=64**3).astype(np.float32) for k in (1, 2)]
    found = quality.classes(text.encode())
    assert quality.order_gain(found, models) == pytest.approx(max(plain_order_gain(found, m) for m in models), abs=1e-6)


def test_bands_do_not_follow_junk(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, sentences(rng, rng.randint(80, 300), words), "en") for i in range(200)]
    rows += [(1000 + i, "".join(rng.choice("#%$@!qxzQXZ0123456789 ") for _ in range(900)), "en") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in quality.judge(table).where("kept").collect()}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 190


@pytest.mark.parametrize("values", [[1.0], [1.0, 9.0], [0.0, 5.0, 5.004, 5.01, 9.0, 40.0], np.random.default_rng(3).normal(9, 1, 501).tolist()])
def test_closest_half(spark, values):
    table = spark.createDataFrame([("en", 99, 0, v, v) for v in values], "language string, n_words bigint, n_repeat_words bigint, entropy double, word_order double")
    found = quality.bands(table, width=1.0, least=0.0).collect()[0]
    bins = sorted(math.floor(v / quality.BIN) for v in values)
    half = (len(bins) + 1) // 2
    shortest = min(bins[i + half - 1] - bins[i] for i in range(len(bins) - half + 1))
    assert found.below + found.above == pytest.approx(shortest * quality.BIN)
    low, high = found["median"] - found.below, found["median"] + found.above
    assert sum(low - quality.BIN <= v <= high + quality.BIN for v in values) >= half


def test_any_number_of_languages(spark):
    rng = random.Random(12)
    rows = [(i, made(rng, 60), f"l{i % 230}") for i in range(460)] + [(1000 + i, made(rng, 80), "en") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2)
    found = quality.judge(table).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    assert all(r.kept for r in found if r.doc_id >= 1000) and {r.language for r in found} == {r[2] for r in rows}
    own = {r.language for r in quality.ngram_counts(table).select("language").distinct().collect()}
    assert len(own) == quality.MAX_LANGUAGES + 1 and "en" in own


# --- languages and toxicity --------------------------------------------------

def test_codewords_differ():
    for n in (1, 2, 3, 5, 6, 40):
        code = language_id.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code.tolist()}) == n


def test_languages(spark, docs, rows):
    rng = random.Random(8)
    own = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(200)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijklm"), ("cc", "ßüöärstu"))}
    table = spark.createDataFrame([(i, made(rng, 30, own[lang]), lang) for i, lang in enumerate(list(own) * 70)], "doc_id bigint, text string, lang string")
    found = language_id.identify_held_out(table).join(table, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found) and len(held) > 40
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    odd = language_id.identify_held_out(docs).collect()
    assert len(odd) == len(rows)
    for r in odd:
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in text or "")) and 0 <= r.score <= 1
    assert language_id.identify_held_out(docs.limit(0)).count() == 0
    unknown = language_id.identify_held_out(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(7)
    bad = ["grubnik", "zlotfass", "verdoop"]
    rows = []
    for i in range(1500):
        mean = i % 4 == 0
        words = made(rng, 40).split()
        if mean:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(mean)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows if r[0] % 5], "doc_id bigint, quality bigint, toxic bigint")
    return docs, labels, rows


def test_toxicity_held_out(toxic):
    docs, labels, rows = toxic
    found = {r.doc_id: r for r in toxicity.score_held_out(docs, labels).collect()}
    assert len(found) == len(rows)
    for i, _, mean in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert found[i].predicted == int(found[i].score >= 0.5) and 0 <= found[i].score <= 1
    held = [r for r in rows if found[r[0]].held_out]
    assert sum(found[i].predicted == mean for i, _, mean in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_say_nothing(toxic):
    docs, labels, _ = toxic
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.score_held_out(docs, x).collect())) for x in (labels, turned))
    assert one == two


def test_toxicity_of_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, toxic bigint")
    for known in (labels, labels.limit(0)):
        found = toxicity.score_held_out(docs, known).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_held_out(docs.limit(0), labels).count() == 0


def test_fractions_and_raised_digits_are_no_letters():
    for text in ("½ ²", "②", "12_3", "", "№"):
        assert bool(language_id._LETTER.search(text)) == any(unicodedata.category(c)[0] == "L" for c in text)
    assert all(language_id._LETTER.search(text) for text in ("½ a", "ª", "語", "ǅ"))
