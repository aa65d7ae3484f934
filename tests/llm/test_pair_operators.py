"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from voxloom.llm import embedding_dedup, simhash


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    """The smallest node each node reaches, over all pairs."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if least[b] < least[a] and linked(a, b):
                    least[a], changed = least[b], True
    return least


def texts(rng, n):
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and out:
            base = out[rng.randrange(len(out))].split(" ")
            if kind < 0.2:
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 300]))))
    return out


def test_fingerprints_are_the_plain_ones():
    odd = [None, "", " \t", "One", "one TWO", "É é Ü \x85 x\x1cy", "a b c", "a b c d\ne\x0bf", "x " * 5000]
    for t in odd + texts(random.Random(1), 60):
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t), t


@pytest.mark.parametrize("tile", [4096, 3])
@pytest.mark.parametrize("radius", [0, 2, 5])
def test_components_are_those_of_all_pairs(spark, tile, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(150):
        v = values[rng.randrange(len(values))]
        for _ in range(rng.choice([1, 2, 3, 6])):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r.node: r.component for r in simhash.components(simhash.links(distinct, radius, tile), "a", "b").collect()}
    expected = plain_components(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= radius)
    assert {v: found.get(v, v) for v in signed} == expected


def chained(rng, n):
    """Fingerprints with the same upper 32 bits, most of them a bit or two from an earlier one."""
    out = [0xABCD_0123 << 32 | v for v in (0x10001, 0x40008, 0x100008, 0x110000)]
    while len(out) < n:
        v = rng.choice(out)
        for _ in range(rng.choice([1, 2, 2, 2, 9])):
            v ^= 1 << rng.randrange(32)
        out.append(v)
    return np.array(sorted(set(out)), np.uint64)


def named_by_least(nodes, linked):
    """The smallest node each node reaches, by a matrix of links."""
    names = np.array(nodes)
    while True:
        least = np.minimum(names, np.where(linked, names[None, :], names.max()).min(axis=1))
        if (least == names).all():
            return dict(zip(nodes, names.tolist()))
        names = least


def parts_of(edges, nodes):
    forest = simhash.Forest()
    for a, b in edges:
        forest.join(a, b)
    return {v: forest.root(v) for v in nodes}


@pytest.mark.parametrize("seed", range(6))
def test_large_groups_of_one_key(seed):
    rng = random.Random(seed)
    made = chained(rng, 400)
    near = np.bitwise_count(made[:, None] ^ made[None, :]) <= 2
    nodes = made.tolist()
    assert parts_of(simhash._edges_of_large(made, made, 2), nodes) == named_by_least(nodes, near)
    side = np.array([rng.random() < 0.5 for _ in nodes])
    across = near & (side[:, None] != side[None, :])
    assert parts_of(simhash._edges_of_large(made[side], made[~side], 2), nodes) == named_by_least(nodes, across)


@pytest.mark.parametrize("tile", [4096, 100])
def test_components_of_a_large_key(spark, tile):
    rng = random.Random(11)
    made = chained(rng, 500)
    nodes = made.view(np.int64).tolist()
    expected = named_by_least(nodes, np.bitwise_count(made[:, None] ^ made[None, :]) <= 2)
    distinct = spark.createDataFrame([(v,) for v in nodes], "fp bigint")
    found = {r.node: r.component for r in simhash.components(simhash.links(distinct, 2, tile), "a", "b").collect()}
    assert {v: found.get(v, v) for v in nodes} == expected


def test_the_smallest_label_is_joined():
    few = [0x10001, 0x40008, 0x100008, 0x110000]
    rng = random.Random(0)
    made = np.array([0xABCD_0123 << 32 | v for v in few + [rng.getrandbits(32) for _ in range(60)]], np.uint64)
    near = np.bitwise_count(made[:, None] ^ made[None, :]) <= 2
    assert parts_of(simhash._edges_of_large(made, made, 2), made.tolist()) == named_by_least(made.tolist(), near)


def test_simhash_over_documents(spark):
    given = texts(random.Random(4), 150)
    docs = [(i * 3, t, "x", 1.5) for i, t in enumerate(given)] + [(7, None, "x", 0.0), (8, "", "x", 0.0), (None, given[5], "x", 0.0), (27, given[9], "y", 0.0), (27, given[9], "y", 0.0)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, fp string, component double").repartition(3)
    found = simhash.near_duplicates(table).collect()
    prints = {d: plain_fingerprint(t) for d, t, _, _ in docs if d is not None}
    least = plain_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    expected = [(d, f"{plain_fingerprint(t):016x}", least[5 * 3 if d is None else d]) for d, t, _, _ in docs]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({least[d] for d in prints})
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_one_row_of_each_component_with_repeated_and_null_ids(spark):
    rng = random.Random(21)
    far = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(6)]
    docs = [
        (5, far[0], "a"), (5, far[1], "b"), (9, far[1], "c"),  # an id of two texts
        (None, far[2], "d"), (None, far[2], "d"), (None, far[2], "d"), (None, far[0], "e"),  # copies without an id
        (None, far[3], "f"), (12, far[4], "g"), (12, far[4], "g"), (None, None, "h"), (None, "", "h"), (7, far[5], "i"),
    ]
    found = []
    for parts in (1, 5):
        table = spark.createDataFrame(docs[:: 1 if parts == 1 else -1], "doc_id bigint, text string, fp string").repartition(parts)
        found.append(sorted(map(tuple, simhash.one_of_each(table).collect()), key=repr))
    assert found[0] == found[1]
    assert [r for r in found[0] if r[2] != "h"] == sorted([docs[i] for i in (0, 1, 3, 7, 8, 12)], key=repr)
    assert len(found[0]) == 7


def vectors(rng, n, dim=16):
    out = [rng.normal(size=dim)]
    while len(out) < n:
        base = out[rng.integers(len(out))]
        out.append(rng.normal(size=dim) if rng.random() < 0.5 else base + rng.normal(size=dim) * rng.choice([0.02, 0.08]))
    return out


@pytest.mark.parametrize("tile", [2048, 7])
def test_embedding_links_are_those_of_all_pairs(spark, tile):
    made = vectors(np.random.default_rng(3), 300)
    rows = [(i, [float(np.float32(x)) for x in v], "label") for i, v in enumerate(made)]
    rows += [(400, None, ""), (401, [0.0] * 16, ""), (402, [float("nan")] * 16, ""), (403, [None] * 16, ""), (404, [1.0], ""), (405, [], "")]
    rows += [(406, rows[0][1], ""), (406, rows[0][1], ""), (407, [float("inf")] + [1.0] * 15, ""), (-5, rows[1][1], "")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node string")
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    cosine = lambda x, y: x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)
    links = [sum(k != j and cosine(v, w) >= 0.95 for k, (_, w) in enumerate(good)) for j, (_, v) in enumerate(good)]
    at = {i: v for i, v in good}
    least = plain_components(sorted(at), lambda a, b: cosine(at[a], at[b]) >= 0.95)
    expected = [(i, n, least[i], least[i] == i) for (i, _), n in zip(good, links)]
    expected += [(i, 0, i, True) for i, *_ in rows if i not in at]
    found = sorted(map(tuple, embedding_dedup.near_duplicates(table, tile=tile).collect()))
    missed = sum(n for _, n, _, _ in expected) - sum(n for _, n, _, _ in found)
    assert 0 <= missed <= 0.02 * sum(links)
    if not missed:
        assert found == sorted(expected)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_dedup.near_duplicates(table).count() == 0
    odd = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(odd).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, False)]


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(1)
    u, v = rng.random(9), rng.random(7)
    found = embedding_dedup.traverse(u, v, np.argsort(u), np.argsort(v), 0.7)
    sums = {a * 7 + b: u[a] + v[b] for a in range(9) for b in range(7)}
    limit = min(sums.values()) + 0.7
    assert [sums[c] for c in found] == sorted(s for s in sums.values() if s <= limit)
