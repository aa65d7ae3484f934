"""Extra columns of any name and type, and texts with very many spans, in all stages."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import mixing, pii, quality, simhash


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(90)) + f" mail a{i}@b.com." for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), {"k": i}, i, [{"x": "y"}], i, "r", "w") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None, None, None, None)] * 2
    rows += [(50, None, "en", "s0", 0, {}, 1, [], 1, "", ""), (51, "", "en", "s0", 0, {}, 1, [], 1, "", "")]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, tags map<string,bigint>, `a.b` bigint,"
        " deep array<map<string,string>>, `row` bigint, language string, `odd, col` string",
    )


def test_stages_keep_strange_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, None)
        assert found.columns == odd.columns, name
        assert [f.dataType for f in found.schema] == [f.dataType for f in odd.schema], name
        assert found.count() > 0
        assert stage(spark, odd.limit(0), None).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, None).where("piece = 0").count() == odd.count()


def test_operators_agree_without_strange_columns(odd):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for run in (quality.kept_documents, simhash.one_of_each, pii.redact):
        key = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
        assert key(run(odd)) == key(run(plain))
    taken = mixing.mixed_sizes(odd).agg(F.count("*"), F.sum("taken")).first()
    assert taken[0] == odd.count() and taken[1] == mixing.mixed_documents(odd).agg(F.sum(mixing.word_count())).first()[0]


def plain_candidates(text, base, wide):
    taken = [s for k in pii.KINDS for s in base[k]]
    out = []
    for kind, a, b in wide:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


def test_candidates_overlap_nothing():
    rng = random.Random(9)
    parts = ["+1 555 123 4567", "10.1.2.3", "4111 1111 1111 1111", "555-123-4567", "a (at) b (dot) com", "x@y.org", "1.2.3.4.5", "99", "-"]
    for _ in range(200):
        text = "".join(rng.choice(parts) + rng.choice([" ", ", ", " w ", ""]) for _ in range(rng.randint(1, 25)))
        base = pii.base_spans(text)
        found = pii.candidates(text, base)
        added = found[sum(map(len, base.values())) :]
        assert plain_candidates(text, base, added) == added
        every = {k: [] for k in pii.KINDS}
        wide = pii.candidates(text, every)  # without base spans, all that any wider pattern gives first
        assert all(any(x < b and a < y for _, x, y in found) for _, a, b in wide)


def test_many_spans_in_one_text():
    text = "".join(f"call {i % 900 + 100}-555-{i % 9000 + 1000}, " for i in range(60_000))
    start = time.monotonic()
    assert len(pii.candidates(text, pii.base_spans(text))) == 60_000
    assert time.monotonic() - start < 20


def plain_flow(capacity, quotas, repeats):
    """Tokens and cost of a min-cost flow by cheapest paths, one after the other, over all arcs."""
    arcs, nodes = [], {"from", "to"}
    for p, n in capacity.items():
        arcs += [["from", p, n, r] for r in range(repeats)] + [[p, s, repeats * n, 0] for s in p if s in quotas]
        nodes |= {p, *[s for s in p if s in quotas]}
    arcs += [[s, "to", q, 0] for s, q in quotas.items()]
    residual = [x for a, b, c, k in arcs for x in ([a, b, c, k], [b, a, 0, -k])]
    nodes |= set(quotas)
    flow = cost = 0
    while True:
        far, via = {n: float("inf") for n in nodes}, {}
        far["from"] = 0
        for _ in nodes:
            for i, (a, b, c, k) in enumerate(residual):
                if c and far[a] + k < far[b]:
                    far[b], via[b] = far[a] + k, i
        if "to" not in via:
            return flow, cost
        path, x = [], "to"
        while x != "from":
            path.append(via[x])
            x = residual[via[x]][0]
        amount = min(residual[i][2] for i in path)
        for i in path:
            residual[i][2] -= amount
            residual[i ^ 1][2] += amount
        flow, cost = flow + amount, cost + amount * far["to"]


def test_flow_is_largest_and_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        sources = ["a", "b", "c", None][: rng.randint(1, 4)]
        capacity = {tuple(s for s in sources if rng.random() < 0.6): rng.randint(0, 20) for _ in range(4)}
        quotas = {s: rng.randint(0, 30) for s in sources}
        repeats = rng.randint(1, 3)
        found = mixing.min_cost_flow(capacity, quotas, repeats)
        given = {p: sum(n for (q, _), n in found.items() if q == p) for p in capacity}
        assert all(n <= repeats * capacity[p] for p, n in given.items())
        assert all(sum(n for (_, t), n in found.items() if t == s) <= quotas[s] for s in quotas)
        cost = sum(max(0, n - r * capacity[p]) for p, n in given.items() for r in range(1, repeats))
        assert (sum(given.values()), cost) == plain_flow(capacity, quotas, repeats)


def test_many_sets_of_sources():
    rng = random.Random(5)
    names = [f"s{i}" for i in range(40)]
    capacity = {tuple(sorted(rng.sample(names, rng.randint(1, 8)))): rng.randint(1, 10**6) for _ in range(50_000)}
    total = sum(capacity.values())
    start = time.monotonic()
    found = mixing.min_cost_flow(capacity, {s: int(1.5 * total * rng.random() / 20) for s in names})
    assert found and time.monotonic() - start < 60
