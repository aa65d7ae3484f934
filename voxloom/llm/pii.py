"""Personal data by weak supervision.

Each text is scanned once for runs of digits and for signs of an address; only these are looked
at closely. Spans of the base patterns always stay. Wider patterns give candidates, on which
labelers vote: patterns and checksums, gazetteers, and the words around. Spark counts the votes
of all candidates of all documents; expectation-maximisation on those counts estimates how
reliable each labeler is, and its posteriors train the final span classifier, a logistic model
of votes and shape. A second scan adds the candidates it accepts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import columns_of, text_of, values

KINDS = ("email", "ip", "card", "phone")
TAGS = {k: f"[{k.upper()}]" for k in KINDS}

_RUN = re.compile(r"[0-9+][0-9 ().+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Wider patterns: written-out addresses, numbers in groups, numbers without a plus sign.
_WRITTEN = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?(?:\(at\)|\[at\]) ?([A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,8})", re.I)
_MARK = re.compile(r"\(at\)|\[at\]", re.I)
_GROUPS = re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9.-])")
_PLUS = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_FOURS = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])")
_QUADS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")
_NEAR = re.compile(r"[^\W\d_]+")

# Gazetteers.
DOMAINS = frozenset("com org net edu gov info io dev app eu uk de fr es it nl ch at be pl us ca au in jp br mx".split())
AREA_CODES = frozenset("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 81 82 86 90 91 351 353 358 380".split())
CUES = {
    "email": frozenset("mail email contact write courriel correo kontakt address".split()),
    "ip": frozenset("ip host server address adresse client login gateway".split()),
    "card": frozenset("card visa mastercard credit karte carte tarjeta account".split()),
    "phone": frozenset("phone call tel telephone mobile fax cell whatsapp telefon téléphone teléfono llame appelez".split()),
}
OTHER_CUES = frozenset("version isbn issn page pages no nr number id order item code chapter section ref year".split())
LABELERS = ("pattern", "check", "gazetteer", "cue", "other_cue", "apart")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> list[tuple[int, int]]:
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return found


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _numbers(text: str, start: int, end: int, found: dict) -> None:
    """Base spans within one run of digits and separators, which no match can leave."""
    for m in _IP.finditer(text, start, end):
        if _octets(m[0]):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text, start, end):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text, start, end):
        if 9 <= len(_digits(m[0])) <= 15:
            found["phone"].append(m.span())


def runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base patterns by kind: leftmost, not overlapping, failed checks dropped."""
    found: dict = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    for start, end in runs(text):
        if end - start >= 7:  # the shortest address and number
            _numbers(text, start, end, found)
    return found


def candidates(text: str, base: dict) -> list[tuple[str, int, int]]:
    """Spans of the wider patterns, at most one at each place, and the base spans."""
    found = [(k, *s) for k in KINDS for s in base[k]]
    wide = []
    if ("(" in text or "[" in text) and _MARK.search(text):
        wide += [("email", *m.span()) for m in _WRITTEN.finditer(text)]
    for start, end in runs(text):
        if end - start >= 7:
            lo = max(0, start - 1)  # an opening bracket belongs to it
            for kind, pattern in (("ip", _QUADS), ("card", _FOURS), ("phone", _PLUS), ("phone", _GROUPS)):
                wide += [(kind, *m.span()) for m in pattern.finditer(text, lo, end)]
    if wide:
        taken = bytearray(len(text))  # a mark for each place within a span, so that many spans cost no more each
        for _, a, b in found:
            taken[a:b] = b"\1" * (b - a)
        for kind, a, b in wide:
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                found.append((kind, a, b))
    return found


def votes(text: str, kind: str, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing."""
    span, digits = text[start:end], _digits(text[start:end])
    if kind == "email":
        check = 1 if "@" in span or "dot" in span.lower() else 0
        known = span.replace(" ", "").rstrip(")]").rpartition(".")[2].rpartition("]")[2].rpartition(")")[2].lower() in DOMAINS
    elif kind == "ip":
        check, known = (1 if _octets(span) else -1), not span.startswith(("0.", "1.0", "2.0"))
    elif kind == "card":
        check, known = (1 if 13 <= len(digits) <= 19 and luhn(digits) else -1), digits[:1] in "3456"
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        known = "+" in span and any(digits[:n] in AREA_CODES for n in (1, 2, 3))
    near = [w.lower() for w in _NEAR.findall(text[max(0, start - 40) : start])[-4:]]
    cue = any(w in CUES[kind] for w in near)
    before, after = text[start - 1 : start], text[end : end + 1]
    apart = not (before.isalnum() or before in "_$€£#=/" and before) and not (after.isalnum() or after in "_%=/" and after)
    return (
        1 if is_base else 0 if _PLUS.match(span) else -1, check, 1 if known else 0, 1 if cue else 0,
        -1 if any(w in OTHER_CUES for w in near) else 0, 1 if apart else -1,
    )


def features(kind: str, span: str, vote: tuple) -> tuple:
    """A candidate's votes and shape, of which there are few combinations."""
    return (kind, *vote, min(len(_digits(span)) // 3, 6), int(any(c in span for c in " -()")))


@dataclass
class SpanModel:
    """Reliability of each labeler by kind, and the classifier's probability by features."""

    reliability: dict
    weights: dict

    def probability(self, feature: tuple) -> float:
        w = self.weights.get(feature[0])
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(_inputs(feature) @ w, -30, 30))))


def _inputs(feature: tuple) -> np.ndarray:
    _, *vote, size, split = feature
    return np.array([1.0, *[v > 0 for v in vote], *[v < 0 for v in vote], size / 6, split], float)


def expectation_maximisation(vote: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Reliabilities of the labelers and the probability that each row of votes is personal.

    A labeler that votes is right with its own probability, whatever the others say. Starts from
    the majority; one pseudo-vote of reliability 0.7 keeps rare labelers from 0 and 1.
    """
    belief = 1 / (1 + np.exp(-2.0 * vote.sum(axis=1)))
    for _ in range(rounds):
        prior = np.clip((n @ belief + 1) / (n.sum() + 2), 0.01, 0.99)
        right = (n[:, None] * ((vote > 0) * belief[:, None] + (vote < 0) * (1 - belief[:, None]))).sum(axis=0)
        reliability = np.clip((right + 0.7) / ((n[:, None] * (vote != 0)).sum(axis=0) + 1), 0.5, 0.99)
        odds = np.log(prior / (1 - prior)) + vote @ np.log(reliability / (1 - reliability))
        belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return reliability, belief


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def train(docs: DataFrame) -> SpanModel:
    """A span model from the votes on all candidates of all documents.

    Candidates come to the driver as counts by kind, votes and shape: at most
    4 * 3**6 * 7 * 2 (40,824) rows, whatever the number of documents.
    """

    def run(batches):
        counts: dict[tuple, int] = {}
        for batch in batches:
            for text in values(batch.column(0)):
                if (base := base_spans(text)) and (found := candidates(text, base)):
                    inside = {(k, *s) for k in KINDS for s in base[k]}
                    for c in found:
                        f = features(c[0], text[c[1] : c[2]], votes(text, *c, c in inside))
                        counts[f] = counts.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([" ".join(map(str, f)) for f in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["feature", "n"],
        )

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "feature string, n bigint")
    rows = counted.groupBy("feature").agg(F.sum("n").alias("n")).orderBy("feature").collect()
    reliability, weights = {}, {}
    for kind in KINDS:
        of_kind = [(tuple([kind, *map(int, r.feature.split()[1:])]), r.n) for r in rows if r.feature.split()[0] == kind]
        if not of_kind:
            continue
        n = np.array([c for _, c in of_kind], float)
        vote = np.array([f[1 : 1 + len(LABELERS)] for f, _ in of_kind], float)
        right, belief = expectation_maximisation(vote, n)
        reliability[kind] = dict(zip(LABELERS, right.tolist()))
        weights[kind] = _fit(np.array([_inputs(f) for f, _ in of_kind]), belief, n)
    return SpanModel(reliability, weights)


def spans_of(text: str, model: SpanModel, least: float = 0.5) -> tuple[dict, dict]:
    """The base spans and all spans of a text, by kind, in order. Added spans overlap no other."""
    base = base_spans(text)
    every = {k: list(base[k]) for k in KINDS}
    found = candidates(text, base)
    for c in found[sum(map(len, base.values())) :]:
        kind, a, b = c
        if model.probability(features(kind, text[a:b], votes(text, kind, a, b, False))) >= least:
            every[kind].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def joined(found: dict) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in KINDS for a, b in found[k]])


def redacted(text: str, found: dict) -> str:
    """The text with a tag for each span; where spans overlap, their union gets the first one's tag."""
    parts, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in found[k]):
        if a >= at:
            parts += [text[at:a], TAGS[kind]]
        at = max(at, b)
    return "".join(parts) + text[at:]


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    The counts and the hash are of the base spans, ``spans`` has all as kind:start:end in code
    points, by kind and start. A null text is empty and has none. Repeated rows and rows with a
    null doc_id get rows of their own; other columns are ignored; an empty table gives no rows.
    """
    model = model or train(docs)

    def run(batches):
        for batch in batches:
            rows = []
            for text in values(batch.column(1)):
                base, every = spans_of(text, model)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, model: SpanModel | None = None, column: str = "text") -> DataFrame:
    """``docs`` with tags in place of all spans in ``column``.

    Null stays null, empty stays empty; rows stay as they are otherwise, repeated ones and those
    with a null doc_id too, whatever other columns there are. An empty table gives an empty result.
    """
    model = model or train(docs)

    # Rows travel as one struct: their columns may have any name.
    columns = [F.col(column).cast("string").alias(column) if n == column else c for c, n in zip(columns_of(docs), docs.columns)]
    given = docs.select(F.struct(*columns).alias("row"))

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            fields, i = list(rows.type), rows.type.get_field_index(column)
            parts = rows.flatten()
            parts[i] = pa.array([t if t is None else redacted(t, spans_of(t, model)[1]) for t in values(parts[i])], pa.string())
            fields[i] = pa.field(column, pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=fields)], names=["row"])

    return given.mapInArrow(run, given.schema).select("row.*")
