"""Removal of repeated byte strings with suffix arrays.

A string of LENGTH bytes that starts in an earlier document, too, is removed wherever it comes
again. No task can sort the suffixes of a whole corpus, so strings that may be equal are first
brought together:

1. In each window of LENGTH bytes the smallest hash of its KMER-byte parts is its anchor. Equal
   windows have equal anchors, and neighbouring windows mostly share one. Anchors that are met in
   two documents or more are found by hash.
2. Runs of windows that share such an anchor are cut out as pieces. Equal pieces are added up in
   each task: only the earliest document's piece goes on, the others are removed as they are.
3. Pieces with the same anchor meet in one task. There a suffix array of all its pieces is built by
   two-stage sorting: suffixes that are smaller than their successors are sorted directly, the
   others follow from these by scanning the buckets of first bytes. Neighbours in it with a common
   prefix of LENGTH bytes are repeats.

Anchors that are met very often have their pieces cut into single windows, each of which goes by
its own hash; so no task gets all of them.
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

from voxloom.llm.common import give_back, giving_back, settle, text_bytes, values

LENGTH = 50
KMER = 16
# Windows in a piece at most, bytes looked at or sorted at once, and text for each bucket.
RUN, CHUNK, SORTED, BUCKET = 64, 1 << 20, 1 << 21, 12 << 20
# Text whose pieces a task holds at once, and pieces held at once; frequent anchors make many of little text.
PORTION, HELD = 16 << 20, 1 << 20
# Text whose anchors are put in order at once.
MET = 40 << 20
# An anchor is frequent from so many pieces on, or from one of so many anchors of the corpus if that is more.
FREQUENT, ONE_OF = 20_000, 1_000_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# --- arrays as bytes ---------------------------------------------------------

def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _steps(values: np.ndarray) -> bytes:
    """Numbers by their differences, which take less room where neighbours are alike."""
    return _packed(np.diff(values, prepend=np.zeros(1, values.dtype)))


def _summed(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(_unpacked(raw, kind), dtype=kind)


# --- windows and anchors -----------------------------------------------------

def _anchors(raw: np.ndarray) -> np.ndarray:
    """The anchor of each window of LENGTH bytes that starts in ``raw``."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    span = 1
    while span < KMER:  # hashes of 1, 2, 4 ... bytes
        h = h[:-span] * _ODD[span.bit_length()] + h[span:]
        span *= 2
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    width, span = LENGTH - KMER + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: -(width - span)], h[width - span :]) if width > span else h


def _slices(texts: list[bytes]):
    """Groups of (document, offset, bytes) of about CHUNK bytes; long texts are cut, so that each
    window is whole in just one slice."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def runs(texts: list[bytes]):
    """(document, first window, last window, anchor) of all runs of windows with one anchor, as arrays."""
    for group in _slices(texts):
        raw = np.frombuffer(b"".join([p for _, _, p in group]), np.uint8)
        lengths = np.array([len(p) for _, _, p in group])
        starts = np.cumsum(lengths) - lengths
        found = _anchors(raw)
        at = np.arange(len(found))
        part = np.repeat(np.arange(len(group)), lengths)[: len(found)]
        inside = at + LENGTH <= (starts + lengths)[part]
        at, part, found = at[inside], part[inside], found[inside]
        offset = at - starts[part]
        new = np.ones(len(at), bool)
        new[1:] = (part[1:] != part[:-1]) | (found[1:] != found[:-1])
        begin = np.flatnonzero(new)
        into = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        new |= into % RUN == 0
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        document = np.array([i for i, _, _ in group])[part[begin]]
        base = np.array([a for _, a, _ in group])[part[begin]]
        yield document, base + offset[begin], base + offset[end], found[begin]


def _codes(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of an anchor."""
    return (anchor >> np.uint64(33)) % np.uint64(buckets) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)


# --- anchors of several documents --------------------------------------------

EMPTY = np.zeros(0, np.int64)
_MET = "bucket int, document bigint, anchors binary, documents binary, several binary"
_REPEATED = "document bigint, code bigint, frequent boolean"


def _by_document(documents: np.ndarray, codes: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(documents, kind="stable")
    documents, codes = documents[order], codes[order]
    begin = np.flatnonzero(np.append(True, documents[1:] != documents[:-1])) if len(documents) else EMPTY
    return [(int(documents[b]), codes[b:e].tobytes()) for b, e in zip(begin, np.append(begin[1:], len(documents)))]


def _meet(batches, buckets: int):
    """Anchors of each batch by bucket, one entry for each, with the number of its documents here;
    and for documents that share an anchor already here, which these are."""
    for batch in _portions(batches, 1, MET):
        ids = np.array(batch.column(0).to_pylist(), np.int64)
        found = [(ids[i], _codes(a, buckets)) for i, _, _, a in runs(batch.column(1).to_pylist())]
        if not found:
            continue
        document, code = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.lexsort((document, code))
        document = document[order]
        code = code[order]
        del order
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        end = np.append(begin[1:], len(code))
        several = document[begin] != document[end - 1]
        count = np.where(several, np.ceil(np.log2(end - begin)), 0).astype(np.uint8)
        bucket = (code[begin] >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[b], cut[b + 1])
            rows.append((b, None, _steps(code[begin[own]].astype(np.uint32)), _packed(document[begin[own]]), _packed(count[own])))
        shared = np.repeat(several, end - begin)
        for d, codes in _by_document(document[shared], code[shared]):
            rows.append((d % buckets, d, codes, None, None))
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_SCHEMA)


_NAMES = [x.split()[0] for x in _MET.split(", ")]
_SCHEMA = pa.schema(list(zip(_NAMES, [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])))


def _repeated(table, frequent: int):
    """Which anchors of a bucket are met in several documents: a row for each anchor and document."""
    bucket = table.column("bucket")[0].as_py()
    told, codes, anchors, documents, counts = [], [], [], [], []
    for d, a, packed, several in zip(*(table.column(c).to_pylist() for c in _NAMES[1:])):
        if d is not None:
            codes.append(np.frombuffer(a, np.uint64))
            told.append(np.full(len(codes[-1]), d, np.int64))
        else:
            anchors.append(_summed(a, np.uint32))
            documents.append(_unpacked(packed, np.int64))
            counts.append(_unpacked(several, np.uint8))
    hot = np.zeros(0, np.uint64)
    if anchors:
        anchor, document, count = (np.concatenate(x) for x in (anchors, documents, counts))
        order = np.argsort(anchor, kind="stable")
        anchor, document, count = anchor[order], document[order], count[order]
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        low, high = np.minimum.reduceat(document, begin), np.maximum.reduceat(document, begin)
        many = (low != high) | (np.maximum.reduceat(count, begin) > 0)
        times = np.add.reduceat(np.exp2(count.astype(float)), begin)
        again = np.repeat(many, np.diff(np.append(begin, len(anchor)))) & (count == 0)
        code = np.uint64(bucket) << np.uint64(32) | anchor.astype(np.uint64)
        told.append(document[again])
        codes.append(code[again])
        hot = code[begin][times >= frequent]
    document, code = np.concatenate([EMPTY, *told]), np.concatenate([hot[:0], *codes])
    return pa.table({
        "document": pa.array(np.append(document, np.zeros(len(hot), np.int64)), mask=np.arange(len(document) + len(hot)) >= len(document)),
        "code": np.append(code, hot).view(np.int64),
        "frequent": np.arange(len(document) + len(hot)) >= len(document),
    })


# --- pieces ------------------------------------------------------------------

_PIECES = "bucket int, texts binary, lengths binary, anchors binary, documents binary, members binary, rows binary, starts binary, covers binary"
_COVERS = "document bigint, row bigint, first bigint, after bigint"


def _portions(batches, column: int = 2, most: int | None = None):
    """The rows of the batches with about ``most`` bytes of text at a time, PORTION if not given."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // (most or PORTION)
        begin = np.flatnonzero(np.append(True, size[1:] != size[:-1])) if len(size) else []
        for a, b in zip(begin, np.append(begin[1:], len(size))):
            yield batch.slice(int(a), int(b - a))


def _wanted_runs(texts: list[bytes], wanted: list[np.ndarray], often: np.ndarray, buckets: int):
    """(text, place, size, anchor code, single) of the pieces of each slice; runs of a frequent anchor are single windows."""
    for document, first, last, anchor in runs(texts):
        code = _codes(anchor, buckets)
        hit = np.zeros(len(code), bool)
        cut = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
        for b, e in zip(cut.tolist(), np.append(cut[1:], len(document)).tolist()):
            known = wanted[document[b]]
            if len(known):
                hit[b:e] = known[np.minimum(np.searchsorted(known, code[b:e]), len(known) - 1)] == code[b:e]
        document, first, last, code = document[hit], first[hit], last[hit], code[hit]
        single = np.isin(code, often)
        times = np.where(single, last - first + 1, 1)
        run = np.repeat(np.arange(len(code)), times)
        into = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        size = np.where(single, 0, last - first) + LENGTH
        yield document[run].astype(np.int32), (first[run] + into).astype(np.int32), size[run].astype(np.uint8), code[run], single[run]


def _pieces(batches, buckets: int, often: np.ndarray):
    """Pieces of each portion by bucket. Of equal pieces the earliest document's goes on; the others
    are covered as they are."""
    for batch in _portions(batches):
        ids, keys = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
        texts, copies = (batch.column(i).to_pylist() for i in (2, 4))
        copied = [k in c for k, c in zip(keys.tolist(), copies)]
        whole = [(d, k, 0, len(t)) for d, k, t, c in zip(ids.tolist(), keys.tolist(), texts, copied) if c]
        texts = [b"" if c else t for t, c in zip(texts, copied)]
        wanted = [np.unique(c.values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in batch.column(3)]
        yield from _whole_covers(np.array(whole, np.int64).reshape(-1, 4), buckets)
        raw = b"".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(lengths) - lengths
        held, count = [], 0
        for found in _wanted_runs(texts, wanted, often, buckets):
            held.append(list(found))
            count += len(found[0])
            if count >= HELD:
                yield from _by_bucket(raw, base, ids, keys, held, buckets)
                held, count = [], 0
        if count:
            yield from _by_bucket(raw, base, ids, keys, held, buckets)


def _by_bucket(raw: bytes, base: np.ndarray, ids: np.ndarray, keys: np.ndarray, held: list, buckets: int):
    """Rows of _PIECES for pieces as ``_wanted_runs`` gives them, of texts that start in ``raw`` at ``base``."""
    text, start, size, code, single = (np.concatenate([x.pop(0) for x in held]) for _ in range(5))
    at = base[text] + start
    digest = _digests(raw, at, size)
    heads, piece = _equal(raw, at, size, digest, single)
    low = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(low, piece, ids[text])
    anchor = np.where(single, digest, code * _ODD[0])[heads]
    later = ids[text] > low[piece]
    covers = np.stack((ids[text[later]], keys[text[later]], start[later], start[later] + size[later].astype(np.int64)), axis=1)
    own = np.flatnonzero(~later)
    own = own[np.argsort(piece[own], kind="stable")]
    member = piece[own]
    ends = np.searchsorted(member, np.arange(len(heads) + 1))
    for b, chosen in _split((anchor >> np.uint64(20)).astype(np.int64) % buckets):
        times = ends[chosen + 1] - ends[chosen]
        take = np.repeat(ends[chosen] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        yield pa.RecordBatch.from_pylist([{
            "bucket": b, "texts": _joined_texts(raw, at[heads[chosen]], size[heads[chosen]]),
            "lengths": _packed(size[heads[chosen]]),
            "anchors": _packed(anchor[chosen].astype(np.uint16)), "documents": _steps(low[chosen]),
            "members": _steps(np.repeat(np.arange(len(chosen), dtype=np.int32), times)),
            "rows": _packed(keys[text[own[take]]]), "starts": _packed(start[own[take]].astype(np.int64)), "covers": None,
        }], schema=_PIECES_SCHEMA)
    yield from _whole_covers(_joined(covers), buckets)


def _whole_covers(covers: np.ndarray, buckets: int):
    """Rows of _PIECES for covers that are known already."""
    for lines in np.array_split(covers, 1 + len(covers) // 50_000):
        if len(lines):
            yield pa.RecordBatch.from_pylist([{"bucket": int(lines[0, 1] % buckets), "covers": _packed(lines)}], schema=_PIECES_SCHEMA)


# --- equal pieces --------------------------------------------------------------

# Pieces are told apart by place and size within one string of bytes: an object for each would take several times its text.
AT_ONCE = 1 << 16


def _cuts(raw: bytes, at: np.ndarray, size: np.ndarray):
    """The pieces one by one."""
    for i in range(0, len(at), AT_ONCE):
        for a, n in zip(at[i : i + AT_ONCE].tolist(), size[i : i + AT_ONCE].tolist()):
            yield raw[a : a + n]


def _digests(raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, _cuts(raw, at, size)), np.uint64, len(at))


def _equal(raw: bytes, at: np.ndarray, size: np.ndarray, digest: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal pieces of one kind, and for each piece the number of its set.

    Pieces are compared with the first one of their digest, byte by byte. One that has only the digest in common stays by itself.
    """
    order = np.lexsort((kind, digest))
    new = np.append(True, (digest[order[1:]] != digest[order[:-1]]) | (kind[order[1:]] != kind[order[:-1]]))[: len(order)]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.flatnonzero(~new)
    pairs = zip(_cuts(raw, at[order[again]], size[order[again]]), _cuts(raw, at[head[again]], size[head[again]]))
    other = again[np.fromiter((a != b for a, b in pairs), bool, len(again))]
    head[other] = order[other]
    first = np.empty(len(order), np.int64)
    first[order] = head
    heads = np.flatnonzero(first == np.arange(len(first)))
    number = np.empty(len(first), np.int32)
    number[heads] = np.arange(len(heads))
    return heads, number[first]


def _joined_texts(raw: bytes, at: np.ndarray, size: np.ndarray) -> bytes:
    """The pieces one after another, compressed."""
    to = zstandard.ZstdCompressor(level=3).compressobj(size=int(size.sum(dtype=np.int64)))
    out = [to.compress(b"".join(_cuts(raw, at[i : i + AT_ONCE], size[i : i + AT_ONCE]))) for i in range(0, len(at), AT_ONCE)]
    return b"".join([*out, to.flush()])


_PIECE_COLUMNS = [x.split()[0] for x in _PIECES.split(", ")[1:]]
_PIECES_SCHEMA = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in _PIECE_COLUMNS])


def _split(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    begin = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
    for b, e in zip(begin, np.append(begin[1:], len(order))):
        yield int(bucket[order[b]]), order[b:e]


def _joined(covers: np.ndarray) -> np.ndarray:
    """(document, row, first, after) with overlapping and touching covers of a row joined."""
    if not len(covers):
        return covers.reshape(0, 4)
    covers = covers[np.lexsort((covers[:, 2], covers[:, 1], covers[:, 0]))]
    new = np.ones(len(covers), bool)
    # Ends are running maxima within a row: covers of one row are shifted apart first.
    row = np.cumsum(np.append(True, (covers[1:, :2] != covers[:-1, :2]).any(axis=1))) - 1
    far = int(covers[:, 3].max()) + 1
    reach = np.maximum.accumulate(covers[:, 3] + row * far)
    new[1:] = covers[1:, 2] + row[1:] * far > reach[:-1]
    begin = np.flatnonzero(new)
    out = covers[begin]
    out[:, 3] = reach[np.append(begin[1:], len(covers)) - 1] - row[begin] * far
    return out


# --- suffix arrays -----------------------------------------------------------

def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros past the end."""
    padded = np.concatenate((raw, np.zeros(LENGTH + 16, np.uint8)))
    out = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= padded[i : i + len(out)]
    return out


def smaller_than_next(raw: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors: the next other byte is larger."""
    n = len(raw)
    change = np.flatnonzero(np.append(raw[1:] != raw[:-1], True))  # last place of each run of a byte
    rises = np.append(raw[change[:-1] + 1] > raw[change[:-1]], False)
    return np.repeat(rises, np.diff(np.append(-1, change)))[:n]


def sort_directly(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``at`` in the order of the first LENGTH bytes or more from each place."""
    order = np.argsort(words[at], kind="stable")
    at = at[order]
    key = words[at]
    group = np.cumsum(np.append(True, key[1:] != key[:-1]))
    open_ = np.arange(len(at))
    for depth in range(8, LENGTH, 8):
        own = group[open_]
        same = np.zeros(len(open_), bool)
        tie = own[1:] == own[:-1]
        same[1:] |= tie
        same[:-1] |= tie
        open_ = open_[same]
        if not len(open_):
            break
        own, key = group[open_], words[at[open_] + depth]
        order = np.lexsort((key, own))
        at[open_] = at[open_][order]
        key = key[order]
        new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
        group[open_] = np.cumsum(new)
    return at


def suffix_array(raw: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Places of ``raw`` in the order of their suffixes, as far as LENGTH bytes tell them apart.

    Two stages: the suffixes smaller than their successors are sorted directly. The others are
    induced: going up through the buckets of first bytes, each finished suffix puts the one before
    it, if that is larger, at the end of what is filled of its bucket.
    """
    n = len(raw)
    if n == 0:
        return EMPTY
    words = words_at(raw) if words is None else words
    small = smaller_than_next(raw)
    sorted_ = sort_directly(np.flatnonzero(small), words)
    ends = np.cumsum(np.bincount(raw[sorted_], minlength=256))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[raw[n - 1]].append(np.array([n - 1]))  # comes before the end of the text
    out = []
    for byte in range(256):
        parts = waiting[byte]
        current = np.concatenate(parts) if parts else EMPTY
        filled = [current]
        while len(current):  # runs of this byte
            before = current[current > 0] - 1
            current = before[(raw[before] == byte) & ~small[before]]
            filled.append(current)
        filled.append(sorted_[ends[byte - 1] if byte else 0 : ends[byte]])
        bucket = np.concatenate(filled)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = raw[before]
        keep = ~small[before] & (first > byte)
        before, first = before[keep], first[keep]
        order = np.argsort(first, kind="stable")
        before = before[order]
        cut = np.cumsum(np.bincount(first, minlength=256))
        for b in np.flatnonzero(np.diff(cut, prepend=0)).tolist():
            waiting[b].append(before[(cut[b - 1] if b else 0) : cut[b]])
    return np.concatenate(out)


def common_prefix(suffixes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which neighbours in the order have a common prefix of LENGTH bytes."""
    same = np.zeros(max(len(suffixes) - 1, 0), bool)
    open_ = np.arange(len(same))
    for depth in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        open_ = open_[words[suffixes[open_] + depth] == words[suffixes[open_ + 1] + depth]]
    same[open_] = True
    return same


def repeats(parts: list[bytes], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of each window whose bytes also come in a part of an earlier document."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    words = words_at(raw)
    lengths = np.array([len(p) for p in parts])
    part = np.repeat(np.arange(len(parts)), lengths)
    offset = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = offset + LENGTH <= lengths[part]
    order = suffix_array(raw, words)
    order = order[whole[order]]
    if not len(order):
        return EMPTY, EMPTY
    begin = np.flatnonzero(np.append(True, ~common_prefix(order, words)))
    own = documents[part[order]]
    least = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(order))))
    found = order[own > least]
    return part[found], offset[found]


def _compare(table):
    """Covers of the pieces of one bucket: (document, row, first, after)."""
    covers, texts, pieces, members, count = [], [], [], [], 0
    for i in range(table.num_rows):
        text, lengths, anchor, document, member, rows, starts, cover = (table.column(c)[i].as_py() for c in _PIECE_COLUMNS)
        if cover is not None:
            covers.append(_unpacked(cover, np.int64).reshape(-1, 4))
            continue
        texts.append(zstandard.decompress(text))
        document, at = _summed(document, np.int64), _summed(member, np.int32)
        pieces.append((_unpacked(lengths, np.uint8), _unpacked(anchor, np.uint16), document))
        members.append((at + count, document[at], _unpacked(rows, np.int64), _unpacked(starts, np.int64)))
        count += len(document)
    if count:
        raw = b"".join(texts)
        del texts
        sizes, anchors, document = (np.concatenate(x) for x in zip(*pieces))
        sizes = sizes.astype(np.int64)
        at = np.cumsum(sizes) - sizes
        heads, number = _equal(raw, at, sizes, _digests(raw, at, sizes), anchors)
        low = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(low, number, document)
        at, sizes, anchors = at[heads], sizes[heads], anchors[heads]
        member, document, row, start = (np.concatenate(x) for x in zip(*members))
        del pieces, members
        member = number[member]
        later = document > low[member]
        covers.append(_joined(np.stack((document[later], row[later], start[later], start[later] + sizes[member[later]]), axis=1)))
        first = np.flatnonzero(~later)
        first = first[np.argsort(member[first], kind="stable")]
        member, document, row, start = member[first], document[first], row[first], start[first]
        for chosen in _sorted_parts(anchors, sizes):
            part, offset = repeats(list(_cuts(raw, at[chosen], sizes[chosen])), low[chosen])
            part = chosen[part]
            a, b = np.searchsorted(member, part), np.searchsorted(member, part, side="right")
            again = np.repeat(np.arange(len(part)), b - a)
            m = np.repeat(a, b - a) + np.arange(len(again)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            covers.append(_joined(np.stack((document[m], row[m], start[m] + offset[again], start[m] + offset[again] + LENGTH), axis=1)))
    found = _joined(np.concatenate(covers)) if covers else np.zeros((0, 4), np.int64)
    return pa.table({c.split()[0]: pa.array(np.ascontiguousarray(found[:, i])) for i, c in enumerate(_COVERS.split(", "))})


def _sorted_parts(anchors: np.ndarray, sizes: np.ndarray):
    """Parts of about SORTED bytes; those of one anchor stay together."""
    order = np.argsort(anchors, kind="stable")
    new = np.append(True, anchors[order][1:] != anchors[order][:-1])
    total = np.cumsum(sizes[order])
    block = (total // SORTED)[np.flatnonzero(new)][np.cumsum(new) - 1]
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    for b, e in zip(begin, np.append(begin[1:], len(order))):
        yield order[b:e]


# --- the operator ------------------------------------------------------------

def _kept(text: bytes, covers: list) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs removed."""
    out, at, spans = [], 0, 0
    for a, b in sorted(covers):
        if a > at or not spans:
            out.append(text[at:a])
            spans += 1
        at = max(at, b)
    return b"".join([*out, text[at:]]), spans


def _found(covers):
    """The covers of each document as an array of (row, first, after): an object for each would take several times the room."""
    flat = covers.values
    flat = np.stack([flat.field(name).to_numpy(zero_copy_only=False) for name in ("row", "first", "after")], axis=1)
    begin = covers.offsets.to_numpy()
    for known, a, b in zip(covers.is_valid().to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
        yield flat[a : b if known else a]


def _each(run):
    """``run`` over the groups of a task, giving memory back after each."""
    def whole(table):
        out = run(table)
        give_back()
        return out

    return whole


def remove_repeats(docs: DataFrame, with_text: bool = False, frequent: int = FREQUENT, bucket_bytes: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Each byte is removed that a string of LENGTH bytes covers which also starts in a row with a
    smaller doc_id, in the texts as they are given. Null texts are empty; texts below LENGTH bytes
    stay whole. Rows with the same doc_id take nothing from each other; a null doc_id comes after
    all others. Other columns are ignored; an empty table gives an empty result.
    """
    last = 2**63 - 1
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(last)).alias("document"), F.col("doc_id").isNull().alias("unnamed"), text_bytes().alias("text")
    )
    # A row is told from others of its doc_id by a hash of its text.
    given = given.withColumn("row", F.xxhash64("text"))
    # Copies of a whole earlier text need no search.
    prints = settle(given.select("document", "row", F.xxhash64(F.lit(1), F.col("text")).alias("more"), F.length("text").alias("size")), "prints")
    firsts = prints.groupBy("row", "more", "size").agg(F.min("document").alias("first"), F.max("document").alias("last")).where("first < last")
    copies = prints.join(firsts.drop("last"), ["row", "more", "size"]).where(f"document > first and size >= {LENGTH}").select("document", "row")
    size = prints.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, size // bucket_bytes)
    often = max(frequent, 2 * size // (LENGTH - KMER + 2) // ONE_OF)
    met = given.select("document", "text").mapInArrow(giving_back(lambda it: _meet(it, buckets)), _MET)
    repeated = settle(met.groupBy("bucket").applyInArrow(_each(lambda table: _repeated(table, often)), _REPEATED), "anchors")
    # At most ONE_OF anchors or so can be as frequent as that.
    hot = np.unique(np.array([r.code for r in repeated.where("frequent").collect()], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    told = repeated.where("not frequent").select("document", "code", F.lit(None).cast("bigint").alias("copy"))
    told = told.unionAll(copies.select("document", F.lit(None).cast("bigint"), "row"))
    told = told.groupBy("document").agg(F.collect_list("code").alias("codes"), F.collect_set("copy").alias("copies"))
    # With the same columns as below, so that texts are shuffled once for both.
    pieces = given.join(told, "document").select("document", "row", "text", "codes", "copies", "unnamed").mapInArrow(
        giving_back(lambda it: _pieces(it, buckets, shared.value)), _PIECES
    )
    covers = pieces.groupBy("bucket").applyInArrow(_each(_compare), _COVERS)
    covers = covers.groupBy("document").agg(F.collect_list(F.struct("row", "first", "after")).alias("covers"))

    def finish(batches):
        for batch in _portions(batches):
            out = []
            for text, row, found in zip(values(batch.column(2)), values(batch.column(3)), _found(batch.column(4))):
                kept, spans = _kept(text, found[found[:, 0] == row, 1:].tolist())
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*out)) or [()] * 5
            ids = [None if u else d for d, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            arrays = [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return given.join(covers, "document", "left").select("document", "unnamed", "text", "row", "covers").mapInArrow(giving_back(finish), schema)
