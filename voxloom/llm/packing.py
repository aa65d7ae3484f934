"""Sum-of-squares packing of documents into token sequences.

Texts are encoded once; what follows are narrow rows of one piece each. Pieces are dealt
into shards of a bounded number of pieces, and every shard is packed by itself: each piece
goes where the sum of the squared numbers of open bins per gap becomes smallest. A shard
leaves a few bins open, which is a small and constant part of its bins, so shards grow in
number with the data and never in size.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import giving_back, settle, text_of, values

# Pieces packed by one task at once.
SHARD_PIECES = 40_000
# Words, and parts of words, of which a worker remembers the ids: what is no word known is put together from parts.
REMEMBERED, REMEMBERED_PARTS = 100_000, 350_000

# Texts of these characters are split and lower-cased here as the tokenizer does it; words are then
# looked up. Others go through the tokenizer as a whole.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, by a tokenizer of lower-case words.

    Gives what ``Tokenizer.encode(text, add_special_tokens=False)`` gives, for byte-level
    tokenizers that split texts at white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.path, self.tokenizer = path, None
        self.of_parts = Tokenizer.from_file(path)  # for parts that are normal and split already
        self.of_parts.normalizer = None
        self.of_parts.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if self.tokenizer is None:  # few texts need it
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words. The first words and parts that are met are kept."""
        split = [_PARTS.findall(w) for w in words]
        known = self.parts
        new = [p for p in dict.fromkeys(p for ps in split for p in ps) if p not in known]
        fresh: dict[str, bytes] = {}
        if new:
            found = self.of_parts.encode(" ".join(new), add_special_tokens=False)
            ids, word = np.array(found.ids, "<u4"), np.array(found.word_ids)
            ends = np.searchsorted(word, np.arange(len(new)), side="right").tolist()
            raw, at = ids.tobytes(), 0
            for p, end in zip(new, ends):
                fresh[p] = raw[4 * at : 4 * end]
                at = end
        out = {w: b"".join([known[p] if p in known else fresh[p] for p in ps]) for w, ps in zip(words, split)}
        if len(known) < REMEMBERED_PARTS:
            known.update(fresh)
        if len(self.words) < REMEMBERED:
            self.words.update(out)
        return out

    def encode(self, text: str) -> bytes:
        if not text.isascii() and _OTHER.search(text) or "<|" in text or "\x7f" in text or any(c in text for c in _CONTROLS):
            return self._whole(text)
        words = text.lower().split()
        kept = self.words
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            fresh = self._learn([w for w in dict.fromkeys(words) if w not in kept])
            return b"".join([kept[w] if w in kept else fresh[w] for w in words])


_CONTROLS = [chr(c) for c in range(32) if c not in (9, 10, 13)]
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: (doc_id, piece, start, length, ids_crc32, salt[, ids]).

    A document is the ids of its text and then ``end_id``; only documents longer than ``limit``
    are cut. ``salt`` deals out the pieces; copies of a row get different ones.
    """

    def run(batches):
        enc, end, row = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    row += 1
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), zlib.crc32(b"%d %d %d" % (doc_id or 0, k, row)), part if with_ids else None))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)][: 7 if with_ids else 6],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"][: 7 if with_ids else 6],
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint"
    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(
        giving_back(run), schema + ", ids binary" * with_ids
    )


def sum_of_squares(lengths: list[int], limit: int) -> tuple[list[int], list[int]]:
    """A bin and an offset in it for each length, in the order given.

    Of the open bins that a length fits and a new bin, it takes the one after which the sum of
    the squared numbers of open bins per gap is smallest; ties go to the smallest gap.
    """
    open_bins = np.zeros(limit + 1, np.int64)  # by gap; a full bin is not open
    stacks: dict[int, list[int]] = {}
    bins, offsets, used = [], [], 0
    for s in lengths:
        # Change of the sum for gap g -> g - s: 1 - 2 N(g), and 1 + 2 N(g - s) unless it is full.
        change = 2 - 2 * open_bins[s:] + 2 * open_bins[: limit + 1 - s]
        change[0] -= 1
        change[open_bins[s:] == 0] = _NONE
        change[limit - s] = 1 + 2 * open_bins[limit - s] if s < limit else 0  # a new bin has the whole gap
        gap = int(change.argmin()) + s
        if gap == limit:
            bin_ = used
            used += 1
        else:
            bin_ = stacks[gap].pop()
            open_bins[gap] -= 1
        bins.append(bin_)
        offsets.append(limit - gap)
        if gap > s:
            open_bins[gap - s] += 1
            stacks.setdefault(gap - s, []).append(bin_)
    return bins, offsets


_NONE = np.iinfo(np.int64).max


def pack(parts: DataFrame, limit: int = 4096, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``parts`` (with length and salt) plus ``sequence_id`` and ``offset``.

    ``parts`` is counted, so it should be a stored table. Longest first within a shard.
    """
    shards = max(1, math.ceil(parts.count() / shard_pieces))
    names = [c for c in parts.columns if c != "salt"]

    def run(key, table):
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("salt").to_numpy(), -lengths))
        bins, offsets = sum_of_squares(lengths[order].tolist(), limit)
        out = table.take(pa.array(order)).select(names)
        ids = (key[0].as_py() << 32) + np.array(bins, np.int64)
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(np.array(offsets, np.int64)))

    kinds = dict(parts.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id bigint, offset bigint"
    return parts.withColumn("shard", F.col("salt") % shards).groupBy("shard").applyInArrow(run, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1, with_ids: bool = False,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Pieces of all rows of ``docs`` and their places: (doc_id, piece, start, length, ids_crc32,
    [ids,] sequence_id, offset).

    A null or empty text is the end id alone. Rows with a null doc_id and repeated rows are
    packed like others. Other columns are ignored; an empty table gives an empty result.
    """
    return pack(settle(pieces(docs, tokenizer, limit, end_id, with_ids), "pieces"), limit, shard_pieces)
