"""Exact deduplication that no group of copies can slow down.

Rows of equal text are combined in three steps. Each task first merges the equal texts it has itself:
the part of the aggregation before its shuffle. Then rows of one digest meet, dealt by a salt, so that a text with
a third of all rows is spread over SALTS tasks. Last, the winners of the salts, at most SALTS for a text, are
combined. All steps group by the text itself beside its digest, so texts with equal digests stay apart.

Texts end there. Documents learn their group from narrow tables: first each (salt, digest) in use, then each
document of that salt, so no join key holds more than the copies of one salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import copies, settle, text_of

# Parts that the copies of one text are dealt into.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(name: str = "text") -> Column:
    """A text with A-Z lower-cased and nothing else changed; null is empty."""
    return F.translate(text_of(name), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _combined(rows: DataFrame) -> DataFrame:
    """(digest, text, keep_id, group_size) of rows with doc_id, salt, digest and text."""
    salted = rows.groupBy("salt", "digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _members(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """One row for each document with what ``groups`` says of its ``key``. Equal rows travel as one with a number."""
    members = rows.groupBy("salt", *key, "doc_id").agg(F.count("*").alias("n"))
    known = members.select("salt", *key).distinct().join(groups, key)
    told = members.join(known, ["salt", *key])
    return copies(told, "n", "copy").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def duplicate_groups(docs: DataFrame, *, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the
    largest doc_id stays, a null id only among null ids; of rows equal in both, one is kept. Other columns are not looked
    at; an empty table gives an empty result. ``digest`` makes text_sha256, and only has to bring equal texts together:
    texts that share a digest without being equal are told apart by a join on the text.
    """
    text = normalised()
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = docs.select("doc_id", salt.alias("salt"), digest(text).alias("digest"), text.alias("text"))
    groups = _combined(rows)
    # One row for each different text; shared says that another one has the same digest.
    narrow = settle(groups.select("digest", "keep_id", "group_size"), "groups")
    shared = narrow.groupBy("digest").count().where("count > 1").select("digest")
    keys = rows.select("doc_id", "salt", "digest")
    if shared.isEmpty():
        return _members(keys, narrow, ["digest"])
    shared = settle(shared, "shared_digests")
    alone = _members(keys.join(shared, "digest", "left_anti"), narrow.join(shared, "digest", "left_anti"), ["digest"])
    clashing = rows.join(shared, "digest", "left_semi")
    return alone.unionByName(_members(clashing, _combined(clashing), ["digest", "text"]))


def kept_documents(docs: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with all their columns.

    Of rows equal in text and doc_id the one whose other columns have the smallest hash stays. Nulls, repeats and
    empty tables are as in ``duplicate_groups``.
    """
    names = [F.col("`" + name.replace("`", "``") + "`") for name in docs.columns]
    whole = F.struct(*names)
    winners = duplicate_groups(docs, salts=salts).where("kept").select(
        F.col("text_sha256").alias("_digest"), F.col("keep_id").alias("_keep_id")
    )
    rows = docs.select(whole.alias("_row"), F.lower(F.hex(sha256(normalised()))).alias("_digest"), F.col("doc_id").alias("_id"))
    met = rows.join(winners, (rows["_digest"] == winners["_digest"]) & rows["_id"].eqNullSafe(winners["_keep_id"]))
    one = met.groupBy(rows["_digest"], "_id").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return one.select("_row.*")
