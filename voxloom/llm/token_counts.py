"""Exact token counts by a length histogram.

Each task encodes its texts and adds up how many have each length; Spark sums these up. From
then on there is one row for each length. Sums over all longer lengths answer totals, quantiles
and totals after truncation for every context limit.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import settle, text_of, values

# Lengths that are added up in one task; their sums are then added up in turn.
SPAN = 1024
_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The worker's encoding from a file of ranks, made once."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def length_histogram(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(length, n_docs): how many rows have each encoded length. Null and empty texts have length 0."""

    def run(batches):
        encode, counts = encoding(ranks, pattern).encode_ordinary, {}
        for batch in batches:
            for text in values(batch.column(0)):
                n = len(encode(text))
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n_docs"]
        )

    found = docs.select(text_of().alias("text")).mapInArrow(run, "length bigint, n_docs bigint")
    return found.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row for each length, taken as a context limit. ``histogram`` is used several times, so it
    should be a stored table.

    n_docs have this length; docs_longer and tokens_longer are those of greater length;
    truncated_tokens is the total when every document is cut at the limit, total_tokens without a
    limit; share_within is the part of the documents that need no cut, so quantiles are read from it.
    """
    spanned = histogram.withColumn("span", F.floor(F.col("length") / SPAN))
    sums = [F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens")]
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 1024 lengths
    later = spanned.groupBy("span").agg(*sums).select(
        "span", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("docs", "tokens")]
    )
    within = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    total = histogram.agg(*sums).first()  # one row
    docs, tokens = F.lit(total["docs"] or 0), F.lit(total["tokens"] or 0).cast("bigint")
    rows = spanned.join(later, "span").select(
        "length", "n_docs",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(within), F.lit(0))).alias("tokens_longer"),
    )
    return rows.select(
        "length", "n_docs", "docs_longer", "tokens_longer",
        (tokens - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        tokens.alias("total_tokens"), (1 - F.col("docs_longer") / docs).alias("share_within"),
    )


def token_counts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``suffix_sums`` of the lengths of all rows of ``docs``. Repeated rows count each time; doc_id
    and other columns are not looked at; an empty table gives an empty result."""
    return suffix_sums(settle(length_histogram(docs, ranks, pattern), "lengths"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(tokens): the total when every document is cut at ``limit``, from the result of ``token_counts``."""
    longer = F.when(F.col("length") > limit, F.col("n_docs"))
    return sums.agg(F.coalesce(
        F.sum(F.when(F.col("length") <= limit, F.col("n_docs") * F.col("length"))), F.lit(0)
    ).alias("within"), F.coalesce(F.sum(longer), F.lit(0)).alias("longer")).select((F.col("within") + limit * F.col("longer")).alias("tokens"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """(length): the smallest length that a share ``q`` of the documents does not exceed."""
    return sums.where(F.col("share_within") >= q - 1e-12).agg(F.min("length").alias("length"))
