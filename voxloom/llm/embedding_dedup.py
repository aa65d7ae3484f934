"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut into halves, each with its own codebook, and the product of the codebooks is a
grid of cells. Every vector lies in one cell and visits the cells nearest to it, in order of the
sum of its halves' distances, by multi-sequence traversal; how far it goes is set on a sample so
that the target recall is reached there. Vectors that lie in a visited cell are verified by their
cosine. A cell with many vectors is cut into tiles, and of a tile only counts and the edges that
join its parts are kept.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import components, hashed_share, settle
from voxloom.llm.simhash import Forest

# About so many vectors the codebooks are fitted on, chosen by a hash.
FIT_ROWS = 20_000
CODEWORDS = 1024
# Vectors of a cell that a task holds at once, on each side.
TILE = 2048


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and how much farther than the nearest cell a vector looks."""

    first: np.ndarray
    second: np.ndarray
    slack: float

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _squares(vectors[:, :cut], self.first), _squares(vectors[:, cut:], self.second)

    def visits(self, vectors: np.ndarray) -> list[list[int]]:
        """Cells of each vector from the nearest on; the first is its own."""
        a, b = self.distances(vectors)
        orders = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        out = []
        for u, v, i, j in zip(a, b, *orders):
            out.append(traverse(u, v, i, j, self.slack))
        return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def traverse(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, slack: float) -> list[int]:
    """Multi-sequence traversal: cells in rising order of u + v until ``slack`` above the first.

    ``i`` and ``j`` sort ``u`` and ``v``; a heap holds the cells next to those visited.
    """
    width, limit = len(v), u[i[0]] + v[j[0]] + slack
    heap, seen, out = [(u[i[0]] + v[j[0]], 0, 0)], {(0, 0)}, []
    while heap:
        d, p, q = heapq.heappop(heap)
        if d > limit:
            break
        out.append(int(i[p]) * width + int(j[q]))
        for r, s in ((p + 1, q), (p, q + 1)):
            if r < len(u) and s < width and (r, s) not in seen:
                seen.add((r, s))
                heapq.heappush(heap, (u[i[r]] + v[j[s]], r, s))
    return out


def k_means(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = _squares(x, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, codewords: int, least: float, recall: float, seed: int = 42) -> MultiIndex:
    """Codebooks of ``sample`` (rows of length 1) and the slack that reaches ``recall``.

    The slack is measured on neighbours at just the least cosine, made from the sample's vectors by
    turning them in random directions: real neighbours are as near or nearer.
    """
    rng, cut = np.random.default_rng(seed), sample.shape[1] // 2
    index = MultiIndex(k_means(sample[:, :cut], codewords, rng), k_means(sample[:, cut:], codewords, rng), 0.0)
    part = sample[:4000]
    aside = rng.normal(size=part.shape)
    aside -= (aside * part).sum(axis=1)[:, None] * part
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
    turned = least * part + np.sqrt(1 - least * least) * aside
    (a, b), (c, d) = index.distances(part), index.distances(turned)
    rows = np.arange(len(part))
    beyond = a[rows, c.argmin(axis=1)] + b[rows, d.argmin(axis=1)] - a.min(axis=1) - b.min(axis=1)
    index.slack = float(np.quantile(beyond, recall))
    return index


def _matrix(column, width: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have a cosine of at least ``least``; those near it are counted anew."""
    cosine = _unit(x) @ _unit(y).T
    found = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12)):
        found[i, j] = x[i] @ y[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(y[j] @ y[j])) >= least
    return found


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, recall: float = 0.998, fit_rows: int = FIT_ROWS, tile: int = TILE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other vectors linked by a cosine of at least ``least``, ``component_id``
    is the smallest vec_id that links reach. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components have no links. Equal vectors are one vector that counts as many
    times. Rows with a null vec_id count as links of others and have a null component_id unless
    linked; their ``kept`` is false. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(
        F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False)
    )
    given = given.withColumn("sound", sound)
    sized = given.where("sound").groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    none = given.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
    if sized is None:
        return none
    given = given.withColumn("sound", F.col("sound") & (F.size("v") == sized.width))
    print_ = F.when(F.col("sound"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), F.col("v")).alias("b")))
    given = given.withColumn("same", print_)
    distinct = settle(
        given.where("sound").groupBy("same").agg(
            F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("v").alias("v")
        ).select(F.xxhash64("same").alias("node"), "same", "vec_id", "n", "v"),
        "vectors",
    )
    total = distinct.count()
    sample = distinct.where(hashed_share(F.col("node"), fit_rows, total)).select("v").toArrow()
    index = fit(_unit(_matrix(sample.column("v").combine_chunks())), min(CODEWORDS, max(1, round((total / 50) ** 0.5))), least, recall)
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            seen = shared.value.visits(_unit(_matrix(batch.column(2)))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2),
                pa.array([s[0] for s in seen], pa.int32()), pa.array(seen, pa.list_(pa.int32())),
            ], names=["node", "n", "v", "cell", "visits"])

    placed = settle(
        distinct.select("node", "n", "v").mapInArrow(place, "node bigint, n bigint, v array<double>, cell int, visits array<int>"), "placed"
    )
    inside = placed.withColumn("at", F.col("cell"))
    asking = placed.withColumn("at", F.explode("visits"))
    tiles = lambda rows, name: rows.groupBy("at").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    counts = tiles(inside, "inside").join(tiles(asking, "asking"), "at")  # at most CODEWORDS ** 2 rows
    own = lambda n: F.pmod("node", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["at", "i", "j", "side", "node", "n", "v", "cell", "visits"]
    asking = asking.withColumn("visits", F.lit(None).cast("array<int>"))
    left = asking.join(counts, "at").withColumn("side", F.lit(0)).withColumn("i", own("asking")).withColumn("j", every("inside"))
    right = inside.join(counts, "at").withColumn("side", F.lit(1)).withColumn("j", own("inside")).withColumn("i", every("asking"))
    met = left.select(columns).unionAll(right.select(columns))

    def verify(table):
        side = table.column("side").to_numpy()
        asks, holds = (table.filter(pa.array(side == s)).combine_chunks() for s in (0, 1))
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not asks.num_rows or not holds.num_rows:
            return empty
        x, y = (_matrix(t.column("v").combine_chunks()) for t in (asks, holds))
        a, b = (t.column("node").to_numpy() for t in (asks, holds))
        times_a, times_b = (t.column("n").to_numpy() for t in (asks, holds))
        found = _linked(x, y, least) & (a[:, None] != b[None, :])
        links_a = found @ times_b
        # What visits the asker's own cell finds it by itself; others are told here.
        cells, cell_of = np.unique(asks.column("cell").to_numpy(), return_inverse=True)
        visits = holds.column("visits").combine_chunks()
        sees = np.zeros((len(b), len(cells)), bool)
        flat, row = visits.flatten().to_numpy(), np.repeat(np.arange(len(b)), np.diff(visits.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
        sees[row[cells[at] == flat], at[cells[at] == flat]] = True
        links_b = times_a @ (found & ~sees[:, cell_of].T)
        forest = Forest()
        label = np.arange(len(b))
        for q in np.flatnonzero(found.any(axis=1)):
            hit = np.flatnonzero(found[q])
            forest.join(int(a[q]), int(b[hit[0]]))
            if (label[hit] != label[hit[0]]).any():
                for other in np.unique(label[hit]):
                    forest.join(int(b[hit[0]]), int(b[other]))
                label[np.isin(label, label[hit])] = label[hit].min()
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        one, other = links_a > 0, links_b > 0
        return pa.table({
            "a": pa.array(np.concatenate((a[one], b[other], edges[:, 0]))),
            "b": pa.concat_arrays([pa.nulls(int(one.sum() + other.sum()), pa.int64()), pa.array(edges[:, 1])]),
            "n": pa.array(np.concatenate((links_a[one], links_b[other], np.zeros(len(edges), np.int64))).astype(np.int64)),
        })

    found = settle(met.groupBy("at", "i", "j").applyInArrow(verify, "a bigint, b bigint, n bigint"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null"), "a", "b")
    named = distinct.select("node", "same", "vec_id", "n").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least_id, "component").join(links, "node", "left").select(
        "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id"
    )
    out = given.select("vec_id", "same").join(named, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
