"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample and balanced by a penalty on large
lists. Every vector goes to its nearest list and, when it lies near a border,
to further lists whose centroid is almost as near and not hidden behind one
already chosen. Centroids are searched through an in-memory graph of nearest
centroids. A query takes the lists whose distance is within a ratio of the
best, and more in order of distance until they hold enough vectors.

Inner products become distances by one more coordinate that gives all vectors
the same length. Neighbouring lists share a shard, so that a query is sent
once, with the lists it wants, to each shard it touches and returns from there
its best rows only; a shard above a bounded size is cut into blocks, to each of
which the query is sent, so dense lists are shared by many tasks. Of equal
vectors only as many as a query could return (smallest ids first) are indexed
as candidates; the rest cannot appear in any result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage

#: Vectors that the centroids are fitted on, those with the smallest hashes of their ids.
SAMPLE_ROWS = 50_000
#: Rows a list should hold, and how many lists there are at most (their centroids are sent to every task).
LIST_ROWS = 256
MAX_LISTS = 16_384
#: Rows that lie together in a shard, about; and rows that are compared in one group at most, about.
SHARD_ROWS = 8_192
BLOCK_ROWS = 16_384
#: Replication: as many lists at most, within this ratio of the nearest.
REPLICAS = 4
BORDER_RATIO = 1.05
#: Search: lists within this ratio of the nearest.
PROBE_RATIO = 1.13


class Centroids:
    """Centroids with a graph of nearest neighbours, searched for many points at once."""

    def __init__(self, points: np.ndarray, degree: int = 24, seeds: int = 64):
        self.points = np.ascontiguousarray(points, dtype=np.float64)
        n = len(self.points)
        k = min(degree, n - 1)
        self.near = np.zeros((n, k), dtype=np.int64)
        for at in range(0, n if k else 0, 1024):
            d = self._to(self.points[at:at + 1024], np.arange(n))
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            self.near[at:at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
        self.seeds = np.unique(np.linspace(0, n - 1, min(seeds, n)).astype(np.int64))

    def _to(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        c = self.points[which]
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]))

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the lists that the search has met (others infinite), and the least per row.

        From the seeds the search goes on to the graph neighbours of every list
        that lies within ``ratio`` of the best one met so far, until all such
        lists are expanded.
        """
        rows, n = len(x), len(self.points)
        dist = np.full((rows, n), np.inf)
        dist[:, self.seeds] = self._to(x, self.seeds)
        done = np.zeros((rows, n), bool)
        best = dist.min(axis=1)
        while True:
            r, c = np.nonzero((dist <= ratio * best[:, None]) & ~done)
            if not len(r):
                return dist, best
            done[r, c] = True
            near = (r[:, None] * n + self.near[c]).ravel()
            near = np.unique(near[~np.isfinite(dist.ravel()[near])])
            for at in range(0, len(near), 50_000):
                r, c = np.divmod(near[at:at + 50_000], n)
                d = x[r] - self.points[c]
                dist[r, c] = np.sqrt(np.einsum("ij,ij->i", d, d))
            best = dist.min(axis=1)


def fitted(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids of a sample by k-means with a penalty on lists above their even share."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centre = sample[np.sort(rng.permutation(len(sample))[:lists])].copy()
    share, penalty = len(sample) / lists, np.zeros(lists)
    for _ in range(rounds):
        own = np.empty(len(sample), dtype=np.int64)
        half = (centre * centre).sum(1)
        for at in range(0, len(sample), 2048):
            own[at:at + 2048] = np.argmin(half[None, :] - 2 * (sample[at:at + 2048] @ centre.T) + penalty[None, :], axis=1)
        size = np.bincount(own, minlength=lists)
        spread = ((sample - centre[own]) ** 2).sum(1).mean()
        penalty = np.clip(penalty + 0.2 * spread * (size / share - 1), 0, None)
        for d in range(sample.shape[1]):
            total = np.bincount(own, weights=sample[:, d], minlength=lists)
            centre[:, d] = np.where(size > 0, total / np.maximum(size, 1), centre[:, d])
    return centre


def usable(vector: Column, dims: int | None = None) -> Column:
    """Neither NULL nor zero, no NULL or non-finite component, and of ``dims`` components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & (F.size(vector) == dims) if dims else ok, F.lit(False))


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added in order, so that equal vectors score equally."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * rows[:, d]
    return total


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS,
            max_lists: int = MAX_LISTS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, replicas: int = REPLICAS, border: float = BORDER_RATIO, ratio: float = PROBE_RATIO) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found per query.

    Queries are the rows for which ``is_query`` holds, candidates all rows but
    the query's own; rows that share an id are one row (the first by vector).
    Vectors that are not usable, or whose length differs from that of the
    most frequent length, take no part. Ties go to the smaller id. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("bigint").alias("_id"), v.alias("_v"), is_query.alias("_query")).filter(F.col("_id").isNotNull() & usable(F.col("_v")))
    lengths = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if lengths is None:
        return empty
    dims = lengths["n"]
    rows = rows.filter(F.size("_v") == dims)
    # One row per id, then of equal vectors the k + 1 smallest ids: row limits that Spark applies before the shuffle too.
    one = F.row_number().over(Window.partitionBy("_id").orderBy("_v"))
    rows = cut_lineage(rows.withColumn("_n", one).filter("_n = 1").drop("_n"))
    count, top = rows.agg(F.count("*"), F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))).first()
    twin = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    points = rows.withColumn("_n", twin).filter(F.col("_n") <= k + 1).drop("_n")
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_v").toPandas()
    longest = float(top)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, longest - (x * x).sum(1)))[:, None]], axis=1)

    lists = int(max(1, min(max_lists, count // list_rows, len(sample))))
    centres = fitted(lifted(_matrix(sample["_v"])), lists)
    graph = spark.sparkContext.broadcast(Centroids(centres))
    # Lists near each other share a shard.
    groups = fitted(centres, max(1, len(centres) * list_rows // shard_rows))
    shard_of = np.argmin((groups * groups).sum(1)[None, :] - 2 * (centres @ groups.T), axis=1)

    def post(batches):
        index = graph.value
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at:at + 512]
                x = lifted(_matrix(part["_v"]))
                dist, best = index.within(x, border)
                found = np.argsort(dist, axis=1, kind="stable")[:, :4 * replicas]
                dist = np.take_along_axis(dist, found, 1)
                chosen = np.zeros(found.shape, bool)
                chosen[:, 0] = True
                for j in range(1, found.shape[1]):
                    near = (dist[:, j] <= border * best) & (chosen.sum(1) < replicas)
                    for i in range(j):  # not behind a list that is chosen already
                        between = np.sqrt(((index.points[found[:, i]] - index.points[found[:, j]]) ** 2).sum(1))
                        near &= ~(chosen[:, i] & (between < dist[:, j] * 0.5))
                    chosen[:, j] = near
                r, c = np.nonzero(chosen)
                yield pd.DataFrame({"_list": found[r, c].astype(np.int32), "_id": part["_id"].to_numpy()[r], "_v": part["_v"].to_numpy()[r]})

    posted = cut_lineage(points.select("_id", "_v").mapInPandas(post, "_list int, _id bigint, _v array<double>"))
    sizes = {r["_list"]: r["n"] for r in posted.groupBy("_list").agg(F.count("*").alias("n")).collect()}  # at most max_lists rows
    held = np.array([sizes.get(i, 0) for i in range(len(centres))], dtype=np.int64)
    blocks = np.maximum(1, -(-np.bincount(shard_of, weights=held).astype(np.int64) // block_rows))
    need = (k + 1) * replicas

    def probe(batches):
        index = graph.value
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at:at + 128]
                x = _matrix(part["_v"])
                x = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
                dist, best = index.within(x, ratio)
                take, wide = dist <= ratio * best[:, None], ratio
                # Where the lists hold too few rows the ratio grows, at last to all lists.
                while (few := np.flatnonzero((take * held[None, :]).sum(1) < need)).size:
                    wide *= 1.5
                    if wide > 20:
                        take[few] = True
                        break
                    more, nearest_of = index.within(x[few], wide)
                    take[few] = more <= wide * nearest_of[:, None]
                out = []
                for row in range(len(x)):
                    wanted = np.flatnonzero(take[row])
                    places = shard_of[wanted]
                    for shard in np.unique(places):
                        own = wanted[places == shard].astype(np.int32)
                        out += [(int(shard), block, part["_id"].iat[row], part["_v"].iat[row], own) for block in range(blocks[shard])]
                yield pd.DataFrame(out, columns=["_shard", "_block", "_q", "_qv", "_lists"])

    asked = rows.filter("_query").select("_id", "_v").mapInPandas(probe, "_shard int, _block int, _q bigint, _qv array<double>, _lists array<int>")

    @F.pandas_udf("_shard int, _block int")
    def place_of(which: pd.Series, ids: pd.Series) -> pd.DataFrame:
        shard = shard_of[which.to_numpy()]
        spread = (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return pd.DataFrame({"_shard": shard.astype(np.int32), "_block": (spread.astype(np.int64) % blocks[shard]).astype(np.int32)})

    stored = posted.withColumn("_at", place_of("_list", "_id")).select("_at._shard", "_at._block", "_list", "_id", "_v")

    def compare(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            cv, ids, lists_of = _matrix(c["_v"]), c["_id"].to_numpy(), c["_list"].to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at:at + 256]
                qv, own = _matrix(part["_qv"]), part["_q"].to_numpy()
                wanted = np.zeros((len(part), len(centres)), bool)
                for i, w in enumerate(part["_lists"]):
                    wanted[i, w] = True
                rough = qv @ cv.T
                rough[(own[:, None] == ids[None, :]) | ~wanted[:, lists_of]] = -np.inf
                # A row may lie in several lists of the shard.
                n = min(k * replicas, len(ids))
                edge = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
                # The product may round otherwise than the exact score: what could tie stays.
                slack = 1e-9 * (1 + longest)
                r, j = np.nonzero((rough >= edge[:, None] - slack) & np.isfinite(rough))
                score = exact_scores(qv[r], cv[j])
                order = np.lexsort((ids[j], -score, r))
                r, j, score = r[order], j[order], score[order]
                fresh = np.append(True, (r[1:] != r[:-1]) | (ids[j[1:]] != ids[j[:-1]]))[:len(r)]
                r, j, score = r[fresh], j[fresh], score[fresh]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append(pd.DataFrame({"query_id": own[r[keep]], "vec_id": ids[j[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    pairs = asked.groupBy("_shard", "_block").cogroup(stored.groupBy("_shard", "_block")).applyInPandas(compare, "query_id bigint, vec_id bigint, score double")
    best = pairs.dropDuplicates(["query_id", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
