"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors the codebooks are fitted on at most; every vector is indexed.
SAMPLE = 20_000


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of a bounded sample."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, points[:, d], k) for d in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the closest centroid."""
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


class MultiIndex:
    """Two codebooks, one per half of the vector, and the rows in every pair of their centroids."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.half = left, right, left.shape[1]
        self.counts = np.zeros(len(left) * len(right), np.int64)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a = nearest(vectors[:, : self.half], self.left)
        b = nearest(vectors[:, self.half :], self.right)
        return a * len(self.right) + b

    def traverse(self, query: np.ndarray, enough: int) -> np.ndarray:
        """Cells in order of summed distance (the negative inner product of each half with its
        centroid), until they hold ``enough`` rows."""
        da, db = -self.left @ query[: self.half], -self.right @ query[self.half :]
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        da, db, oa, ob = da[oa].tolist(), db[ob].tolist(), oa.tolist(), ob.tolist()
        heap, out, rows = [(da[0] + db[0], 0, 0)], [], 0
        while heap and rows < enough:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * len(ob) + ob[j]
            out.append(cell)
            rows += self.counts[cell]
            if i + 1 < len(oa) and j == 0:
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            if j + 1 < len(ob):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        return np.array(out, np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)``: vectors that are neither null nor zero nor empty and hold finite numbers
    only, in double precision. Rows without an id take no part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    return (
        df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists("vector", lambda x: x != 0.0))
    )


def build(vectors: DataFrame, k: int = 64) -> MultiIndex | None:
    """Codebooks from at most SAMPLE vectors (in the order of a hash of their id), and the number of
    all rows in each of the k * k cells. None without vectors."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()
    if not len(sample):
        return None
    points = np.stack(sample["vector"].to_numpy())
    half = points.shape[1] // 2
    index = MultiIndex(kmeans(points[:, :half], k), kmeans(points[:, half:], k))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(index.counts), np.int64)
        for f in frames:
            if len(f):
                total += np.bincount(index.cells(np.stack(f["vector"].to_numpy())), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    counted = vectors.select("vector").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for cell, n in counted.collect():  # k * k rows at most
        index.counts[cell] = n
    return index


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20,
           k: int = 64, share: float = 0.55, least: int = 2000, shard_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` rows found with the largest inner products.

    Each query visits centroid pairs until they hold ``share`` of all rows (``least`` at least), and
    all rows of those cells are reranked by the exact inner product in double precision. Equal scores
    go by the smaller id. Rows with the query's own id are no candidates.

    The index is split into shards by a hash of the row's id: each holds its rows of every cell, so
    neither a hot cell nor a vector that a third of the rows share gathers in one task. A shard gives
    one row per query with its best ``top``, and these rows are merged as they stream by. Vectors must have one length. Of rows with one query id the smallest
    vector asks; repeated candidates are candidates each. No usable vectors: no rows.
    """
    vectors = usable(df, id_col, vector_col)
    packed = "query_id long, ids array<long>, scores array<double>"
    index = build(vectors, k)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = int(index.counts.sum())
    enough, shards = max(least, top, int(np.ceil(share * rows))), max(1, -(-rows // shard_rows))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            visits = []
            for v in f["vector"]:
                flags = np.zeros(len(index.counts), bool)
                flags[index.traverse(v, enough)] = True
                visits.append(np.packbits(flags).tobytes())
            yield f.assign(cells=visits)

    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.mapInPandas(route, "vec_id long, vector array<double>, cells binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def rerank(_, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, v = rows["vec_id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy())
            cell = index.cells(v)
            for query, q, visits in zip(asks["vec_id"], asks["vector"], asks["cells"]):
                flags = np.unpackbits(np.frombuffer(visits, np.uint8)).view(bool)
                at = np.flatnonzero(flags[cell] & (ids != query))
                scores = (v[at] * q).sum(axis=1)  # row by row alike, so equal vectors tie exactly
                if len(at) > top:
                    least_kept = np.partition(scores, len(at) - top)[len(at) - top]
                    keep = scores >= least_kept
                    at, scores = at[keep], scores[keep]
                best = np.lexsort((ids[at], -scores))[:top]
                out.append((query, ids[at[best]], scores[best]))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by query; only the best ``top`` of the current one are held."""
        owner, ids, scores, done = None, None, None, []
        for f in frames:
            for query, more, values in zip(f["query_id"], f["ids"], f["scores"]):
                if query != owner:
                    if owner is not None:
                        done.append(ranked(owner, ids, scores))
                    owner, ids, scores = query, np.empty(0, np.int64), np.empty(0)
                ids, scores = np.append(ids, more), np.append(scores, values)
                best = np.lexsort((ids, -scores))[:top]
                ids, scores = ids[best], scores[best]
            if len(done) > 500:
                yield pd.concat(done)
                done = []
        if owner is not None:
            done.append(ranked(owner, ids, scores))
        if done:
            yield pd.concat(done)

    def ranked(query: int, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        rank = np.arange(1, len(ids) + 1)
        return pd.DataFrame({"query_id": query, "rank": rank, "vec_id": ids.astype(np.int64), "score": scores})

    found = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(rerank, packed)
    by_query = found.repartition("query_id").sortWithinPartitions("query_id")
    return by_query.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")
