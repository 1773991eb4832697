"""Exact top-k by inner product with the threshold algorithm.

The vectors are dealt over shards. A shard keeps one sorted list per dimension; a query
reads each list from the end that its own component favours, looks up the full score of
every vector met, and stops as soon as the best score that an unmet vector could still
have, the sum over the lists of what stands at the depth reached, is below its k-th
score. The k best of each shard are merged.

Queries come in blocks and candidates in shards, both of bounded size; each task holds
one of either. Scores are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a shard and queries of a block, on average.
SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
#: Depths at which the threshold is looked at: the first, and how much deeper each next is.
_FIRST_DEPTH, _DEEPER = 8, 1.3
_EXACT = float(1 << 53)


def whole_components(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as long; null where the vector is null or has
    a component that is null, not finite or beyond the long range."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) >= F.lit(9.2e18))
    )
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), scaled)


class Lists:
    """The sorted lists of a shard, and its vectors for lookups."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        columns = np.ascontiguousarray(self.vectors.T)
        self.order = np.argsort(columns, axis=1, kind="stable")  # per dimension, smallest first
        by_rank = np.take_along_axis(columns, self.order, axis=1)
        depths = [min(_FIRST_DEPTH, len(ids))]
        while depths[-1] < len(ids):
            depths.append(min(len(ids), max(depths[-1] + 1, int(depths[-1] * _DEEPER))))
        self.depths = np.array(depths)
        # what stands at each of these depths, read from the small and from the large end
        self.small, self.large = by_rank[:, self.depths - 1].T, by_rank[:, len(ids) - self.depths].T

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best but ``own``, best first, ties to the smaller id."""
        count = len(self.ids)
        down, up = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        # the best score that a vector unmet at each depth could still have
        thresholds = self.large[:, down] @ query[down] + self.small[:, up] @ query[up]
        met = np.zeros(count, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        stop, start = 0, 0
        while True:
            depth = int(self.depths[stop])
            fresh = np.zeros(count, bool)
            if depth < count:
                fresh[self.order[down, count - depth : count - start].ravel()] = True
                fresh[self.order[up, start:depth].ravel()] = True
                fresh &= ~met
                met |= fresh
            else:
                fresh = ~met
            new = np.flatnonzero(fresh)
            new = new[self.ids[new] != own]
            scores = np.concatenate([best, self.vectors[new] @ query])
            ids = np.concatenate([best_ids, self.ids[new]])
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[scores >= kth], scores[scores >= kth]
            pick = np.lexsort([ids, -scores])[:k]
            best_ids, best = ids[pick], scores[pick]
            # an unmet vector may tie at the threshold with a smaller id
            if depth == count or len(best) == k and thresholds[stop] < best[-1]:
                return best_ids, best
            # no stop before the threshold falls below the present k-th score is of use
            enough = np.flatnonzero(thresholds < best[-1]) if len(best) == k else np.zeros(0, int)
            start, stop = depth, int(enough[0]) if len(enough) else len(self.depths) - 1


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in vectors])


def _pair_tasks(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[tuple]:
    if not len(candidates) or not len(queries):
        return
    vectors, wanted = _stacked(candidates["vector"]), _stacked(queries["vector"])
    # sums of products below 2**53 are exact in floating point, which is faster; others stay whole
    reach = float(np.abs(vectors).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float64 if reach < _EXACT else np.int64 if reach < 9.2e18 else object
    lists = Lists(candidates["vec_id"].to_numpy(np.int64), vectors.astype(kind))
    for row, (own, number) in enumerate(zip(queries["vec_id"].tolist(), queries["query"].tolist())):
        ids, scores = lists.top(wanted[row].astype(kind), own, k)
        for found, score in zip(ids.tolist(), scores.tolist()):
            yield number, own, found, int(score)


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = 256,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query row the ``k`` rows of highest score.

    The score is the inner product of ``floor(scale * x)``; ties go to the smaller id.
    Every row but those of the query's own id is a candidate. Null vectors, vectors
    with a component null or not finite, and rows with a null id take no part; vectors of
    different length do not meet. A query with fewer candidates gets all of them. A
    repeated candidate row counts each time; equal query rows are one query, and of
    different vectors under one id each is a query with ranks of its own. Scores beyond
    the long range are an error. Other columns play no part.
    """
    usable = vectors.select(F.col(id).cast("long").alias("vec_id"), whole_components(F.col(vector), scale).alias("vector"), is_query.alias("_asks"))
    usable = usable.filter("vec_id IS NOT NULL AND vector IS NOT NULL").withColumn("size", F.size("vector"))
    asked = usable.filter("_asks").select("vec_id", "vector", "size").distinct()
    asked = asked.withColumn("query", F.xxhash64("vec_id", "vector"))
    sizes = usable.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_asks"), 1)).alias("q")).agg(F.sum("n"), F.sum("q")).first()
    shards, blocks = max(1, -(-(sizes[0] or 0) // shard_rows)), max(1, -(-(sizes[1] or 0) // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = usable.select("vec_id", "vector", "size", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    queries = asked.select("query", "vec_id", "vector", "size", every(shards).alias("shard"), F.pmod(F.col("query"), F.lit(blocks)).cast("int").alias("block"))
    pair = ["size", "shard", "block"]

    def task(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_pair_tasks(own, wanted, k), columns=["query", "query_id", "vec_id", "score"])

    found = candidates.groupBy(*pair).cogroup(queries.groupBy(*pair)).applyInPandas(task, "query long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
