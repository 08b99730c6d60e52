"""Exact top-k inner-product search by MaxScore over dimension postings.

The vectors are dealt to shards; in a shard each dimension is a posting list of impacts
(a column of the shard's matrix).  For a query the terms are its dimensions, bounded by
the best contribution any vector of the shard can get from them.  Terms whose bounds
together stay below the current k-th score are non-essential: the essential postings are
traversed, and the others are probed group by group only for vectors that can still
compete.  Shard results are merged by a windowed top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Vectors of a shard that are scored at a time; the threshold grows from block to block.
STRIDE = 256
#: Non-essential terms probed between two prunings.
PROBE = 8


def integers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, v = floor(scale * x) and n of the rows that take part; n rows are equal in both."""
    x = F.col("embedding")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    return (vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & whole)
            .select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))
            .groupBy("vec_id", "v").agg(F.count("*").alias("n")))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def shard_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """Per query the k best (query index, vector index, score) of one shard, ties to the
    smaller id; rows of the query's own id are no candidates.  Indices are of the rows given."""
    dim = max(q.shape[1], 1)
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * dim
    kind = np.float64 if most < 2 ** 53 else np.int64  # float64 sums of integers are exact below 2^53
    order = np.argsort(ids, kind="stable")
    ids, v, q = ids[order], v[order].astype(kind), q.astype(kind)
    bound = np.where(q > 0, q * v.max(axis=0, initial=0), q * v.min(axis=0, initial=0))  # >= 0, per query and term
    terms = np.argsort(bound, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(bound, terms, 1), axis=1)
    low = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    theta = np.full(len(q), low, dtype=kind)
    best = [np.zeros(0, np.int64) for _ in range(3)]
    for at in range(0, len(ids), STRIDE):
        block = v[at: at + STRIDE]
        spare = (sums < theta[:, None]).sum(axis=1)  # non-essential terms of each query
        essential = np.ones_like(q, dtype=bool)
        np.put_along_axis(essential, terms, np.arange(q.shape[1]) >= spare[:, None], 1)
        acc = (q * essential) @ block.T
        rest = np.where(spare > 0, np.take_along_axis(sums, np.maximum(spare - 1, 0)[:, None], 1)[:, 0], 0) if dim and q.shape[1] else np.zeros(len(q), kind)
        alive = (acc + rest[:, None] >= theta[:, None]) & (q_ids[:, None] != ids[at: at + STRIDE])
        qi, di = np.nonzero(alive)
        score = acc[qi, di]
        for step in range(0, int(spare.max(initial=0)), PROBE):
            for j in range(step, min(step + PROBE, int(spare.max(initial=0)))):
                nth = spare[qi] - 1 - j  # the largest bounds first
                term = terms[qi, np.maximum(nth, 0)]
                score = score + np.where(nth >= 0, q[qi, term] * block[di, term], 0)
            left = np.maximum(spare - step - PROBE, 0)
            rest = np.where(left > 0, np.take_along_axis(sums, np.maximum(left - 1, 0)[:, None], 1)[:, 0], 0)
            go = score + rest[qi] >= theta[qi]
            qi, di, score = qi[go], di[go], score[go]
        best = [np.concatenate(x) for x in zip(best, (qi, di + at, score.astype(np.int64)))]
        rank = np.lexsort((best[1], -best[2], best[0]))  # ids ascend, so the index breaks ties
        best = [x[rank] for x in best]
        nth = np.arange(len(rank)) - np.searchsorted(best[0], best[0])
        best = [x[nth < k] for x in best]
        last = nth[nth < k] == k - 1
        theta[best[0][last]] = best[2][last]
    return best[0], order[best[1]], best[2]


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "times": []}).astype("int64")
        if not len(vectors) or not len(queries):
            return empty
        dim = max(map(len, [*vectors["v"], *queries["v"]]))
        q_ids, ids = (x["vec_id"].to_numpy(np.int64) for x in (queries, vectors))
        q_times, times = (np.minimum(x["n"].to_numpy(np.int64), k) for x in (queries, vectors))
        qi, vi, score = shard_top(q_ids, _matrix(queries["v"], dim), ids, _matrix(vectors["v"], dim), k)
        return pd.DataFrame({"query_id": q_ids[qi], "vec_id": ids[vi], "score": score,
                             "times": np.minimum(q_times[qi] * times[vi], k)})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0,
          shard_rows: int = 1024, block_rows: int = 1024) -> DataFrame:
    """For every row of ``vectors`` (vec_id, embedding) that ``is_query`` holds for, the k
    rows of another vec_id with the highest inner product of the integer vectors.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.  A null
    vector, one with a null or non-finite component, or a null vec_id takes no part; a
    shorter vector counts as padded with 0; fewer than k candidates give fewer rows; an empty
    table gives none; texts and other columns are not read.  Every row is a candidate: of a
    repeated vec_id each row counts with its own vector, equal ones as often as they are there.
    Queries of one vec_id give one list, the best of all their pairs.
    Queries (in blocks) meet shards, both of bounded size, whatever the number of rows: rows
    are dealt by id and vector, and those equal in both travel as one with their number.
    """
    all_ = stash(integers(vectors, scale), "search-vectors")
    asked = all_.where(is_query)
    n_shards = max(1, -(-all_.count() // shard_rows))
    n_blocks = max(1, -(-asked.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    left = all_.select("vec_id", "v", "n", deal(n_shards, 1).alias("shard"), every(n_blocks).alias("block"))
    right = asked.select("vec_id", "v", "n", deal(n_blocks, 2).alias("block"), every(n_shards).alias("shard"))
    found = (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
             .applyInPandas(_search(k), "query_id long, vec_id long, score long, times long")
             .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3(vectors: DataFrame) -> DataFrame:
    """``top_k`` of the rows whose vec_id is divisible by 50; awkward rows as stated there."""
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL_OP3 = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5
"""
