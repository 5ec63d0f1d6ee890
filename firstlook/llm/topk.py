"""Exact top-k search by inner product, exhaustive and term at a time.

Vectors are sparse rows of integer weights. Candidates are cut into blocks and stored by term as postings (row, weight). For a group of
queries, each term's postings are scattered, times the queries' weights, into dense score arrays over the block; a partition
selection keeps the k best of a block, and the blocks' winners are merged by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

CANDIDATES_A_BLOCK = 16_384
QUERIES_A_BLOCK = 2_048
SCORES_AT_ONCE = 1 << 19
_FOUND = "query_id long, vec_id long, score long"


def whole_weights(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null for a vector that is null or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _weights(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero weights, by row and term."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    weight = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = weight != 0
    return row[used], term[used], weight[used]


def _best(query_ids: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each query's row of scores, without the query's own row; ties go to smaller ids."""
    own = query_ids[:, None] == vec_ids[None, :]
    lowest = np.iinfo(np.int64).min
    scores[own] = lowest
    keep = min(k, scores.shape[1])
    bar = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    q, c = np.nonzero((scores >= bar[:, None]) & ~own)
    value = scores[q, c]
    order = np.lexsort((vec_ids[c], -value, q))
    q, c, value = q[order], c[order], value[order]
    first = np.searchsorted(q, np.arange(len(query_ids)))
    rank = np.arange(len(q)) - first[q]
    top = rank < k
    return query_ids[q[top]], vec_ids[c[top]], value[top]


def _block_search(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(candidates):
            vec_ids = candidates["id"].to_numpy()
            row, term, weight = _weights(candidates["weights"])
            by_term = np.argsort(term, kind="stable")
            row, term, weight = row[by_term], term[by_term], weight[by_term]
            step = max(1, SCORES_AT_ONCE // len(vec_ids))
            for start in range(0, len(queries), step):
                some = queries.slice(start, step)
                scores = np.zeros((len(some), len(vec_ids)), np.int64)
                q_row, q_term, q_weight = _weights(some["weights"])
                by_q_term = np.argsort(q_term, kind="stable")
                q_row, q_term, q_weight = q_row[by_q_term], q_term[by_q_term], q_weight[by_q_term]
                for t in np.unique(q_term):
                    lo, hi = np.searchsorted(term, [t, t + 1])
                    a, b = np.searchsorted(q_term, [t, t + 1])
                    if hi - lo == len(vec_ids):
                        for q, w in zip(q_row[a:b], q_weight[a:b]):
                            scores[q] += w * weight[lo:hi]
                    else:
                        for q, w in zip(q_row[a:b], q_weight[a:b]):
                            scores[q, row[lo:hi]] += w * weight[lo:hi]
                found.append(_best(some["id"].to_numpy(), vec_ids, scores, k))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in columns))))

    return search


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id.

    Both tables bring id long and weights array<long>; other columns are ignored. Rows whose id or weights are null take no part. A
    missing component counts as zero, so vectors may differ in length. Candidates with the query's own id are not answers to it;
    candidates that repeat an id are rows of their own. A query with fewer than k candidates gets all; an empty table gives no rows.
    """
    queries, candidates = (
        t.select("id", "weights").filter(F.col("id").isNotNull() & F.col("weights").isNotNull()) for t in (queries, candidates)
    )
    count = candidates.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    blocks = -(-count[0] // CANDIDATES_A_BLOCK) or 1
    groups = -(-count[1] // QUERIES_A_BLOCK) or 1

    def dealt(t: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id", F.lit(own)), F.lit(own_parts))
        return t.select("id", "weights", part.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_parts - 1).cast("long"))).alias(other))

    found = (
        dealt(queries, "query_group", groups, "block", blocks).groupBy("query_group", "block")
        .cogroup(dealt(candidates, "block", blocks, "query_group", groups).groupBy("query_group", "block"))
        .applyInArrow(_block_search(k), _FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
