"""Approximate nearest neighbours by a permutation index: pivot orders, inverted files, footrule, exact rerank."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0)


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """For each vector its ``depth`` nearest pivots, nearest first, ties to the smaller number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :depth]


class InvertedFiles:
    """For each pivot the vectors that have it among their nearest, and its place in their order."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.n, self.depth = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
        self.vector, self.place = by_pivot // self.depth, by_pivot % self.depth

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distances of all vectors from a query's order: sums of place differences, where a pivot that an order lacks
        has the place ``depth``. Only the files of the query's pivots are read: a vector that is in none is at the
        greatest distance, and each common pivot lowers it by twice what the later of its two places lacks of ``depth``.
        """
        parts = [slice(self.starts[p], self.starts[p + 1]) for p in order]
        mine = np.repeat(np.arange(len(order)), [s.stop - s.start for s in parts])
        nearer = self.depth - np.maximum(mine, np.concatenate([self.place[s] for s in parts]))
        common = np.bincount(np.concatenate([self.vector[s] for s in parts]), weights=nearer, minlength=self.n)
        return self.depth * (self.depth + 1) - 2 * common


def search(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = 512, depth: int = 128, block: int = 4096, reranked: int = 320, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``is_query`` its ``k`` nearest other rows by cosine.

    Rows need vec_id and embedding; other columns are ignored. Nearest first, ties to the smaller vec_id; the score is
    the cosine of the original vectors in double precision. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows of null vec_id. A cosine needs vectors of one length, so those of each number
    of components are searched on their own. If fewer than ``k`` candidates exist, all are returned. Rows that repeat a vec_id are queries and candidates of their own:
    each query's results are ranked by themselves, and it leaves out one row of its id and vector, itself.

    Equal vectors are indexed once, with their k + 1 smallest ids (no result needs more). A vector is represented by
    the order of its ``depth`` nearest pivots; the pivots are ``n_pivots`` vectors of the smallest hashes. Vectors are
    dealt into blocks of about ``block``, queries into blocks of ``query_block``; a task takes one block of each, posts
    its vectors in the pivots' inverted files, ranks by footrule distance and reranks the first ``reranked`` exactly.
    So every row is indexed, a task's memory is bounded, and no vector is skipped because its cell is full.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    sizes = [r["size"] for r in rows.select(F.size("embedding").alias("size")).distinct().collect()]
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_search(rows.where(F.size("embedding") == size), k, n_pivots, depth, block, reranked, query_block) for size in sorted(sizes)]
    return reduce(DataFrame.union, parts)


def _search(rows: DataFrame, k: int, n_pivots: int, depth: int, block: int, reranked: int, query_block: int) -> DataFrame:
    """``search`` of rows (vec_id, embedding, is_query) whose vectors have one length."""
    rows = rows.withColumn("key", F.sha2(F.concat_ws(",", "embedding"), 256))
    few = Window.partitionBy("key").orderBy("vec_id")
    smallest = rows.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
    distinct = stored(smallest.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
    n = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("key"), "key").limit(n_pivots).select("embedding").collect()
    pivots = np.array([r[0] for r in chosen])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    depth = min(depth, len(pivots))
    blocks = max(1, -(-n // block))
    # Queries of one id are told apart by vector and number.
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("key"))
    queries = rows.where("is_query").select("vec_id", copy.alias("copy_no"), "key", "embedding")
    query_blocks = max(1, -(-queries.count() // query_block))

    def both(df: DataFrame, seed: Column, other: int, own: int, name: str, other_name: str) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(seed), F.lit(own)).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = both(queries, F.col("vec_id"), blocks, query_blocks, "q", "v")
    right = both(distinct.select("key", "ids", "embedding"), F.col("ids")[0], query_blocks, blocks, "v", "q")

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("ids", key=lambda ids: ids.str[0], ignore_index=True)
            x, y = np.stack(held.embedding.to_list()), np.stack(asked.embedding.to_list())
            norms, own_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            files = InvertedFiles(pivot_orders(x / norms[:, None], sent.value, depth), len(sent.value))
            orders = pivot_orders(y / own_norms[:, None], sent.value, depth)
            for i, (query, copy, key) in enumerate(zip(asked.vec_id, asked.copy_no, asked.key, strict=True)):
                near = np.argsort(files.footrule(orders[i]), kind="stable")[:reranked]
                scores = (x[near] * y[i]).sum(axis=1) / (norms[near] * own_norms[i])
                for j in np.lexsort((near, -scores))[: k + 1]:
                    ids = list(held.ids[near[j]])
                    if held.key[near[j]] == key and query in ids:
                        ids.remove(query)
                    out += [(query, copy, found, scores[j]) for found in ids]
        return pd.DataFrame(out, columns=["query_id", "copy_no", "vec_id", "score"])

    found = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(nearest, "query_id long, copy_no int, vec_id long, score double")
    best = Window.partitionBy("query_id", "copy_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
