"""Approximate nearest neighbours by a permutation index: pivot inverted files, footrule ranking, exact reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Pivots are so many rows of the smallest hashes of the vectors (equal vectors count once).
PIVOTS = 256
#: A vector is posted with its nearest pivots in order, so many (at most 255).
POSTED = 64
#: Of n vectors, a query reranks about RERANKED * n ** GROWTH; the share falls as the nearest of more vectors lie nearer.
RERANKED, GROWTH = 5.0, 0.58
K = 20
#: Rows of an index part and of a block of queries.
PART_ROWS, BLOCK_ROWS = 8_192, 2_048


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: F.coalesce(x, F.lit(0.0)) != 0)


def permutations(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """Per row the numbers of its nearest pivots, nearest first; ties to the smaller number."""
    near = np.round(x @ pivots.T, 9)
    return np.argsort(-near, axis=1, kind="stable")[:, :posted].astype(np.int32)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of components, alike for equal vectors."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += q[d] * x[:, d]
    return total


def search(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int, posted: int, share: float) -> list[tuple[int, int, float]]:
    """(query id, id, score) of the k best of a part for each query; rows should be sorted by id.

    Each pivot's inverted file holds the place that it has with each row, `posted` where it is not listed. A query walks
    the files of its own pivots; footrule, the sum of place differences where an unlisted pivot counts as standing behind
    the last place, falls by twice what the later of both places leaves to the end, for each pivot that both list. The
    nearest share of the part is reranked by the inner product itself.
    """
    own, theirs = permutations(queries, pivots, posted), permutations(rows, pivots, posted)
    n, m = len(rows), theirs.shape[1]
    files = np.full((len(pivots), n), m, np.uint8)
    files[theirs.ravel(), np.repeat(np.arange(n), m)] = np.tile(np.arange(m, dtype=np.uint8), n)
    wanted = min(n, max(10 * k, int(np.ceil(n * share))))
    later, out = np.empty(n, np.uint8), []
    for q, q_id, places in zip(queries, q_ids.tolist(), own, strict=True):
        distance = np.zeros(n, np.int32)
        for place, p in enumerate(places.tolist()):
            np.maximum(files[p], np.uint8(place), out=later)
            distance += later
        found = np.flatnonzero(distance <= np.partition(distance, wanted - 1)[wanted - 1]) if wanted < n else np.arange(n)
        found = found[ids[found] != q_id]
        rough = rows[found] @ q
        if len(found) > k:
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max())]
        score = inner(q, rows[found])
        best = np.lexsort((ids[found], -score))[:k]
        out += [(q_id, int(ids[found[i]]), float(score[i])) for i in best.tolist()]
    return out


def fit_pivots(vectors: DataFrame, vector: str, pivots: int = PIVOTS) -> np.ndarray:
    """A bounded sample of distinct vectors, those of the smallest hashes."""
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).withColumn("h", F.xxhash64("v"))
    rows = rows.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(pivots).collect()
    return np.array([r["v"] for r in rows], float)


def nearest(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, pivots: int = PIVOTS, posted: int = POSTED, reranked: float | None = None) -> DataFrame:
    """Per query its k nearest rows of vectors found: query_id, rank from 1, vec_id, score (inner product).

    Index parts are rows of like hashes of the id, of about 8,192 rows, so that many equal vectors are spread over all
    parts; queries come in blocks of about 2,048. Each part meets each block in a task of its own, whose memory is
    bounded by both; it gives k rows a query, and the best k of all parts remain, ties to the smaller id. `reranked` is
    the share of a part that a query reranks; by default it falls with the number of vectors (RERANKED, GROWTH), as the
    nearest of more vectors lie nearer.

    Vectors of each dimension are searched on their own, with pivots of their own: an inner product needs equal lengths.
    Vectors that are null, empty, zero or hold a null or non-finite component take no part, as queries or as candidates;
    nor do rows with a null id. A query's own id is no candidate of it. Rows that share an id are candidates each. Fewer
    than k candidates are all given; an empty table gives no rows. Extra columns, whatever their names, are not looked at.
    """
    slim = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = slim(vectors), slim(queries)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = None
    for d, n in sizes:
        own = _found(rows.where(F.size("v") == d), asked.where(F.size("v") == d), n, k, pivots, posted, reranked)
        found = own if found is None else found.union(own)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = written(found, "found").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, asked: DataFrame, n: int, k: int, pivots: int, posted: int, reranked: float | None) -> DataFrame:
    """(query_id, vec_id, score): up to k of each index part, for the n vectors of one dimension."""
    table = fit_pivots(rows, "v", pivots)
    n_parts = max(1, -(-n // PART_ROWS))
    n_blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    deal = lambda df, own, other, a, b, salt: df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(a)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    parts = deal(rows, "part", "block", n_parts, n_blocks, 1).groupBy("part", "block")
    blocks = deal(asked, "block", "part", n_blocks, n_parts, 2).groupBy("part", "block")
    return parts.cogroup(blocks).applyInPandas(_meeting(table, k, posted, min(1.0, RERANKED * n ** (GROWTH - 1)) if reranked is None else reranked), "query_id long, vec_id long, score double")


def _meeting(table: np.ndarray, k: int, posted: int, share: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def kernel(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        rows = rows.sort_values("id", kind="stable")
        x, q = np.stack(rows["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        got = search(q, asked["id"].to_numpy(), x, rows["id"].to_numpy(), table, k, posted, share)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return kernel


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
