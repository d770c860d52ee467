"""Similarity of embedding vectors by blocked matrix products; an inverted file for large bases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sportlake.functions.text import normalize_name
from sportlake.operators import vector_index


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


class _Queries:
    """Queries as matrices by length of vector."""

    def __init__(self, rows: list):
        self.by: dict[int, tuple] = {}
        for size in sorted({len(r["embedding"]) for r in rows}):
            mine = [r for r in rows if len(r["embedding"]) == size]
            x = np.array([[np.nan if v is None else v for v in r["embedding"]] for r in mine], np.float64).reshape(len(mine), size)
            label = np.array([np.nan if r["label"] is None else r["label"] for r in mine], np.float64)
            self.by[size] = np.array([r["vec_id"] for r in mine], np.int64), label, x, np.sqrt((x * x).sum(axis=1))

    def blocks(self, batch: pa.RecordBatch, cosine: bool, rows: int = 1024) -> Iterator[tuple]:
        """For blocks of base rows and the queries of their length: ids and labels of both, and rounded scores (queries by rows), NaN where there is none."""
        vectors = batch.column("embedding")
        size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        ids, label = batch.column("vec_id").to_numpy(), batch.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False)
        for one, (q_id, q_label, q, q_norm) in self.by.items():
            # an empty vector has cosine -1 with any other, and no inner product
            empty = np.flatnonzero(size == 0 if one else size >= 0) if cosine else np.zeros(0, np.int64)
            same = np.flatnonzero(size == one) if one else np.zeros(0, np.int64)
            for low in range(0, len(empty), rows):
                part = empty[low : low + rows]
                yield q_id, q_label, ids[part], label[part], np.full((len(q_id), len(part)), -1.0)
            for low in range(0, len(same), rows):
                part = same[low : low + rows]
                x = vectors.take(pa.array(part)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(part), one)
                score = q @ x.T
                if cosine:
                    length = q_norm[:, None] * np.sqrt((x * x).sum(axis=1))[None]
                    score = score / np.where(length == 0, 1.0, length)
                yield q_id, q_label, ids[part], label[part], np.round(score, 9)


def _query_parts(queries: DataFrame, most: int) -> Iterator[Broadcast]:
    """The queries (vec_id, embedding, label), at most about `most` of them in a broadcast, by hash."""
    q = queries.select("vec_id", "embedding", "label").filter("embedding IS NOT NULL")
    parts = -(-q.count() // most)
    for part in range(parts):
        mine = q if parts == 1 else q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
        yield q.sparkSession.sparkContext.broadcast(_Queries(mine.collect()))


def _over(base: DataFrame, queries: DataFrame, made: Callable, schema: str, most: int) -> DataFrame:
    rows = base.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    out = None
    for shared in _query_parts(queries, most):
        part = rows.mapInArrow(made(shared), schema)
        out = part if out is None else out.unionByName(part)
    return base.sparkSession.createDataFrame([], schema) if out is None else out


def nearest(base: DataFrame, queries: DataFrame, k: int, cosine: bool, same_label: bool = False, most: int = 10_000) -> DataFrame:
    """q_id, vec_id, score, rank: the k best of each query, ties by id.

    Blocks of the base are multiplied with all queries of a broadcast; a task keeps its k best of each query, and the best of these are
    taken at last. Vectors of different lengths are not compared; those that are NULL or hold a NULL are left out. Cosines of empty
    vectors are -1, a zero norm counts as 1.
    """

    def made(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for q_id, q_label, ids, label, score in shared.value.blocks(batch, cosine):
                    score = np.where(np.isnan(score) | (same_label and q_label[:, None] != label[None]), -np.inf, score)
                    key = len(q_id), int(q_id[0])
                    old_id, old = held.get(key, (np.zeros((len(q_id), 0), np.int64), np.zeros((len(q_id), 0))))
                    every, name = np.hstack([old, score]), np.hstack([old_id, np.broadcast_to(ids, score.shape)])
                    if every.shape[1] > 4 * k:  # whatever ties with the k-th best stays until the ids decide
                        least = np.partition(every, every.shape[1] - k, axis=1)[:, every.shape[1] - k]
                        wide = int((every >= least[:, None]).sum(axis=1).max())
                        if wide < every.shape[1]:
                            order = np.argsort(-every, axis=1, kind="stable")[:, :wide]
                            every, name = np.take_along_axis(every, order, axis=1), np.take_along_axis(name, order, axis=1)
                    order = np.lexsort((name, -every), axis=1)[:, :k]
                    held[key] = np.take_along_axis(name, order, axis=1), np.take_along_axis(every, order, axis=1)
                    shared_ids[key] = q_id
            for key, (name, score) in held.items():
                fine = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(shared_ids[key][:, None], score.shape)[fine]), pa.array(name[fine]), pa.array(score[fine])], ["q_id", "vec_id", "score"])

        shared_ids: dict[tuple, np.ndarray] = {}
        return run

    near = _over(base, queries, made, "q_id long, vec_id long, score double", most)
    best = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties by id. Parts of the base are cut to k first, so no task sees a query's whole row of pairs."""
    best = [F.col("score").desc(), F.col("vec_id")]
    parts = pairs.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    near = parts.withColumn("_r", F.row_number().over(Window.partitionBy("q_id", "_part").orderBy(*best))).filter(F.col("_r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*best))).filter(F.col("rank") <= k).drop("_r", "_part")


def cosine_top_k(base: DataFrame, queries: DataFrame, k: int = 10, most: int = 10_000) -> DataFrame:
    return nearest(base, queries, k, cosine=True, most=most)


def inner_product_top_k(base: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Only vectors of the query's kind (label)."""
    return nearest(base, queries, k, cosine=False, same_label=True)


def cosine_hints(base: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.18) -> DataFrame:
    return cosine_top_k(base, queries, k).filter(F.col("score") >= least)


#: Bounds of accept and review, of players and of others.
BANDS = {True: (0.85, 0.60), False: (0.70, 0.50)}


def band_counts(base: DataFrame, queries: DataFrame, players: Callable[[np.ndarray], np.ndarray], most: int = 10_000) -> DataFrame:
    """label, band, n: how many pairs of a vector of the base (by label) and a query are accepted, reviewed or rejected. players: which labels are players'."""
    names = np.array(["reject", "review", "accept"])

    def made(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, _, label, score in shared.value.blocks(batch, True):
                    player = players(label)
                    high, low = (np.where(player, BANDS[True][k], BANDS[False][k]) for k in (0, 1))
                    band = (score >= low[None]).astype(np.int64) + (score >= high[None])
                    kinds, at = np.unique(np.nan_to_num(label, nan=-1).astype(np.int64), return_inverse=True)
                    n = np.bincount((at[None] * 3 + band)[~np.isnan(score)], minlength=3 * len(kinds))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(kinds, 3)), pa.array(np.tile(names, len(kinds))), pa.array(n)], ["label", "band", "n"])

        return run

    counts = _over(base, queries, made, "label long, band string, n long", most)
    return counts.groupBy("label", "band").agg(F.sum("n").alias("n")).filter("n > 0")


def match_band(score: Column, kind: Column) -> Column:
    """accept, review or reject by the kind's two bounds."""
    high, low = F.when(kind == "player", 0.85).otherwise(0.70), F.when(kind == "player", 0.60).otherwise(0.50)
    return F.when(score >= high, "accept").when(score >= low, "review").otherwise("reject")


def missing_embeddings(base: DataFrame, embedded: DataFrame, key: str, batch: int) -> DataFrame:
    """Entities without a vector, with a batch number by hash: batches of about that size."""
    rows = base.select(key).join(embedded.select(key).distinct(), key, "left_anti")
    total = rows.agg(F.ceil(F.count("*") / batch).alias("_n"))
    return rows.crossJoin(F.broadcast(total)).withColumn("batch", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.greatest(F.lit(1).cast("long"), "_n"))).drop("_n")


def approx_top_k(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each query by an inverted file with codes, built for this search; vector_index keeps one for many."""
    return vector_index.search(vector_index.build(base), base, queries, k)


def mentions(texts: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """Entities (entity_id, name) named in a text: a token of three letters or more of the name is a token of the text."""
    tokens = lambda df, k, c: df.select(k, F.explode(F.array_distinct(F.split(normalize_name(F.col(c)), " "))).alias("token")).filter("length(token) >= 3")
    return tokens(texts, key, "text").join(tokens(entities, "entity_id", "name"), "token").select(key, "entity_id").distinct()
