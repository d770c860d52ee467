"""Approximate vector search by an inverted file of trained cells with short codes.

Cells and code books are trained on a bounded sample of the unit vectors. Every vector stands in the list of its nearest cell, with a code of a
few bytes for what the cell's centre leaves of it. A query scans the lists of the cells nearest to it, scored by codes; the best of these are
scored exactly. How many cells a query probes is calibrated on the sample: the fewest for which a stated share of true neighbours lies in probed cells (vectors
without any structure need most cells, and then the codes carry the search).

The index is a table in the shared folder, its rows in order of cells, so a scan of few cells reads few row groups; the model lies beside it, and both are loaded
again by later searches. Vectors that are NULL, empty, hold a NULL or have another length than most are not indexed; a zero vector scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.sources.io import shared_folder

#: Rows of the sample that trains the index, at most.
SAMPLE = 65_536
#: Rounds of training.
ROUNDS = 10
#: Sampled queries that calibrate the number of probes.
PROBES_FROM = 256


def trained(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most k cells, by Lloyd's rounds; an empty cell keeps its centre."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at = nearest_centre(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[k : k + 4096] @ c.T - half).argmax(axis=1) for k in range(0, len(x), 4096))])


@dataclass
class Model:
    """cells: centres; books: for each part of a vector the centres of its code; probes: cells that a query scans."""

    cells: np.ndarray
    books: np.ndarray
    probes: int

    @classmethod
    def fit(cls, x: np.ndarray, cells: int | None = None, parts: int = 16, codes: int = 256, target: float = 0.97, k: int = 10, seed: int = 5) -> Model:
        """x: unit vectors. target: share of the k nearest in the sample that probed cells should hold."""
        rng, dim = np.random.default_rng(seed), x.shape[1]
        centres = trained(x, cells or max(1, int(len(x) ** 0.5)), rng)
        at = nearest_centre(x, centres)
        left = x - centres[at]
        parts = max(p for p in range(1, min(parts, dim) + 1) if dim % p == 0)
        width = dim // parts
        books = np.stack([padded(trained(left[:, m * width : (m + 1) * width], codes, rng), codes) for m in range(parts)])
        asked = x[rng.choice(len(x), min(PROBES_FROM, len(x)), replace=False)]
        near = np.argsort(-(asked @ x.T), axis=1)[:, :k]
        rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each cell, for each query
        needed = np.sort(np.take_along_axis(rank, at[near], axis=1).ravel())
        return cls(centres, books, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each unit vector."""
        at = nearest_centre(x, self.cells)
        left, width = x - self.cells[at], self.books.shape[2]
        return at, np.stack([nearest_centre(left[:, m * width : (m + 1) * width], b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        return self.cells[cell] + np.concatenate([b[code[:, m]] for m, b in enumerate(self.books)], axis=1)


def padded(book: np.ndarray, codes: int) -> np.ndarray:
    """A book of a short sample, its last centre repeated."""
    return np.concatenate([book, np.repeat(book[-1:], codes - len(book), axis=0)])


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return (x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]).astype(np.float32)


def whole(base: DataFrame) -> DataFrame:
    return base.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") > 0) & F.coalesce(F.forall("embedding", lambda c: c.isNotNull()), F.lit(False)))


@dataclass
class Index:
    """A stored index: the folder of its lists and its model."""

    spark: SparkSession
    folder: str
    model: Model

    @property
    def dim(self) -> int:
        return self.model.cells.shape[1]

    def lists(self) -> DataFrame:
        """cell, vec_id, code of every indexed vector."""
        return self.spark.read.parquet(f"{self.folder}/lists")


def build(base: DataFrame, folder: str | None = None, **fit) -> Index | None:
    """Train on a sample of base (vec_id, embedding) and index every vector; None if there is none. fit: see Model.fit."""
    spark, folder, rows = base.sparkSession, folder or shared_folder(base.sparkSession), whole(base)
    length = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if length is None:
        return None
    dim = length["dim"]
    rows = rows.filter(F.size("embedding") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    model = Model.fit(unit(sample.column("embedding").combine_chunks(), dim), **fit)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, code = shared.value.encode(unit(b.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "vec_id", "code"])

    lists = rows.mapInArrow(run, "cell int, vec_id long, code binary")
    lists.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/lists")
    books = [(np.asarray(a, np.float64).ravel().tolist(), list(a.shape)) for a in (model.cells, model.books)]
    spark.createDataFrame([(books[0][0], books[0][1], books[1][0], books[1][1], model.probes)], "cells array<double>, cells_shape array<int>, books array<double>, books_shape array<int>, probes int").write.mode("overwrite").parquet(f"{folder}/model")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Index:
    r = spark.read.parquet(f"{folder}/model").first()
    shaped = lambda a, shape: np.array(a, np.float32).reshape(shape)
    return Index(spark, folder, Model(shaped(r["cells"], r["cells_shape"]), shaped(r["books"], r["books_shape"]), r["probes"]))


def candidates(index: Index, queries: DataFrame, n: int, probes: int | None = None, most: int = 10_000) -> DataFrame:
    """q_id, vec_id: the n of each query with the best codes in the cells that it probes. Queries go in broadcasts of about `most` at a time."""
    asked, dim, out = whole(queries).filter(F.size("embedding") == index.dim), index.dim, None
    probes = min(probes or index.model.probes, len(index.model.cells))
    parts = -(-asked.count() // most)
    for part in range(parts):
        mine = (asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)).toArrow()
        ids, q = mine.column("vec_id").to_numpy(), unit(mine.column("embedding").combine_chunks(), dim)
        nearest = np.argsort(-(q @ index.model.cells.T), axis=1, kind="stable")[:, :probes]
        shared = index.spark.sparkContext.broadcast((index.model, ids, q, nearest))
        lists = index.lists()
        wanted = np.unique(nearest)
        if len(wanted) < len(index.model.cells):
            lists = lists.filter(F.col("cell").isin(wanted.tolist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            model, ids, q, nearest = shared.value
            asks: list[list[int]] = [[] for _ in model.cells]
            for k, row in enumerate(nearest.tolist()):
                for c in row:
                    asks[c].append(k)
            held = [(np.zeros(0, np.float32), np.zeros(0, np.int64)) for _ in ids]
            for b in batches:
                cell = b.column("cell").to_numpy()
                name = b.column("vec_id").to_numpy()
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)
                for c in np.unique(cell).tolist():
                    here = np.flatnonzero(cell == c)
                    if asks[c]:
                        score = q[asks[c]] @ model.decode(cell[here], code[here]).T
                        for k, s in zip(asks[c], score, strict=True):
                            s, v = np.concatenate([held[k][0], s]), np.concatenate([held[k][1], name[here]])
                            if len(s) > 4 * n:
                                best = np.argpartition(-s, n - 1)[:n]
                                s, v = s[best], v[best]
                            held[k] = s, v
            for k, (s, v) in enumerate(held):
                if len(s):
                    best = np.lexsort((v, -s))[:n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids[k])), pa.array(v[best]), pa.array(s[best].astype(np.float64))], ["q_id", "vec_id", "approx"])

        found = lists.mapInArrow(run, "q_id long, vec_id long, approx double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.spark.createDataFrame([], "q_id long, vec_id long")
    best = Window.partitionBy("q_id").orderBy(F.col("approx").desc(), "vec_id")
    return out.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n).select("q_id", "vec_id")


def search(index: Index | None, base: DataFrame, queries: DataFrame, k: int = 10, rescored: int | None = None, probes: int | None = None) -> DataFrame:
    """q_id, vec_id, score, rank: the k best of each query among its candidates by exact cosine, ties by id. rescored: candidates of each query, 12 k if not given."""
    if index is None:
        return base.sparkSession.createDataFrame([], "q_id long, vec_id long, score double, rank int")
    pairs = candidates(index, queries, rescored or 12 * k, probes)
    vectors = whole(base)
    pairs = pairs.join(vectors, "vec_id").join(whole(queries).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("asked")), "q_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot("embedding", "embedding") * dot("asked", "asked"))
    score = F.round(dot("embedding", "asked") / F.when(length == 0, 1.0).otherwise(length), 9)
    best = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.select("q_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
