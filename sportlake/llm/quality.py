"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its hashed byte n-grams (1 to 3 bytes), weighted by 1 + log(count) and inverse document frequency and brought to
unit length, and five terms for what n-gram counts cannot show: the shares of words like the one before, of repeated word pairs,
of capitals, digits and other marks. A truncated singular value decomposition of all terms of a labelled sample gives the latent space.
The sample's unit vectors are broadcast; every document is projected, its cosine with every sample vector comes from blocked matrix
products, and the nearest neighbours vote with their similarity as weight. A vote counts in inverse proportion to its
label's share of the sample, so the score is the chance of label 1 if both labels were equally common.

The fit reads at most `per_label` documents of each label, the first in order of a hash of the id, one row for each id. Tasks make their
terms, so what comes to the driver is bounded in rows and in bytes (PLACES counts a row) however long the texts are, and so is what
is broadcast. Scoring reads all rows and whole texts.

Nulls, ties and odd rows: a text that is null, empty or blank has no terms and gets score 0, with labels or without. Ties among
neighbours go to the earlier one in the sample, which is in order of ids. A text like no neighbour, and any text without labels to
learn from, scores 0.5. Repeated rows get a row each; an empty table gives no rows. Columns pass through whatever their names are; only a
column named `score` gives way to the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import documents, fold, keeps_columns, labels, mapped, text_bytes, word_hashes

PLACES = 1 << 13
DIMS = 64
NEIGHBOURS = 25
HELD_OUT, FOLDS = 0, 5
THRESHOLD = 0.3
#: Terms that are shares, and their weight beside n-grams of unit length.
SHARES = 5
SHARE_WEIGHT = 1
_SPREAD = np.uint32(0x9E3779B1)
#: Of a byte: 1 capital, 2 digit, 3 other ASCII mark, 0 the rest.
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if 32 < b < 127 and not chr(b).isalnum() else 0 for b in range(256)])


def counts(text: str | None) -> np.ndarray:
    """Counts of hashed n-grams over the whole text."""
    data = text_bytes(text).astype(np.uint32)
    out, code = np.zeros(PLACES, np.int64), data
    for n in range(1, 4):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
        if len(code):
            out += np.bincount(((code + np.uint32(n)) * _SPREAD) >> np.uint32(32 - 13), minlength=PLACES)
    return out


def shape(text: str | None) -> np.ndarray:
    """Shares of the whole text: words like the one before, repeated word pairs, capitals, digits and other ASCII marks among bytes."""
    data = text_bytes(text)
    h = word_hashes(data)
    if not len(h):
        return np.zeros(SHARES, np.float32)
    pairs = h[1:] * np.uint64(3) + h[:-1]
    kinds = np.bincount(_KIND[data], minlength=4) / len(data)
    again = (h[1:] == h[:-1]).mean() if len(h) > 1 else 0.0
    return np.array([again, 1 - len(np.unique(pairs)) / max(1, len(pairs)), *kinds[1:]], np.float32)


def blank(text: str | None) -> bool:
    return not (text or "").strip(" \t\n\x0b\x0c\r")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def terms(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Weighted terms of texts, the shares last."""
    x = np.zeros((len(texts), PLACES + SHARES), np.float32)
    for k, text in enumerate(texts):
        x[k, :PLACES] = counts(text)
        x[k, PLACES:] = SHARE_WEIGHT * shape(text)
    grams = x[:, :PLACES]
    np.log1p(grams, out=grams)
    grams *= idf
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-12)
    return x


class Sample:
    """Terms of the labelled documents: places and counts of their n-grams, row after row, and their shares."""

    def __init__(self, place: np.ndarray, count: np.ndarray, start: np.ndarray, shares: np.ndarray, label: np.ndarray):
        self.place, self.start, self.shares, self.label = place, start, shares, label
        df = np.bincount(place, minlength=PLACES)
        self.idf = (np.log((1 + len(label)) / (1 + df)) + 1).astype(np.float32)
        self.value = np.log1p(count.astype(np.float32)) * self.idf[place]
        row = np.repeat(np.arange(len(label)), np.diff(start))
        self.value /= np.maximum(np.sqrt(np.bincount(row, self.value**2, len(label))), 1e-12).astype(np.float32)[row]

    @classmethod
    def of(cls, texts: list[str | None], label: np.ndarray) -> "Sample":
        every = [counts(t) for t in texts]
        place = [np.flatnonzero(c) for c in every]
        start = np.cumsum([0, *map(len, place)])
        return cls(np.concatenate(place), np.concatenate([c[p] for c, p in zip(every, place, strict=True)]), start, np.stack([shape(t) for t in texts]), label)

    def blocks(self, rows: int = 256) -> Iterator[np.ndarray]:
        for a in range(0, len(self.label), rows):
            b = min(len(self.label), a + rows)
            x = np.zeros((b - a, PLACES + SHARES), np.float32)
            x[:, PLACES:] = SHARE_WEIGHT * self.shares[a:b]
            low, high = self.start[a], self.start[b]
            x[np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1])), self.place[low:high]] = self.value[low:high]
            yield x

    def axes(self) -> np.ndarray:
        """Leading right singular vectors by subspace iteration from a fixed start."""
        q = np.random.default_rng(3).standard_normal((PLACES + SHARES, min(DIMS + 16, len(self.label)))).astype(np.float32)
        for _ in range(6):
            q, _ = np.linalg.qr(sum(x.T @ (x @ q) for x in self.blocks()))
        values, vectors = np.linalg.eigh(sum(y.T @ y for y in (x @ q for x in self.blocks())))
        return np.ascontiguousarray((q @ vectors)[:, np.argsort(values)[::-1][:DIMS]], np.float32)


class Model:
    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, label: np.ndarray):
        self.idf, self.axes, self.vectors, self.label = idf, axes, vectors, label
        self.vote = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9)).astype(np.float32)

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the sample and cosines of each text's nearest neighbours, of equal ones the earlier."""
        near = unit(terms(texts, self.idf) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.empty((len(near), k), np.int64)
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        for row, (x, low) in enumerate(zip(near, least, strict=True)):
            at = np.flatnonzero(x >= low)
            best[row] = at[np.lexsort((at, -x[at]))[:k]]
        return best, np.take_along_axis(near, best, axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best, similarity = self.nearest(texts)
        w = np.maximum(similarity, 0) ** 2 * self.vote[best]
        total = w.sum(axis=1)
        scores = np.where(total > 0, (w * self.label[best]).sum(axis=1) / np.maximum(total, 1e-12), 0.5)
        return np.where([blank(t) for t in texts], 0.0, scores)


def fitted(sample: Sample) -> Model | None:
    if not len(sample.label):
        return None
    axes = sample.axes()
    return Model(sample.idf, axes, unit(np.concatenate([x @ axes for x in sample.blocks()])), sample.label.astype(np.float32))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        every = [counts(t) for t in texts]
        place = [np.flatnonzero(c) for c in every]
        columns = [batch.column("doc_id"), batch.column("quality"), pa.array([p.astype(np.int16) for p in place], pa.list_(pa.int16()))]
        columns += [pa.array([c[p].astype(np.int32) for c, p in zip(every, place, strict=True)], pa.list_(pa.int32())), pa.array([shape(t) for t in texts], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "place", "count", "shares"])


def fit(docs: DataFrame, marks: DataFrame, per_label: int = 1500) -> Model | None:
    marks = marks.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    one = [marks.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(per_label) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(one[0].unionByName(one[1])), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = mapped(texts, _terms_of, "doc_id long, quality int, place array<smallint>, count array<int>, shares array<float>").toArrow().sort_by("doc_id")
    if not len(rows):
        return None
    place, count, shares = (rows.column(k).combine_chunks() for k in ("place", "count", "shares"))
    start = np.concatenate([[0], np.cumsum(place.value_lengths().to_numpy())])
    return fitted(Sample(place.flatten().to_numpy().astype(np.int64), count.flatten().to_numpy(), start, shares.flatten().to_numpy().reshape(-1, SHARES), rows.column("quality").to_numpy()))


def scored(docs: DataFrame, model: Model | None, *keep: str, batch: int = 128) -> DataFrame:
    """The columns named in keep (but one named score), and score, of every row."""
    keep = tuple(c for c in keep if c != "score")
    if model is None:
        return docs.select(*keep, F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), 0.5).otherwise(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # columns go by their places, so that any name does
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").alias("text"))
    schema = rows.drop("text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows in batches:
            scores = np.zeros(len(rows))
            text = rows.column("text")
            for a in range(0, len(rows), batch):
                scores[a : a + batch] = m.scores(text.slice(a, batch).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(scores)], [*rows.schema.names[:-1], "score"])

    return mapped(rows, run, schema).toDF(*keep, "score")


@keeps_columns
def good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns."""
    return scored(docs, model, *docs.columns).filter(F.col("score") >= threshold).drop("score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return scored(docs, fit(docs, labels(spark, sf_dir)), "doc_id").select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
