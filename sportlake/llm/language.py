"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum over presence: the number of byte n-grams of 1 to 4 bytes that both hold,
over the geometric mean of the numbers that each holds. N-grams are hashed to 2**16 places. Nyström features against landmark
texts of every language feed one-versus-rest kernel ridge regression. Both steps are linear in the presence vector once that is
normalised, so landmarks and weights fold into one matrix (places by languages) and documents are scored in batches by one
matrix product.

The fit reads at most `per_lang` texts of each language, the first in order of a hash of the id, one row for each id. Tasks list the
places that a text holds, so what comes to the driver is bounded in rows and in bytes (PLACES a row) however long the texts are. The
languages share LANDMARKS landmarks, LEAST of them each at least. Everything else reads all rows and whole texts.

Nulls, ties and odd rows: a null text, and one without a letter, is `und` with score 0. Rows without a language are never
learned from. Equal scores go to the first language in code point order. Repeated rows get a row each; an empty table, or one
with nothing to learn from, gives `und` with score 0 for every row. Further columns of docs, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.llm.common import documents, fold, mapped, text_bytes, text_of

PLACES = 1 << 16
GRAMS = 4
LANDMARKS, LEAST = 256, 4
HELD_OUT, FOLDS = 0, 5
_SPREAD = np.uint32(0x9E3779B1)


def places(text: str | None) -> np.ndarray:
    """Hash places of all n-grams of the text, in lower case for A-Z; repeats included."""
    data = text_bytes(text, lower=True).astype(np.uint32)
    out, code = [], data
    for n in range(1, GRAMS + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
        out.append(((code + np.uint32(n)) * _SPREAD) >> np.uint32(16))
    return np.concatenate(out)


def has_letter(text: str | Column = "text") -> Column:
    return F.coalesce(F.col("text") if isinstance(text, str) else text, F.lit("")).rlike(r"\p{L}")


class Model:
    """languages, and a matrix of PLACES by languages."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) @ self.weights
        p = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)


def fitted(held: list[np.ndarray], langs: list[str], ridge: float = 1e-2) -> Model | None:
    """held: the places that each text holds. Nyström landmarks are the first texts of each language."""
    names = sorted(set(langs))
    if not names:
        return None
    of = np.array([names.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(of == k)[: max(LEAST, LANDMARKS // len(names))] for k in range(len(names))])
    known = np.unique(np.concatenate([held[k] for k in marks]))  # other places are in no landmark

    def rows(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), len(known)), np.float32)
        for row, k in enumerate(which):
            x[row, np.flatnonzero(np.isin(known, held[k], assume_unique=True))] = 1 / max(1, len(held[k])) ** 0.5
        return x

    z = rows(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram, right = ridge * len(held) / len(names) * np.eye(root.shape[1]), np.zeros((root.shape[1], len(names)))
    share = np.array([(of == k).mean() for k in range(len(names))])
    for a in range(0, len(held), 128):  # every language counts alike
        phi = rows(np.arange(a, min(len(held), a + 128))) @ z.T @ root
        w = 1 / (share[of[a : a + 128]] * len(names))
        gram += phi.T @ (phi * w[:, None])
        right += phi.T @ (np.where(of[a : a + 128, None] == np.arange(len(names)), 1.0, -1.0) * w[:, None])
    weights = np.zeros((PLACES, len(names)), np.float32)
    weights[known] = z.T @ (root @ np.linalg.solve(gram, right))
    return Model(names, weights)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [np.unique(places(t.as_py())).astype(np.int32) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(held, pa.list_(pa.int32()))], ["doc_id", "lang", "held"])


def fit(docs: DataFrame, per_lang: int = 200) -> Model | None:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    train = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter() & (fold("doc_id", FOLDS) != HELD_OUT))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id")
    ids = train.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_lang).select("doc_id").distinct()
    texts = train.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("doc_id", "one.lang", "one.text")
    rows = mapped(texts, _held, "doc_id long, lang string, held array<int>").toArrow().sort_by("doc_id")
    return fitted([x.values.to_numpy() for x in rows.column("held")], rows.column("lang").to_pylist())


def predicted(docs: DataFrame, model: Model | None, batch: int = 32) -> DataFrame:
    """Adds lang_pred and score to doc_id of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(has_letter(), F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        x = np.zeros((batch, PLACES), np.float32)
        for rows in batches:
            names, scores = ["und"] * len(rows), np.zeros(len(rows))
            text = rows.column("text")
            with_text = np.flatnonzero(~text.is_null().to_numpy(zero_copy_only=False))
            for a in range(0, len(with_text), batch):
                part = with_text[a : a + batch]
                x[:] = 0
                for k, row in enumerate(part):
                    x[k, places(text[int(row)].as_py())] = 1
                p = m.scores(x[: len(part)])
                for k, row in enumerate(part):
                    best = int(p[k].argmax())
                    names[row], scores[row] = m.names[best], float(p[k, best])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(rows, run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return predicted(docs, fit(docs)).select("doc_id", held_out, "lang_pred", "score")
