"""Toxic passages by maximum-scoring segments.

Each word (a run of letters in lower case, hashed; counted once a document) has a log-odds between toxic and other documents under an
informative Dirichlet prior, the prior counts being a tenth of the word's counts in all training text (one of a group of copies); it is
drawn towards 0 by a multiple of its standard error. A word scores its log-odds less a constant drift, a word that was not seen
the drift alone, so clean text falls. A linear scan finds all maximal-scoring segments of a document. Their scores follow an
extreme-value law in clean text: lambda solves the balance equation of the score distribution in clean training documents, K is fitted to
their best segments, and a segment of score S in a text of n words is significant when K n exp(-lambda S) is below a
bound. A document's evidence is the sum of lambda S - ln(K n) over its significant segments; a logistic curve fitted on the training
documents turns it into the score. The labels weigh as in all training labels, not as in the sample, so a text without
evidence gets the share of toxic ones among such texts, and never more than their share of all.

The fit reads at most `per_label` documents of each label, the first in order of a hash of the id, one row for each id. Words, score
distribution and segments are counted by Spark; to the driver come only the words whose log-odds is not drawn to 0 and a row of numbers
for each sampled document. Scoring reads all rows and whole texts.

Nulls, ties and odd rows: a null text, or one without words, has no segment and gets the score of no evidence. Repeated rows get
a row each. Without labels, or with only one of them, every score is 0.5 or that label's share; an empty table gives no rows. Further
columns of docs, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import documents, fold, labels, mapped, mix64, prefix_hash, span_hash, text_bytes, written

HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
PRIOR = 0.1
SHRINK = 1.5
#: What every word loses, so that clean text falls.
DRIFT = 1.0
BOUND = 0.5
#: Scores of words in the distribution are rounded to so many parts of 1.
PARTS = 50
#: Of the logistic curve's slope.
DAMP = 0.05
SAMPLE_PARTS = 12

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def word_starts(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and hash of each run of letters (bytes from 128 count as letters) of the text in lower case."""
    data = text_bytes((text or "").lower())
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    return start, end, span_hash(prefix_hash(data), start, end)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time.

    Runs of one sign act as one step, so the scan takes as many steps as there are positive runs.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    up = scores > 0
    cut = np.flatnonzero(np.diff(up)) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    total = 0.0
    found: list[list] = []  # start, end, sum before, sum after
    links: list[int] = []  # for each: the nearest earlier candidate with a smaller sum before, or -1
    for a, b, x, rising in zip(starts.tolist(), ends.tolist(), sums.tolist(), up[starts].tolist(), strict=True):
        before, total = total, total + x
        if not rising:
            continue
        new = [a, b, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = links[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                links.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], links[j:]
    return [(a, b, after - before) for a, b, before, after in found]


def sketch(words: np.ndarray) -> int:
    """The smallest hash of three words in a row; copies nearly always share it."""
    return int(mix64(words[2:] * np.uint64(9) + words[1:-1] * np.uint64(3) + words[:-2]).min()) if len(words) > 2 else -1 - int(words.sum())


class Model:
    """Words with log-odds (sorted hashes), their log-odds, the law of clean text, and the curve of the score."""

    def __init__(self, words: np.ndarray, odds: np.ndarray, decay: float = 1.0, k: float = 1.0, slope: float = 1.0, offset: float = 0.0):
        self.words, self.odds, self.decay, self.k, self.slope, self.offset = words, odds, decay, k, slope, offset

    def word_scores(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -DRIFT)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.odds[at], 0.0) - DRIFT

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Byte start, byte end and lambda S - ln(K n) of every significant passage."""
        start, end, words = word_starts(text)
        if not len(words):
            return []
        floor = np.log(self.k * len(words))
        found = [(a, b, self.decay * s - floor) for a, b, s in segments(self.word_scores(words))]
        return [(int(start[a]), int(end[b - 1]), e) for a, b, e in found if e > -np.log(BOUND)]

    def evidence(self, text: str | None) -> float:
        return float(sum(e for _, _, e in self.passages(text)))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * np.log1p(evidence) + self.offset))))


def law(scores: np.ndarray, times: np.ndarray, best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """lambda from the scores of words in clean text, and K from the best segments and lengths of clean texts."""
    share = times / max(1, times.sum())
    low, high = 1e-6, 20.0
    for _ in range(80):  # sum of p exp(lambda s) is 1 at 0 and at lambda; below 1 between them
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    decay = min(low, 3.0)
    if not len(best):
        return decay, 1.0
    return decay, max(1e-9, float(np.mean(np.exp(decay * np.minimum(best, np.quantile(best, 0.9))) / length)))


def curve(evidence: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve on log(1 + evidence); share: of toxic ones among all labels.

    One document is added to each side at no evidence in proportion to share, so that a side without such documents has a chance.
    The slope is not negative, and no evidence gets share at most.
    """
    x = np.log1p(np.append(evidence, [0, 0]))
    y = np.append(toxic, [True, False]).astype(float)
    w = np.append(np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean())), [share, 1 - share])
    a = np.stack([x, np.ones(len(x))], axis=1)
    beta = np.array([0.0, np.log(share / (1 - share))])
    for _ in range(100):  # Newton steps of a slightly damped logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - DAMP * beta * [1, 0]
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag([DAMP, 1e-6]), grad)
        beta += np.clip(step, -2, 2)
    return max(0.0, float(beta[0])), min(float(beta[1]), float(np.log(share / (1 - share))))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [word_starts(t.as_py())[2] for t in batch.column("text")]
        columns = [batch.column("doc_id"), batch.column("toxic"), pa.array([sketch(w) & 2**63 - 1 for w in words], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "sketch", "words"])


def log_odds(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted hashes) and their log-odds, without those drawn to 0. sample: doc_id, toxic, text."""
    words = mapped(sample, _words_of, "doc_id long, toxic int, sketch long, words array<long>")
    one = words.groupBy("toxic", "sketch").agg(F.min_by("words", "doc_id").alias("words"))  # one of a group of copies
    counts = written(one.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("c0"), F.sum("toxic").alias("c1")), "word-counts")
    n0, n1 = counts.agg(F.coalesce(F.sum("c0"), F.lit(0)), F.coalesce(F.sum("c1"), F.lit(0))).first()
    prior = PRIOR * (F.col("c0") + F.col("c1"))
    odds = [F.log((F.col(c) + prior) / (F.lit(float(n + PRIOR * (n0 + n1))) - F.col(c) - prior)) for c, n in (("c0", n0), ("c1", n1))]
    error = F.sqrt(1 / (F.col("c0") + prior) + 1 / (F.col("c1") + prior))
    counts = counts.select("word", (odds[1] - odds[0]).alias("z"), (SHRINK * error).alias("e")).filter("abs(z) > e")
    rows = counts.select("word", F.expr("signum(z) * (abs(z) - e)").alias("odds")).toArrow()
    found, odds = rows.column("word").to_numpy().view(np.uint64), rows.column("odds").to_numpy()
    order = np.argsort(found)
    return found[order], odds[order]


def _clean_law(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, length, bins, times = [], [], [], []
            for text in batch.column("text"):
                scores = model.value.word_scores(word_starts(text.as_py())[2])
                values, n = np.unique(np.round(scores * PARTS).astype(np.int32), return_counts=True)
                best.append(max((s for _, _, s in segments(scores)), default=0.0))
                length.append(len(scores))
                bins.append(values)
                times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(length, pa.int64()), pa.array(bins, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["best", "length", "bins", "times"])

    return run


def fit(docs: DataFrame, marks: DataFrame, per_label: int = 3000) -> Model | None:
    spark = docs.sparkSession
    marks = marks.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = marks.agg(F.avg("toxic")).first()[0]
    if share is None:
        return None
    one = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(per_label) for k in (0, 1)]
    sample = texts.join(F.broadcast(one[0].unionByName(one[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = written(sample.repartition(SAMPLE_PARTS, "doc_id"), "toxic-sample")
    if not 0 < share < 1 or sample.select("toxic").distinct().count() < 2:
        share = min(max(share, 0.001), 0.999)
        return Model(np.zeros(0, np.uint64), np.zeros(0), slope=0.0, offset=float(np.log(share / (1 - share))))
    model = Model(*log_odds(sample))
    scored_clean = mapped(sample.filter("toxic = 0").select("text"), _clean_law(spark.sparkContext.broadcast(model)), "best double, length long, bins array<int>, times array<long>")
    clean = written(scored_clean, "clean-law")
    bins = clean.select(F.explode(F.arrays_zip("bins", "times")).alias("x")).groupBy("x.bins").agg(F.sum("x.times").alias("times")).toArrow()
    each = clean.filter("length > 0").select("best", "length").toArrow()
    scores = bins.column("bins").to_numpy() / PARTS
    order = np.argsort(scores)
    model.decay, model.k = law(scores[order], bins.column("times").to_numpy()[order], np.sort(each.column("best").to_numpy()), each.column("length").to_numpy()[np.argsort(each.column("best").to_numpy(), kind="stable")])
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([shared.value.evidence(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "toxic", "evidence"])

    rows = mapped(sample, evidence, "doc_id long, toxic int, evidence double").toArrow().sort_by("doc_id")
    model.slope, model.offset = curve(rows.column("evidence").to_numpy(), rows.column("toxic").to_numpy() == 1, share)
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, and the significant passages (byte start, byte end, evidence) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passages = "array<struct<start:long,end:long,evidence:double>>"
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.array().cast(passages).alias("passages"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows in batches:
            found = [m.passages(t.as_py()) for t in rows.column("text")]
            scores = [m.probability(sum(e for _, _, e in x)) for x in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores, pa.float64()), pa.array([[{"start": a, "end": b, "evidence": e} for a, b, e in x] for x in found], kind)], ["doc_id", "score", "passages"])

    return mapped(rows, run, f"doc_id long, score double, passages {passages}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return scored(docs, fit(docs, labels(spark, sf_dir))).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
