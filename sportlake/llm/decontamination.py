"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Items are indexed by length, in classes of one to two times as many words. Every passage of every text is a query of each class: windows
of twice the class's longest possible item, one starting every so many words, so each occurrence of an item lies whole in a window. A
posting's impact is the item's BM25 weight of the term over the sum of its weights, so scores run from 0 to 1. Postings stand in blocks
with their largest impact, and WAND skips blocks that cannot reach the threshold. Before that, one array operation over a whole
batch of texts drops the passages in which no item can: an item's rarest terms are its essential ones, the others together stay below
what an item may miss, and essential terms found in a passage plus all others bound the item's score from above. All items above
the threshold are then verified: the share of the question's five-word shingles that the passage holds, and that the answer, where the
items have one, follows in the same text.

Document frequencies and the mean length are taken over all items. The index of at most `most_items` items and `most_words` words is
broadcast at a time; more items are split by a hash, each part with its own pass, which changes no score.

Words are runs of letters and digits. Nulls, ties and odd rows: null and empty texts or items match nothing; an item of fewer than five
words is one shingle, found wherever it stands whole. A null or blank answer is none; one longer than the text does not stand in it; an item whose answer is of marks only cannot be verified and is not reported.
Repeated items are found each, repeated rows get rows each. Empty tables give no rows. Further columns, whatever their names, are ignored
by leaks() and kept by clean_documents().
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import documents, keeps_columns, mapped, prefix_hash, span_hash, text_bytes, written

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 64
#: Share of an item's weight that its other, commoner terms may have.
OTHERS = 0.3

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_starts(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and hash of each run of letters and digits (bytes from 128 count as letters) of the text in lower case."""
    data = text_bytes((text or "").lower())
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of so many words in a row; of all words if there are fewer."""
    if not len(words):
        return words
    n = min(width, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    return h


class Items:
    """What is known of all items: their number and mean length, and in how many of them terms (sorted hashes) stand."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.terms, self.df = n, max(mean, 1e-9), terms, df

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        words = [word_starts(t)[2] for t in texts]
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(w) for w in words]]), return_counts=True)
        return cls(len(texts), sum(map(len, words)) / max(1, len(words)), terms, df)


class Index:
    """Terms (sorted hashes) with postings (item, impact) in blocks, and what each item needs for verification."""

    def __init__(self, ids: list[int], texts: list[str | None], answers: list[str | None] | None = None, known: Items | None = None):
        self.ids, known = ids, known or Items.of(texts)
        words = [word_starts(t)[2] for t in texts]
        self.question, self.width = [np.unique(shingles(w)) for w in words], [min(SHINGLE, len(w)) for w in words]
        self.answer = [word_starts(a)[2] for a in answers] if answers else [np.zeros(0, np.uint64)] * len(ids)
        self.unverified = [bool((a or "").strip()) and not len(w) for a, w in zip(answers or [None] * len(ids), self.answer, strict=True)]
        self.longest = max((len(w) for w in words), default=0)
        length = np.array([len(w) for w in words], float)
        tf = [np.unique(w, return_counts=True) for w in words]
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in tf]]))
        term = np.concatenate([np.zeros(0, np.int64), *[np.searchsorted(self.terms, t) for t, _ in tf]])
        item = np.repeat(np.arange(len(ids)), [len(t) for t, _ in tf])
        count = np.concatenate([np.zeros(0), *[c for _, c in tf]])
        df = known.df[np.searchsorted(known.terms, self.terms)]
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * (length / known.mean)[item])) if len(item) else count
        impact = weight / np.bincount(item, weight, len(ids))[item] if len(item) else weight

        order = np.lexsort((impact, item))  # an item's commonest terms, up to OTHERS of its weight, are not essential
        total = np.concatenate([[0], np.cumsum(impact[order])])
        before = total[1:] - total[np.searchsorted(item[order], np.arange(len(ids)))][item[order]]
        essential = np.zeros(len(item), bool)
        essential[order] = before > OTHERS
        self.others = np.bincount(item[~essential], impact[~essential], len(ids))

        order = np.lexsort((item, term))
        self.item, self.impact, essential = item[order], impact[order], essential[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        e_term = term[order][essential]
        self.e_item, self.e_impact = self.item[essential], self.impact[essential]
        self.e_terms, at = np.unique(self.terms[e_term], return_index=True)
        self.e_first = np.append(at, len(e_term))
        self.lists: dict[int, tuple] = {}
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.e_terms >> np.uint64(44)).astype(np.int64)] = True

    def passages(self, words: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Documents and numbers of the passages (rows of two) in which some item can reach the threshold. words with their document and place."""
        hit = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.e_terms, words[hit]), max(0, len(self.e_terms) - 1))
        real = self.e_terms[place] == words[hit] if len(self.e_terms) else np.zeros(0, bool)
        hit, place = hit[real], place[real]
        number = at[hit] // self.longest
        doc, number, place = np.concatenate([doc[hit], doc[hit]]), np.concatenate([number, number - 1]), np.concatenate([place, place])
        doc, number, place = doc[number >= 0], number[number >= 0], place[number >= 0]
        if not len(doc):
            return np.zeros((0, 2), np.int64)
        width = int(number.max()) + 1
        passage, of = np.unique(doc * width + number, return_inverse=True)
        rows = np.unique(of * len(self.e_terms) + place)
        of, place = rows // len(self.e_terms), rows % len(self.e_terms)
        n = self.e_first[place + 1] - self.e_first[place]
        row = np.repeat(np.arange(len(rows)), n)
        posting = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.e_first[place[row]]
        keys, at = np.unique(of[row] * len(self.ids) + self.e_item[posting], return_inverse=True)
        score = np.bincount(at, self.e_impact[posting], len(keys)) + self.others[keys % len(self.ids)]
        passage = passage[np.unique(keys[score >= THRESHOLD - 1e-9] // len(self.ids))]
        return np.stack([passage // width, passage % width], axis=1)

    def wand(self, words: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items that score the threshold or more for the words as a query, by block-max WAND."""
        terms = np.unique(words)
        place = np.searchsorted(self.terms, terms)
        place = place[(place < len(self.terms)) & (self.terms[np.minimum(place, len(self.terms) - 1)] == terms)]
        cursors = [[0, *self.postings(p)] for p in place.tolist()]  # position, items, impacts, block maxima, largest impact
        bound, found = threshold - 1e-9, []
        while True:
            cursors = sorted((c for c in cursors if c[0] < len(c[1])), key=lambda c: c[1][c[0]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[4]
                if total >= bound:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == target:
                pivot += 1
            block, until = 0.0, None  # the sum of block maxima at the target, and the first item past one of those blocks
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(c[1], target, c[0])
                if c[0] < len(c[1]):
                    b = c[0] // BLOCK
                    block += c[3][b]
                    end = c[1][min(len(c[1]), (b + 1) * BLOCK) - 1] + 1
                    until = end if until is None else min(until, end)
            if block >= bound:
                score = sum(c[2][c[0]] for c in cursors[: pivot + 1] if c[0] < len(c[1]) and c[1][c[0]] == target)
                if score >= bound:
                    found.append((target, score))
                until = target + 1
            elif pivot + 1 < len(cursors):
                until = min(until, cursors[pivot + 1][1][cursors[pivot + 1][0]])
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(c[1], max(until, target + 1), c[0])

    def postings(self, p: int) -> tuple[list[int], list[float], list[float], float]:
        """Items, impacts, largest impact of each block and of all, of a term."""
        if p not in self.lists:
            a, b = int(self.first[p]), int(self.first[p + 1])
            impacts = self.impact[a:b].tolist()
            self.lists[p] = self.item[a:b].tolist(), impacts, [max(impacts[k : k + BLOCK]) for k in range(0, b - a, BLOCK)], max(impacts)
        return self.lists[p]

    def overlap(self, k: int, passage: np.ndarray, text: np.ndarray) -> float:
        """Share of the question's shingles in the passage; 0 if its answer does not stand in the text or cannot be looked for."""
        wanted, answer, n = self.question[k], self.answer[k], self.width[k]
        share = float(np.isin(wanted, shingles(passage, n)).mean()) if n and len(passage) >= n else 0.0
        if self.unverified[k]:
            return 0.0
        if len(answer) and share:
            places = np.flatnonzero(text[: max(0, len(text) - len(answer) + 1)] == answer[0])
            share *= any((text[p : p + len(answer)] == answer).all() for p in places)
        return share


def by_length(ids: list[int], texts: list[str | None], answers: list[str | None] | None, known: Items) -> list[Index]:
    """An index for each class of lengths, whose windows are those of the longest possible item; items without words are in none."""
    classes: dict[int, list[int]] = {}
    for k, text in enumerate(texts):
        classes.setdefault(len(word_starts(text)[2]).bit_length(), []).append(k)
    found = []
    for size, at in sorted(classes.items()):
        if size:
            found.append(Index([ids[k] for k in at], [texts[k] for k in at], [answers[k] for k in at] if answers else None, known))
            found[-1].longest = (1 << size) - 1
    return found


def _matches(indexes: Broadcast, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for low in range(0, len(batch), 256):
                texts = [word_starts(t.as_py())[2] for t in column.slice(low, 256)]
                n = np.array([len(w) for w in texts])
                doc = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                words = np.concatenate([np.zeros(0, np.uint64), *texts])
                best: dict[tuple[int, int, int], list] = {}
                for c, x in enumerate(indexes.value):
                    for d, p in x.passages(words, doc, at).tolist():
                        passage = texts[d][p * x.longest : (p + 2) * x.longest]
                        for item, score in x.wand(passage):
                            share = x.overlap(item, passage, texts[d])
                            if share >= OVERLAP:
                                seen = best.setdefault((d, c, item), [0, 0.0, 0.0])
                                seen[:] = seen[0] + 1, max(seen[1], score), max(seen[2], share)
                rows = sorted(best)
                out = [pa.array([batch.column("doc_id")[low + d].as_py() for d, _, _ in rows], pa.int64()), pa.array([indexes.value[c].ids[k] for _, c, k in rows], pa.int64())]
                out += [pa.array([best[r][k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [word_starts(t.as_py())[2] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([len(w) for w in words], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))], ["part", "n", "terms"])


def leaks(docs: DataFrame, items: DataFrame, most_items: int = 50_000, most_words: int = 5_000_000) -> DataFrame:
    """doc_id, item_id, n_passages, score, overlap of every verified match. items: item_id, text and, if there is one, answer."""
    spark = docs.sparkSession
    names = ["doc_id", "item_id", "n_passages", "score", "overlap"]
    schema = "doc_id long, item_id long, n_passages long, score double, overlap double"
    items = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", *["answer"] * ("answer" in items.columns))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    keyed = items.withColumn("part", F.xxhash64("item_id", "text"))
    terms = written(mapped(keyed.select("part", "text"), _item_terms, "part long, n long, terms array<long>"), "item-terms")
    n, words = terms.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = written(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "item-frequencies")
    parts = max(-(-n // most_items), -(-words // most_words))
    out = None
    for part in range(parts):
        own = F.pmod("part", F.lit(parts)) == part
        mine = keyed.filter(own).drop("part").collect()
        found = df.join(terms.filter(own).select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toArrow().to_pandas()
        found["term"] = found["term"].astype("uint64")
        found = found.sort_values("term")
        known = Items(n, words / max(1, n), found["term"].to_numpy(), found["df"].to_numpy())
        indexes = by_length([r["item_id"] for r in mine], [r["text"] for r in mine], [r["answer"] for r in mine] if "answer" in items.columns else None, known)
        if indexes:
            found = mapped(rows, _matches(spark.sparkContext.broadcast(indexes), names), schema)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


@keeps_columns
def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item. Rows are told apart by a hash of id and text, so null and repeated ids are no matter."""
    key = F.xxhash64("doc_id", "text")
    found = leaks(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, key == F.col("_leaked"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
