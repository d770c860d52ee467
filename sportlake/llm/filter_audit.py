"""Audit of how filters interact, from one pass of a byte transducer over every text.

A finite-state transducer reads the UTF-8 bytes of whole texts, each byte once: tables give the next state and what the
byte begins (a word, the end of one, a capital, a code point, a symbol). Texts of a batch are cut into lanes of equally many bytes that step
together through the tables; a lane starts a few bytes early, where the state of any text settles. The words that begin and end go, with
their document, into an open hash table whose every hit is verified byte by byte, so distinct words are exact. From the counts come the failures of
filters A to D; copies (E) are found by a digest of the text.

What the five filters do in all 120 orders follows from how many documents of a part fail which set of filters: 32 sets by
two labels each, counted in parallel. Documents are grouped by id and digest before they meet their group's smallest id, and rows of a repeated id
are counted before that, so no group of copies stands in one task.

Nulls, ties and odd rows: a null text is empty. Texts are equal when their UTF-8 bytes are (SHA-256). A null id is neither smaller nor
larger than any, so such a row never fails E and makes no other fail it; it has no labels. Rows that share an id and a text are no copies of each other.
Of several labels of an id the larger counts. A null source and an empty one are the same part. An empty table gives no rows.
Bytes that are not UTF-8 count as code points of their own. Memory of a task follows the longest text. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import arrow_batches, documents, labels, mapped, mix64, text_of, written

LEAST_WORDS = 200
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

# --- tables of the transducer -------------------------------------------------------------------------------------------

#: What a byte begins; one bit each.
WORD_STARTS, WORD_ENDS, CAPITAL, CODE_POINT, SYMBOL = 1, 2, 4, 8, 16
#: Classes of bytes.
SPACE, PLAIN, UPPER, MARK, TRAIL, LEAD2, LEAD3, LEAD4, WRONG = range(9)
#: States: outside words; in a word; in a word within a character that wants one, two or three more bytes.
OUTSIDE, INSIDE, WANTS1, WANTS2, WANTS3 = range(5)
#: A character has four bytes at most, so after so many bytes the state no longer depends on where a lane began.
SETTLES = 4
LANE = 64
#: Bytes of texts that go through the tables at once; a longer text goes alone.
AT_ONCE = 1 << 21


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; next state and output by state * 9 + class."""
    kind = np.full(256, PLAIN, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[65:91] = UPPER
    kind[list(b"#$%&*|")] = MARK
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:0xF8], kind[0xF8:] = TRAIL, LEAD2, LEAD3, LEAD4, WRONG
    to, out = np.zeros((5, 9), np.uint8), np.zeros((5, 9), np.uint8)
    for state in range(5):
        for k in range(9):
            to[state, k] = {SPACE: OUTSIDE, LEAD2: WANTS1, LEAD3: WANTS2, LEAD4: WANTS3}.get(k, INSIDE)
            out[state, k] = CODE_POINT | (CAPITAL if k == UPPER else SYMBOL if k == MARK else 0)
            if k == TRAIL and state >= WANTS1:  # within a character
                to[state, k], out[state, k] = state - 1, 0
            if k != SPACE and state == OUTSIDE:
                out[state, k] |= WORD_STARTS
            if k == SPACE and state != OUTSIDE:
                out[state, k] |= WORD_ENDS
    return kind, to.ravel() * 9, out.ravel()


KIND, NEXT, OUT = _tables()


def transduced(data: np.ndarray) -> np.ndarray:
    """What each byte begins, from one pass over the bytes. The bytes before the first count as space."""
    n = len(data)
    lanes = -(-n // LANE)
    padded = np.full(SETTLES + lanes * LANE, 32, np.uint8)
    padded[SETTLES : SETTLES + n] = data
    kinds = KIND[padded]
    steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(kinds, (SETTLES + LANE, lanes), (1, LANE)))
    out = np.empty((LANE, lanes), np.uint8)
    state = np.full(lanes, OUTSIDE * 9, np.uint8)
    for k in range(SETTLES + LANE):
        at = state + steps[k]
        state = NEXT[at]
        if k >= SETTLES:
            out[k - SETTLES] = OUT[at]
    return np.ascontiguousarray(out.T).ravel()[:n]


# --- words in a verified hash table ---------------------------------------------------------------------------------------


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; data ends in eight bytes more than it has places."""
    return np.lib.stride_tricks.as_strided(data, (len(data) - 8, 8), (1, 1))


def _loaded(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of words, of which `left` belong to the word; the others are 0."""
    got = np.ascontiguousarray(eights[at]).view("<u8").ravel()
    cut = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
    return np.where(left > 0, (got << cut) >> cut, np.uint64(0))


def hashed(eights: np.ndarray, start: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of each word and its salt."""
    h = mix64(salt.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64))
    live, at = np.arange(len(start)), 0
    while len(live):
        h[live] = mix64(h[live] * np.uint64(0x9E3779B97F4A7C15) + _loaded(eights, start[live] + at, size[live] - at))
        at += 8
        live = live[size[live] > at]
    return h


def same_words(eights: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b have the same bytes."""
    same = size[a] == size[b]
    live, at = np.flatnonzero(same), 0
    while len(live):
        left = size[a[live]] - at
        equal = _loaded(eights, start[a[live]] + at, left) == _loaded(eights, start[b[live]] + at, left)
        same[live[~equal]] = False
        at += 8
        live = live[equal & (left > 8)]
    return same


def distinct_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, hash_of=hashed) -> np.ndarray:  # noqa: ANN001
    """For each word, whether it is the one that holds its place in the table: one word of each document and spelling. data ends in eight spare bytes.

    Words probe slot after slot: an empty slot takes one of the words that want it; a word whose slot holds its own document and bytes is done, the others go on.
    """
    eights = _eights(data)
    slots = 1 << max(4, int(2 * len(start)).bit_length())
    table = np.full(slots, -1, np.int64)
    slot = (hash_of(eights, start, size, doc) & np.uint64(slots - 1)).astype(np.int64)
    holds = np.zeros(len(start), bool)
    live = np.arange(len(start))
    while len(live):
        want = slot[live]
        free = table[want] < 0
        table[want[free]] = live[free]
        owner = table[want]
        mine = owner == live
        holds[live[mine]] = True
        done = mine.copy()
        other = np.flatnonzero(~mine & (doc[owner] == doc[live]))
        done[other] = same_words(eights, start, size, live[other], owner[other])
        live = live[~done]
        slot[live] = (slot[live] + 1) & (slots - 1)
    return holds


def measured(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """words, distinct words, capitals, code points, symbols (columns) of each text. Texts stand one after another, each followed by a space; bounds: where they start, and the end of the last."""
    docs = len(bounds) - 1
    out = transduced(data)
    start, end = np.flatnonzero(out & WORD_STARTS), np.flatnonzero(out & WORD_ENDS)
    doc = np.searchsorted(bounds, start, side="right") - 1
    spare = np.concatenate([data, np.zeros(8, np.uint8)])
    counts = np.zeros((docs, 5), np.int64)
    counts[:, 0] = np.bincount(doc, minlength=docs)
    counts[:, 1] = np.bincount(doc[distinct_words(spare, start, end - start, doc)], minlength=docs)
    for column, bit in ((2, CAPITAL), (3, CODE_POINT), (4, SYMBOL)):
        counts[:, column] = np.add.reduceat((out & bit) > 0, bounds[:-1], dtype=np.int64)
    counts[:, 3] -= 1  # the space after the text
    return counts


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        counts, digests, a = np.zeros((len(texts), 5), np.int64), [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AT_ONCE, side="right")) - 1)
            size = np.diff(offsets[a : b + 1])
            bounds = np.concatenate([[0], np.cumsum(size + 1)])
            spaced = np.full(bounds[-1], 32, np.uint8)
            keep = np.ones(bounds[-1], bool)
            keep[bounds[1:] - 1] = False
            spaced[keep] = data[offsets[a] : offsets[b]]
            counts[a:b] = measured(spaced, bounds)
            digests += [hashlib.sha256(data[x:y]).digest() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
            a = b
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *(pa.array(c) for c in counts.T), pa.array(digests, pa.binary())], ["doc_id", "part", "words", "distinct_words", "capitals", "code_points", "symbols", "digest"])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, part, words, distinct_words, capitals, code_points, symbols, digest of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_of().alias("text"))
    return mapped(rows, _measure, "doc_id long, part string, words long, distinct_words long, capitals long, code_points long, symbols long, digest binary")


# --- filters --------------------------------------------------------------------------------------------------------------


def failures(rows: DataFrame) -> DataFrame:
    """doc_id, part, digest, and which of the filters A to D fail, as bits."""
    tests = [F.col("words") < LEAST_WORDS, 100 * F.col("distinct_words") < 50 * F.col("words"), 100 * F.col("capitals") > 2 * F.col("code_points"), F.col("symbols") > 0]
    bits = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", "digest", bits.cast("int").alias("fails"))


def patterns(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), good, toxic, n: how many rows fail which filters."""
    with arrow_batches(docs.sparkSession, 2048):
        rows = written(failures(measures(docs)).groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n")), "failures")
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = known.join(first, ["digest", "doc_id"], "left").withColumn("fails", F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E")))
    marks = marks.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.join(marks, "doc_id", "left").select("part", "fails", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"), "n")
    unknown = rows.filter("doc_id IS NULL").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return known.unionByName(unknown).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part and order. counted: as from patterns().

    What a step does depends on which filters came before, not on their order, so there are 80 sums for each part; the 600 steps of the orders look them up.
    """
    bit = {c: 1 << k for k, c in enumerate(FILTERS)}
    steps = [(o, k + 1, bit[o[k]], sum(bit[c] for c in o[:k])) for o in ORDERS for k in range(len(o))]
    kinds = F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(m).alias("before")) for b, m in sorted({(b, m) for _, _, b, m in steps})))
    cells = counted.withColumn("at", F.explode(kinds)).select("part", "fails", "good", "toxic", "n", "at.bit", "at.before")

    def total(name: str, test: Column, times: Column | None = None) -> Column:
        n = F.col("n") if times is None else F.col("n") * times
        return F.sum(F.when(test, n).otherwise(F.lit(0))).cast("long").alias(name)

    fails = F.col("fails").bitwiseAND(F.col("bit")) > 0
    earlier = F.col("fails").bitwiseAND(F.col("before")) > 0
    share = F.expr(f"{len(ORDERS)} div greatest(bit_count(fails), 1)")  # a row goes at each filter that it fails in equally many orders
    sums = cells.groupBy("part", "bit", "before").agg(
        total("kept", ~fails & ~earlier), total("removed", fails & ~earlier), total("redundant", fails & earlier), total("unique_fails", F.col("fails") == F.col("bit")),
        total("good_lost", fails & ~earlier & F.col("good")), total("toxic_lost", fails & ~earlier & F.col("toxic")), total("shapley", fails, share),
    )
    table = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    return sums.join(F.broadcast(table), ["bit", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(patterns(documents(spark, sf_dir), labels(spark, sf_dir)))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM d),
c AS (SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n FROM f
    LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b | l2.b | l3.b | l4.b | l5.b = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step))
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before = 0 AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before = 0 AND toxic), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(fails), 1)) FILTER (fails & bit > 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
