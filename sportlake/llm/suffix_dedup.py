"""Removal of long repeated byte strings with suffix sorting, shallow and deep.

Every start of a `length`-byte window is a suffix to be ordered to that depth. Suffixes that agree to the full depth repeat, and
all their bytes go. To spread the sort, a suffix belongs to the bucket named by the smallest hash of the `gram`-byte strings in its
window: equal windows have equal buckets. Neighbouring starts of one document in one bucket form a segment. Buckets that a
single start could not share are dropped; segments with the same bytes count once, with their number. What is left is sorted
bucket by bucket: multikey quicksort on words of eight bytes to a shallow depth, then blind tries for the groups that still agree.
A blind trie compares its members with a leader, splits them by the first differing position and byte alone, and goes on in
each branch with a new leader, so bytes that all share are never looked at again.

Segments and documents are identified by 64-bit hashes together with bucket and length. The segments of a bucket with very many
different ones are cut into runs of windows that have the same smallest hash under a second hash function, and those are buckets of their
own: each window goes to one of them, equal windows to the same one.

Nulls, ties and odd rows: a null text is empty; texts shorter than the length have no window and stay whole. Repeated rows
count as separate documents and so remove each other. Ids may be null or repeat. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import documents, mapped, mix64, prefix_hash, span_hash, text_bytes, text_of, written

LENGTH = 400
#: Different segments of a bucket beyond which it is dealt anew by a second hash.
SEGMENTS = 20_000
#: Buckets and segments with more than one in HOT_PARTS of all rows, of which there are fewer than HOT_PARTS, are joined without a shuffle.
HOT_PARTS = 20_000
#: Window starts that are sorted at once.
BATCH = 200_000
SHALLOW = 16
BITS = 24


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Bucket, hash, first start, number of starts of each segment, and whether the string that names its bucket occurs again in the text."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    p = prefix_hash(data)
    q = np.arange(len(data) - gram + 1)
    grams = span_hash(p, q, q + gram)
    low = window_minima(grams, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    n = np.diff(np.append(first, len(low)))
    bucket = low[first]
    values, times = np.unique(grams[grams <= bucket.max()], return_counts=True)
    several = np.isin(bucket, values[times > 1])
    return bucket.view(np.int64), span_hash(p, first, first + n + length - 1).view(np.int64), first, n, several


def sort_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """How often the `length` bytes at each position occur among the positions of its group, counted with their times.

    data must go on for eight bytes after the last suffix.
    """
    total = times.copy()
    word = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        word |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    rows, of = np.arange(len(at)), group
    for depth in range(0, min(SHALLOW, length - 7), 8):  # multikey quicksort: only ties go on to the next word
        key = word[at[rows] + depth]
        order = np.lexsort((key, of))
        rows, of, key = rows[order], of[order], key[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])
        rows, of = _ties(rows, np.cumsum(new) - 1)
        if not len(rows):
            return total
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    while len(rows):  # blind tries: one branching of every group at a time
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        size = np.diff(np.append(start, len(rows)))
        leader = np.repeat(rows[start], size)
        common, byte = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for a in range(0, len(rows), 8192):
            mine, theirs = windows[at[rows[a : a + 8192]]], windows[at[leader[a : a + 8192]]]
            differ = mine != theirs
            where = differ.argmax(axis=1)
            line = np.arange(len(where))
            same = ~differ[line, where]
            common[a : a + 8192] = np.where(same, length, where)
            byte[a : a + 8192] = mine[line, where].astype(np.int64) - theirs[line, where]
        same = common == length
        number = np.cumsum(np.concatenate([[0], np.where(same, times[rows], 0)]))
        occurs = np.repeat(number[start + size] - number[start], size)
        total[rows[same]] = occurs[same]
        rows, of, common, byte = rows[~same], of[~same], common[~same], byte[~same]
        order = np.lexsort((byte, np.where(byte < 0, common, -common), byte > 0, of))  # in the order of the suffixes
        rows, of, common, byte = rows[order], of[order], common[order], byte[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (common[1:] != common[:-1]) | (byte[1:] != byte[:-1])]) if len(rows) else np.zeros(0, bool)
        rows, of = _ties(rows, np.cumsum(new) - 1)
    return total


def _ties(rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the groups of one."""
    more = np.bincount(of, minlength=1)[of] > 1 if len(of) else np.zeros(0, bool)
    return rows[more], of[more]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: windows of the segment (n in all) from offset on, and their bytes.
BODY = pa.schema([("bucket", pa.int64()), ("share", pa.int64()), ("segment", pa.int64()), ("n", pa.int32()), ("offset", pa.int32()), ("windows", pa.int32()), ("times", pa.int64()), ("body", pa.binary())])


def _sorter(length: int):
    """Rows arrive in order of bucket and share; a bucket is sorted whole, small ones together."""
    out = pa.schema([("bucket", pa.int64()), ("segment", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("end", pa.int32())])

    def sort(held: list[tuple]) -> pa.RecordBatch:
        bucket, share, segment, whole, offset, n, times, body = zip(*held, strict=True)
        data = np.frombuffer(b"".join(body) + bytes(8), np.uint8)
        n, times, offset = np.array(n), np.array(times), np.array(offset)
        base = np.cumsum([0, *map(len, body)])[:-1]
        key, share = np.array(bucket, np.int64), np.array(share, np.int64)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (share[1:] != share[:-1])]))
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        total = sort_suffixes(data, base[row] + start, group[row], times[row], length)
        repeats = np.zeros(len(row) + len(n), bool)  # a gap after each segment
        repeats[np.arange(len(row)) + row] = total > 1
        a, b = _spans(repeats)
        of = np.searchsorted(np.cumsum(n + 1), a, "right")
        low = (np.cumsum(n + 1) - n - 1 - offset)[of]
        return pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(np.array(segment, np.int64)[of]), pa.array(np.array(whole, np.int32)[of]), pa.array((a - low).astype(np.int32)), pa.array((b - low + length - 1).astype(np.int32))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, last = [], 0, None
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in BODY.names], strict=True):
                if starts >= BATCH and r[:2] != last:
                    yield sort(held)
                    held, starts = [], 0
                last = r[:2]
                held.append(r)
                starts += r[5]
        if held:
            yield sort(held)

    return run


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ids = [], batch.column("uid").to_numpy()
            for uid, text in zip(ids, batch.column("text"), strict=True):
                bucket, segment, first, n, several = segments_of(text_bytes(text.as_py()), length, gram)
                if len(first):
                    parts.append((np.full(len(first), uid), bucket, segment, first.astype(np.int32), n.astype(np.int32), several))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["uid", "bucket", "segment", "first", "n", "several"])

    return run


def _bodies(length: int, gram: int):
    """Cut the bytes of the wanted segments out of each document, those of large buckets by a second smallest hash."""

    def parts(body: bytes, n: int) -> Iterator[tuple[int, int, int]]:
        data = np.frombuffer(body, np.uint8)
        q = np.arange(len(data) - gram + 1)
        low = window_minima(mix64(span_hash(prefix_hash(data), q, q + gram) ^ np.uint64(0xA0761D6478BD642F)), length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        return zip(low[first].view(np.int64).tolist(), first.tolist(), np.diff(np.append(first, n)).tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data = text_bytes(text.as_py()).tobytes()
                for w in wanted.as_py():
                    body = data[w["first"] : w["first"] + w["n"] + length - 1]
                    for share, offset, n in parts(body, w["n"]) if w["large"] else [(0, 0, w["n"])]:
                        rows.append({k: w[k] for k in ("bucket", "segment", "n", "times")} | {"share": share, "offset": offset, "windows": n, "body": body[offset : offset + n + length - 1]})
                        size += n + length
                if size >= 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, BODY)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, BODY)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_removed, n_spans, digest, n_bytes, left = [], [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = text_bytes(text.as_py())
            depth = np.zeros(len(data) + 1, np.int64)
            for s in spans.as_py() or []:
                depth[s["start"]] += 1
                depth[s["end"]] -= 1
            gone = np.cumsum(depth[:-1]) > 0
            n_bytes.append(len(data))
            n_removed.append(int(gone.sum()))
            n_spans.append(len(_spans(gone)[0]))
            kept = data[~gone].tobytes()
            digest.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))


def bits_of(ids: DataFrame) -> Broadcast:
    """A table of 2**BITS hashed bits, whatever the data's size, that knows all of ids and seldom others; for holds()."""
    word = F.col("uid").bitwiseAND(F.lit((1 << (BITS - 6)) - 1)).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftright(uid, {BITS - 6}) & 63 as int))")
    words = ids.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(table)


def holds(table: np.ndarray, uid: np.ndarray) -> np.ndarray:
    u = uid.view(np.uint64)
    at = (u & np.uint64((1 << (BITS - 6)) - 1)).astype(np.int64)
    return (table[at].view(np.uint64) >> ((u >> np.uint64(BITS - 6)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def among(ids: DataFrame):
    """A test for a uid column that is true for all of ids and seldom for others."""
    shared = bits_of(ids)

    @F.pandas_udf("boolean")
    def test(uid: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, uid.to_numpy()))

    return test


def joined(df: DataFrame, other: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """df.join(other, on, how), inner or left semi. Rows of df with a key in hot, which is small, meet theirs in a broadcast, so no task gets all rows of such a key."""
    hot = F.broadcast(hot.select(*on))
    often = F.broadcast(other.join(hot, on, "left_semi"))
    return df.join(often, on, how).unionByName(df.join(hot, on, "left_anti").join(other, on, how))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """uid, start, end of byte ranges (they may overlap) made of windows that start anywhere else too. docs: uid, text.

    A bucket or segment of a very common text is in no task whole before the sort, which deals large buckets anew.
    """
    gram = max(1, length // 5)
    found = written(mapped(docs.select("uid", "text"), _segments(length, gram), "uid long, bucket long, segment long, first int, n int, several boolean"), "segments")
    shared = written(found.groupBy("bucket").agg(F.count("*").alias("k"), F.max("several").alias("several")).filter("k > 1 or several").select("bucket", "k"), "shared")
    hot = shared.filter(F.col("k") * HOT_PARTS > found.count())
    kept = written(joined(found, shared, ["bucket"], hot, "left_semi").select("bucket", "segment", "n", "uid", "first"), "kept-segments")
    one = kept.groupBy("bucket", "segment", "n").agg(F.count("*").alias("times"), F.min(F.struct("uid", "first")).alias("at"))
    one = written(one.select("bucket", "segment", "n", "times", "at.uid", "at.first"), "one-of-each")
    hot = one.filter(F.col("times") * HOT_PARTS > kept.count())
    large = one.groupBy("bucket").agg(F.count("*").alias("k")).filter(F.col("k") > SEGMENTS).select("bucket", F.lit(True).alias("large"))
    one = one.join(F.broadcast(large), "bucket", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    wanted = one.groupBy("uid").agg(F.collect_list(F.struct("bucket", "segment", "n", "times", "large", "first")).alias("wanted"))
    sources = docs.select("uid", "text").filter(among(one.select("uid"))("uid")).dropDuplicates(["uid"])
    schema = "bucket long, share long, segment long, n int, offset int, windows int, times long, body binary"
    bodies = mapped(sources.join(wanted, "uid").select("text", "wanted"), _bodies(length, gram), schema)
    bodies = bodies.repartition("bucket", "share").sortWithinPartitions("bucket", "share")
    marks = written(mapped(bodies, _sorter(length), "bucket long, segment long, n int, first int, end int"), "marks")
    marks = marks.withColumnRenamed("first", "from")
    return joined(kept, marks, ["bucket", "segment", "n"], hot).select("uid", (F.col("first") + F.col("from")).cast("long").alias("start"), (F.col("first") + F.col("end")).cast("long").alias("end"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every document without its repeated bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    text is what is left; a character of which a cut leaves only some bytes is not in it (kept_sha256 is of all bytes that are left).
    """
    docs = identified(docs)
    spans = written(repeated_spans(docs, length), "spans")
    touched = among(spans.select("uid"))("uid")
    by = spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    marked = docs.withColumn("touched", touched)
    whole = marked.filter(~F.col("touched")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), "text")
    cut = mapped(marked.filter("touched").select("doc_id", "uid", "text").join(by, "uid", "left").select("doc_id", "text", "spans"), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return whole.unionByName(cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
