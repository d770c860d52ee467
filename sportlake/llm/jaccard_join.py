"""Size-aware join of word-shingle sets on Jaccard similarity, and the components of its links.

A text's set holds its distinct four-word shingles. Equal sets are one node. Two sets of sizes n and m link when they share at
least need(n, m) shingles. Small sets enumerate: for each size m of a partner, all subsets of need(n, m) shingles, each known
by the sum of its hashes; two sets of those sizes that name the same subset share it and so link, without more ado. Large sets
scan inverted lists of the shingles in their prefixes: in a common order of all shingles, rare ones first, two sets that link
share one of their first n - need + 1. Where enumerating would name more subsets than the lists hold entries for the size, the
lists take over; that boundary comes from the counted frequencies. A pair goes by its smaller set.

The links wanted are those that make components, so lists are read three times. First each set meets its neighbour in the list by
size; for each set the partner it meets most often is verified on whole sets, and the links merge. Then each set of a list of frequent
shingles names the one partner of another component that its sketch finds most alike, so that the copies around one centre
meet it; one partner for each set is verified, and the links merge. Last, in lists that still hold several components, all pairs of
different components and fitting sizes are counted; those that share enough of their prefixes are verified. Pairs inside a
component cannot change it. A list of more than LIST_ROWS entries is dealt into blocks, and each two blocks of it are a task's.

Shingles and sets are known by 64-bit hashes. Frequencies are counted in 2**24 hashed counters over all
texts, which stay on the executors; they only set the order of shingles, so collisions cost time and no link.

Nulls, ties and odd rows: a null or blank text has an empty set and links with nothing; its component is its own id. Repeated rows
have equal sets and link. Components take the smallest id that is not null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import arrow_batches, comparable, documents, keeps_columns, mapped, mix64, text_bytes, word_hashes, written
from sportlake.llm.components import components
from sportlake.llm.suffix_dedup import bits_of, holds

WORDS = 4
PERCENT = 85
COUNTERS = 24
#: Only shingles with hashes below this share of all are counted; prefixes seldom reach beyond.
COUNTED = np.uint64(1 << 62)
KEPT_BYTES = 6
#: Bytes of a set's sketch: eight to sixteen bits for each shingle, within these bounds.
SKETCH = (32, 4096)
#: Rows of an Arrow batch; texts and sets are long.
ROWS = 2000
CHUNK = 1 << 16
#: Rows of lists that are read together, and pairs that are judged together.
LISTS = 8192
PAIRS = 2048
#: Lists up to this length are paired all at once.
SHORT_LIST = 32
#: Entries of a list that one task holds beside as many others.
LIST_ROWS = 20_000
#: Lists of frequent shingles in which a set looks for the centre of its copies.
CENTRES = 3
#: Work on an entry of a list, its pairs' verification included, in terms of naming a subset.
ENTRY_COST = 8


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """Shingles that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subsets(n: int, boundary: int, percent: int = PERCENT) -> int:
    """How many subsets a set of n names."""
    return sum(comb(n, need(n, m, percent)) for m in partners(n, percent) if min(n, m) <= boundary)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes."""
    h = word_hashes(text_bytes(text, lower=True))
    if not len(h):
        return h
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)]
    x = mix64(x)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def set_id(x: np.ndarray) -> int:
    """A hash of the whole set, as a signed integer."""
    sums = np.array([mix64(x + np.uint64(11)).sum(dtype=np.uint64), len(x)], np.uint64)
    return int(mix64(mix64(sums[:1]) + sums[1:]).view(np.int64)[0])


def subset_keys(x: np.ndarray, boundary: int, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """A key of each subset for each size of partner, and that size."""
    n = len(x)
    h = mix64(x ^ np.uint64(0x5DEECE66D))
    total = int(h.sum(dtype=np.uint64))
    for m in partners(n, percent):
        if min(n, m) <= boundary:
            for out in combinations(h.tolist(), n - need(n, m, percent)):
                yield (total - sum(out) + (min(n, m) << 40) + (max(n, m) << 20)) * 0x9E3779B97F4A7C15 + 2**63 & 2**64 - 1, m


def slots(x: np.ndarray) -> np.ndarray:
    """Counters of counted shingles."""
    return (x >> np.uint64(62 - COUNTERS)).astype(np.int64)


def _add(total: np.ndarray, at: np.ndarray) -> None:
    at, times = np.unique(at, return_counts=True)
    total[at] += times.astype(np.uint32)


def first_of(x: np.ndarray, flags: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set, and how many of it are known to be rare: rare counted shingles, frequent ones, those not counted, each by hash."""
    p, counted = prefix(len(x), percent), int(np.searchsorted(x, COUNTED))
    late = is_frequent(x[:counted], flags)
    rare = x[:counted][~late][:p]
    return np.concatenate([rare, x[:counted][late], x[counted:]])[:p], len(rare)


def sketch(x: np.ndarray) -> bytes:
    """A bit for each shingle at a hashed place."""
    size = min(max(SKETCH[0], 1 << len(x).bit_length()), SKETCH[1])
    bits = np.zeros(8 * size, np.uint8)
    bits[(x & np.uint64(8 * size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch that the set has at a smaller size."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


# --- passes over the texts --------------------------------------------------------------------------------------------


def _each(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for a in range(0, len(batch), 1024):
            part = batch.slice(a, 1024)
            yield part, [shingle_set(t.as_py(), words) for t in part.column("text")]


def _counters(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << COUNTERS, np.uint32), [np.zeros(0, np.int64)], 0
        for _, sets in _each(batches, words):
            for x in sets:
                held.append(slots(x[x < COUNTED]))
                size += len(held[-1])
            if size > 1 << 20:
                _add(total, np.concatenate(held))
                held, size = held[:1], 0
        _add(total, np.concatenate(held))
        chunks = range(0, 1 << COUNTERS, CHUNK)
        body = [zlib.compress(total[a : a + CHUNK].tobytes(), 1) for a in chunks]
        yield pa.RecordBatch.from_arrays([pa.array([a // CHUNK for a in chunks], pa.int32()), pa.array(body, pa.binary())], ["chunk", "body"])

    return run


def _sum_counters(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.uint32)
    for b in rows["body"]:
        total += np.frombuffer(zlib.decompress(b), np.uint32)
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "body": [zlib.compress(total.tobytes(), 1)]})


def counters(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """chunk, body: the counters over all texts, written."""
    rows = mapped(docs.select("text"), _counters(words), "chunk int, body binary")
    return written(rows.groupBy("chunk").applyInPandas(_sum_counters, "chunk int, body binary"), "counters")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many counters hold each count; counts from 2**20 on are one."""
    for batch in batches:
        for body in batch.column("body"):
            n = np.bincount(np.minimum(np.frombuffer(zlib.decompress(body.as_py()), np.uint32), 1 << 20))
            count = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(count), pa.array(n[count])], ["count", "n"])


class Usual:
    """What the counters hold: counts, and how many counters hold each."""

    def __init__(self, count: np.ndarray, n: np.ndarray):
        order = np.argsort(count)
        self.count, self.n = count[order], n[order]
        bulk = np.cumsum(self.n) - self.n < 0.95 * self.n.sum()
        self.mean = float((self.count * self.n)[bulk].sum() / max(1, self.n[bulk].sum()))  # what chance fills a counter with
        self.most = max(6.0, self.mean + 3 * self.mean**0.5)  # beyond that, a counter holds a frequent shingle

    @classmethod
    def of(cls, total: DataFrame) -> "Usual":
        rows = mapped(total, _histogram, "count long, n long").groupBy("count").agg(F.sum("n").alias("n")).toArrow()
        return cls(rows.column("count").to_numpy(), rows.column("n").to_numpy())


def frequent(total: DataFrame, most: float) -> np.ndarray:
    """Counters above most, as packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [np.packbits(np.frombuffer(zlib.decompress(x.as_py()), np.uint32) > most).tobytes() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(flags, pa.binary())], ["chunk", "flags"])

    out = np.zeros((1 << COUNTERS) // 8, np.uint8)
    for r in mapped(total, run, "chunk int, flags binary").collect():
        out[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["flags"], np.uint8)
    return out


def is_frequent(x: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Of counted shingles."""
    at = slots(x)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def boundary_for(usual: Usual, percent: int = PERCENT) -> int:
    """The largest size up to which naming subsets costs no more than scanning the lists of a prefix."""
    rare = usual.count <= usual.most
    others = (np.maximum(0, usual.count - usual.mean) * usual.n)[rare].sum() / max(1, (usual.count * usual.n)[rare].sum())  # entries beside the own one that chance does not explain
    n = 1
    while subsets(n + 1, n + 1, percent) <= prefix(n + 1, percent) * (1 + float(others)) * ENTRY_COST:
        n += 1
    return n


class _Once:
    """True for a set the first time in a task; equal sets then stay out of the shuffle. Remembers a million at most."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, node: int) -> bool:
        if node in self.seen:
            return False
        if len(self.seen) < 1_000_000:
            self.seen.add(node)
        return True


def _nodes(shared: Broadcast, words: int, percent: int) -> Callable:
    """The set of each row: its size and hash; the subset keys of a small one with the partner's size of each; of a large one the prefix, how many of it are known to be rare, and a sketch if not all are."""
    key = pa.list_(pa.struct([("key", pa.int64()), ("m", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, boundary = shared.value
        once = _Once()
        for batch, sets in _each(batches, words):
            node, small, first, rare, sketches = [], [], [], [], []
            for x in sets:
                n = len(x)
                node.append(set_id(x))
                new = n > 0 and once(node[-1])
                small.append([{"key": k - 2**63, "m": m} for k, m in subset_keys(x, boundary, percent)] if new and min(partners(n, percent)) <= boundary else None)
                p, known = first_of(x, flags, percent) if new and n > boundary else (None, None)
                first.append(p)
                rare.append(known)
                sketches.append(sketch(x) if p is not None and known < len(p) else None)
            columns = [batch.column("doc_id"), batch.column("uid"), pa.array([len(x) for x in sets], pa.int32()), pa.array(node, pa.int64()), pa.array(small, key)]
            columns += [pa.array([None if p is None else p.view(np.int64) for p in first], pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "n", "node", "keys", "first", "rare", "sketch"])

    return run


def _bodies(words: int, wanted: Broadcast) -> Callable:
    """Sets of the rows that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        some = (b.filter(pa.array(holds(wanted.value, b.column("uid").to_numpy()))) for b in batches)
        for _, sets in _each(some, words):
            kept = [(s, x) for x in sets if len(x) and once(s := set_id(x))]
            body = [np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]).tobytes() for _, x in kept]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in kept], pa.int64()), pa.array(body, pa.binary())], ["node", "body"])

    return run


# --- lists and pairs --------------------------------------------------------------------------------------------------


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of token, n, node. Without repeats and lists of one; before: the node that comes before in the list."""
    none = np.zeros(0, np.int64)
    token, node, n, late = none, none, none, none  # up to two rows held back: the last, and the one before it
    emitted = True

    def rows(token: np.ndarray, node: np.ndarray, n: np.ndarray, late: np.ndarray, first: int, last: int) -> pa.RecordBatch:
        same = np.concatenate([[False], token[1:] == token[:-1], [False]])
        keep = np.flatnonzero(same[:-1] | same[1:])
        keep = keep[(keep >= first) & (keep < last)]
        return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep]), pa.array(n[keep].astype(np.int32)), pa.array(node[np.maximum(keep - 1, 0)], mask=~same[keep]), pa.array(late[keep].astype(np.int32))], ["token", "node", "n", "before", "late"])

    for batch in batches:
        if not len(batch):
            continue
        t, s, k, f = (np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False)]) for old, c in ((token, "token"), (node, "node"), (n, "n"), (late, "late")))
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
        t, s, k, f = t[new], s[new], k[new], f[new]
        held = 0 if emitted else max(0, len(token) - 1)
        yield rows(t, s, k, f, held, len(t) - 1)
        token, node, n, late = t[-2:], s[-2:], k[-2:], f[-2:]
        emitted = False
    if len(token):
        yield rows(token, node, n, late, len(token) - 1, len(token))


def most_common(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What sets of n_a and n_b shingles can have in common at most, row by row, by their sketches (words of 64 bits).

    A shingle whose bit the other sketch lacks is not in the other set.
    """
    if a.shape[-1] != b.shape[-1]:
        size = 8 * min(a.shape[-1], b.shape[-1])
        a, b = (np.ascontiguousarray(folded(np.ascontiguousarray(x).view(np.uint8), size)).view(np.uint64) for x in (a, b))
    return np.minimum(n_a - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))


class Lists:
    """Whole lists: token, block_a, block_b, block, n, node, label in order of the first three, n and node; sketches or None.

    Sketches grow with n, so those of a list that are of one size stand together.
    """

    def __init__(self, columns: dict[str, np.ndarray], sketches: list[bytes | None], percent: int):
        self.__dict__.update(columns)
        self.percent = percent
        change = (self.token[1:] != self.token[:-1]) | (self.block_a[1:] != self.block_a[:-1]) | (self.block_b[1:] != self.block_b[:-1])
        self.start = np.concatenate([[0], np.flatnonzero(change) + 1])
        self.end = np.append(self.start[1:], len(self.token))
        size = np.array([len(x) if x is not None else 0 for x in sketches])
        self.size, self.row, self.bits = size, np.zeros(len(size), np.int64), {}
        for one in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == one)
            self.row[at] = np.arange(len(at))
            self.bits[one] = np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), one // 8)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a and b of a list are of different labels and, if it is dealt into blocks, of different ones."""
        return (self.label[a] != self.label[b]) & ((self.block_a[a] == self.block_b[a]) | (self.block[a] != self.block[b]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows a and b of pairs that may link, and what they can share over what they must."""
        length = self.end - self.start
        short = np.repeat(length <= SHORT_LIST, length)
        of = np.repeat(np.arange(len(length)), length)
        found = []
        for d in range(1, min(SHORT_LIST, int(length.max(initial=0)))):
            b = np.flatnonzero((of[d:] == of[:-d]) & short[d:]) + d
            a = b - d
            fine = (100 * self.n[a] >= self.percent * self.n[b]) & self.fits(a, b)
            found.append((a[fine], b[fine]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            kind = self.size[a] * 65536 + self.size[b]
            for one in np.unique(kind).tolist():
                at = np.flatnonzero(kind == one)
                for k in range(0, len(at), PAIRS):
                    yield self.judged(a[at[k : k + PAIRS]], b[at[k : k + PAIRS]], one >> 16, one & 65535)
        for low, high in zip(self.start[length > SHORT_LIST].tolist(), self.end[length > SHORT_LIST].tolist(), strict=True):
            for b in range(low + 1, high):
                first = low + int(np.searchsorted(self.n[low:b], -(-self.percent * int(self.n[b]) // 100)))
                edges = [first, *(first + 1 + np.flatnonzero(np.diff(self.size[first:b]))).tolist(), b]
                for x, y in zip(edges, edges[1:], strict=False):
                    for k in range(x, y, PAIRS):
                        a = np.arange(k, min(y, k + PAIRS))
                        a = a[self.fits(a, np.array([b]))]
                        if len(a):
                            yield self.judged(a, np.array([b]), int(self.size[x]), int(self.size[b]))

    def judged(self, a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wanted = -(-self.percent * (self.n[a] + self.n[b]) // (100 + self.percent))
        b = np.broadcast_to(b, a.shape)
        if not size_a or not size_b:
            return a, b, np.ones(len(a))
        row = self.row[a]
        one = self.bits[size_a][row[0] : row[-1] + 1] if len(row) and row[-1] - row[0] + 1 == len(row) and (np.diff(row) == 1).all() else self.bits[size_a][row]
        other = self.bits[size_b][self.row[b[:1]]] if b.strides == (0,) else self.bits[size_b][self.row[b]]
        share = most_common(self.n[a], one, self.n[b], other) / wanted
        fine = share >= 1
        return a[fine], b[fine], share[fine]


def _whole_lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[Lists]:
    names, held = ("token", "block_a", "block_b"), []

    def made(rows: pa.Table) -> Lists:
        columns = {k: rows.column(k).to_numpy().astype(np.int64) for k in (*names, "block", "n", "node", "label")}
        return Lists(columns, rows.column("sketch").to_pylist(), percent)

    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) < LISTS:
            continue
        rows = pa.concat_tables(held)
        key = np.stack([rows.column(k).to_numpy() for k in names])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        if len(change):
            yield made(rows.slice(0, change[-1] + 1))
            rows = rows.slice(change[-1] + 1)
        held = [rows]
    if held:
        yield made(pa.concat_tables(held))


def _fitting(percent: int) -> Callable:
    """Pairs of a list with different labels and sizes near enough, unless their sketches rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list) -> pa.RecordBatch:
            a, b, n_a, n_b = (np.concatenate(x) for x in zip(*found, strict=True))
            first = a < b
            columns = np.where(first, a, b), np.where(first, b, a), np.where(first, n_a, n_b), np.where(first, n_b, n_a)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "n_a", "n_b"])

        for x in _whole_lists(batches, percent):
            found, size = [], 0
            for a, b, _ in x.pairs():
                if len(a):
                    found.append((x.node[a], x.node[b], x.n[a], x.n[b]))
                    size += len(a)
                if size >= LISTS:
                    yield made(found)
                    found, size = [], 0
            if found:
                yield made(found)

    return run


def _alike(percent: int) -> Callable:
    """For each row of a list the partner of another label that its sketch finds most alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_lists(batches, percent):
            best, partner = np.zeros(len(x.token)), np.zeros(len(x.token), np.int64)
            for one, other, share in x.pairs():
                for a, b in ((one, other), (other, one)):
                    order = np.lexsort((x.node[b], -share, a))
                    order = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
                    a, b, s = a[order], b[order], share[order]
                    more = s > best[a]
                    best[a[more]], partner[a[more]] = s[more], x.node[b[more]]
            at = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(x.node[at]), pa.array(partner[at]), pa.array(best[at])], ["node", "partner", "share"])

    return run


def _linked(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(body: bytes) -> np.ndarray:
            x = np.zeros((len(body) // KEPT_BYTES, 8), np.uint8)
            x[:, 8 - KEPT_BYTES :] = np.frombuffer(body, np.uint8).reshape(-1, KEPT_BYTES)
            return x.view(">u8").ravel().astype(np.uint64)

        for batch in batches:
            good = []
            for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
                x, y = numbers(x.as_py()), numbers(y.as_py())
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                good.append(100 * common >= percent * (len(z) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link. Only texts with one of those sets are read into sets again."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = nodes.join(ids, "node", "left_semi").select("uid")
    sets = mapped(docs.select("uid", "text"), _bodies(words, bits_of(texts)), "node long, body binary").dropDuplicates(["node"])
    sets = written(sets.join(ids, "node", "left_semi"), "sets")
    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    return written(mapped(two.select("a", "b", "body_a", "body_b"), _linked(percent), "a long, b long"), "links")


def dealt(rows: DataFrame) -> DataFrame:
    """Entries of lists in order, for tasks that take whole lists. Lists of more than LIST_ROWS entries are dealt into blocks; each two blocks are a list."""
    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / LIST_ROWS).alias("blocks")).filter("blocks > 1")
    rows = rows.join(blocks, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("token", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "n", "node", "label", "sketch")
    return rows.repartition("token", "block_a", "block_b").sortWithinPartitions("token", "block_a", "block_b", "n", "node")


def links(docs: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) between different sets that join them as all links would."""
    keyed = nodes.filter("keys is not null").dropDuplicates(["node"]).select("node", "n", F.explode("keys").alias("k")).select("node", "n", F.col("k.key").alias("token"), F.col("k.m").alias("m"))
    keyed = written(keyed, "subsets")
    least = keyed.groupBy("token", "n").agg(F.min("node").alias("least"))
    small = keyed.join(least.select("token", F.col("n").alias("m"), "least"), ["token", "m"]).select(F.col("node").alias("a"), F.col("least").alias("b")).filter("a <> b")

    entries = nodes.filter("first IS NOT NULL").select("node", "n", "rare", F.posexplode("first").alias("at", "token")).select("token", "node", "n", (F.col("at") - F.col("rare")).alias("late"))
    lists = entries.repartition("token").sortWithinPartitions("token", "n", "node")
    lists = written(mapped(lists, _neighbours, "token long, node long, n int, before long, late int"), "lists")
    met = lists.filter("before is not null").groupBy("node", "n", "before").count().filter(F.col("count") * 30 >= F.col("n"))  # the others are left to the later readings
    most = met.groupBy("node").agg(F.max_by("before", F.struct("count", "before")).alias("before"))
    first = written(most.select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).distinct(), "pairs")
    edges = written(small.select("a", "b").unionByName(verified(first, docs, nodes, words, percent)).distinct(), "links")

    # Lists of frequent shingles can be long: their entries carry sketches, so that few of the pairs leave the task.
    sketches = nodes.filter("sketch IS NOT NULL").select("node", "sketch").dropDuplicates(["node"])

    def mixed(lists: DataFrame, edges: DataFrame) -> DataFrame:
        """The lists that hold several components, with labels."""
        named = lists.select("token", "node", "n", "late").join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = written(named, "named-lists")
        several = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
        return written(named.join(several, "token", "left_semi").select("token", "n", "node", "label", "late"), "mixed-lists")

    rows = mixed(lists, edges)
    centre = mapped(dealt(rows.filter(F.col("late").between(0, CENTRES - 1)).join(sketches, "node")), _alike(percent), "node long, partner long, share double")
    centre = centre.groupBy("node").agg(F.max_by("partner", F.struct("share", "partner")).alias("partner"))
    second = centre.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()
    second = written(second.join(first, ["a", "b"], "left_anti"), "pairs")
    edges = written(edges.unionByName(verified(second, docs, nodes, words, percent)), "links")

    rows = mixed(rows, edges)
    rows = rows.filter("late < 0").withColumn("sketch", F.lit(None).cast("binary")).unionByName(rows.filter("late >= 0").join(sketches, "node"))
    # A shingle of one prefix that stands in both sets stands in both prefixes, unless the other prefix ends before it. So the set whose
    # prefix ends first shares no more than what it shares of its prefix and all that follows its prefix.
    after = F.greatest(*(F.ceil(F.col(n) * percent / 100) - 1 for n in ("n_a", "n_b")))
    least_shared = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    pairs = mapped(dealt(rows), _fitting(percent), "a long, b long, n_a long, n_b long").groupBy("a", "b", "n_a", "n_b").count()
    rest = pairs.filter(F.col("count") + after >= least_shared).select("a", "b")
    rest = written(rest.join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    return edges.unionByName(verified(rest, docs, nodes, words, percent))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. Links need a Jaccard similarity of percent / 100 on shingles of so many words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("uid"))
    with arrow_batches(docs.sparkSession, ROWS):
        nodes, labels = _labelled(docs, words, percent)
    named = nodes.select("doc_id", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    some = named.filter("n > 0").join(least, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = named.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def _labelled(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The node of every row and the component of every linked node, both written."""
    total = counters(docs, words)
    usual = Usual.of(total)
    shared = docs.sparkSession.sparkContext.broadcast((frequent(total, usual.most), boundary_for(usual, percent)))
    made = mapped(docs, _nodes(shared, words, percent), "doc_id long, uid long, n int, node long, keys array<struct<key:long,m:int>>, first array<long>, rare int, sketch binary")
    nodes = written(made, "nodes")
    return nodes, components(links(docs, nodes, words, percent))


@keeps_columns
def near_distinct(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all its columns, and one row of each component: the one with the smallest id, of several the one with the smallest hash of its text.

    Rows with a null id and rows without shingles stay. Of rows with the same id and text one stays, the first in the order of their columns.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("uid"))
    with arrow_batches(docs.sparkSession, ROWS):
        nodes, labels = _labelled(keyed, words, percent)
    named = nodes.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "uid", "node").agg(F.count("*").alias("rows"))
    named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("own", F.struct("doc_id", "uid"))
    marked = named.join(named.groupBy("label").agg(F.min("own").alias("kept")), "label").withColumn("gone", F.col("own") > F.col("kept")).filter("gone OR rows > 1")
    marked = written(marked.select(F.col("doc_id").alias("_id"), F.col("uid").alias("_uid"), "gone"), "marked")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_uid"))
    out, repeated = docs.join(marked.drop("gone"), same, "left_anti"), marked.filter("NOT gone").drop("gone")
    if not repeated.isEmpty():
        first = docs.join(repeated, same).groupBy("_id", "_uid").agg(F.min_by(F.struct(*docs.columns), F.struct(*comparable(docs))).alias("_row"))
        out = out.unionByName(first.select("_row.*"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
