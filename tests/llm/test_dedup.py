"""Exact, suffix and Jaccard deduplication against brute force, with nulls, empty texts, repeats and ties."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sportlake.llm import components as cc
from sportlake.llm import exact_dedup as ed
from sportlake.llm import jaccard_join as jj
from sportlake.llm import suffix_dedup as sd


def frame(spark, docs, parts=3):
    """Documents with further columns whose names the operators use inside."""
    rows = [(d, t, 1, "x") for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, bucket string").repartition(parts)


@pytest.mark.parametrize("hot_parts", [1, 4, 20_000])
def test_exact_dedup(spark, hot_parts):
    docs = [(1, "a  b"), (2, "a\tb"), (3, "a b c"), (4, None), (5, ""), (6, "a b"), (6, "a b"), (9, "é" * 50_000), (None, "a b")]
    docs += [(k, "same") for k in range(100, 400)] + [(k, f"w {k % 40}") for k in range(1000, 1300)]
    got = ed.exact_dedup(frame(spark, docs), slots=9, radix=3, hot_parts=hot_parts).collect()
    groups = defaultdict(list)
    for d, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = []
    for d, t in docs:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        keep = min(x for x in groups[t] if x is not None)
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ed.exact_dedup(frame(spark, []), slots=8).count() == 0


def test_merging_across_batches():
    import pyarrow as pa

    rows = [(0, bytes([k // 3]) * 32, 1, 1, k, 1) for k in range(30)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(ed.ENTRY.names, r, strict=True)) for r in rows[a : a + 4]], ed.ENTRY) for a in range(0, 30, 4)]
    got = [r for b in ed.merge_runs(iter(batches)) for r in b.to_pylist()]
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(3 * k, 3) for k in range(10)]


def cut(docs, length):
    bodies = [(t or "").encode() for _, t in docs]
    times = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    for (d, _), b in zip(docs, bodies, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


@pytest.mark.parametrize(("seed", "length", "segments"), [(0, 12, 2), (1, 40, 20_000), (2, 400, 20_000)])
def test_suffix_dedup(spark, monkeypatch, seed, length, segments):
    monkeypatch.setattr(sd, "BATCH", 300)
    monkeypatch.setattr(sd, "SEGMENTS", segments)
    r = random.Random(seed)
    base = "".join(r.choice("ab é") for _ in range(800 if length < 400 else 3000))
    docs = [(0, None), (1, ""), (2, "z" * 1500), (3, "xy" * 600)]
    for k in range(30):
        a = r.randint(0, 700)
        docs.append(r.choice([(k, base[a : a + r.randint(0, 700)]), (k, "q" + base[a : a + r.randint(0, 700)] + "zz"), (k, ("ab" * r.randint(1, 5) + "c") * r.randint(0, 70)), r.choice(docs), (None, base[:a])]))
    got = sd.suffix_dedup(frame(spark, docs), length).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cut(docs, length), key=str)


def test_suffix_dedup_of_nothing(spark):
    assert sd.suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_of_passages(spark):
    """Shared passages of over 50 words go where they have 400 bytes, shorter ones stay; n_bytes is the length before the cut either way."""
    r = random.Random(3)

    def words(count, letters):
        return " ".join("".join(r.choices("abcdefghij", k=letters)) for _ in range(count))

    long, short = words(60, 8), words(55, 5)
    assert len(short) < 400 < len(long)
    docs = [(k, f"{words(80, 6)} {passage} {words(80, 6)}") for k, passage in enumerate([long, long, short, short, words(60, 8)])]
    got = {x.doc_id: x for x in sd.suffix_dedup(frame(spark, docs)).collect()}
    for k, text in docs:
        assert got[k].n_bytes == len(text)
        if long in text:
            assert got[k].n_removed >= len(long) and got[k].n_spans == 1
            assert long not in got[k].text and len(got[k].text) == len(text) - got[k].n_removed
        else:
            assert (got[k].n_removed, got[k].n_spans, got[k].text) == (0, 0, text)


def test_suffix_dedup_of_a_common_text(spark, monkeypatch):
    """Rows of one bucket or segment that very many documents share are not gathered in one task."""
    r = random.Random(5)
    text, near = ["".join(r.choices("abcdefghij", k=700)) for _ in range(2)]
    docs = [(k, text) for k in range(400)] + [(k, f"{k} {near[:400]} {k}") for k in range(400, 800)] + [(k, "".join(r.choices("abc", k=500))) for k in range(800, 900)]
    plans, mapped = [], sd.mapped

    def watched(df, run, schema):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return mapped(df, run, schema)

    monkeypatch.setattr(sd, "mapped", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(map(tuple, sd.suffix_dedup(frame(spark, docs, 8)).collect()), key=str) == sorted(cut(docs, 400), key=str)
        spans = sd.repeated_spans(sd.identified(frame(spark, docs, 8))).withColumn("task", F.spark_partition_id())
        found = spans.groupBy("start", "end").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("k")).filter("k = 400").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found and all(x.tasks > 1 for x in found)
    assert not [p for p in plans if "SortMergeJoin [bucket#" in p]


def linked(docs, words, percent):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(docs)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[top(a)] = top(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return [(d, len(sets[k]), least.get(top(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)]


@pytest.mark.parametrize(("seed", "vocabulary", "words", "percent"), [(0, 6, 4, 85), (1, 60, 5, 80)])
def test_jaccard_join(spark, seed, vocabulary, words, percent):
    r = random.Random(seed)
    names = [f"w{k}" for k in range(vocabulary)]
    bases = [[r.choice(names) for _ in range(r.choice([1, 2, 3, 5, 8, 10, 12, 15, 18, 20, 25, 40, 100]))] for _ in range(25)]
    docs = [(1000, None), (1001, ""), (1002, " \n "), (None, "w1 w2")]
    for k in range(250):
        b = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.randrange(len(b) + 1)
            b = r.choice([b[:at] + [r.choice(names)] + b[at:], b[:at] + b[at + 1 :] or b])
        docs.append((k, " ".join(b).upper() if k % 9 == 0 else "  ".join(b)))
    got = jj.jaccard_components(frame(spark, docs), words, percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(linked(docs, words, percent), key=str)


def test_needs_and_prefixes():
    for n in range(1, 60):
        for m in jj.partners(n):
            o = jj.need(n, m)
            assert 100 * o >= 85 * (n + m - o) and (o == 0 or 100 * (o - 1) < 85 * (n + m - o + 1))
            assert n - jj.prefix(n) + 1 <= o


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_window_minima():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 7, 321, 500):
        assert (sd.window_minima(x, w) == [x[k : k + w].min() for k in range(500 - w + 1)]).all()


@pytest.mark.parametrize("rows", [20_000, 7])
def test_jaccard_join_of_hot_groups(spark, monkeypatch, rows):
    """Copies around two centres, some of which link with no other, and lists dealt into blocks."""
    monkeypatch.setattr(jj, "LIST_ROWS", rows)
    monkeypatch.setattr(jj, "SHORT_LIST", 8)
    r = random.Random(rows)
    docs = []
    for base, n in ((0, 150), (1, 80)):
        words = [f"b{base}x{k}" for k in range(r.choice([120, 700]))]
        for k in range(n):
            w = list(words)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8])):
                w[r.randrange(len(w))] = f"new{r.random()}"
            docs.append((1000 * base + k, " ".join(w)))
    got = jj.jaccard_components(frame(spark, docs, 5)).collect()
    assert sorted(map(tuple, got)) == sorted(linked(docs, 4, 85))


def test_components_end_or_fail(spark):
    with pytest.raises(RuntimeError):
        cc.components(spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long"), most_rounds=1)
