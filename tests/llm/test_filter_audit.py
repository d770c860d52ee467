"""The byte transducer, its hash table and the audit against plain computation."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sportlake.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\t ", "a", "A b A", "é" * 70, "日本 日本 語", "😀 x 😀 #", "x" * 200 + " " + "x" * 200, "a\x0bb\x0cc\rd\x1ce", "#$%&*|", "Ünï code A B", "12345678 12345678 123456789 12345670", "é " * 500, "\x00 \x00", "ABC " * 300, "abcdefgh" * 9 + " " + "abcdefgh" * 8 + "abcdefgi"]


def plain(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(r + b" " for r in raw), np.uint8), np.cumsum([0] + [len(r) + 1 for r in raw])


def test_transducer_counts():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aB#é日😀 \n ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    rng.shuffle(texts)
    got = fa.measured(*packed(texts))
    marks = [[*row[:4], row[4]] for row in got.tolist()]
    assert marks == [plain(t) for t in texts]
    assert fa.measured(*packed([ODD[5] * 5000])).tolist() == [plain(ODD[5] * 5000)]


def test_bytes_that_are_not_utf8():
    data = b"a\xff\x80b \xe2\x82 c\xf0\x9f\x98"
    got = fa.measured(np.frombuffer(data + b" ", np.uint8), np.array([0, len(data) + 1]))
    assert got[0, 0] == got[0, 1] == 3 and got[0, 2] == got[0, 4] == 0


@pytest.mark.parametrize("hash_of", [fa.hashed, lambda e, start, size, doc: np.zeros(len(start), np.uint64), lambda e, start, size, doc: size.astype(np.uint64)])
def test_words_with_equal_hashes_are_told_apart(hash_of):
    rng = random.Random(1)
    words = [["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 8, 9, 17]))) for _ in range(60)] for _ in range(5)]
    data, bounds = packed([" ".join(w) for w in words])
    out = fa.transduced(data)
    start, end = np.flatnonzero(out & fa.WORD_STARTS), np.flatnonzero(out & fa.WORD_ENDS)
    doc = np.searchsorted(bounds, start, side="right") - 1
    holds = fa.distinct_words(np.concatenate([data, np.zeros(8, np.uint8)]), start, end - start, doc, hash_of)
    assert np.bincount(doc[holds], minlength=5).tolist() == [len(set(w)) for w in words]


def brute(rows, marks):
    """rows: doc_id, text, source. Every order applied to every row, one after another."""
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    failed = []
    for k, t, s in rows:
        w, d, c, n, m = plain(t or "")
        failed.append((s or "", {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 2 * n, "D": m > 0, "E": k is not None and first[t or ""] < k}, marks.get(k, (0, 0)) if k is not None else (0, 0)))
    out = {}
    for part in {p for p, _, _ in failed}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [(f, m) for p, f, m in failed if p == part]
            every = left
            for step, c in enumerate(order, 1):
                gone = [(f, m) for f, m in left if f[c]]
                redundant = sum(f[c] for f, _ in every) - len(gone)
                left = [(f, m) for f, m in left if not f[c]]
                shapley[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f[c] and sum(f.values()) == 1 for f, _ in every), sum(m[0] == 1 for _, m in gone), sum(m[1] == 1 for _, m in gone)]
        for p, order, step in list(out):
            if p == part:
                out[p, order, step].append(shapley[order[step - 1]])
    return out


def odd_rows():
    rng = random.Random(9)
    long = [" ".join(rng.choice(["aa", "Bb", "cc#", "dd", "é"] + [f"w{j}" for j in range(n)]) for _ in range(230)) for n in (1, 50, 400)]
    pool = ODD + long + [None]
    rows = [(k, rng.choice(pool), rng.choice(["s", "t", None, ""])) for k in range(150)]
    return rows + rows[:5] + [(None, long[0], "s"), (None, long[0], "s"), (None, "fresh", None), (3, long[2], "t"), (3, long[2], "s"), (1000, long[1], "u")]


def test_audit_equals_brute_force(spark):
    rows = odd_rows()
    marks = {k: (k % 2, int(k % 7 == 0)) for k in range(0, 150, 3)}
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, n int, fails int, part string").repartition(5)
    labels = spark.createDataFrame([(k, *v) for k, v in marks.items()] + [(None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = fa.audit(fa.patterns(docs, labels)).collect()
    want = brute(rows, marks)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want
    assert len(got) == len(want) == 4 * 600 - (0 if {"s", "t", "", "u"} <= {r["part"] for r in got} else 600)


def test_measures_of_a_table(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r["doc_id"]), bytes(r["digest"]).hex(), r["words"], r["distinct_words"], r["capitals"], r["code_points"], r["symbols"]) for r in fa.measures(docs).collect())
    assert got == sorted((str(k), hashlib.sha256((t or "").encode()).hexdigest(), *plain(t or "")) for k, t, _ in rows)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.patterns(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = fa.audit(fa.patterns(one, labels)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and all(r["removed"] + r["kept"] + r["redundant"] >= 0 for r in got)


def test_long_text_goes_alone(spark, monkeypatch):
    monkeypatch.setattr(fa, "AT_ONCE", 1000)  # also in this process only: the table below is cut by the real bound
    texts = ["word%d " % k * 30 for k in range(20)] + ["Long#" * 5000]
    batch = next(fa._measure(iter([__import__("pyarrow").RecordBatch.from_pydict({"doc_id": list(range(21)), "part": ["p"] * 21, "text": texts})])))
    assert [list(x) for x in zip(*(batch.column(c).to_pylist() for c in ("words", "distinct_words", "capitals", "code_points", "symbols")), strict=True)] == [plain(t) for t in texts]
