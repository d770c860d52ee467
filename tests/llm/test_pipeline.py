"""Every stage of the pipeline, and the benchmark query, against plain computation over whole tables."""

import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from test_dedup import linked
from tokenizers import Tokenizer

import corpus_pipeline
from sportlake.llm import decontamination as dc
from sportlake.llm import mixing, quality, registry
from sportlake.llm.common import documents, labels, shared_dir

MIDDLE = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def plain_shingles(words, width=5):
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def plain_leaks(docs, items):
    """(document, item) of every match: each passage of each text is held against each item, with no index and no bound."""
    words = {i: plain_words(t) for i, t in items}
    df = Counter(t for w in words.values() for t in set(w))
    mean = sum(map(len, words.values())) / len(words)
    weights = {}
    for i, w in words.items():
        norm = dc.K1 * (1 - dc.B + dc.B * len(w) / mean)
        x = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * (dc.K1 + 1) / (n + norm) for t, n in Counter(w).items()}
        weights[i] = {t: v / sum(x.values()) for t, v in x.items()}
    found = set()
    for d, text in docs:
        own = plain_words(text)
        for longest in {2 ** len(w).bit_length() - 1 for w in words.values() if w}:
            for at in range(0, len(own), longest):
                passage = own[at : at + 2 * longest]
                held = set(passage)
                for i, w in words.items():
                    if w and 2 ** len(w).bit_length() - 1 == longest and sum(v for t, v in weights[i].items() if t in held) >= dc.THRESHOLD - 1e-9:
                        wanted = plain_shingles(w, min(5, len(w)))
                        if len(wanted & plain_shingles(passage, min(5, len(w)))) >= dc.OVERLAP * len(wanted):
                            found.add((d, i))
    return found


def plain_scores(model, texts):
    """Votes of the nearest neighbours, one text and one cosine at a time."""
    for text in texts:
        if not (text or "").strip(" \t\n\x0b\x0c\r"):
            yield 0.0
            continue
        v = (quality.terms([text], model.idf) @ model.axes)[0].astype(float)
        cosines = model.vectors.astype(float) @ (v / max(np.linalg.norm(v), 1e-12))
        near = sorted(range(len(cosines)), key=lambda k: (-cosines[k], k))[: quality.NEIGHBOURS]
        w = [max(cosines[k], 0) ** 2 * float(model.vote[k]) for k in near]
        yield sum(x for x, k in zip(w, near, strict=True) if model.label[k] == 1) / sum(w) if sum(w) else 0.5


def items_of(folder):
    return duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet' WHERE text IS NOT NULL").fetchall()


def test_benchmark_query_against_plain_search(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, MIDDLE).select("doc_id", "text").collect()]
    want = plain_leaks(docs, items_of(MIDDLE))
    assert want and {(r["doc_id"], r["item_id"]) for r in registry.QUERIES["op4_decontaminate"](spark, MIDDLE).collect()} == want


def test_stages_against_plain_computation(spark):
    stages, docs = dict(corpus_pipeline.STAGES), documents(spark, MIDDLE)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before = rows(docs)
    assert len(before) == docs.count()

    good = stages["quality"](spark, docs, MIDDLE)
    model = quality.fit(docs, labels(spark, MIDDLE))
    want = {d: t for (d, t), s in zip(before.items(), plain_scores(model, before.values()), strict=True) if s >= quality.THRESHOLD}
    assert rows(good) == want and len(want) < len(before)

    distinct = stages["near-duplicates"](spark, good, MIDDLE)
    want = {d: want[d] for d, _, least in linked(list(want.items()), 5, 80) if d == least}
    assert rows(distinct) == want and len(want) < good.count()

    clean = stages["decontamination"](spark, distinct, MIDDLE)
    leaked = {d for d, _ in plain_leaks(list(want.items()), items_of(MIDDLE))}
    want = {d: t for d, t in want.items() if d not in leaked}
    assert rows(clean) == want and leaked

    mix = stages["mix"](spark, clean, MIDDLE)
    con = duckdb.connect()
    con.register("documents", clean.toArrow())
    taken = {d: n for d, n in con.execute(f"SELECT doc_id, taken FROM ({mixing.SQL})").fetchall() if n}
    made = [(r["doc_id"], r["text"]) for r in mix.collect()]
    words = Counter()
    for d, text in made:
        own, all_of = WORD.findall(text), WORD.findall(want[d])
        assert text == want[d] or own == all_of[: len(own)]
        words[d] += len(own)
    assert words == taken

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(d, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")) for d, t in made]
    got = sorted(stages["tokens"](spark, mix, MIDDLE).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, len(x), zlib.crc32(x)) for d, x in ids)
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]


def test_run_keeps_stages_and_token_files_only(spark, small):
    before = set(os.listdir(shared_dir(spark)))
    assert corpus_pipeline.run(spark, small).count()
    left = sorted(re.sub("-[0-9a-f]{32}$", "", x) for x in set(os.listdir(shared_dir(spark))) - before)
    assert left == sorted([f"stage-{name}" for name, _ in corpus_pipeline.STAGES] + ["token-files"])
