"""Mixing and token files against SQL, plain computation and round trips; the pipeline on the smallest tables."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sportlake.llm import decontamination, jaccard_join, mixing, quality, registry, tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = registry.QUERIES[name](spark, small)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def odd_documents(spark):
    rows = [(k, "w " * (k % 50), "abc"[k % 3] if k % 10 else None) for k in range(300)] + [(1, "w w", "a"), (None, "w " * 7000, "d"), (5, None, "e"), (6, " ", "e")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, place int"), rows


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mix_meets_targets(spark, block):
    df, rows = odd_documents(spark)
    got = mixing.mixed(df, block=block).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source"], r["target"], r["source_size"]), []).append(r["taken"])
    for (_, target, size), taken in by.items():
        assert target <= 2 * size and sum(taken) == int(target)
    again = mixing.mixed(df.repartition(7), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mixed(blank).collect()] == [0, 0]


def test_mixed_documents_hold_the_words_taken(spark):
    df = spark.createDataFrame([(k, f"a{k} b c " * (k % 9), "xy"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(df, block=16).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixing.mixed_documents(df, block=16).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == taken


def test_every_stretch_of_the_mix_is_near_its_weights(spark):
    df = spark.createDataFrame([(k, "w " * (20 + k % 30), "abc"[k % 3]) for k in range(600)], "doc_id long, text string, source string")
    pieces = mixing.mix_pieces(df, block=32).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(df, block=32).collect() if r["taken"]}
    words = dict.fromkeys(taken, 0)
    for p in pieces:
        words[p["doc_id"]] += p["words"]
    assert words == taken
    slots = {p["slot"]: p["source"] for p in pieces}
    order = [slots[k] for k in sorted(slots)]
    share = {s: order.count(s) / len(order) for s in "abc"}
    for n in range(1, len(order) + 1):
        assert all(abs(order[:n].count(s) - n * share[s]) <= np.log2(len(order)) + 1 for s in "abc")
    # the mixed documents stand in that order
    first = {}
    for p in sorted(pieces, key=lambda p: (p["slot"], p["skip"])):
        first.setdefault((p["doc_id"], p["pass"]), None)
    assert [r["doc_id"] for r in mixing.mixed_documents(df.repartition(3), block=32).collect()] == [d for d, _ in first]


def test_stages_keep_clashing_columns(spark):
    names = ["doc_id", "text", "source", "score", "_text", "key", "size", "_id", "_leaked", "place", "slot", "label", "n"]
    rows = [(k, f"w{k} b c d e f g h", "xy"[k % 2], *range(10)) for k in range(20)]
    docs = spark.createDataFrame(rows, names)
    marks = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "zz yy xx vv uu tt")], "item_id long, text string")
    stages = [lambda d: quality.good(d, quality.fit(d, marks), 0.0), jaccard_join.near_distinct, lambda d: decontamination.clean_documents(d, items), mixing.mixed_documents]
    for stage in stages:
        got = stage(docs)
        assert got.columns == names and got.count() >= 10 and all(tuple(r)[3:] == tuple(range(10)) for r in got.collect())
        assert stage(docs.filter("false")).count() == 0


def test_stages_keep_columns_of_maps(spark):
    rows = [(k % 18, f"w{k % 18} b c d e f g h", "xy"[k % 2], {"a": str(k % 18)}, [({"b": k % 18},)]) for k in range(20)]  # the last two rows repeat the first two
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,string>, deep array<struct<x:map<string,int>>>")
    items = spark.createDataFrame([(1, "zz yy xx vv uu tt")], "item_id long, text string")
    assert jaccard_join.near_distinct(docs).count() == 18 and decontamination.clean_documents(docs, items).count() == 20
    for stage in (jaccard_join.near_distinct, lambda d: decontamination.clean_documents(d, items), mixing.mixed_documents):
        got = stage(docs).collect()
        assert got and all(r["more"] == {"a": str(r["doc_id"])} and r["deep"][0]["x"] == {"b": r["doc_id"]} for r in got)


def test_pieces_equal_the_library(library):
    own, r = tokens.pieces("word_bpe_49k.json"), random.Random(1)
    parts = [*"abcDE ,.,. \n\t'sé'ßÉçñí́ΣσŒœ12!?-中ſŉİıµª·  \x1c\x0b", "'re", "<|endoftext|>", " <|startoftext|>", "the,", "on.\n", "a, b", "..", "THE END."]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert own.ids(text, None).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_blocks_round_trip_from_every_checkpoint():
    ids = np.random.default_rng(0).zipf(1.3, 200_000).clip(0, 40_000).astype(np.uint32)
    table = tokens.Table.of(ids)
    for n in (0, 1, 7, 8, 9, 5000, 200_000):
        body = tokens.encode_block(ids[:n], table, every=16)
        read = tokens.Table.read(table.payload())
        lanes, points = np.frombuffer(body, "<u4", 4)[[0, 3]]
        for k in range(points):
            step = np.frombuffer(body, "<u4", 1, 16 + k * (8 + 8 * int(lanes)))[0]
            assert (tokens.decode_block(body, read, k) == ids[:n][int(step) * int(lanes) :]).all()


def test_token_files(spark, library, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "SHARD_IDS", 500)
    docs = [(k, f"word {k} und Straße, «x» " * (k % 30)) for k in range(120)] + [(5, None), (7, ""), (None, "no id")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int").repartition(4)
    got = sorted(tokens.read_tokens(tokens.write_tokens(df), with_ids=True).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    want = sorted([(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in docs], key=str)
    assert sorted([(r["doc_id"], r["ids"]) for r in got], key=str) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4")))
        at += r["n_tokens"]
    assert tokens.read_tokens(tokens.write_tokens(df.filter("false"))).count() == 0
    monkeypatch.setattr(tokens, "SHARD_IDS", 2_000_000)
    again = tokens.read_tokens(tokens.write_tokens(df.repartition(2), path=str(tmp_path / "files"))).collect()
    assert sorted((r["start"], r["ids_crc32"]) for r in again) == sorted((r["start"], r["ids_crc32"]) for r in got)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, small)
        assert after.columns == columns, name
        if name != "mix":
            assert 0 < after.count() <= kept.count()
        kept = after
    out = corpus_pipeline.run(spark, small).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in kept.collect())
    words = kept.selectExpr("sum(size(regexp_extract_all(text, '([^ \\n]+)'))) AS n").first()["n"]
    assert sum(r["n_tokens"] for r in out) > words


def test_stages_with_null_and_repeated_ids(spark):
    schema = "doc_id long, text string, source string"
    say = lambda *parts: " ".join(f"{p}{k}" for p in parts for k in "abcdefghijklmnopqrst")
    rows = [(None, f"n{k} b c", "x") for k in range(40)] + [(7, "a a", "x"), (7, "b b b", "y"), (7, "d d d", "y"), *[(8, "c c c c", "y")] * 5, (None, "e e", None)]
    df = spark.createDataFrame(rows, schema)
    for block in (3, 4096):
        want, got = {}, {}
        for r in mixing.mixed(df, block=block).collect():
            want[r["source"]] = want.get(r["source"], 0) + r["taken"]
        out = mixing.mixed_documents(df, block=block)
        for r in out.collect():
            got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
        assert got == want and out.filter("doc_id IS NULL").count()
        assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(df.repartition(5), block=block).collect()))

    leaked = say("what", "leaks")
    docs = [(None, leaked, "x"), (None, say("clean"), "x"), (1, leaked, "x"), (1, say("more"), "x"), (2, None, "x")]
    kept = decontamination.clean_documents(spark.createDataFrame(docs, schema), spark.createDataFrame([(1, leaked)], "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [docs[1], docs[3], docs[4]]))

    docs = [(1, say("one", "two"), "x"), (2, say("one", "two"), "x"), (2, say("three"), "x"), (3, say("four"), "z"), (3, say("four"), "y"), (None, say("four"), "x"), (None, None, "x"), (4, say("five"), "x")]
    kept = jaccard_join.near_distinct(spark.createDataFrame(docs, schema)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [docs[0], docs[2], docs[4], docs[5], docs[6], docs[7]]))
