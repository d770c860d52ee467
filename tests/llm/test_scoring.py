"""Classifiers on held-out rows, segments against brute force, licences and benchmark leaks."""

import random

import numpy as np

from sportlake.llm import decontamination as dc
from sportlake.llm import language, licenses, quality, registry, toxicity

MIDDLE = "/root/testdata/sf0.01"


def joined(spark, name, label):
    out = registry.QUERIES[name](spark, MIDDLE)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    marks = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    assert out.count() == docs.count()
    return out.join(docs.select("doc_id", "lang"), "doc_id").join(marks, "doc_id", "left").filter("held_out").filter(f"{label} IS NOT NULL").collect()


def test_quality_held_out(spark):
    rows = joined(spark, "op3_quality", "quality")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_toxicity_held_out(spark):
    rows = joined(spark, "op8_toxicity", "toxic")
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.85
    # of the toxic texts here, the others share no telling word with the 37 that can be learned from
    toxic = [r for r in rows if r["toxic"] == 1 and r["lang"] == "en"]
    assert len(toxic) >= 9 and np.mean([r["predicted"] == 1 for r in toxic]) >= 0.9
    assert np.mean([r["predicted"] == 1 for r in rows if r["toxic"] == 0]) <= 0.05


def test_toxicity_against_plain_computation(spark):
    """Log-odds, the law of clean text, evidence and score of a small sample, each from its definition."""
    import math
    from collections import Counter

    r = random.Random(12)
    calm, harsh = [f"w{chr(97 + k)}{chr(97 + k % 7)}x" for k in range(25)], ["vile", "nasty", "ugh"]
    text = lambda bad: " ".join(r.choice(harsh) if bad and r.random() < 0.3 else r.choice(calm) for _ in range(r.randint(8, 30)))
    sample = [(k, int(k % 4 == 0), text(k % 4 == 0)) for k in range(80)]
    words, odds = toxicity.log_odds(spark.createDataFrame(sample, "doc_id long, toxic int, text string").repartition(3))
    one = {}
    for k, t, x in sample:  # of texts that count as copies of each other, the one with the smallest id
        one.setdefault((t, toxicity.sketch(toxicity.word_starts(x)[2])), x)
    counts = [Counter(w for (t, _), x in one.items() if t == side for w in set(x.split())) for side in (0, 1)]
    n = [sum(c.values()) for c in counts]
    want = {}
    for w in set(counts[0]) | set(counts[1]):
        c = [counts[0][w], counts[1][w]]
        prior = toxicity.PRIOR * sum(c)
        both = [math.log((c[k] + prior) / (n[k] + toxicity.PRIOR * sum(n) - c[k] - prior)) for k in (0, 1)]
        z, e = both[1] - both[0], toxicity.SHRINK * math.sqrt(1 / (c[0] + prior) + 1 / (c[1] + prior))
        if abs(z) > e:
            want[int(toxicity.word_starts(w)[2][0])] = math.copysign(abs(z) - e, z)
    assert set(words.tolist()) == set(want) and np.allclose(odds, [want[int(w)] for w in words])
    assert {int(toxicity.word_starts(w)[2][0]) for w in harsh} <= {w for w, x in want.items() if x > 0}

    model = toxicity.Model(words, odds)
    clean = [model.word_scores(toxicity.word_starts(x)[2]) for _, t, x in sample if not t]
    values, times = np.unique(np.concatenate(clean), return_counts=True)
    best = np.array([max((s for _, _, s in toxicity.segments(c)), default=0.0) for c in clean])
    decay, k = toxicity.law(np.append(values, 2.0), np.append(times, 1), np.sort(best), np.array([len(c) for c in clean])[np.argsort(best, kind="stable")])
    share = np.append(times, 1) / (times.sum() + 1)
    assert decay == 3.0 or abs((share * np.exp(decay * np.append(values, 2.0))).sum() - 1) < 1e-6
    model.decay, model.k, model.slope, model.offset = decay, k, 1.3, -2.0
    for _, _, x in sample:
        scores = model.word_scores(toxicity.word_starts(x)[2]).tolist()
        evidence = sum(e for e in (decay * s - math.log(k * len(scores)) for _, _, s in by_definition(scores)) if e > -math.log(toxicity.BOUND))
        assert abs(model.evidence(x) - evidence) < 1e-9
        assert abs(model.probability(evidence) - 1 / (1 + math.exp(-(1.3 * math.log1p(evidence) - 2.0)))) < 1e-12


def test_language_held_out(spark):
    rows = joined(spark, "op10_language", "lang")
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "en", 0), (2, "", "en", 0), (3, "12 !", None, 0), (4, "the cat sat on the mat", "en", 0), (5, "der hund und die katze", "de", 0), (6, "the " * 5000, "en", 0)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language.predicted(docs, language.fit(docs)).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language.predicted(docs, language.fit(docs.filter("false"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def odd_scored(spark):
    r = random.Random(4)
    say = lambda n, of: " ".join(r.choice(of) for _ in range(n))
    good, junk = ["river", "stone", "walks", "under", "early", "light"], ["XXX", "!!!", "99", "win"]
    texts = [say(60, good) if k % 3 else say(40, junk) + " ugh nasty vile" * 3 for k in range(240)]
    rows = [(k, t, "s", 0.5, 1) for k, t in enumerate(texts)] + [(300, None, "s", 0.5, 1), (301, "", "s", 0.5, 1), (302, " \n ", None, 0.5, 1), (303, " ".join(texts) * 20, "s", 0.5, 1), (5, texts[5], "s", 0.5, 1), (None, texts[0], None, 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, _text int")
    marks = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 3 == 0)) for k in range(240)] + [(7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, marks, texts


def test_quality_of_odd_rows(spark):
    docs, marks, texts = odd_scored(spark)
    model = quality.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model, "doc_id").collect()}
    assert all(got[k] == 0 for k in (300, 301, 302)) and 0 <= got[303] <= 1 and len(got) == 245
    assert all((got[k] >= 0.3) == (k % 3 > 0) for k in range(240))
    kept = quality.good(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id % 3 = 0 AND doc_id < 240").count() == 0 and kept.filter("doc_id = 5").count() == 2
    assert quality.good(docs.filter("false"), model).count() == 0
    # neighbours against plain cosines, of equal ones the earlier
    best, similarity = model.nearest(texts[:30])
    x = quality.unit(quality.terms(texts[:30], model.idf) @ model.axes)
    for row, v in enumerate(x):
        plain = [float(np.dot(v, w)) for w in model.vectors]
        assert np.allclose(similarity[row], sorted(plain, reverse=True)[: quality.NEIGHBOURS], atol=1e-5)
        assert len(set(best[row])) == quality.NEIGHBOURS
    twice = quality.Model(model.idf, model.axes, np.concatenate([model.vectors[:40]] * 2), np.concatenate([model.label[:40]] * 2))
    first = twice.nearest(texts[:5])[0]
    assert all(set(k - 40 for k in row if k >= 40) <= set(row) for row in first.tolist())


def test_toxicity_of_odd_rows(spark):
    docs, marks, _ = odd_scored(spark)
    model = toxicity.fit(docs, marks)
    rows = toxicity.scored(docs, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({got[k]["score"] for k in (300, 301, 302)}) == 1 and got[300]["score"] < 0.3 and not got[300]["passages"]
    assert all((got[k]["score"] >= 0.3) == (k % 3 == 0) for k in range(240))
    assert toxicity.scored(docs.filter("false"), model).count() == 0


def test_toxicity_without_evidence_is_not_above_the_share(spark):
    for share in (0.05, 0.4):
        toxic = np.arange(400) < 400 * share
        slope, offset = toxicity.curve(np.zeros(400), toxic, share)
        assert abs(1 / (1 + np.exp(-offset)) - share) < 0.01
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = registry.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.001").join(marks.filter("toxic IS NOT NULL"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) >= np.mean([r["toxic"] == 0 for r in got])


def test_language_of_repeats(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("doc_id < 300")
    model = language.fit(docs)
    a, b = docs.filter("doc_id = 7"), docs.filter("doc_id < 20")
    got = language.predicted(a.unionByName(a).unionByName(b), model).collect()
    assert len([r for r in got if r["doc_id"] == 7]) == 3 and len({(r["lang_pred"], round(r["score"], 6)) for r in got if r["doc_id"] == 7}) == 1
    same = language.Model(["aa", "bb"], np.zeros((language.PLACES, 2), np.float32))
    assert {r["lang_pred"] for r in language.predicted(docs.filter("text IS NOT NULL AND text <> ''"), same).collect()} <= {"aa", "und"}


def test_scores_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.fit(docs, marks), "doc_id").collect()} == {1: 0.5, 2: 0.0}
    assert {r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, marks)).collect()} == {0.5}


def by_definition(x):
    """Maximal-scoring segments by their recursive definition."""
    if not len(x) or max(x) <= 0:
        return []
    best, where = 0, None
    for a in range(len(x)):
        for b in range(a + 1, len(x) + 1):
            s = sum(x[a:b])
            if s > best or s == best and where and b - a < where[1] - where[0]:
                best, where = s, (a, b)
    a, b = where
    return by_definition(x[:a]) + [(a, b, best)] + [(b + c, b + d, s) for c, d, s in by_definition(x[b:])]


def test_segments_are_the_maximal_ones():
    r = random.Random(1)
    for _ in range(300):
        x = [r.choice([-3.1, -2.3, -1.7, 1.13, 2.37, 3.71]) for _ in range(r.randint(0, 14))]
        got = sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(x)))
        assert got == sorted((a, b, round(s, 6)) for a, b, s in by_definition(x))


def test_wand_finds_all_above_the_threshold():
    r = random.Random(2)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]
    items = [" ".join(r.choice(names[: r.choice([10, 80])]) for _ in range(r.randint(1, 20))) for _ in range(200)]
    x = dc.Index(list(range(200)), items)
    for _ in range(100):
        words = dc.word_starts(" ".join(r.choice(items).split()[: r.randint(1, 15)] + r.choice(items).split() + r.choice(items).split()))[2]
        terms, scores = set(words.tolist()), np.zeros(200)
        for p, term in enumerate(x.terms.tolist()):
            if term in terms:
                scores[x.item[x.first[p] : x.first[p + 1]]] += x.impact[x.first[p] : x.first[p + 1]]
        for least in (0.2, 0.5, 0.8):
            assert sorted(k for k, _ in x.wand(words, least)) == np.flatnonzero(scores >= least - 1e-9).tolist()


def test_leaks(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(r.randint(8, 40))).capitalize() + ".", f"answer {word()}") for k in range(50)]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, f"{fill(200)} {items[k][1].upper()} {fill(90)} {items[k][2]}") for k in range(20)] + [(k, fill(300)) for k in range(20, 60)] + [(90, None), (91, ""), (92, f"{fill(50)} {items[0][1]}")]
    base = spark.createDataFrame(docs, "doc_id long, text string")
    whole = dc.leaks(base, spark.createDataFrame([i[:2] for i in items], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in whole} == {(k, k) for k in range(20)} | {(92, 0)}
    tested = spark.createDataFrame([*items, (99, None, None)], "item_id long, text string, answer string")
    assert {(x["doc_id"], x["item_id"]) for x in dc.leaks(base, tested, most_items=20).collect()} == {(k, k) for k in range(20)}
    one = sorted(map(tuple, dc.leaks(base, tested).collect()))
    assert one == sorted(map(tuple, dc.leaks(base, tested, most_items=7).collect())) == sorted(map(tuple, dc.leaks(base, tested, most_words=100).collect()))
    assert sorted(x["doc_id"] for x in dc.clean_documents(base, tested).collect()) == [*range(20, 60), 90, 91, 92]
    assert dc.leaks(base, tested.filter("false")).count() == 0


def test_licenses(spark):
    t = licenses.TEMPLATES
    docs = [(1, f"intro words\n{t['MIT']}\nmore"), (2, "x " * 300 + t["MIT-text"].replace("Software", "SOFTWARE") + " y" * 200 + "\n" + t["Apache-2.0"]), (3, "a licence to print money, some say"), (4, None), (5, ""), (6, f"{t['GPL-3.0']} {t['all-rights-reserved']}"), (7, t["all-rights-reserved"])]
    got = {(r["doc_id"], r["license"]) for r in licenses.license_notices(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "MIT-text"), (2, "Apache-2.0"), (6, "GPL-3.0"), (6, "all-rights-reserved"), (7, "all-rights-reserved")}


def test_all_licenses_of_a_block(spark):
    t = licenses.TEMPLATES
    held = ["MIT-text", "Apache-2.0-header", "GPL-3.0-header", "CC-BY-NC-4.0", "all-rights-reserved"]
    text = "\n".join([*(t[k] for k in held), "Copyright (c) 2020 Jane"])
    again = "\n".join([t["MIT-text"]] * 4 + [t["MPL-2.0"], t["all-rights-reserved"]])
    got = licenses.license_notices(spark.createDataFrame([(1, text), (2, again)], "doc_id long, text string")).collect()
    assert {r["block"] for r in got} == {0}
    assert sorted(r["license"] for r in got if r["doc_id"] == 1) == sorted([*held, "copyright"])
    assert sorted(r["license"] for r in got if r["doc_id"] == 2) == ["MIT-text"] * 4 + ["MPL-2.0", "all-rights-reserved"]


def test_licenses_before_an_exact_copy(spark):
    exact = licenses.TEMPLATES["BSD-conditions"].split()
    changed = lambda *places: " ".join("other" if k in places else w for k, w in enumerate(exact))
    fill = " ".join(["word"] * 20)
    docs = [(1, f"{fill} {changed(10)} {fill} {changed()} {fill}"), (2, f"{changed(15)} {fill} {changed(3)} {fill} {changed()} {changed(9, 17)}")]
    got = licenses.license_notices(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {k: sorted((r["start"], r["license"], r["n_missing"], r["n_added"]) for r in got if r["doc_id"] == k) for k in (1, 2)}
    assert [x[1:] for x in found[1]] == [("BSD-conditions", 1, 1), ("BSD-conditions", 0, 0)]
    assert [x[1:] for x in found[2]] == [("BSD-conditions", 1, 1), ("BSD-conditions", 1, 1), ("BSD-conditions", 0, 0)]


def test_leaks_of_numbers(spark):
    items = [(1, "What is 17 plus 25", "42"), (2, "What is 31 plus 64", "95"), (3, "3 7 12 19 28 + 5", None), (4, "Which mark ends a question", "?"), (5, "Which word opens the gate", " "), (7, "ivory and horn", None), (8, "sesame", "seed")]
    docs = [(1, "a what is 17 plus 25 b 42"), (2, "a what is 17 plus 25 b 43"), (3, "see 3, 7, 12, 19, 28, 5 there"), (4, "which mark ends a question ?"), (5, "which word opens the gate"), (6, "what is plus"), (7, "gates of Ivory and horn, again"), (8, "of ivory, of horn; open sesame"), (9, "one sesame seed")]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (3, 3), (5, 5), (7, 7), (9, 8)]


def test_leaks_with_answers_of_any_length(spark):
    question, road = "what is the long way around", "back home to rome"
    items = [(1, question, f"{question} and {road}"), (2, question, road), (3, question, "rome"), (4, question, "rome " * 50), (5, question, question), (6, question, None)]
    fill = " ".join(f"w{k}" for k in range(30_000))
    docs = [(1, f"{question} rome"), (2, f"{question} and {road}"), (3, f"so {question} {road}"), (4, question), (5, f"{fill} {question} {fill} {road}"), (6, f"{road} {question}"), (6, f"{road} {question}"), (None, f"{question} rome"), (7, "rome"), (8, "rome " * 60 + question)]
    df = spark.createDataFrame([(*d, 1, 2.0, {"k": "v"}) for d in docs], "doc_id long, text string, item_id int, score double, more map<string,string>")
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.leaks(df, spark.createDataFrame(items, "item_id long, text string, answer string")).collect()), key=str)
    want = []
    for k, text in docs:  # whole words in a row: the question, and the answer somewhere in the same text
        want += [(k, i) for i, q, a in items if f" {q} " in f" {text} " and (a is None or f" {a.strip()} " in f" {text} ")]
    assert got == sorted(want, key=str)
    assert [r["doc_id"] for r in dc.clean_documents(df, spark.createDataFrame(items[:5], "item_id long, text string, answer string")).collect()] == [7]


def fewest(block, wanted):
    """Fewest missing and added words by plain edit distance over every stretch of the block."""
    best = len(wanted)
    for a in range(len(block)):
        row = list(range(len(wanted) + 1))  # differences of the stretch so far and the first k wanted words
        for w in block[a : a + 2 * len(wanted)]:
            new = [row[0] + 1]
            for k, v in enumerate(wanted):
                new.append(min(new[k] + 1, row[k + 1] + 1, row[k] if v == w else 10**6))
            row = new
            best = min(best, row[-1])
    return best


def test_wording_against_plain_edit_distance():
    r = random.Random(5)
    for _ in range(150):
        wanted = [r.randint(1, 12) for _ in range(r.choice([1, 3, 8, 14, 21]))]
        copy = [w for w in wanted if r.random() > 0.06]
        for _ in range(r.choice([0, 0, 1, 2])):
            copy.insert(r.randrange(len(copy) + 1), r.randint(1, 12))
        block = [r.randint(0, 12) for _ in range(r.randint(0, 12))] + copy + [r.randint(0, 12) for _ in range(r.randint(0, 12))]
        got = list(licenses.placed(np.array(block, np.int64), np.array(wanted, np.int64)))
        least = fewest(block, wanted)
        assert bool(got) == (least <= int(licenses.DIFFERENT * len(wanted)))
        for a, b, missing, added in got:
            assert missing + added >= least and fewest(block[a:b], wanted) == missing + added
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_licenses_of_odd_rows(spark):
    import time

    t = licenses.TEMPLATES
    long = " ".join(["license permission the copyright"] * 8000)
    rows = [(1, None), (2, ""), (3, t["MIT"]), (3, t["MIT"]), (None, t["MIT"]), (4, long + " " + t["MIT-full"]), (5, "\n".join(t.values()))]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, license string, block int")
    began = time.time()
    got = licenses.license_notices(docs).collect()
    assert time.time() - began < 60
    assert sorted(map(str, [(r["doc_id"], r["license"]) for r in got if r["doc_id"] in (None, 3)])) == sorted(map(str, [(None, "MIT"), (3, "MIT"), (3, "MIT")]))
    assert {r["license"] for r in got if r["doc_id"] == 4} == {"MIT-full"}
    assert {r["license"] for r in got if r["doc_id"] == 5} == set(t)
    assert licenses.license_notices(docs.filter("false")).count() == 0


def test_every_license_alone(spark):
    """Each template exactly, alone, at the ends and in the middle of prose, after another, changed in places, and far down a long text."""
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(["river", "stone", "walks", "under", "early", "light", "so", "that"]) for _ in range(n))
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        text = text.replace(" <>", "")
        words = text.split()
        differ = int(licenses.DIFFERENT * len(licenses.words_of(text)))
        changed = list(words)
        if differ >= 2:
            telling = [j for j, w in enumerate(words) if licenses._TELLING.search(w)]
            for j in r.sample([j for j in range(1, len(words) - 1) if j not in telling[1:] and words[j].isalpha()], differ // 2):
                changed[j] = "other"
        for j, (doc, missing) in enumerate([(text, 0), (f"{text} {prose(400)}", 0), (f"{prose(400)} {text}", 0), (f"{prose(700)}\n{text}\n{prose(700)}", 0), (f"{prose(9000)} license {prose(9000)}\n{text} {prose(300)}", 0), (f"{prose(50)} {' '.join(changed)} {prose(50)}", differ // 2 if differ >= 2 else 0), ("\n".join([text, prose(900), text.upper()]), 0)]):
            rows.append((100 * k + j, doc))
            want.add((100 * k + j, name, missing, missing))
    got = licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {(x["doc_id"], x["license"], x["n_missing"], x["n_added"]) for x in got} == want
    assert len(got) == len(rows) + len(licenses.TEMPLATES)
    texts = dict(rows)
    for x in got:  # the span is the notice, from its first word to its last
        if x["n_missing"] == 0:
            whole = [w for w, _, _ in licenses.words_of(licenses.TEMPLATES[x["license"]].replace(" <>", ""))]
            assert [w for w, _, _ in licenses.words_of(texts[x["doc_id"]][x["start"] : x["end"]])] == whole


def test_language_scores_against_plain_kernels():
    r = random.Random(6)
    tongues = {"aa": ["kalo", "mira", "tesu", "oni"], "bb": ["brst", "gruk", "vlod", "krim"], "cc": ["ééla", "õnu", "kalo", "üri"]}
    train = [(k, " ".join(r.choice(tongues[k]) for _ in range(r.randint(1, 12)))) for k in r.choices("aa bb cc".split(), [5, 3, 2], k=90)]
    texts = [" ".join(r.choice(sum(tongues.values(), [])) for _ in range(8)) for _ in range(20)]
    held = lambda t: set(language.places(t).tolist())
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    sets, langs = [held(t) for _, t in train], [k for k, _ in train]
    model = language.fitted([np.array(sorted(s)) for s in sets], langs)

    marks = [s for k in sorted(tongues) for s in [s for s, lang in zip(sets, langs, strict=True) if lang == k][: language.LANDMARKS // 3]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6 * values[-1]
    phi = lambda rows: np.array([[kernel(s, m) for m in marks] for s in rows]) @ vectors[:, keep] / np.sqrt(values[keep])
    w = np.diag([len(langs) / 3 / langs.count(k) for k in langs])
    y = np.array([[1.0 if k == n else -1.0 for n in sorted(tongues)] for k in langs])
    x = phi(sets)
    f = phi([held(t) for t in texts]) @ np.linalg.solve(x.T @ w @ x + 1e-2 * len(langs) / 3 * np.eye(x.shape[1]), x.T @ w @ y)
    want = np.exp(4 * f) / np.exp(4 * f).sum(axis=1, keepdims=True)

    rows = np.zeros((len(texts), language.PLACES), np.float32)
    for k, t in enumerate(texts):
        rows[k, list(held(t))] = 1
    assert np.allclose(model.scores(rows), want, atol=2e-3)
