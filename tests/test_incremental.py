"""Keyed tables and the streams that keep their results in them, against recomputation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sportlake.sources.keyed import KeyedTable, added, earliest, merged, newest
from sportlake.streaming import incremental as inc

SCHEMA = "player long, submitted_at timestamp, answer_id long, is_correct boolean, points long"


def answers(seed, n=400, players=6, start=0):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(rng.choice([0] * 5 + list(range(players))), t0 + dt.timedelta(minutes=rng.randint(0, 4000)), start + k, rng.random() < 0.8, rng.randint(0, 9)) for k in range(n)]


def parts_of(spark, tmp_path, parts):
    """Parts as files of a stream, one a batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for f in sorted((tmp_path / f"in/{k}").glob("part-*")):
            f.rename(tmp_path / f"in/{k:03}-{f.name}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string, at long", ["k"], buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, at long")
    assert table.read().count() == 0
    assert len(table.merge(frame([(k, "a", 1) for k in range(200)]), 0, newest("at"))) == 16
    before = table.manifest()["paths"]
    written = table.merge(frame([(3, "b", 2), (3, "c", 3), (7, "old", 0), (None, "n", 1)]), 1, newest("at"))
    after = table.manifest()["paths"]
    assert 1 <= len(written) <= 3 and {b for b in after if after[b] != before.get(b)} == set(map(str, written))
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 201 and rows[3] == "c" and rows[7] == "a" and rows[None] == "n"
    assert table.merge(frame([(3, "again", 9)]), 1, newest("at")) == []  # a batch that comes again
    assert {r["k"]: r["v"] for r in table.read().collect()} == rows
    frame([(3, "torn", 9)]).write.parquet(str(tmp_path / "t/batch=2/_bucket=5"))  # left by a try that broke off before it was published
    assert {r["k"]: r["v"] for r in table.read().collect()} == rows
    table.merge(frame([(3, "d", 9)]), 2, newest("at"))
    rows[3] = "d"
    assert {r["k"]: r["v"] for r in table.read().collect()} == rows
    assert table.vacuum() > 0 and {r["k"]: r["v"] for r in table.read().collect()} == rows


def test_rules(spark, tmp_path):
    schema = "k long, a long, b string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    found = {}
    for name, rule in (("ignore", earliest()), ("first", earliest("a")), ("last", newest("a")), ("new", newest()), ("merge", merged({"a": "sum", "b": "old"})), ("merge2", merged({"a": "greatest"}))):
        table = KeyedTable(spark, str(tmp_path / name), schema, ["k"], buckets=4)
        table.merge(frame((1, 5, "x"), (2, 5, None)), 0, rule)
        table.merge(frame((1, 3, "y"), (2, 9, "z"), (3, 1, "w")), 1, rule)
        found[name] = {r["k"]: (r["a"], r["b"]) for r in table.read().collect()}
    assert found["ignore"] == {1: (5, "x"), 2: (5, None), 3: (1, "w")} and found["first"] == {1: (3, "y"), 2: (5, None), 3: (1, "w")}
    assert found["last"] == {1: (5, "x"), 2: (9, "z"), 3: (1, "w")} and found["new"] == {1: (3, "y"), 2: (9, "z"), 3: (1, "w")}
    assert found["merge"] == {1: (8, "x"), 2: (14, "z"), 3: (1, "w")} and found["merge2"] == {1: (5, "y"), 2: (9, "z"), 3: (1, "w")}
    sums = KeyedTable(spark, str(tmp_path / "sums"), "k long, n long", ["k"], buckets=4)
    sums.merge(spark.createDataFrame([(1, 4), (2, 2)], "k long, n long"), 0, added)
    sums.merge(spark.createDataFrame([(1, 3), (2, -2)], "k long, n long"), 1, added)
    assert [tuple(r) for r in sums.read().collect()] == [(1, 7)]


def test_first_and_last_without_horizon(spark, tmp_path):
    rows = answers(1, 300)
    stream = parts_of(spark, tmp_path, [rows[:100], rows[100:150], rows[150:]])
    for last in (False, True):
        got = inc.one_of_each(stream, ["player"], ["submitted_at", "answer_id"], last, buckets=4).collect()
        pick = max if last else min
        assert sorted(r["answer_id"] for r in got) == sorted(pick((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2]))[2] for p in {r[0] for r in rows})


def test_totals_equal_recomputation(spark, tmp_path):
    first, changed = answers(2, 200), [(r[0] + 1, r[1], r[2], not r[3], 7) for r in answers(2, 200)[:40]]
    parts = [first[:120], first[120:], changed, answers(3, 60, start=1000)]
    totals = inc.Totals(spark, SCHEMA, ["answer_id"], ["player"], {"points": F.col("points"), "right": F.when(F.col("is_correct"), 1).otherwise(0)}, buckets=8)
    inc.drive(parts_of(spark, tmp_path, parts), totals.step)
    rows = {r[2]: r for part in parts for r in part}.values()
    want = {p: (sum(r[0] == p for r in rows), sum(r[4] for r in rows if r[0] == p), sum(r[3] for r in rows if r[0] == p)) for p in {r[0] for r in rows}}
    assert {r["player"]: (r["n"], r["points"], r["right"]) for r in totals.read().collect()} == want
    batch = spark.createDataFrame([(77, dt.datetime(2024, 1, 1), 5, True, 3)], SCHEMA)
    totals.step(batch, 50)
    totals.step(batch, 50)  # comes again
    later = {r["player"]: r["n"] for r in totals.read().collect()}
    assert later[77] == 1 and sum(later.values()) == len(rows)


def test_totals_after_a_broken_batch(spark, monkeypatch):
    totals = inc.Totals(spark, SCHEMA, ["answer_id"], ["player"], {}, buckets=4)
    totals.step(spark.createDataFrame(answers(4, 50), SCHEMA), 0)
    batch = spark.createDataFrame([(r[0] + 1, *r[1:]) for r in answers(4, 50)[:20]], SCHEMA)
    merge, fails = totals.totals.merge, [True]

    def torn(*args):
        if fails.pop() if fails else False:
            raise OSError("lost")
        return merge(*args)

    monkeypatch.setattr(totals.totals, "merge", torn)
    with pytest.raises(OSError):
        totals.step(batch, 1)
    totals.step(batch, 1)
    rows = [(r[0] + (k < 20), *r[1:]) for k, r in enumerate(answers(4, 50))]
    assert {r["player"]: r["n"] for r in totals.read().collect()} == {p: sum(r[0] == p for r in rows) for p in {r[0] for r in rows}}


def plain_streaks(rows):
    out = {}
    for player in {r[0] for r in rows}:
        current = best = 0
        for r in sorted((r for r in rows if r[0] == player), key=lambda r: (r[1], r[2])):
            current = current + 1 if r[3] else 0
            best = max(best, current)
        out[player] = (current, best)
    return out


@pytest.mark.parametrize("width", ["10 minutes", "1 hour", "3 days"])
def test_streaks_from_stretches(spark, width):
    rows = answers(5, 700, 4)
    got = inc.streaks_of(inc.block_runs(spark.createDataFrame(rows, SCHEMA), width)).collect()
    assert {r["player"]: (r["current_streak"], r["best_streak"]) for r in got} == plain_streaks(rows)


def test_streaks_of_a_stream_with_late_answers(spark, tmp_path):
    rows = answers(6, 400, 4)  # times at random, so every batch has late ones
    kept = inc.Streaks(spark, buckets=8)
    inc.drive(parts_of(spark, tmp_path, [rows[:150], rows[150:300], rows[300:], rows[:30]]), kept.step)
    assert {r["player"]: (r["current_streak"], r["best_streak"]) for r in kept.read().collect()} == plain_streaks(rows)


def test_late_rows_go_aside(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [[(1, t(10), 0, True, 0), (1, t(1), 1, True, 0)], [(1, t(9), 2, True, 0), (1, t(7), 3, True, 0), (1, None, 4, True, 0)], [(2, t(20), 5, True, 0), (2, t(8), 6, True, 0)], [(2, t(17), 7, True, 0), (2, t(19), 8, True, 0)]]
    kept, late = inc.late_split(parts_of(spark, tmp_path, parts), "submitted_at", "2 hours")
    assert sorted(r["answer_id"] for r in late.collect()) == [3, 7]
    assert sorted(r["answer_id"] for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 8] and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_streams_without_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert inc.one_of_each(empty, ["player"], ["submitted_at"]).count() == 0
    kept, late = inc.late_split(empty, "submitted_at", "1 hour")
    assert kept.count() == 0 and late.count() == 0
    totals, streaks = inc.Totals(spark, SCHEMA, ["answer_id"], ["player"], {}), inc.Streaks(spark)
    inc.drive(empty, totals.step)
    inc.drive(empty, streaks.step)
    assert totals.read().count() == 0 and streaks.read().count() == 0
