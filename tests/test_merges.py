"""Chains of merges, circles and what a merge would do."""

import random

from sportlake.operators import merges


def plain(steps):
    to = {}
    for a, b in steps:
        if a is not None and b is not None and a != b:
            to.setdefault(a, set()).add(b)
    out = {}
    for a in to:
        seen, at, bad = {a}, a, False
        while at in to:
            bad |= len(to[at]) > 1
            at = min(to[at])
            if at in seen:
                at = None
                break
            seen.add(at)
        out[a] = (None, "circle") if at is None else (None, "ambiguous") if bad else (at, None)
    return out


def test_chains_end_where_they_lead(spark):
    rng = random.Random(3)
    steps = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (2, 3), (4, 3), (5, 6), (6, 7), (7, 5), (8, 5), (9, 9), (None, 1), (10, None), (11, 12), (11, 13), (14, 11), (1, 2), (20, 21), (21, 20)]
    steps += [(1000 + k, 1000 + rng.randint(0, 60)) for k in range(60)]
    got = merges.resolved(spark.createDataFrame(steps, "old_id int, new_id int").repartition(3)).collect()
    want = plain(steps)
    assert {r["old_id"]: (r["new_id"], r["problem"]) for r in got} == want and len(got) == len(want)
    assert want[100] == (160, None) and want[8] == (None, "circle") and want[14] == (None, "ambiguous")


def test_merge_and_its_plan(spark):
    teams = spark.createDataFrame([(k, f"T{k}") for k in range(1, 8)], "team_id int, name string")
    matches = spark.createDataFrame([(1, 1, 2), (2, 3, 1), (3, 5, 6), (4, None, 7)], "match_id int, home int, away int")
    closed = merges.resolved(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 70)], "old_id int, new_id int"))
    tables = {"matches": (matches, ["home", "away"])}
    out, left = merges.merged(tables, teams, "team_id", closed)
    assert sorted(map(tuple, out["matches"].collect())) == [(1, 3, 3), (2, 3, 3), (3, 5, 6), (4, None, 7)] and out["matches"].columns == matches.columns
    assert sorted(r["team_id"] for r in left.collect()) == [3, 4, 5, 6, 7]
    got = {(r["table_name"], r["column_name"]): r["rows"] for r in merges.plan(tables, teams, "team_id", closed).collect()}
    assert got == {("entities", "team_id"): 2, ("problems", "circle"): 2, ("problems", "ambiguous"): 0, ("problems", "no such entity"): 1, ("matches", "home"): 1, ("matches", "away"): 2}
    assert merges.resolved(spark.createDataFrame([], "old_id int, new_id int")).count() == 0
