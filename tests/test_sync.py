"""Full sync of two small archives against what it should give, row by row."""

import datetime as dt

import pytest

from sportlake.operators import sync

DAY = [dt.date(2020, 1, k) for k in range(1, 9)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def target(spark):
    return sync.Snapshot.of(spark, {
        "teams": frame(spark, [(1, "Alpha", "alpha"), (2, "Beta", "beta")], "team_id int, name string, normalized_name string"),
        "players": frame(spark, [(1, "Ann", "ann"), (7, "Bo", "bo")], "player_id long, name string, normalized_name string"),
        "competitions": frame(spark, [(1, "Liga")], "competition_id int, name string"),
        "seasons": frame(spark, [(2020, "2020-21")], "season_id int, label string"),
        "matches": frame(spark, [(10, DAY[0], 1, 2, 2020, 1, 3)], "match_id long, match_date date, home_team_id int, away_team_id int, season_id int, competition_id int, home_score int"),
        "lineups": frame(spark, [(10, 1, 4)], "match_id long, player_id long, shirt_number int"),
        "goals": frame(spark, [], "match_id long, player_id long, assist_player_id long, minute int"),
    })


def source(spark):
    return {
        "teams": frame(spark, [(51, "beta", "Beta 2"), (52, "gamma", "Gamma"), (53, "alpha", "Alpha 2"), (54, None, "?"), (55, "gamma", "again")], "team_id int, normalized_name string, name string"),
        "players": frame(spark, [(100, "Bo", "bo"), (101, "Cy", "cy"), (102, "Cy", "cy")], "player_id long, name string, normalized_name string"),
        "competitions": frame(spark, [(9, "Liga"), (8, "Pokal")], "competition_id int, name string"),
        "seasons": frame(spark, [(2020, "2020-21"), (1, "2021-22")], "season_id int, label string"),
        "matches": frame(spark, [(900, DAY[0], 53, 51, 2020, 9, 5), (901, DAY[1], 52, 51, 1, 8, 1), (902, DAY[1], 55, 51, 1, 8, 2), (903, DAY[2], 54, 51, 1, 8, 0), (904, None, 52, 51, 1, 8, 0)], "match_id long, match_date date, home_team_id int, away_team_id int, season_id int, competition_id int, home_score int"),
        "lineups": frame(spark, [(900, 100, 9), (901, 100, 9), (902, 102, 3), (902, 101, 3), (903, 100, 1), (901, 555, 2)], "match_id long, player_id long, shirt_number int"),
        "goals": frame(spark, [(900, 100, None, 7), (902, 101, 100, 8), (902, 101, 999, 9)], "match_id long, player_id long, assist_player_id long, minute int"),
    }


def rows(snapshot, name):
    return sorted(map(tuple, snapshot.read(name).collect()), key=str)


def test_everything_is_brought_in(spark):
    to = target(spark)
    report = {r["table_name"]: tuple(r)[1:] for r in sync.full_sync(source(spark), to).collect()}
    assert rows(to, "teams") == [(1, "Alpha", "alpha"), (2, "Beta", "beta"), (3, "Gamma", "gamma")]
    assert rows(to, "players") == [(1, "Ann", "ann"), (7, "Bo", "bo"), (8, "Cy", "cy")]
    assert rows(to, "competitions") == [(1, "Liga"), (2, "Pokal")] and rows(to, "seasons") == [(2020, "2020-21"), (2021, "2021-22")]
    assert rows(to, "matches") == sorted([(10, DAY[0], 1, 2, 2020, 1, 3), (11, DAY[1], 3, 2, 2021, 2, 1)], key=str)
    assert rows(to, "lineups") == sorted([(10, 1, 4), (11, 7, 9), (11, 8, 3)], key=str)  # the match that has a line-up keeps it
    assert rows(to, "goals") == sorted([(10, 7, None, 7), (11, 8, 7, 8)], key=str)
    assert report == {"teams": (1, 2, 1), "players": (1, 2, 0), "competitions": (1, 1, 0), "seasons": (1, 1, 0), "matches": (1, 1, 2), "lineups": (2, 1, 4), "goals": (2, 0, 1)}
    again = {r["table_name"]: r["created"] for r in sync.full_sync(source(spark), to).collect()}
    assert set(again.values()) == {0} and len(rows(to, "lineups")) == 3


@pytest.mark.parametrize("stage", ["players", "matches", "goals"])
def test_a_broken_stage_leaves_the_target(spark, stage):
    to = target(spark)
    before = {name: rows(to, name) for name in to.paths()}
    with pytest.raises(RuntimeError, match=stage):
        sync.full_sync(source(spark), to, fail_at=stage)
    assert {name: rows(to, name) for name in to.paths()} == before
    sync.full_sync(source(spark), to)
    assert len(rows(to, "matches")) == 2
