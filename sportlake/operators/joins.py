"""Joins of matches, people and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_star(m: DataFrame, seasons: DataFrame, competitions: DataFrame, teams: DataFrame) -> DataFrame:
    """Matches with season label, competition name and both team names."""
    out = m.join(seasons.select("season_id", F.col("label").alias("season")), "season_id").join(competitions.select("competition_id", F.col("name").alias("competition")), "competition_id")
    return role_teams(out, teams)


def role_teams(m: DataFrame, teams: DataFrame) -> DataFrame:
    """The team dimension in two roles."""
    for side in ("home", "away"):
        m = m.join(teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_team")), f"{side}_team_id")
    return m


def team_matches(teams: DataFrame, m: DataFrame) -> DataFrame:
    """Each team with its matches on either side, once each; teams without any stay. Two equal keys instead of an OR."""
    sides = m.select("match_id", F.explode(F.array_distinct(F.array("home_team_id", "away_team_id"))).alias("team_id"))
    return teams.join(sides, "team_id", "left")


def opponent_join(focal: DataFrame, teams: DataFrame) -> DataFrame:
    return focal.join(teams.select(F.col("team_id").alias("opponent_id"), F.col("name").alias("opponent")), "opponent_id")


def semi_focal(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Matches with one of the ids on a side, and which side."""
    flag = ids.select("team_id").distinct()
    out = m.join(flag.select(F.col("team_id").alias("home_team_id"), F.lit(True).alias("focal_home")), "home_team_id", "left").join(flag.select(F.col("team_id").alias("away_team_id"), F.lit(True).alias("focal_away")), "away_team_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("focal_home", "focal_away")}).filter("focal_home OR focal_away")


def anti_missing(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """Parents without a child."""
    return parent.join(child.select(*keys).distinct(), keys, "left_anti")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Children whose value is not NULL and no parent's key."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def without_events(m: DataFrame, **events: DataFrame) -> DataFrame:
    """match_id and kind for every kind of event that a match has none of."""
    out = None
    for kind, rows in events.items():
        part = anti_missing(m, rows, ["match_id"]).select("match_id", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def cross_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row beside the single row of a one-row aggregate."""
    return df.crossJoin(F.broadcast(one.limit(1)))


def goals_with_assists(g: DataFrame, players: DataFrame) -> DataFrame:
    names = players.select("player_id", "name")
    scorer = g.join(names.withColumnRenamed("name", "scorer"), "player_id")
    return scorer.join(names.select(F.col("player_id").alias("assist_player_id"), F.col("name").alias("assist")), "assist_player_id", "left")


def backfill_fk(fact: DataFrame, name: str, dim: DataFrame, key: str) -> DataFrame:
    """Key of the dimension by trimmed lower name, else by normalised name; the smallest key where several fit."""
    exact = dim.groupBy(F.lower("name").alias("_n")).agg(F.min(key).alias("_exact"))
    normal = dim.groupBy(F.col("normalized_name").alias("_n")).agg(F.min(key).alias("_normal"))
    keyed = fact.withColumn("_n", F.lower(F.trim(name)))
    return keyed.join(exact, "_n", "left").join(normal, "_n", "left").withColumn(key, F.coalesce("_exact", "_normal")).drop("_n", "_exact", "_normal")


def map_ids(source: DataFrame, target: DataFrame, key: str, aliases: DataFrame | None = None) -> DataFrame:
    """source key, target key and how it was found: exact name, normalised name, alias; NULL target if not at all."""
    by_name = target.groupBy("name").agg(F.min(key).alias("_a"))
    by_normal = target.groupBy("normalized_name").agg(F.min(key).alias("_b"))
    out = source.select(F.col(key).alias("source_id"), "name", "normalized_name").join(by_name, "name", "left").join(by_normal, "normalized_name", "left")
    if aliases is not None:  # alias (normalised name), name of the target
        out = out.join(aliases.join(by_name.withColumnRenamed("_a", "_c"), "name").select(F.col("alias").alias("normalized_name"), "_c"), "normalized_name", "left")
    else:
        out = out.withColumn("_c", F.lit(None).cast("long"))
    how = F.when(F.col("_a").isNotNull(), "name").when(F.col("_b").isNotNull(), "normalized").when(F.col("_c").isNotNull(), "alias")
    return out.select("source_id", F.coalesce("_a", "_b", "_c").alias("target_id"), how.alias("found_by"))


def map_matches(source: DataFrame, target: DataFrame) -> DataFrame:
    """Matches of two databases by date and both team names; the smallest target where several fit."""
    keys = ["match_date", "home_team", "away_team"]
    return source.select(F.col("match_id").alias("source_id"), *keys).join(target.groupBy(*keys).agg(F.min("match_id").alias("target_id")), keys, "left").select("source_id", "target_id")


def remap_events(events: DataFrame, required: dict[str, DataFrame], optional: dict[str, DataFrame]) -> DataFrame:
    """Ids rewritten by maps of (source_id, target_id): rows without a required id go, an optional one becomes NULL."""
    for how, maps in (("inner", required), ("left", optional)):
        for column, ids in maps.items():
            found = ids.filter("target_id IS NOT NULL").select(F.col("source_id").alias(column), F.col("target_id").alias("_new"))
            events = events.join(found, column, how).withColumn(column, F.col("_new")).drop("_new")
    return events


def match_surname(names: DataFrame, players: DataFrame) -> DataFrame:
    """One-word names to the player with that last name; the longest name, then the smallest id, wins."""
    last = players.withColumn("surname", F.element_at(F.split("name", " "), -1))
    best = last.withColumn("_r", F.row_number().over(Window.partitionBy("surname").orderBy(F.length("name").desc(), "player_id"))).filter("_r = 1")
    return names.filter(~F.col("name").contains(" ")).join(best.select(F.col("surname").alias("name"), "player_id"), "name")


def enrich_by_lastname(players: DataFrame, profiled: DataFrame, fields: list[str]) -> DataFrame:
    """Fields copied from the only profiled player with the same last name; of several, the first whose name holds or is held.

    Only different names are compared, so pairs do not grow with the rows of a name.
    """
    last = lambda df: df.withColumn("_last", F.element_at(F.split("name", " "), -1))
    donor = F.struct(F.col("player_id").alias("donor_id"), *fields)
    donors = last(profiled).groupBy("_last", F.col("name").alias("_name")).agg(F.min(donor).alias("_donor"), F.count("*").alias("_n"))
    donors = donors.withColumn("_n", F.sum("_n").over(Window.partitionBy("_last")))
    pairs = last(players.select("name").distinct()).join(donors, "_last").filter((F.col("_n") == 1) | F.col("name").contains(F.col("_name")) | F.col("_name").contains(F.col("name")))
    found = pairs.groupBy("name").agg(F.min("_donor").alias("_donor"))
    first = players.select("player_id", "name").join(found, "name").groupBy("player_id").agg(F.min("_donor").alias("_donor"))
    return players.drop(*fields).join(first.select("player_id", "_donor.*"), "player_id", "left")


def source_context(bad: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first kind of source (in the given order) that mentions each player, with its smallest match."""
    parts = None
    for rank, (kind, rows) in enumerate(sources):
        part = rows.select("player_id", "match_id", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
        parts = part if parts is None else parts.unionByName(part)
    first = parts.join(bad.select("player_id").distinct(), "player_id", "left_semi").groupBy("player_id").agg(F.min(F.struct("rank", "kind", "match_id")).alias("x"))
    return first.select("player_id", "x.kind", "x.match_id")


def counts_per_match(m: DataFrame, **events: DataFrame) -> DataFrame:
    """Number of each kind of event per match, 0 where none."""
    for kind, rows in events.items():
        m = m.join(rows.groupBy("match_id").agg(F.count("*").alias(kind)), "match_id", "left").withColumn(kind, F.coalesce(kind, F.lit(0).cast("long")))
    return m


def latest_match_lineup(lineups: DataFrame) -> DataFrame:
    return cross_one(lineups, lineups.agg(F.max("match_id").alias("last"))).filter("match_id = last").drop("last")


def token_join(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs where the name stands in the text: found by a shared token, so nothing is compared with everything, then checked whole."""
    tokens = lambda df, c: df.withColumn("_token", F.explode(F.array_distinct(F.split(F.lower(c), r"\s+")))).filter("_token <> ''")
    last = names.withColumn("_token", F.element_at(F.split(F.lower(name), r"\s+"), -1))
    return tokens(texts, text).join(last, "_token").filter(F.lower(text).contains(F.lower(name))).drop("_token").distinct()


def match_profiles(profiles: DataFrame, players: DataFrame) -> DataFrame:
    """Profiles (profile_id, full_name) to players: the same name, else a player's name within the full name; all hits."""
    exact = profiles.join(players.select("player_id", F.col("name").alias("full_name")), "full_name").select("profile_id", "player_id")
    left = profiles.join(exact, "profile_id", "left_anti")
    return exact.unionByName(token_join(left, "full_name", players.select("player_id", "name"), "name").select("profile_id", "player_id"))
