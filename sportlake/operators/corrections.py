"""Corrections from table to table: merging, upserts, deduplication, reclassification, id assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sportlake.operators.windows import keep_first


def upsert_latest(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source win over rows of target with the same key (NULL is a value)."""
    both = target.withColumn("_p", F.lit(1)).unionByName(source.withColumn("_p", F.lit(0)))
    return keep_first(both, keys, ["_p"]).drop("_p")


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source whose key target lacks are added."""
    return target.unionByName(source.join(target.select(*keys).distinct(), keys, "left_anti"))


def upsert_merge(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Per-column rules where both have the key: overwrite, fill (new, else old), greatest, either."""
    old, new = target.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rules]), source.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rules], F.lit(True).alias("_new"))

    def merged(c: str, rule: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if rule == "overwrite":
            return F.when(F.col("_new"), n).otherwise(o)
        return {"fill": lambda: F.coalesce(n, o), "greatest": lambda: F.greatest(n, o), "either": lambda: F.coalesce(n, F.lit(False)) | F.coalesce(o, F.lit(False))}[rule]()

    return old.join(new, keys, "full").select(*keys, *[merged(c, r).alias(c) for c, r in rules.items()])


def append_missing(target: DataFrame, source: DataFrame, key: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of source with a new key and no NULL in the required columns; and counts of copied and skipped rows."""
    fresh = source.join(target.select(key).distinct(), key, "left_anti")
    whole = ~F.greatest(*[F.col(c).isNull() for c in required]) if len(required) > 1 else F.col(required[0]).isNotNull()
    return fresh.filter(whole), fresh.agg(F.count_if(whole).alias("copied"), F.count_if(~whole).alias("skipped"))


def merge_entities(df: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    """Every listed column repointed by mapping (old_id, new_id)."""
    for c in columns:
        df = df.join(mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def merge_counts(tables: dict[str, tuple[DataFrame, list[str]]], mapping: DataFrame) -> DataFrame:
    """Rows that a merge would repoint, per table and column."""
    out = None
    for name, (df, columns) in tables.items():
        for c in columns:
            part = df.join(mapping.select(F.col("old_id").alias(c)), c, "left_semi").agg(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.count("*").alias("rows"))
            out = part if out is None else out.unionByName(part)
    return out


def drop_duplicate_matches(m: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Matches without repeats of the keys, and the ids that went (to be taken from every event table)."""
    numbered = m.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("match_id")))
    return numbered.filter("_rn = 1").drop("_rn"), numbered.filter("_rn > 1").select("match_id")


def cascade(events: DataFrame, gone: DataFrame) -> DataFrame:
    return events.join(gone, "match_id", "left_anti")


def dedupe_events(events: DataFrame, keys: list[str], id_column: str, order: list[str] = ()) -> DataFrame:
    """One event per natural key, NULL counting as a value: the smallest id."""
    return keep_first(events, keys, [id_column, *order])


def reclassify(m: DataFrame, wrong: Column, competition_id: int) -> tuple[DataFrame, DataFrame]:
    """Matches moved to another competition, and the season-competition pairs that this needs anew."""
    moved = m.withColumn("competition_id", F.when(wrong, competition_id).otherwise(F.col("competition_id"))).withColumn("season_competition_id", F.col("season_id") * 10 + F.col("competition_id"))
    pairs = ["season_competition_id", "season_id", "competition_id"]
    return moved, moved.select(*pairs).distinct().join(m.select("season_competition_id").distinct(), "season_competition_id", "left_anti").select(*pairs)


def relink_leagues(season_competitions: DataFrame, leagues: DataFrame) -> DataFrame:
    """Season-competitions repointed to the league of their season's band, of several the smallest. leagues: first, last, new_competition_id."""
    seasons = leagues.select(F.explode(F.sequence("first", "last")).alias("season_id"), "new_competition_id").groupBy("season_id").agg(F.min("new_competition_id").alias("new_competition_id"))
    return season_competitions.join(seasons, "season_id", "left").withColumn("competition_id", F.coalesce("new_competition_id", "competition_id")).drop("new_competition_id")


def clean_leading_marks(df: DataFrame, column: str = "name") -> DataFrame:
    """Leading question marks and blanks removed, unless nothing would be left."""
    clean = F.regexp_replace(column, r"^[?\s]+", "")
    return df.withColumn(column, F.when(clean != "", clean).otherwise(F.col(column)))


def purge(df: DataFrame, columns: list[str], gone: DataFrame, key: str) -> DataFrame:
    """Rows that refer to none of the purged entities in any of the columns."""
    for c in columns:
        df = df.join(gone.select(F.col(key).alias(c)).distinct(), c, "left_anti")
    return df


def decide_cleaning(findings: DataFrame, usage: DataFrame, key: str = "player_id") -> DataFrame:
    """delete if unused, else update if a right name is known, else needs_review."""
    out = findings.join(usage.select(key, "uses"), key, "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))
    return out.withColumn("action", F.when(F.col("uses") == 0, "delete").when(F.col("right_name").isNotNull(), "update").otherwise("needs_review"))


def enrich_profiles(df: DataFrame, facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New value where there is one, else the old."""
    new = facts.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(new, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return out


def rebuild_careers(stations: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All stations of the people in fresh are replaced."""
    return stations.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def resolve_player_names(appearances: DataFrame, profiles: DataFrame) -> DataFrame:
    """The full name of the profile behind an appearance's url, else its own name."""
    full = profiles.groupBy("profile_url").agg(F.min("full_name").alias("_full"))
    return appearances.join(full, "profile_url", "left").withColumn("name", F.coalesce("_full", "name")).drop("_full")


def assign_ids(names: DataFrame, existing: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """normalized_name and id: the existing one, else new ids from the largest on, in order of the names' MD5, so that they do not depend on how rows are dealt.

    New names are numbered inside ranges of the hash that follow one another, so no task sees all of them.
    """
    known = existing.groupBy("normalized_name").agg(F.min(key).alias(key))
    fresh = names.select("normalized_name").filter("normalized_name IS NOT NULL").distinct().join(known, "normalized_name", "left_anti").withColumn("_h", F.md5("normalized_name"))
    fresh = fresh.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * buckets / 65536).withColumn("_b", F.floor("_b"))
    base = fresh.groupBy("_b").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_base")
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    order = Window.partitionBy("_b").orderBy("_h", "normalized_name")
    new = fresh.withColumn("_rn", F.row_number().over(order)).join(base, "_b").crossJoin(F.broadcast(top)).select("normalized_name", (F.col("_top") + F.col("_base") + F.col("_rn")).alias(key))
    return known.unionByName(new)



def standings(m: DataFrame, side: str) -> DataFrame:
    """Points and goals of one side of played matches, per season-competition, matchday and team."""
    own, other = (f"{side}_score", "away_score" if side == "home" else "home_score")
    points = F.when(F.col(own) > F.col(other), 3).when(F.col(own) == F.col(other), 1).otherwise(0)
    return m.filter("home_score IS NOT NULL").select("season_competition_id", "matchday", F.col(f"{side}_team_id").alias("team_id"), points.alias("points"), F.col(own).alias("goals_for"), F.col(other).alias("goals_against"))


def set_standings(m: DataFrame) -> DataFrame:
    """Table of each season-competition: totals, goal difference and place."""
    rows = standings(m, "home").unionByName(standings(m, "away"))
    out = rows.groupBy("season_competition_id", "team_id").agg(*[F.sum(c).alias(c) for c in ("points", "goals_for", "goals_against")]).withColumn("goal_difference", F.col("goals_for") - F.col("goals_against"))
    order = Window.partitionBy("season_competition_id").orderBy(F.col("points").desc(), F.col("goal_difference").desc(), F.col("goals_for").desc(), "team_id")
    return out.withColumn("place", F.row_number().over(order))


def rename_if_free(df: DataFrame, fuller: DataFrame, key: str) -> DataFrame:
    """The fuller name of a row, unless another row has it already."""
    free = fuller.join(df.select(F.col("name").alias("full_name")).distinct(), "full_name", "left_anti")
    one = free.groupBy(key).agg(F.min("full_name").alias("_full"))
    one = one.join(one.groupBy("_full").agg(F.min(key).alias(key)).select(key, "_full"), [key, "_full"], "left_semi")
    return df.join(one, key, "left").withColumn("name", F.coalesce("_full", "name")).drop("_full")


def reload_events(target: DataFrame, source: DataFrame, matches: DataFrame) -> DataFrame:
    """Events of the given matches replaced by those of source."""
    ids = matches.select("match_id").distinct()
    return target.join(ids, "match_id", "left_anti").unionByName(source.join(ids, "match_id", "left_semi").select(*target.columns))
