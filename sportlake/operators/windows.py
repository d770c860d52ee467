"""Window functions, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sportlake.functions.numbers import ratio


def ranked(df: DataFrame, keys: list, order: list, name: str = "rn") -> DataFrame:
    """Row number per key; order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return ranked(df, keys, order, "_rn").filter("_rn = 1").drop("_rn")


def rank_duplicates(m: DataFrame) -> DataFrame:
    """Matches of one competition season, date, sides and score, numbered by id; from 2 on they are repeats."""
    return ranked(m, ["season_competition_id", "match_date", "home_team_id", "away_team_id", "home_score", "away_score"], ["match_id"])


def current_streak(answers: DataFrame) -> DataFrame:
    """Correct answers since the last miss, per player."""
    newest = Window.partitionBy("player").orderBy(F.col("submitted_at").desc(), F.col("answer_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = answers.withColumn("misses", F.sum((~F.col("is_correct")).cast("int")).over(newest))
    return rows.groupBy("player").agg(F.count_if((F.col("misses") == 0) & F.col("is_correct")).alias("current_streak"))


def best_streak(answers: DataFrame) -> DataFrame:
    """The longest run of correct answers, per player."""
    so_far = Window.partitionBy("player").orderBy("submitted_at", "answer_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = answers.withColumn("island", F.sum((~F.col("is_correct")).cast("int")).over(so_far)).groupBy("player", "island").agg(F.count_if("is_correct").alias("n"))
    return runs.groupBy("player").agg(F.max("n").alias("best_streak"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("percent", ratio("n", "_all", 2, 100)).drop("_all")


def best_season(goals: DataFrame, m: DataFrame) -> DataFrame:
    """The season with most goals of each player; the earliest of equals."""
    n = goals.join(m.select("match_id", "season_id"), "match_id").groupBy("player_id", "season_id").agg(F.count("*").alias("goals"))
    return keep_first(n, ["player_id"], [F.col("goals").desc(), "season_id"])


def scoring_side(goals: DataFrame) -> DataFrame:
    """Home if the home score rose over the goal before in the match, else away."""
    order = Window.partitionBy("match_id").orderBy("minute", F.coalesce("stoppage", F.lit(0)), "goal_id", "assist_player_id")
    return goals.withColumn("side", F.when(F.col("score_home") > F.lag("score_home", 1, 0).over(order), "home").otherwise("away"))


def running_matchday(m: DataFrame) -> DataFrame:
    """Matches of a competition season numbered by date and id: inside months, plus the matches of the months before, so no task holds a season."""
    month = F.date_trunc("month", "match_date")
    inside = ranked(m.withColumn("_month", month), ["season_competition_id", "_month"], ["match_date", "match_id"], "_rn")
    before = Window.partitionBy("season_competition_id").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = m.groupBy("season_competition_id", month.alias("_month")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    names = {"season_competition_id": "_sc", "_month": "_at"}  # a missing date or season is a group of its own, first in order
    joined = inside.join(months.drop("_n").withColumnsRenamed(names), F.col("season_competition_id").eqNullSafe(F.col("_sc")) & F.col("_month").eqNullSafe(F.col("_at")))
    return joined.withColumn("running_matchday", (F.col("_rn") + F.col("_before")).cast("int")).drop("_rn", "_before", "_month", *names.values())


def last_n(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each session, numbered oldest first."""
    rows = ranked(messages, ["session_id"], [F.col("turn").desc()], "_rn").filter(F.col("_rn") <= n)
    return ranked(rows, ["session_id"], ["turn"], "position").drop("_rn")


def first_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return ranked(df, [key], order, "_rn").filter(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_worst(df: DataFrame, value: str, key: str, least: int, k: int) -> DataFrame:
    """The k best and worst rows by a value among those with enough matches."""
    rows = df.filter(F.col("matches") >= least)
    best, worst = top_k(rows, [F.col(value).desc_nulls_last(), key], k), top_k(rows, [F.col(value).asc_nulls_last(), key], k)
    return best.withColumn("end", F.lit("best")).unionByName(worst.withColumn("end", F.lit("worst")))


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page of rows, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: random, and the same each time."""
    return top_k(df, [F.md5(F.concat_ws(":", key, F.lit(seed))), key], n)


def custom_order(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Adds the place of the value in the list; others come last."""
    return df.withColumn("place", F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0)), F.lit(len(values) + 1)))


def shuffled_options(correct: Column, alternatives: Column, key: Column, seed: int) -> Column:
    """All answers of a question in the order of a seeded hash; a NULL answer stays one."""
    tagged = F.transform(F.concat(F.array(correct), alternatives), lambda x: F.struct(F.md5(F.concat_ws(":", key, x, F.lit(seed))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda x: x.x)


def usage_count(lineups: DataFrame, goals: DataFrame, substitutions: DataFrame, cards: DataFrame) -> DataFrame:
    """How often each player is referred to by any fact."""
    parts = [lineups.select("player_id"), goals.select("player_id"), goals.select(F.col("assist_player_id").alias("player_id")), substitutions.select(F.col("player_on_id").alias("player_id")), substitutions.select(F.col("player_off_id").alias("player_id")), cards.select("player_id")]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.filter("player_id IS NOT NULL").groupBy("player_id").agg(F.count("*").alias("uses"))


def missing_values(need: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return need.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def distinct_entities(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).unionByName(b.select(key)).filter(F.col(key).isNotNull()).distinct()


def match_timeline(goals: DataFrame, cards: DataFrame, substitutions: DataFrame) -> DataFrame:
    """One list of events per match, numbered by minute; cards without a minute come last."""
    rows = goals.select("match_id", "minute", "player_id", F.lit("goal").alias("kind"))
    rows = rows.unionByName(cards.select("match_id", "minute", "player_id", F.lit("card").alias("kind"))).unionByName(substitutions.select("match_id", "minute", F.col("player_on_id").alias("player_id"), F.lit("substitution").alias("kind")))
    return ranked(rows, ["match_id"], [F.col("minute").asc_nulls_last(), "kind", "player_id"], "position")


def missing_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Match keys of a that b lacks; NULL scores are equal to each other."""
    keys = ["season_id", "home_team_id", "away_team_id", "match_date"]
    fill = lambda df: df.select(*keys, *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("home_score", "away_score")]).distinct()
    return fill(a).join(fill(b), [*keys, "home_score", "away_score"], "left_anti")
