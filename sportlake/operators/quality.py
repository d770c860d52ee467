"""Data-quality checks. Each gives rows of findings, or counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sportlake.functions import text as tx
from sportlake.operators import aggregates as agg
from sportlake.operators import joins as joi
from sportlake.operators.corrections import dedupe_events


def valid_minute(minute: Column, stoppage: Column | None = None) -> Column:
    """NULL is fine; else 0 to 120, and stoppage 0 to 20."""
    ok = minute.isNull() | minute.between(0, 120)
    return ok if stoppage is None else ok & (stoppage.isNull() | stoppage.between(0, 20))


def valid_refs(events: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Events with the first column whose value is no parent's key; NULL reason if all are."""
    reason = F.lit(None).cast("string")
    for column, (parent, key) in reversed(parents.items()):
        known = parent.select(F.col(key).alias(column), F.lit(True).alias(f"_k_{column}")).distinct()
        events = events.join(known, column, "left")
        reason = F.when(F.col(column).isNotNull() & F.col(f"_k_{column}").isNull(), f"unknown {column}").otherwise(reason)
    return events.withColumn("reason", reason).drop(*[f"_k_{c}" for c in parents])


def ingest_events(events: DataFrame, keys: list[str], id_column: str, parents: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Valid events without repeats, and the rows that went by reason."""
    checked = valid_refs(events, parents).withColumn("reason", F.when(~valid_minute(F.col("minute")), "minute").otherwise(F.col("reason")))
    good = checked.filter("reason IS NULL").drop("reason")
    kept = dedupe_events(good, keys, id_column)
    bad = checked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("rows"))
    repeats = good.groupBy(*keys).count().agg(F.lit("duplicate").alias("reason"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows"))
    return kept, bad.unionByName(repeats)


def sparse_seasons(seasons: DataFrame, m: DataFrame, below: int) -> DataFrame:
    out = agg.season_coverage(seasons, m).filter(F.col("matches") < below)
    return out.withColumn("kind", F.when(F.col("matches") == 0, "empty").otherwise("sparse"))


def bad_player_names(players: DataFrame) -> DataFrame:
    return players.withColumn("reason", tx.player_name_error(F.col("name"))).filter("reason IS NOT NULL")


def record_adds_up(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups where wins, draws and losses are not all matches. rows come from result_wdl."""
    return agg.record(rows, *keys).withColumn("open", F.col("matches") - F.col("wins") - F.col("draws") - F.col("losses")).filter("open <> 0").select(*keys, "matches", "open")


def bad_team_names(teams: DataFrame) -> DataFrame:
    return teams.filter(F.lower("name").contains("trainer") | F.col("name").contains(",") | (F.length("name") > 100))


def goals_per_match_range(m: DataFrame, low: float, high: float) -> DataFrame:
    """Average of score goals per played match, and whether it lies in the range."""
    out = m.filter("home_score IS NOT NULL").agg(F.sum(F.col("home_score") + F.col("away_score")).alias("goals"), F.count("*").alias("matches"))
    return out.withColumn("ok", (F.col("goals") >= F.col("matches") * low) & (F.col("goals") <= F.col("matches") * high))


def expected_matches(m: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    return m.groupBy(*keys).agg(F.count("*").alias("matches")).filter((F.col("matches") < low) | (F.col("matches") > high))


def high_scores(m: DataFrame, score: int, total: int) -> DataFrame:
    rows = m.filter(F.greatest("home_score", "away_score") >= score)
    return rows.withColumn("level", F.when(F.col("home_score") + F.col("away_score") >= total, "warn").otherwise("info"))


def score_vs_goals(m: DataFrame, goals: DataFrame) -> DataFrame:
    """Matches with goals whose counts by side (own goals for the other side) differ from the score."""
    own = F.coalesce(F.col("event_type") == "own_goal", F.lit(False))
    side = F.when(own, ~F.col("at_home")).otherwise(F.col("at_home"))
    n = goals.groupBy("match_id").agg(F.count_if(side).alias("home_goals"), F.count_if(~side).alias("away_goals"))
    return m.join(n, "match_id").filter((F.col("home_score") != F.col("home_goals")) | (F.col("away_score") != F.col("away_goals")))


def halftime_exceeds_final(m: DataFrame) -> DataFrame:
    return m.filter((F.col("halftime_home") > F.col("home_score")) | (F.col("halftime_away") > F.col("away_score")))


def no_lineups(m: DataFrame, lineups: DataFrame, since: int) -> DataFrame:
    return joi.anti_missing(m.filter(F.col("season_id") >= since), lineups, ["match_id"]).groupBy("season_id").agg(F.count("*").alias("matches"))


def date_outside_season(m: DataFrame, seasons: DataFrame, asof: str) -> DataFrame:
    out = m.join(seasons.select("season_id", "start_year", "end_year"), "season_id")
    future = F.col("match_date") > F.lit(asof).cast("date")
    odd = (F.year("match_date") < F.col("start_year")) | (F.year("match_date") > F.col("end_year"))
    return out.withColumn("reason", F.when(future, "future").when(odd, "outside")).filter("reason IS NOT NULL")


def expectations(m: DataFrame, facts: list[tuple[str, str]]) -> DataFrame:
    """Named conditions over the match table and whether they hold."""
    one = m.agg(*[F.expr(sql).alias(name) for name, sql in facts])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).alias("holds")) for n, _ in facts])).alias("x")).select("x.fact", "x.holds")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("empty", F.col("rows") == 0)


def required_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL or empty values per column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.column_name", "x.missing")


def date_format(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def value_ranges(df: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Smallest and largest value per column and how many lie outside the range."""
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high"), F.count_if(~F.col(c).between(a, b)).alias("outside")).alias(c) for c, (a, b) in ranges.items()])
    return one.select(F.explode(F.array(*ranges)).alias("x")).select("x.*")


def domains(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of each side, and rows that only one side has."""
    return a.agg(F.count("*").alias("rows_a")).crossJoin(b.agg(F.count("*").alias("rows_b"))).crossJoin(a.exceptAll(b).agg(F.count("*").alias("only_a"))).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, change."""
    out = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    return out.withColumn("change", F.col("after") - F.col("before"))


def find_name_errors(entities: dict[str, DataFrame], usage: DataFrame | None = None) -> DataFrame:
    """Findings over several kinds of entity: kind, id, name, category, and whether to delete. entities: id, name."""
    out = None
    for kind, df in entities.items():
        category = tx.error_category(F.col("name"))
        if kind != "player":
            category = F.when(category != "contains_comma", category)
        part = df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "name", category.alias("category")).filter("category IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("delete", F.col("category").isin("trainer_name", "referee_name", "goal_text", "error_text"))


def error_breakdown(errors: DataFrame, columns: list[str]) -> DataFrame:
    """Findings counted by each column alone."""
    out = None
    for c in columns:
        part = errors.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).withColumn("by", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def validate_findings(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings beside the name on their profile page (url, page_name), and whether it differs."""
    names = pages.select("url", tx.normalize_whitespace(F.regexp_replace("page_name", "^Schiedsrichterin:", "")).alias("page_name"))
    return findings.join(names, "url", "left").withColumn("differs", F.lower("page_name") != F.lower("name"))
