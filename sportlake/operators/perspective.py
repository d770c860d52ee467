"""Matches seen from one focal team: filters, derived columns, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOME, AWAY = "home_team_id", "away_team_id"


def focal_matches(m: DataFrame, focal: int = 1) -> DataFrame:
    """Matches with the focal team on either side."""
    return m.filter((F.col(HOME) == focal) | (F.col(AWAY) == focal))


def focal_perspective(m: DataFrame, focal: int = 1) -> DataFrame:
    """location, own_score, opponent_score and opponent_id; NULL location where neither side is focal."""
    home, away = F.col(HOME) == focal, F.col(AWAY) == focal
    return m.withColumns(
        {
            "location": F.when(home, "Home").when(away, "Away"),
            "own_score": F.when(home, F.col("home_score")).when(away, F.col("away_score")),
            "opponent_score": F.when(home, F.col("away_score")).when(away, F.col("home_score")),
            "opponent_id": F.when(home, F.col(AWAY)).when(away, F.col(HOME)),
        }
    )


def outcome(own: Column, other: Column, labels: tuple[str, str, str] = ("W", "D", "L"), null_as: str | None = None) -> Column:
    """Win, draw or loss in the given labels; null_as where a score is missing."""
    return F.when(own > other, labels[0]).when(own == other, labels[1]).when(own < other, labels[2]).otherwise(F.lit(null_as))


def result_wdl(m: DataFrame, focal: int = 1, null_as: str | None = None) -> DataFrame:
    return focal_perspective(focal_matches(m, focal), focal).withColumn("result", outcome(F.col("own_score"), F.col("opponent_score"), null_as=null_as))


def result_label(m: DataFrame, focal: int = 1, labels: tuple[str, str, str] = ("Sieg", "Unentschieden", "Niederlage"), unknown: str = "Unbekannt") -> DataFrame:
    """Result and location in words; unknown where neither side is focal or a score is missing."""
    seen = focal_perspective(m, focal)
    return seen.withColumns({"result": outcome(F.col("own_score"), F.col("opponent_score"), labels, unknown), "location": F.coalesce("location", F.lit(unknown))})


def league_points(m: DataFrame, focal: int = 1) -> DataFrame:
    seen = result_wdl(m, focal)
    return seen.withColumn("points", F.when(F.col("result") == "W", 3).when(F.col("result") == "D", 1).when(F.col("result") == "L", 0))


def played_only(m: DataFrame) -> DataFrame:
    return m.filter("home_score IS NOT NULL AND away_score IS NOT NULL")


def unplayed(m: DataFrame) -> DataFrame:
    return m.filter("home_score IS NULL OR away_score IS NULL")


def exclude_misclassified(m: DataFrame, competition_id: int, source: str) -> DataFrame:
    """Without matches of a competition that come from a source of another; a NULL source stays."""
    wrong = (F.col("competition_id") == competition_id) & F.col("source_file").contains(source)
    return m.filter(~F.coalesce(wrong, F.lit(False)))


def in_competitions(m: DataFrame, ids: list[int]) -> DataFrame:
    return m.filter(F.col("competition_id").isin(ids))


def name_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.lower(column).contains(text.lower()))


def focal_team_ids(teams: DataFrame, names: list[str], default: int) -> DataFrame:
    """Ids of all teams with one of the names in theirs, or the default id if there is none."""
    found = teams.filter(F.lower("name").rlike("|".join(n.lower() for n in names))).select("team_id")
    return with_default(found, "team_id", default)


def with_default(df: DataFrame, column: str, default: int) -> DataFrame:
    """df, or one row with the default if df is empty."""
    kind = df.schema[column].dataType
    none = df.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(default).cast(kind).alias(column))
    return df.select(column).unionByName(none)


def date_between(m: DataFrame, first: str, last: str) -> DataFrame:
    return m.filter(F.col("match_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def recent(m: DataFrame, asof: str, months: int = 24, column: str = "match_date") -> DataFrame:
    """Rows of the last months up to and with asof."""
    end = F.lit(asof).cast("date")
    return m.filter((F.col(column) >= F.add_months(end, -months)) & (F.col(column) <= end))


def total_minute(g: DataFrame) -> DataFrame:
    return g.withColumn("total_minute", F.col("minute") + F.coalesce("stoppage", F.lit(0)))


def stoppage_goals(g: DataFrame, half: int = 90) -> DataFrame:
    return g.filter((F.col("minute") > half) | ((F.col("minute") == half) & (F.col("stoppage") > 0)))


def with_scoreline(m: DataFrame, line: str, focal: int = 1) -> DataFrame:
    own, other = map(int, line.split(":"))
    return focal_perspective(focal_matches(m, focal), focal).filter((F.col("own_score") == own) & (F.col("opponent_score") == other))


def score_text() -> Column:
    """home:away; NULL where a score is."""
    return F.concat(F.col("home_score").cast("string"), F.lit(":"), F.col("away_score").cast("string"))


def minute_bucket(minute: Column, stoppage: Column) -> Column:
    late = (minute > 90) | ((minute == 90) & (F.coalesce(stoppage, F.lit(0)) > 0))
    out = F.when(late, "90+")
    for last in (15, 30, 45, 60, 75, 90):
        out = out.when(minute <= last, f"{last - 14 if last > 15 else 0}-{last}")
    return out


def era_bucket(year: Column) -> Column:
    out = F.when(year < 1950, "Pre-1950")
    for first in (1950, 1970, 1990):
        out = out.when(year < first + 20, f"{first}-{first + 19}")
    return out.otherwise("2010+")


def in_bands(df: DataFrame, column: str, bands: list[tuple[int, int, str]], name: str) -> DataFrame:
    """The label of the band (first, last, label) that the column's value lies in."""
    out = F.lit(None).cast("string")
    for first, last, label in reversed(bands):
        out = F.when(F.col(column).between(first, last), label).otherwise(out)
    return df.withColumn(name, out)


def league_level(name: Column) -> Column:
    """Level of a competition by its name; the order of the tests matters."""
    low = F.lower(name)
    # Words in the names of leagues, in the order in which they decide.
    return (
        F.when(low.contains("bundesliga") & ~low.contains("2.") & ~low.contains("süd"), "first_division").when(low.rlike(r"2\. ?bundesliga"), "second_division").when(low.contains("regionalliga"), "third_division").when(low.rlike("amateur|oberliga"), "amateur")
        .when(low.rlike("gauliga|bezirks|kreis|klasse"), "historical").when(low.contains("pokal"), "cup").when(low.rlike("champions league|europa league|uefa"), "international").otherwise("other")
    )


def minutes_played(lineups: DataFrame, substitutions: DataFrame) -> DataFrame:
    """A starter plays to the minute he goes off, else 90; another from his first minute on to 90. Never below 0."""
    off = substitutions.groupBy("match_id", F.col("player_off_id").alias("player_id")).agg(F.min("minute").alias("off"))
    on = substitutions.groupBy("match_id", F.col("player_on_id").alias("player_id")).agg(F.min("minute").alias("on"))
    rows = lineups.join(off, ["match_id", "player_id"], "left").join(on, ["match_id", "player_id"], "left")
    return rows.withColumn("minutes", F.when(F.col("is_starter"), F.coalesce("off", F.lit(90))).otherwise(F.greatest(F.lit(0), 90 - F.coalesce("on", F.lit(90)))))


def data_question(text: Column, keywords: list[str]) -> Column:
    """Does a message hold one of the keywords."""
    return F.lower(text).rlike("|".join(keywords))


def active_sessions(s: DataFrame, asof: str) -> DataFrame:
    return s.withColumn("active", F.col("expires_at") >= F.lit(asof).cast("timestamp"))


def short_names(df: DataFrame, n: int = 5) -> DataFrame:
    return df.filter(F.length("name") <= n)


def preview(column: str, n: int = 100) -> Column:
    return F.substring(column, 1, n)


def matches_against(m: DataFrame, teams: DataFrame, opponent: str, focal: int = 1) -> DataFrame:
    """Matches against opponents whose name holds the text, with result."""
    wanted = name_contains(teams, "name", opponent).select(F.col("team_id").alias("opponent_id"), F.col("name").alias("opponent"))
    return result_wdl(m, focal).join(wanted, "opponent_id")


def career_stations(people: DataFrame, stations: DataFrame, key: str) -> DataFrame:
    """Stations with the person's name, numbered in time order; a NULL year comes first."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.coalesce("start_year", F.lit(0)), "team_name")
    return stations.join(people.select(key, "name"), key).withColumn("station", F.row_number().over(order))


def season_fixtures(m: DataFrame, season_id: int, competition_id: int) -> DataFrame:
    return m.filter((F.col("season_id") == season_id) & (F.col("competition_id") == competition_id)).orderBy("match_date", "matchday", "match_id")
