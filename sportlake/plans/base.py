"""How a query is registered: a function of the archive, and SQL over the same derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sportlake.sources.archive import SQL, Archive

FOCAL = """
f AS (SELECT *, CASE WHEN own_score > opponent_score THEN 'W' WHEN own_score = opponent_score THEN 'D' WHEN own_score < opponent_score THEN 'L' END AS result FROM (
  SELECT *, CASE WHEN home_team_id = 1 THEN 'Home' ELSE 'Away' END AS location, CASE WHEN home_team_id = 1 THEN home_score ELSE away_score END AS own_score,
    CASE WHEN home_team_id = 1 THEN away_score ELSE home_score END AS opponent_score, CASE WHEN home_team_id = 1 THEN away_team_id ELSE home_team_id END AS opponent_id
  FROM matches WHERE home_team_id = 1 OR away_team_id = 1))"""

#: Plain SQL for what record() gives.
RECORD = """count(*) AS matches, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'D') AS draws, count(*) FILTER (result = 'L') AS losses,
  sum(own_score)::BIGINT AS goals_for, sum(opponent_score)::BIGINT AS goals_against, (sum(own_score) - sum(opponent_score))::BIGINT AS goal_difference,
  ((count(*) FILTER (result = 'W') * 2000 + count(*)) // (2 * count(*)))::DOUBLE / 10 AS win_pct"""

Made = Callable[[Archive], DataFrame]


def full_sql(sql: str) -> str:
    """The query after the derived tables; sql may begin with further tables, ending in a comma-free SELECT."""
    head, select = ("", sql) if sql.lstrip().upper().startswith(("SELECT", "(", "FROM")) else sql.split("\n--\n", 1)
    return f"WITH {SQL.strip()},{FOCAL}{',' + head if head else ''} {select}"


def as_query(made: Made) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: made(Archive(spark, folder))
