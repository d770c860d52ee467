"""Sports tables derived from the given tables by integer expressions, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPETITIONS = {1: "Bundesliga", 2: "2. Bundesliga", 3: "Regionalliga Südwest", 4: "DFB-Pokal", 5: "Europapokal"}
TEAMS = 20
_NAME = "CASE {k} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in COMPETITIONS.items()) + " END"


class Archive:
    """The tables of one folder. Facts stay lazy; dimensions are small and left to the optimiser to broadcast."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def teams(self) -> DataFrame:
        return self.spark.range(1, TEAMS + 1).selectExpr("CAST(id AS INT) AS team_id", "concat('Team ', id) AS name", "concat('team ', id) AS normalized_name")

    def players(self) -> DataFrame:
        return self.raw("part").selectExpr("p_partkey + 1 AS player_id", "concat(p_name, ' ', p_partkey) AS name", "p_name AS normalized_name", "p_type AS primary_position", "p_brand AS nationality", "160 + p_size % 40 AS height_cm")

    def seasons(self) -> DataFrame:
        years = self.raw("orders").select(F.year("o_orderdate").alias("y")).distinct()
        return years.selectExpr("y AS season_id", "concat(y, '-', lpad(CAST((y + 1) % 100 AS STRING), 2, '0')) AS label", "y AS start_year", "y + 1 AS end_year")

    def competitions(self) -> DataFrame:
        return self.raw("orders").selectExpr("CAST(substr(o_orderpriority, 1, 1) AS INT) AS competition_id").distinct().withColumn("name", F.expr(_NAME.format(k="competition_id")))

    def season_competitions(self) -> DataFrame:
        return self.matches().select("season_competition_id", "season_id", "competition_id").distinct()

    def matches(self) -> DataFrame:
        keyed = self.raw("orders").selectExpr("o_orderkey AS match_id", "o_custkey AS c", "year(o_orderdate) AS season_id", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS competition_id", "CAST(o_orderdate AS DATE) AS match_date", "CASE o_orderstatus WHEN 'F' THEN 'profirest' ELSE 'liga' END AS source_file", "o_orderkey % 50 = 0 AS open", "CAST(o_custkey % 20 + 1 AS INT) AS home_team_id")
        return keyed.selectExpr(
            "match_id", "season_id", "competition_id", "season_id * 10 + competition_id AS season_competition_id", "match_date", "home_team_id", "CAST((home_team_id + match_id % 19) % 20 + 1 AS INT) AS away_team_id",
            "CASE WHEN NOT open THEN CAST((match_id * 7 + c) % 6 AS INT) END AS home_score", "CASE WHEN NOT open THEN CAST((match_id * 5 + c * 3) % 5 AS INT) END AS away_score",
            "CASE WHEN NOT open THEN CAST((match_id * 7 + c) % 6 AS INT) div 2 END AS halftime_home", "CASE WHEN NOT open THEN CAST((match_id * 5 + c * 3) % 5 AS INT) div 2 END AS halftime_away",
            "CAST(match_id * 37 % 30000 AS INT) AS attendance", "CASE WHEN c % 10 <> 0 THEN CAST(c % 30 + 1 AS INT) END AS referee_id", "CAST(match_id % 34 + 1 AS INT) AS matchday", "concat(match_id % 34 + 1, '. ', CASE WHEN match_id % 3 = 0 THEN 'Runde' ELSE 'Spieltag' END) AS round_name", "source_file",
        )

    def _lines(self, flag: str | None, *more: str) -> DataFrame:
        lines = self.raw("lineitem")
        if flag:
            lines = lines.filter(F.col("l_returnflag") == flag)
        return lines.selectExpr("l_orderkey AS match_id", "l_partkey + 1 AS player_id", "l_suppkey + 1 AS other_id", "l_linenumber AS line", "CAST(l_quantity AS INT) AS q", "l_linestatus AS status", "l_partkey AS p", "l_suppkey AS s", *more)

    def lineup_rows(self) -> DataFrame:
        """Repeats included."""
        return self._lines(None).selectExpr("match_id", "player_id", "line", "line % 2 = 1 AS at_home", "status = 'O' AS is_starter", "q AS shirt_number")

    def lineups(self) -> DataFrame:
        """One row for each match and player."""
        return self.lineup_rows().groupBy("match_id", "player_id").agg(F.min("line").alias("line"), F.max("is_starter").alias("is_starter"), F.min("shirt_number").alias("shirt_number")).withColumn("at_home", F.col("line") % 2 == 1)

    def goals(self) -> DataFrame:
        return self._lines("N").selectExpr(
            "match_id * 10000000 + p * 10 + line AS goal_id", "match_id", "player_id", "CASE WHEN s % 3 = 0 THEN NULL ELSE other_id END AS assist_player_id", "line % 2 = 1 AS at_home", "CASE WHEN q < 45 THEN 2 * q WHEN q = 50 THEN 93 ELSE 90 END AS minute",
            "CASE WHEN q BETWEEN 45 AND 49 THEN line % 5 END AS stoppage", "CASE WHEN p % 10 = 0 THEN 'own_goal' WHEN p % 10 = 1 THEN 'penalty' END AS event_type", "line AS score_home", "CAST(s % 3 AS INT) AS score_away",
        )

    def cards(self) -> DataFrame:
        return self._lines("R").selectExpr("match_id * 10000000 + p * 10 + line AS card_id", "match_id", "player_id", "CASE WHEN s % 10 = 0 THEN q + 10 END AS minute", "CASE CAST(s % 3 AS INT) WHEN 0 THEN 'yellow' WHEN 1 THEN 'second_yellow' ELSE 'red' END AS card_type")

    def player_events(self) -> DataFrame:
        """match_id, player_id, part, kind of all line-ups, goals, assists and cards from one reading of the lines; counted, these are aggregates.player_events."""
        goal = "CASE WHEN p % 10 = 0 THEN 'own_goal' WHEN p % 10 = 1 THEN 'penalty' ELSE 'goal' END"
        kind = f"CASE flag WHEN 'N' THEN {goal} WHEN 'R' THEN CASE s % 3 WHEN 0 THEN 'yellow' WHEN 1 THEN 'second_yellow' ELSE 'red' END END"
        own = f"struct(player_id, IF(status = 'O', 2, 1) AS part, {kind} AS kind)"
        assist = "struct(other_id AS player_id, 0 AS part, IF(p % 10 = 0, 'own_goal_assist', 'assist') AS kind)"
        lines = self._lines(None, "l_returnflag AS flag")
        return lines.selectExpr("match_id", f"inline(IF(flag = 'N' AND s % 3 <> 0, array({own}, {assist}), array({own})))")

    def substitutions(self) -> DataFrame:
        return self._lines("A").selectExpr("match_id * 10000000 + p * 10 + line AS substitution_id", "match_id", "q + 40 AS minute", "player_id AS player_on_id", "other_id AS player_off_id")

    def answers(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id AS answer_id", "user_id AS player", "CAST(event_id % 50 AS INT) AS round_id", "event_type IN ('purchase', 'click') AS is_correct", "CAST(round(value * 100) AS BIGINT) AS time_ms", "event_type AS answer", "ts AS submitted_at")

    def rounds(self) -> DataFrame:
        return self.raw("events").selectExpr("CAST(event_id % 50 AS INT) AS round_id").distinct().selectExpr("round_id", "round_id div 10 AS game_id", "CAST(round_id % 25 AS INT) AS question_id")

    def messages(self) -> DataFrame:
        return self.raw("conversations").selectExpr("conv_id AS session_id", "turn", "role", "text AS content")


SQL = f"""
teams AS (SELECT (i)::INT AS team_id, 'Team ' || i AS name, 'team ' || i AS normalized_name FROM range(1, {TEAMS + 1}) t(i)),
players AS (SELECT p_partkey + 1 AS player_id, p_name || ' ' || p_partkey AS name, p_name AS normalized_name, p_type AS primary_position, p_brand AS nationality, 160 + p_size % 40 AS height_cm FROM part),
seasons AS (SELECT DISTINCT year(o_orderdate)::INT AS season_id, year(o_orderdate) || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS label, year(o_orderdate)::INT AS start_year, (year(o_orderdate) + 1)::INT AS end_year FROM orders),
matches AS (SELECT o_orderkey AS match_id, year(o_orderdate)::INT AS season_id, substr(o_orderpriority, 1, 1)::INT AS competition_id, (year(o_orderdate) * 10 + substr(o_orderpriority, 1, 1)::INT)::INT AS season_competition_id,
  o_orderdate::DATE AS match_date, (o_custkey % 20 + 1)::INT AS home_team_id, ((o_custkey % 20 + 1 + o_orderkey % 19) % 20 + 1)::INT AS away_team_id,
  CASE WHEN o_orderkey % 50 <> 0 THEN ((o_orderkey * 7 + o_custkey) % 6)::INT END AS home_score, CASE WHEN o_orderkey % 50 <> 0 THEN ((o_orderkey * 5 + o_custkey * 3) % 5)::INT END AS away_score,
  CASE WHEN o_orderkey % 50 <> 0 THEN ((o_orderkey * 7 + o_custkey) % 6 // 2)::INT END AS halftime_home, CASE WHEN o_orderkey % 50 <> 0 THEN ((o_orderkey * 5 + o_custkey * 3) % 5 // 2)::INT END AS halftime_away,
  (o_orderkey * 37 % 30000)::INT AS attendance, CASE WHEN o_custkey % 10 <> 0 THEN (o_custkey % 30 + 1)::INT END AS referee_id, (o_orderkey % 34 + 1)::INT AS matchday,
  (o_orderkey % 34 + 1) || '. ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Runde' ELSE 'Spieltag' END AS round_name, CASE o_orderstatus WHEN 'F' THEN 'profirest' ELSE 'liga' END AS source_file FROM orders),
competitions AS (SELECT DISTINCT competition_id, {_NAME.format(k="competition_id")} AS name FROM matches),
season_competitions AS (SELECT DISTINCT season_competition_id, season_id, competition_id FROM matches),
lines AS (SELECT l_orderkey AS match_id, l_partkey + 1 AS player_id, l_suppkey + 1 AS other_id, l_linenumber AS line, l_quantity::INT AS q, l_linestatus AS status, l_returnflag AS flag, l_partkey AS p, l_suppkey AS s FROM lineitem),
lineup_rows AS (SELECT match_id, player_id, line, line % 2 = 1 AS at_home, status = 'O' AS is_starter, q AS shirt_number FROM lines),
lineups AS (SELECT match_id, player_id, min(line) AS line, max(is_starter) AS is_starter, min(shirt_number) AS shirt_number, min(line) % 2 = 1 AS at_home FROM lineup_rows GROUP BY ALL),
goals AS (SELECT match_id * 10000000 + p * 10 + line AS goal_id, match_id, player_id, CASE WHEN s % 3 = 0 THEN NULL ELSE other_id END AS assist_player_id, line % 2 = 1 AS at_home,
  CASE WHEN q < 45 THEN 2 * q WHEN q = 50 THEN 93 ELSE 90 END AS minute, CASE WHEN q BETWEEN 45 AND 49 THEN line % 5 END AS stoppage,
  CASE WHEN p % 10 = 0 THEN 'own_goal' WHEN p % 10 = 1 THEN 'penalty' END AS event_type, line AS score_home, (s % 3)::INT AS score_away FROM lines WHERE flag = 'N'),
cards AS (SELECT match_id * 10000000 + p * 10 + line AS card_id, match_id, player_id, CASE WHEN s % 10 = 0 THEN q + 10 END AS minute, CASE s % 3 WHEN 0 THEN 'yellow' WHEN 1 THEN 'second_yellow' ELSE 'red' END AS card_type FROM lines WHERE flag = 'R'),
substitutions AS (SELECT match_id * 10000000 + p * 10 + line AS substitution_id, match_id, q + 40 AS minute, player_id AS player_on_id, other_id AS player_off_id FROM lines WHERE flag = 'A'),
answers AS (SELECT event_id AS answer_id, user_id AS player, (event_id % 50)::INT AS round_id, event_type IN ('purchase', 'click') AS is_correct, round(value * 100)::BIGINT AS time_ms, event_type AS answer, ts AS submitted_at FROM events),
rounds AS (SELECT DISTINCT (event_id % 50)::INT AS round_id, (event_id % 50 // 10)::INT AS game_id, (event_id % 25)::INT AS question_id FROM events),
messages AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations)
"""
