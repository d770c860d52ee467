"""Queries on players, goals, cards and line-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sportlake.functions.numbers import sql_ratio
from sportlake.operators import aggregates as agg
from sportlake.operators import joins as joi
from sportlake.operators import perspective as prj
from sportlake.operators import windows as win

PER_PLAYER = """pp AS (SELECT player_id, a.appearances, a.starts, coalesce(g.goals, 0) AS goals, coalesce(g.penalties, 0) AS penalties, coalesce(s.assists, 0) AS assists, coalesce(c.yellow, 0) AS yellow, coalesce(c.second_yellow, 0) AS second_yellow, coalesce(c.red, 0) AS red
 FROM (SELECT player_id, count(DISTINCT match_id) AS appearances, count(*) FILTER (is_starter) AS starts FROM lineups GROUP BY 1) a
 LEFT JOIN (SELECT player_id, count(*) AS goals, count(*) FILTER (event_type = 'penalty') AS penalties FROM goals WHERE event_type IS DISTINCT FROM 'own_goal' GROUP BY 1) g USING (player_id)
 LEFT JOIN (SELECT assist_player_id AS player_id, count(*) AS assists FROM goals WHERE event_type IS DISTINCT FROM 'own_goal' AND assist_player_id IS NOT NULL GROUP BY 1) s USING (player_id)
 LEFT JOIN (SELECT player_id, count(*) FILTER (card_type = 'yellow') AS yellow, count(*) FILTER (card_type = 'second_yellow') AS second_yellow, count(*) FILTER (card_type = 'red') AS red FROM cards GROUP BY 1) c USING (player_id))
--
"""
STATIONS = "st AS (SELECT DISTINCT player_id, 'Team ' || CASE WHEN at_home THEN home_team_id ELSE away_team_id END AS team_name, CASE WHEN season_id % 5 = 0 THEN NULL ELSE season_id END AS start_year FROM lineups JOIN matches USING (match_id))\n--\n"


def stations(a):  # noqa: ANN001, ANN201
    """Career stations from line-ups: team and season, the year missing for every fifth."""
    side = F.when(F.col("at_home"), F.col("home_team_id")).otherwise(F.col("away_team_id"))
    rows = a.lineups().select("match_id", "player_id", "at_home").join(a.matches(), "match_id")
    return rows.select("player_id", F.concat(F.lit("Team "), side).alias("team_name"), F.when(F.col("season_id") % 5 != 0, F.col("season_id")).alias("start_year")).distinct()


def facts(a):  # noqa: ANN001, ANN201
    return a.lineups(), a.goals(), a.cards()


QUERIES = {
    "prj24_short_names": (lambda a: prj.short_names(a.players(), 10).select("player_id", "name"), "SELECT player_id, name FROM players WHERE length(name) <= 10"),
    "prj27_career_stations": (lambda a: prj.career_stations(a.players(), stations(a), "player_id").select("player_id", "name", "team_name", "start_year", "station"), STATIONS + "SELECT player_id, name, team_name, start_year, row_number() OVER (PARTITION BY player_id ORDER BY coalesce(start_year, 0), team_name)::INT AS station FROM st JOIN players USING (player_id)"),
    "joi03_player_facts": (lambda a: agg.per_player(a.player_events()).drop("first_match", "last_match", "own_goals", "own_goal_assists"), PER_PLAYER + "SELECT * FROM pp"),
    "joi07_anti_missing": (lambda a: joi.anti_missing(a.matches(), a.lineups(), ["match_id"]).groupBy("season_id").agg(F.count("*").alias("n")), "SELECT season_id, count(*) AS n FROM matches WHERE match_id NOT IN (SELECT match_id FROM lineups) GROUP BY 1"),
    "joi08_orphans": (lambda a: joi.orphans(a.goals(), "assist_player_id", a.lineups(), "player_id").select("goal_id", "assist_player_id").unionByName(joi.orphans(a.substitutions().select(F.col("substitution_id").alias("goal_id"), F.col("player_off_id").alias("assist_player_id")), "assist_player_id", a.goals().select("player_id"), "player_id")), "SELECT goal_id, assist_player_id FROM goals WHERE assist_player_id IS NOT NULL AND assist_player_id NOT IN (SELECT player_id FROM lineups) UNION ALL SELECT substitution_id, player_off_id FROM substitutions WHERE player_off_id NOT IN (SELECT player_id FROM goals)"),
    "joi09_without_events": (lambda a: joi.without_events(a.matches(), lineups=a.lineups(), goals=a.goals(), cards=a.cards(), substitutions=a.substitutions()), "SELECT match_id, 'lineups' AS kind FROM matches ANTI JOIN lineups USING (match_id) UNION ALL SELECT match_id, 'goals' FROM matches ANTI JOIN goals USING (match_id) UNION ALL SELECT match_id, 'cards' FROM matches ANTI JOIN cards USING (match_id) UNION ALL SELECT match_id, 'substitutions' FROM matches ANTI JOIN substitutions USING (match_id)"),
    "joi11_goals_with_assists": (lambda a: joi.goals_with_assists(a.goals(), a.players()).groupBy("scorer", "assist").agg(F.count("*").alias("n")), "SELECT p.name AS scorer, s.name AS assist, count(*) AS n FROM goals g JOIN players p ON p.player_id = g.player_id LEFT JOIN players s ON s.player_id = assist_player_id GROUP BY ALL"),
    "joi12_pair_presence": (lambda a: joi.anti_missing(a.goals(), a.lineups().filter("is_starter"), ["match_id", "player_id"]).select("goal_id"), "SELECT goal_id FROM goals ANTI JOIN (SELECT * FROM lineups WHERE is_starter) USING (match_id, player_id)"),
    "joi21_source_context": (lambda a: joi.source_context(a.players(), [("goal", a.goals()), ("card", a.cards()), ("lineup", a.lineups())]), "SELECT player_id, CASE min(r) WHEN 0 THEN 'goal' WHEN 1 THEN 'card' ELSE 'lineup' END AS kind, arg_min(match_id, r * 1000000000 + match_id) AS match_id FROM (SELECT player_id, match_id, 0 AS r FROM goals UNION ALL SELECT player_id, match_id, 1 FROM cards UNION ALL SELECT player_id, match_id, 2 FROM lineups) GROUP BY 1"),
    "joi24_latest_lineup": (lambda a: joi.latest_match_lineup(a.lineups()).select("match_id", "player_id"), "SELECT match_id, player_id FROM lineups WHERE match_id = (SELECT max(match_id) FROM lineups)"),
    "joi25_career_sources": (lambda a: a.players().select("player_id").join(agg.scorer_span(a.matches(), a.goals()).select("player_id", F.col("first_season").alias("g")), "player_id", "left").join(a.lineups().join(a.matches(), "match_id").groupBy("player_id").agg(F.min("season_id").alias("l")), "player_id", "left").select("player_id", F.coalesce("g", "l").alias("first_season")), "SELECT player_id, coalesce((SELECT min(season_id) FROM goals g JOIN matches USING (match_id) WHERE g.player_id = p.player_id), (SELECT min(season_id) FROM lineups l JOIN matches USING (match_id) WHERE l.player_id = p.player_id)) AS first_season FROM players p"),
    "agg03_player_career_stats": (lambda a: agg.player_career_stats(a.players(), a.player_events()), PER_PLAYER + f"SELECT player_id, name, appearances, starts, appearances - starts AS sub_appearances, goals, penalties, assists, yellow, second_yellow, red, {sql_ratio('goals', 'appearances', 2)} AS goals_per_match FROM pp JOIN players USING (player_id)"),
    "agg04_top_scorers": (lambda a: agg.top_scorers(a.players(), a.player_events()), PER_PLAYER + f"SELECT player_id, name, goals, penalties, goals - penalties AS regular_goals, appearances, {sql_ratio('goals', 'appearances', 2)} AS goals_per_match FROM pp JOIN players USING (player_id) WHERE goals > 0"),
    "agg06_player_season_stats": (lambda a: agg.player_season_stats(a.matches(), a.player_events()), """x AS (SELECT match_id, season_id, competition_id FROM matches)
--
SELECT player_id, season_id, competition_id, l.appearances, l.starts, coalesce(g.n, 0) AS goals, coalesce(s.n, 0) AS assists, coalesce(c.yellow, 0) AS yellow, coalesce(c.red, 0) AS red FROM
 (SELECT player_id, season_id, competition_id, count(*) AS appearances, count(*) FILTER (is_starter) AS starts FROM lineups JOIN x USING (match_id) GROUP BY 1, 2, 3) l
 LEFT JOIN (SELECT player_id, season_id, competition_id, count(*) AS n FROM goals JOIN x USING (match_id) WHERE event_type IS DISTINCT FROM 'own_goal' GROUP BY 1, 2, 3) g USING (player_id, season_id, competition_id)
 LEFT JOIN (SELECT assist_player_id AS player_id, season_id, competition_id, count(*) AS n FROM goals JOIN x USING (match_id) WHERE assist_player_id IS NOT NULL GROUP BY 1, 2, 3) s USING (player_id, season_id, competition_id)
 LEFT JOIN (SELECT player_id, season_id, competition_id, count(*) FILTER (card_type = 'yellow') AS yellow, count(*) FILTER (card_type = 'red') AS red FROM cards JOIN x USING (match_id) GROUP BY 1, 2, 3) c USING (player_id, season_id, competition_id)"""),
    "agg07_career_highlights": (lambda a: agg.career_highlights(a.players(), a.matches(), a.player_events()), PER_PLAYER + "SELECT player_id, name, appearances, goals, best_season, best_goals FROM pp JOIN players USING (player_id) LEFT JOIN (SELECT player_id, season_id AS best_season, n AS best_goals FROM (SELECT player_id, season_id, count(*) AS n, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, season_id) AS r FROM goals JOIN matches USING (match_id) GROUP BY 1, 2) WHERE r = 1) USING (player_id)"),
    "agg11_player_statistics": (lambda a: agg.per_player(a.player_events()).select("player_id", "appearances", "goals", "own_goals"), PER_PLAYER + "SELECT player_id, appearances, goals, coalesce(n, 0) AS own_goals FROM pp LEFT JOIN (SELECT player_id, count(*) AS n FROM goals WHERE event_type = 'own_goal' GROUP BY 1) USING (player_id)"),
    "agg22_scorer_span": (lambda a: agg.scorer_span(a.matches(), a.goals()), "SELECT player_id, count(*) AS goals, min(season_id) AS first_season, max(season_id) AS last_season, count(DISTINCT season_id) AS seasons FROM goals JOIN matches USING (match_id) GROUP BY 1"),
    "agg23_appearance_leaders": (lambda a: win.top_k(agg.per_player(agg.player_events(*facts(a))).select("player_id", "appearances", "starts", "first_match", "last_match"), [F.col("appearances").desc(), "player_id"], 25), "SELECT player_id, count(DISTINCT match_id) AS appearances, count(*) FILTER (is_starter) AS starts, min(match_id) AS first_match, max(match_id) AS last_match FROM lineups GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
    "agg24_card_counts": (lambda a: agg.card_counts(a.cards()), "SELECT player_id, count(DISTINCT (match_id, coalesce(minute, 0))) FILTER (card_type = 'yellow') AS yellow, count(DISTINCT (match_id, coalesce(minute, 0))) FILTER (card_type = 'second_yellow') AS second_yellow, count(DISTINCT (match_id, coalesce(minute, 0))) FILTER (card_type = 'red') AS red FROM cards GROUP BY 1"),
    "agg25_season_regulars": (lambda a: agg.season_regulars(a.matches(), a.lineups(), 5), "SELECT season_id, player_id, count(*) AS appearances FROM lineups JOIN matches USING (match_id) GROUP BY 1, 2 HAVING count(*) > 5"),
    "agg28_career_text": (lambda a: agg.career_text(stations(a), "player_id"), STATIONS + "SELECT player_id, coalesce(string_agg(lpad(start_year::VARCHAR, 4, '0') || ' ' || team_name, '; ' ORDER BY lpad(start_year::VARCHAR, 4, '0') || ' ' || team_name), '') AS career FROM st GROUP BY 1"),
    "agg33_name_variants": (lambda a: agg.name_variants(a.players()), "SELECT normalized_name, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM players GROUP BY 1 HAVING count(*) > 1"),
    "agg33_spellings": (lambda a: agg.spellings(a.players()), "SELECT normalized_name, name, count(*) AS n, variants FROM players JOIN (SELECT normalized_name, count(DISTINCT name) AS variants FROM players GROUP BY 1 HAVING count(DISTINCT name) > 1) USING (normalized_name) GROUP BY ALL"),
    "agg34_duplicate_counts": (lambda a: agg.duplicate_counts({"cards": (a.cards(), ["match_id", "player_id", "minute", "card_type"]), "goals": (a.goals(), ["match_id", "player_id", "minute", "stoppage"]), "lineups": (a.lineup_rows(), ["match_id", "player_id"])}), "SELECT 'cards' AS table_name, coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM cards GROUP BY match_id, player_id, minute, card_type) UNION ALL SELECT 'goals', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM goals GROUP BY match_id, player_id, minute, stoppage) UNION ALL SELECT 'lineups', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineup_rows GROUP BY match_id, player_id)"),
    "agg35_player_match_goals": (lambda a: agg.player_match_goals(a.goals(), 2), "SELECT match_id, player_id, count(*) AS goals FROM goals GROUP BY 1, 2 HAVING count(*) >= 2"),
    "agg36_top_goals_per_match": (lambda a: agg.top_goals_per_match(a.goals()), f"SELECT player_id, goals, matches, {sql_ratio('goals', 'matches', 2)} AS goals_per_match FROM (SELECT player_id, count(*) AS goals, count(DISTINCT match_id) AS matches FROM goals GROUP BY 1)"),
    "agg44_fill_rate": (lambda a: agg.fill_rate(a.goals(), ["stoppage", "event_type", "assist_player_id"]), "SELECT c AS column_name, n AS filled, ((n * 2000 + t) // (2 * t))::DOUBLE / 10 AS percent FROM (SELECT 'stoppage' AS c, count(stoppage) AS n, count(*) AS t FROM goals UNION ALL SELECT 'event_type', count(event_type), count(*) FROM goals UNION ALL SELECT 'assist_player_id', count(assist_player_id), count(*) FROM goals)"),
    "agg48_unprofiled_regulars": (lambda a: a.players().filter("height_cm < 170").join(agg.per_player(agg.player_events(*facts(a))), "player_id").filter("appearances >= 5").select("player_id", "appearances"), PER_PLAYER + "SELECT player_id, appearances FROM pp JOIN players USING (player_id) WHERE height_cm < 170 AND appearances >= 5"),
    "agg51_player_win_record": (lambda a: agg.win_record(a.matches(), a.lineups(), a.players(), "ring"), "SELECT player_id, name, count(*) AS matches, count(*) FILTER (result = 'W') AS wins FROM f JOIN lineups USING (match_id) JOIN players USING (player_id) WHERE name ILIKE '%ring%' GROUP BY ALL"),
    "agg54_squad_sizes": (lambda a: stations(a).groupBy("team_name", "start_year").agg(F.countDistinct("player_id").alias("players")), STATIONS + "SELECT team_name, start_year, count(DISTINCT player_id) AS players FROM st GROUP BY ALL"),
    "agg56_club_careers": (lambda a: stations(a).filter("team_name = 'Team 1'").join(a.players(), "player_id").select("player_id", "name", "start_year"), STATIONS + "SELECT player_id, name, start_year FROM st JOIN players USING (player_id) WHERE team_name = 'Team 1'"),
    "win05_best_season": (lambda a: win.best_season(a.goals(), a.matches()).select("player_id", "season_id", "goals"), "SELECT player_id, season_id, n AS goals FROM (SELECT player_id, season_id, count(*) AS n, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, season_id) AS r FROM goals JOIN matches USING (match_id) GROUP BY 1, 2) WHERE r = 1"),
    "win06_scoring_side": (lambda a: win.scoring_side(a.goals()).groupBy("match_id", "side").agg(F.count("*").alias("n")), "SELECT match_id, side, count(*) AS n FROM (SELECT match_id, CASE WHEN score_home > lag(score_home, 1, 0) OVER (PARTITION BY match_id ORDER BY minute, coalesce(stoppage, 0), goal_id, assist_player_id NULLS FIRST) THEN 'home' ELSE 'away' END AS side FROM goals) GROUP BY 1, 2"),
    "win08_keep_first": (lambda a: win.keep_first(a.goals(), ["match_id", "player_id"], ["goal_id", "minute", F.coalesce("stoppage", F.lit(-1))]).select("match_id", "player_id", "goal_id", "minute"), "SELECT match_id, player_id, goal_id, minute FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY goal_id, minute, coalesce(stoppage, -1)) AS r FROM goals) WHERE r = 1"),
    "win09_keep_most_complete": (lambda a: win.keep_first(joi.counts_per_match(prj.result_wdl(a.matches()), lineups=a.lineups()), ["season_id", "opponent_id"], [F.col("lineups").desc(), "match_id"]).select("season_id", "opponent_id", "match_id", "lineups"), "SELECT season_id, opponent_id, match_id, n AS lineups FROM (SELECT *, coalesce(k, 0) AS n, row_number() OVER (PARTITION BY season_id, opponent_id ORDER BY coalesce(k, 0) DESC, match_id) AS r FROM f LEFT JOIN (SELECT match_id, count(*) AS k FROM lineups GROUP BY 1) USING (match_id)) WHERE r = 1"),
    "ord01_top_k": (lambda a: win.top_k(agg.top_goals_per_match(a.goals()).select("player_id", "goals"), [F.col("goals").desc(), "player_id"], 20), "SELECT player_id, count(*) AS goals FROM goals GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "ord06_custom_order": (lambda a: win.custom_order(a.cards().groupBy("card_type").agg(F.count("*").alias("n")), "card_type", ["red", "yellow"]), "SELECT card_type, count(*) AS n, CASE card_type WHEN 'red' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END::BIGINT AS place FROM cards GROUP BY 1"),
    "ord09_lineup_order": (lambda a: win.ranked(a.lineups(), ["match_id"], [F.col("at_home").desc(), F.col("is_starter").desc(), "shirt_number", "player_id"], "place").select("match_id", "player_id", "place"), "SELECT match_id, player_id, row_number() OVER (PARTITION BY match_id ORDER BY at_home DESC, is_starter DESC, shirt_number, player_id)::INT AS place FROM lineups"),
    "set01_usage_count": (lambda a: win.usage_count(a.lineups(), a.goals(), a.substitutions(), a.cards()), "SELECT player_id, count(*) AS uses FROM (SELECT player_id FROM lineups UNION ALL SELECT player_id FROM goals UNION ALL SELECT assist_player_id FROM goals UNION ALL SELECT player_on_id FROM substitutions UNION ALL SELECT player_off_id FROM substitutions UNION ALL SELECT player_id FROM cards) WHERE player_id IS NOT NULL GROUP BY 1"),
    "set05_distinct_entities": (lambda a: win.distinct_entities(a.lineups(), a.goals(), "player_id"), "SELECT player_id FROM lineups UNION SELECT player_id FROM goals"),
    "set07_match_timeline": (lambda a: win.match_timeline(a.goals(), a.cards(), a.substitutions()), "SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY minute NULLS LAST, kind, player_id)::INT AS position FROM (SELECT match_id, minute, player_id, 'goal' AS kind FROM goals UNION ALL SELECT match_id, minute, player_id, 'card' FROM cards UNION ALL SELECT match_id, minute, player_on_id, 'substitution' FROM substitutions)"),
}
