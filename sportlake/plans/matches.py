"""Queries on matches, seasons, competitions and teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sportlake.functions.numbers import ratio, sql_ratio
from sportlake.operators import aggregates as agg
from sportlake.operators import joins as joi
from sportlake.operators import perspective as prj
from sportlake.operators import windows as win
from sportlake.plans.base import RECORD
from sportlake.sources.archive import COMPETITIONS

#: Spark leaves NULL fields out of JSON objects; so does this.
REPORT = """SELECT match_id, info, goals, lineup FROM
  (SELECT match_id, '{' || concat_ws(',', '"match_date":"' || match_date || '"', '"home_team_id":' || home_team_id, '"away_team_id":' || away_team_id, '"home_score":' || home_score, '"away_score":' || away_score) || '}' AS info FROM matches)
  LEFT JOIN (SELECT match_id, '[' || string_agg('{' || concat_ws(',', '"minute":' || minute, '"stoppage":' || stoppage, '"player_id":' || player_id) || '}', ',' ORDER BY minute NULLS FIRST, stoppage NULLS FIRST, player_id NULLS FIRST) || ']' AS goals FROM goals GROUP BY 1) USING (match_id)
  LEFT JOIN (SELECT match_id, '[' || string_agg('{' || concat_ws(',', '"at_home":' || at_home, '"is_starter":' || is_starter, '"player_id":' || player_id) || '}', ',' ORDER BY at_home, is_starter, player_id) || ']' AS lineup FROM lineups GROUP BY 1) USING (match_id)"""
LEVELS = "CASE competition_id WHEN 1 THEN 'first_division' WHEN 2 THEN 'second_division' WHEN 3 THEN 'third_division' ELSE 'cup' END"
BUCKET = "CASE WHEN minute > 90 OR (minute = 90 AND coalesce(stoppage, 0) > 0) THEN '90+' WHEN minute <= 15 THEN '0-15' WHEN minute <= 30 THEN '16-30' WHEN minute <= 45 THEN '31-45' WHEN minute <= 60 THEN '46-60' WHEN minute <= 75 THEN '61-75' ELSE '76-90' END"

QUERIES = {
    "prj01_focal_matches": (lambda a: prj.focal_matches(a.matches()).select("match_id", "home_team_id", "away_team_id"), "SELECT match_id, home_team_id, away_team_id FROM matches WHERE home_team_id = 1 OR away_team_id = 1"),
    "prj02_focal_perspective": (lambda a: prj.focal_perspective(prj.focal_matches(a.matches())).select("match_id", "location", "own_score", "opponent_score", "opponent_id"), "SELECT match_id, location, own_score, opponent_score, opponent_id FROM f"),
    "prj03_result_wdl": (lambda a: prj.result_wdl(a.matches(), null_as="L").select("match_id", "result"), "SELECT match_id, coalesce(result, 'L') AS result FROM f"),
    "prj04_result_label": (lambda a: prj.result_label(a.matches()).groupBy("result", "location").agg(F.count("*").alias("n")), "SELECT coalesce(CASE f.result WHEN 'W' THEN 'Sieg' WHEN 'D' THEN 'Unentschieden' WHEN 'L' THEN 'Niederlage' END, 'Unbekannt') AS result, coalesce(f.location, 'Unbekannt') AS location, count(*) AS n FROM matches LEFT JOIN f USING (match_id) GROUP BY ALL"),
    "prj05_league_points": (lambda a: prj.league_points(a.matches()).groupBy("season_id").agg(F.sum("points").alias("points")), "SELECT season_id, sum(CASE result WHEN 'W' THEN 3 WHEN 'D' THEN 1 WHEN 'L' THEN 0 END)::BIGINT AS points FROM f GROUP BY season_id"),
    "prj06_played_unplayed": (lambda a: prj.played_only(a.matches()).select("match_id", F.lit("played").alias("state")).unionByName(prj.unplayed(a.matches()).select("match_id", F.lit("open").alias("state"))), "SELECT match_id, CASE WHEN home_score IS NULL OR away_score IS NULL THEN 'open' ELSE 'played' END AS state FROM matches"),
    "prj07_exclude_misclassified": (lambda a: prj.exclude_misclassified(a.matches(), 5, "profirest").select("match_id", "competition_id"), "SELECT match_id, competition_id FROM matches WHERE NOT (competition_id = 5 AND source_file LIKE '%profirest%')"),
    "prj08_in_competitions": (lambda a: prj.in_competitions(a.matches(), [1, 4]).select("match_id"), "SELECT match_id FROM matches WHERE competition_id IN (1, 4)"),
    "prj09_name_contains": (lambda a: prj.name_contains(a.players(), "name", "RING").select("player_id", "name"), "SELECT player_id, name FROM players WHERE name ILIKE '%ring%'"),
    "prj10_focal_team_ids": (lambda a: prj.focal_team_ids(a.teams(), ["team 1"], 1).join(joi.team_matches(a.teams(), a.matches()), "team_id").groupBy("team_id").agg(F.count("match_id").alias("matches")), "SELECT team_id, count(*) AS matches FROM teams JOIN matches ON team_id = home_team_id OR team_id = away_team_id WHERE name ILIKE '%team 1%' GROUP BY team_id"),
    "prj11_date_between": (lambda a: prj.date_between(a.matches(), "1996-01-01", "1996-12-31").select("match_id", "match_date"), "SELECT match_id, match_date FROM matches WHERE match_date BETWEEN '1996-01-01' AND '1996-12-31'"),
    "prj12_recent": (lambda a: prj.recent(a.matches(), "1999-06-30").select("match_id", "match_date"), "SELECT match_id, match_date FROM matches WHERE match_date BETWEEN DATE '1997-06-30' AND DATE '1999-06-30'"),
    "prj13_total_minute": (lambda a: prj.total_minute(a.goals()).groupBy("total_minute").agg(F.count("*").alias("n")), "SELECT minute + coalesce(stoppage, 0) AS total_minute, count(*) AS n FROM goals GROUP BY 1"),
    "prj14_stoppage_goals": (lambda a: prj.stoppage_goals(a.goals()).select("goal_id", "minute", "stoppage"), "SELECT goal_id, minute, stoppage FROM goals WHERE minute > 90 OR (minute = 90 AND stoppage > 0)"),
    "prj15_scoreline": (lambda a: prj.with_scoreline(a.matches(), "5:0").select("match_id", "own_score", "opponent_score"), "SELECT match_id, own_score, opponent_score FROM f WHERE own_score = 5 AND opponent_score = 0"),
    "prj16_score_text": (lambda a: a.matches().select("match_id", prj.score_text().alias("score")), "SELECT match_id, home_score || ':' || away_score AS score FROM matches"),
    "prj17_minute_bucket": (lambda a: a.goals().groupBy(prj.minute_bucket(F.col("minute"), F.col("stoppage")).alias("bucket")).agg(F.count("*").alias("n")), f"SELECT {BUCKET} AS bucket, count(*) AS n FROM goals GROUP BY 1"),
    "prj18_era_bucket": (lambda a: a.matches().groupBy(prj.era_bucket(F.col("season_id") - 50).alias("era")).agg(F.count("*").alias("n")), "SELECT CASE WHEN season_id - 50 < 1950 THEN 'Pre-1950' WHEN season_id - 50 < 1970 THEN '1950-1969' ELSE '1970-1989' END AS era, count(*) AS n FROM matches GROUP BY 1"),
    "prj19_league_by_year": (lambda a: prj.in_bands(a.seasons(), "start_year", [(1900, 1996, "Oberliga"), (1997, 1999, "2. Bundesliga"), (2000, 2030, "Bundesliga")], "league").select("season_id", "league"), "SELECT season_id, CASE WHEN start_year <= 1996 THEN 'Oberliga' WHEN start_year <= 1999 THEN '2. Bundesliga' ELSE 'Bundesliga' END AS league FROM seasons"),
    "prj20_league_level": (lambda a: a.competitions().select("competition_id", prj.league_level(F.col("name")).alias("level")), f"SELECT competition_id, {LEVELS} AS level FROM competitions"),
    "prj21_minutes_played": (lambda a: prj.minutes_played(a.lineups(), a.substitutions()).select("match_id", "player_id", "minutes"), "SELECT l.match_id, l.player_id, CASE WHEN is_starter THEN coalesce(o.m, 90) ELSE greatest(0, 90 - coalesce(i.m, 90)) END AS minutes FROM lineups l LEFT JOIN (SELECT match_id, player_off_id AS player_id, min(minute) AS m FROM substitutions GROUP BY ALL) o USING (match_id, player_id) LEFT JOIN (SELECT match_id, player_on_id AS player_id, min(minute) AS m FROM substitutions GROUP BY ALL) i USING (match_id, player_id)"),
    "prj26_matches_against": (lambda a: prj.matches_against(a.matches(), a.teams(), "team 1").select("match_id", "opponent", "result"), "SELECT match_id, name AS opponent, result FROM f JOIN teams ON team_id = opponent_id WHERE name ILIKE '%team 1%'"),
    "prj28_season_fixtures": (lambda a: prj.season_fixtures(a.matches(), 1997, 2).select("match_id", "match_date", "matchday"), "SELECT match_id, match_date, matchday FROM matches WHERE season_id = 1997 AND competition_id = 2"),
    "joi01_match_star": (lambda a: joi.match_star(a.matches(), a.seasons(), a.competitions(), a.teams()).select("match_id", "season", "competition", "home_team", "away_team", "referee_id"), "SELECT match_id, label AS season, c.name AS competition, h.name AS home_team, g.name AS away_team, referee_id FROM matches JOIN seasons USING (season_id) JOIN competitions c USING (competition_id) JOIN teams h ON h.team_id = home_team_id JOIN teams g ON g.team_id = away_team_id"),
    "joi02_role_teams": (lambda a: joi.role_teams(a.matches(), a.teams()).groupBy("home_team", "away_team").agg(F.count("*").alias("n")), "SELECT h.name AS home_team, g.name AS away_team, count(*) AS n FROM matches JOIN teams h ON h.team_id = home_team_id JOIN teams g ON g.team_id = away_team_id GROUP BY ALL"),
    "joi04_team_matches": (lambda a: joi.team_matches(a.teams(), a.matches()).groupBy("team_id").agg(F.count("match_id").alias("n")), "SELECT team_id, count(match_id) AS n FROM teams LEFT JOIN matches ON team_id = home_team_id OR team_id = away_team_id GROUP BY team_id"),
    "joi05_opponent_join": (lambda a: joi.opponent_join(prj.result_wdl(a.matches()), a.teams()).select("match_id", "opponent"), "SELECT match_id, name AS opponent FROM f JOIN teams ON team_id = opponent_id"),
    "joi06_semi_focal": (lambda a: joi.semi_focal(a.matches(), a.teams().filter("team_id IN (1, 7)")).select("match_id", "focal_home", "focal_away"), "SELECT match_id, home_team_id IN (1, 7) AS focal_home, away_team_id IN (1, 7) AS focal_away FROM matches WHERE home_team_id IN (1, 7) OR away_team_id IN (1, 7)"),
    "joi10_cross_probe": (lambda a: joi.cross_one(a.matches(), a.matches().agg(F.max("attendance").alias("most"))).filter("attendance = most").select("match_id", "attendance"), "SELECT match_id, attendance FROM matches WHERE attendance = (SELECT max(attendance) FROM matches)"),
    "joi23_counts_per_match": (lambda a: joi.counts_per_match(a.matches().select("match_id"), goals=a.goals(), cards=a.cards(), substitutions=a.substitutions()), "SELECT match_id, coalesce(g.n, 0) AS goals, coalesce(c.n, 0) AS cards, coalesce(s.n, 0) AS substitutions FROM matches LEFT JOIN (SELECT match_id, count(*) AS n FROM goals GROUP BY 1) g USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM cards GROUP BY 1) c USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM substitutions GROUP BY 1) s USING (match_id)"),
    "agg01_season_performance": (lambda a: agg.season_performance(a.matches()), f"SELECT season_id, competition_id, {RECORD} FROM f GROUP BY ALL"),
    "agg02_competition_statistics": (lambda a: agg.competition_statistics(a.matches()), f"SELECT competition_id, {RECORD}, count(DISTINCT season_id) AS seasons, min(season_id) AS first_season, max(season_id) AS last_season FROM f GROUP BY competition_id"),
    "agg05_match_results": (lambda a: joi.counts_per_match(prj.result_label(a.matches()), goals=a.goals(), cards=a.cards()).select("match_id", "result", "location", "goals", "cards"), "SELECT match_id, coalesce(CASE f.result WHEN 'W' THEN 'Sieg' WHEN 'D' THEN 'Unentschieden' WHEN 'L' THEN 'Niederlage' END, 'Unbekannt') AS result, coalesce(f.location, 'Unbekannt') AS location, coalesce(g.n, 0) AS goals, coalesce(c.n, 0) AS cards FROM matches LEFT JOIN f USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM goals GROUP BY 1) g USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM cards GROUP BY 1) c USING (match_id)"),
    "agg08_recent_matches": (lambda a: joi.counts_per_match(prj.recent(prj.result_wdl(a.matches()), "1999-06-30"), goals=a.goals()).select("match_id", "match_date", "result", "goals"), "SELECT match_id, match_date, result, coalesce(n, 0) AS goals FROM f LEFT JOIN (SELECT match_id, count(*) AS n FROM goals GROUP BY 1) USING (match_id) WHERE match_date BETWEEN DATE '1997-06-30' AND DATE '1999-06-30'"),
    "agg12_match_details": (lambda a: joi.counts_per_match(joi.role_teams(a.matches(), a.teams()), goals=a.goals(), cards=a.cards(), substitutions=a.substitutions()).select("match_id", "home_team", "away_team", "goals", "cards", "substitutions", prj.score_text().alias("score")), "SELECT match_id, h.name AS home_team, w.name AS away_team, coalesce(g.n, 0) AS goals, coalesce(c.n, 0) AS cards, coalesce(s.n, 0) AS substitutions, home_score || ':' || away_score AS score FROM matches JOIN teams h ON h.team_id = home_team_id JOIN teams w ON w.team_id = away_team_id LEFT JOIN (SELECT match_id, count(*) AS n FROM goals GROUP BY 1) g USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM cards GROUP BY 1) c USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM substitutions GROUP BY 1) s USING (match_id)"),
    "agg13_season_summary": (lambda a: agg.season_summary(a.matches(), a.lineups(), a.goals()), "SELECT season_id, count(*) AS matches, sum(home_score + away_score)::BIGINT AS score_goals, any_value(p) AS players, any_value(s) AS scorers, any_value(g) AS goals FROM matches LEFT JOIN (SELECT season_id, count(DISTINCT player_id) AS p FROM lineups JOIN matches USING (match_id) GROUP BY 1) USING (season_id) LEFT JOIN (SELECT season_id, count(DISTINCT player_id) AS s, count(*) AS g FROM goals JOIN matches USING (match_id) GROUP BY 1) USING (season_id) GROUP BY season_id"),
    "agg14_win_rate_by_season": (lambda a: agg.season_table(a.matches(), 1, "season_id", "competition_id"), f"SELECT season_id, competition_id, {RECORD}, 3 * wins + draws AS points, {sql_ratio('3 * wins + draws', 'matches', 2)} AS points_per_game FROM f WHERE result IS NOT NULL GROUP BY season_id, competition_id"),
    "agg15_win_rate_by_competition": (lambda a: agg.season_table(joi.semi_focal(a.matches(), a.teams().filter("team_id = 1")).drop("focal_home", "focal_away"), 1, "competition_id"), f"SELECT competition_id, {RECORD}, 3 * wins + draws AS points, {sql_ratio('3 * wins + draws', 'matches', 2)} AS points_per_game FROM f WHERE result IS NOT NULL GROUP BY competition_id"),
    "agg17_home_away_split": (lambda a: agg.record(prj.result_wdl(a.matches()), "location"), f"SELECT location, {RECORD} FROM f GROUP BY location"),
    "agg18_head_to_head": (lambda a: agg.head_to_head(a.matches(), a.teams(), least=5), f"SELECT opponent_id, name AS opponent, {RECORD} FROM f JOIN teams ON team_id = opponent_id GROUP BY ALL HAVING count(*) >= 5"),
    "agg19_opponent_summary": (lambda a: prj.result_wdl(a.matches()).filter("opponent_id = 7").groupBy("result").agg(F.count("*").alias("n")), "SELECT result, count(*) AS n FROM f WHERE opponent_id = 7 GROUP BY result"),
    "agg20_all_time_record": (lambda a: agg.record(prj.result_wdl(a.matches())), f"SELECT {RECORD} FROM f"),
    "agg21_season_table": (lambda a: agg.season_table(a.matches()), f"SELECT season_id, {RECORD}, 3 * wins + draws AS points, {sql_ratio('3 * wins + draws', 'matches', 2)} AS points_per_game FROM f WHERE result IS NOT NULL GROUP BY season_id"),
    "agg26_nested_events": (lambda a: agg.nested_events(a.matches(), a.goals(), a.cards()).select("match_id", agg.as_text("scorers").alias("scorers"), agg.as_text("cards").alias("cards")), "SELECT match_id, s.x AS scorers, c.x AS cards FROM matches LEFT JOIN (SELECT match_id, string_agg(coalesce(minute, -1) || '/' || player_id || '/' || coalesce(event_type, 'goal'), ';' ORDER BY coalesce(minute, -1), player_id, coalesce(event_type, 'goal')) AS x FROM goals GROUP BY 1) s USING (match_id) LEFT JOIN (SELECT match_id, string_agg(coalesce(minute, -1) || '/' || player_id || '/' || card_type, ';' ORDER BY coalesce(minute, -1), player_id, card_type) AS x FROM cards GROUP BY 1) c USING (match_id)"),
    "agg27_match_report": (lambda a: agg.match_report(a.matches(), a.goals(), a.lineups()), REPORT),
    "agg29_rounds_per_competition": (lambda a: agg.rounds_per_competition(a.matches()), "SELECT season_id, competition_id, count(*) AS matches, count(DISTINCT match_date) AS dates, min(match_date) AS first_date, max(match_date) AS last_date, string_agg(DISTINCT round_name, ', ' ORDER BY round_name) AS round_names FROM matches GROUP BY ALL"),
    "agg30_source_provenance": (lambda a: agg.distinct_text(a.matches().withColumn("pair", F.concat_ws("-", "home_team_id", "away_team_id")), ["source_file", "season_id"], "pair", "pairs"), "SELECT source_file, season_id, count(*) AS matches, string_agg(DISTINCT home_team_id || '-' || away_team_id, ', ' ORDER BY home_team_id || '-' || away_team_id) AS pairs FROM matches GROUP BY ALL"),
    "agg31_duplicate_groups": (lambda a: agg.duplicate_groups(a.matches()), "SELECT match_date, least(home_team_id, away_team_id) AS team_a, greatest(home_team_id, away_team_id) AS team_b, least(home_score, away_score) AS score_a, greatest(home_score, away_score) AS score_b, count(*) AS n, string_agg(match_id, ',' ORDER BY source_file <> 'liga', match_id) AS match_ids FROM matches GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1"),
    "agg32_duplicate_groups_by_opponent": (lambda a: agg.duplicate_groups_by_opponent(a.matches(), a.lineups()), "SELECT season_id, opponent_id, own_score, opponent_score, count(*) AS n, string_agg(match_id || ':' || coalesce(k, 0), ',' ORDER BY match_id) AS ids FROM f LEFT JOIN (SELECT match_id, count(*) AS k FROM lineups GROUP BY 1) USING (match_id) GROUP BY ALL HAVING count(*) > 1"),
    "agg37_volume_summary": (lambda a: agg.volume_summary(a.matches(), a.goals()), f"SELECT *, {sql_ratio('matches', 'seasons', 1)} AS matches_per_season, {sql_ratio('goals', 'matches', 2)} AS goals_per_match FROM (SELECT count(*) AS matches, count(DISTINCT season_id) AS seasons FROM matches), (SELECT count(*) AS goals FROM goals)"),
    "agg38_competition_breakdown": (lambda a: agg.breakdown(a.matches(), a.goals(), "competition_id"), "SELECT competition_id, count(DISTINCT season_id) AS seasons, count(*) AS matches, coalesce(any_value(n), 0) AS goals FROM matches LEFT JOIN (SELECT competition_id, count(*) AS n FROM goals JOIN matches USING (match_id) GROUP BY 1) USING (competition_id) GROUP BY competition_id"),
    "agg39_season_coverage": (lambda a: agg.season_coverage(a.seasons(), a.matches()), "SELECT season_id, label, count(match_id) AS matches, count(DISTINCT competition_id) AS competitions FROM seasons LEFT JOIN matches USING (season_id) GROUP BY ALL"),
    "agg40_season_events": (lambda a: agg.season_summary(a.matches(), a.lineups(), a.goals()).select("season_id", "matches", "players", "goals"), "SELECT season_id, count(*) AS matches, any_value(p) AS players, any_value(g) AS goals FROM matches JOIN (SELECT season_id, count(DISTINCT player_id) AS p FROM lineups JOIN matches USING (match_id) GROUP BY 1) USING (season_id) JOIN (SELECT season_id, count(*) AS g FROM goals JOIN matches USING (match_id) GROUP BY 1) USING (season_id) GROUP BY season_id"),
    "agg41_team_overview": (lambda a: agg.team_overview(a.teams(), a.matches()), "SELECT team_id, name, count(*) FILTER (home_team_id = team_id) AS home_matches, count(*) FILTER (away_team_id = team_id) AS away_matches, count(*) AS matches, count(*) FILTER (competition_id <= 3) AS league_matches, min(match_date) AS first_date, max(match_date) AS last_date FROM teams JOIN matches ON team_id = home_team_id OR team_id = away_team_id GROUP BY ALL"),
    "agg42_minutes_histogram": (lambda a: win.custom_order(a.goals().groupBy(prj.minute_bucket(F.col("minute"), F.col("stoppage")).alias("bucket")).agg(F.count("*").alias("n")), "bucket", ["0-15", "16-30", "31-45", "46-60", "61-75", "76-90", "90+"]), f"SELECT bucket, n, CAST(list_position(['0-15', '16-30', '31-45', '46-60', '61-75', '76-90', '90+'], bucket) AS BIGINT) AS place FROM (SELECT {BUCKET} AS bucket, count(*) AS n FROM goals GROUP BY 1)"),
    "agg50_focal_match_results": (lambda a: joi.match_star(prj.result_wdl(a.matches()), a.seasons(), a.competitions(), a.teams()).select("match_id", "season", "competition", "location", "result", "round_name", "halftime_home", "halftime_away", "attendance", "referee_id"), "SELECT match_id, label AS season, c.name AS competition, location, result, round_name, halftime_home, halftime_away, attendance, referee_id FROM f JOIN seasons USING (season_id) JOIN competitions c USING (competition_id)"),
    "agg52_competition_counts": (lambda a: a.matches().filter("season_id = 1998").groupBy("competition_id").agg(F.count("*").alias("matches"), F.count_if((F.col("competition_id") == 5) & (F.col("source_file") == "profirest")).alias("misclassified")), "SELECT competition_id, count(*) AS matches, count(*) FILTER (competition_id = 5 AND source_file = 'profirest') AS misclassified FROM matches WHERE season_id = 1998 GROUP BY 1"),
    "agg53_sync_verification": (lambda a: agg.sync_verification(a.matches().filter("season_id = 1998"), goals=a.goals(), lineups=a.lineups(), cards=a.cards(), substitutions=a.substitutions()), "x AS (SELECT match_id FROM matches WHERE season_id = 1998)\n--\nSELECT (SELECT count(*) FROM x) AS matches, (SELECT count(*) FROM goals SEMI JOIN x USING (match_id)) AS goals, (SELECT count(*) FROM lineups SEMI JOIN x USING (match_id)) AS lineups, (SELECT count(*) FROM cards SEMI JOIN x USING (match_id)) AS cards, (SELECT count(*) FROM substitutions SEMI JOIN x USING (match_id)) AS substitutions"),
    "agg55_wdl_shares": (lambda a: agg.record(prj.result_wdl(a.matches()), "competition_id").filter("matches >= 20").select("competition_id", "win_pct", ratio("draws", "matches", 1, 100).alias("draw_pct"), ratio("losses", "matches", 1, 100).alias("loss_pct")), f"SELECT competition_id, win_pct, {sql_ratio('draws', 'matches', 1, 100)} AS draw_pct, {sql_ratio('losses', 'matches', 1, 100)} AS loss_pct FROM (SELECT competition_id, {RECORD} FROM f GROUP BY 1) WHERE matches >= 20"),
    "win01_rank_duplicates": (lambda a: win.rank_duplicates(a.matches()).select("match_id", "rn"), "SELECT match_id, row_number() OVER (PARTITION BY season_competition_id, match_date, home_team_id, away_team_id, home_score, away_score ORDER BY match_id)::INT AS rn FROM matches"),
    "win04_share_of_total": (lambda a: win.share_of_total(a.matches(), "competition_id"), f"SELECT competition_id, count(*) AS n, {sql_ratio('count(*)', '(SELECT count(*) FROM matches)', 2, 100)} AS percent FROM matches GROUP BY competition_id"),
    "win07_running_matchday": (lambda a: win.running_matchday(a.matches()).select("match_id", "running_matchday"), "SELECT match_id, row_number() OVER (PARTITION BY season_competition_id ORDER BY match_date, match_id)::INT AS running_matchday FROM matches"),
    "ord02_best_worst": (lambda a: win.best_worst(agg.record(prj.result_wdl(a.matches()), "opponent_id"), "win_pct", "opponent_id", 5, 3).select("opponent_id", "win_pct", "end"), f"x AS (SELECT opponent_id, {RECORD} FROM f GROUP BY 1 HAVING count(*) >= 5)\n--\n(SELECT opponent_id, win_pct, 'best' AS \"end\" FROM x ORDER BY win_pct DESC NULLS LAST, opponent_id LIMIT 3) UNION ALL (SELECT opponent_id, win_pct, 'worst' FROM x ORDER BY win_pct NULLS LAST, opponent_id LIMIT 3)"),
    "ord03_page": (lambda a: win.page(a.matches().filter("source_file = 'liga'").select("match_id", "match_date"), [F.col("match_date").desc(), "match_id"], 20, 40), "SELECT match_id, match_date, (SELECT count(*) FROM matches WHERE source_file = 'liga') AS total FROM matches WHERE source_file = 'liga' ORDER BY match_date DESC, match_id LIMIT 20 OFFSET 40"),
    "ord07_season_order": (lambda a: win.ranked(a.seasons(), [F.lit(1)], [F.regexp_extract("label", r"^(\d+)", 1).cast("int").desc()], "place").select("label", "place"), "SELECT label, row_number() OVER (ORDER BY start_year DESC)::INT AS place FROM seasons"),
    "ord08_best_seasons": (lambda a: win.top_k(agg.season_table(a.matches()).select("season_id", "points_per_game"), [F.col("points_per_game").desc_nulls_last(), "season_id"], 3), f"SELECT season_id, {sql_ratio('3 * wins + draws', 'matches', 2)} AS points_per_game FROM (SELECT season_id, {RECORD} FROM f WHERE result IS NOT NULL GROUP BY season_id) ORDER BY 2 DESC, 1 LIMIT 3"),
    "set02_report_sections": (lambda a: a.matches().agg(F.lit("matches").alias("section"), F.count("*").alias("n")).unionByName(a.goals().agg(F.lit("goals").alias("section"), F.count("*").alias("n"))).unionByName(a.cards().agg(F.lit("cards").alias("section"), F.count("*").alias("n"))), "SELECT 'matches' AS section, count(*) AS n FROM matches UNION ALL SELECT 'goals', count(*) FROM goals UNION ALL SELECT 'cards', count(*) FROM cards"),
    "set03_with_default": (lambda a: prj.with_default(a.matches().filter("season_id = 1890").select("match_id"), "match_id", -1).unionByName(prj.with_default(a.matches().filter("season_id = 1995").select("match_id"), "match_id", -1)), "SELECT -1 AS match_id UNION ALL SELECT match_id FROM matches WHERE season_id = 1995"),
    "set04_missing_values": (lambda a: win.missing_values(a.matches(), a.matches().filter("source_file = 'profirest'"), "season_competition_id").unionByName(win.missing_values(a.matches().select(F.col("referee_id").alias("season_competition_id")), a.matches(), "season_competition_id")), "SELECT DISTINCT season_competition_id FROM matches WHERE season_competition_id NOT IN (SELECT season_competition_id FROM matches WHERE source_file = 'profirest') UNION ALL SELECT DISTINCT referee_id FROM matches WHERE referee_id IS NULL OR referee_id NOT IN (SELECT season_competition_id FROM matches)"),
    "set06_distinct_seasons": (lambda a: a.matches().filter("competition_id = 5").join(a.seasons(), "season_id").select("label").distinct(), "SELECT DISTINCT label FROM matches JOIN seasons USING (season_id) WHERE competition_id = 5"),
    "set08_missing_matches": (lambda a: win.missing_matches(a.matches().filter("source_file = 'liga'"), a.matches().filter("source_file = 'profirest'")), "x AS (SELECT season_id, home_team_id, away_team_id, match_date, coalesce(home_score, -1) AS home_score, coalesce(away_score, -1) AS away_score, source_file, match_id FROM matches)\n--\nSELECT DISTINCT season_id, home_team_id, away_team_id, match_date, home_score, away_score FROM x WHERE source_file = 'liga' EXCEPT SELECT season_id, home_team_id, away_team_id, match_date, home_score, away_score FROM x WHERE source_file = 'profirest'"),
}

assert len(COMPETITIONS) == 5
