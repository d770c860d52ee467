"""Queries on pages made from the match tables, and on profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sportlake.functions import text as tx
from sportlake.operators import joins as joi
from sportlake.operators import quality as dq
from sportlake.operators import vectors as vec
from sportlake.plans import page_makers as made
from sportlake.sources import io
from sportlake.sources import match_job as job
from sportlake.sources import pages as pg


def season_pages(a):  # noqa: ANN001, ANN201
    """The pages table as files in season folders, scanned for some of the seasons: its id and season, and the bytes read."""
    path = io.shared_folder(a.spark)
    label = F.concat(F.col("page_id") % 9 + 1990, F.lit("-"), F.lpad(((F.col("page_id") % 9 + 91) % 100).cast("string"), 2, "0"))
    made.write_season_files(a.raw("pages").select(label.alias("season"), F.col("page_id").cast("string").alias("name"), F.col("html")), path)
    return pg.scan_pages(a.spark, path, ["1993-94", "1998-99"])


def standing_pages(a):  # noqa: ANN001, ANN201
    return a.season_competitions().select("season_competition_id", F.concat(F.lit("1. Team 2 9 - 1 6 "), F.col("competition_id"), F.lit(". Team 1 "), F.col("season_id") % 7, F.lit(" - "), F.col("competition_id"), F.lit(" "), F.col("season_id") % 5).alias("html"))


def nested(a):  # noqa: ANN001, ANN201
    return made.nested_pages(a.matches(), a.teams(), a.lineups(), a.substitutions(), a.goals(), a.cards())


#: What the pages of nested() hold, as the page job should read it.
JOB = """
played AS (SELECT * FROM matches SEMI JOIN (SELECT match_id FROM lineups UNION ALL SELECT match_id FROM substitutions UNION ALL SELECT match_id FROM goals) USING (match_id)),
good AS (SELECT * FROM played WHERE home_score IS NOT NULL),
cell AS (SELECT match_id AS page_id, CASE WHEN at_home THEN 'home' ELSE 'away' END AS side, 'P' || player_id AS name, shirt_number AS number, '../spieler/p' || player_id || '.html' AS href, is_starter FROM lineups SEMI JOIN good USING (match_id)),
swap AS (SELECT match_id AS page_id, CASE WHEN substitution_id % 2 = 1 THEN 'home' ELSE 'away' END AS side, substitution_id AS id, row_number() OVER (PARTITION BY match_id ORDER BY substitution_id, minute || '. P' || player_on_id || ' für P' || player_off_id) AS k, minute, 'P' || player_on_id AS player_on, 'P' || player_off_id AS player_off FROM substitutions SEMI JOIN good USING (match_id)),
line AS (SELECT page_id, side, name, max(number) AS number, max(replace(href, '../', '')) AS profile_url, bool_and(is_starter) AS starts, arg_max(came, k) FILTER (came IS NOT NULL) AS minute_on, arg_max(went, k) FILTER (went IS NOT NULL) AS minute_off FROM (
  SELECT page_id, side, name, number, href, is_starter, NULL::INT AS came, NULL::INT AS went, 0 AS k FROM cell
  UNION ALL SELECT page_id, side, player_on, NULL, NULL, NULL, minute, NULL, k FROM swap UNION ALL SELECT page_id, side, player_off, NULL, NULL, NULL, NULL, minute, k FROM swap) GROUP BY page_id, side, name),
lineup AS (SELECT page_id, side, name, number, profile_url, CASE WHEN minute_on IS NOT NULL THEN false ELSE coalesce(starts, true) END AS is_starter, minute_on, minute_off FROM line),
scored AS (SELECT match_id AS page_id, CASE WHEN score_home > lag(score_home, 1, 0) OVER (PARTITION BY match_id ORDER BY goal_id, minute || coalesce('+' || stoppage, '') || '. ' || score_home || ':' || score_away || ' P' || player_id || ' (' || coalesce('P' || assist_player_id, '-')) THEN 'home' ELSE 'away' END AS side, minute, stoppage, score_home AS home_score, score_away AS away_score, 'P' || player_id AS name, 'P' || assist_player_id AS assist FROM goals SEMI JOIN good USING (match_id)),
card AS (SELECT c.match_id AS page_id, side, cell.name, NULL::INT AS minute, card_type FROM cards c JOIN cell ON cell.page_id = c.match_id AND cell.name = 'P' || c.player_id WHERE c.minute IS NULL
  UNION ALL SELECT page_id, side, player_on, minute, 'yellow' FROM swap WHERE id % 3 = 0),
staff AS (SELECT match_id AS page_id, 'referee' AS role, 'R' || referee_id AS name, '../sr/' || referee_id || '.html' AS profile_url FROM good WHERE referee_id IS NOT NULL
  UNION ALL SELECT match_id, 'focal_coach', 'C1', '../trainer/t1.html' FROM good UNION ALL SELECT match_id, 'other_coach', 'C' || away_team_id, NULL FROM good),
everything AS (SELECT 'matches' AS "table", match_id AS page_id, 'Team ' || home_team_id AS home, 'Team ' || away_team_id AS away, home_score, away_score, halftime_home, halftime_away, match_date, '15.30' AS kickoff, attendance FROM good
  UNION ALL BY NAME SELECT 'officials' AS "table", * FROM staff
  UNION ALL BY NAME SELECT 'players' AS "table", name, min(profile_url) AS profile_url FROM lineup GROUP BY name
  UNION ALL BY NAME SELECT 'lineups' AS "table", *, NULL::INT AS stoppage_on, NULL::INT AS stoppage_off FROM lineup
  UNION ALL BY NAME SELECT 'substitutions' AS "table", page_id, side, minute, player_on, player_off, NULL::INT AS number_on, NULL::INT AS number_off FROM swap
  UNION ALL BY NAME SELECT 'goals' AS "table", * FROM scored
  UNION ALL BY NAME SELECT 'cards' AS "table", * FROM card
  UNION ALL BY NAME SELECT 'errors' AS "table", match_id AS page_id, 'no header' AS error FROM played WHERE home_score IS NULL)
--
"""

def team_sheets(a):  # noqa: ANN001, ANN201
    found = io.written(job.cells(nested(a), "team").drop("header", "crowd", "n_blocks", "several"))
    return job.entries(found), job.substitutions(found)


QUERIES = {
    "src01_scan_pages": (lambda a: season_pages(a).select("season", F.length("html").alias("size")).groupBy("season").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes")), "SELECT CASE page_id % 9 WHEN 3 THEN '1993-94' ELSE '1998-99' END AS season, count(*) AS files, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages WHERE page_id % 9 IN (3, 8) GROUP BY 1"),
    "src22_extract_headers": (lambda a: pg.parsed_matches(made.header_pages(a.matches(), a.teams()))[0], "SELECT match_id, 'Team ' || home_team_id AS home, 'Team ' || away_team_id AS away, home_score, away_score, halftime_home, halftime_away FROM matches WHERE home_score IS NOT NULL"),
    "agg49_parse_statistics": (lambda a: pg.parse_statistics(*pg.parsed_matches(made.header_pages(a.matches(), a.teams()))), "SELECT CASE WHEN home_score IS NULL THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM matches GROUP BY 1"),
    "joi19_match_profiles": (lambda a: joi.match_profiles(a.players().select(F.col("player_id").alias("profile_id"), F.when(F.col("player_id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("Dr. "), "name")).alias("full_name")), a.players()), "SELECT player_id AS profile_id, player_id FROM players"),
    "joi20_match_coaches": (lambda a: joi.token_join(a.players().select("player_id", F.concat(F.lit("Trainer: "), "name").alias("title")), "title", a.players().select(F.col("player_id").alias("coach_id"), F.element_at(F.split("name", " "), -1).alias("last")), "last").select("player_id", "coach_id"), "SELECT DISTINCT p.player_id, c.player_id AS coach_id FROM (SELECT player_id, unnest(string_split('trainer: ' || name, ' ')) AS token FROM players) p JOIN players c ON token = (c.player_id - 1)::VARCHAR"),
    "fun28_standings_row": (lambda a: pg.standings_rows(standing_pages(a), "Team 1"), "SELECT season_competition_id, competition_id AS position, season_id % 7 AS goals_for, competition_id AS goals_against, season_id % 5 AS points FROM season_competitions"),
    "fun41_row_id": (lambda a: a.messages().select("session_id", "turn", F.sha2(F.concat_ws("/", "session_id", "turn"), 256).alias("row_id")), "SELECT session_id, turn, sha256(session_id || '/' || turn) AS row_id FROM messages"),
    "fun43_mention_of": (lambda a: vec.mentions(a.raw("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), "text"), "key", a.raw("region").select(F.col("r_regionkey").alias("entity_id"), F.lit("the que").alias("name"))), f"SELECT conv_id || '/' || turn AS key, r_regionkey AS entity_id FROM region, (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, unnest(string_split(lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^A-Za-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))), ' ')) AS t FROM conversations) WHERE t IN ('the', 'que'))"),
    "fun49_match_conditions": (lambda a: a.matches().select("match_id", tx.match_conditions(F.concat(F.date_format("match_date", "d.M.yyyy"), F.lit(", 15.30 Uhr, "), "attendance", F.lit(" Zuschauer, Regen, "), F.col("matchday") % 30, F.lit(" Grad"))).alias("x")).select("match_id", "x.match_date", "x.crowd.attendance", "x.weather", "x.temperature"), "SELECT match_id, match_date, attendance, 'Regen' AS weather, matchday % 30 AS temperature FROM matches"),
    "fun50_reserve_players": (lambda a: pg.reserve_players(a.lineups().groupBy("match_id").agg(F.concat(F.lit("<td>Reserve: "), F.concat_ws(", ", F.collect_list(F.concat(F.lit("P"), "player_id"))), F.lit("</td>")).alias("html"))), "SELECT match_id, 'P' || player_id AS name FROM lineups"),
    "fun52_friendly_block": (lambda a: pg.friendly_blocks(a.matches().filter("home_score IS NOT NULL").groupBy(F.col("season_competition_id").alias("page_id")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<hr>"), F.when(F.col("match_id") % 2 == 0, F.date_format("match_date", "d.M.yyyy")).otherwise(F.concat(F.lit("ca. Oktober "), F.year("match_date"))), F.lit(" A - B "), "home_score", F.lit(":"), "away_score"))).alias("html"))).groupBy("page_id", "match_date", "home_score", "away_score").agg(F.count("*").alias("n")), "SELECT season_competition_id AS page_id, CASE WHEN match_id % 2 = 0 THEN match_date ELSE make_date(year(match_date), 10, 1) END AS match_date, home_score, away_score, count(*) AS n FROM matches WHERE home_score IS NOT NULL GROUP BY 1, 2, 3, 4"),
    "dq26_validate_findings": (lambda a: dq.validate_findings(a.players().select("player_id", "name", F.col("player_id").alias("url")), a.players().select(F.col("player_id").alias("url"), F.when(F.col("player_id") % 3 == 0, F.concat(F.lit("Schiedsrichterin: "), F.upper("name"))).when(F.col("player_id") % 3 == 1, F.lit("X")).otherwise(F.lit(None)).alias("page_name"))).groupBy("differs").agg(F.count("*").alias("n")), "SELECT CASE player_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS differs, count(*) AS n FROM players GROUP BY 1"),
    "src04_overview_rows": (lambda a: pg.overview_rows(made.overview_pages(a.matches(), a.teams(), 1)), "SELECT CASE WHEN match_id // 100 % 2 = 0 THEN 'liga' ELSE 'pokal' END || match_id // 100 || '.html' AS url, 'profiliga' || match_id || '.html' AS detail_file, 'Team ' || opponent_id AS opponent, coalesce(home_score || ':' || away_score, '-:-') AS score, round_name AS stage, CASE WHEN match_id // 100 % 2 = 0 THEN row_number() OVER (PARTITION BY match_id // 100 ORDER BY match_id) END::INT AS matchday FROM f WHERE opponent_id <> 1"),
    "fun51_team_block": (lambda a: job.entries(job.cells(nested(a), "team")).select(F.col("page_id").alias("match_id"), "side", "name", "number", "profile_url", (~F.col("reserve")).alias("is_starter")), "SELECT match_id, CASE WHEN at_home THEN 'home' ELSE 'away' END AS side, 'P' || player_id AS name, shirt_number AS number, 'spieler/p' || player_id || '.html' AS profile_url, is_starter FROM lineups"),
    "src22_team_sheets": (lambda a: job.lineups(*team_sheets(a)).select(F.col("page_id").alias("match_id"), "side", "name", "number", "profile_url", "is_starter", "minute_on", "minute_off"), JOB.replace("good AS (SELECT * FROM played WHERE home_score IS NOT NULL)", "good AS (SELECT * FROM played)").strip() + "\nSELECT page_id AS match_id, side, name, number, profile_url, is_starter, minute_on, minute_off FROM lineup"),
    "src22_officials": (lambda a: job.officials(job.cells(nested(a), "staff")).select(F.col("page_id").alias("match_id"), "role", "name", "profile_url"), JOB.replace("good AS (SELECT * FROM played WHERE home_score IS NOT NULL)", "good AS (SELECT * FROM played)").strip() + "\nSELECT page_id AS match_id, role, name, profile_url FROM staff"),
    "src22_match_job": (lambda a: job.extracted(nested(a)), JOB.strip() + "\nSELECT * FROM everything"),
    "src22_match_counts": (lambda a: job.summary(a.spark, job.run(nested(a), io.shared_folder(a.spark))), JOB.strip() + "\nSELECT CASE WHEN \"table\" = 'errors' THEN 'error: ' || error ELSE \"table\" END AS table_name, count(*) AS n FROM everything GROUP BY 1"),
}
