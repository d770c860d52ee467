"""Queries of the column functions over texts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sportlake.functions import numbers as num
from sportlake.functions import text as tx
from sportlake.operators import perspective as prj

NAMES = "n AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '? ' WHEN 1 THEN 'wdh. ' WHEN 2 THEN 'FE, ' WHEN 3 THEN '12 ' ELSE '' END || coalesce(text, '') AS name FROM documents)\n--\n"


def names(a):  # noqa: ANN001, ANN201
    """Name-like texts with the marks that cleaning removes."""
    mark = F.when(F.col("doc_id") % 8 == 0, "? ").when(F.col("doc_id") % 8 == 1, "wdh. ").when(F.col("doc_id") % 8 == 2, "FE, ").when(F.col("doc_id") % 8 == 3, "12 ").otherwise("")
    return a.raw("documents").select("doc_id", F.concat(mark, F.coalesce("text", F.lit(""))).alias("name"))


def goal_lines(a):  # noqa: ANN001, ANN201
    """Goal texts made from the goals table."""
    g = a.goals()
    line = F.concat(F.col("minute"), F.when(F.col("stoppage").isNotNull(), F.concat(F.lit("+"), F.col("stoppage"))).otherwise(""), F.lit(". "), F.col("score_home"), F.lit(":"), F.col("score_away"), F.lit(" P"), F.col("player_id"), F.lit(" ("), F.coalesce(F.col("assist_player_id").cast("string"), F.lit("-")), F.lit(")"))
    return g.select("goal_id", "match_id", line.alias("line"))


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{tx.BLANK}+|{tx.BLANK}+\z', '', 'g')"


_BARE = _trim(rf"regexp_replace({_trim('name')}, '^\?', '')")
_NAME = rf"regexp_replace({_BARE}, '(?i)^wdh\.{tx.BLANK}*', '')"
_CLEAN = _trim(rf"regexp_replace({_NAME}, '(?i)^(?:FE|ET|HE),{tx.BLANK}*', '')")
#: The reason of player_name_error() and the category of error_category() in SQL, of name.
REASON = rf"""CASE WHEN {_BARE} = '' THEN 'empty' WHEN {_BARE} = '-' THEN 'placeholder' WHEN regexp_matches(lower({_NAME}), 'trainer:|fsv-trainer|coach:|-trainer') THEN 'trainer'
  WHEN regexp_matches(lower({_NAME}), 'schiedsrichter:|schiedsrichterin:|referee:') THEN 'referee' WHEN starts_with(lower({_NAME}), 'tore ') OR regexp_matches({_NAME}, '^\d+\.{tx.BLANK}*\d+:\d+') THEN 'goal_text'
  WHEN contains(lower({_CLEAN}), ' an ') THEN 'assist_text' WHEN {_CLEAN} IN ('', '-') THEN 'empty' WHEN NOT regexp_matches({_CLEAN}, '^\p{{L}}') THEN 'not_a_letter' WHEN length({_CLEAN}) < 2 THEN 'too_short' WHEN length({_CLEAN}) > 100 THEN 'too_long' END"""
CATEGORY = rf"""CASE WHEN regexp_matches(lower(name), 'trainer|coach') THEN 'trainer_name' WHEN regexp_matches(lower(name), 'schiedsrichter|referee') THEN 'referee_name' WHEN regexp_matches(lower(name), '^tore{tx.BLANK}|^\d+\.{tx.BLANK}*\d+:\d+') THEN 'goal_text'
  WHEN regexp_matches(lower(name), ',{tx.BLANK}*(?:liebers|latza|hazard|klopp)') THEN 'error_text' WHEN regexp_matches(name, '^[^a-zA-Z]|^[A-Z]{{1,3}}\z') THEN 'invalid_pattern' WHEN length(name) > 100 THEN 'too_long' WHEN contains(name, ',') THEN 'contains_comma' END"""

GOAL_LINES = "gl AS (SELECT goal_id, minute, stoppage, score_home, score_away, 'P' || player_id AS scorer, assist_player_id::VARCHAR AS assist FROM goals)\n--\n"

QUERIES = {
    "fun01_normalize_whitespace": (lambda a: a.raw("documents").select("doc_id", tx.normalize_whitespace(F.col("text")).alias("clean")), r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents"),
    "fun02_strip_accents": (lambda a: a.raw("documents").select("doc_id", tx.strip_accents(F.col("text")).alias("plain")), f"SELECT doc_id, strip_accents(text) AS plain FROM documents"),
    "fun03_normalize_name": (lambda a: a.raw("documents").select("doc_id", tx.normalize_name(F.col("text")).alias("name")), rf"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^A-Za-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))) AS name FROM documents"),
    "fun04_parse_int": (lambda a: a.raw("events").select("event_id", tx.parse_int(F.regexp_extract("props", r"(\d+)", 1)).alias("k")), r"SELECT event_id, regexp_extract(props, '(\d+)', 1)::INT AS k FROM events"),
    "fun05_parse_minute": (lambda a: goal_lines(a).select("goal_id", tx.parse_minute(F.col("line")).alias("x")).select("goal_id", "x.minute", "x.stoppage"), "SELECT goal_id, minute, stoppage FROM goals"),
    "fun06_parse_header_score": (lambda a: a.matches().select("match_id", tx.parse_header_score(F.concat(F.lit("Team "), "home_team_id", F.lit(" - Team "), "away_team_id", F.lit(" "), F.coalesce(F.col("home_score").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("away_score").cast("string"), F.lit("-")))).alias("x")).select("match_id", "x.home", "x.away", "x.home_score", "x.away_score"), "SELECT match_id, 'Team ' || home_team_id AS home, 'Team ' || away_team_id AS away, home_score, away_score FROM matches"),
    "fun07_parse_german_date": (lambda a: a.matches().select("match_id", tx.parse_german_date(F.concat(F.lit("am "), F.date_format("match_date", "d.M.yyyy"))).alias("d"), tx.parse_german_date(F.concat(F.lit("31.0"), F.col("matchday") % 9 + 1, F.lit(".1999"))).alias("odd")), "SELECT match_id, match_date AS d, CASE matchday % 9 + 1 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 9 THEN NULL ELSE make_date(1999, (matchday % 9 + 1)::INT, 31) END AS odd FROM matches"),
    "fun08_parse_approx_month": (lambda a: a.matches().select("match_id", tx.parse_approx_month(F.concat(F.when(F.col("matchday") % 2 == 0, "ca. Oktober ").otherwise("ca. Herbst "), "season_id")).alias("d")), "SELECT match_id, make_date(season_id, CASE WHEN matchday % 2 = 0 THEN 10 ELSE 1 END, 1) AS d FROM matches"),
    "fun09_clean_player_name": (lambda a: names(a).select("doc_id", tx.clean_player_name(F.col("name")).alias("name")), NAMES + f"SELECT doc_id, {_CLEAN} AS name FROM n"),
    "fun10_player_name_error": (lambda a: names(a).select("doc_id", tx.player_name_error(F.col("name")).alias("reason")), NAMES + f"SELECT doc_id, {REASON} AS reason FROM n"),
    "fun11_legacy_player_name": (lambda a: names(a).select("doc_id", tx.legacy_player_name(F.col("name")).alias("name")), NAMES + rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(name), '^\d+{tx.BLANK}+|{tx.BLANK}+\d+\z', '', 'g'), '[^A-Za-z ''\-]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM n"),
    "fun12_error_category": (lambda a: names(a).select("doc_id", tx.error_category(F.col("name")).alias("category")), NAMES + f"SELECT doc_id, {CATEGORY} AS category FROM n"),
    "fun13_invalid_player_pattern": (lambda a: goal_lines(a).select(F.regexp_replace("line", r"\+\d+", "").alias("name")).unionByName(names(a).select("name")).groupBy(tx.invalid_player_pattern(F.col("name")).alias("pattern")).agg(F.count("*").alias("n")), NAMES.replace("\n--\n", "") + rf""", u AS (SELECT 'goal_time' AS p FROM goals UNION ALL SELECT CASE WHEN regexp_matches(name, '^\d+\z') THEN 'digits' WHEN regexp_matches(name, '^-+\z') THEN 'dashes' WHEN regexp_matches(name, '^\d+\.{tx.BLANK}+\d+:\d+') THEN 'goal_time' WHEN regexp_matches(name, '^(?:FE|HE|ET|EL),{tx.BLANK}') THEN 'goal_mark'
  WHEN regexp_matches(name, ',{tx.BLANK}+[^\n]+{tx.BLANK}+an{tx.BLANK}') THEN 'assist_text' WHEN regexp_matches(name, '^\([^\n]*\)\z') THEN 'brackets' WHEN regexp_matches(name, 'dir\.{tx.BLANK}*FS') THEN 'free_kick' END FROM n)
--
SELECT p AS pattern, count(*) AS n FROM u GROUP BY 1"""),
    "fun14_normalize_href": (lambda a: a.raw("pages").select("page_id", tx.normalize_href(F.concat(F.lit("../../"), "url")).alias("href")), "SELECT page_id, url AS href FROM pages"),
    "fun15_canonical_team": (lambda a: a.raw("supplier").select("s_suppkey", tx.canonical_team(F.col("s_name"), [r"#0*1$", r"#0*2$"], "Focal").alias("name")), "SELECT s_suppkey, CASE WHEN s_suppkey IN (1, 2) THEN 'Focal' ELSE s_name END AS name FROM supplier"),
    "fun16_is_focal_text": (lambda a: a.raw("documents").groupBy(tx.is_focal_text(F.col("text"), ["license", "idiot"]).alias("focal")).agg(F.count("*").alias("n")), "SELECT lower(text) LIKE '%license%' OR lower(text) LIKE '%idiot%' AS focal, count(*) AS n FROM documents GROUP BY 1"),
    "fun17_season_years": (lambda a: a.seasons().select("label", tx.season_years(F.col("label")).alias("x"), tx.season_years(F.col("label"), legacy=True).alias("y")).select("label", "x.start_year", "x.end_year", F.col("y.end_year").alias("legacy_end")), "SELECT label, start_year, end_year, end_year AS legacy_end FROM seasons"),
    "fun18_league_from_title": (lambda a: a.matches().select("match_id", tx.league_from_title(F.when(F.col("competition_id") <= 2, F.concat(F.lit("Saison: Liga "), "competition_id")).otherwise("Saison"), F.col("source_file")).alias("league")), "SELECT match_id, CASE WHEN competition_id <= 2 THEN 'Liga ' || competition_id WHEN source_file = 'liga' THEN 'Liga' END AS league FROM matches"),
    "fun19_attendance_kickoff": (lambda a: a.matches().select("match_id", tx.attendance_kickoff(F.concat(F.lit("Samstag, 15.30 Uhr, "), "attendance", F.lit(" Zuschauer"))).alias("x")).select("match_id", "x.kickoff", "x.attendance"), "SELECT match_id, '15.30' AS kickoff, attendance FROM matches"),
    "fun20_substitution_text": (lambda a: a.substitutions().select("substitution_id", tx.substitution_text(F.concat("minute", F.lit(". 12 P"), "player_on_id", F.lit(" für 7 X an P"), "player_off_id")).alias("x")).select("substitution_id", "x.minute", "x.player_on", "x.player_off", "x.number_on", "x.number_off"), "SELECT substitution_id, minute, 'P' || player_on_id AS player_on, 'P' || player_off_id AS player_off, 12 AS number_on, 7 AS number_off FROM substitutions"),
    "fun21_goal_text": (lambda a: goal_lines(a).select("goal_id", tx.goal_text(F.col("line")).alias("x")).select("goal_id", "x.*"), GOAL_LINES + "SELECT * FROM gl"),
    "fun22_goal_kind": (lambda a: a.goals().select("goal_id", tx.goal_kind(F.when(F.col("event_type") == "penalty", "FE, Meier").when(F.col("event_type") == "own_goal", "Meier (Eigentor)").otherwise("Meier")).alias("kind")), "SELECT goal_id, coalesce(event_type, 'goal') AS kind FROM goals"),
    "fun23_card_kind": (lambda a: a.cards().select("card_id", tx.card_kind(F.concat(F.lit("../img/"), F.create_map(*[F.lit(x) for k, v in tx.CARDS.items() for x in (v, k)])[F.col("card_type")])).alias("kind")), "SELECT card_id, card_type AS kind FROM cards"),
    "fun25_career_years": (lambda a: a.seasons().select("season_id", tx.career_years(F.concat("start_year", F.lit("/"), F.lpad((F.col("end_year") % 100).cast("string"), 2, "0"))).alias("x")).select("season_id", "x.start_year", "x.end_year"), "SELECT season_id, start_year, end_year FROM seasons"),
    "fun29_digits_or_null": (lambda a: a.raw("supplier").select("s_suppkey", tx.digits_or_null(F.col("s_name")).alias("digits")), "SELECT s_suppkey, s_suppkey::INT AS digits FROM supplier"),
    "fun30_points_difficulty": (lambda a: a.answers().select("answer_id", num.points_difficulty(F.col("is_correct"), F.col("time_ms"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("round_id") % 3 + 1).cast("int"))).alias("points")), "SELECT answer_id, CASE WHEN is_correct THEN [50, 100, 150][round_id % 3 + 1] + greatest(0, 30000 - time_ms) * 50 // 30000 ELSE 0 END::BIGINT AS points FROM answers"),
    "fun31_points_time": (lambda a: a.answers().select("answer_id", num.points_time(F.col("is_correct"), F.col("time_ms")).alias("points")), "SELECT answer_id, CASE WHEN is_correct THEN greatest(10, 100 - time_ms * 2 // 1000) ELSE 0 END::BIGINT AS points FROM answers"),
    "fun32_answer_matches": (lambda a: a.answers().groupBy(num.answer_matches(F.concat(F.lit(" "), F.upper("answer")), F.lit("purchase")).alias("right")).agg(F.count("*").alias("n")), "SELECT answer = 'purchase' AS \"right\", count(*) AS n FROM answers GROUP BY 1"),
    "fun33_evidence_score": (lambda a: a.raw("part").select("p_partkey", num.evidence_score(F.element_at(F.split("p_name", " "), -1), F.array("p_name", "p_type")).alias("found"), num.evidence_score(F.lit("widget"), F.array("p_name", "p_type")).alias("score")), "SELECT p_partkey, 95 AS found, CASE WHEN p_name ILIKE '%widget%' OR p_type ILIKE '%widget%' THEN 95 ELSE 75 END AS score FROM part"),
    "fun34_question_valid": (lambda a: a.raw("part").select("p_partkey", num.question_valid(F.col("p_type"), F.array("p_name", "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lit("x")))).alias("valid"), num.in_domain(F.lower("p_type"), ["standard", "promo"], "medium").alias("kind")), "SELECT p_partkey, p_partkey % 3 <> 0 AS valid, CASE WHEN lower(p_type) IN ('standard', 'promo') THEN lower(p_type) ELSE 'medium' END AS kind FROM part"),
    "fun35_json_field": (lambda a: a.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events"),
    "fun36_unordered_pair": (lambda a: a.matches().groupBy(F.least("home_team_id", "away_team_id").alias("a"), F.greatest("home_team_id", "away_team_id").alias("b")).agg(F.count("*").alias("n")), "SELECT least(home_team_id, away_team_id) AS a, greatest(home_team_id, away_team_id) AS b, count(*) AS n FROM matches GROUP BY 1, 2"),
    "fun37_ratio": (lambda a: a.matches().select("match_id", num.ratio(F.col("home_score"), F.col("away_score"), 3).alias("ratio")), f"SELECT match_id, {num.sql_ratio('home_score', 'away_score', 3)} AS ratio FROM matches"),
    "fun38_key_coalesce": (lambda a: a.cards().groupBy("match_id", F.coalesce("minute", F.lit(-1)).alias("minute")).agg(F.count("*").alias("n")), "SELECT match_id, coalesce(minute, -1) AS minute, count(*) AS n FROM cards GROUP BY 1, 2"),
    "fun39_year_of": (lambda a: a.matches().groupBy(F.year("match_date").alias("y")).agg(F.count("*").alias("n")), "SELECT year(match_date)::INT AS y, count(*) AS n FROM matches GROUP BY 1"),
    "fun40_last_name": (lambda a: a.players().select("player_id", tx.last_name(F.col("name")).alias("last")), "SELECT player_id, (player_id - 1)::VARCHAR AS last FROM players"),
    "fun42_name_override": (lambda a: a.players().select("player_id", F.coalesce(F.create_map(F.lit("small ring"), F.lit("little ring"))[F.col("normalized_name")], F.col("normalized_name")).alias("name")), "SELECT player_id, CASE WHEN normalized_name = 'small ring' THEN 'little ring' ELSE normalized_name END AS name FROM players"),
    "fun46_lineup_marks": (lambda a: a.cards().select("card_id", tx.lineup_marks(F.concat(F.col("player_id") % 90 + 1, F.lit(" <b>P</b> <img src='"), F.when(F.col("card_type") == "yellow", "gelbekarte.bmp").when(F.col("card_type") == "red", "rotekarte.bmp").otherwise("gelbrot.bmp"), F.lit("'>"))).alias("x")).select("card_id", "x.captain", "x.yellow", "x.second_yellow", "x.red", "x.shirt_number"), "SELECT card_id, true AS captain, (card_type = 'yellow')::INT AS yellow, card_type = 'second_yellow' AS second_yellow, card_type = 'red' AS red, (player_id % 90 + 1)::INT AS shirt_number FROM cards"),
    "fun47_grid_position": (lambda a: a.lineups().groupBy(tx.grid_position(F.col("line")).alias("position")).agg(F.count("*").alias("n")), "SELECT CASE line WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' ELSE 'ATT' END AS position, count(*) AS n FROM lineups GROUP BY 1"),
    "fun48_goal_attributes": (lambda a: a.goals().select("goal_id", tx.goal_attributes(F.when(F.col("minute") < 30, "Kopfball nach Flanke").when(F.col("minute") < 60, "Freistoß links").otherwise("nach Pass")).alias("x")).select("goal_id", "x.free_kick", "x.header", "x.body_part", "x.assist_type"), "SELECT goal_id, minute >= 30 AND minute < 60 AS free_kick, minute < 30 AS header, CASE WHEN minute < 30 THEN 'head' WHEN minute < 60 THEN 'left_foot' END AS body_part, CASE WHEN minute < 30 THEN 'cross' WHEN minute >= 60 THEN 'pass' END AS assist_type FROM goals"),
    "prj22_data_question": (lambda a: a.messages().groupBy(prj.data_question(F.col("content"), ["wie viele", "statistik", r"\btore\b", "the"]).alias("data")).agg(F.count("*").alias("n")), "SELECT regexp_matches(lower(content), 'wie viele|statistik|\\btore\\b|the') AS data, count(*) AS n FROM messages GROUP BY 1"),
    "prj25_preview": (lambda a: a.messages().select("session_id", "turn", prj.preview("content", 100).alias("preview")), "SELECT session_id, turn, substr(content, 1, 100) AS preview FROM messages"),
}
