"""Queries of quality checks and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sportlake.functions import text as tx
from sportlake.operators import compare
from sportlake.operators import corrections as cor
from sportlake.operators import joins as joi
from sportlake.operators import merges as mrg
from sportlake.operators import perspective as prj
from sportlake.operators import quality as dq
from sportlake.operators import sync
from sportlake.operators import windows as win
from sportlake.plans.texts import CATEGORY, NAMES, REASON, names
from sportlake.sources import io
from sportlake.sources import keyed as kt

MAPPING = "mp(old_id, new_id) AS (VALUES (19, 1), (20, 1), (18, 2))\n--\n"


def mapping(a):  # noqa: ANN001, ANN201
    """Teams 18 to 20 are others under another name."""
    return a.teams().filter("team_id >= 18").select(F.col("team_id").alias("old_id"), F.when(F.col("team_id") == 18, 2).otherwise(1).alias("new_id"))


def id_map(df, key: str, every: int, shift: int):  # noqa: ANN001, ANN201
    """source_id, target_id = id + shift; every so many ids have none."""
    return df.select(F.col(key).alias("source_id"), F.when(F.col(key) % every != 0, F.col(key) + shift).alias("target_id")).distinct()

#: Names of overview files: cup, friendly, five of Europe, and two that are none.
STUBS = ["profipokal", "profirest", "profiuefa", "profiuec", "profiuecl", "profiintertoto", "profiueclq", "profiliga", "profiliga7"]


def versions(a):  # noqa: ANN001, ANN201
    """Two versions of the matches: in the second the open ones are missing and some have no season."""
    m = a.matches()
    changed = F.when(F.col("match_id") % 1300 != 0, F.col("season_id"))
    return m.select("match_id", "season_id", "round_name"), m.filter("home_score IS NOT NULL").select("match_id", changed.alias("season_id"), "round_name")


def chains(a):  # noqa: ANN001, ANN201
    """Steps from team to team: 20 to 18 by way of 19, 17 to 1, a circle of three, and one to a team that is not there."""
    steps = "(20, 19), (19, 18), (17, 1), (14, 15), (15, 16), (16, 14), (13, 99)"
    return a.spark.sql(f"SELECT CAST(col1 AS INT) AS old_id, CAST(col2 AS INT) AS new_id FROM VALUES {steps}")


CHAINS = "ok AS (SELECT * FROM (VALUES (20, 18), (19, 18), (17, 1)) v(old_id, new_id))\n--\n"


def keyed(a, schema, keys, batches, rule):  # noqa: ANN001, ANN201
    """Batches merged one after another into a stored table with keys; the last one comes twice."""
    table = kt.KeyedTable(a.spark, io.shared_folder(a.spark), schema, keys, buckets=16)
    for n, batch in [*enumerate(batches), (len(batches) - 1, batches[-1])]:
        table.merge(batch.select(*table.schema.names), n, rule)
    return table.read()


#: Of the matches that the sync brings in, one of each day and pairing that the target lacks.
SYNC = """has AS (SELECT * FROM matches WHERE source_file = 'liga' AND home_team_id <= 12 AND away_team_id <= 12 AND competition_id <= 3 AND season_id <= 1999),
every AS (SELECT * FROM has UNION ALL SELECT * FROM matches ANTI JOIN has USING (match_date, home_team_id, away_team_id) QUALIFY row_number() OVER (PARTITION BY match_date, home_team_id, away_team_id ORDER BY match_id) = 1)
--
"""


def synced(a, *events):  # noqa: ANN001, ANN201
    """An archive with part of the teams, players, seasons and matches takes in the whole one, whose ids are others: the target, and the report."""
    more = lambda df, *columns: df.withColumns({c: F.col(c) + 500 for c in columns})
    part = a.matches().filter("source_file = 'liga' AND home_team_id <= 12 AND away_team_id <= 12 AND competition_id <= 3 AND season_id <= 1999")
    seasons = a.seasons().select("season_id", "label")
    have = {"teams": a.teams().filter("team_id <= 12"), "players": a.players().filter("player_id % 3 = 0"), "competitions": a.competitions().filter("competition_id <= 3"), "seasons": seasons.filter("season_id <= 1999"), "matches": part, "lineups": a.lineups().limit(0)}
    source = {"teams": more(a.teams(), "team_id"), "players": more(a.players(), "player_id"), "competitions": more(a.competitions(), "competition_id"), "seasons": more(seasons, "season_id"), "matches": more(a.matches(), "match_id", "season_id", "competition_id", "home_team_id", "away_team_id")}
    if "lineups" in events:
        source["lineups"] = more(a.lineups(), "match_id", "player_id")
    target = sync.Snapshot.of(a.spark, have)
    return target, sync.full_sync(source, target)


def sync_rows(a, name):  # noqa: ANN001, ANN201
    """Rows of a table after the sync; matches and line-ups with day and teams in place of ids."""
    target = synced(a, name)[0]
    teams = lambda side: target.read("teams").select(F.col("team_id").alias(f"{side}_team_id"), F.col("normalized_name").alias(side))
    named = target.read("matches").join(teams("home"), "home_team_id").join(teams("away"), "away_team_id")
    if name == "matches":
        return named
    return target.read(name).join(named.select("match_id", "match_date", "home", "away"), "match_id").join(target.read("players").select("player_id", "normalized_name"), "player_id")


QUERIES = {
    "dq01_valid_minute": (lambda a: a.goals().groupBy(dq.valid_minute(F.col("minute") + 30, F.col("stoppage")).alias("ok")).agg(F.count("*").alias("n")), "SELECT minute + 30 <= 120 AND coalesce(stoppage, 0) <= 20 AS ok, count(*) AS n FROM goals GROUP BY 1"),
    "dq02_valid_refs": (lambda a: dq.valid_refs(a.goals(), {"match_id": (a.matches(), "match_id"), "player_id": (a.players().filter("height_cm >= 165"), "player_id"), "assist_player_id": (a.players().filter("height_cm < 195"), "player_id")}).select("goal_id", "reason"), "SELECT goal_id, CASE WHEN player_id NOT IN (SELECT player_id FROM players WHERE height_cm >= 165) THEN 'unknown player_id' WHEN assist_player_id NOT IN (SELECT player_id FROM players WHERE height_cm < 195) THEN 'unknown assist_player_id' END AS reason FROM goals"),
    "dq03_ingest_events": (lambda a: dq.ingest_events(a.cards(), ["match_id", "player_id", "minute", "card_type"], "card_id", {"player_id": (a.players().filter("height_cm >= 165"), "player_id")})[1], "SELECT 'unknown player_id' AS reason, count(*) AS rows FROM cards WHERE player_id NOT IN (SELECT player_id FROM players WHERE height_cm >= 165) UNION ALL SELECT 'duplicate', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM cards WHERE player_id IN (SELECT player_id FROM players WHERE height_cm >= 165) GROUP BY match_id, player_id, minute, card_type)"),
    "dq03_ingested_rows": (lambda a: dq.ingest_events(a.cards(), ["match_id", "player_id", "minute", "card_type"], "card_id", {"player_id": (a.players().filter("height_cm >= 165"), "player_id")})[0].select("card_id", "match_id", "minute"), "SELECT min(card_id) AS card_id, match_id, minute FROM cards WHERE player_id IN (SELECT player_id FROM players WHERE height_cm >= 165) GROUP BY match_id, player_id, minute, card_type"),
    "dq04_sparse_seasons": (lambda a: dq.sparse_seasons(a.seasons(), a.matches(), 2500), "SELECT season_id, label, count(match_id) AS matches, count(DISTINCT competition_id) AS competitions, CASE WHEN count(match_id) = 0 THEN 'empty' ELSE 'sparse' END AS kind FROM seasons LEFT JOIN matches USING (season_id) GROUP BY 1, 2 HAVING count(match_id) < 2500"),
    "dq05_bad_player_names": (lambda a: dq.bad_player_names(names(a).select(F.col("doc_id").alias("player_id"), "name")).select("player_id", "reason"), NAMES + f"SELECT doc_id AS player_id, {REASON} AS reason FROM n WHERE {REASON} IS NOT NULL"),
    "dq06_record_adds_up": (lambda a: dq.record_adds_up(prj.result_wdl(a.matches()), "season_id"), "SELECT season_id, count(*) AS matches, count(*) FILTER (result IS NULL) AS open FROM f GROUP BY 1 HAVING count(*) FILTER (result IS NULL) <> 0"),
    "dq07_one_focal_team": (lambda a: prj.name_contains(a.teams(), "name", "team 1").agg(F.count("*").alias("names")).join(a.matches().agg(F.count("*").alias("matches")), F.lit(True)), "SELECT (SELECT count(*) FROM teams WHERE name ILIKE '%team 1%') AS names, (SELECT count(*) FROM matches) AS matches"),
    "dq08_bad_team_names": (lambda a: dq.bad_team_names(a.raw("documents").select("doc_id", F.col("text").alias("name"))).select("doc_id"), "SELECT doc_id FROM documents WHERE lower(text) LIKE '%trainer%' OR text LIKE '%,%' OR length(text) > 100"),
    "dq09_goals_per_match": (lambda a: dq.goals_per_match_range(a.matches(), 1.5, 4.0), "SELECT sum(home_score + away_score)::BIGINT AS goals, count(*) AS matches, sum(home_score + away_score) BETWEEN count(*) * 1.5 AND count(*) * 4.0 AS ok FROM matches WHERE home_score IS NOT NULL"),
    "dq10_expected_matches": (lambda a: dq.expected_matches(prj.focal_matches(a.matches()), ["season_id", "competition_id"], 25, 45), "SELECT season_id, competition_id, count(*) AS matches FROM f GROUP BY 1, 2 HAVING count(*) < 25 OR count(*) > 45"),
    "dq11_high_scores": (lambda a: dq.high_scores(a.matches(), 5, 9).select("match_id", "level"), "SELECT match_id, CASE WHEN home_score + away_score >= 9 THEN 'warn' ELSE 'info' END AS level FROM matches WHERE greatest(home_score, away_score) >= 5"),
    "dq12_score_vs_goals": (lambda a: dq.score_vs_goals(a.matches(), a.goals()).select("match_id", "home_goals", "away_goals"), "SELECT match_id, h AS home_goals, w AS away_goals FROM matches JOIN (SELECT match_id, count(*) FILTER (at_home <> (coalesce(event_type, '') = 'own_goal')) AS h, count(*) FILTER (at_home = (coalesce(event_type, '') = 'own_goal')) AS w FROM goals GROUP BY 1) USING (match_id) WHERE home_score <> h OR away_score <> w"),
    "dq13_halftime": (lambda a: dq.halftime_exceeds_final(a.matches().withColumn("halftime_home", F.col("halftime_home") + F.when(F.col("matchday") == 7, 2).otherwise(0))).select("match_id"), "SELECT match_id FROM matches WHERE halftime_home + CASE WHEN matchday = 7 THEN 2 ELSE 0 END > home_score OR halftime_away > away_score"),
    "dq14_no_lineups": (lambda a: dq.no_lineups(a.matches(), a.lineups(), 1998), "SELECT season_id, count(*) AS matches FROM matches ANTI JOIN lineups USING (match_id) WHERE season_id >= 1998 GROUP BY 1"),
    "dq15_scorer_not_in_lineup": (lambda a: joi.anti_missing(a.goals(), a.lineups().filter("line > 1"), ["match_id", "player_id"]).select("goal_id"), "SELECT goal_id FROM goals ANTI JOIN (SELECT * FROM lineups WHERE line > 1) USING (match_id, player_id)"),
    "dq16_date_outside_season": (lambda a: dq.date_outside_season(a.matches(), a.seasons().withColumn("start_year", F.when(F.col("season_id") == 1997, 1998).otherwise(F.col("start_year"))), "2000-12-31").select("match_id", "reason"), "SELECT match_id, CASE WHEN match_date > DATE '2000-12-31' THEN 'future' ELSE 'outside' END AS reason FROM matches WHERE match_date > DATE '2000-12-31' OR season_id = 1997"),
    "dq17_expectations": (lambda a: dq.expectations(a.matches(), [("first_season", "min(season_id) <= 1995"), ("season_1998", "count_if(season_id = 1998) > 0"), ("season_1905", "count_if(season_id = 1905) > 0")]), "SELECT 'first_season' AS fact, min(season_id) <= 1995 AS holds FROM matches UNION ALL SELECT 'season_1998', count(*) FILTER (season_id = 1998) > 0 FROM matches UNION ALL SELECT 'season_1905', count(*) FILTER (season_id = 1905) > 0 FROM matches"),
    "dq18_row_counts": (lambda a: dq.row_counts({"matches": a.matches(), "goals": a.goals(), "none": a.cards().filter("card_type = 'blue'")}), "SELECT 'matches' AS table_name, count(*) AS rows, count(*) = 0 AS empty FROM matches UNION ALL SELECT 'goals', count(*), count(*) = 0 FROM goals UNION ALL SELECT 'none', 0, true"),
    "dq19_required_not_null": (lambda a: dq.required_not_null(a.matches(), ["home_score", "referee_id", "match_date"]), "SELECT 'home_score' AS column_name, count(*) FILTER (home_score IS NULL) AS missing FROM matches UNION ALL SELECT 'referee_id', count(*) FILTER (referee_id IS NULL) FROM matches UNION ALL SELECT 'match_date', count(*) FILTER (match_date IS NULL) FROM matches"),
    "dq20_date_format": (lambda a: dq.date_format(a.matches().withColumn("d", F.when(F.col("matchday") == 3, F.date_format("match_date", "d.M.yyyy")).otherwise(F.col("match_date").cast("string"))), "d").select("match_id"), "SELECT match_id FROM matches WHERE matchday = 3"),
    "dq21_unique_values": (lambda a: dq.unique_values(a.goals(), "goal_id"), "SELECT goal_id, count(*) AS n FROM goals GROUP BY 1 HAVING count(*) > 1"),
    "dq22_value_ranges": (lambda a: dq.value_ranges(a.matches(), {"season_id": (1900, 2030), "home_score": (0, 4), "attendance": (0, 20000)}), "SELECT 'season_id' AS column_name, min(season_id)::BIGINT AS low, max(season_id)::BIGINT AS high, count(*) FILTER (season_id NOT BETWEEN 1900 AND 2030) AS outside FROM matches UNION ALL SELECT 'home_score', min(home_score), max(home_score), count(*) FILTER (home_score NOT BETWEEN 0 AND 4) FROM matches UNION ALL SELECT 'attendance', min(attendance), max(attendance), count(*) FILTER (attendance NOT BETWEEN 0 AND 20000) FROM matches"),
    "dq22_domains": (lambda a: dq.domains(a.cards(), "card_type", ["yellow", "red"]), "SELECT card_type, count(*) AS n FROM cards WHERE card_type NOT IN ('yellow', 'red') GROUP BY 1"),
    "dq23_compare_tables": (lambda a: dq.compare_tables(a.matches().select("match_id", "season_id"), a.matches().filter("competition_id <> 4").select("match_id", (F.col("season_id") + F.when(F.col("match_id") % 13 == 0, 1).otherwise(0)).alias("season_id"))), "SELECT count(*) AS rows_a, count(*) FILTER (competition_id <> 4) AS rows_b, count(*) FILTER (competition_id = 4 OR match_id % 13 = 0) AS only_a, count(*) FILTER (competition_id <> 4 AND match_id % 13 = 0) AS only_b FROM matches"),
    "dq23_compare_by_checksums": (lambda a: compare.summary(compare.Comparison(*versions(a), ["match_id"])), "SELECT count(*) AS rows_a, count(*) FILTER (home_score IS NOT NULL) AS rows_b, count(*) FILTER (home_score IS NULL OR match_id % 1300 = 0) AS only_a, count(*) FILTER (home_score IS NOT NULL AND match_id % 1300 = 0) AS only_b FROM matches"),
    "dq23_different_rows": (lambda a: compare.Comparison(*versions(a), ["match_id"]).rows(), "SELECT match_id, season_id, round_name, 'a' AS side, 1 AS times FROM matches WHERE home_score IS NULL OR match_id % 1300 = 0 UNION ALL SELECT match_id, NULL, round_name, 'b', 1 FROM matches WHERE home_score IS NOT NULL AND match_id % 1300 = 0"),
    "dq24_compare_runs": (lambda a: dq.compare_runs(*[m.groupBy(F.col("competition_id").cast("string").alias("metric")).agg(F.count("*").alias("value")) for m in (a.matches().filter("season_id = 1995"), a.matches().filter("season_id = 1996"))]), "SELECT competition_id::VARCHAR AS metric, count(*) FILTER (season_id = 1995) AS before, count(*) FILTER (season_id = 1996) AS after, count(*) FILTER (season_id = 1996) - count(*) FILTER (season_id = 1995) AS change FROM matches GROUP BY 1"),
    "dq25_find_name_errors": (lambda a: dq.find_name_errors({"player": names(a).select(F.col("doc_id").alias("id"), "name"), "team": a.teams().select(F.col("team_id").alias("id"), F.concat(F.lit("Trainer "), "name").alias("name"))}).select("kind", "id", "category", "delete"), NAMES + f"SELECT kind, id::BIGINT AS id, category, category IN ('trainer_name', 'referee_name', 'goal_text', 'error_text') AS delete FROM (SELECT 'player' AS kind, doc_id AS id, {CATEGORY} AS category FROM n UNION ALL SELECT 'team', team_id, 'trainer_name' FROM teams) WHERE category IS NOT NULL"),
    "agg43_error_breakdown": (lambda a: dq.error_breakdown(dq.high_scores(a.matches(), 5, 9).select("level", "source_file"), ["level", "source_file"]), "x AS (SELECT CASE WHEN home_score + away_score >= 9 THEN 'warn' ELSE 'info' END AS level, source_file FROM matches WHERE greatest(home_score, away_score) >= 5)\n--\nSELECT level AS value, count(*) AS n, 'level' AS \"by\" FROM x GROUP BY 1 UNION ALL SELECT source_file, count(*), 'source_file' FROM x GROUP BY 1"),
    "win11_examples_per_category": (lambda a: win.first_n(dq.high_scores(a.matches(), 5, 9).select("match_id", "level"), "level", ["match_id"], 10), "SELECT match_id, level FROM (SELECT match_id, level, row_number() OVER (PARTITION BY level ORDER BY match_id) AS r FROM (SELECT match_id, CASE WHEN home_score + away_score >= 9 THEN 'warn' ELSE 'info' END AS level FROM matches WHERE greatest(home_score, away_score) >= 5)) WHERE r <= 10"),
    "joi13_backfill_fk": (lambda a: joi.backfill_fk(a.raw("nation").select("n_nationkey", F.concat(F.lit(" TEAM "), F.col("n_nationkey") + 1, F.lit(" ")).alias("team_name")), "team_name", a.teams(), "team_id").select("n_nationkey", "team_id"), "SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN (n_nationkey + 1)::INT END AS team_id FROM nation"),
    "joi14_map_ids": (lambda a: joi.map_ids(a.players(), a.players().select((F.col("player_id") + 1000).alias("player_id"), F.when(F.col("player_id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("x"), "name")).alias("name"), F.col("name").alias("normalized_name")), "player_id"), "SELECT player_id AS source_id, CASE WHEN player_id % 2 = 0 THEN player_id + 1000 END AS target_id, CASE WHEN player_id % 2 = 0 THEN 'name' END AS found_by FROM players"),
    "joi15_map_matches": (lambda a: joi.map_matches(joi.role_teams(a.matches(), a.teams()), joi.role_teams(a.matches(), a.teams())), "SELECT match_id AS source_id, min(match_id) OVER (PARTITION BY match_date, home_team_id, away_team_id) AS target_id FROM matches"),
    "joi16_remap_events": (lambda a: joi.remap_events(a.goals().select("goal_id", "match_id", "player_id", "assist_player_id"), {"match_id": id_map(a.matches(), "match_id", 9, 100), "player_id": id_map(a.players(), "player_id", 10, 5)}, {"assist_player_id": id_map(a.players(), "player_id", 4, 7)}), "SELECT goal_id, match_id + 100 AS match_id, player_id + 5 AS player_id, CASE WHEN assist_player_id % 4 <> 0 THEN assist_player_id + 7 END AS assist_player_id FROM goals WHERE match_id % 9 <> 0 AND player_id % 10 <> 0"),
    "joi17_match_surname": (lambda a: joi.match_surname(a.raw("part").select(F.col("p_partkey").cast("string").alias("name")), a.players()).select("name", "player_id"), "SELECT (player_id - 1)::VARCHAR AS name, player_id FROM players"),
    "joi18_enrich_by_lastname": (lambda a: joi.enrich_by_lastname(a.players().select("player_id", "normalized_name", F.col("normalized_name").alias("name"), "height_cm"), a.players().select("player_id", F.col("normalized_name").alias("name"), "height_cm"), ["height_cm"]).select("player_id", "donor_id"), "SELECT p.player_id, CASE WHEN any_value(n) = 1 THEN min(d.player_id) ELSE min(d.player_id) FILTER (contains(d.normalized_name, p.normalized_name) OR contains(p.normalized_name, d.normalized_name)) END AS donor_id FROM players p LEFT JOIN (SELECT player_id, normalized_name, count(*) OVER (PARTITION BY split_part(normalized_name, ' ', -1)) AS n FROM players) d ON split_part(d.normalized_name, ' ', -1) = split_part(p.normalized_name, ' ', -1) GROUP BY 1"),
    "cor01_merge_entities": (lambda a: cor.merge_entities(a.matches(), ["home_team_id", "away_team_id"], mapping(a)).select("match_id", "home_team_id", "away_team_id"), MAPPING + "SELECT match_id, coalesce(h.new_id, home_team_id) AS home_team_id, coalesce(w.new_id, away_team_id) AS away_team_id FROM matches LEFT JOIN mp h ON h.old_id = home_team_id LEFT JOIN mp w ON w.old_id = away_team_id"),
    "cor01_merge_chains": (lambda a: mrg.merged({"matches": (a.matches(), ["home_team_id", "away_team_id"])}, a.teams(), "team_id", mrg.resolved(chains(a)))[0]["matches"].select("match_id", "home_team_id", "away_team_id"), CHAINS + "SELECT match_id, coalesce(h.new_id, home_team_id) AS home_team_id, coalesce(w.new_id, away_team_id) AS away_team_id FROM matches LEFT JOIN ok h ON h.old_id = home_team_id LEFT JOIN ok w ON w.old_id = away_team_id"),
    "cor01_merge_plan": (lambda a: mrg.plan({"matches": (a.matches(), ["home_team_id", "away_team_id"])}, a.teams(), "team_id", mrg.resolved(chains(a))), CHAINS + "SELECT 'entities' AS table_name, 'team_id' AS column_name, count(*) AS rows FROM teams JOIN ok ON old_id = team_id UNION ALL SELECT 'problems', 'circle', 3 UNION ALL SELECT 'problems', 'ambiguous', 0 UNION ALL SELECT 'problems', 'no such entity', 1 UNION ALL SELECT 'matches', 'home_team_id', count(*) FROM matches JOIN ok ON old_id = home_team_id UNION ALL SELECT 'matches', 'away_team_id', count(*) FROM matches JOIN ok ON old_id = away_team_id"),
    "cor01_merge_counts": (lambda a: cor.merge_counts({"matches": (a.matches(), ["home_team_id", "away_team_id"])}, mapping(a)), "SELECT 'matches' AS table_name, 'home_team_id' AS column_name, count(*) AS rows FROM matches WHERE home_team_id >= 18 UNION ALL SELECT 'matches', 'away_team_id', count(*) FROM matches WHERE away_team_id >= 18"),
    "cor02_drop_duplicate_matches": (lambda a: cor.cascade(a.goals(), cor.drop_duplicate_matches(a.matches(), ["season_competition_id", "match_date", "home_team_id"])[1]).groupBy("match_id").agg(F.count("*").alias("goals")), "SELECT match_id, count(*) AS goals FROM goals WHERE match_id IN (SELECT min(match_id) FROM matches GROUP BY season_competition_id, match_date, home_team_id) GROUP BY 1"),
    "cor03_dedupe_events": (lambda a: cor.dedupe_events(a.cards(), ["match_id", "player_id", "minute", "card_type"], "card_id").select("card_id", "match_id"), "SELECT min(card_id) AS card_id, match_id FROM cards GROUP BY match_id, player_id, minute, card_type"),
    "cor04_reclassify_friendlies": (lambda a: cor.reclassify(a.matches(), (F.col("competition_id") == 5) & (F.col("source_file") == "profirest"), 6)[0].select("match_id", "competition_id", "season_competition_id"), "SELECT match_id, k AS competition_id, season_id * 10 + k AS season_competition_id FROM (SELECT *, CASE WHEN competition_id = 5 AND source_file = 'profirest' THEN 6 ELSE competition_id END AS k FROM matches)"),
    "cor04_new_bridge_rows": (lambda a: cor.reclassify(a.matches(), (F.col("competition_id") == 5) & (F.col("source_file") == "profirest"), 6)[1], "SELECT DISTINCT season_id * 10 + 6 AS season_competition_id, season_id, 6 AS competition_id FROM matches WHERE competition_id = 5 AND source_file = 'profirest'"),
    "cor05_reclassify_by_round": (lambda a: cor.reclassify(a.matches(), (F.col("competition_id") == 4) & F.col("round_name").contains("Spieltag"), 1)[0].groupBy("competition_id").agg(F.count("*").alias("n")), "SELECT CASE WHEN competition_id = 4 AND round_name LIKE '%Spieltag%' THEN 1 ELSE competition_id END AS competition_id, count(*) AS n FROM matches GROUP BY 1"),
    "cor06_relink_leagues": (lambda a: cor.relink_leagues(a.season_competitions(), a.seasons().groupBy(F.lit(1).alias("k")).agg(F.min("season_id").alias("first")).select("first", (F.col("first") + 2).alias("last"), F.lit(9).alias("new_competition_id"))), "SELECT season_competition_id, season_id, CASE WHEN season_id <= (SELECT min(season_id) + 2 FROM seasons) THEN 9 ELSE competition_id END AS competition_id FROM season_competitions"),
    "cor07_clean_leading_marks": (lambda a: cor.clean_leading_marks(names(a)), NAMES + r"SELECT doc_id, coalesce(nullif(regexp_replace(name, '^[?\s]+', ''), ''), name) AS name FROM n"),
    "cor08_purge_invalid_players": (lambda a: cor.purge(a.goals(), ["player_id", "assist_player_id"], a.players().filter("height_cm > 190"), "player_id").select("goal_id"), "SELECT goal_id FROM goals WHERE player_id NOT IN (SELECT player_id FROM players WHERE height_cm > 190) AND coalesce(assist_player_id, -1) NOT IN (SELECT player_id FROM players WHERE height_cm > 190)"),
    "cor09_decide_cleaning": (lambda a: cor.decide_cleaning(a.players().select("player_id", F.when(F.col("player_id") % 2 == 0, F.col("name")).alias("right_name")), win.usage_count(a.lineups(), a.goals(), a.substitutions(), a.cards())).select("player_id", "action"), "SELECT player_id, CASE WHEN player_id NOT IN (SELECT player_id FROM lineups UNION SELECT player_id FROM goals UNION SELECT assist_player_id FROM goals WHERE assist_player_id IS NOT NULL UNION SELECT player_on_id FROM substitutions UNION SELECT player_off_id FROM substitutions UNION SELECT player_id FROM cards) THEN 'delete' WHEN player_id % 2 = 0 THEN 'update' ELSE 'needs_review' END AS action FROM players"),
    "cor10_enrich_profiles": (lambda a: cor.enrich_profiles(a.players(), a.raw("part").select((F.col("p_partkey") + 1).alias("player_id"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("height_cm"), F.lit(None).cast("string").alias("nationality")), "player_id", ["height_cm", "nationality"]).select("player_id", "height_cm", "nationality"), "SELECT player_id, CASE WHEN p_size > 25 THEN p_size ELSE height_cm END AS height_cm, nationality FROM players JOIN part ON p_partkey + 1 = player_id"),
    "cor11_rebuild_careers": (lambda a: cor.rebuild_careers(a.lineups().select("player_id", "match_id"), a.goals().filter("minute > 88").select("player_id", "match_id"), "player_id"), "SELECT player_id, match_id FROM lineups WHERE player_id NOT IN (SELECT player_id FROM goals WHERE minute > 88) UNION ALL SELECT player_id, match_id FROM goals WHERE minute > 88"),
    "cor12_resolve_player_names": (lambda a: cor.resolve_player_names(a.lineups().select("match_id", "player_id", F.col("player_id").cast("string").alias("profile_url"), F.lit("?").alias("name")), a.players().filter("height_cm >= 180").select(F.col("player_id").cast("string").alias("profile_url"), F.col("name").alias("full_name"))).select("match_id", "player_id", "name"), "SELECT match_id, player_id, CASE WHEN height_cm >= 180 THEN name ELSE '?' END AS name FROM lineups JOIN players USING (player_id)"),
    "cor13_assign_ids": (lambda a: cor.assign_ids(a.raw("part").select(F.col("p_name").alias("normalized_name")), a.players().filter("normalized_name LIKE '%ring%'").select("normalized_name", "player_id"), "player_id"), "k AS (SELECT normalized_name, min(player_id) AS player_id FROM players WHERE normalized_name LIKE '%ring%' GROUP BY 1), t AS (SELECT max(player_id) AS top FROM players WHERE normalized_name LIKE '%ring%')\n--\nSELECT * FROM k UNION ALL SELECT p_name, top + row_number() OVER (ORDER BY md5(p_name), p_name) FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT LIKE '%ring%'), t"),
    "cor14_set_standings": (lambda a: cor.set_standings(a.matches()), "x AS (SELECT season_competition_id, home_team_id AS team_id, home_score AS g, away_score AS c FROM matches WHERE home_score IS NOT NULL UNION ALL SELECT season_competition_id, away_team_id, away_score, home_score FROM matches WHERE home_score IS NOT NULL)\n--\nSELECT *, row_number() OVER (PARTITION BY season_competition_id ORDER BY points DESC, goal_difference DESC, goals_for DESC, team_id)::INT AS place FROM (SELECT season_competition_id, team_id, sum(CASE WHEN g > c THEN 3 WHEN g = c THEN 1 ELSE 0 END)::BIGINT AS points, sum(g)::BIGINT AS goals_for, sum(c)::BIGINT AS goals_against, sum(g - c)::BIGINT AS goal_difference FROM x GROUP BY 1, 2)"),
    "cor15_rename_if_free": (lambda a: cor.rename_if_free(a.players().select("player_id", "name"), a.players().select("player_id", F.when(F.col("player_id") % 4 == 0, F.col("name")).otherwise(F.concat(F.lit("Dr. "), "name")).alias("full_name")), "player_id"), "SELECT player_id, CASE WHEN player_id % 4 <> 0 THEN 'Dr. ' || name ELSE name END AS name FROM players"),
    "cor16_full_sync": (lambda a: cor.append_missing(a.matches().filter("source_file = 'liga'"), joi.remap_events(a.matches(), {}, {"home_team_id": id_map(a.teams(), "team_id", 6, 0)}), "match_id", ["home_team_id", "home_score"])[0].select("match_id", "home_team_id", "home_score"), "SELECT match_id, home_team_id, home_score FROM matches WHERE source_file <> 'liga' AND home_team_id % 6 <> 0 AND home_score IS NOT NULL"),
    "cor17_reload_events": (lambda a: cor.reload_events(a.goals(), a.goals().filter("minute > 45"), a.matches().filter("season_id = 1998")).select("goal_id", "match_id", "minute"), "SELECT goal_id, match_id, minute FROM goals JOIN matches USING (match_id) WHERE season_id <> 1998 OR minute > 45"),
    "cor16_sync_matches": (lambda a: sync_rows(a, "matches").select("match_date", "home", "away", "home_score"), SYNC + "SELECT match_date, 'team ' || home_team_id AS home, 'team ' || away_team_id AS away, home_score FROM every"),
    "cor16_sync_lineups": (lambda a: sync_rows(a, "lineups").select("match_date", "home", "away", "normalized_name", "line", "is_starter", "shirt_number"), SYNC + "SELECT DISTINCT match_date, 'team ' || home_team_id AS home, 'team ' || away_team_id AS away, normalized_name, line, is_starter, shirt_number FROM lineups JOIN matches USING (match_id) JOIN players USING (player_id)"),
    "cor16_sync_report": (lambda a: synced(a)[1].select("table_name", "created", "skipped"), SYNC + "SELECT 'teams' AS table_name, 8 AS created, 0 AS skipped UNION ALL SELECT 'players', (SELECT count(DISTINCT normalized_name) FROM players) - (SELECT count(DISTINCT normalized_name) FROM players WHERE player_id % 3 = 0), 0 UNION ALL SELECT 'competitions', 2, 0 UNION ALL SELECT 'seasons', count(*) FILTER (season_id > 1999), 0 FROM seasons UNION ALL SELECT 'matches', (SELECT count(*) FROM every) - (SELECT count(*) FROM has), 0"),
    "src10_upsert_latest": (lambda a: cor.upsert_latest(a.answers().filter("is_correct").select("player", "round_id", F.lit("old").alias("v")).distinct(), a.answers().filter("time_ms > 5000").select("player", "round_id", F.lit("new").alias("v")).distinct(), ["player", "round_id"]), "SELECT player, round_id, CASE WHEN bool_or(time_ms > 5000) THEN 'new' ELSE 'old' END AS v FROM answers WHERE is_correct OR time_ms > 5000 GROUP BY 1, 2"),
    "src11_insert_ignore": (lambda a: cor.insert_ignore(a.matches().filter("source_file = 'liga'").select("match_id", F.lit("old").alias("v")), a.matches().filter("competition_id >= 3").select("match_id", F.lit("new").alias("v")), ["match_id"]), "SELECT match_id, CASE WHEN source_file = 'liga' THEN 'old' ELSE 'new' END AS v FROM matches WHERE source_file = 'liga' OR competition_id >= 3"),
    "src12_upsert_merge": (lambda a: cor.upsert_merge(a.matches().filter("source_file = 'liga'").select("match_id", "attendance", "referee_id", F.lit(False).alias("seen")), a.matches().filter("competition_id >= 3").select("match_id", F.lit(10000).alias("attendance"), F.lit(None).cast("int").alias("referee_id"), F.lit(True).alias("seen")), ["match_id"], {"attendance": "greatest", "referee_id": "fill", "seen": "either"}), "SELECT match_id, CASE WHEN competition_id < 3 THEN attendance WHEN source_file <> 'liga' THEN 10000 ELSE greatest(attendance, 10000) END AS attendance, CASE WHEN source_file = 'liga' THEN referee_id END AS referee_id, competition_id >= 3 AS seen FROM matches WHERE source_file = 'liga' OR competition_id >= 3"),
    "src10_keyed_latest": (lambda a: keyed(a, "player long, round_id int, answer_id long", ["player", "round_id"], [a.answers().filter("is_correct"), a.answers().filter("time_ms > 5000")], kt.newest("answer_id")), "SELECT player, round_id, max(answer_id) AS answer_id FROM answers WHERE is_correct OR time_ms > 5000 GROUP BY 1, 2"),
    "src11_keyed_ignore": (lambda a: keyed(a, "match_id long, v string", ["match_id"], [a.matches().filter("source_file = 'liga'").withColumn("v", F.lit("old")), a.matches().filter("competition_id >= 3").withColumn("v", F.lit("new"))], kt.earliest()), "SELECT match_id, CASE WHEN source_file = 'liga' THEN 'old' ELSE 'new' END AS v FROM matches WHERE source_file = 'liga' OR competition_id >= 3"),
    "src12_keyed_merge": (lambda a: keyed(a, "match_id long, attendance int, referee_id int", ["match_id"], [a.matches().filter("source_file = 'liga'"), a.matches().filter("competition_id >= 3").withColumns({"attendance": F.lit(10000), "referee_id": F.lit(None).cast("int")})], kt.merged({"attendance": "greatest"})), "SELECT match_id, CASE WHEN competition_id < 3 THEN attendance WHEN source_file <> 'liga' THEN 10000 ELSE greatest(attendance, 10000) END AS attendance, CASE WHEN source_file = 'liga' THEN referee_id END AS referee_id FROM matches WHERE source_file = 'liga' OR competition_id >= 3"),
    "src19_append_missing": (lambda a: cor.append_missing(a.matches().filter("season_id < 1998"), a.matches(), "match_id", ["home_score", "referee_id"])[1], "SELECT count(*) FILTER (home_score IS NOT NULL AND referee_id IS NOT NULL) AS copied, count(*) FILTER (home_score IS NULL OR referee_id IS NULL) AS skipped FROM matches WHERE season_id >= 1998"),
    "src21_classify_files": (lambda a: a.matches().groupBy(tx.classify_file(F.concat(F.lit("/x/"), "source_file", F.lit("/profi"), "source_file", F.col("match_id") % 3, F.lit(".html"))).alias("kind")).agg(F.count("*").alias("n")), "SELECT CASE source_file WHEN 'liga' THEN 'league_overview' ELSE 'match' END AS kind, count(*) AS n FROM matches GROUP BY 1"),
    "src21_overview_competitions": (lambda a: a.matches().select("match_id", tx.overview_competition(F.concat(F.lit("1998-99/"), F.element_at(F.array(*map(F.lit, STUBS)), (F.col("match_id") % len(STUBS) + 1).cast("int")), F.lit(".html"))).alias("x")).select("match_id", "x.label", "x.level"), f"SELECT match_id, CASE WHEN k = 0 THEN 'DFB-Pokal' WHEN k = 1 THEN 'Freundschaftsspiele' WHEN k < 7 THEN 'Europapokal' END AS label, CASE WHEN k = 0 THEN 'cup' WHEN k = 1 THEN 'friendly' WHEN k < 7 THEN 'international' END AS level FROM (SELECT match_id, match_id % {len(STUBS)} AS k FROM matches)"),
}
