"""Queries on quiz answers, chat messages, vectors, tables and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sportlake.functions.numbers import points_time, ratio, sql_ratio
from sportlake.operators import aggregates as agg
from sportlake.operators import mentions
from sportlake.operators import perspective as prj
from sportlake.operators import vectors as vec
from sportlake.operators import windows as win
from sportlake.sources import io
from sportlake.plans import page_makers as made
from sportlake.sources import pages as pg
from sportlake.streaming import incremental as inc
from sportlake.streaming import jobs as st

POINTS = "ap AS (SELECT *, CASE WHEN is_correct THEN greatest(10, 100 - time_ms * 2 // 1000) ELSE 0 END::BIGINT AS points FROM answers)\n--\n"
BOARD = f"SELECT player, count(DISTINCT game_id) AS games, count(*) AS questions, count(*) FILTER (is_correct) AS correct, sum(points)::BIGINT AS points, {sql_ratio('count(*) FILTER (is_correct)', 'count(*)', 2, 100)} AS accuracy, {sql_ratio('coalesce(sum(time_ms) FILTER (is_correct), 0)::BIGINT', 'count(*) FILTER (is_correct)', 2)} AS avg_time_ms FROM ap JOIN rounds USING (round_id)"
COS = "list_dot_product(b.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
STREAK = "SELECT player, count(*) FILTER (misses = 0 AND is_correct) AS current_streak FROM (SELECT *, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY player ORDER BY submitted_at DESC, answer_id DESC ROWS UNBOUNDED PRECEDING) AS misses FROM answers) GROUP BY 1"
BEST = "SELECT player, max(n) AS best_streak FROM (SELECT player, island, count(*) FILTER (is_correct) AS n FROM (SELECT *, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY player ORDER BY submitted_at, answer_id ROWS UNBOUNDED PRECEDING) AS island FROM answers) GROUP BY 1, 2) GROUP BY 1"
SESSIONS = "SELECT player, min(submitted_at) AS started, max(submitted_at) AS last_seen, count(*) AS messages FROM (SELECT *, sum(g) OVER (PARTITION BY player ORDER BY submitted_at, answer_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN submitted_at - lag(submitted_at) OVER (PARTITION BY player ORDER BY submitted_at, answer_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS g FROM answers)) GROUP BY player, s"


#: Names out of benchmark texts: their last two words, and their first two short ones.
LAST, SHORT = r"([A-Za-z]+ [A-Za-z]+)[^A-Za-z]*$", r"(?:^|[^A-Za-z])([a-z][a-z]? [a-z][a-z]?)[^A-Za-z]"
PLAIN = r"lower(trim(regexp_replace(regexp_replace(strip_accents({c}), '[^A-Za-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')))"
PHRASES = f"""ph AS (SELECT entity_id, {PLAIN.format(c="name")} AS name FROM (SELECT item_id * 2 AS entity_id, regexp_extract(text, '{LAST}', 1) AS name FROM benchmark UNION ALL SELECT item_id * 2 + 1, regexp_extract(text, '{SHORT}', 1) FROM benchmark)),
pt AS (SELECT entity_id, name AS pattern FROM ph WHERE name <> '' UNION SELECT entity_id, t FROM (SELECT entity_id, unnest(string_split(name, ' ')) AS t FROM ph) WHERE length(t) >= 3)
--
"""
NAMED = "SELECT DISTINCT {key}, entity_id FROM (SELECT *, " + PLAIN.format(c="text") + " AS plain FROM {table}) JOIN pt ON contains(plain, pattern)"


#: Tables and what they refer to.
PARENTS = {"nation": ["region"], "customer": ["nation"], "supplier": ["nation"], "orders": ["customer"], "lineitem": ["orders", "part", "supplier"], "labels": ["documents"]}
IN_ORDER = "benchmark conversations documents embeddings events pages part region labels nation customer supplier orders lineitem".split()


def everything(a, database):  # noqa: ANN001, ANN201
    return io.load_in_order({t: a.raw(t) for t in IN_ORDER}, PARENTS, database)


def listed(a, database):  # noqa: ANN001, ANN201
    everything(a, database)
    return io.catalogue(a.spark, database)


def phrases(a):  # noqa: ANN001, ANN201
    text, id_ = F.col("text"), F.col("item_id") * 2
    every = F.array(F.struct(id_.alias("entity_id"), F.regexp_extract(text, LAST, 1).alias("name")), F.struct((id_ + 1).alias("entity_id"), F.regexp_extract(text, SHORT, 1).alias("name")))
    return a.raw("benchmark").select(F.explode(every).alias("x")).select("x.*")


def answers(a):  # noqa: ANN001, ANN201
    return a.answers().withColumn("points", points_time(F.col("is_correct"), F.col("time_ms")))


def questions(a):  # noqa: ANN001, ANN201
    """A question per part: topic, difficulty, times used."""
    return a.raw("part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("topic"), (F.col("p_size") % 7).alias("times_used"), F.col("p_name").alias("correct"), F.array("p_brand", "p_type", F.lit("x")).alias("alternatives"))


def base(a):  # noqa: ANN001, ANN201
    return a.raw("embeddings")


def asked(a):  # noqa: ANN001, ANN201
    return a.raw("embeddings").filter("vec_id % 20 = 0")


def driven(kept, a):  # noqa: ANN001, ANN201
    """What an incremental job keeps of the whole stream of answers."""
    inc.drive(st.answer_stream(a), kept.step)
    return kept.read()


def late_counts(kept, late):  # noqa: ANN001, ANN201
    """Answers of both sides by player: together they are all."""
    return kept.unionByName(late).groupBy("player").agg(F.count("*").alias("answers"))


QUERIES = {
    "joi22_round_question": (lambda a: answers(a).join(a.rounds(), "round_id").groupBy("game_id", "question_id").agg(F.count("*").alias("n")), "SELECT game_id, question_id, count(*) AS n FROM answers JOIN rounds USING (round_id) GROUP BY 1, 2"),
    "prj23_active_sessions": (lambda a: prj.active_sessions(a.answers().groupBy("player").agg((F.max("submitted_at") + F.expr("INTERVAL 1 HOUR")).alias("expires_at")), "2024-01-20 12:00:00").select("player", "active"), "SELECT player, max(submitted_at) + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-20 12:00:00' AS active FROM answers GROUP BY 1"),
    "agg09_leaderboard_of_players": (lambda a: agg.player_quiz_stats(a.answers()).select("player", "questions", "correct", ratio("correct", "questions", 2, 100).alias("accuracy")), f"SELECT player, questions, correct, {sql_ratio('correct', 'questions', 2, 100)} AS accuracy FROM (SELECT player, count(*) AS questions, count(*) FILTER (is_correct) AS correct FROM answers GROUP BY 1)"),
    "agg10_global_leaderboard": (lambda a: agg.game_leaderboard(answers(a), a.rounds()), POINTS + BOARD + " GROUP BY player"),
    "agg16_game_leaderboard": (lambda a: agg.game_leaderboard(answers(a), a.rounds(), 2), POINTS + BOARD + " WHERE game_id = 2 GROUP BY player"),
    "agg45_question_stats": (lambda a: agg.question_stats(a.answers(), a.rounds()), f"SELECT question_id, count(*) AS used, count(*) FILTER (is_correct) AS correct, {sql_ratio('sum(time_ms)::BIGINT', 'count(*)', 2)} AS avg_time_ms FROM answers JOIN rounds USING (round_id) GROUP BY 1"),
    "agg46_player_quiz_stats": (lambda a: agg.player_quiz_stats(a.answers()), f"SELECT player, count(*) AS questions, count(*) FILTER (is_correct) AS correct, {sql_ratio('sum(time_ms)::BIGINT', 'count(*)', 2)} AS avg_time_ms FROM answers GROUP BY 1"),
    "agg47_generation_progress": (lambda a: agg.generation_progress(a.answers().join(a.rounds(), "round_id").select("game_id", "round_id", F.when(F.col("answer") == "error", "failed").when(F.col("answer") == "view", "pending").otherwise("completed").alias("status"))), "SELECT game_id, count(*) AS jobs, count(*) FILTER (answer NOT IN ('error', 'view')) AS completed, max((answer = 'error')::INT) AS failed, min(round_id) FILTER (answer IN ('error', 'view')) AS first_open, CASE WHEN bool_or(answer = 'error') THEN 'failed' WHEN count(*) FILTER (answer IN ('error', 'view')) = 0 THEN 'completed' ELSE 'running' END AS state FROM answers JOIN rounds USING (round_id) GROUP BY 1"),
    "win02_current_streak": (lambda a: win.current_streak(a.answers()), STREAK),
    "win03_best_streak": (lambda a: win.best_streak(a.answers()), BEST),
    "win10_last_n_messages": (lambda a: win.last_n(a.messages(), 3).select("session_id", "turn", "position"), "SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn)::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages) WHERE r <= 3"),
    "ord04_sample_questions": (lambda a: win.sample_rows(questions(a).filter("topic = 'PROMO'"), "question_id", 10, 7).select("question_id"), "SELECT p_partkey AS question_id FROM part WHERE p_type = 'PROMO' ORDER BY md5(p_partkey || ':7'), 1 LIMIT 10"),
    "ord05_least_used": (lambda a: win.top_k(questions(a).filter("topic = 'ECONOMY'").select("question_id", "times_used"), ["times_used", "question_id"], 100), "SELECT p_partkey AS question_id, p_size % 7 AS times_used FROM part WHERE p_type = 'ECONOMY' ORDER BY 2, 1 LIMIT 100"),
    "ord10_shuffle_options": (lambda a: questions(a).select("question_id", F.array_join(win.shuffled_options(F.col("correct"), F.col("alternatives"), F.col("question_id"), 3), "|").alias("options"), F.size(win.shuffled_options(F.col("correct"), F.col("alternatives"), F.col("question_id"), 3)).alias("n")), "SELECT p_partkey AS question_id, array_to_string(list_transform(list_sort(list_transform([p_name, p_brand, p_type, 'x'], lambda x: {'h': md5(p_partkey || ':' || x || ':3'), 'x': x})), lambda y: y.x), '|') AS options, 4 AS n FROM part"),
    "str01_player_stats": (lambda a: st.run_once(st.player_stats(st.answer_stream(a)), a, "update", ["player"]), "SELECT player, count(*) AS questions, count(*) FILTER (is_correct) AS correct, sum(time_ms)::BIGINT AS time_ms FROM answers GROUP BY 1"),
    "str02_streaks": (lambda a: driven(inc.Streaks(a.spark), a), f"SELECT player, current_streak, best_streak FROM ({STREAK}) JOIN ({BEST}) USING (player)"),
    "str02_streaks_batch": (lambda a: inc.streaks_of(inc.block_runs(a.answers().withColumn("submitted_at", F.col("submitted_at").cast("timestamp")))), f"SELECT player, current_streak, best_streak FROM ({STREAK}) JOIN ({BEST}) USING (player)"),
    "str03_question_stats": (lambda a: st.run_once(st.question_stats(st.answer_stream(a), a.rounds()), a, "update", ["question_id"]), "SELECT question_id, count(*) AS used, count(*) FILTER (is_correct) AS correct, sum(time_ms)::BIGINT AS time_ms FROM answers JOIN rounds USING (round_id) GROUP BY 1"),
    "str04_chat_sessions": (lambda a: st.run_once(st.sessions(st.answer_stream(a)), a, "complete"), SESSIONS),
    "str04_ended_sessions": (lambda a: st.run_once(st.sessions(st.answer_stream(a, "2 days")), a, "append"), SESSIONS.replace("SELECT player, min", "SELECT * FROM (SELECT player, min", 1) + ") WHERE last_seen + INTERVAL 1 HOUR <= (SELECT max(submitted_at) - INTERVAL 2 DAY FROM answers)"),
    "str04_sessions_batch": (lambda a: st.sessions_batch(a.answers()), SESSIONS),
    "str05_one_answer_per_round": (lambda a: inc.one_of_each(st.answer_stream(a).select("player", "round_id", "submitted_at", "answer_id"), ["player", "round_id"], ["submitted_at", "answer_id"]).select("player", "round_id", "answer_id"), "SELECT player, round_id, first(answer_id ORDER BY submitted_at, answer_id) AS answer_id FROM answers GROUP BY 1, 2"),
    "str05_last_answer_per_round": (lambda a: inc.one_of_each(st.answer_stream(a).select("player", "round_id", "submitted_at", "answer_id"), ["player", "round_id"], ["submitted_at", "answer_id"], last=True).select("player", "round_id", "answer_id"), "SELECT player, round_id, last(answer_id ORDER BY submitted_at, answer_id) AS answer_id FROM answers GROUP BY 1, 2"),
    "str06_refresh": (lambda a: driven(inc.Totals(a.spark, "answer_id long, round_id int, is_correct boolean, time_ms long", ["answer_id"], ["round_id"], {"correct": F.col("is_correct").cast("int"), "time_ms": F.col("time_ms")}), a), "SELECT round_id, count(*) AS n, sum(is_correct::INT)::BIGINT AS correct, sum(time_ms)::BIGINT AS time_ms FROM answers GROUP BY 1"),
    "str07_leaderboard": (lambda a: st.run_once(st.leaderboard(st.answer_stream(a)), a, "update", ["player"]), POINTS + "SELECT player, sum(points)::BIGINT AS points, count(*) AS questions FROM ap GROUP BY 1"),
    "str08_dedupe_events": (lambda a: st.run_once(st.deduped(st.answer_stream(a), ["player", "round_id", "answer"]), a, "append").select("player", "round_id", "answer"), "SELECT DISTINCT player, round_id, answer FROM answers"),
    "str09_late_stream": (lambda a: late_counts(*inc.late_split(st.answer_stream(a), "submitted_at", "2 minutes")), "SELECT player, count(*) AS answers FROM answers GROUP BY 1"),
    "str09_late_answers": (lambda a: st.late_batch(a.answers(), "2 minutes").groupBy("late").agg(F.count("*").alias("n")), "SELECT submitted_at < m - INTERVAL 2 MINUTE AS late, count(*) AS n FROM (SELECT submitted_at, max(submitted_at) OVER (ORDER BY answer_id ROWS UNBOUNDED PRECEDING) AS m FROM answers) GROUP BY 1"),
    "vec01_cosine_top_k": (lambda a: vec.cosine_top_k(base(a), asked(a), 10).select("q_id", "vec_id", "rank"), f"SELECT q_id, vec_id, r::INT AS rank FROM (SELECT q.vec_id AS q_id, b.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, b.vec_id) AS r FROM embeddings b, embeddings q WHERE q.vec_id % 20 = 0) WHERE r <= 10"),
    "vec02_inner_product_top_k": (lambda a: vec.inner_product_top_k(base(a), asked(a), 5).select("q_id", "vec_id", "rank"), "SELECT q_id, vec_id, r::INT AS rank FROM (SELECT q.vec_id AS q_id, b.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r FROM embeddings b, embeddings q WHERE q.vec_id % 20 = 0 AND b.label = q.label) WHERE r <= 5"),
    "vec03_cosine_hints": (lambda a: vec.cosine_hints(base(a), asked(a)).select("q_id", "vec_id"), f"SELECT q_id, vec_id FROM (SELECT q.vec_id AS q_id, b.vec_id, round({COS}, 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, b.vec_id) AS r FROM embeddings b, embeddings q WHERE q.vec_id % 20 = 0) WHERE r <= 5 AND s >= 0.18"),
    "vec04_match_band": (lambda a: vec.band_counts(base(a), asked(a), lambda label: label % 2 == 0), f"SELECT label::BIGINT AS label, CASE WHEN s >= CASE WHEN label % 2 = 0 THEN 0.85 ELSE 0.70 END THEN 'accept' WHEN s >= CASE WHEN label % 2 = 0 THEN 0.60 ELSE 0.50 END THEN 'review' ELSE 'reject' END AS band, count(*) AS n FROM (SELECT b.label, round({COS}, 9) AS s FROM embeddings b, embeddings q WHERE q.vec_id % 20 = 0) GROUP BY 1, 2"),
    "vec05_missing_embeddings": (lambda a: vec.missing_embeddings(a.players().select(F.col("player_id").alias("vec_id")), base(a), "vec_id", 100).select("vec_id"), "SELECT player_id AS vec_id FROM players WHERE player_id NOT IN (SELECT vec_id FROM embeddings)"),
    "vec06_upsert_embeddings": (lambda a: st.upsert_vectors(base(a).select("vec_id", "label"), base(a).filter("label = 0").select("vec_id", F.lit(99).alias("label")), ["vec_id"]), "SELECT vec_id, CASE WHEN label = 0 THEN 99 ELSE label END::INT AS label FROM embeddings"),
    "vec07_approx_top_k": (lambda a: vec.approx_top_k(base(a), asked(a), 10), None),
    "vec08_resolve_mentions": (lambda a: vec.mentions(a.raw("documents").select("doc_id", "text"), "doc_id", a.raw("region").select(F.col("r_regionkey").alias("entity_id"), F.concat(F.substring(F.lit("the que und con les"), F.col("r_regionkey") * 4 + 1, F.lit(3)), F.lit(" of")).alias("name"))), "x AS (SELECT DISTINCT doc_id, unnest(string_split(lower(trim(regexp_replace(regexp_replace(strip_accents(text)" + r", '[^A-Za-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))), ' ')) AS token FROM documents)" + "\n--\nSELECT DISTINCT doc_id, r_regionkey AS entity_id FROM x JOIN region ON token = substr('the que und con les', r_regionkey * 4 + 1, 3)"),
    "vec08_whole_names": (lambda a: mentions.resolve(a.raw("documents").select("doc_id", "text"), "doc_id", phrases(a)), PHRASES + NAMED.format(key="doc_id", table="documents")),
    "fun43_whole_names": (lambda a: mentions.resolve(a.messages().select(F.concat_ws("/", "session_id", "turn").alias("key"), F.col("content").alias("text")), "key", phrases(a)), PHRASES + NAMED.format(key="session_id || '/' || turn AS key", table="(SELECT *, content AS text FROM messages)")),
    "src06_scan_table": (lambda a: io.scan_table(a.spark, a.folder, "supplier", ["s_suppkey", "s_name"]), "SELECT s_suppkey, s_name FROM supplier"),
    "src07_coerce_dates": (lambda a: io.coerce_dates(a.matches().select("match_id", F.when(F.col("match_id") % 3 == 0, F.date_format("match_date", "d.M.yyyy")).when(F.col("match_id") % 3 == 1, F.col("match_date").cast("string")).otherwise("31.09.1972").alias("d")), ["d"]), "SELECT match_id, CASE WHEN match_id % 3 < 2 THEN match_date END AS d FROM matches"),
    "src08_coerce_booleans": (lambda a: io.coerce_booleans(a.lineups().select("match_id", "player_id", F.col("is_starter").cast("int").alias("is_starter")), ["is_starter"]), "SELECT match_id, player_id, is_starter FROM lineups"),
    "src09_load_tables": (lambda a: io.load_tables({"orders": a.raw("orders"), "lineitem": a.raw("lineitem")}, "sportlake_copy"), "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem"),
    "src13_write_csv": (lambda a: io.csv_round_trip(a.matches().select("match_id", "match_date", "home_score")), "SELECT match_id, match_date, home_score FROM matches"),
    "src14_write_json": (lambda a: a.raw("part").select("p_partkey", "p_name").select(io.as_json(a.raw("part").select("p_partkey", "p_name")).alias("row")), "SELECT '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}' AS row FROM part"),
    "src15_report": (lambda a: io.report_round_trip(a.matches().filter("home_score >= 5").select("match_id", "home_score")), "SELECT match_id, home_score FROM matches WHERE home_score >= 5"),
    "src16_materialize": (lambda a: io.materialize("sportlake_seasons", agg.season_performance(a.matches())).select("view_name", "rows"), "SELECT 'sportlake_seasons' AS view_name, count(*) AS rows FROM (SELECT DISTINCT season_id, competition_id FROM f)"),
    "src17_table_stats": (lambda a: io.table_stats({"region": a.raw("region"), "part": a.raw("part")}), "SELECT 'region' AS table_name, 2 AS columns, count(*) AS rows FROM region UNION ALL SELECT 'part', 6, count(*) FROM part"),
    "src09_load_in_order": (lambda a: everything(a, "sportlake_all"), " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS place, count(*) AS rows FROM {t}" for k, t in enumerate(IN_ORDER, 1))),
    "src17_catalogue": (lambda a: listed(a, "sportlake_listed").select("table_name", "column_name", "position", "rows"), " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, (row_number() OVER ())::INT AS position, (SELECT count(*) FROM {t}) AS rows FROM (DESCRIBE {t})" for t in IN_ORDER)),
    "src18_write_by_decade": (lambda a: io.by_decade(a.matches().select("match_id", "match_date"), "match_date").groupBy("decade").agg(F.count("*").alias("n")), "SELECT (year(match_date) // 10 * 10)::INT AS decade, count(*) AS n FROM matches GROUP BY 1"),
    "src20_guarded_sql": (lambda a: io.guarded_sql(a.spark, "SELECT match_id FROM {m} WHERE season_id = 1998 AND source_file <> ';' ORDER BY match_id; DROP TABLE m", 200, m=a.matches()), "SELECT match_id FROM matches WHERE season_id = 1998 ORDER BY match_id LIMIT 200"),
    "src02_resolve_frames": (lambda a: pg.resolve_frames(made.framed(a.raw("pages"))).select("url", "content_url"), "SELECT 'frame/' || url AS url, url AS content_url FROM pages UNION ALL SELECT url, url FROM pages"),
    "src03_explode_blocks": (lambda a: pg.explode_blocks(a.raw("pages"), "<p>"), "SELECT page_id, i::INT AS block, p[i + 2] AS html FROM (SELECT page_id, string_split(html, '<p>') AS p FROM pages) x, unnest(range(len(x.p) - 1)) AS r(i)"),
    "src04_overview_links": (lambda a: pg.links(a.raw("pages")), r"""SELECT page_id, i::INT AS position, h[i + 1] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages) x, unnest(range(len(x.h))) AS r(i)"""),
    "src05_fallback_fixtures": (lambda a: pg.fixtures(made.fixture_pages(a.matches(), a.teams()), "Team 1"), "SELECT season_competition_id, matchday, 'Team ' || opponent_id AS opponent, own_score, opponent_score FROM f WHERE home_score IS NOT NULL"),
    "src22_extract_archive": (lambda a: pg.extract_goals(made.match_pages(a.matches(), a.goals())), "SELECT match_id, minute, stoppage, score_home, score_away, 'P' || player_id AS scorer, assist_player_id::VARCHAR AS assist FROM goals"),
    "fun24_profile_facts": (lambda a: pg.profiles(made.profile_pages(a.players())), "SELECT player_id, make_date(1950 + (player_id % 50)::INT, 1, 1) AS birth_date, CASE WHEN player_id % 3 <> 0 THEN 'Mainz' END AS birth_place, CASE WHEN player_id % 5 <> 0 THEN height_cm END AS height_cm, (player_id % 30 + 60)::INT AS weight_kg, regexp_extract(primary_position, '^[A-Za-z]+') AS position, regexp_extract(nationality, '^[A-Za-z]+') AS nationality FROM players"),
    "fun26_key_value_facts": (lambda a: pg.key_values(made.fact_pages(a.players())).select("page_id", *[F.col("facts")[k].alias(c) for k, c in (("Position", "position"), ("Land", "country"), ("Größe", "height"))], F.size("facts").alias("n")), "SELECT player_id AS page_id, primary_position AS position, nationality AS country, height_cm::VARCHAR AS height, 3 AS n FROM players"),
    "fun27_squad_entries": (lambda a: pg.squad(made.squad_pages(a.lineups())), "SELECT match_id AS page_id, CASE WHEN line = 1 THEN 'TOR' WHEN line <= 3 THEN 'ABWEHR' WHEN line <= 5 THEN 'MITTELFELD' ELSE 'ANGRIFF' END AS position_group, shirt_number, 'P' || player_id AS name FROM lineups"),
    "fun44_apply_substitutions": (lambda a: pg.applied(a.lineups(), a.substitutions()), "x AS (SELECT match_id, player_id, bool_or(s) AS s, arg_max(o, k * 1000 + o) FILTER (o IS NOT NULL) AS o, arg_max(w, k * 1000 + w) FILTER (w IS NOT NULL) AS w FROM (SELECT match_id, player_id, is_starter AS s, NULL::INT AS o, NULL::INT AS w, 0 AS k FROM lineups UNION ALL SELECT match_id, player_on_id, NULL, minute, NULL, substitution_id FROM substitutions UNION ALL SELECT match_id, player_off_id, NULL, NULL, minute, substitution_id FROM substitutions) GROUP BY 1, 2)\n--\nSELECT match_id, player_id, CASE WHEN o IS NOT NULL THEN false ELSE coalesce(s, true) END AS is_starter, o AS minute_on, w AS minute_off FROM x"),
    "fun45_collect_cards": (lambda a: pg.collected_cards(*made.card_cells(a.cards())).groupBy("match_id", "player_id", "minute", "card_type").agg(F.count("*").alias("n")), "SELECT match_id, player_id, minute, card_type, CASE card_type WHEN 'yellow' THEN count(*) ELSE 1 END AS n FROM cards GROUP BY 1, 2, 3, 4"),
}
