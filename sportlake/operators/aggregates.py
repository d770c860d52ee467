"""Season, competition, player and event aggregates.

Facts are aggregated on their own keys before they meet, so joins never multiply rows and sums stay right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sportlake.functions.numbers import ratio
from sportlake.operators.perspective import result_wdl


def wdl(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("result") == r).alias(prefix + n) for r, n in (("W", "wins"), ("D", "draws"), ("L", "losses"))]


def record(rows: DataFrame, *keys: str) -> DataFrame:
    """matches, wins, draws, losses, goals and win % by the keys; rows come from result_wdl."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("matches"), *wdl(), F.sum("own_score").alias("goals_for"), F.sum("opponent_score").alias("goals_against"))
    return out.withColumns({"goal_difference": F.col("goals_for") - F.col("goals_against"), "win_pct": ratio("wins", "matches", 1, 100)})


def season_performance(m: DataFrame, focal: int = 1) -> DataFrame:
    return record(result_wdl(m, focal), "season_id", "competition_id")


def competition_statistics(m: DataFrame, focal: int = 1) -> DataFrame:
    rows = result_wdl(m, focal)
    span = rows.groupBy("competition_id").agg(F.countDistinct("season_id").alias("seasons"), F.min("season_id").alias("first_season"), F.max("season_id").alias("last_season"))
    return record(rows, "competition_id").join(span, "competition_id")


#: What counts: the name of each number, and the kinds of event that it counts.
COUNTED = {
    "goals": ["goal", "penalty"], "penalties": ["penalty"], "own_goals": ["own_goal"], "assists": ["assist"], "own_goal_assists": ["own_goal_assist"],
    "yellow": ["yellow"], "second_yellow": ["second_yellow"], "red": ["red"],
}


def goal_kind(event_type: Column) -> Column:
    return F.when(event_type.isin("own_goal", "penalty"), event_type).otherwise("goal")


def assist_kind(event_type: Column) -> Column:
    return F.when(event_type == "own_goal", "own_goal_assist").otherwise("assist")


def player_events(lineups: DataFrame, goals: DataFrame, cards: DataFrame) -> DataFrame:
    """match_id, player_id, part (2 for a start, 1 for another place in the line-up, else 0), kind (NULL or an event) from three tables of facts.

    A row may hold a part and an event of a player. Where one table has all the facts, its adapter gives these rows from one reading.
    """
    of = lambda df, player, part, kind: df.select("match_id", F.col(player).alias("player_id"), part.alias("part"), kind.alias("kind"))
    none, event = F.lit(0), F.col("event_type")
    parts = [of(lineups, "player_id", F.when(F.col("is_starter"), 2).otherwise(1), F.lit(None).cast("string")), of(goals, "player_id", none, goal_kind(event))]
    parts += [of(goals.filter("assist_player_id IS NOT NULL"), "assist_player_id", none, assist_kind(event)), of(cards, "player_id", none, F.col("card_type"))]
    return reduce(DataFrame.unionByName, parts)


def _by_match(events: DataFrame, *keys: str) -> DataFrame:
    """One row for each player and match: the part played, and the numbers of events. Repeats of a line-up count once."""
    return events.groupBy("match_id", "player_id", *keys).agg(F.max("part").alias("part"), *[F.count_if(F.col("kind").isin(kinds)).alias(name) for name, kinds in COUNTED.items()])


def _parts() -> list[Column]:
    return [F.count_if(F.col("part") > 0).alias("appearances"), F.count_if(F.col("part") == 2).alias("starts")]


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Numbers by the keys, where there was a line-up."""
    seen = F.when(F.col("part") > 0, F.col("match_id"))
    out = rows.groupBy(*keys).agg(*_parts(), *[F.sum(c).alias(c) for c in COUNTED], F.min(seen).alias("first_match"), F.max(seen).alias("last_match"))
    return out.filter("appearances > 0")


def per_player(events: DataFrame) -> DataFrame:
    """One row per player with line-ups: appearances, starts, goals by kind (own goals apart), assists (those of own goals apart), cards by kind, first and last match.

    One reading and one shuffle of the events, by player and match, so that the events of one player are spread; the second step adds up sums.
    """
    return _summed(_by_match(events), "player_id")


def player_career_stats(players: DataFrame, events: DataFrame) -> DataFrame:
    out = per_player(events).withColumns({"sub_appearances": F.col("appearances") - F.col("starts"), "goals_per_match": ratio("goals", "appearances", 2)})
    return players.select("player_id", "name").join(out, "player_id").drop("first_match", "last_match", "own_goals", "own_goal_assists")


def top_scorers(players: DataFrame, events: DataFrame, least: int = 1) -> DataFrame:
    out = per_player(events).filter(F.col("goals") >= least)
    return players.select("player_id", "name").join(out, "player_id").select("player_id", "name", "goals", "penalties", (F.col("goals") - F.col("penalties")).alias("regular_goals"), "appearances", ratio("goals", "appearances", 2).alias("goals_per_match"))


def _with_season(m: DataFrame, events: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Events with columns of their match, a row for each player and match: the join leaves them by match, so that grouping needs no shuffle after a shuffled one."""
    return _by_match(events.join(m.select("match_id", *keys), "match_id", how), *keys)


def player_season_stats(m: DataFrame, events: DataFrame) -> DataFrame:
    """Per player, season and competition; assists of own goals count here."""
    keys = ["player_id", "season_id", "competition_id"]
    out = _summed(_with_season(m, events, "season_id", "competition_id"), *keys)
    return out.select(*keys, "appearances", "starts", "goals", (F.col("assists") + F.col("own_goal_assists")).alias("assists"), "yellow", "red")


def career_highlights(players: DataFrame, m: DataFrame, events: DataFrame) -> DataFrame:
    """Appearances and goals of each player with line-ups, and the season with most goals (own goals count, the earliest of equals)."""
    rows = _with_season(m, events, "season_id", how="left").withColumn("_all", F.col("goals") + F.col("own_goals"))
    seasons = rows.groupBy("player_id", "season_id").agg(_parts()[0], F.sum("goals").alias("goals"), F.sum("_all").alias("_all"))
    best = F.max(F.when(F.col("season_id").isNotNull() & (F.col("_all") > 0), F.struct("_all", (-F.col("season_id")).alias("_back"))))
    out = seasons.groupBy("player_id").agg(F.sum("appearances").alias("appearances"), F.sum("goals").alias("goals"), best.alias("x")).filter("appearances > 0")
    return players.select("player_id", "name").join(out, "player_id").select("player_id", "name", "appearances", "goals", (-F.col("x._back")).alias("best_season"), F.col("x._all").alias("best_goals"))


def game_leaderboard(answers: DataFrame, rounds: DataFrame, game_id: int | None = None) -> DataFrame:
    """Correct answers, points and average time of correct answers per player, over one game or all."""
    rounds = rounds if game_id is None else rounds.filter(F.col("game_id") == game_id)
    rows = answers.join(rounds, "round_id")
    out = rows.groupBy("player").agg(F.countDistinct("game_id").alias("games"), F.count("*").alias("questions"), F.count_if("is_correct").alias("correct"), F.sum("points").alias("points"), F.sum(F.when(F.col("is_correct"), F.col("time_ms")).otherwise(0)).alias("_t"))
    return out.withColumns({"accuracy": ratio("correct", "questions", 2, 100), "avg_time_ms": ratio("_t", "correct", 2)}).drop("_t")


def head_to_head(m: DataFrame, teams: DataFrame, focal: int = 1, least: int = 1) -> DataFrame:
    rows = record(result_wdl(m, focal), "opponent_id").filter(F.col("matches") >= least)
    return rows.join(teams.select(F.col("team_id").alias("opponent_id"), F.col("name").alias("opponent")), "opponent_id")


def season_table(m: DataFrame, focal: int = 1, *keys: str) -> DataFrame:
    """Played matches only: record, points and points per game."""
    rows = result_wdl(m, focal).filter("result IS NOT NULL")
    out = record(rows, *(keys or ("season_id",)))
    return out.withColumn("points", F.col("wins") * 3 + F.col("draws")).withColumn("points_per_game", ratio("points", "matches", 2))


def season_summary(m: DataFrame, lineups: DataFrame, goals: DataFrame) -> DataFrame:
    """Season totals with players used and scorers, each counted on its own."""
    of = m.select("match_id", "season_id")
    out = m.groupBy("season_id").agg(F.count("*").alias("matches"), F.sum(F.col("home_score") + F.col("away_score")).alias("score_goals"))
    used = lineups.join(of, "match_id").groupBy("season_id").agg(F.countDistinct("player_id").alias("players"))
    scorers = goals.join(of, "match_id").groupBy("season_id").agg(F.countDistinct("player_id").alias("scorers"), F.count("*").alias("goals"))
    return out.join(used, "season_id", "left").join(scorers, "season_id", "left").na.fill(0, ["players", "scorers", "goals"])


def scorer_span(m: DataFrame, goals: DataFrame) -> DataFrame:
    rows = goals.join(m.select("match_id", "season_id"), "match_id")
    return rows.groupBy("player_id").agg(F.count("*").alias("goals"), F.min("season_id").alias("first_season"), F.max("season_id").alias("last_season"), F.countDistinct("season_id").alias("seasons"))


def card_counts(cards: DataFrame) -> DataFrame:
    """Distinct cards (match, minute with NULL as 0, kind) of each kind per player."""
    kinds = ("yellow", "second_yellow", "red")
    event = F.struct("match_id", F.coalesce("minute", F.lit(0)))
    return cards.groupBy("player_id").agg(*[F.countDistinct(F.when(F.col("card_type") == k, event)).alias(k) for k in kinds])


def season_regulars(m: DataFrame, lineups: DataFrame, least: int) -> DataFrame:
    return lineups.join(m.select("match_id", "season_id"), "match_id").groupBy("season_id", "player_id").agg(F.count("*").alias("appearances")).filter(F.col("appearances") > least)


def nested_events(m: DataFrame, goals: DataFrame, cards: DataFrame) -> DataFrame:
    """Arrays of scorer and card objects per match, in order of minute; NULL when none."""
    minute = F.coalesce("minute", F.lit(-1))
    scorers = goals.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(minute.alias("minute"), "player_id", F.coalesce("event_type", F.lit("goal")).alias("kind")))).alias("scorers"))
    shown = cards.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(minute.alias("minute"), "player_id", F.col("card_type").alias("kind")))).alias("cards"))
    return m.join(scorers, "match_id", "left").join(shown, "match_id", "left")


def as_text(column: str) -> Column:
    """minute/player/kind of each object, joined by a semicolon."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws("/", x.minute, x.player_id, x.kind)), ";")


def match_report(m: DataFrame, goals: DataFrame, lineups: DataFrame) -> DataFrame:
    """Three JSON documents per match: info, goals in order, line-up."""
    part = lambda df, order, name: df.groupBy("match_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*order)))).alias(name))
    info = m.select("match_id", F.to_json(F.struct("match_date", "home_team_id", "away_team_id", "home_score", "away_score")).alias("info"))
    return info.join(part(goals, ["minute", "stoppage", "player_id"], "goals"), "match_id", "left").join(part(lineups, ["at_home", "is_starter", "player_id"], "lineup"), "match_id", "left")


def career_text(stations: DataFrame, key: str) -> DataFrame:
    """Stations of each person as one ordered text; a station with a NULL part is left out."""
    line = F.concat(F.lpad(F.col("start_year").cast("string"), 4, "0"), F.lit(" "), "team_name")
    return stations.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("career"))


def distinct_text(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Count of rows and the distinct values as one ordered text."""
    return rows.groupBy(*keys).agg(F.count("*").alias("matches"), F.array_join(F.array_sort(F.collect_set(value)), ", ").alias(name))


def rounds_per_competition(m: DataFrame) -> DataFrame:
    out = distinct_text(m, ["season_id", "competition_id"], "round_name", "round_names")
    dates = m.groupBy("season_id", "competition_id").agg(F.countDistinct("match_date").alias("dates"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
    return out.join(dates, ["season_id", "competition_id"])


def duplicate_groups(m: DataFrame) -> DataFrame:
    """Matches on one date with the same unordered sides and score; ids from the preferred source first."""
    pair = lambda a, b: (F.least(a, b), F.greatest(a, b))
    (t1, t2), (s1, s2) = pair("home_team_id", "away_team_id"), pair("home_score", "away_score")
    prefer = F.struct((F.col("source_file") != "liga").cast("int").alias("p"), "match_id")
    out = m.groupBy("match_date", t1.alias("team_a"), t2.alias("team_b"), s1.alias("score_a"), s2.alias("score_b")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(prefer)).alias("x"))
    return out.filter("n > 1").withColumn("match_ids", F.array_join(F.transform("x", lambda x: x.match_id.cast("string")), ",")).drop("x")


def duplicate_groups_by_opponent(m: DataFrame, lineups: DataFrame, focal: int = 1) -> DataFrame:
    """Focal matches of one season with the same opponent and score: ids with their line-up counts."""
    n = lineups.groupBy("match_id").agg(F.count("*").alias("n_lineups"))
    rows = result_wdl(m, focal).join(n, "match_id", "left").na.fill(0, ["n_lineups"])
    out = rows.groupBy("season_id", "opponent_id", "own_score", "opponent_score").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("match_id", "n_lineups"))).alias("x")).filter("n > 1")
    return out.withColumn("ids", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x.match_id, x.n_lineups)), ",")).drop("x")


def name_variants(p: DataFrame) -> DataFrame:
    return p.groupBy("normalized_name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names")).filter("n > 1")


def spellings(p: DataFrame) -> DataFrame:
    """A row for each spelling of a name that has several: normalized_name, name, n (rows with it), variants (spellings of the name).

    Unlike name_variants, no cell holds a group: equal names are counted first, and the count of spellings is joined.
    """
    each = p.filter("normalized_name IS NOT NULL AND name IS NOT NULL").groupBy("normalized_name", "name").agg(F.count("*").alias("n"))
    several = each.groupBy("normalized_name").agg(F.count("*").alias("variants")).filter("variants > 1")
    return each.join(several, "normalized_name")


def duplicate_counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows less distinct keys (NULL is a value) per table."""
    out = None
    for name, (df, keys) in tables.items():
        part = df.groupBy(*keys).count().agg(F.lit(name).alias("table_name"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
        out = part if out is None else out.unionByName(part)
    return out


def player_match_goals(goals: DataFrame, least: int = 4) -> DataFrame:
    return goals.groupBy("match_id", "player_id").agg(F.count("*").alias("goals")).filter(F.col("goals") >= least)


def top_goals_per_match(goals: DataFrame) -> DataFrame:
    out = goals.groupBy("player_id").agg(F.count("*").alias("goals"), F.countDistinct("match_id").alias("matches"))
    return out.withColumn("goals_per_match", ratio("goals", "matches", 2))


def volume_summary(m: DataFrame, goals: DataFrame) -> DataFrame:
    a = m.agg(F.count("*").alias("matches"), F.countDistinct("season_id").alias("seasons"))
    b = goals.agg(F.count("*").alias("goals"))
    return a.crossJoin(b).withColumns({"matches_per_season": ratio("matches", "seasons", 1), "goals_per_match": ratio("goals", "matches", 2)})


def breakdown(m: DataFrame, goals: DataFrame, key: str) -> DataFrame:
    """Seasons, matches and goals per value of a match column."""
    a = m.groupBy(key).agg(F.countDistinct("season_id").alias("seasons"), F.count("*").alias("matches"))
    b = goals.join(m.select("match_id", key), "match_id").groupBy(key).agg(F.count("*").alias("goals"))
    return a.join(b, key, "left").na.fill(0, ["goals"])


def season_coverage(seasons: DataFrame, m: DataFrame) -> DataFrame:
    n = m.groupBy("season_id").agg(F.count("*").alias("matches"), F.countDistinct("competition_id").alias("competitions"))
    return seasons.select("season_id", "label").join(n, "season_id", "left").na.fill(0, ["matches", "competitions"])


def team_overview(teams: DataFrame, m: DataFrame) -> DataFrame:
    sides = m.select(F.col("home_team_id").alias("team_id"), F.lit(1).alias("home"), "match_date", "competition_id").unionByName(m.select(F.col("away_team_id").alias("team_id"), F.lit(0).alias("home"), "match_date", "competition_id"))
    out = sides.groupBy("team_id").agg(F.count_if(F.col("home") == 1).alias("home_matches"), F.count_if(F.col("home") == 0).alias("away_matches"), F.count("*").alias("matches"), F.count_if(F.col("competition_id") <= 3).alias("league_matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
    return teams.select("team_id", "name").join(out, "team_id")


def fill_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled values and percent of rows per column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns]))
    return one.select("_n", pairs.alias("x")).select("x.column_name", "x.filled", ratio("x.filled", "_n", 1, 100).alias("percent"))


def question_stats(answers: DataFrame, rounds: DataFrame, key: str = "question_id") -> DataFrame:
    out = answers.join(rounds, "round_id").groupBy(key).agg(F.count("*").alias("used"), F.count_if("is_correct").alias("correct"), F.sum("time_ms").alias("_t"))
    return out.withColumn("avg_time_ms", ratio("_t", "used", 2)).drop("_t")


def player_quiz_stats(answers: DataFrame) -> DataFrame:
    out = answers.groupBy("player").agg(F.count("*").alias("questions"), F.count_if("is_correct").alias("correct"), F.sum("time_ms").alias("_t"))
    return out.withColumn("avg_time_ms", ratio("_t", "questions", 2)).drop("_t")


def generation_progress(jobs: DataFrame) -> DataFrame:
    """Per game: completed jobs, whether one failed, state, first open round. jobs: game_id, round_id, status."""
    out = jobs.groupBy("game_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.max((F.col("status") == "failed").cast("int")).alias("failed"), F.min(F.when(F.col("status") != "completed", F.col("round_id"))).alias("first_open"))
    return out.withColumn("state", F.when(F.col("failed") == 1, "failed").when(F.col("completed") == F.col("jobs"), "completed").otherwise("running"))


def win_record(m: DataFrame, lineups: DataFrame, players: DataFrame, name: str, focal: int = 1) -> DataFrame:
    """Focal matches that players with the text in their name were in, and wins among them."""
    who = players.filter(F.lower("name").contains(name.lower())).select("player_id", "name")
    rows = result_wdl(m, focal).join(lineups.select("match_id", "player_id").distinct(), "match_id").join(who, "player_id")
    return rows.groupBy("player_id", "name").agg(F.count("*").alias("matches"), F.count_if(F.col("result") == "W").alias("wins"))


def sync_verification(m: DataFrame, **facts: DataFrame) -> DataFrame:
    """Rows of each fact that belong to the given matches."""
    out = m.agg(F.countDistinct("match_id").alias("matches"))
    for name, rows in facts.items():
        out = out.crossJoin(rows.join(m.select("match_id").distinct(), "match_id", "left_semi").agg(F.count("*").alias(name)))
    return out
