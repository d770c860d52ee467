"""Pages made from the given tables, which hold no archive pages: what the page queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sportlake.sources.pages import POSITIONS


def write_season_files(pages: DataFrame, path: str) -> None:
    """Pages (season, name, html) as one HTML file each under the folder of their season, on the file system of path. Names are unique in a season."""

    def write(rows):  # noqa: ANN001, ANN202
        import pyarrow.fs

        from pyspark import TaskContext

        files, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        number = TaskContext.get().attemptNumber()
        for batch in rows:
            for season, name, html in zip(*(batch.column(c).to_pylist() for c in ("season", "name", "html")), strict=True):
                files.create_dir(f"{root}/{season}", recursive=True)
                part = f"{root}/{season}/.{name}.{number}"  # a repeated task replaces the file as a whole
                with files.open_output_stream(part) as out:
                    out.write((html or "").encode())
                files.move(part, f"{root}/{season}/{name}.html")
            yield batch.slice(0, 0).select(["name"])

    pages.select("season", "name", "html").mapInArrow(write, "name string").count()


def framed(pages: DataFrame) -> DataFrame:
    """Each page, and a frameset in front of it."""
    frames = pages.select(F.concat(F.lit("frame/"), "url").alias("url"), F.concat(F.lit('<frameset><frame name="top" src="top"><frame name="main" src="'), "url", F.lit('"></frameset>')).alias("html"))
    return pages.select("url", "html").unionByName(frames)


def overview_pages(m: DataFrame, teams: DataFrame, focal: int, matches: int = 100) -> DataFrame:
    """Overviews of the focal team's matches made from the match table, a league and a cup page in turn for so many ids; one row is a headline."""
    played = m.filter((F.col("home_team_id") == focal) != (F.col("away_team_id") == focal))
    other = F.when(F.col("home_team_id") == focal, F.col("away_team_id")).otherwise(F.col("home_team_id"))
    rows = played.withColumn("team_id", other).join(teams.select("team_id", F.col("name").alias("opponent")), "team_id")
    score = F.coalesce(F.concat("home_score", F.lit(":"), "away_score"), F.lit("-:-"))
    line = F.concat(F.lit("<tr><td>"), F.date_format("match_date", "d.M.yyyy"), F.lit('</td><td><a href="gegner'), "team_id", F.lit('.html">'), "opponent", F.lit("</a></td><td>("), "round_name", F.lit(')</td><td><a href="profiliga'), "match_id", F.lit('.html"><b>'), score, F.lit("</b></a></td></tr>"))
    number = F.floor(F.col("match_id") / matches)
    lines = rows.groupBy(number.alias("k")).agg(F.array_sort(F.collect_list(F.struct("match_id", line.alias("line")))).alias("x"))
    return lines.select(F.concat(F.when(F.col("k") % 2 == 0, "liga").otherwise("pokal"), "k", F.lit(".html")).alias("url"), F.concat(F.lit("<table><tr><td>Alle Spiele</td></tr>"), F.concat_ws("", "x.line"), F.lit("</table>")).alias("html"))


def fixture_pages(m: DataFrame, teams: DataFrame) -> DataFrame:
    """Matchday pages made from matches: one table row per match."""
    name = lambda side: teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(side))
    rows = m.filter("home_score IS NOT NULL").join(name("home"), "home_team_id").join(name("away"), "away_team_id")
    line = F.concat(F.lit("<tr><td>"), "home", F.lit("</td><td>"), "away", F.lit("</td><td>"), "home_score", F.when(F.col("match_id") % 2 == 0, ":").otherwise("-"), "away_score", F.lit("</td></tr>"))
    return rows.groupBy("season_competition_id", "matchday").agg(F.concat_ws("", F.collect_list(line)).alias("html"))


def match_pages(m: DataFrame, goals: DataFrame) -> DataFrame:
    """Detail pages made from goals: a table of goal texts per match."""
    line = F.concat(F.lit("<tr><td>"), "minute", F.coalesce(F.concat(F.lit("+"), "stoppage"), F.lit("")), F.lit(". "), "score_home", F.lit(":"), "score_away", F.lit(" P"), "player_id", F.lit(" ("), F.coalesce(F.col("assist_player_id").cast("string"), F.lit("-")), F.lit(")</td></tr>"))
    return goals.groupBy("match_id").agg(F.concat(F.lit("<b>Tore</b>"), F.concat_ws("", F.collect_list(line))).alias("html")).join(m.select("match_id"), "match_id")


def profile_pages(players: DataFrame) -> DataFrame:
    """Profile pages made from the players; some lack the place, some the height."""
    place = F.when(F.col("player_id") % 3 == 0, "").otherwise(" in Mainz")
    height = F.when(F.col("player_id") % 5 == 0, "").otherwise(F.concat(F.lit(", "), "height_cm", F.lit(" cm")))
    page = F.concat(F.lit("P * 01.01."), F.col("player_id") % 50 + 1950, place, height, F.lit(", "), F.col("player_id") % 30 + 60, F.lit(" kg Position: "), "primary_position", F.lit(" Nationalität: "), "nationality")
    return players.select("player_id", page.alias("html"))


def fact_pages(players: DataFrame) -> DataFrame:
    """Pages with a table of facts, made from the players; one of its rows has a single cell."""
    row = lambda name, value: F.concat(F.lit(f"<tr><td>{name}</td><td>"), value, F.lit("</td></tr>"))
    page = F.concat(F.lit("<table><tr><td>Steckbrief</td></tr>"), row("Position", F.col("primary_position")), row("Land", F.col("nationality")), row("Größe", F.col("height_cm")), F.lit("</table>"))
    return players.select(F.col("player_id").alias("page_id"), page.alias("html"))


def squad_pages(lineups: DataFrame) -> DataFrame:
    """Squad pages made from line-ups, a page for each match: players by line under their header, then the coach."""
    bounds = dict(zip(POSITIONS, ((1, 1), (2, 3), (4, 5), (6, 99)), strict=True))
    entry = lambda x: F.concat(x["shirt_number"], F.lit(" P"), x["player_id"])
    part = lambda head, low, high: F.concat(F.array(F.lit(head)), F.transform(F.filter("e", lambda x: x["line"].between(low, high)), entry))
    pages = lineups.groupBy(F.col("match_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("line", "shirt_number", "player_id"))).alias("e"))
    return pages.select("page_id", F.concat_ws("\n", *[part(h, *b) for h, b in bounds.items()], F.array(F.lit("TRAINER"), F.lit("1 Coach"))).alias("html"))


def card_cells(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line-up cells and substitution entries made from cards: icons without a minute stand in the first, the others in the second."""
    icon = F.concat(F.lit('<img src="../'), F.when(F.col("card_type") == "yellow", "gelbekarte").when(F.col("card_type") == "red", "rotekarte").otherwise("gelbrot"), F.lit('.bmp">'))
    cells = cards.groupBy("match_id", "player_id", "minute").agg(F.concat(F.lit("P "), F.concat_ws("", F.collect_list(icon))).alias("cell"))
    return cells.filter("minute IS NULL").drop("minute"), cells.filter("minute IS NOT NULL")


def header_pages(m: DataFrame, teams: DataFrame) -> DataFrame:
    """Detail pages made from matches; those without scores have a broken header."""
    name = lambda side: teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(side))
    rows = m.join(name("home"), "home_team_id").join(name("away"), "away_team_id")
    line = F.concat("home", F.lit(" - "), "away", F.lit(" "), "home_score", F.lit(":"), "away_score", F.lit(" ("), "halftime_home", F.lit(":"), "halftime_away", F.lit(")"))
    return rows.select("match_id", F.concat(F.lit("<html><b>"), F.coalesce(line, F.lit("?")), F.lit("</b></html>")).alias("html"))


#: Attributes of team blocks, by layout; the last but one has none, and the last stands in a table that holds the page.
BLOCKS = ('width="100%" height="30%"', "height='28%' width='100%'", "width=100% height=27%", "", 'width="100%" height="30%"')


def nested_pages(m: DataFrame, teams: DataFrame, lineups: DataFrame, substitutions: DataFrame, goals: DataFrame, cards: DataFrame) -> DataFrame:
    """page_id, html: match pages in five layouts, each team block holding a table of starters and substitutions and one of the reserve, with card icons, staff and goals."""
    icon = lambda kind: F.concat(F.lit(" <img src='../"), F.when(kind == "yellow", "gelbekarte").when(kind == "red", "rotekarte").otherwise("gelbrot"), F.lit(".bmp'>"))
    shown = cards.filter("minute IS NULL").groupBy("match_id", "player_id").agg(F.concat_ws("", F.array_sort(F.collect_list(icon(F.col("card_type"))))).alias("icons"))
    cell = F.concat(F.lit("<tr><td>"), "shirt_number", F.lit(' <a href="../spieler/p'), "player_id", F.lit('.html">P'), "player_id", F.lit("</a>"), F.coalesce("icons", F.lit("")), F.lit("</td></tr>"))
    entry = F.concat(F.lit("<tr><td>"), "minute", F.lit(". P"), "player_on_id", F.lit(" für P"), "player_off_id", F.when(F.col("substitution_id") % 3 == 0, icon(F.lit("yellow"))).otherwise(""), F.lit("</td></tr>"))
    lines = lineups.join(shown, ["match_id", "player_id"], "left").select("match_id", "at_home", F.when(F.col("is_starter"), 0).otherwise(2).alias("kind"), F.col("line").cast("long").alias("k"), cell.alias("cell"))
    lines = lines.unionByName(substitutions.select("match_id", (F.col("substitution_id") % 2 == 1).alias("at_home"), F.lit(1).alias("kind"), F.col("substitution_id").alias("k"), entry.alias("cell")))
    goal = F.concat(F.lit("<tr><td>"), "minute", F.coalesce(F.concat(F.lit("+"), "stoppage"), F.lit("")), F.lit(". "), "score_home", F.lit(":"), "score_away", F.lit(" P"), "player_id", F.lit(" ("), F.coalesce(F.concat(F.lit("P"), "assist_player_id"), F.lit("-")), F.lit(")</td></tr>"))
    lines = lines.unionByName(goals.select("match_id", F.lit(True).alias("at_home"), F.lit(3).alias("kind"), F.col("goal_id").alias("k"), goal.alias("cell")))
    rows = lines.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("kind", "k", "at_home", "cell"))).alias("x"))
    part = lambda test: F.concat_ws("", F.transform(F.filter("x", test), lambda x: x["cell"]))
    layout = F.col("match_id") % len(BLOCKS)
    tag = F.element_at(F.array(*map(F.lit, BLOCKS)), layout.cast("int") + 1)
    team = lambda home: F.concat(F.lit("<table "), tag, F.lit("><tr><td><table>"), part(lambda x: (x["kind"] < 2) & (x["at_home"] == F.lit(home))), F.lit("</table><table><tr><td>Reserve:</td></tr>"), part(lambda x: (x["kind"] == 2) & (x["at_home"] == F.lit(home))), F.lit("</table></td></tr></table>"))
    name = lambda side: teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(side))
    played = m.join(name("home"), "home_team_id").join(name("away"), "away_team_id").join(rows, "match_id")
    score = F.concat("home", F.lit(" - "), "away", F.lit(" "), "home_score", F.lit(":"), "away_score", F.lit(" ("), "halftime_home", F.lit(":"), "halftime_away", F.lit(")"))
    head = F.concat(F.lit("<html><b>"), F.coalesce(score, F.lit("abgesagt")), F.lit("</b><p>Sa, "), F.date_format("match_date", "d.M.yyyy"), F.lit(", 15.30 Uhr, "), "attendance", F.lit(" Zuschauer</p>"))
    staff = F.concat(F.lit("<table><tr><td><b>Schiedsrichter:</b> "), F.coalesce(F.concat(F.lit('<a href="../sr/'), "referee_id", F.lit('.html">R'), "referee_id", F.lit("</a>")), F.lit("")), F.lit('</td><td>FSV-Trainer: <a href="../trainer/t1.html">C1</a></td><td>Trainer: C'), "away_team_id", F.lit("</td></tr></table>"))
    scorers = F.concat(F.lit("<table><tr><td><b>Tore</b></td></tr></table><table>"), part(lambda x: x["kind"] == 3), F.lit("</table>"))
    around = lambda text: F.when(layout == len(BLOCKS) - 1, text).otherwise("")
    return played.select(F.col("match_id").alias("page_id"), F.concat(head, around("<table><tr><td>"), team(True), staff, team(False), around("</td></tr></table>"), scorers).alias("html"))
