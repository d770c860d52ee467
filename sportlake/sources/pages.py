"""Pages of a match archive as tables: frames, links, blocks, fixtures, goals, profiles and squads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.functions import text as tx
from sportlake.sources.io import written


def scan_pages(spark: SparkSession, path: str, seasons: list[str] | None = None) -> DataFrame:
    """HTML files under season folders (YYYY-YY): url, season, html read as latin-1. Only the folders of the seasons asked for are listed and read."""
    folders = f"{{{','.join(seasons)}}}" if seasons else "[0-9][0-9][0-9][0-9]-[0-9][0-9]"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").load(f"{path}/{folders}")
    return files.select(F.col("path").alias("url"), tx.some(F.col("path"), r"/(\d{4}-\d{2})/").alias("season"), F.decode("content", "ISO-8859-1").alias("html"))


#: Names of the frame that holds the content, and of pages that are linked from overviews (fixed values).
FRAMES = ("tabelle", "table", "main", "inhalt", "content")
MATCH_LINK, OPPONENT_LINK = r"profi[a-z]*\d+\.html", "gegner"


def beside(base: Column, href: Column) -> Column:
    """The path that a relative href names beside the page at base; a leading slash starts at the root, and a whole address stands as it is."""
    folder = F.regexp_replace(base, r"[^/]*\z", "")
    steps = F.filter(F.split(F.when(href.startswith("/"), href).otherwise(F.concat(folder, href)), "/"), lambda x: (x != "") & (x != "."))
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.when(href.rlike(r"^[A-Za-z]+://"), href).otherwise(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))


def resolve_frames(pages: DataFrame, preferred: tuple[str, ...] = FRAMES, most: int = 32) -> DataFrame:
    """url, content_url: framesets followed to the content frame - the first with a preferred name, else the first whose source has a digit, else the first.

    Sources are relative to the page that names them. Where a frame's page is missing, or has been passed already, the last page counts.
    Framesets inside one another are followed until none is left; more than `most` levels are an error.
    """
    frames = pages.filter(F.lower("html").contains("<frameset")).select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)(<frame\s[^>]*>)"), F.lit(1))).alias("at", "tag"))
    name, src = F.lower(F.regexp_extract("tag", r"(?i)name=[\"']?([^\"'\s>]*)", 1)), F.regexp_extract("tag", r"(?i)src=[\"']?([^\"'\s>]*)", 1)
    rank = F.when(name.isin(*preferred), 0).when(src.rlike(r"\d"), 1).otherwise(2)
    best = frames.filter(src != "").select("url", beside(F.col("url"), src).alias("to"), F.row_number().over(Window.partitionBy("url").orderBy(rank, "at")).alias("_r")).filter("_r = 1").drop("_r")
    step = written(best.join(pages.select(F.col("url").alias("to")).distinct(), "to", "left_semi").select(F.col("url").alias("content_url"), "to"))
    out = written(pages.select("url", F.col("url").alias("content_url"), F.array("url").alias("passed")))
    for _ in range(most):
        on = F.col("to").isNotNull() & ~F.array_contains("passed", F.col("to"))
        moved = out.join(step, "content_url", "left").select("url", F.when(on, F.col("to")).otherwise(F.col("content_url")).alias("content_url"), F.when(on, F.concat("passed", F.array("to"))).otherwise(F.col("passed")).alias("passed"), on.alias("moved"))
        out = written(moved)
        if out.filter("moved").isEmpty():
            return out.select("url", "content_url")
        out = out.drop("moved")
    raise RuntimeError(f"framesets lie more than {most} levels deep")


def explode_blocks(pages: DataFrame, mark: str, first_only: bool = False) -> DataFrame:
    """The parts of a page that each begin at the mark, numbered."""
    parts = F.split("html", f"\\Q{mark}\\E")
    out = pages.select("page_id", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("block", "html"))
    return out.filter("block = 0") if first_only else out


def links(pages: DataFrame) -> DataFrame:
    """Targets of a page's links in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("position", "href"))


#: The target of a link, in quotes of either kind or in none.
HREF = r"(?i)href=[\"']?([^\"'\s>]*)"


def plain(html: Column) -> Column:
    """Text without tags, white space made even."""
    return tx.normalize_whitespace(F.regexp_replace(html, "<[^>]*>", " "))


def parts(html: Column, tag: str) -> Column:
    """Contents of all elements of a tag, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def overview_rows(pages: DataFrame) -> DataFrame:
    """Matches of overview pages (url, html): link to the match page, opponent, score, stage, and on league pages the running matchday.

    A row of four cells or more with a link to a match page and one to an opponent counts; anything else, null pages too, gives no row.
    """
    link = lambda part: rf"(?is)<a\s[^>]*href=[\"']?([^\"'\s>]*{part}[^\"'\s>]*)[^>]*>(.*?)</a>"
    match, opponent = link(MATCH_LINK), link(OPPONENT_LINK)
    rows = pages.select("url", F.posexplode(parts(F.col("html"), "tr")).alias("at", "row")).withColumn("cells", F.transform(parts(F.col("row"), "td"), plain))
    rows = rows.filter((F.size("cells") >= 4) & F.col("row").rlike(match) & F.col("row").rlike(opponent))
    stage = F.regexp_replace(F.get(F.filter("cells", lambda x: x.rlike(r"^\(.*\)$")), F.lit(0)), r"^\(+|\)+$", "")
    day = F.row_number().over(Window.partitionBy("url").orderBy("at"))
    league = F.lower(F.regexp_extract("url", r"([^/]*)\z", 1)).contains("liga")
    return rows.select("url", tx.some(F.col("row"), match).alias("detail_file"), plain(F.regexp_extract("row", opponent, 2)).alias("opponent"), plain(F.regexp_extract("row", match, 2)).alias("score"), stage.alias("stage"), F.when(league, day).alias("matchday"))


def fixtures(pages: DataFrame, focal: str) -> DataFrame:
    """Rows of matchday tables where exactly one side is the focal team, seen from its side; scores are a:b or a-b."""
    row = F.explode(F.regexp_extract_all("html", F.lit(r"<tr>(.*?)</tr>"), F.lit(1))).alias("row")
    cell = lambda k: F.element_at(F.regexp_extract_all("row", F.lit(r"<td>(.*?)</td>"), F.lit(1)), k)
    rows = pages.select("season_competition_id", "matchday", row).select("season_competition_id", "matchday", cell(1).alias("home"), cell(2).alias("away"), F.split(cell(3), "[:-]").alias("s"))
    at_home, at_away = F.col("home") == focal, F.col("away") == focal
    a, b = F.col("s")[0].cast("int"), F.col("s")[1].cast("int")
    return rows.filter(at_home != at_away).select("season_competition_id", "matchday", F.when(at_home, F.col("away")).otherwise(F.col("home")).alias("opponent"), F.when(at_home, a).otherwise(b).alias("own_score"), F.when(at_home, b).otherwise(a).alias("opponent_score"))


def extract_goals(pages: DataFrame) -> DataFrame:
    """Goals of detail pages; a text that is no goal gives a row with NULLs."""
    line = F.explode(F.regexp_extract_all("html", F.lit(r"<td>(.*?)</td>"), F.lit(1))).alias("line")
    return pages.select("match_id", line).select("match_id", tx.goal_text(F.col("line")).alias("g")).select("match_id", "g.*")


def profiles(pages: DataFrame) -> DataFrame:
    """Facts read from profile pages (player_id, html); what a page does not say is NULL."""
    text = tx.normalize_whitespace(F.regexp_replace("html", "<[^>]*>", " "))
    return pages.select("player_id", tx.profile_facts(text).alias("x")).select("player_id", "x.*")


def key_values(pages: DataFrame) -> DataFrame:
    """Rows of exactly two cells of pages (page_id, html) as a map; of a repeated key the last row counts."""
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    plain = lambda cell: tx.normalize_whitespace(F.regexp_replace(cell, "<[^>]*>", " "))
    rows = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells), lambda x: F.size(x) == 2)
    add = lambda done, x: F.map_concat(F.map_filter(done, lambda k, _: k != plain(x[0])), F.create_map(plain(x[0]), plain(x[1])))
    return pages.select("page_id", F.aggregate(rows, F.create_map().cast("map<string,string>"), add).alias("facts"))


#: Headers of squad pages (fixed values).
POSITIONS = ("TOR", "ABWEHR", "MITTELFELD", "ANGRIFF")


def squad(pages: DataFrame) -> DataFrame:
    """Entries 'number name' of squad pages (page_id, html) under their position header; what follows TRAINER is left out."""
    lines = pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("at", "line"))
    header = F.when(F.col("line").isin(*POSITIONS, "TRAINER"), F.col("line"))
    so_far = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("h", header).withColumn("position_group", F.last("h", ignorenulls=True).over(so_far))
    entry = r"^(\d+)\s+(.+?)\s*$"
    return out.filter("h IS NULL AND position_group <> 'TRAINER'").select("page_id", "position_group", tx.some(F.col("line"), entry, 1).cast("int").alias("shirt_number"), tx.some(F.col("line"), entry, 2).alias("name"))


def applied(lineups: DataFrame, substitutions: DataFrame, order: str = "substitution_id") -> DataFrame:
    """Line-ups with minutes on and off; incoming players are no starters, and players missing in the line-up are added. Of several entries of a player the last in order counts, as they stand on the page."""
    last = lambda who, name: substitutions.groupBy("match_id", F.col(who).alias("player_id")).agg(F.max_by("minute", F.struct(order, "minute")).alias(name))
    on, off = last("player_on_id", "minute_on"), last("player_off_id", "minute_off")
    keys = ["match_id", "player_id"]
    out = lineups.select(*keys, "is_starter").join(on, keys, "full").join(off, keys, "full")
    return out.withColumn("is_starter", F.when(F.col("minute_on").isNotNull(), False).otherwise(F.coalesce("is_starter", F.lit(True))))


def collected_cards(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """Cards shown in line-up cells (match_id, player_id, cell; no minute) and in substitution entries (with minute), a row for each card."""
    both = cells.select("match_id", "player_id", "cell", F.lit(None).cast("int").alias("minute")).unionByName(entries.select("match_id", "player_id", "cell", "minute"))
    marks = tx.lineup_marks(F.col("cell"))
    shown = F.concat(F.array_repeat(F.lit("yellow"), marks["yellow"]), F.array_repeat(F.lit("second_yellow"), marks["second_yellow"].cast("int")), F.array_repeat(F.lit("red"), marks["red"].cast("int")))
    return both.select("match_id", "player_id", F.explode(shown).alias("card_type"), "minute")


def parsed_matches(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match headers and the pages that have none: a failed page goes to the second table and stops nothing. pages: match_id, html."""
    head = tx.parse_header_score(F.regexp_extract("html", r"<b>(.*?)</b>", 1))
    out = pages.select("match_id", head.alias("x")).select("match_id", "x.*")
    return out.filter("home IS NOT NULL"), out.filter("home IS NULL").select("match_id", F.lit("no header").alias("error"))


def parse_statistics(good: DataFrame, failed: DataFrame) -> DataFrame:
    return good.agg(F.lit("ok").alias("status"), F.count("*").alias("n")).unionByName(failed.agg(F.lit("failed").alias("status"), F.count("*").alias("n")))


def standings_rows(pages: DataFrame, focal: str) -> DataFrame:
    """Place, goals and points of the focal row per matchday page: 'N. Name a - b points'."""
    pattern = rf"(\d+)\.\s*{focal}\s+(\d+)\s*-\s*(\d+)\s+(\d+)"
    number = lambda k: tx.some(F.col("html"), pattern, k).cast("int")
    return pages.select("season_competition_id", number(1).alias("position"), number(2).alias("goals_for"), number(3).alias("goals_against"), number(4).alias("points")).filter("position IS NOT NULL")


def reserve_players(pages: DataFrame) -> DataFrame:
    """Bench players: the comma-separated names after 'Reserve:'."""
    names = F.explode(F.split(F.regexp_extract("html", r"Reserve:\s*([^<]*)", 1), r",\s*")).alias("name")
    return pages.select("match_id", names).filter("name <> ''")


def friendly_blocks(pages: DataFrame, mark: str = "<hr>") -> DataFrame:
    """Simplified blocks of friendlies: date or month, score, opponent; every block of a page counts."""
    blocks = explode_blocks(pages, mark)
    score = r"(\d+):(\d+)"
    return blocks.select("page_id", "block", F.coalesce(tx.parse_german_date(F.col("html")), tx.parse_approx_month(F.regexp_extract("html", r"(ca\.\s+\p{L}+\s+\d{4})", 1))).alias("match_date"), tx.some(F.col("html"), score, 1).cast("int").alias("home_score"), tx.some(F.col("html"), score, 2).cast("int").alias("away_score"))
