"""Match pages to tables, as one job.

The pages are read once: a row for each page, with what it says as a whole and its table cells in a list, is written, and every table comes from these
rows. The result is one output, partitioned by table; pages that cannot be read stand in a table of errors with their reason, stop nothing, and can be
tried again alone.

A page names the match in its first bold text. Its team blocks are the first two tables of full width and one of the heights, tried in turn; without such
tables, the first two that hold a table beginning with `Reserve`, or else name it themselves. Players stand in the cells of the tables inside a block (of the block itself, if it holds
none), those of a table beginning with `Reserve` on the bench. Cells of staff, goals and substitutions are no players, and a cell that holds a further table is none.

Null, empty and broken pages are errors. Of repeated players the first number and link count. Where a player is put on or off more than once, the entry that
stands last on the page counts. Names are as the page has them. Further columns of pages are ignored; pages with the same id are read as one page.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.functions import text as tx
from sportlake.sources import elements as el
from sportlake.sources.io import shared_folder, written

#: Heights of team tables, the first found twice counts; height of the blocks of a page of several matches (fixed values).
HEIGHTS, SEVERAL = ("30%", "28%", "27%"), "45%"
SIDES = ("home", "away")
#: Beyond the places of any page.
LAST = 2**31
#: What marks cells of a team block that name no player (fixed values).
STAFF = ("trainer:", "fsv-trainer", "coach:", "-trainer", "schiedsrichter:", "schiedsrichterin:", "referee:")
#: Links of players (fixed value).
PLAYER = r"spieler/.*\.html"

COLUMNS = {
    "matches": ["page_id", "home", "away", "home_score", "away_score", "halftime_home", "halftime_away", "match_date", "kickoff", "attendance"],
    "officials": ["page_id", "role", "name", "profile_url"],
    "players": ["name", "profile_url"],
    "lineups": ["page_id", "side", "name", "number", "profile_url", "is_starter", "minute_on", "stoppage_on", "minute_off", "stoppage_off"],
    "substitutions": ["page_id", "side", "minute", "stoppage", "player_on", "number_on", "player_off", "number_off"],
    "goals": ["page_id", "side", "minute", "stoppage", "home_score", "away_score", "name", "assist"],
    "cards": ["page_id", "side", "name", "minute", "stoppage", "card_type"],
    "errors": ["page_id", "error"],
}


def blocks_of(tables: dict[int, tuple], reserves: set[int], naming: set[int]) -> tuple[list[int], bool]:
    """The places of the team blocks of a page, and whether it holds several matches. tables: parent and attributes by place; reserves: tables beginning with Reserve; naming: tables that name it themselves."""
    full = {at: el.attribute(attrs, "height") for at, (_, attrs) in tables.items() if "100%" in attrs and el.attribute(attrs, "width") == "100%"}
    high = {h: [at for at, x in full.items() if x == h] for h in (*HEIGHTS, SEVERAL)}
    wrappers = {at if tables[at][0] is None else tables[at][0] for at in reserves}
    named = wrappers if len(wrappers) >= 2 else naming
    return next((high[h] for h in HEIGHTS if len(high[h]) >= 2), [at for at in tables if at in named]), len(high[SEVERAL]) >= 2


def page_of(html: str) -> tuple:
    """header, crowd, n_blocks, several and cells of a page, as in PAGE."""
    tables, ends, opened, firsts, naming, groups, header = {}, {}, [], {}, set(), {}, []
    crowd = bold_at = bold_end = goals_in = staff_at = None
    judged = False
    for at, tag, closing, attrs, text, _, table_at, parent_at, cell_at in el.tree(html, every=False):
        if cell_at is not None:
            group = groups.get(cell_at)
            if group is None:
                group = groups[cell_at] = table_at, [], [], [], []
            if text:
                group[1].append(text)
            if closing:
                if tag == "table":
                    group[4].append(at)
            elif tag == "a":
                group[2].append((el.attribute(attrs, "href"), text))
            elif tag == "img":
                group[3].append(el.attribute(attrs, "src"))
        if tag == "table":
            if not closing:
                tables[at] = parent_at, attrs
                opened.append(at)
            elif opened:
                ends[opened.pop()] = at
        elif tag == "b":
            if not closing:
                low, bold_at = text.lower(), at if bold_at is None else bold_at
                if "tore" in low and table_at is not None:
                    goals_in = table_at if goals_in is None else min(goals_in, table_at)
                if "schiedsrichter" in low and not judged:
                    staff_at, judged = table_at, True
            elif bold_at is not None and bold_end is None:
                bold_end = at
        if text:
            if bold_at is not None and bold_end is None:
                header.append(text)
            if crowd is None and "zuschau" in text.lower():
                crowd = text
            if table_at is not None:
                if table_at not in firsts:
                    firsts[table_at] = text
                if "Reserve" in text:
                    naming.add(table_at)
    reserves = {at for at, text in firsts.items() if text.lower().startswith("reserve")}
    blocks, several = blocks_of(tables, reserves, naming)
    goals_at = goals_in and next((at for at in tables if at > goals_in), None)

    own, spans = set(blocks), []
    for b, following in zip(blocks[:2], [*blocks[1:], None], strict=False):  # a place stands in the last block that begins before it, until that ends
        end = min(x for x in (following, ends.get(b), LAST) if x is not None)
        spans.append((b, end, any(b < at < end for at in tables if at not in own)))
    cells = []
    for at, (table_at, texts, anchors, icons, closed) in groups.items():
        side = None
        for name, (start, end, holds) in zip(SIDES, spans, strict=False):
            if start <= at < end and not (holds and table_at in own):  # the tables of a block, if it holds any; else the block itself
                side = name
        cells.append((at, " ".join(texts), anchors, icons, bool(closed), side, table_at in reserves, table_at == goals_at, table_at == staff_at))
    return " ".join(header), crowd, len(blocks), several, cells


CELL = {
    "at": ("int", pa.int32()), "text": ("string", pa.string()), "anchors": ("array<struct<href:string,text:string>>", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), "icons": ("array<string>", pa.list_(pa.string())),
    "holds_table": ("boolean", pa.bool_()), "side": ("string", pa.string()), "reserve": ("boolean", pa.bool_()), "in_goals": ("boolean", pa.bool_()), "in_staff": ("boolean", pa.bool_()),
}
PAGE = {"header": ("string", pa.string()), "crowd": ("string", pa.string()), "n_blocks": ("bigint", pa.int64()), "several": ("boolean", pa.bool_()), "cells": (f"array<struct<{','.join(f'{k}:{x}' for k, (x, _) in CELL.items())}>>", pa.list_(pa.struct([(k, x) for k, (_, x) in CELL.items()])))}


def read(pages: DataFrame) -> DataFrame:
    """A row for each page (page_id, html): page_id, header, crowd (the text that names spectators), n_blocks, several, and its cells in a list."""
    return el.by_page(pages, "page_id", page_of, PAGE)


def cells_of(found: DataFrame, cells: str = "cells") -> DataFrame:
    """A row for each cell of pages that were read, from one of their lists of cells, beside the other columns."""
    own = [c for c in found.columns if c not in ("page_id", cells)]
    return found.select("page_id", *own, F.inline(cells)).select("page_id", *CELL, *own)


#: The cells that a table comes from.
KINDS = {"team": lambda c: c["side"].isNotNull(), "scorers": lambda c: c["in_goals"], "staff": lambda c: c["in_staff"]}


def cells(pages: DataFrame, kind: str | None = None) -> DataFrame:
    """A row for each cell of a page, or for those of a kind: page_id, at, text, anchors (href, text), icons, holds_table, side, reserve, in_goals, in_staff, and the same for all rows of a page: header, crowd, n_blocks, several."""
    found = read(pages)
    return cells_of(found.withColumn("cells", F.filter("cells", KINDS[kind])) if kind else found)


def without_marks(c: Column) -> Column:
    """Text without the marks of penalties, own goals and repeats in front; of 'X an Y' the last part."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i)^(FE|ET|HE),\s*", ""), r"(?i)^wdh\.\s*", ""), r"(?i)^.*\s+an\s+", ""))


def numbered(c: Column) -> tuple[Column, Column]:
    """Number in front of a name, and the name."""
    return tx.some(c, r"^(\d{1,9})\s+\S").cast("int"), F.regexp_replace(c, r"^\d+\s+(?=\S)", "")


MINUTE = r"^\s*(\d{1,9})(?:\+(\d{1,9}))?\.\s*"


def minutes() -> list[Column]:
    return [tx.some(F.col("text"), MINUTE, 1).cast("int").alias("minute"), tx.some(F.col("text"), MINUTE, 2).cast("int").alias("stoppage")]


def reason() -> Column:
    """Why a page cannot be read, by the first reason that holds; NULL if it can."""
    return F.when(F.col("several"), "several matches").when(tx.parse_header_score(F.col("header"))["home"].isNull(), "no header").when(F.col("n_blocks") < 2, "no team tables")


def substitutions(found: DataFrame) -> DataFrame:
    """Substitution entries of team blocks in order: page_id, side, at, minute, stoppage, player_on, number_on, player_off, number_off, card_type."""
    rest = F.regexp_replace("text", MINUTE, "")
    clean = lambda k: without_marks(F.regexp_replace(F.trim(F.element_at(F.split(rest, " für ", 2), k)), r"^\d+\s+(?=\S)", ""))
    number = lambda k: numbered(F.regexp_replace(F.regexp_replace(F.trim(F.element_at(F.split(rest, " für ", 2), k)), r"(?i)^(FE|ET|HE),\s*", ""), r"(?i)^wdh\.\s*", ""))[0]
    strip = lambda c: numbered(c)[1]
    shown = F.get(F.filter(F.transform("icons", tx.card_kind), lambda x: x.isNotNull()), F.lit(0))
    rows = found.filter("side IS NOT NULL AND NOT holds_table").filter(F.col("text").contains(" für ") & F.col("text").rlike(MINUTE) & rest.contains(" für "))
    return rows.select("page_id", "side", "at", *minutes(), strip(clean(1)).alias("player_on"), number(1).alias("number_on"), strip(clean(2)).alias("player_off"), number(2).alias("number_off"), shown.alias("card_type"))


def entries(found: DataFrame) -> DataFrame:
    """Player cells of team blocks: page_id, side, at, name, number, profile_url, reserve, icons."""
    low = F.lower("text")
    staff = low.rlike("|".join(rf"\Q{x}\E" for x in STAFF))
    goal = low.startswith("tore ") | F.col("text").rlike(r"^\d+\.\s*\d+:\d+")
    rows = found.filter("side IS NOT NULL AND NOT holds_table AND text <> ''").filter(~low.startswith("reserve") & ~staff & ~goal & ~F.col("text").contains(" für "))
    number, name = numbered(F.col("text"))
    url = F.get(F.filter(F.transform("anchors", lambda a: a["href"]), lambda h: h.rlike(PLAYER)), F.lit(0))
    rows = rows.select("page_id", "side", "at", name.alias("name"), number.alias("number"), F.replace(url, F.lit("../"), F.lit("")).alias("profile_url"), "reserve", "icons")
    return rows.filter(F.length("name") >= 2).withColumn("name", F.trim(F.regexp_replace("name", r"^\?", ""))).filter(F.col("name").rlike(r"^\p{L}"))


def lineups(players: DataFrame, swaps: DataFrame) -> DataFrame:
    """Players of a side with the minutes at which they came and went: an entry that stands later on the page overwrites an earlier one. Who comes on is no starter; who is named in a substitution alone is added."""
    none = lambda kind: F.lit(None).cast(kind)
    seen = players.select("page_id", "side", F.struct(F.lit(0), "at").alias("at"), "name", "number", "profile_url", (~F.col("reserve")).alias("starts"), *(none("struct<minute:int,stoppage:int>").alias(c) for c in ("came", "went")))
    time, when = "struct<minute:int,stoppage:int>", F.struct("minute", "stoppage")
    part = lambda who, number, came, went: F.struct(F.col(who).alias("name"), F.col(number).alias("number"), none("string").alias("profile_url"), none("boolean").alias("starts"), came.alias("came"), went.alias("went"))
    both = F.array(part("player_on", "number_on", when, none(time)), part("player_off", "number_off", none(time), when))
    rows = seen.unionByName(swaps.select("page_id", "side", F.struct(F.lit(1), "at").alias("at"), F.inline(both))).filter("name <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    out = rows.groupBy("page_id", "side", "name").agg(first("number"), first("profile_url"), F.bool_and("starts").alias("starts"), last("came"), last("went"))
    starter = F.when(F.col("came").isNotNull(), False).otherwise(F.coalesce("starts", F.lit(True)))
    return out.select("page_id", "side", "name", "number", "profile_url", starter.alias("is_starter"), *(F.col(f"{c}.{x}").alias(f"{x}_{y}") for c, y in (("came", "on"), ("went", "off")) for x in ("minute", "stoppage")))


def cards(players: DataFrame, swaps: DataFrame) -> DataFrame:
    """Cards shown beside players (no minute) and in substitution entries (for who came on)."""
    shown = players.select("page_id", "side", "name", F.lit(None).cast("int").alias("minute"), F.lit(None).cast("int").alias("stoppage"), F.explode(F.transform("icons", tx.card_kind)).alias("card_type"))
    return shown.unionByName(swaps.select("page_id", "side", F.col("player_on").alias("name"), "minute", "stoppage", "card_type")).filter("card_type IS NOT NULL")


def goals(found: DataFrame) -> DataFrame:
    """Goals of the goal table in order: page_id, side, minute, stoppage, home_score, away_score, name, assist. The side is home if its score has risen since the goal before."""
    body = MINUTE + r"(\d{1,9}):(\d{1,9})\s+(.*)$"
    rows = found.filter("in_goals AND NOT holds_table").filter(F.col("text").rlike(body)).withColumn("said", F.regexp_extract("text", body, 5))
    said = F.regexp_replace(F.regexp_replace("said", r"(?i)^(FE|ET|HE),\s*", ""), r"(?i)^wdh\.\s*", "")
    open_at = F.instr(said, "(")
    in_brackets = said.contains("(") & said.contains(")")
    scorer = F.trim(F.when(in_brackets, F.substring(said, F.lit(1), open_at - 1)).otherwise(said))
    assist = F.when(in_brackets, without_marks(F.regexp_replace(F.substring(said, open_at + 1, F.length(said)), r"^[ )]+|[ )]+$", "")))
    linked = F.get(F.transform(F.filter("anchors", lambda a: a["href"].contains("../spieler/")), lambda a: a["text"]), F.lit(0))
    words = F.split(scorer, " ")
    odd = scorer.contains(" ") & ~scorer.rlike("^[A-Z][a-z]+ [A-Z][a-z]+")
    name = F.when(odd & linked.isNotNull(), linked).when(odd & (F.size(words) > 2), F.element_at(words, -1)).otherwise(scorer)
    rows = rows.select("page_id", "at", *minutes(), tx.some(F.col("text"), body, 3).cast("int").alias("home_score"), tx.some(F.col("text"), body, 4).cast("int").alias("away_score"), name.alias("name"), F.nullif(F.nullif(assist, F.lit("-")), F.lit("")).alias("assist"))
    rows = rows.filter((F.length("name") >= 2) & F.col("name").rlike(r"^\p{L}"))
    before = F.coalesce(F.lag("home_score").over(Window.partitionBy("page_id").orderBy("at")), F.lit(0))
    return rows.withColumn("side", F.when(F.col("home_score") > before, "home").otherwise("away"))


def officials(found: DataFrame) -> DataFrame:
    """Referee, coach of the focal team and of the other, from the table that names the referee in bold; of several cells of a role the last."""
    text = F.col("text")
    after = F.trim(F.element_at(F.split(text, ":"), -1))
    coach = F.when(text.contains("FSV-Trainer"), F.struct(F.lit("focal_coach").alias("role"), after.alias("name"))).when(text.contains("Trainer"), F.struct(F.lit("other_coach").alias("role"), after.alias("name")))
    judge = F.when(text.contains("Schiedsrichter"), F.struct(F.lit("referee").alias("role"), F.trim(F.replace(text, F.lit("Schiedsrichter:"), F.lit(""))).alias("name")))
    rows = found.filter("in_staff").select("page_id", "at", F.explode(F.array_compact(F.array(coach, judge))).alias("x"), F.get("anchors", F.lit(0))["href"].alias("profile_url"))
    rows = rows.groupBy("page_id", F.col("x.role").alias("role")).agg(F.max_by(F.struct("x.name", "profile_url"), "at").alias("x"))
    return rows.select("page_id", "role", "x.name", "x.profile_url").filter("name <> ''")


def matches(found: DataFrame) -> DataFrame:
    """Sides, scores, date, kick-off and attendance of pages that were read."""
    crowd = tx.attendance_kickoff(F.col("crowd"))
    return found.select("page_id", tx.parse_header_score(F.col("header")).alias("x"), tx.parse_german_date(F.col("crowd")).alias("match_date"), crowd["kickoff"].alias("kickoff"), crowd["attendance"].alias("attendance")).select("page_id", "x.*", "match_date", "kickoff", "attendance")


def tables(pages: DataFrame) -> dict[str, DataFrame]:
    """The tables of match pages (page_id, html) by name, each with the columns of all of them. pages are read once; what several tables come from is written."""
    pages = read(pages).withColumn("error", reason())
    found = written(pages.select("page_id", "header", "crowd", "error", *(F.filter("cells", test).alias(name) for name, test in KINDS.items())))
    good = found.filter("error IS NULL")
    cells_in = lambda name: cells_of(good.select("page_id", name), name)
    players, swaps = written(entries(cells_in("team"))), written(substitutions(cells_in("team")))
    both = written(lineups(players, swaps))
    linked = both.select("name", "profile_url").distinct().groupBy("name").agg(F.min("profile_url").alias("profile_url"))
    bad = found.filter("error IS NOT NULL")
    made = {"matches": matches(good), "officials": officials(cells_in("staff")), "players": linked, "lineups": both, "substitutions": swaps, "goals": goals(cells_in("scorers")), "cards": cards(players, swaps), "errors": bad}
    kinds = {f.name: f.dataType for df in made.values() for f in df.schema}
    names = list(dict.fromkeys(c for columns in COLUMNS.values() for c in columns))
    return {name: df.select(*(F.col(c) if c in COLUMNS[name] else F.lit(None).cast(kinds[c]).alias(c) for c in names)) for name, df in made.items()}


def extracted(pages: DataFrame) -> DataFrame:
    """All tables of match pages (page_id, html) in one output: `table`, and the columns of all of them."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("table"), "*") for name, df in tables(pages).items()))


def run(pages: DataFrame, folder: str) -> str:
    """Extract pages into folder, in partitions by table; the folder's path comes back. Run again, it replaces what is there."""
    for name, df in tables(pages).items():  # each into its partition, so that no rows are sorted for it
        df.write.mode("overwrite").parquet(f"{folder}/table={name}")
    return folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of an output."""
    return spark.read.parquet(folder).filter(F.col("table") == name).select(*COLUMNS[name])


def retry(pages: DataFrame, folder: str) -> str:
    """Read the pages that failed once more (pages may hold all of them, mended) and give a new folder with what was good before and what is now; the old one stays as it is."""
    spark = pages.sparkSession
    before = spark.read.parquet(folder)
    failed = table(spark, folder, "errors").select("page_id")
    again = extracted(pages.join(F.broadcast(failed) if failed.limit(100_001).count() <= 100_000 else failed, "page_id", "left_semi"))
    gone = failed.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    stays = before.filter("table <> 'players'").join(gone, "page_id", "left_anti").unionByName(before.filter("table = 'players'"))
    both = stays.unionByName(again.select(*stays.columns))
    people = both.filter("table = 'players'").groupBy("table", "name").agg(F.min("profile_url").alias("profile_url"))
    path = shared_folder(spark)
    both.filter("table <> 'players'").unionByName(people, allowMissingColumns=True).write.partitionBy("table").parquet(path)
    return path


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """table and rows of an output, and the pages that failed by reason as tables `error: ...`."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(F.when(F.col("table") == "errors", F.concat(F.lit("error: "), "error")).otherwise(F.col("table")).alias("table_name")).agg(F.count("*").alias("n"))
