"""Column functions on names, dates, scores and the texts of match pages. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that decompose to one other (compatibility decomposition, without combining marks), what they become, and the combining
#: marks, which go. Up to the end of the Latin and Greek extensions; the sharp s stays.
LETTERS = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in map(chr, range(128, 0x2000))}
MARKED = "".join(c for c, x in LETTERS.items() if len(x) == 1 and x != c)
PLAIN = "".join(x for c, x in LETTERS.items() if len(x) == 1 and x != c)
COMBINING = "".join(c for c, x in LETTERS.items() if not x)
MONTHS = {"januar": 1, "februar": 2, "märz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12}
#: White space, in a form that all regular expressions read alike.
BLANK = r"[\t-\r ]"
CARDS = {"gelbekarte.bmp": "yellow", "gelbrot.bmp": "second_yellow", "rotekarte.bmp": "red"}


def some(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; NULL if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_accents(c: Column) -> Column:
    return F.translate(c, MARKED + COMBINING, PLAIN)


def normalize_name(c: Column) -> Column:
    """Without accents, marks as spaces, single spaces, lower case."""
    return F.lower(normalize_whitespace(F.regexp_replace(strip_accents(c), "[^A-Za-z0-9 ]", " ")))


def parse_int(c: Column) -> Column:
    """Digits with . and , as separators; anything else is NULL."""
    plain = F.regexp_replace(F.trim(c), "[.,]", "")
    return F.when(plain.rlike(r"^\d{1,9}$"), plain.cast("int"))


def digits_or_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast("int")


def parse_minute(c: Column) -> Column:
    """'45+2.' to minute and stoppage."""
    pattern = r"^\s*(\d+)(?:\+(\d+))?\."
    return F.struct(some(c, pattern, 1).cast("int").alias("minute"), some(c, pattern, 2).cast("int").alias("stoppage"))


def parse_header_score(c: Column) -> Column:
    """'A - B 2:1 (1:0)' to sides and scores; a dash for a score is NULL."""
    pattern = r"^\s*(.+?) - (.+?)\s+(\d+|-):(\d+|-)(?:\s*\((\d+):(\d+)\))?"
    number = lambda k: some(c, pattern, k).try_cast("int")
    return F.struct(some(c, pattern, 1).alias("home"), some(c, pattern, 2).alias("away"), number(3).alias("home_score"), number(4).alias("away_score"), number(5).alias("halftime_home"), number(6).alias("halftime_away"))


def parse_german_date(c: Column) -> Column:
    """dd.mm.yyyy, dd.mm.yy (up to 30 is 20yy) or yyyy-mm-dd anywhere; an impossible date is NULL."""
    full = F.try_to_date(F.regexp_extract(c, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), "d.M.yyyy")
    day, year = F.regexp_extract(c, r"(\d{1,2}\.\d{1,2}\.)(\d{2})(?!\d)", 1), F.regexp_extract(c, r"(\d{1,2}\.\d{1,2}\.)(\d{2})(?!\d)", 2)
    short = F.try_to_date(F.concat(day, F.when(year <= "30", "20").otherwise("19"), year), "d.M.yyyy")
    return F.coalesce(full, short, F.try_to_date(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))


def parse_approx_month(c: Column) -> Column:
    """'ca. Oktober 1945' to the first of the month; an unknown month is January."""
    month = F.coalesce(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])[F.lower(F.regexp_extract(c, r"(\p{L}+)\s+\d{4}", 1))], F.lit(1))
    return F.make_date(some(c, r"(\d{4})").cast("int"), month, F.lit(1))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def _without_question_mark(c: Column) -> Column:
    return stripped(F.regexp_replace(stripped(c), r"^\?", ""))


def _without_repeat_mark(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)^wdh\.{BLANK}*", "")


def _without_goal_mark(c: Column) -> Column:
    return stripped(F.regexp_replace(c, rf"(?i)^(?:FE|ET|HE),{BLANK}*", ""))


def clean_player_name(c: Column) -> Column:
    """Without one leading question mark, then a repeat mark, then a penalty or own goal mark."""
    return _without_goal_mark(_without_repeat_mark(_without_question_mark(c)))


# Marks of lines that are not players, in lower case.
TRAINER_MARKS = "trainer:|fsv-trainer|coach:|-trainer"
REFEREE_MARKS = "schiedsrichter:|schiedsrichterin:|referee:"


def player_name_error(c: Column) -> Column:
    """Why a text is no player's name; NULL if it is one. Each test sees the name as cleaned up to there; the first reason counts."""
    bare = _without_question_mark(c)
    name = _without_repeat_mark(bare)
    low, clean = F.lower(name), _without_goal_mark(name)
    return (
        F.when(c.isNull() | (bare == ""), "empty").when(bare == "-", "placeholder").when(low.rlike(TRAINER_MARKS), "trainer").when(low.rlike(REFEREE_MARKS), "referee").when(low.startswith("tore ") | name.rlike(rf"^\d+\.{BLANK}*\d+:\d+"), "goal_text")
        .when(F.lower(clean).contains(" an "), "assist_text").when(clean.isin("", "-"), "empty").when(~clean.rlike(r"^\p{L}"), "not_a_letter").when(F.length(clean) < 2, "too_short").when(F.length(clean) > 100, "too_long")
    )


def legacy_player_name(c: Column) -> Column:
    """Older rule: no shirt number at either end, no accents, only letters, dash and apostrophe."""
    bare = F.regexp_replace(strip_accents(c), rf"^\d+{BLANK}+|{BLANK}+\d+\z", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z '\-]", " "), " +", " "))


# Surnames that stand after a comma in lines with two names.
SECOND_NAMES = "liebers|latza|hazard|klopp"


def error_category(c: Column) -> Column:
    """The category of a wrong name, in order; NULL for a plain or empty one."""
    low = F.lower(c)
    return (
        F.when(low.rlike("trainer|coach"), "trainer_name").when(low.rlike("schiedsrichter|referee"), "referee_name").when(low.rlike(rf"^tore{BLANK}|^\d+\.{BLANK}*\d+:\d+"), "goal_text").when(low.rlike(rf",{BLANK}*(?:{SECOND_NAMES})"), "error_text")
        .when(c.rlike(r"^[^a-zA-Z]|^[A-Z]{1,3}\z"), "invalid_pattern").when(F.length(c) > 100, "too_long").when(c.contains(","), "contains_comma")
    )


def invalid_player_pattern(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^\d+\z"), "digits").when(c.rlike(r"^-+\z"), "dashes").when(c.rlike(rf"^\d+\.{BLANK}+\d+:\d+"), "goal_time").when(c.rlike(rf"^(?:FE|HE|ET|EL),{BLANK}"), "goal_mark").when(c.rlike(rf",{BLANK}+[^\n]+{BLANK}+an{BLANK}"), "assist_text").when(c.rlike(r"^\([^\n]*\)\z"), "brackets").when(c.rlike(rf"dir\.{BLANK}*FS"), "free_kick")
    )


def normalize_href(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\./", "")


def canonical_team(c: Column, aliases: list[str], name: str) -> Column:
    """One name for all texts that match an alias pattern."""
    return F.when(F.lower(c).rlike("|".join(f"(?:{a})" for a in aliases)), name).otherwise(normalize_whitespace(c))


def is_focal_text(c: Column, words: list[str]) -> Column:
    low, out = F.lower(c), F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def season_years(c: Column, legacy: bool = False) -> Column:
    """'2004-05' to start and end. legacy: the two digits decide the century, up to 30 being 20yy."""
    start, two = some(c, r"^(\d{4})").cast("int"), some(c, r"^\d{4}-(\d{2})$").cast("int")
    end = F.when(two <= 30, two + 2000).otherwise(two + 1900) if legacy else start + 1
    return F.struct(start.alias("start_year"), end.alias("end_year"))


def career_years(c: Column) -> Column:
    """'1999-2001' or '2007/08' to start and end; one year alone is both."""
    start, end = some(c, r"(\d{4})").cast("int"), some(c, r"\d{4}\s*[-/]\s*(\d{2,4})")
    full = F.when(F.length(end) == 4, end.cast("int")).when(F.length(end) == 2, F.floor(start / 100).cast("int") * 100 + end.cast("int") + F.when(end.cast("int") < start % 100, 100).otherwise(0))
    return F.struct(start.alias("start_year"), F.coalesce(full, start).alias("end_year"))


def league_from_title(title: Column, file: Column) -> Column:
    """What follows the colon of a title; else by the file's name."""
    after = F.nullif(F.trim(F.regexp_extract(title, r":\s*(.+)$", 1)), F.lit(""))
    low = F.lower(file)
    return F.coalesce(after, F.when(low.contains("liga"), "Liga").when(low.contains("pokal"), "Pokal").when(low.contains("freund"), "Freundschaftsspiel"))


def classify_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    return (
        F.when(name.rlike(r"^profiliga"), "league_overview").when(name.rlike(r"^profi(?:dfb|pokal)"), "cup").when(name.rlike(r"^profirest"), "friendly").when(name.rlike(r"^profi(?:uefa|euro|inter)"), "european").when(name.rlike(r"\d+\.html?$"), "match").when(name.contains("stat"), "statistics").when(name.contains("kalender"), "calendar").otherwise("other")
    )


#: Overview files of a season beside its league, with competition and level.
OVERVIEWS = {
    "profipokal": ("DFB-Pokal", "cup"), "profiuefa": ("Europapokal", "international"), "profiuec": ("Europapokal", "international"), "profiuecl": ("Europapokal", "international"),
    "profiintertoto": ("Europapokal", "international"), "profiueclq": ("Europapokal", "international"), "profirest": ("Freundschaftsspiele", "friendly"),
}


def overview_competition(path: Column) -> Column:
    """label and level of an overview file of a cup, of Europe or of friendly matches; NULL for other files."""
    stem = F.lower(F.regexp_extract(path, r"([^/]+)\.html?$", 1))
    part = lambda k: F.create_map(*[F.lit(x) for name, values in OVERVIEWS.items() for x in (name, values[k])])[stem]
    return F.struct(part(0).alias("label"), part(1).alias("level"))


def attendance_kickoff(c: Column) -> Column:
    """'date, 15.30 Uhr, 12.000 Zuschauer' to kick-off and attendance; 'keine' is NULL."""
    return F.struct(some(c, r"(\d{1,2}[.:]\d{2})\s*Uhr").alias("kickoff"), parse_int(some(c, r"([\d.,]+)\s*Zuschauer")).alias("attendance"))


def substitution_text(c: Column) -> Column:
    """'46. 12 A für 7 B' to minute, names and numbers; of 'X an Y' the last part is the player."""
    pattern = r"^(\d+)(?:\+\d+)?\.\s*(?:(\d+)\s+)?(.+?)\s+für\s+(?:(\d+)\s+)?(.+?)\s*$"
    name = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, pattern, k), r"^.* an ", "")), F.lit(""))
    return F.struct(some(c, pattern, 1).cast("int").alias("minute"), name(3).alias("player_on"), some(c, pattern, 2).cast("int").alias("number_on"), name(5).alias("player_off"), some(c, pattern, 4).cast("int").alias("number_off"))


def goal_text(c: Column) -> Column:
    """'70. 3:1 Scorer (Assist)' to minute, score, scorer and assist; '-' is NULL."""
    pattern = r"^(\d+)(?:\+(\d+))?\.\s*(\d+):(\d+)\s+([^(]+?)\s*(?:\(([^)]*)\))?\s*$"
    part = lambda k: F.nullif(F.nullif(F.trim(F.regexp_extract(c, pattern, k)), F.lit("")), F.lit("-"))
    return F.struct(some(c, pattern, 1).cast("int").alias("minute"), some(c, pattern, 2).cast("int").alias("stoppage"), some(c, pattern, 3).cast("int").alias("score_home"), some(c, pattern, 4).cast("int").alias("score_away"), part(5).alias("scorer"), part(6).alias("assist"))


def goal_kind(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)eigentor|\bET\b"), "own_goal").when(c.rlike(r"(?i)elfmeter|\bFE\b|\bHE\b|11m"), "penalty").otherwise("goal")


def card_kind(icon: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CARDS.items() for x in kv])[F.lower(F.regexp_extract(icon, r"([^/]+)$", 1))]


def goal_attributes(c: Column) -> Column:
    low = F.lower(c)
    part = F.when(low.contains("kopf"), "head").when(low.rlike("links"), "left_foot").when(low.rlike("rechts"), "right_foot")
    return F.struct(low.contains("freistoß").alias("free_kick"), low.contains("kopf").alias("header"), part.alias("body_part"), F.when(low.contains("flanke"), "cross").when(low.contains("ecke"), "corner").when(low.contains("pass"), "pass").alias("assist_type"))


def profile_facts(c: Column) -> Column:
    """Facts of a profile page's text."""
    return F.struct(
        parse_german_date(F.regexp_extract(c, r"\*\s*(\d{1,2}\.\d{1,2}\.\d{4})", 1)).alias("birth_date"), some(c, r"\*\s*\d{1,2}\.\d{1,2}\.\d{4}\s+in\s+([^,<\n]+)").alias("birth_place"), some(c, r"(\d{3})\s*cm").cast("int").alias("height_cm"), some(c, r"(\d{2,3})\s*kg").cast("int").alias("weight_kg"),
        some(c, r"Position:?\s*(\p{L}+)").alias("position"), some(c, r"Nationalität:?\s*(\p{L}+)").alias("nationality"),
    )


def lineup_marks(cell: Column) -> Column:
    """What a line-up cell's html says of a player."""
    return F.struct(cell.rlike("(?i)<b>").alias("captain"), F.regexp_count(cell, F.lit("gelbekarte")).alias("yellow"), cell.contains("gelbrot").alias("second_yellow"), cell.contains("rotekarte").alias("red"), some(F.regexp_replace(cell, "<[^>]*>", " "), r"^\s*(\d{1,2})\b").cast("int").alias("shirt_number"))


def match_conditions(c: Column) -> Column:
    return F.struct(parse_german_date(c).alias("match_date"), attendance_kickoff(c).alias("crowd"), some(c, r"(?i)\b(regen|schnee|sonnig|bewölkt|nebel)\b").alias("weather"), some(c, r"(-?\d{1,2})\s*(?:°|Grad)").cast("int").alias("temperature"))


def grid_position(row: Column) -> Column:
    return F.when(row == 1, "GK").when(row == 2, "DEF").when(row == 3, "MID").when(row >= 4, "ATT")


def last_name(c: Column) -> Column:
    return F.element_at(F.split(normalize_name(c), " "), -1)
