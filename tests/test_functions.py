"""Column functions on hand-written edge cases."""

from pyspark.sql import functions as F

from sportlake.functions import numbers as num
from sportlake.functions import text as tx
from sportlake.operators import perspective as prj


def values(spark, texts, make):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["x"] for r in df.select("k", make(F.col("t")).alias("x")).orderBy("k").collect()]


def test_names(spark):
    assert values(spark, ["Müller", "Saint-Étienne", "  a  b ", None, "Strauß"], tx.normalize_name) == ["muller", "saint etienne", "a b", None, "strau"]
    assert values(spark, ["? SANDER", "wdh. Meier", "FE, Lipponer", "Klopp"], tx.clean_player_name) == ["SANDER", "Meier", "Lipponer", "Klopp"]
    assert values(spark, ["Trainer: Baas", "Liebers an Klopp", "12", "-", "A", "x" * 101, "", None, "Meier"], tx.player_name_error) == ["trainer", "assist_text", "not_a_letter", "placeholder", "too_short", "too_long", "empty", "empty", None]


def test_name_rules(spark):
    assert values(spark, ["Čech", "Qəbələ", "Şahin Ő", "e\u0301", "Łódź", "Großer"], tx.strip_accents) == ["Cech", "Qəbələ", "Sahin O", "e", "Łodz", "Großer"]
    names = ["?", "? -", "WDH. fe, Meier", "Baas (FSV-Trainer)", "Trainerin Meier", "Coach: X", "Referee: Y", "Schiedsrichterin: Z", "Tore 3", "Torsten Tor", "70. 3:1 Meier", "Liebers AN Klopp", "FE, -", " \n ", "'Meier", "Jo"]
    want = ["empty", "placeholder", None, "trainer", None, "trainer", "referee", "referee", "goal_text", None, "goal_text", "assist_text", "empty", "empty", "not_a_letter", None]
    assert values(spark, names, tx.player_name_error) == want
    assert values(spark, ["?  Meier", "wdh.Meier", "WDH. he, Meier", "? wdh. ET, A  B"], tx.clean_player_name) == ["Meier", "Meier", "Meier", "A  B"]
    names = ["Cotrainer X", "Referee", "Tore 3", "7. 1:0 X", "Meier, Klopp", "12", "ABC", "ABCD", "A" * 101, "Meier, Hans", "", None]
    assert values(spark, names, tx.error_category) == ["trainer_name", "referee_name", "goal_text", "goal_text", "error_text", "invalid_pattern", "invalid_pattern", None, "too_long", "contains_comma", None, None]


def test_numbers_in_texts(spark):
    assert values(spark, ["12.000", "1,5", "x", "", None], tx.parse_int) == [12000, 15, None, None, None]
    assert [tuple(x) for x in values(spark, ["45+2.", "  7.", "x."], tx.parse_minute)] == [(45, 2), (7, None), (None, None)]
    assert [tuple(x) for x in values(spark, ["A - B 2:1 (1:0)", "A - B -:-", "none"], tx.parse_header_score)] == [("A", "B", 2, 1, 1, 0), ("A", "B", None, None, None, None), (None,) * 6]


def test_dates(spark):
    assert [str(x) for x in values(spark, ["31.09.1972", "1.2.1999", "am 2001-05-06", "1.2.05", ""], tx.parse_german_date)] == ["None", "1999-02-01", "2001-05-06", "2005-02-01", "None"]
    assert [str(x) for x in values(spark, ["ca. Oktober 1945", "Frühjahr 1950"], tx.parse_approx_month)] == ["1945-10-01", "1950-01-01"]


def test_seasons(spark):
    assert [tuple(x) for x in values(spark, ["1905-06", "1999-00", "2029-30"], tx.season_years)] == [(1905, 1906), (1999, 2000), (2029, 2030)]
    assert [tuple(x) for x in values(spark, ["1905-06"], lambda c: tx.season_years(c, legacy=True))] == [(1905, 2006)]
    assert [tuple(x) for x in values(spark, ["2007/08", "1999-2001", "1998/02", "1950"], tx.career_years)] == [(2007, 2008), (1999, 2001), (1998, 2002), (1950, 1950)]


def test_goal_and_substitution_texts(spark):
    assert tuple(values(spark, ["70. 3:1 Meier (Klopp)"], tx.goal_text)[0]) == (70, None, 3, 1, "Meier", "Klopp")
    assert tuple(values(spark, ["90+3. 1:1 Meier (-)"], tx.goal_text)[0]) == (90, 3, 1, 1, "Meier", None)
    assert tuple(values(spark, ["46. 12 A für 7 X an B"], tx.substitution_text)[0]) == (46, "A", 12, "B", 7)


def test_leagues(spark):
    names = ["Bundesliga", "2. Bundesliga Süd", "Regionalliga Südwest", "Amateur-Oberliga", "Bezirksliga", "DFB-Pokal", "Europapokal", "Test"]
    assert values(spark, names, prj.league_level) == ["first_division", "second_division", "third_division", "amateur", "historical", "cup", "cup", "other"]
    more = ["Bundesliga Süd", "2.Bundesliga", "Oberliga", "Gauliga Südwest", "Kreisklasse", "1. Klasse", "Champions League", "UEFA-Cup", "Europa League"]
    assert values(spark, more, prj.league_level) == ["other", "second_division", "amateur", "historical", "historical", "historical", "international", "international", "international"]


def test_ratio_rounds_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 0), (None, 3), (2, 3)], "x int, y int").select(num.ratio("x", "y", 2).alias("r"))
    assert [r["r"] for r in df.collect()] == [0.13, None, None, 0.67]


def test_points(spark):
    df = spark.createDataFrame([(True, 0, "easy"), (True, 30000, "hard"), (True, 31000, "?"), (False, 1, "easy")], "c boolean, t long, d string")
    assert [r[0] for r in df.select(num.points_difficulty(F.col("c"), F.col("t"), F.col("d"))).collect()] == [100, 150, 100, 0]
    assert [r[0] for r in df.select(num.points_time(F.col("c"), F.col("t"))).collect()] == [100, 40, 38, 0]
