"""The element tree and the page job on pages written by hand."""

import pytest

from sportlake.sources import elements as el
from sportlake.sources import io
from sportlake.sources import match_job as job


def found(spark, html):
    return el.tags(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("at").collect()


def test_tables_inside_tables(spark):
    rows = found(spark, "x<TABLE a=1><tr><td>A<table><tr><td>B</table>C<td>D</tr></table>E</table><table><td>F<!-- <table> --></td>G</table>")
    text = {r["text"]: (r["depth"], r["table_at"], r["cell_at"]) for r in rows if r["text"]}
    opens = [r["at"] for r in rows if r["tag"] == "table" and not r["closing"]]
    parents = [r["parent_at"] for r in rows if r["tag"] == "table" and not r["closing"]]
    assert parents == [None, opens[0], None]
    assert {k: (d, t) for k, (d, t, _) in text.items()} == {"x": (0, None), "A": (1, opens[0]), "B": (2, opens[1]), "C": (1, opens[0]), "D": (1, opens[0]), "E": (0, None), "F": (1, opens[2]), "G": (1, opens[2])}
    assert text["A"][2] == text["C"][2] != text["D"][2] and text["B"][2] and text["E"][2] is None and text["G"][2] is None
    assert [r["text"] for r in found(spark, "&uuml;ber&nbsp;1 &amp; <b>2 < 3</b>")] == ["über 1 &", "2", "< 3", ""]
    assert [tuple(r)[1:3] for r in found(spark, None)] == [(0, None)] and len(found(spark, "")) == 1


def team(tag, *tables):
    """A block whose tables each hold cells, one a row."""
    inner = "".join("<table border=0>" + "".join(f"<tr><td>{c}</td></tr>" for c in t) + "</table>" for t in tables)
    return f"<table {tag}><tr><td>{inner}</td></tr></table>"


HOME = (['1 <a href="../spieler/al.html">Al Ek</a>', "<b>2 Bo</b><img src='../gelbekarte.bmp'>", "?Uwe", "46. 12 <a href='../spieler/cu.html'>Cu</a> für 2 Bo <img src=\"../gelbrot.bmp\">", "60+2. Ed für 1 Al Ek", "85. FE, wdh. Bo für Ed", "FSV-Trainer: Cy", "Tore 12. 1:0 Al", "12. 1:0 Al", "-", "9", ""], ["Reserve:", "12 Cu", "13 <a href=x.html>Di</a>"])
AWAY = (["3 Fa", "Fa <a href='../spieler/fa.html'></a>", "Trainer: Old"], ["<b>Reserve</b>", "14 Gu", "3 Fa"])
STAFF = "<table><tr><td><b>Schiedsrichter:</b> <a href='../sr/ek.html'>Ann Ek</a></td><td>FSV-Trainer: <a href='../trainer/cy.html'>Cy Do</a></td><td>Trainer: Old Man</td></tr></table>"
GOALS = "<table><tr><td><b>Tore</b></td></tr></table><table><tr><td>12. 1:0 Al Ek (Bo)</td><td>45+1. 1:1 FE, Fa (-)</td></tr><tr><td>70. 2:1 Abc von <a href='../spieler/cu.html'>Cu</a> (FE, Di an Bo)</td><td>kein Tor</td></tr></table>"
HEAD = "<html><b>1. FSV A - SV B 2:1 (1:1)</b><p>Sa, 12.05.1999, 15.30 Uhr, 12.000 Zuschauer</p>"


def page(tag):
    return HEAD + team(tag, *HOME) + STAFF + team(tag, *AWAY) + GOALS


def with_wrapper(tag):
    """The same inside one more table, which holds the page."""
    return HEAD + "<table><tr><td>" + team(tag, *HOME) + "</td><td>" + STAFF + "</td><td>" + team(tag, *AWAY) + "</td></tr></table>" + GOALS


LAYOUTS = {1: page('width="100%" height="30%"'), 2: page("height='28%' width='100%'"), 3: page("width=100% height=27%"), 4: page(""), 5: with_wrapper('width="100%" height="30%"'), 6: with_wrapper(""), 7: page('width="100%" height="30%"').replace("</td></tr>", "").replace("<html>", "<html><!-- <b>old</b> --><img src=logo.gif>")}
SEVERAL = {10: HEAD + 2 * team('width="100%" height="45%"', ["a"])}
BROKEN = {11: None, 12: "", 13: "<b>no score</b>" + team("height=30% width=100%", ["1 A"]) * 2, 14: HEAD, 15: HEAD + team('width="100%" height="30%"', *HOME)}


@pytest.fixture(scope="module")
def output(spark, tmp_path_factory):
    pages = spark.createDataFrame([(k, h, "more") for k, h in (LAYOUTS | SEVERAL | BROKEN).items()], "page_id int, html string, side string")
    return pages, job.run(pages, f"{tmp_path_factory.mktemp('job')}/out")


def rows(spark, folder, name):
    return sorted(map(tuple, job.table(spark, folder, name).collect()), key=str)


@pytest.mark.parametrize("k", sorted(LAYOUTS))
def test_layouts(spark, output, k):
    own = lambda name: [r[1:] for r in rows(spark, output[1], name) if r[0] == k]
    # Al Ek went at 60+2; Bo went at 46 and came back at 85 for Ed; Cu came from the bench; Fa stands in the team and on the bench
    want = [("home", "Al Ek", 1, "spieler/al.html", True, None, None, 60, 2), ("home", "Bo", 2, None, False, 85, None, 46, None), ("home", "Uwe", None, None, True, None, None, None, None), ("home", "Cu", 12, None, False, 46, None, None, None)]
    want += [("home", "Ed", None, None, False, 60, 2, 85, None), ("home", "Di", 13, None, False, None, None, None, None), ("away", "Fa", 3, "spieler/fa.html", False, None, None, None, None), ("away", "Gu", 14, None, False, None, None, None, None)]
    if k == 7:  # cells without an end reach to the next one
        want[6] = ("away", "Fa", 3, "spieler/fa.html", False, None, None, None, None)
    assert own("lineups") == sorted(want, key=lambda r: str((k, *r)))
    assert own("substitutions") == sorted([("home", 46, None, "Cu", 12, "Bo", 2), ("home", 60, 2, "Ed", None, "Al Ek", 1), ("home", 85, None, "Bo", None, "Ed", None)], key=lambda r: str((k, *r)))
    assert own("goals") == sorted([("home", 12, None, 1, 0, "Al Ek", "Bo"), ("away", 45, 1, 1, 1, "Fa", None), ("home", 70, None, 2, 1, "Cu", "Bo")], key=lambda r: str((k, *r)))
    assert own("cards") == sorted([("home", "Bo", None, None, "yellow"), ("home", "Cu", 46, None, "second_yellow")], key=lambda r: str((k, *r)))
    assert own("officials") == sorted([("referee", "Ann Ek", "../sr/ek.html"), ("focal_coach", "Cy Do", "../trainer/cy.html"), ("other_coach", "Old Man", None)], key=lambda r: str((k, *r)))
    ((home, away, a, b, c, d, day, kickoff, crowd),) = own("matches")
    assert (home, away, a, b, c, d, str(day), kickoff, crowd) == ("1. FSV A", "SV B", 2, 1, 1, 1, "1999-05-12", "15.30", 12000)


def test_errors_and_retry(spark, output):
    pages, folder = output
    assert rows(spark, folder, "errors") == sorted([(10, "several matches"), (11, "no header"), (12, "no header"), (13, "no header"), (14, "no team tables"), (15, "no team tables")], key=str)
    count = {r["table_name"]: r["n"] for r in job.summary(spark, folder).collect()}
    assert count["matches"] == 7 and count["error: no header"] == 3 and count["players"] == 8
    mended = pages.filter("page_id <> 14").unionByName(spark.createDataFrame([(14, LAYOUTS[1].replace("12 Cu", "12 Cu Two"), "")], pages.schema))
    again = job.retry(mended, folder)
    assert [r[0] for r in rows(spark, again, "errors")] == [10, 11, 12, 13, 15] and sorted(r[0] for r in rows(spark, again, "matches")) == [1, 2, 3, 4, 5, 6, 7, 14]
    assert rows(spark, again, "lineups")[: 8 * 7] != [] and [r for r in rows(spark, again, "lineups") if r[0] == 3] == [r for r in rows(spark, folder, "lineups") if r[0] == 3]
    assert len(rows(spark, again, "players")) == 9 and rows(spark, folder, "errors")[0][0] == 10
    assert job.extracted(pages.filter("false")).count() == 0


def test_team_table_of_its_own_cells(spark):
    html = HEAD + "".join(f'<table width="100%" height="30%"><tr><td>{n} A{n}</td></tr></table>' for n in (1, 2))
    got = job.entries(job.cells(spark.createDataFrame([(1, html)], "page_id int, html string"))).collect()
    assert sorted((r["side"], r["name"], r["number"]) for r in got) == [("away", "A2", 2), ("home", "A1", 1)]


def test_pages_are_read_where_they_lie(spark):
    """A page is one row until it has been read: the pages are shuffled by their id at most once, not at all if they lie by it already, and their tags never."""
    pages = spark.createDataFrame(list(LAYOUTS.items()), "page_id int, html string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for made in (el.tags, job.cells):
        assert plan(made(pages)).count("Exchange hash") == 1 and plan(made(pages)).count("Window [") == 1
    joined = pages.hint("merge").join(pages.select("page_id").hint("merge"), "page_id")
    assert plan(job.cells(joined)).count("Exchange hash") == plan(joined).count("Exchange hash") == 2


def test_pages_with_one_id_are_read_one_after_another(spark):
    halves = [(k, part) for k in range(50) for part in ("<b>A - B 1:0</b>" + "<p>x</p>" * k, "<table><tr><td>1 Al<td>2 Bo</table>")]
    got = el.tags(spark.createDataFrame(halves, "page_id int, html string").repartition(3)).orderBy("page_id", "at").collect()
    want = el.tags(spark.createDataFrame([(k, a + b) for (k, a), (_, b) in zip(halves[::2], halves[1::2], strict=True)], "page_id int, html string")).orderBy("page_id", "at").collect()
    assert got == want and len(got) > 50
    odd = spark.sql("SELECT 1 AS page_id, CAST(concat(CAST('<table><td>1 A' AS BINARY), X'FF') AS STRING) AS html")
    assert [r["text"] for r in job.cells(odd).collect()] == ["1 A�"]


def test_cells_of_a_kind(spark, output):
    every = job.cells(output[0]).collect()
    for kind, test in {"team": lambda r: r["side"], "scorers": lambda r: r["in_goals"], "staff": lambda r: r["in_staff"]}.items():
        assert sorted(map(str, job.cells(output[0], kind).collect())) == sorted(str(r) for r in every if test(r)) != []


def test_substitutions_are_read_once(spark, output):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = io.written(job.cells(output[0]))
    assert plan(job.lineups(job.entries(found), job.substitutions(found))).count("FileScan") == 2


def test_each_table_is_computed_once(spark, output):
    """Line-ups and what they come from are read back, not computed for each table that needs them."""
    made = job.tables(output[0])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert {name: plan(df).count("FileScan") for name, df in made.items()} == {"matches": 1, "officials": 1, "players": 1, "lineups": 1, "substitutions": 1, "goals": 1, "cards": 2, "errors": 1}
    assert [plan(made[name]).count("Generate") for name in ("players", "lineups", "substitutions")] == [0, 0, 0]


def test_tables_of_no_pages(spark, output, tmp_path):
    """A run over no pages replaces what is there by empty tables, which can be read."""
    folder = job.run(output[0].filter("page_id = 1"), f"{tmp_path}/out")
    assert len(rows(spark, folder, "matches")) == 1
    job.run(output[0].filter("false"), folder)
    assert job.summary(spark, folder).collect() == [] and all(job.table(spark, folder, name).count() == 0 for name in job.COLUMNS)
