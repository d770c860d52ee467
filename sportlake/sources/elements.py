"""Pages as rows of tags, and the tables and cells that they stand in.

A page is cut at its tags and walked through once with a stack of the open tables and the cell of each that was opened last. Cells and rows that are
never closed end where the next one begins, and a closing tag without an opening one is passed over. A page is one row and is read where it lies,
so tags are neither shuffled nor sorted; only pages with the same id are brought together, and read as one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Named characters of pages.
NAMED = {"nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}
#: Pages that are read at a time, so that their rows stay few.
PAGES = 500
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9]*)")
_BLANKS = re.compile(r"[ \t-\r]+")
#: Texts of a page without any of these change at their ends alone.
_ODD = ("&", "\u00a0", "  ", *"\t\n\v\f\r")
_VALUES = {name: [re.compile(rf"\b{name}[ \t-\r]*=[ \t-\r]*{q}", re.IGNORECASE) for q in ('"([^"]*)"', r"'([^']*)'", r"([^ \t-\r\"'>]+)")] for name in ("width", "height", "href", "src")}


def unescaped(text: str) -> str:
    """Named characters as what they stand for; blanks that do not break as blanks; single blanks."""
    if "&" in text:
        for name, plain in NAMED.items():
            text = text.replace(f"&{name};", plain)
    return _BLANKS.sub(" ", text.replace("\u00a0", " ")).strip(" ")


@lru_cache(maxsize=10_000)
def attribute(attrs: str, name: str) -> str | None:
    """The value of an attribute in a tag, in quotes of either kind or in none; None without it."""
    return next((found[1] for found in (p.search(attrs) for p in _VALUES[name]) if found and found[1]), None)


@lru_cache(maxsize=10_000)
def tag_of(attrs: str) -> tuple[str | None, bool]:
    """Of what stands after a bracket the tag and whether it closes; None if the bracket opens none."""
    found = _NAME.match(attrs)
    return (found[2].lower(), found[1] != "") if found else (None, False)


def tree(html: str, every: bool = True) -> list[tuple]:
    """The rows of a page as tags() gives them; the first stands for what comes before any tag. every: if not, rows without text go that open no cell, link or picture and are no table or bold."""
    if "<!--" in html:
        html = _COMMENT.sub(" ", html)
    odd = any(x in html for x in _ODD)
    before, *parts = html.split("<")
    rows, around, depth, table_at, cell_at = [(0, None, False, None, unescaped(before), 0, None, None, None)], [], 0, None, None
    for at, part in enumerate(parts, 1):
        attrs, _, text = part.partition(">")
        tag, closing = tag_of(attrs)
        if tag is None:
            attrs, text = None, "<" + part
        if text:
            text = unescaped(text) if odd else text.strip(" ")
        parent_at = None
        if tag == "td" or tag == "tr" or tag == "th":
            if closing and tag == "tr" and not text:
                continue
            if depth:
                cell_at = at if tag == "td" and not closing else None
            if not (text or every or cell_at):
                continue
        elif tag == "a":
            if closing and not text:
                continue
        elif tag == "table":
            if not closing:
                around.append((table_at, cell_at))
                parent_at, table_at, cell_at = table_at, at, None
                depth += 1
            elif depth:
                table_at, cell_at = around.pop()
                depth -= 1
        rows.append((at, tag, closing, attrs, text, depth, table_at, parent_at, cell_at))
    return rows


def together(pages: DataFrame, key: str) -> DataFrame:
    """key and html, as bytes, of each page; pages with the same key one after another as one, null as empty. What is dealt out by the key already is not shuffled again."""
    page = Window.partitionBy(key)
    rows = pages.select(key, F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(key, "row", F.min("row").over(page).alias("first"), F.collect_list("html").over(page).alias("all")).filter("row = first")
    return rows.select(key, F.when(F.size("all") > 1, F.array_join(F.sort_array("all"), "")).otherwise(F.col("all")[0]).cast("binary").alias("html"))


def arrow(values: Sequence, kind: pa.DataType) -> pa.Array:
    """values as an Arrow array; lists of tuples as lists of structs, field by field."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    fields = list(kind.value_type)
    columns = list(zip(*chain.from_iterable(values), strict=True)) or [()] * len(fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), pa.StructArray.from_arrays([arrow(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))


def by_page(pages: DataFrame, key: str, read: Callable[[str], tuple], columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """key, and for each page what read makes of it. columns: name, and type for Spark and for Arrow. Bytes that are no text count as the sign for that."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                part = batch.slice(start, PAGES)
                found = zip(*(read(html.decode(errors="replace")) for html in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(arrow(x, kind) for x, (_, kind) in zip(found, columns.values(), strict=True))], [key, *columns])

    rows = together(pages, key)
    return rows.mapInArrow(some, ", ".join([f"`{key}` {rows.schema[key].dataType.simpleString()}", *(f"{name} {kind}" for name, (kind, _) in columns.items())]))


ROWS = {"rows": ("array<struct<at:int,tag:string,closing:boolean,attrs:string,text:string,depth:int,table_at:int,parent_at:int,cell_at:int>>", pa.list_(pa.struct([("at", pa.int32()), ("tag", pa.string()), ("closing", pa.bool_()), ("attrs", pa.string()), ("text", pa.string()), *((x, pa.int32()) for x in ("depth", "table_at", "parent_at", "cell_at"))])))}


def tags(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, at, tag, closing, attrs, text (what follows the tag), depth, table_at, parent_at, cell_at of every tag; a page without any, or null, is one row without a tag.

    at: the tag's place in the page. table_at: the innermost table that the row stands in, by the place of its opening tag (of such a tag the table
    itself); parent_at: for opening tags of tables, the table around it. cell_at: the cell of that table, by the place of its opening tag.
    """
    return by_page(pages, key, lambda html: (tree(html),), ROWS).select(key, F.inline("rows"))
