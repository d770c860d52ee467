"""Which entities a text names: the whole name or one of its longer words stands anywhere in it, inside longer words too.

Names are sought in the different words of all texts together, not in the texts: a word that stands in a million of them is looked at once. Names
made of short words only ("FC 05") can begin and end inside words, so the short words between two longer ones count as one unit, with the
two letters on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sportlake.functions.text import normalize_name

#: Words of a name that stand for it, from this length on.
LONG = 3
#: A longer word: its first two and its last two letters.
ENDS = r"\b(?=([a-z0-9]{2})[a-z0-9])[a-z0-9]+([a-z0-9]{2})\b"


def patterns(entities: DataFrame) -> DataFrame:
    """entity_id, pattern: the words of three letters or more, or the whole name where it has none; a name without letters has no pattern."""
    rows = entities.select("entity_id", normalize_name(F.col("name")).alias("_name")).filter("_name <> ''")
    words = F.filter(F.split("_name", " "), lambda w: F.length(w) >= LONG)
    return rows.select("entity_id", F.explode(F.when(F.size(words) > 0, F.array_distinct(words)).otherwise(F.array("_name"))).alias("pattern"))


def units(plain: Column) -> Column:
    """The different words of a normalised text, and its runs of short words with the ends of the longer ones around them."""
    runs = F.filter(F.split(F.regexp_replace(plain, ENDS, "$1|$2"), r"\|"), lambda x: x.contains(" "))
    return F.filter(F.array_distinct(F.concat(F.split(plain, " "), runs)), lambda x: x != "")


def grams(c: Column, sizes: Column) -> Column:
    """The different pieces of a text of those lengths; a shorter text is its own."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: c.substr(i, n)))))


def found(vocabulary: DataFrame, sought: DataFrame) -> DataFrame:
    """unit, pattern: the units that hold a pattern. Each pattern is looked up by its rarest piece of three letters, and what that gives is compared."""
    pieces = vocabulary.select("unit", F.explode(grams(F.col("unit"), F.array(*map(F.lit, range(1, LONG + 1))))).alias("gram"))
    own = sought.select("pattern", F.explode(grams(F.col("pattern"), F.array(F.least(F.length("pattern"), F.lit(LONG))))).alias("gram"))
    known = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    anchors = own.join(known, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("x")).select("pattern", "x.gram")
    return pieces.join(anchors, "gram").filter(F.col("unit").contains(F.col("pattern"))).select("unit", "pattern")


def resolve(texts: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """key, entity_id of every entity (entity_id, name) that a text (key, text) names, each once.

    Both are compared without accents and marks, in lower case. Null and empty texts name nobody, null and empty names are named nowhere; repeated
    rows count once; a null key is a key. Texts are read twice: for their vocabulary, and for where its matching units stand.
    """
    plain = texts.select(key, normalize_name(F.col("text")).alias("_plain"))
    of = plain.select(key, F.explode(units(F.col("_plain"))).alias("unit"))
    wanted = patterns(entities)
    hits = found(of.select("unit").distinct(), wanted.select("pattern").distinct())
    named = of.join(hits, "unit").select(key, "pattern").distinct()
    return named.join(wanted, "pattern").select(key, "entity_id").distinct()
