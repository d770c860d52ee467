"""Merging entities along chains: a mapping of old to new ids is closed first, then every table follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sportlake.sources.io import written


def resolved(mapping: DataFrame) -> DataFrame:
    """old_id, new_id, problem: where each id ends. mapping: old_id, new_id, in steps that may follow one another.

    Pointers are doubled: each round every id jumps as far again as it has come, so chains of length n take log n rounds. An id that is in a circle, or leads
    into one, ends nowhere: its problem is `circle`, and its new_id NULL. An id with several different targets is `ambiguous`, and what leads to it too. Steps to
    itself and NULLs are left out.
    """
    steps = mapping.filter("old_id IS NOT NULL AND new_id IS NOT NULL AND old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"), (F.min("new_id") != F.max("new_id")).alias("bad"))
    out = written(steps.select("old_id", "new_id", "bad"))
    many, far = out.count(), 1
    while True:
        ahead = out.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_to"), F.col("bad").alias("_bad"))
        joined = out.join(ahead, "new_id", "left")
        moved = joined.select("old_id", F.coalesce("_to", "new_id").alias("new_id"), (F.col("bad") | F.coalesce("_bad", F.lit(False))).alias("bad"), F.col("_to").isNotNull().alias("open"))
        moved = written(moved)
        out, far = moved.select("old_id", "new_id", "bad"), far * 2
        still = moved.filter("open").count()
        if not still or far > 2 * many:  # longer than any chain: what is still on its way goes round
            break
    problem = F.when(F.col("open"), "circle").when(F.col("bad"), "ambiguous")
    return moved.select("old_id", F.when(problem.isNull(), F.col("new_id")).alias("new_id"), problem.alias("problem"))


def merged(tables: dict[str, tuple[DataFrame, list[str]]], entities: DataFrame, key: str, closed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables with their columns repointed, and the entities without those that were merged into others. closed: as from resolved(); ids with a problem stay as they are, and so do ids whose target is no entity."""
    to = targets(entities, key, closed)
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(to.select(F.col("old_id").alias(c), F.col("new_id").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new").select(*df.columns)
        out[name] = df
    return out, entities.join(to.select(F.col("old_id").alias(key)), key, "left_anti").select(*entities.columns)


def targets(entities: DataFrame, key: str, closed: DataFrame) -> DataFrame:
    """The steps that can be taken: those without a problem whose target is an entity."""
    return closed.filter("problem IS NULL").select("old_id", "new_id").join(entities.select(F.col(key).alias("new_id")).distinct(), "new_id", "left_semi")


def plan(tables: dict[str, tuple[DataFrame, list[str]]], entities: DataFrame, key: str, closed: DataFrame) -> DataFrame:
    """What merged() would do, without doing it: table_name, column_name, rows; rows that would be repointed, entities that would go, ids that cannot be merged."""
    to = targets(entities, key, closed)
    line = lambda df, name, column: df.agg(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.count("*").alias("rows"))
    out = line(entities.join(to.select(F.col("old_id").alias(key)), key, "left_semi"), "entities", key)
    for what in ("circle", "ambiguous"):
        out = out.unionByName(line(closed.filter(F.col("problem") == what), "problems", what))
    lost = closed.filter("problem IS NULL").join(to.select("old_id"), "old_id", "left_anti")
    out = out.unionByName(line(lost, "problems", "no such entity"))
    for name, (df, columns) in tables.items():
        for c in columns:
            out = out.unionByName(line(df.join(to.select(F.col("old_id").alias(c)), c, "left_semi"), name, c))
    return out
