"""Bringing one archive into another: entities, then matches, then events, published at once.

Source and target number their rows each for themselves, so rows meet by natural keys: teams, players, competitions and seasons by name, matches by date and
both teams. What the target lacks is created with new ids, in an order that depends on the names alone. Every table is staged in dependency order, and one
manifest then names all of them: before it, and if a stage fails, the target is as it was. Run again, a sync that has been published creates nothing. Ids are 0 or
more.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.operators.corrections import assign_ids
from sportlake.sources.io import shared_folder

#: Entities by name: id and the column that names them.
ENTITIES = {"teams": ("team_id", "normalized_name"), "players": ("player_id", "normalized_name"), "competitions": ("competition_id", "name"), "seasons": ("season_id", "label")}
#: Columns of matches and events that hold ids of entities.
MATCH_REFS = {"season_id": "seasons", "competition_id": "competitions", "home_team_id": "teams", "away_team_id": "teams"}
MATCH_KEY = ["match_date", "home_team_id", "away_team_id"]
EVENTS = {"lineups": ["player_id"], "goals": ["player_id", "assist_player_id"], "cards": ["player_id"], "substitutions": ["player_on_id", "player_off_id"]}


class Snapshot:
    """Tables in a folder that all see, of which a manifest names those that count."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def paths(self) -> dict[str, str]:
        fs, path = self._at("manifest")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.paths()[name]}")

    def stage(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        """Write a table that does not count yet: its path, and what was written."""
        path = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{path}")
        return path, self.spark.read.schema(df.schema).parquet(f"{self.folder}/{path}")

    def publish(self, paths: dict[str, str]) -> None:
        """From now on these paths count, and for tables not named the ones before; in one rename."""
        fs, part = self._at("manifest.part")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(self.paths() | paths).encode()))
        stream.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        overwrite[0] = jvm.Options.Rename.OVERWRITE
        jvm.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, self._at("manifest")[1], overwrite)

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None) -> Snapshot:
        out = cls(spark, folder or shared_folder(spark))
        out.publish({name: out.stage(name, df)[0] for name, df in tables.items()})
        return out


def entity_ids(source: DataFrame, target: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """source_id, target_id of the source's entities, and the target's entities with those that it lacked. A name that several entities share goes to the smallest id; one without a name is left out."""
    named = lambda df: df.select(F.col(name).alias("normalized_name"), F.col(key).cast("long").alias(key)).filter("normalized_name IS NOT NULL")
    ids = assign_ids(named(source), named(target), key)
    pairs = named(source).join(ids.withColumnRenamed(key, "target_id"), "normalized_name").select(F.col(key).alias("source_id"), "target_id").distinct()
    fresh = source.filter(F.col(name).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(key))).filter("_r = 1").drop("_r")
    fresh = fresh.join(target.select(name).distinct(), name, "left_anti").join(ids.select(F.col("normalized_name").alias(name), F.col(key).alias("_id")), name)
    fresh = fresh.withColumn(key, F.col("_id").cast(target.schema[key].dataType))
    return pairs, target.unionByName(fresh.select(*target.columns))


def repointed(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The column's ids as the target has them; an id that has none becomes -1, a NULL stays."""
    to = ids.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"))
    out = df.join(to, F.col(column) == F.col("_from"), "left")
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce(F.col("_to"), F.lit(-1))).cast(df.schema[column].dataType)).drop("_from", "_to")


def lost(columns: list[str]) -> Column:
    """Some column points to nothing."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.col(c), F.lit(0)) == -1)
    return out


def full_sync(source: dict[str, DataFrame], target: Snapshot, fail_at: str | None = None) -> DataFrame:
    """Bring every table of source into target: table_name, created, kept, skipped (rows that point to nothing, and events of matches whose target has events already).

    source: teams, players, competitions, seasons, matches and event tables, of which any may be missing. fail_at: a stage that breaks off, for tests.
    """
    spark, staged, report, ids = target.spark, {}, [], {}

    def stage(name: str, df: DataFrame, created: int, skipped: int) -> DataFrame:
        if name == fail_at:
            raise RuntimeError(f"stage {name} broke off")
        staged[name], out = target.stage(name, df)
        n = out.count()
        report.append((name, created, n - created, skipped))
        return out

    for name, (key, column) in ENTITIES.items():
        if name in source:
            before = target.read(name)
            ids[name], after = entity_ids(source[name], before, key, column)
            _, ids[name] = target.stage(f"ids-{name}", ids[name])
            missing = source[name].filter(F.col(column).isNull()).count()
            stage(name, after, source[name].select(column).filter(F.col(column).isNotNull()).distinct().join(before.select(column), column, "left_anti").count(), missing)
    if "matches" in source:
        rows = source["matches"].withColumn("source_id", F.col("match_id"))
        for c, of in MATCH_REFS.items():
            rows = repointed(rows, c, ids[of]) if of in ids else rows
        before = target.read("matches")
        refs = list(MATCH_REFS)
        good = rows.filter(~lost(refs) & F.concat(*[F.col(c).cast("string") for c in MATCH_KEY]).isNotNull())
        name = F.concat_ws("|", *[F.col(c).cast("string") for c in MATCH_KEY])
        ids["matches"], _ = entity_ids(good.withColumn("normalized_name", name), before.withColumn("normalized_name", name), "match_id", "normalized_name")
        _, ids["matches"] = target.stage("ids-matches", ids["matches"])
        first = good.withColumn("_r", F.row_number().over(Window.partitionBy(*MATCH_KEY).orderBy("source_id"))).filter("_r = 1")
        fresh = first.join(before.select(*MATCH_KEY).distinct(), MATCH_KEY, "left_anti").drop("match_id").join(ids["matches"].withColumnRenamed("target_id", "match_id"), "source_id")
        fresh = fresh.select(*[F.col(c).cast(before.schema[c].dataType).alias(c) for c in before.columns])
        _, fresh = target.stage("fresh-matches", fresh)
        stage("matches", before.unionByName(fresh), fresh.count(), rows.count() - good.count())
    for name, people in EVENTS.items():
        if name in source and "matches" in ids:
            before = target.read(name)
            rows = repointed(source[name], "match_id", ids["matches"])
            for c in people:
                rows = repointed(rows, c, ids["players"]) if "players" in ids else rows
            good = rows.filter(~lost(["match_id", *people])).join(before.select("match_id").distinct(), "match_id", "left_anti")
            good = good.select(*[F.col(c).cast(before.schema[c].dataType).alias(c) for c in before.columns]).distinct()
            _, fresh = target.stage(f"fresh-{name}", good)
            created = fresh.count()
            stage(name, before.unionByName(fresh), created, rows.count() - created)
    target.publish(staged)
    return spark.createDataFrame(report, "table_name string, created long, kept long, skipped long")
