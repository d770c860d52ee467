"""Streams that keep their results in keyed tables: each batch reads its own rows and what they touch, and counts once however often it is tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.sources.io import shared_folder
from sportlake.sources.keyed import KeyedTable, Rule, added, earliest, newest


def drive(stream: DataFrame, step, folder: str | None = None) -> None:  # noqa: ANN001
    """Run step(batch, number) on every batch of what is there. folder: of the checkpoint, so that a later call goes on from here."""
    spark = stream.sparkSession
    stream.writeStream.foreachBatch(step).option("checkpointLocation", folder or shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()


def one_of_each(stream: DataFrame, keys: list[str], order: list[str], last: bool = False, buckets: int = 64, folder: str | None = None) -> DataFrame:
    """The first row of each key by order, or the last, whenever it comes: no horizon, and no state but the stored table."""
    table = KeyedTable(stream.sparkSession, folder or shared_folder(stream.sparkSession), stream.schema, keys, buckets)
    rule: Rule = newest(*order) if last else earliest(*order)
    drive(stream, lambda batch, n: table.merge(batch, n, rule))
    return table.read()


class Totals:
    """Sums and counts of groups over rows with keys, kept up to date: of a row that changes, what it gave before is taken back.

    sums: name to expression; the count of rows stands in `n`. A group without rows is gone. Every batch reads the stored rows of the buckets that it touches
    and the groups of its changes. What a batch changes is written first, under its number, so a batch that breaks off between the two tables ends as if it had not.
    """

    def __init__(self, spark: SparkSession, schema, keys: list[str], groups: list[str], sums: dict[str, Column], order: list[str] | None = None, folder: str | None = None, buckets: int = 64):  # noqa: ANN001
        self.spark, self.folder, self.groups, self.sums = spark, folder or shared_folder(spark), groups, sums
        self.rows = KeyedTable(spark, f"{self.folder}/rows", schema, keys, buckets)
        self.rule = newest(*(order or []))
        shape = self._partial(spark.createDataFrame([], self.rows.schema), 1).schema
        self.totals = KeyedTable(spark, f"{self.folder}/totals", shape, groups, buckets)

    def _partial(self, rows: DataFrame, sign: int) -> DataFrame:
        return rows.groupBy(*self.groups).agg((F.count("*") * sign).alias("n"), *((F.sum(e) * sign).alias(name) for name, e in self.sums.items()))

    def step(self, batch: DataFrame, number: int) -> None:
        change = f"{self.folder}/changes/batch={number}"
        state = self.totals.manifest()["batch"]
        if state is not None and number <= state:
            return
        done = self.rows.manifest()["batch"]
        if done is None or number > done:  # else the change of this batch stands written
            batch = batch.select(*self.rows.schema.names)
            batch.write.mode("overwrite").parquet(f"{self.folder}/input/batch={number}")  # a stream's batch is read several times
            batch = self.spark.read.schema(self.rows.schema).parquet(f"{self.folder}/input/batch={number}")
            old = self.rows.read(self.rows.touched(batch)).join(batch.select(*self.rows.keys).distinct(), self.rows.keys, "left_semi").select(*self.rows.schema.names)
            new = self.rule(old, batch, self.rows.keys)
            delta = self._partial(old, -1).unionByName(self._partial(new, 1))
            added(delta, delta.limit(0), self.groups).write.mode("overwrite").parquet(change)
            self.rows.merge(batch, number, self.rule)
        self.totals.merge(self.spark.read.schema(self.totals.schema).parquet(change), number, added)

    def read(self) -> DataFrame:
        return self.totals.read()


def late_split(stream: DataFrame, time: str, delay: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that came in time, and those that came later than the delay after the newest of the batches before: together all rows. Rows without a time are in time."""
    spark, path = stream.sparkSession, folder or shared_folder(stream.sparkSession)
    wait = F.expr(f"INTERVAL {delay}")

    def step(batch: DataFrame, n: int) -> None:
        before = _newest_before(spark, f"{path}/newest", n)
        late = F.lit(False) if before is None else F.coalesce(F.col(time) < F.lit(before) - wait, F.lit(False))
        batch.withColumn("_late", late).write.mode("overwrite").partitionBy("_late").parquet(f"{path}/rows/batch={n}")
        batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={n}")

    drive(stream, step)
    try:
        rows = spark.read.schema(stream.schema.add("_late", "boolean").add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    except Exception as e:  # no batch has run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], stream.schema).withColumn("_late", F.lit(False)).withColumn("batch", F.lit(0))
    return rows.filter("NOT _late").drop("_late", "batch"), rows.filter("_late").drop("_late", "batch")


def _newest_before(spark: SparkSession, path: str, n: int):  # noqa: ANN202
    """The newest time of the batches before n; None if there is none."""
    if n == 0:
        return None
    seen = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") < n)
    return seen.agg(F.max("newest")).first()[0]


# --- streaks from mergeable runs ------------------------------------------------------------------------------------------


def block_runs(answers: DataFrame, width: str = "1 hour") -> DataFrame:
    """player, block, n, misses, lead, trail, best: runs of right answers in each stretch of time of a player. Stretches side by side combine into longer ones, so no task needs all answers of a player."""
    rows = answers.withColumn("block", F.window("submitted_at", width).start)
    in_order = Window.partitionBy("player", "block").orderBy("submitted_at", "answer_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum(F.when(F.col("is_correct"), 0).otherwise(1)).over(in_order))
    runs = rows.groupBy("player", "block", "run").agg(F.count_if("is_correct").alias("right"), F.count("*").alias("n"))
    return runs.groupBy("player", "block").agg(
        F.sum("n").alias("n"), F.max("run").cast("long").alias("misses"), F.coalesce(F.max(F.when(F.col("run") == 0, F.col("right"))), F.lit(0)).alias("lead"), F.max_by("right", "run").alias("trail"), F.max("right").alias("best")
    )


def combined(a: Column, b: Column) -> Column:
    """The runs of a stretch followed by another; associative."""
    joined = a["trail"] + b["lead"]
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["misses"] + b["misses"]).alias("misses"), F.when(a["misses"] == 0, joined).otherwise(a["lead"]).alias("lead"),
        F.when(b["misses"] == 0, joined).otherwise(b["trail"]).alias("trail"), F.greatest(a["best"], b["best"], joined).alias("best"),
    )


RUN = ("n", "misses", "lead", "trail", "best")


def longer(runs: DataFrame, by: list[Column], order: str = "block") -> DataFrame:
    """The runs of stretches that belong together, by keys, in order: one row for each."""
    parts = F.array_sort(F.collect_list(F.struct(order, *RUN)))
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in RUN))
    fold = F.aggregate("parts", zero, combined)
    return runs.groupBy(*by).agg(parts.alias("parts"), F.min(order).alias(order)).withColumn("x", fold).drop("parts").select("*", "x.*").drop("x")


def streaks_of(runs: DataFrame) -> DataFrame:
    """player, current_streak, best_streak, folded by day and then by player: no cell holds more than the hours of a day or the days of a player."""
    days = longer(runs, [F.col("player"), F.to_date("block").alias("day")])
    every = longer(days.select("player", "block", *RUN), [F.col("player")])
    return every.select("player", F.col("trail").alias("current_streak"), F.col("best").alias("best_streak"))


class Streaks:
    """Streaks kept up to date: answers stand in stretches of time, and a batch reads those stretches that it touches, so late answers count where they belong."""

    def __init__(self, spark: SparkSession, folder: str | None = None, width: str = "1 hour", buckets: int = 64):
        self.spark, self.folder, self.width = spark, folder or shared_folder(spark), width
        shape = "player long, block timestamp, submitted_at timestamp, answer_id long, is_correct boolean"
        self.answers = KeyedTable(spark, f"{self.folder}/answers", shape, ["player", "block", "answer_id"], buckets, by=["player", "block"])
        self.runs = KeyedTable(spark, f"{self.folder}/runs", "player long, block timestamp, n long, misses long, lead long, trail long, best long", ["player", "block"], buckets, by=["player"])

    def step(self, batch: DataFrame, number: int) -> None:
        rows = batch.select("player", F.window("submitted_at", self.width).start.alias("block"), "submitted_at", "answer_id", "is_correct")
        rows.write.mode("overwrite").parquet(f"{self.folder}/input/batch={number}")
        rows = self.spark.read.schema(self.answers.schema).parquet(f"{self.folder}/input/batch={number}")
        self.answers.merge(rows, number, newest())
        touched = self.answers.read(self.answers.touched(rows)).join(rows.select("player", "block").distinct(), ["player", "block"], "left_semi")
        self.runs.merge(block_runs(touched, self.width), number, newest())

    def read(self) -> DataFrame:
        return streaks_of(self.runs.read())
