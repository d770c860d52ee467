"""Streams of quiz answers: running statistics, sessions, deduplication; those that keep results in tables are in incremental.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sportlake.functions.numbers import points_time
from sportlake.operators.corrections import upsert_latest
from sportlake.sources.archive import Archive
from sportlake.sources.io import shared_folder


def answer_stream(a: Archive, delay: str = "30 days") -> DataFrame:
    """The events table as a stream of answers."""
    schema = a.raw("events").schema
    stream = a.spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*").load(f"{a.folder}/events.parquet*")
    answers = stream.selectExpr("event_id AS answer_id", "user_id AS player", "CAST(event_id % 50 AS INT) AS round_id", "event_type IN ('purchase', 'click') AS is_correct", "CAST(round(value * 100) AS BIGINT) AS time_ms", "event_type AS answer", "CAST(ts AS TIMESTAMP) AS submitted_at")
    return answers.withWatermark("submitted_at", delay)


def run_once(stream: DataFrame, a: Archive, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Drive a stream over all that is there: its output as a table.

    Every batch is written under its number and replaces what an earlier try of it left. Of mode update the newest row of each of the keys
    counts, of mode complete the last batch.
    """
    spark, path = a.spark, shared_folder(a.spark)
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/seen={n}"))
    query.option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(path)
    if mode == "complete":
        return out.join(out.agg(F.max("seen").alias("seen")), "seen", "left_semi").drop("seen")
    return latest(out, keys, "seen").drop("seen") if keys else out.drop("seen")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("_r = 1").drop("_r")


def player_stats(answers: DataFrame) -> DataFrame:
    return answers.groupBy("player").agg(F.count("*").alias("questions"), F.count_if("is_correct").alias("correct"), F.sum("time_ms").alias("time_ms"))


def question_stats(answers: DataFrame, rounds: DataFrame) -> DataFrame:
    joined = answers.join(rounds, "round_id")
    return joined.groupBy("question_id").agg(F.count("*").alias("used"), F.count_if("is_correct").alias("correct"), F.sum("time_ms").alias("time_ms"))


def leaderboard(answers: DataFrame) -> DataFrame:
    return answers.groupBy("player").agg(F.sum(points_time(F.col("is_correct"), F.col("time_ms"))).alias("points"), F.count("*").alias("questions"))


def sessions(answers: DataFrame, gap: str = "1 hour") -> DataFrame:
    """A player's session lasts until so long has passed without an answer.

    In append mode a session is written once, when the watermark has passed its end, and leaves the state; those still open wait there for the next run.
    """
    out = answers.groupBy("player", F.session_window("submitted_at", gap).alias("w")).agg(F.max("submitted_at").alias("last_seen"), F.count("*").alias("messages"))
    return out.select("player", F.col("w.start").alias("started"), "last_seen", "messages")


def sessions_batch(answers: DataFrame, hours: int = 1) -> DataFrame:
    """The batch twin of sessions: islands between gaps."""
    order = Window.partitionBy("player").orderBy("submitted_at", "answer_id")
    gap = F.col("submitted_at") >= F.lag("submitted_at").over(order) + F.make_dt_interval(hours=F.lit(hours))
    rows = answers.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("player", "island").agg(F.min("submitted_at").alias("started"), F.max("submitted_at").alias("last_seen"), F.count("*").alias("messages")).drop("island")


def deduped(answers: DataFrame, keys: list[str]) -> DataFrame:
    return answers.dropDuplicatesWithinWatermark(keys)


def late_batch(answers: DataFrame, delay: str, buckets: int = 1024) -> DataFrame:
    """Marks answers that arrive (by id) after the newest so far by more than the delay.

    The running maximum is taken inside ranges of ids and over the ranges before, so no task holds all rows.
    """
    size = answers.agg(F.max("answer_id").alias("_top"))
    rows = answers.crossJoin(F.broadcast(size)).withColumn("_b", F.floor(F.col("answer_id") * buckets / (F.col("_top") + 1)))
    tops = rows.groupBy("_b").agg(F.max("submitted_at").alias("_t")).select("_b", F.max("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    so_far = F.max("submitted_at").over(Window.partitionBy("_b").orderBy("answer_id").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_so_far", so_far).join(tops, "_b")
    return out.withColumn("late", F.col("submitted_at") < F.greatest("_so_far", "_before") - F.expr(f"INTERVAL {delay}")).drop("_b", "_top", "_so_far", "_before")


def upsert_vectors(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return upsert_latest(base, new, keys)
