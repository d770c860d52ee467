"""Reading and writing tables, reports and derived tables."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the driver and all executors see (spark.checkpoint.dir). A local session without one gets one of our own; a cluster needs it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="sportlake-"))
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a shared folder: later reads do not recompute it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def coerce_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """German or ISO date text to dates; impossible dates become NULL."""
    return df.withColumns({c: F.coalesce(F.try_to_date(c, "d.M.yyyy"), F.try_to_date(c, "yyyy-MM-dd")) for c in columns})


def coerce_booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("boolean") for c in columns})


def load_tables(tables: dict[str, DataFrame], database: str) -> DataFrame:
    """Write each table into a database, in a folder of its own; table_name and rows of what was written."""
    out = None
    for name, df in tables.items():
        spark = df.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        df.write.mode("overwrite").option("path", shared_folder(spark)).saveAsTable(f"{database}.{name}")
        part = spark.table(f"{database}.{name}").agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def load_in_order(tables: dict[str, DataFrame], parents: dict[str, list[str]], database: str) -> DataFrame:
    """load_tables with every table after those that it refers to (parents by table): table_name, place, rows.

    Tables without order among them go by name. A circle of references is an error before anything is written; a parent that is not loaded is no bar.
    """
    sorter, order = TopologicalSorter({t: [p for p in parents.get(t, []) if p in tables and p != t] for t in sorted(tables)}), []
    sorter.prepare()
    while ready := sorted(sorter.get_ready()):
        order += ready
        sorter.done(*ready)
    loaded = load_tables({name: tables[name] for name in order}, database)
    return loaded.withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("table_name")).cast("int"))


def catalogue(spark: SparkSession, database: str) -> DataFrame:
    """table_name, column_name, type, position of all tables of a database, with the rows of the table; views that are not stored are left out."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    columns = [(t, c.name, c.dataType, k) for t in names for k, c in enumerate(spark.catalog.listColumns(f"{database}.{t}"), 1)]
    listed = spark.createDataFrame(columns, "table_name string, column_name string, type string, position int")
    counts = [spark.table(f"{database}.`{t}`").agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")) for t in names]
    return listed.join(reduce(DataFrame.unionByName, counts), "table_name") if counts else listed.withColumn("rows", F.lit(0).cast("long"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "").csv(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    """df written as CSV to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("nullValue", "").csv(path)


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def report_round_trip(df: DataFrame) -> DataFrame:
    """Findings saved as JSON between stages and read with their schema."""
    path = shared_folder(df.sparkSession)
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def materialize(name: str, df: DataFrame) -> DataFrame:
    """Write a derived table to a new folder, then point the view of its name there in one step: view_name, rows, seconds. Readers of the old one are not disturbed, and at no time is there none."""
    spark, began, path = df.sparkSession, time.time(), shared_folder(df.sparkSession)
    df.write.parquet(path)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    return spark.table(name).agg(F.lit(name).alias("view_name"), F.count("*").alias("rows"), F.lit(time.time() - began).alias("seconds"))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def by_decade(df: DataFrame, column: str) -> DataFrame:
    """df written in partitions by decade of a date, and read back so that decades can be pruned."""
    path = shared_folder(df.sparkSession)
    df.withColumn("decade", (F.floor(F.year(column) / 10) * 10).cast("int")).write.partitionBy("decade").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Text up to the first semicolon outside quotes and comments.
_STATEMENT = re.compile(r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])*""", re.DOTALL)


def guarded_sql(spark: SparkSession, text: str, limit: int = 200, **tables: DataFrame) -> DataFrame:
    """The first statement of a user's SQL, if it is a SELECT, with at most limit rows. Tables stand in the text as {name}; semicolons in quotes and comments end nothing."""
    first = _STATEMENT.match(text).group().strip()
    if not first.lower().startswith("select"):
        raise ValueError("only SELECT is allowed")
    return spark.sql(first, **tables).limit(limit)
