"""Stored tables with keys: batches are merged into the buckets that they touch.

Rows stand in buckets by a hash of some key columns. A merge reads the buckets in which the batch has rows, writes them anew in a folder of the batch's number, and
then publishes a manifest that says where each bucket is: one rename, before which readers see the table as it was, and after which they see all of the batch. A
batch that comes again, because its task or the driver was lost, replaces what was not published and is passed over if it was, so every batch counts once.
Memory and I/O follow the touched buckets; the driver holds the list of buckets only. vacuum() deletes what no manifest of the table needs any more.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What becomes of two rows of a key: (stored rows, rows of the batch, keys) to the rows that stay.
Rule = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def newest(*order: str) -> Rule:
    """Of rows of a key the one with the largest order stays; of equal ones the batch's. Without an order the batch's."""
    return lambda old, new, keys: _one(old, new, keys, [F.col(c).desc_nulls_last() for c in order] + [F.col("_new").desc()])


def earliest(*order: str) -> Rule:
    """Of rows of a key the one with the smallest order stays, of equal ones the stored one. Without an order the stored one."""
    return lambda old, new, keys: _one(old, new, keys, [F.col(c).asc_nulls_last() for c in order] + [F.col("_new").asc()])


def _one(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    ties = [F.xxhash64(*[c for c in old.columns])]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties))).filter("_r = 1").drop("_r", "_new")


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of the rows of a key are added; keys whose numbers are all 0 go."""
    sums = [c for c in old.columns if c not in keys]
    out = old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).cast(old.schema[c].dataType).alias(c) for c in sums))
    return out.filter(" OR ".join(f"coalesce(`{c}`, 0) <> 0" for c in sums))


def merged(rules: dict[str, str]) -> Rule:
    """A row for each key, each column by its rule: new (the batch's, if it has a value), old (the stored one, if it has), greatest, least, sum."""

    def run(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        a, b = old.alias("a"), new.alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        both = {c: (F.col(f"a.{c}"), F.col(f"b.{c}")) for c in old.columns}
        pick = {"new": lambda x, y: F.coalesce(y, x), "old": lambda x, y: F.coalesce(x, y), "greatest": F.greatest, "least": F.least, "sum": lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)}
        joined = a.join(b, F.lit(True) if not same else _all(same), "full")
        return joined.select(*((pick["new"] if c in keys else pick[rules.get(c, "new")])(*both[c]).cast(old.schema[c].dataType).alias(c) for c in old.columns))

    return run


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class KeyedTable:
    """A table in a folder that the driver and all executors see. by: the keys that choose the bucket (all if not given)."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], buckets: int = 64, by: list[str] | None = None):
        self.spark, self.folder, self.keys, self.buckets, self.by = spark, folder.rstrip("/"), keys, buckets, by or keys
        self.schema = spark.createDataFrame([], schema).schema

    def _file(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict:
        """batch: number of the last one; paths: folder of each bucket that has rows; schema stands with the table."""
        fs, path = self._file("manifest")
        if not fs.exists(path):
            return {"batch": None, "paths": {}}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, part = self._file("manifest.part")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, self._file("manifest")[1], overwrite)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table as last published, or some buckets of it."""
        paths = self.manifest()["paths"]
        return self._read([p for b, p in sorted(paths.items()) if only is None or int(b) in only])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.by]), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets in which the batch has rows: at most as many as the table has."""
        return sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, batch: DataFrame, number: int, rule: Rule) -> list[int]:
        """Merge a batch under its number; the buckets that were written. A number that is not above the last one has been merged already."""
        before = self.manifest()
        if before["batch"] is not None and number <= before["batch"]:
            return []
        touched = self.touched(batch)
        if touched:
            old = self._read([before["paths"][str(b)] for b in touched if str(b) in before["paths"]])
            out = rule(old, batch.select(*self.schema.names), self.keys).select(*self.schema.names)
            rows = out.withColumn("_bucket", self.bucket())
            rows.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/batch={number}")
            fs, top = self._file(f"batch={number}")
            made = {f.getPath().getName() for f in fs.listStatus(top)}
            paths = dict(before["paths"])
            for b in touched:
                paths.pop(str(b), None)
                if f"_bucket={b}" in made:
                    paths[str(b)] = f"batch={number}/_bucket={b}"
            before["paths"] = paths
        self._publish({"batch": number, "paths": before["paths"]})
        return touched

    def vacuum(self) -> int:
        """Delete folders of buckets that the last manifest does not name; how many. No reader of an older state may be at work."""
        fs, top = self._file("")
        named, gone = set(self.manifest()["paths"].values()), 0
        for f in fs.listStatus(top):
            name = f.getPath().getName()
            if name.startswith("batch="):
                inner = [x for x in fs.listStatus(f.getPath()) if x.getPath().getName().startswith("_bucket=")]
                old = [x for x in inner if f"{name}/{x.getPath().getName()}" not in named]
                for x in old:
                    fs.delete(x.getPath(), True)
                gone += len(old)
                if len(old) == len(inner):
                    fs.delete(f.getPath(), True)
        return gone
