"""Helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: A word is a run of characters other than space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, as in tests, a folder of our own serves a local session; a cluster needs the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="sportlake-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later reads neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = f"{_SCRATCH.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Delete the tables that operators have written so far; to be called once their results have been used."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write meanwhile are deleted at the end, so their results have to be written elsewhere before that. Other threads are not affected."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        _delete(spark, folder)


#: Columns that operators read by name; in operators that keep all columns the others go under names of their own.
READ = ("doc_id", "text", "source", "n_chars")


def keeps_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return the columns of docs: whatever names further columns have, they clash with none used inside."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        return operator(docs.toDF(*[c if c in READ else f"other_{k}" for k, c in enumerate(docs.columns)]), *args, **more).toDF(*docs.columns)

    return run


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow whose tasks give free memory back when they end: their worker processes live on, and executors have several."""

    def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(thrifty, schema)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows at most go to Python tasks that start meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def comparable(df: DataFrame) -> list[Column]:
    """The columns of df as hashing and ordering take them: those that hold a map or a variant, which have no order, as JSON."""

    def unordered(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return any(unordered(f.dataType) for f in kind)
        return unordered(kind.elementType) if isinstance(kind, ArrayType) else isinstance(kind, MapType | VariantType)

    return [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))).alias(f.name) if unordered(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


# --- byte and word hashes of whole batches of texts -------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base & (2**64 - 1), np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MULT
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of byte j times base**j over j < i; differences give the hash of any substring."""
    up, _ = _powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start to end, the same wherever they stand."""
    _, down = _powers(len(h))
    return mix64((h[end] - h[start]) * down[start])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_bytes(text: str | None, lower: bool = False) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _LOWER[data] if lower else data


def word_hashes(data: np.ndarray) -> np.ndarray:
    start, end = word_spans(data)
    return span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
