"""Exact deduplication by a tree-merge of sorted digest runs.

Each partition sorts the digests of its rows into a run. In every round the partitions that differ in one digit of
their number exchange runs, each keeping the digests whose own digit is its number's, and merge what they get; a merged
run has one entry for each digest, with the smallest identifier and the number of rows so far. After all rounds a
partition holds every entry of its digests. A digest counts as the same only with equal byte length and a second,
independent hash.

Nulls, ties and odd rows: a null text counts as empty. Rows that repeat an id and a text are all part of the group; they
carry the same id and so are all marked kept if it is the smallest. A null id sorts after every other id. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import SPACE, documents, mapped, text_of, written

RUN = "slot int, digest binary, second long, n_bytes long, keep_id long, group_size long"
ENTRY = pa.schema([("slot", pa.int32()), ("digest", pa.binary()), ("second", pa.int64()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
#: Rows whose digests one partition of a round holds on the average.
SLOT_ROWS, LEAST_SLOTS = 2_000_000, 64
#: A group of more than one part in so many of all rows is joined by broadcast; there are fewer such groups than that.
HOT_PARTS = 20_000
LAST = np.iinfo(np.int64).max


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, and what identifies the normalised text: SHA-256, a second hash, length in bytes."""
    normal = docs.select("doc_id", F.regexp_replace(text_of(), SPACE, " ").alias("normal"))
    return normal.select("doc_id", F.unhex(F.sha2("normal", 256)).alias("digest"), F.xxhash64("normal").alias("second"), F.octet_length("normal").cast("long").alias("n_bytes"))


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries arrive in order; equal neighbours become one, with the smallest id and the sum of rows. Holds one batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).cast(ENTRY)
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        n = table.num_rows
        if not n:
            continue
        column = lambda k: table.column(k).to_numpy()
        raw = table.column("digest").to_pylist()
        digest = np.frombuffer(b"".join(raw), np.uint8).reshape(n, 32)
        new = np.ones(n, bool)
        new[1:] = (digest[1:] != digest[:-1]).any(axis=1) | (column("second")[1:] != column("second")[:-1]) | (column("n_bytes")[1:] != column("n_bytes")[:-1])
        first = np.flatnonzero(new)
        merged = table.take(pa.array(first))
        smallest, total = np.minimum.reduceat(column("keep_id"), first), np.add.reduceat(column("group_size"), first)
        merged = merged.set_column(4, ENTRY.field("keep_id"), pa.array(smallest)).set_column(5, ENTRY.field("group_size"), pa.array(total))
        held = merged.slice(len(first) - 1)
        if len(first) > 1:
            yield from merged.slice(0, len(first) - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def merged_runs(keyed: DataFrame, slots: int = 64, radix: int = 8) -> DataFrame:
    """One row for each distinct text: digest, second, n_bytes, keep_id, group_size. slots is rounded up to a power of radix."""
    rounds = 1
    while radix**rounds < slots:
        rounds += 1
    slots = radix**rounds
    home = F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("int") % slots
    runs = keyed.select((F.spark_partition_id() % slots).alias("slot"), "digest", "second", "n_bytes", F.coalesce("doc_id", F.lit(LAST)).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    order = ("digest", "second", "n_bytes")
    runs = mapped(runs.sortWithinPartitions(*order), merge_runs, RUN)
    for k in range(rounds):
        unit = radix**k
        digit = lambda c: F.floor(c / unit).cast("int") % radix  # noqa: E731, B023
        runs = runs.withColumn("slot", (F.col("slot") + (digit(home) - digit(F.col("slot"))) * unit).cast("int"))
        runs = mapped(runs.repartitionById(slots, "slot").sortWithinPartitions(*order), merge_runs, RUN)
    return runs.select("digest", "second", "n_bytes", F.nullif("keep_id", F.lit(LAST)).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, slots: int | None = None, radix: int = 8, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Every row of docs with the row that stays for its text: doc_id, keep_id, group_size, kept, text_sha256.

    Without a number of slots there is one for every SLOT_ROWS rows, LEAST_SLOTS at least. Rows of large groups find their group in a
    broadcast and are not shuffled, so no task gets all rows of one.
    """
    keyed = written(digests(docs), "digests")
    text, n = ["digest", "second", "n_bytes"], keyed.count()
    groups = written(merged_runs(keyed, slots or max(LEAST_SLOTS, -(-n // SLOT_ROWS)), radix), "groups")
    hot = F.broadcast(groups.filter(F.col("group_size") * hot_parts > n))
    rows = keyed.join(hot, text).unionByName(keyed.join(hot.select(*text), text, "left_anti").join(groups, text))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
