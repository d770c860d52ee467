"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source stand in one shuffled stream, cut into blocks of equally many words. A van der Corput point of
each slot, mapped through the cumulative slot counts of the sources, names the slot's source; the rank of a slot among
those of its source names the block it takes, the stream starting over after its last block. The last slot of a source
is cut where its target is met, slots beyond are left out, and a source that the schedule leaves a few slots short gets
them at the end. Slots joined with the pieces of documents in their blocks are the mix: what it takes from a document is the sum
over its pieces, and the mixed documents stand in the order of their slots, so that any stretch of them is near the target weights.

Ranks and places in the streams come from sums over small groups (hash prefixes, chunks of slots) and then inside each
group, so no source has to stand in one task. Only totals come to the driver.

Nulls, ties and odd rows: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in
order. Rows with the same doc_id are separate rows of the stream, told apart by their place in it. In the mixed documents, rows with
null or repeated ids are taken each for themselves, told apart by a hash of all their columns; wholly equal rows share what they
take. An empty table, or one without words, gives targets of 0. Further columns, whatever their names, are ignored by mixed() and kept
by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.llm.common import WORD, comparable, documents, keeps_columns, text_of, written

SHARES = (3, 1, 2)
TOTAL = 1.5
MOST = 2
BLOCK = 4096
BITS = 48


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", *more, "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, shares: tuple[int, ...] = SHARES, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of total times all words, none above most times its source, the excess reshared by weight.

    One row a source: sources in order of the multiple of their weight at which they are full; those full before the level is reached stop there.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("place", F.row_number().over(named)).withColumn("w", F.element_at(F.array(*map(F.lit, shares)), ((F.col("place") - 1) % len(shares) + 1).cast("int")).cast("double"))
    by = by.withColumn("most", (F.col("source_size") * most).cast("double"))
    full = Window.orderBy(F.col("most") / F.col("w"), "place")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    by = by.withColumn("all", F.sum("source_size").over(every) * F.lit(float(total)))
    by = by.withColumn("is_full", F.col("most") <= F.col("w") * ((F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)))
    left = F.col("all") - F.sum(F.when(F.col("is_full"), F.col("most")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("w"))).over(every)
    return by.withColumn("target", F.when(F.col("is_full"), F.col("most")).otherwise(F.col("w") * (left / open_w))).select("place", "source", "source_size", "target")


def stream_places(rows: DataFrame, seed: int = 17, *more: str) -> DataFrame:
    """Adds `at`: how many words of the same source (`place`) come before the row in its shuffled stream. more: columns that break ties."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("size")))))
    rows = rows.filter("size > 0").withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    before = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("place", "part").agg(F.sum("size").alias("n")).select("place", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("place", "part").orderBy("key", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(parts, ["place", "part"]).select("doc_id", *more, "place", "size", (F.col("base") + F.col("within")).alias("at"))


def schedule(spark: SparkSession, needs: DataFrame, n: int, chunk: int = 4096) -> DataFrame:
    """slot, place, rank: n slots in low-discrepancy order. needs: place, slots (their sum is n)."""
    below = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    needs = needs.filter("slots > 0")
    spans = needs.withColumn("low", F.coalesce(F.sum("slots").over(below), F.lit(0))).withColumn("high", F.col("low") + F.col("slots"))
    width = max(1, n // 4096)
    cells = spans.select("place", "slots", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("cell"))
    mirrored = F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("double")
    points = spark.range(n).select(F.col("id").alias("slot"), F.floor(mirrored / F.lit(float(2**BITS)) * n).alias("point")).withColumn("cell", F.expr(f"point div {width}"))
    dealt = points.join(cells, "cell").filter("point >= low and point < high").select("slot", "place", "slots", F.expr(f"slot div {chunk}").alias("chunk"))
    counts = dealt.groupBy("place", "chunk").count()
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("place", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("place", "chunk").orderBy("slot")
    ranked = dealt.withColumn("within", F.row_number().over(inner) - 1).join(base, ["place", "chunk"]).withColumn("rank", F.col("base") + F.col("within")).filter("rank < slots")
    short = needs.join(counts.groupBy("place").agg(F.sum("count").alias("got")), "place", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).filter("got < slots")
    late = short.select("place", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "place", "rank")
    return ranked.select("slot", "place", "rank").unionByName(late)


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """Every row with the words that the mix takes from it: doc_id, source, size, source_size, target, taken.

    Passes over a document are whole but the last, which takes its first words.
    """
    pieces, at, rows, targets = _pieces(docs, block, seed)
    taken = pieces.groupBy("place", "at").agg(F.sum("words").alias("taken"))
    some = at.join(taken, ["place", "at"], "left").select("doc_id", "place", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).join(targets, "place").select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_pieces(docs: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix as slots filled with pieces of documents: slot, doc_id, source, pass, skip (words of the block before the piece), words."""
    pieces, _, _, targets = _pieces(docs, block, seed)
    return pieces.join(targets.select("place", "source"), "place").select("slot", "doc_id", "source", "pass", "skip", "words")


def _pieces(docs: DataFrame, block: int, seed: int, *more: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pieces of rows in slots, and the tables they come from: places in the streams, all rows, targets. more: columns of docs that break ties in the streams."""
    spark = docs.sparkSession
    sizes = written(sized(docs, *more), "sizes")
    targets = written(source_targets(sizes).withColumn("want", F.floor("target")), "targets")
    named = targets.select("place", F.col("source").alias("of"))
    rows = written(sizes.join(named, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", *more, "place", "size"), "placed")
    at = written(stream_places(rows, seed, *more), "streams")

    needs = targets.filter("want > 0").select("place", F.ceil(F.col("source_size") / block).alias("blocks"), F.expr("want div source_size").alias("passes"), F.expr("want % source_size").alias("rest"))
    needs = needs.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    n = needs.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    slots = schedule(spark, needs.select("place", "slots"), n).join(needs, "place").withColumn("block", F.expr("rank % blocks")).withColumn("pass", F.expr("rank div blocks"))
    cut = F.when(F.col("pass") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("block") * block))

    spans = at.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    low = F.greatest(F.col("at"), F.col("block") * block)
    spans = spans.withColumn("skip", low - F.col("block") * block).withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - low)
    pieces = spans.join(slots.select("place", "block", "slot", "pass", cut.alias("cut")), ["place", "block"])
    pieces = pieces.withColumn("words", F.least(F.col("words"), F.col("cut") - F.col("skip"))).filter("words > 0")
    return pieces.select("doc_id", *more, "place", "at", "size", "slot", "pass", "skip", "words"), at, rows, targets


@keeps_columns
def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix itself, in the order of its slots: documents once for each pass over them, each where its first slot is, and the first words of those that the last pass cuts. The columns of docs.

    Every row is taken for itself, whatever its id; wholly equal rows give together the copies that they take together.
    """
    keyed = docs.withColumn("own", F.xxhash64(*comparable(docs)))
    pieces = _pieces(keyed, block, seed, "own")[0]
    takes = pieces.groupBy("own", "pass").agg(F.max("size").alias("size"), F.min(F.struct("slot", "skip")).alias("first"), F.sum("words").alias("taken"), F.countDistinct("at").alias("rows"))
    takes = written(takes.select("own", "size", "first.slot", "first.skip", "taken", "rows"), "takes")
    copies, equal = keyed.join(takes.filter("rows = 1"), "own"), takes.filter("rows > 1").select("own").distinct()
    if not equal.isEmpty():
        again = takes.join(equal, "own", "left_semi")
        copies = keyed.join(takes.join(equal, "own", "left_anti"), "own").unionByName(keyed.join(equal, "own", "left_semi").dropDuplicates(["own"]).join(again, "own"))
    words = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))
    copies = copies.withColumn("copy", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, left.cast("int")), " "))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    # slots are dense, so equal ranges of them are even parts
    parts, n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), takes.agg(F.max("slot")).first()[0]
    out = out.repartitionById(parts, F.expr(f"cast(slot * {parts} div {(n or 0) + 1} as int)")).sortWithinPartitions("slot", "skip", "own", "copy")
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][(place - 1) % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM p),
f AS (SELECT *, most <= w * ((total - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS is_full FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE w * ((total - sum(CASE WHEN is_full THEN most ELSE 0.0 END) OVER ())
        / sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER ()) END AS target FROM f),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || size)), size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d)
SELECT doc_id, o.source, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size
    + greatest(0, least(size, floor(target)::BIGINT % source_size - pos)) END::BIGINT AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""
