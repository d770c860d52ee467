"""Comparison by checksums and names in texts, against plain computation."""

from collections import Counter

from pyspark.sql import functions as F

from sportlake.functions.text import normalize_name
from sportlake.operators import compare, mentions


def apart(spark, a, b, schema, keys, parts=8):
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    return Counter({tuple(r)[:-1]: r["times"] for r in compare.Comparison(left, right, keys, parts).rows().collect()})


def test_differences_with_nulls_repeats_and_empty_sides(spark):
    a = [(1, "x", 1), (1, "x", 1), (2, None, 2), (None, "n", 3), (4, "same", 4), (5, None, None)]
    b = [(1, "x", 1), (2, "", 2), (None, "n", 3), (4, "same", 4), (5, None, 0), (6, "new", None)]
    schema = "id int, name string, n int"
    want = Counter((*r, "a") for r in (Counter(a) - Counter(b)).elements()) + Counter((*r, "b") for r in (Counter(b) - Counter(a)).elements())
    assert apart(spark, a, b, schema, ["id"]) == want
    assert apart(spark, a, a, schema, ["id"]) == Counter()
    assert apart(spark, a, [], schema, ["id"]) == Counter((*r, "a") for r in a)
    assert apart(spark, [], [], schema, ["id"]) == Counter()


def test_null_moves_between_columns(spark):
    assert len(apart(spark, [(1, None, 7)], [(1, 7, None)], "id int, x int, y int", ["id"])) == 2


def test_two_types_of_one_column_are_equal(spark):
    a, b = spark.range(100).selectExpr("CAST(id AS INT) AS id", "id AS v"), spark.range(100).selectExpr("id", "CAST(id AS INT) AS v")
    assert compare.Comparison(a, b, ["id"], 8).rows().count() == 0


def test_only_the_parts_that_differ_are_compared(spark):
    a = spark.range(200_000).selectExpr("id", "id * 3 AS v")
    b = a.withColumn("v", F.when(F.col("id").isin(17, 40_000, 199_999), -1).otherwise(F.col("v"))).filter("id <> 123456")
    c = compare.Comparison(a, b, ["id"], parts=64)
    assert c.parts_apart.count() <= 4 and c.leaves_apart.count() == 4
    assert c.suspects.count() < 1_000  # of 400,000: four of 4,096 smaller parts
    one = compare.summary(c).collect()[0].asDict()
    assert one == {"rows_a": 200_000, "rows_b": 199_999, "only_a": 4, "only_b": 3}


def test_names_inside_texts(spark):
    texts = [(1, "Der FC 05 gewinnt"), (2, "AFC 051 x"), (3, "fc x 05"), (4, None), (5, ""), (6, "Mueller traf"), (7, "a fc a b c"), (8, "Wir haben Müllers Tor"), (None, "der FC 05"), (9, "f" * 3_000 + "c 05"), (1, "Der FC 05 gewinnt")]
    names = [(1, "FC 05"), (2, "Müller"), (3, "fc a b"), (4, "--"), (5, None), (6, "05"), (7, "B"), (8, "x"), (2, "Müller")]
    got = mentions.resolve(spark.createDataFrame(texts, "key int, text string"), "key", spark.createDataFrame(names, "entity_id int, name string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1), (1, 6), (2, 1), (2, 6), (2, 8), (3, 6), (3, 8), (7, 3), (7, 7), (8, 2), (8, 7), (9, 1), (9, 6), (None, 1), (None, 6)], key=str)
    assert mentions.resolve(spark.createDataFrame([], "key int, text string"), "key", spark.createDataFrame(names, "entity_id int, name string")).count() == 0
    assert mentions.resolve(spark.createDataFrame(texts, "key int, text string"), "key", spark.createDataFrame([], "entity_id int, name string")).count() == 0


def test_names_out_of_documents_in_documents(spark, small):
    """Every document against names out of the documents themselves: short ones, long ones and mixed."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    names = docs.select(F.col("doc_id").alias("entity_id"), F.array_join(F.slice(F.split("text", r"\s+"), 3, 2), " ").alias("name")).unionByName(docs.select((F.col("doc_id") + 100_000).alias("entity_id"), F.regexp_extract("text", "(?:^|[^a-z])([a-z]{1,2} [a-z]{1,2} ?[a-z]{0,2})[^a-z]", 1).alias("name")))
    plain = [(r[0], r[1] or "") for r in docs.select("doc_id", normalize_name(F.col("text"))).collect()]
    named = [tuple(r) for r in names.select("entity_id", normalize_name(F.col("name"))).collect() if r[1]]
    want = {(k, i) for k, text in plain for i, name in named if name in text or any(w in text for w in name.split() if len(w) >= 3)}
    assert set(map(tuple, mentions.resolve(docs, "doc_id", names).collect())) == want and len(want) > 1_000
