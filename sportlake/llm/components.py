"""Connected components of a graph given by its edges, with Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sportlake.llm.common import mapped, written


#: Edges that one task joins up by itself.
SHARE = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins up the edges of a partition: an edge from each node to the smallest of its part."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    edges = [(x, top(x)) for x in list(up)]
    edges = [(x, r) for x, r in edges if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([r for _, r in edges], pa.int64())], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, label (the smallest node it is linked with) for every node of edges (a, b: long).

    Tasks join up shares of the edges first, so that at most an edge for each node and share is left. Then large-star and small-star
    steps take turns until every edge joins a node to its label. Each round is written out. The rounds needed grow with the logarithm
    of the nodes; should most_rounds not be enough, that is an error and no half-made result.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now = written(mapped(now.repartition(1 + now.count() // SHARE), _forest, "u long, v long").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"the components are not complete after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
