"""Comparing two large tables by checksums: only where these differ are rows compared.

Keys fall into parts by their hash, and parts into smaller ones. A part's checksum is its number of rows and sums of two 64-bit hashes of each row, those of the
second side taken off, so order does not count and repeats do. Three readings: checksums of the parts; of the smaller parts inside those that differ;
and the rows of the smaller parts that differ. The first two shuffle one row for each part and task, the last what differs and its neighbours.
"""

from __future__ import annotations

from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the first step, and of each of those; both are bounds on what is broadcast or held for a part.
PARTS = 4096
#: Bits of the pieces in which hashes are summed: 2^39 rows of a part do not overflow.
PIECE = 24


def digest(columns: list[str], seed: int) -> Column:
    """64 bits of a row; a NULL differs from every value and from a NULL in another column."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def sums(hashed: Column, name: str) -> list[Column]:
    """A hash summed over all rows, those of the second side taken off, in pieces that cannot overflow."""
    piece = lambda shift: F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit((1 << PIECE) - 1))
    return [F.sum(piece(shift) * F.col("_sign")).alias(f"_{name}{shift}") for shift in range(0, 64, PIECE)]


class Comparison:
    """Rows that only one of two tables with the same columns has. keys need not be unique or filled; columns of type map cannot be compared."""

    def __init__(self, a: DataFrame, b: DataFrame, keys: list[str], parts: int = PARTS):
        self.columns = a.columns
        one, other = (df.select(*self.columns, F.lit(sign).cast("long").alias("_sign")) for df, sign in ((a, 1), (b, -1)))
        place = digest(keys, 0)
        both = one.unionByName(other)  # both sides in the type that holds either
        self.both = both.withColumns({"_part": F.pmod(place, F.lit(parts)), "_sub": F.pmod(F.shiftright(place, 32), F.lit(parts))})

    def _unequal(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Groups in which what the sides add does not cancel out."""
        checks = [F.sum("_sign").alias("_n"), *sums(digest(self.columns, 1), "x"), *sums(digest(self.columns, 2), "y")]
        out = rows.groupBy(*by).agg(*checks)
        return out.filter(reduce(or_, (F.col(c) != 0 for c in out.columns if c not in by))).select(*by)

    @cached_property
    def parts_apart(self) -> DataFrame:
        """The parts whose checksums differ; never more than there are parts."""
        return self._unequal(self.both, ["_part"])

    @cached_property
    def leaves_apart(self) -> DataFrame:
        """The smaller parts that differ, of those parts only."""
        return self._unequal(self._near(), ["_part", "_sub"])

    def _near(self) -> DataFrame:
        return self.both.join(F.broadcast(self.parts_apart), "_part", "left_semi")

    @cached_property
    def suspects(self) -> DataFrame:
        """All rows of both sides that stand in a smaller part that differs: what is compared row by row."""
        return self._near().join(self.leaves_apart, ["_part", "_sub"], "left_semi").select(*self.columns, "_sign")

    def rows(self) -> DataFrame:
        """The columns, the side (a or b) that has the row more often, and how many times more."""
        out = self.suspects.groupBy(*self.columns).agg(F.sum("_sign").alias("_n")).filter("_n <> 0")
        return out.select(*self.columns, F.when(F.col("_n") > 0, "a").otherwise("b").alias("side"), F.abs("_n").alias("times"))


def summary(c: Comparison) -> DataFrame:
    """Rows of each side, and rows that only one side has."""
    of = lambda n, name: F.coalesce(F.sum(n), F.lit(0)).alias(name)
    size = c.both.agg(F.count_if(F.col("_sign") > 0).alias("rows_a"), F.count_if(F.col("_sign") < 0).alias("rows_b"))
    return size.crossJoin(c.rows().agg(*[of(F.when(F.col("side") == side, F.col("times")), f"only_{side}") for side in "ab"]))
