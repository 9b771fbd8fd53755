"""Vector and matrix products over tables of rows or coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.operators.bags import pool


def vecdot(a: Column, b: Column) -> Column:
    """Dot product of two array columns."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def matvec(rows: DataFrame, vector: DataFrame, row: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(row, value) of a matrix of row arrays times a one-row table ``vector(v)``.

    The vector has one entry per column of the matrix, so it fits a row.
    """
    with_vector = rows.withColumn("_v", vector.select("v").scalar())
    return with_vector.select(row, vecdot(F.col(values), F.col("_v")).alias("value"))


def vecmat(vector: DataFrame, rows: DataFrame, width: int, row: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(j, value) of a vector table (row, x) times a matrix of row arrays."""
    joined = rows.join(vector, row).withColumn("_all", F.lit(0))
    summed = pool(joined, F.col(values), width, key="_all", weight=F.col("x"))
    return summed.select(F.posexplode("pooled").alias("j", "value"))


def matmul(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """(i, j, value) of left(i, k, v) times right(k, row ARRAY).

    The right rows stay arrays: each left entry meets one row, and the sums
    over k are ``width`` aggregates with map-side combine instead of ``width``
    rows per entry.
    """
    summed = pool(left.join(right, "k"), F.col("row"), width, key="i", weight=F.col("v"))
    return summed.select("i", F.posexplode("pooled").alias("j", "value"))


#: Rows or columns of a tile.
TILE = 256


def matmul_tiled(left: DataFrame, right: DataFrame, tile: int = TILE) -> DataFrame:
    """([i,] [j,] value) of ``left([i,] k, v)`` times ``right(k, [j,] v)``; an operand without ``i`` or ``j`` is a vector.

    Entries are dealt out to square tiles. A row of a left tile is sent once to
    each tile of right columns, and a row of a right one once to each tile of
    left rows, so what meets in one place is one row of either for one k: a k
    that most entries have is spread over all pairs of tiles. Partial sums of a
    pair come combined to the sum over k. A missing entry is 0; an i or j
    without any entry has no row.
    """
    cut = lambda c: F.floor(F.col(c) / tile)
    sides = []
    for side, free in ((left, "i"), (right, "j")):
        with_free = side if free in side.columns else side.withColumn(free, F.lit(0).cast("bigint"))
        sides.append(with_free.groupBy(cut(free).alias(f"_{free}"), "k").agg(
            F.collect_list(F.struct(F.col(free).alias("at"), F.col("v").cast("double").alias("v"))).alias(f"_row_{free}")))
    a, b = sides

    def to_tiles(rows: DataFrame, other: DataFrame, free: str) -> DataFrame:
        ends = [other.agg(f(free).alias("t")).scalar() for f in (F.min, F.max)]
        return rows.withColumns({"_from": ends[0], "_to": ends[1]}).where("_to is not null").withColumn(free, F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")

    pairs = to_tiles(a, b, "_j").join(to_tiles(b, a, "_i"), ["_i", "_j", "k"])
    products = F.flatten(F.transform("_row_i", lambda x: F.transform("_row_j", lambda y: F.struct(x["at"].alias("i"), y["at"].alias("j"), (x["v"] * y["v"]).alias("v")))))
    sums = pairs.select(F.explode(products).alias("p")).groupBy("p.i", "p.j").agg(F.sum("p.v").alias("value"))
    kept = [c for c, side in (("i", left), ("j", right)) if c in side.columns]
    return sums.select(*kept, "value")
