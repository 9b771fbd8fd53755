"""Nearest neighbours by shifted Hilbert orderings.

Every distinct vector gets a key on each of several Hilbert curves, each over
another shifted projection. Spark range-partitions the rows by curve and key
and cuts them into windows; a query visits its own window and the
neighbouring ones on every curve, and the merged candidates are ranked by
their exact inner products. That gives a first k-th score. Windows of the
first curve that could still hold something better, by the distance of their
vectors from their centre, are visited too, so nothing nearer is missed; where
the curves separate the vectors well, few windows are left to visit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradespark.llm.blocks import matrix, one_width, valid, visit
from gradespark.llm.common import narrow, settled

K = 20
CURVES = 4
#: Projected dimensions and bits of each.
DIMENSIONS, BITS = 8, 6
#: Rows of a window.
WINDOW = 2048
#: Neighbouring windows on either side.
REACH = 1
_ROUNDING = 1e-12
SCHEMA = "query bigint, query_id bigint, ids array<bigint>, score double"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of whole-number points; ``cells`` has a column for each dimension."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # Undo the rotations and reflections of each level, from the coarsest down.
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    spread = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        spread ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= spread
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Keys of the directions of ``vectors`` on one curve: a random projection, shifted by a part of a cell."""
    rng = np.random.default_rng(curve)
    width = vectors.shape[1]
    used = min(dimensions, width)
    plane = np.linalg.qr(rng.normal(size=(width, used)))[0]
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    spread = 3.0 / np.sqrt(width)  # about three deviations of a direction's component
    place = (unit @ plane / spread + 1) / 2 * ((1 << bits) - 1) + rng.random(used)
    return hilbert_keys(np.clip(place, 0, (1 << bits) - 1), bits)


def _meet(k: int) -> Callable:
    def prepare(vectors: np.ndarray, ids: list) -> Callable:
        first = np.array([i[0] for i in ids], np.int64)
        centre = vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])
        radius = np.linalg.norm(vectors - centre, axis=1).max(initial=0)
        largest = np.linalg.norm(vectors, axis=1).max(initial=0)

        def ask(queries: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
            norms = np.linalg.norm(queries, axis=1)
            margin = _ROUNDING * vectors.shape[1] * norms * largest
            for at in range(0, len(queries), 256):
                some = np.arange(at, min(at + 256, len(queries)))
                able = np.isnan(bounds[some]) | (queries[some] @ centre + norms[some] * radius + margin[some] >= bounds[some])
                some = some[able]
                if not len(some) or not len(vectors):
                    continue
                rough = queries[some] @ vectors.T
                kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(some), -np.inf)
                floor = np.maximum(kth, np.where(np.isnan(bounds[some]), -np.inf, bounds[some]))
                for row, q in enumerate(some):
                    near = np.nonzero(rough[row] >= floor[row] - margin[q])[0]
                    # One component after the other, as a plain loop adds them up.
                    exact = np.cumsum(vectors[near] * queries[q], axis=1)[:, -1]
                    for p in np.lexsort((first[near], -exact))[:k]:
                        yield int(q), ids[near[p]], float(exact[p])

        return ask

    return prepare


def nearest(
    vectors: DataFrame, every: int = 20, k: int = K, curves: int = CURVES, window: int = WINDOW, complete: bool = True,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every`` its ``k`` nearest other rows.

    Nearness is the inner product in double precision, ties go to the smaller
    id. With ``complete`` the result is exact; without it only the neighbouring
    windows are searched. Rows whose id or vector is null, or whose vector is zero or holds a
    null or a non-finite number, take no part. Equal vectors are indexed once, with
    the ids that can be asked for. Rows that repeat an id with the same vector count once, a
    query that repeats with another vector is another query. Vectors of several
    widths are an error; an empty table gives no rows.
    """
    rows = narrow(vectors, {"vec_id": F.col(id_col).cast("bigint"), "vector": F.col(vector_col).cast("array<double>")})
    rows = settled(rows.where(F.col("vec_id").isNotNull() & valid("vector", zero=False)).distinct())
    width = one_width(rows, "vector")
    # k other ids and the query's own: the smallest k + 1 ids of a vector are all that can be asked for.
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    groups = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = settled(groups.withColumn("query", F.monotonically_increasing_id()))
    # Equal query vectors are searched once.
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "vector")
    asked = settled(asked.join(groups.select("vector", "query"), "vector").select("query", "query_id"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cells = matrix(part.column(0), width)
                for c in range(curves):
                    key = pa.array(curve_keys(cells, c), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), c, np.int32)), key, *part.columns],
                                                     ["curve", "key", "vector", "ids", "query"])

    placed = groups.select("vector", "ids", "query").mapInArrow(keys, "curve int, key bigint, vector array<double>, ids array<bigint>, query bigint")
    placed = settled(placed.repartitionByRange("curve", "key", "query").sortWithinPartitions("curve", "key", "query")
                     .withColumn("mark", F.monotonically_increasing_id()))
    # Windows: runs of rows within a sorted partition, then numbered along each curve.
    part, local = F.shiftright("mark", 33), F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("part", part).withColumn("run", F.floor(local / window))
    runs = placed.select("curve", "part", "run").distinct()
    place = F.row_number().over(Window.partitionBy("curve").orderBy("part", "run"))
    runs = settled(runs.withColumn("block", place + F.col("curve").cast("bigint") * (1 << 40)))
    placed = settled(placed.join(runs, ["curve", "part", "run"]).select("curve", "block", "ids", "vector", "query"))
    spots = placed.drop("ids").join(asked.select("query").distinct(), "query").withColumn("query_id", F.col("query"))
    data = placed.select("block", "ids", "vector")
    around = F.explode(F.array(*[F.col("block") + d for d in range(-REACH, REACH + 1)]))
    near = spots.select(around.alias("block"), "query", "query_id", "vector", F.lit(None).cast("double").alias("bound"))
    found = visit(data, near, width, _meet(k + 1), SCHEMA)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    # The curves find the same vectors again; scores of a vector are equal, so each is ranked once.
    first = found.groupBy("query", "query_id", "score", "ids").agg(F.count("*").alias("_c")).drop("_c")
    first = settled(first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"))
    if complete:
        bounds = first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(
            F.col("query").alias("_q"), F.when(F.col("n") > k, F.col("least")).alias("bound"))
        count = runs.where("curve = 0").count()
        home = spots.where("curve = 0").join(bounds, F.col("query") == F.col("_q"), "left")
        others = F.filter(F.sequence(F.lit(1), F.lit(max(1, count))).cast("array<bigint>"), lambda b: F.abs(b - F.col("block")) > REACH)
        rest = home.select(F.explode(others).alias("block"), "query", "query_id", "vector", "bound")
        more = visit(data.where(F.col("block") < (1 << 40)), rest, width, _meet(k + 1), SCHEMA)
        first = first.unionByName(more).groupBy("query", "query_id", "score", "ids").agg(F.count("*").alias("_c")).drop("_c")
        first = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    single = first.select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    single = single.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    # At most k + 1 rows of a query vector; each of its ids leaves itself out.
    ranked = single.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.join(ranked, "query").select("query_id", F.posexplode(own).alias("_at", "_x")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))


ORACLE = """
with v as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
