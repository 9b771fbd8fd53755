"""Exact top-k inner products by the threshold algorithm.

Each block of rows keeps one sorted list per dimension. A query goes down the
lists of its non-zero dimensions, from the end that its sign prefers, scores
every row it comes across in full, and stops when the values at the current
depth can no longer add up to the k-th best score it has. That score is known
before from the query's own block, which it visits first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradespark.llm.blocks import BLOCK, one_width, valid, visit
from gradespark.llm.common import narrow, settled

K = 5
SCALE = 256.0
#: Depth at which a query first compares its bound; it doubles from there.
FIRST_DEPTH = 16
_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)


def threshold_search(rows: np.ndarray, ids: np.ndarray, k: int) -> Callable[[np.ndarray, int, float], list[tuple[int, int]]]:
    """Prepare the sorted lists of ``rows`` (whole numbers); returns the search for one query.

    The search gives the ``k`` best ``(score, position)`` that may still reach
    ``bound`` (null or NaN: any), ties to smaller ids, without rows of the query's own id.
    """
    size = len(rows)
    order = np.argsort(rows, axis=0, kind="stable")
    lists = np.take_along_axis(rows, order, axis=0)
    reach = np.abs(rows).max(0, initial=0)

    def search(query: np.ndarray, own: int, bound: float) -> list[tuple[int, int]]:
        if not size:
            return []
        up, down = np.nonzero(query > 0)[0], np.nonzero(query < 0)[0]
        least = -np.inf if np.isnan(bound) else bound
        if float(np.abs(query) @ reach) >= _EXACT:  # beyond exact doubles: whole numbers of any size
            whole = [int(x) for x in query]
            scores = [max(_LONG[0], min(_LONG[1], sum(a * int(b) for a, b in zip(whole, r)))) for r in rows]
            return [(scores[p], p) for p in sorted(range(size), key=lambda p: (-scores[p], ids[p])) if ids[p] != own][:k]
        if not len(up) and not len(down):
            best = np.nonzero(ids != own)[0]
            return [(0, int(p)) for p in best[np.argsort(ids[best], kind="stable")][:k]]
        at_depth = lambda t: query[up] @ lists[size - 1 - t, up] + query[down] @ lists[t, down]
        if at_depth(0) < least:
            return []
        seen, depth = np.zeros(size, bool), 0
        positions, scores = np.zeros(0, np.int64), np.zeros(0)
        while depth < size:
            nxt = min(size, 2 * depth or FIRST_DEPTH)
            met = np.zeros(size, bool)
            met[order[size - nxt : size - depth][:, up]] = True
            met[order[depth:nxt][:, down]] = True
            fresh = np.nonzero(met & ~seen)[0]
            seen |= met
            fresh = fresh[ids[fresh] != own]
            positions, scores = np.concatenate([positions, fresh]), np.concatenate([scores, rows[fresh] @ query])
            top = np.lexsort((ids[positions], -scores))[:k]
            positions, scores = positions[top], scores[top]
            if len(scores) == k:
                least = max(least, scores[-1])
            depth = nxt
            if at_depth(depth - 1) < least:
                break
        return [(int(s), int(p)) for s, p in zip(scores, positions)]

    return search


def _meet(k: int) -> Callable:
    def prepare(vectors: np.ndarray, ids: list) -> Callable:
        flat = np.array([i[0] for i in ids], np.int64)
        search = threshold_search(np.floor(vectors * SCALE), flat, k)

        def ask(queries: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
            for q, row in enumerate(np.floor(queries * SCALE)):
                for score, position in search(row, own[q], bounds[q]):
                    yield q, [int(flat[position])], score

        return ask

    return prepare


def exact_top_k(
    vectors: DataFrame, every: int = 50, k: int = K, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every`` its ``k`` best among all other rows.

    Components become ``floor(256 x)``, the score is their integer inner
    product, ties go to the smaller id. Rows whose id or vector is null, or
    whose vector holds a null or a non-finite number, take no part; zero vectors do. A row never meets rows
    of its own id. Repeated rows are rows: a repeated query is answered each
    time, a repeated candidate counts each time. Scores that a long cannot hold
    end at its ends. Vectors of several widths are an error; an empty table gives no rows.
    """
    rows = narrow(vectors, {"vec_id": F.col(id_col).cast("bigint"), "vector": F.col(vector_col).cast("array<double>")})
    rows = settled(rows.where(F.col("vec_id").isNotNull() & valid("vector", zero=True)).withColumn("row", F.monotonically_increasing_id()))
    width, count = one_width(rows, "vector"), rows.count()
    blocks = max(1, -(-count // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    data = rows.select("block", F.array("vec_id").alias("ids"), "vector")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("block", F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "vector")
    schema = "query bigint, query_id bigint, ids array<bigint>, score bigint"
    first = settled(visit(data, queries.withColumn("bound", F.lit(None).cast("double")), width, _meet(k), schema))
    # What a query has from its own block: its k-th score is the bound elsewhere.
    bounds = first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(
        F.col("query").alias("_q"), F.when(F.col("n") >= k, F.col("least").cast("double")).alias("bound"))
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"), lambda b: b != F.col("block"))
    rest = queries.join(bounds, F.col("query") == F.col("_q"), "left").select(F.explode(others).alias("block"), "query", "query_id", "vector", "bound")
    found = first.unionByName(visit(data, rest, width, _meet(k), schema)).select("query", "query_id", F.col("ids")[0].alias("vec_id"), "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), s as (
  select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
