"""Embedding bags: pooled rows of a vector table.

The vectors of a bag are summed by plain ``sum`` aggregates, one per
dimension, in blocks of 32 dimensions, which the JVM still compiles well. A bag element therefore stays one row
per block on its way to the aggregation and map-side combine shrinks
a hot bag to one partial row per task. Elements that name the same vector
in a bag are summed up before they meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradespark.operators.ordering import with_running_sum

BLOCK = 32
#: Bits of the width at which ranges and flat ids are cut.
_STRETCH_BITS = 16


def _checked(vector: Column, width: int) -> Column:
    """``vector``, or an error if it has another width; NULL stays NULL."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector must have {width} dimensions, this one has "), F.size(vector).cast("string")))
    return F.when(vector.isNull() | (F.size(vector) == width), vector).otherwise(wrong)


def pool(
    rows: DataFrame,
    vector: Column,
    block_size: int,
    *,
    key: str = "bag_id",
    weight: Column | None = None,
    offset: Column | None = None,
    count: Column | None = None,
    unweighted: Column | None = None,
    mean: bool = False,
    bad: str = "raise",
) -> DataFrame:
    """(key, pooled ARRAY<DOUBLE>) over rows that carry their vector.

    Every vector has ``block_size`` entries, any other width is an error. NULL
    entries add nothing; a dimension without any entry is NULL, in its place.
    ``offset`` is one number per row that is added to every dimension.
    ``mean`` divides by the number of elements, not by the sum of weights.
    A row without a vector or weight is an error; with ``bad="report"`` its
    group is NULL instead, and a column ``bad`` counts such rows.
    A row may stand for ``count`` elements, ``unweighted`` of which have no weight.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    o = F.lit(0.0) if offset is None else offset.cast("double")
    n = F.lit(1) if count is None else count
    missing = F.when(vector.isNull(), n).otherwise(w.isNull().cast("bigint") if unweighted is None else unweighted)
    given = _checked(vector, block_size)
    if bad == "raise":
        given = F.when(missing > 0, F.raise_error(F.concat(F.lit("no vector or weight for an element of group "), F.col(key).cast("string")))).otherwise(given)
    blocks = -(-block_size // BLOCK)
    elements = rows.select(F.col(key), w.alias("_w"), o.alias("_o"), n.cast("bigint").alias("_n"), missing.alias("_bad"), given.alias("_v"))
    elements = elements.select(
        key, "_w", "_o", "_n", "_bad",
        F.posexplode(F.array(*[F.slice("_v", b * BLOCK + 1, BLOCK) for b in range(blocks)])).alias("_block", "_v"),
    )
    sums = [F.sum(F.col("_w") * F.get("_v", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(min(block_size, BLOCK))]
    summed = elements.groupBy(key, "_block").agg(F.sum("_n").alias("_n"), F.sum("_o").alias("_o"), F.sum("_bad").alias("bad"), *sums)
    # Each block has exactly its own width, whatever is NULL in it.
    width = F.least(F.lit(BLOCK), F.lit(block_size) - F.col("_block") * BLOCK)
    values = F.slice(F.array(*[F.col(f"_s{i}") for i in range(len(sums))]), F.lit(1), width)
    # At most block_size / BLOCK rows per group.
    parts = F.sort_array(F.collect_list(F.struct("_block", values.alias("v"))))
    summed = summed.groupBy(key).agg(
        F.max("_n").alias("_n"), F.max("_o").alias("_o"), F.max("bad").alias("bad"), F.flatten(F.transform(parts, lambda p: p["v"])).alias("_sum")
    )
    total = F.col("_sum")
    if offset is not None:
        total = F.transform(total, lambda x: x + F.col("_o"))
    if mean:
        total = F.transform(total, lambda x: x / F.col("_n"))
    if bad == "raise":
        return summed.select(key, total.alias("pooled"))
    return summed.select(key, F.when(F.col("bad") == 0, total).alias("pooled"), "bad")


def combined(elements: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row (bag_id, vec_id, weight, count, unweighted) for each vector of a bag.

    Weights of repeated elements are summed here, so that each vector travels
    once per bag. ``count`` says how many elements a row stands for, and
    ``unweighted`` how many of them have no weight.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return elements.groupBy("bag_id", "vec_id").agg(F.sum(w).alias("weight"), F.count("*").alias("count"), F.count_if(w.isNull()).alias("unweighted"))


def embedding_bag(
    elements: DataFrame,
    table: DataFrame,
    block_size: int,
    *,
    weight: Column | None = None,
    mean: bool = False,
    bags: DataFrame | None = None,
    bad: str = "raise",
) -> DataFrame:
    """Pool ``table.embedding`` over (bag_id, vec_id) elements.

    With ``bags`` (bag_id) every listed bag has a row; an empty one is zeros.
    An id that the table does not have is an error, or reported as ``pool`` says.
    The join is left to Spark, which broadcasts the vector table only where
    its measured size allows it.
    """
    joined = combined(elements, weight).join(table.select("vec_id", "embedding"), "vec_id", "left")
    pooled = pool(
        joined, F.col("embedding"), block_size, weight=F.col("weight"), count=F.col("count"), unweighted=F.col("unweighted"), mean=mean, bad=bad
    )
    if bags is None:
        return pooled
    zeros = F.array_repeat(F.lit(0.0), block_size)
    listed = bags.select("bag_id").join(pooled, "bag_id", "left")
    if bad == "raise":
        return listed.withColumn("pooled", F.coalesce("pooled", zeros))
    return listed.withColumn("bad", F.coalesce("bad", F.lit(0))).withColumn("pooled", F.when(F.col("bad") == 0, F.coalesce("pooled", zeros)))


def positional_weights(elements: DataFrame, weights: DataFrame) -> DataFrame:
    """Add the weight of each element's position in its bag: weights(pos, weight).

    A position without a weight has NULL, which ``pool`` refuses or reports.
    """
    return elements.join(weights, "pos", "left")


def quantized_bag(
    elements: DataFrame, table: DataFrame, block_size: int, *, weight: Column | None = None, mean: bool = False
) -> DataFrame:
    """Pool 8-bit rows (vec_id, scale, bias, q).

    The scale joins the weight, and the bias is one number per element, added
    to every dimension: sum(w*(scale*q + bias)) = sum(w*scale*q) + sum(w*bias).
    """
    joined = combined(elements, weight).join(table.select("vec_id", "scale", "bias", "q"), "vec_id", "left")
    return pool(
        joined, F.col("q"), block_size, mean=mean, count=F.col("count"),
        unweighted=F.when(F.col("scale").isNull() | F.col("bias").isNull(), F.col("count")).otherwise(F.col("unweighted")),
        weight=F.col("weight") * F.col("scale"), offset=F.col("weight") * F.col("bias"),
    )


def bad_ids(elements: DataFrame, table: DataFrame) -> DataFrame:
    """The elements whose id is not in the table; an empty result is a valid call."""
    return elements.join(table.select("vec_id"), "vec_id", "left_anti")


def ranges_from_lengths(lengths: DataFrame) -> DataFrame:
    """(bag_id, length) in bag order to (bag_id, start, length)."""
    return with_running_sum(lengths, "length", "bag_id", name="_end").select(
        "bag_id", (F.col("_end") - F.col("length")).alias("start"), "length"
    )


def check_offsets(offsets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row on offsets (bag_no, offset): are the numbers dense from 0, do offsets never fall, do they cover ``ids``?

    ``ids`` (flat) counts from 0; offsets may start anywhere.
    """
    following = offsets.select((F.col("bag_no") - 1).alias("bag_no"), F.col("offset").alias("_next"))
    falls = offsets.join(following, "bag_no").agg(F.coalesce(F.sum((F.col("_next") < F.col("offset")).cast("int")), F.lit(0)).alias("n")).scalar()
    listed = offsets.agg(
        F.count("*").alias("entries"), (F.count("*") - F.count_distinct("bag_no")).alias("repeated"),
        (F.coalesce(F.max("bag_no") + 1, F.lit(0)) - F.count_distinct(F.when(F.col("bag_no") >= 0, F.col("bag_no")))).alias("gaps"),
        F.coalesce(F.sum((F.col("bag_no") < 0).cast("int")), F.lit(0)).alias("negative"),
        (F.max_by("offset", "bag_no") - F.min_by("offset", "bag_no")).alias("covered"),
    )
    listed = listed.withColumn("falls", falls).withColumn("ids", F.col("covered") if ids is None else ids.agg(F.count("*").alias("n")).scalar())
    fine = (F.col("repeated") == 0) & (F.col("gaps") == 0) & (F.col("negative") == 0) & (F.col("falls") == 0)
    return listed.withColumn("valid", fine & F.coalesce(F.col("covered") == F.col("ids"), F.lit(False)))


def ranges_from_offsets(offsets: DataFrame) -> DataFrame:
    """(bag_no, offset), numbered from 0 with a closing entry, to ranges.

    Numbers are dense, so the next offset is an equi join away. Gaps, repeated
    numbers and falling offsets are an error.
    """
    following = offsets.select((F.col("bag_no") - 1).alias("bag_no"), F.col("offset").alias("_next"))
    first = offsets.where(F.col("bag_no") == 0).agg(F.max("offset").alias("o")).scalar()
    shape = offsets.agg(
        ((F.min("bag_no") == 0) & (F.max("bag_no") == F.count("*") - 1) & (F.count_distinct("bag_no") == F.count("*"))).alias("dense")
    ).scalar()
    length = F.col("_next") - F.col("offset")
    return offsets.join(following, "bag_no").select(
        F.when(shape, F.col("bag_no")).otherwise(F.raise_error(F.lit("bag numbers must be dense from 0"))).alias("bag_id"),
        (F.col("offset") - first).alias("start"),
        F.when(length >= 0, length).otherwise(F.raise_error(F.lit("offsets must not fall"))).alias("length"),
    )


def bag_elements(ranges: DataFrame, indices: DataFrame) -> DataFrame:
    """Cut the flat ids (flat, vec_id) into (bag_id, pos, vec_id); a range with a place that has no id is an error.

    An interval join by merging: ranges, which do not overlap, and ids are cut
    at the same multiples of a fixed width and sorted together, and each id
    belongs to the last range that began at or before it, if it has not ended.
    A range is one row for each stretch of that width that it touches, not one
    for each element, and a long one is spread over as many tasks.
    """
    stretch, width = lambda at: F.shiftright(at.cast("bigint"), _STRETCH_BITS), 1 << _STRETCH_BITS
    end = F.col("start") + F.col("length")
    pieces = ranges.where(F.col("length") > 0).withColumn("_stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(end - 1))))
    first, last = F.greatest("start", F.col("_stretch") * width), F.least(end, (F.col("_stretch") + 1) * width)
    none = F.lit(None)
    opened = pieces.select("_stretch", first.alias("flat"), F.lit(0).alias("_kind"), none.cast(dict(indices.dtypes)["vec_id"]).alias("vec_id"),
                           F.struct("bag_id", "start", first.alias("first"), last.alias("last")).alias("_range"))
    ids = indices.select(stretch(F.col("flat")).alias("_stretch"), F.col("flat").cast("bigint").alias("flat"), F.lit(1).alias("_kind"), "vec_id", none.cast(opened.schema["_range"].dataType).alias("_range"))
    within = Window.partitionBy("_stretch")
    merged = opened.unionByName(ids).withColumn("_own", F.last("_range", ignorenulls=True).over(within.orderBy("flat", "_kind").rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.where(F.col("flat") < F.col("_own.last"))
    found = F.sum("_kind").over(Window.partitionBy("_stretch", F.col("_own.first")))
    short = found < F.col("_own.last") - F.col("_own.first")
    kind = F.when(short, F.raise_error(F.concat(F.lit("no id at some place from "), F.col("_own.first").cast("string")))).otherwise(F.col("_kind"))
    return merged.withColumn("_kind", kind).where("_kind = 1").select("_own.bag_id", (F.col("flat") - F.col("_own.start")).alias("pos"), "vec_id")


def check_ranges(ranges: DataFrame, indices: DataFrame, table: DataFrame) -> DataFrame:
    """One row on the whole call: do the lengths use each id once, and do all ids exist?"""
    spans = ranges.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("listed"),
        F.coalesce(F.min("length"), F.lit(0)).alias("shortest"),
    )
    ids = indices.agg(F.count("*").alias("n")).scalar()
    unknown = bad_ids(indices, table).agg(F.count("*").alias("n")).scalar()
    return spans.withColumn("ids", ids).withColumn("bad_ids", unknown).withColumn(
        "valid",
        (F.col("listed") == F.col("ids")) & (F.col("shortest") >= 0) & (F.col("bad_ids") == 0),
    )
