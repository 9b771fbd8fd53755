"""Scatter updates: ``target[idx] op= value`` where repeated ids accumulate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.functions.numeric import fmax, fmin, floor_divide, interval_micros, is_nan, maximum, micros_interval, minimum, multiply_int
from gradespark.operators.folds import ordered_fold
from gradespark.operators.reduce import product_reduce

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def scatter(target: DataFrame, updates: DataFrame, op: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``target(idx, value)`` after all ``updates(idx, u, order...)``; untouched rows stay.

    Only ``floor_divide`` depends on the order of the updates: that of the
    ``order`` columns and then of ``u``. It is exact for integers (by zero it
    gives 0) and follows the float loop for other numbers, of any sign.
    """
    if op == "floor_divide":
        whole = dict(target.dtypes)["value"] in _WHOLE and dict(updates.dtypes)["u"] in _WHOLE
        of, kind = ("integer", "bigint") if whole else ("float", "double")
        cast = target.select("idx", F.col("value").cast(kind).alias("value"))
        return ordered_fold(cast, updates.withColumn("u", F.col("u").cast(kind)), order, lambda x, u: floor_divide(x, u, of))
    return scatter_all(target, updates, {"value": (op, "u")})


def scatter_all(target: DataFrame, updates: DataFrame, results: dict[str, tuple[str, str]]) -> DataFrame:
    """(idx, one column per result) for {name: (op, update column)}.

    All results share one aggregation of the updates, which come combined to
    the target: a hot id costs one partial row per task. Products of integers
    wrap around modulo 2^64; they are folded by levels beside it. Of intervals
    added to intervals, ``add_micros`` and ``subtract_micros`` give the exact
    microseconds as a decimal, also where no interval is as long.
    """
    types, whole = dict(updates.dtypes), dict(target.dtypes)["value"] in _WHOLE
    exact = {name: column for name, (op, column) in results.items() if op == "multiply" and whole and types[column] in _WHOLE}
    summed = ("add", "subtract", "add_micros", "subtract_micros")
    spans = {name: types[column] for name, (op, column) in results.items() if op in summed and types[column].startswith("interval") and "month" not in types[column] and "year" not in types[column]}
    combined = [
        _combine(op, interval_micros(F.col(column)) if name in spans else F.col(column)).alias(f"_acc_{name}")
        for name, (op, column) in results.items() if name not in exact
    ]
    joined = target.join(updates.groupBy("idx").agg(*combined), "idx", "left") if combined else target
    for name, column in exact.items():
        joined = joined.join(product_reduce(updates, column, "idx").withColumnRenamed("value", f"_acc_{name}"), "idx", "left")

    def result(name: str, op: str) -> Column:
        value, acc = F.col("value"), F.col(f"_acc_{name}")
        if op.endswith("_micros"):
            return _apply(op.removesuffix("_micros"), interval_micros(value), acc)
        if name in spans:
            acc = micros_interval(acc).cast(spans[name])
        return _apply("multiply_int" if name in exact else op, value, acc)

    return joined.select("idx", *[result(name, op).alias(name) for name, (op, _) in results.items()])


def _combine(op: str, u: Column) -> Column:
    number = ~is_nan(u)  # of dates, times and intervals every value is one
    if op in ("add", "subtract", "add_micros", "subtract_micros"):
        return F.sum(u)
    if op in ("multiply", "divide"):
        return F.product(u)
    if op == "maximum":
        return F.max(u)
    if op == "minimum":
        # NaN is Spark's largest value, so min has to look for it.
        return F.coalesce(F.max(F.when(~number, u)), F.min(u))
    if op == "fmax":
        return F.coalesce(F.max(F.when(number, u)), F.max(u))
    if op == "fmin":
        return F.min(u)
    raise ValueError(f"unknown scatter operation: {op}")


def _apply(op: str, value: Column, acc: Column) -> Column:
    done = {
        "add": lambda: value + acc,
        "subtract": lambda: value - acc,
        "multiply": lambda: value * acc,
        "multiply_int": lambda: multiply_int(value, acc),
        "divide": lambda: _divide(value.cast("double"), acc),
        "maximum": lambda: maximum(value, acc),
        "minimum": lambda: minimum(value, acc),
        "fmax": lambda: fmax(value, acc),
        "fmin": lambda: fmin(value, acc),
    }[op]()
    return F.when(acc.isNull(), value).otherwise(done)


def _divide(x: Column, y: Column) -> Column:
    inf = F.lit(float("inf"))
    return (
        F.when(y != 0, x / F.when(y != 0, y))
        .when((x == 0) | F.isnan(x), F.lit(float("nan")))
        .otherwise(F.when(x > 0, inf).otherwise(-inf))
    )
