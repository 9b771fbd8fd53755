"""Group reductions of binary functions, with their identities for empty groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.functions.numeric import floor, gcd, interval_micros, is_nan, micros_interval, multiply_int, power_int
from gradespark.operators.folds import tree_reduce


def _truth(x: Column) -> Column:
    return x.cast("double") != 0


def _or_identity(x: Column, identity) -> Column:
    return x if identity is None else F.coalesce(x, F.lit(identity))


REDUCTIONS = {
    "add": lambda x: _or_identity(F.sum(x), 0),
    "multiply": lambda x: _or_identity(F.product(x), 1.0),
    "bitwise_and": lambda x: _or_identity(F.bit_and(x), -1),
    "bitwise_or": lambda x: _or_identity(F.bit_or(x), 0),
    "bitwise_xor": lambda x: _or_identity(F.bit_xor(x), 0),
    "logical_and": lambda x: _or_identity(F.bool_and(_truth(x)), True),
    "logical_or": lambda x: _or_identity(F.bool_or(_truth(x)), False),
    "logical_xor": lambda x: _or_identity(F.bit_xor(_truth(x).cast("int")), 0) == 1,
    "maximum": lambda x: F.max(x),
    # NaN is Spark's largest value: max hands it on by itself, min must look for it.
    # What is NaN is told apart for numbers only, so dates, times and intervals come through.
    "minimum": lambda x: F.coalesce(F.max(F.when(is_nan(x), x)), F.min(x)),
    "fmax": lambda x: F.coalesce(F.max(F.when(~is_nan(x), x)), F.max(x)),
    "fmin": lambda x: F.min(x),
    "hypot": lambda x: _or_identity(F.sqrt(F.sum(x.cast("double") * x)), 0.0),
}


def reduction(name: str, column: str, of: str = "float") -> Column:
    """Aggregate expression of one reduction, for use in ``agg``; sums of intervals are ``of="interval"``.

    An interval holds 64 bits of microseconds, some 290,000 years, which the sum of a large table may exceed:
    ``of="micros"`` gives the exact sum as a decimal number of microseconds.
    Extremes take columns of any ordered type. ``multiply`` goes through double: integers have ``product_reduce``.
    """
    if of in ("interval", "micros") and name == "add":
        total = F.coalesce(F.sum(interval_micros(F.col(column))), F.lit(0))
        return total if of == "micros" else micros_interval(total)
    return REDUCTIONS[name](F.col(column))


def product_reduce(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys..., value): exact product of 64-bit integers, modulo 2^64 as integers wrap around."""
    whole = rows.withColumn(column, F.col(column).cast("bigint"))
    return tree_reduce(whole, keys, column, multiply_int, power_int)


_WIDTH = 512  # exp(512) is still far from overflow


def logaddexp_reduce(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys..., value, value2): log of the summed exponentials, natural and to base 2, stable for any size.

    One pass: exponentials are summed relative to the multiple of 512 below
    them, so a task's rows shrink to one for each group and multiple. Of these
    only the largest and the next one below it can still count, as exponentials
    further down vanish beside them; two aggregates keep them, and no list of
    multiples is ever built. NaN and infinities are multiples of their own. An
    empty table without keys gives minus infinity.
    """
    inf = float("inf")
    x = F.col(column).cast("double")
    # Base 2 is the same with every number scaled, so each row counts for both.
    both = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), (x * scale).alias("x")) for b, scale in ((0, 1.0), (1, 0.6931471805599453))]))
    each = rows.select(*keys, both.alias("_e")).select(*keys, F.col("_e.base").alias("_base"), F.col("_e.x").alias("_x"))
    odd_part = lambda x: F.isnan(x) | (F.abs(x) == inf)
    odd = odd_part(F.col("_x"))
    part = F.when(odd, F.col("_x")).otherwise(floor(F.col("_x") / _WIDTH) * float(_WIDTH))
    each = each.withColumn("_part", part).where("_x is not null")
    sums = each.groupBy(*keys, "_base", "_part").agg(F.sum(F.when(odd, 1.0).otherwise(F.exp(F.col("_x") - F.col("_part")))).alias("_sum"))
    # Of two neighbouring multiples one is even and one odd, so the largest of either kind are all that is needed.
    # NaN and infinity are the largest of all, count as even and decide alone.
    even = F.when(odd_part(F.col("_part")), True).otherwise(F.pmod(F.col("_part") / _WIDTH, F.lit(2.0)) == 0)
    largest = lambda b, kind: F.max(F.when((F.col("_base") == b) & (even if kind else ~even), F.struct("_part", "_sum")))
    kinds = sums.groupBy(*keys).agg(*[largest(b, kind).alias(f"_{'even' if kind else 'odd'}{b}") for b in (0, 1) for kind in (True, False)])

    def value(b: int, scale: float) -> Column:
        one, two = F.col(f"_even{b}"), F.col(f"_odd{b}")
        top = F.greatest(one["_part"], two["_part"])
        total = sum((F.coalesce(k["_sum"] * F.exp(k["_part"] - top), F.lit(0.0)) for k in (one, two)), F.lit(0.0))
        return F.when(top.isNull(), -inf).when(odd_part(top), top).otherwise((top + F.ln(total)) / scale)

    return kinds.select(*keys, value(0, 1.0).alias("value"), value(1, 0.6931471805599453).alias("value2"))


def gcd_reduce(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value): greatest common divisor of each group, by levels."""
    return tree_reduce(rows.withColumn(column, F.col(column).cast("bigint")), [key], column, gcd)
