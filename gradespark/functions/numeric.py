"""Array-library number functions as Column expressions.

Spark and the array functions differ at the edges: Spark's ANSI division
raises, its rounding functions return BIGINT, its logarithms give NULL outside
their domain, and NaN equals itself. Each function below follows the array
semantics. NULL stands for a missing value and stays NULL.

Comparisons, classes, ``sign``, ``clip`` and the minima and maxima take any
type: numbers, dates, timestamps, intervals, booleans. A Column does not know
its type before it is analysed, so arithmetic whose loops differ by type takes it as ``of``:
"float" (the default), "integer" (exact 64-bit results; division by
zero gives 0) or "boolean".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def _d(x: Column) -> Column:
    return x.cast("double")


def _guard(x: Column, value: Column) -> Column:
    """``value``, but NaN and infinities as they are."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(value)


def _nan_if(condition: Column, value: Column) -> Column:
    return F.when(condition, NAN).otherwise(value)


def _is(x: Column, value: float) -> Column:
    """True where ``x``, of any type, is this floating-point number.

    The hash of one number is one-to-one, and takes every type; the type test
    is folded away, and with it the hash unless ``x`` is a floating-point column.
    """
    kind, hashed = F.typeof(x), F.xxhash64(x)
    wide, narrow = F.xxhash64(F.lit(value)), F.xxhash64(F.lit(value).cast("float"))
    same = F.when(kind == "double", hashed == wide).when(kind == "float", hashed == narrow).otherwise(False)
    return F.when(x.isNotNull(), same)


def is_nan(x: Column) -> Column:
    """True for NaN, of a column of any type: only numbers can be."""
    return F.coalesce(_is(x, NAN), F.lit(False))


def _either_nan(x: Column, y: Column) -> Column:
    return _is(x, NAN) | _is(y, NAN)


def _int(x: Column) -> Column:
    return x.cast("bigint")


def _loop(of: str, **loops):
    if of not in loops:
        raise ValueError(f"no loop for {of!r}, only for {sorted(loops)}")
    return loops[of]()


# --- arithmetic --------------------------------------------------------------


def add(x, y, of="float"):
    return _loop(of, float=lambda: x + y, integer=lambda: x + y, boolean=lambda: x | y)


def subtract(x, y):
    return x - y


def multiply(x, y, of="float"):
    return _loop(of, float=lambda: x * y, integer=lambda: x * y, boolean=lambda: x & y)


def divide(x, y):
    """True division; by zero it gives an infinity or NaN."""
    x, y = _d(x), _d(y)
    return F.when(y == 0, x * F.when(signbit(y), -INF).otherwise(INF)).otherwise(F.try_divide(x, y))


def fmod(x, y, of="float"):
    """Remainder with the sign of the dividend."""
    return _loop(of, float=lambda: F.when(_d(y) == 0, NAN).otherwise(F.try_mod(_d(x), _d(y))), integer=lambda: _int_rest(x, y))


def _int_rest(x, y):
    # NULL only for missing values; by zero it is 0.
    return F.when(x.isNotNull() & y.isNotNull(), F.coalesce(F.try_mod(_int(x), _int(y)), F.lit(0).cast("bigint")))


def remainder(x, y, of="float"):
    """Remainder with the sign of the divisor."""
    rest = fmod(x, y, of)
    y = _int(y) if of == "integer" else _d(y)
    other_sign = (rest < 0) != (y < 0) if of == "integer" else signbit(rest) != signbit(y)
    return F.when((rest != 0) & other_sign, rest + y).otherwise(rest)


def floor_divide(x, y, of="float"):
    if of == "integer":
        return F.when(x.isNotNull() & y.isNotNull(), floor_divide_int(_int(x), _int(y)))
    x, y = _d(x), _d(y)
    rest = fmod(x, y)
    below = (rest != 0) & (signbit(rest) != signbit(y))
    quotient = F.try_divide(x - rest, y) - below.cast("double")
    return F.when(y == 0, divide(x, y)).otherwise(_guard(quotient, F.rint(quotient)))


def floor_divide_int(x, y):
    """Exact floor division of integers; by zero it gives 0, and the least one by -1 itself."""
    least, y = F.lit(-(2**63)), F.when(y != 0, y)
    down = (x % y != 0) & ((x < 0) != (y < 0))
    turned = F.when(x == least, x).otherwise(-x)
    return F.when(y == -1, turned).otherwise(F.coalesce(F.call_function("div", x, y) - down.cast("bigint"), F.lit(0).cast("bigint")))


def _with(x, y, body):
    """``body`` of two columns that it uses often, each computed once."""
    return F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda s: body(s["x"], s["y"])), 0)


def multiply_int(x, y):
    """Product of 64-bit integers modulo 2^64, as the integer loop wraps around."""
    return _with(_int(x), _int(y), _multiply_int)


def _multiply_int(x, y):
    part = lambda v, i: F.shiftrightunsigned(v, 16 * i).bitwiseAND(F.lit(0xFFFF))
    a, b, sums = [part(x, i) for i in range(4)], [part(y, i) for i in range(4)], []
    for k in range(4):
        total = sum((a[i] * b[k - i] for i in range(1, k + 1)), a[0] * b[k])
        sums.append(total + F.shiftrightunsigned(sums[-1], 16) if sums else total)
    low, *rest = [s.bitwiseAND(F.lit(0xFFFF)) for s in sums]
    for i, limb in enumerate(rest, 1):
        low = low.bitwiseOR(F.shiftleft(limb, 16 * i))
    return F.coalesce(F.try_multiply(x, y), low)


def power_int(x, n):
    """``x`` to the power of a positive integer modulo 2^64, by squaring."""
    bits = F.sequence(F.lit(0), F.floor(F.log2(n.cast("double"))).cast("int") + 1)
    start = F.struct(F.lit(1).cast("bigint").alias("done"), x.alias("square"))

    def step(s, i):
        bit = F.call_function("shiftright", n, i).bitwiseAND(F.lit(1).cast("bigint"))
        return F.struct(F.when(bit == 1, _multiply_int(s["done"], s["square"])).otherwise(s["done"]).alias("done"), _multiply_int(s["square"], s["square"]).alias("square"))

    return F.when(n == 1, x).otherwise(F.aggregate(bits, start, step, lambda s: s["done"]))


def divmod(x, y, of="float"):  # noqa: A001
    return F.struct(floor_divide(x, y, of).alias("quotient"), remainder(x, y, of).alias("remainder"))


def absolute(x, of="float"):
    return _loop(of, float=lambda: F.abs(x), integer=lambda: F.abs(x), boolean=lambda: x)


def fabs(x):
    return F.abs(_d(x))


def negative(x):
    return -x


def positive(x):
    return x


def reciprocal(x, of="float"):
    """1 / x; of integers it is truncated, and of 0 missing."""
    return _loop(of, float=lambda: divide(F.lit(1.0), x), integer=lambda: F.when(F.abs(x) == 1, _int(x)).when(x != 0, F.lit(0).cast("bigint")))


def square(x):
    return x * x


def sqrt(x):
    return F.sqrt(_d(x))


def cbrt(x):
    return F.cbrt(_d(x))


def power(x, y, of="float"):
    """1 to any power is 1, and so is -1 to an infinite one.

    Of integers it is exact, an error beyond 64 bits or for a negative exponent.
    """
    if of == "integer":
        return _int_power(_int(x), _int(y))
    x, y = _d(x), _d(y)
    one = (x == 1) & y.isNotNull() | (x == -1) & (F.abs(y) == INF)
    return F.when(one, 1.0).otherwise(F.pow(x, y))


def _int_power(x, y):
    whole = lambda v: F.lit(v).cast("bigint")
    # From 2 on, 63 factors are all a 64-bit number can take; one more overflows, as it should.
    product = F.aggregate(F.array_repeat(x, F.least(y, F.lit(64)).cast("int")), whole(1), lambda a, b: a * b)
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None).cast("bigint"))
        .when(y < 0, F.raise_error(F.lit("integers have no negative powers")).cast("bigint"))
        .when((y == 0) | (x == 1), whole(1))
        .when(x == 0, whole(0))
        .when(x == -1, F.when(y % 2 == 0, whole(1)).otherwise(whole(-1)))
        .otherwise(product)
    )


def float_power(x, y):
    return power(x, y)


def hypot(x, y):
    return F.hypot(x, y)


def _micros(interval: Column) -> Column:
    """A day-time interval in microseconds."""
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + interval)


def interval_micros(interval: Column) -> Column:
    """A day-time interval in microseconds, as a decimal that leaves room for sums; the same in every time zone."""
    whole = interval.cast("interval day to second")
    part = lambda unit: F.extract(F.lit(unit), whole)
    hours = part("DAY").cast("bigint") * 24 + part("HOUR")
    micros = (hours * 60 + part("MINUTE")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")
    return micros.cast("decimal(20,0)")


def micros_interval(micros: Column) -> Column:
    """The interval of a whole number of microseconds; raises where no interval is as long."""
    return F.expr("interval '0.000001' second") * micros


def divide_interval(x, y):
    """How often an interval fits into another one."""
    return divide(_micros(x), _micros(y))


def floor_divide_interval(x, y):
    return floor_divide_int(_micros(x), _micros(y))


def remainder_interval(x, y):
    """The interval left by ``floor_divide_interval``; NULL for an empty divisor."""
    a, b = _micros(x), _micros(y)
    rest = F.when(b != 0, a - floor_divide_int(a, b) * b)
    return F.make_dt_interval(secs=(rest / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def divmod_interval(x, y):
    return F.struct(
        floor_divide_interval(x, y).alias("quotient"), remainder_interval(x, y).alias("remainder")
    )


def ones_like(x, dtype: str = "double"):
    """1 for every value that is there."""
    return F.when(x.isNotNull(), F.lit(1).cast(dtype))


# --- exponentials and logarithms ---------------------------------------------


def exp(x):
    return F.exp(x)


def exp2(x):
    return F.pow(F.lit(2.0), _d(x))


def expm1(x):
    return F.expm1(x)


def _log(x, value, edge: float):
    return F.when(x > edge, value).when(x == edge, -INF).when(x.isNotNull(), NAN)


def log(x):
    x = _d(x)
    return _log(x, F.when(F.isnan(x), NAN).otherwise(F.ln(x)), 0.0)


def log2(x):
    x = _d(x)
    return _log(x, F.when(F.isnan(x), NAN).otherwise(F.log2(x)), 0.0)


def log10(x):
    x = _d(x)
    return _log(x, F.when(F.isnan(x), NAN).otherwise(F.log10(x)), 0.0)


def log1p(x):
    x = _d(x)
    return _log(x, F.when(F.isnan(x), NAN).otherwise(F.log1p(x)), -1.0)


def logaddexp(x, y):
    """log(exp(x) + exp(y)); equal arguments, infinities too, add ln 2."""
    x, y = _d(x), _d(y)
    far = F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
    return _nan_if(_either_nan(x, y), F.when(x == y, x + F.lit(0.6931471805599453)).otherwise(far))


def logaddexp2(x, y):
    """log2(2**x + 2**y)."""
    x, y = _d(x), _d(y)
    far = F.greatest(x, y) + F.log1p(exp2(-F.abs(x - y))) / F.lit(0.6931471805599453)
    return _nan_if(_either_nan(x, y), F.when(x == y, x + 1).otherwise(far))


# --- trigonometry ------------------------------------------------------------


def sin(x):
    return F.sin(x)


def cos(x):
    return F.cos(x)


def tan(x):
    return F.tan(x)


def arcsin(x):
    return F.asin(x)


def arccos(x):
    return F.acos(x)


def arctan(x):
    return F.atan(x)


def arctan2(y, x):
    """Spark's own function takes -0.0 for 0.0."""
    y, x = _d(y), _d(x)
    flat = copysign(F.when(signbit(x), F.pi()).otherwise(0.0), y)
    return F.when((y == 0) & ~F.isnan(x), flat).otherwise(F.atan2(y, x))


def sinh(x):
    return F.sinh(x)


def cosh(x):
    return F.cosh(x)


def tanh(x):
    return F.tanh(x)


def arcsinh(x):
    return F.asinh(x)


def arccosh(x):
    return F.acosh(x)


def arctanh(x):
    return F.atanh(x)


def degrees(x):
    return F.degrees(x)


def radians(x):
    return F.radians(x)


rad2deg = degrees
deg2rad = radians


# --- rounding ----------------------------------------------------------------


def ceil(x, of="float"):
    return x if of == "integer" else _guard(_d(x), _wide(_d(x), F.ceil(_d(x))))


def floor(x, of="float"):
    return x if of == "integer" else _guard(_d(x), _wide(_d(x), F.floor(_d(x))))


def _wide(x, rounded):
    """The rounded value, but x itself where every double is an integer."""
    return F.when(F.abs(x) >= float(1 << 52), x).otherwise(rounded.cast("double"))


def trunc(x, of="float"):
    return x if of == "integer" else F.when(_d(x) < 0, ceil(x)).otherwise(floor(x))


def rint(x):
    return F.rint(_d(x))


def modf(x):
    """(fraction, integral); an infinity has the fraction 0."""
    x = _d(x)
    whole = trunc(x)
    fraction = F.when(F.abs(x) == INF, copysign(F.lit(0.0), x)).otherwise(x - whole)
    return F.struct(fraction.alias("fraction"), whole.alias("integral"))


def clip(x, low, high):
    return minimum(maximum(x, low), high)


# --- comparison --------------------------------------------------------------


def equal(x, y):
    return (x == y) & ~_either_nan(x, y)


def not_equal(x, y):
    return (x != y) | _either_nan(x, y)


def greater(x, y):
    return (x > y) & ~_either_nan(x, y)


def greater_equal(x, y):
    return (x >= y) & ~_either_nan(x, y)


def less(x, y):
    return (x < y) & ~_either_nan(x, y)


def less_equal(x, y):
    return (x <= y) & ~_either_nan(x, y)


def maximum(x, y):
    """The larger one; NaN if either is NaN, NULL if either is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


def minimum(x, y):
    smaller = F.when(_is(x, NAN), x).when(_is(y, NAN), y).otherwise(F.least(x, y))
    return F.when(x.isNotNull() & y.isNotNull(), smaller)


def fmax(x, y):
    """The larger one; NaN only if both are NaN."""
    return F.when(_is(x, NAN), y).when(_is(y, NAN), x).otherwise(F.greatest(x, y))


def fmin(x, y):
    return F.when(_is(x, NAN), y).when(_is(y, NAN), x).otherwise(F.least(x, y))


def heaviside(x, y):
    x, y = _d(x), _d(y)
    return F.when(F.isnan(x), NAN).when(x < 0, 0.0).when(x == 0, y).when(x > 0, 1.0)


def sign(x):
    return F.signum(x)


# --- logic and bits ----------------------------------------------------------


def _truth(x):
    return _d(x) != 0


def logical_and(x, y):
    return _truth(x) & _truth(y)


def logical_or(x, y):
    return _truth(x) | _truth(y)


def logical_xor(x, y):
    return _truth(x) != _truth(y)


def logical_not(x):
    return ~_truth(x)


def bitwise_and(x, y, of="integer"):
    return _loop(of, integer=lambda: x.bitwiseAND(y), boolean=lambda: x & y)


def bitwise_or(x, y, of="integer"):
    return _loop(of, integer=lambda: x.bitwiseOR(y), boolean=lambda: x | y)


def bitwise_xor(x, y, of="integer"):
    return _loop(of, integer=lambda: x.bitwiseXOR(y), boolean=lambda: x != y)


def invert(x, of="integer"):
    return _loop(of, integer=lambda: F.bitwise_not(x), boolean=lambda: ~x)


def bitwise_count(x):
    """Bits set in the absolute value."""
    x = x.cast("bigint")
    return F.when(x == -(1 << 63), 1).otherwise(F.bit_count(F.abs(F.greatest(x, F.lit(1 - (1 << 63))))))


def left_shift(x, n):
    """Shift as 64-bit number; Spark alone would wrap the count."""
    return F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftleft", x.cast("bigint"), n.cast("int"))
    )


def right_shift(x, n):
    return F.call_function("shiftright", x.cast("bigint"), F.least(n, F.lit(63)).cast("int"))


#: Euclid's divisions of two 64-bit integers are at most so many.
_DIVISIONS = 93


def _magnitude(x):
    """Absolute value; the least integer stays."""
    return F.when((x < 0) & (x != -(2**63)), -x).otherwise(x)


def gcd(x, y):
    """Greatest common divisor, by Euclid; not negative but for the least integer."""
    return _with(_int(x), _int(y), _gcd)


def _gcd(x, y):
    start = F.struct(x.alias("a"), y.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    divided = F.aggregate(F.sequence(F.lit(1), F.lit(_DIVISIONS)), start, step, lambda s: _magnitude(s["a"]))
    # Most often one divides the other.
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None).cast("bigint")).when(y == 0, _magnitude(x)).when(x == 0, _magnitude(y))
        .when(y % F.when(x != 0, x) == 0, _magnitude(x)).when(x % F.when(y != 0, y) == 0, _magnitude(y)).otherwise(divided)
    )


def lcm(x, y):
    """Least common multiple modulo 2^64, 0 if either is 0."""
    x, y = _int(x), _int(y)
    divisor = gcd(x, y)
    share = F.call_function("div", _magnitude(x), F.when(divisor != 0, divisor))
    return F.when((x == 0) | (y == 0), F.lit(0).cast("bigint")).otherwise(multiply_int(share, _magnitude(y)))


# --- classes of floats -------------------------------------------------------


isnan = is_nan


def isinf(x):
    return _is(x, INF) | _is(x, -INF)


def isfinite(x):
    return ~isnan(x) & ~isinf(x)


def isnat(x):
    """A missing time is NULL."""
    return x.isNull()


def signbit(x):
    """True for negative numbers and for -0.0, which only its text tells from 0.0."""
    x = _d(x)
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def copysign(x, y):
    size = F.abs(_d(x))
    return F.when(signbit(y), -size).otherwise(size)


# --- labels ------------------------------------------------------------------


def one_decimal(x: Column) -> Column:
    """``'%.1f' % x`` for x >= 0, rounding the exact binary value half to even."""
    tenths = F.floor(x * 10).cast("bigint")
    odd = tenths * 2 + 1
    middle = odd / F.lit(20.0)
    # Where x is the double next to the midpoint, the sign of 20*middle - odd,
    # taken without rounding error, says on which side it lies.
    big, small = middle * 16, middle * 4
    total = big + small
    rest = (big - (total - small)) + (small - (total - (total - small)))
    side = (total - odd) + rest
    up = (x > middle) | ((x == middle) & ((side > 0) | ((side == 0) & (tenths % 2 == 1))))
    rounded = tenths + up.cast("bigint")
    whole = F.floor(rounded / 10).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), (rounded % 10).cast("string"))
