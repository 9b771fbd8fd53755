"""Column functions against numpy and str."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradespark.functions import numeric as n
from gradespark.functions import strings as s

FLOATS = [0.0, -0.0, 1.5, -1.5, 2.5, -2.5, 0.5, -0.5, 1.0, -1.0, 3.0, -7.0, 7.25, 1e300, -1e17, float("nan"), float("inf"), float("-inf")]

ONE = [
    "absolute", "fabs", "negative", "positive", "reciprocal", "square", "sqrt", "cbrt", "exp", "exp2", "expm1", "log", "log2",
    "log10", "log1p", "sin", "cos", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "degrees", "radians",
    "rad2deg", "deg2rad", "ceil", "floor", "trunc", "rint", "sign", "isnan", "isinf", "isfinite", "signbit", "logical_not",
]
TWO = [
    "add", "subtract", "multiply", "divide", "fmod", "remainder", "floor_divide", "power", "float_power", "hypot",
    "logaddexp", "logaddexp2", "arctan2", "maximum", "minimum", "fmax", "fmin", "heaviside", "copysign",
    "equal", "not_equal", "greater", "greater_equal", "less", "less_equal", "logical_and", "logical_or", "logical_xor",
]
INT_TWO = ["bitwise_and", "bitwise_or", "bitwise_xor", "gcd", "lcm", "floor_divide_int", "left_shift", "right_shift"]


def same(mine, theirs):
    if isinstance(theirs, (bool, np.bool_)):
        return mine == bool(theirs)
    if math.isnan(theirs):
        return mine is not None and math.isnan(mine)
    return mine is not None and (mine == theirs or math.isclose(mine, theirs, rel_tol=1e-12, abs_tol=1e-300))


@pytest.mark.parametrize("name", ONE)
def test_unary(spark, name):
    rows = spark.createDataFrame([(x,) for x in FLOATS], "x double")
    got = [r[0] for r in rows.select(getattr(n, name)(F.col("x"))).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(np.array(FLOATS))
    bad = [(x, g, w) for x, g, w in zip(FLOATS, got, want) if not same(g, w)]
    assert not bad


@pytest.mark.parametrize("name,values", [("arccosh", [1.0, 2.5, 100.0]), ("arcsinh", [-2.0, 0.0, 3.0]), ("arctanh", [-0.5, 0.0, 0.9]), ("tan", [0.1, 1.0, -2.0])])
def test_inverse_hyperbolic(spark, name, values):
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in rows.select(getattr(n, name)(F.col("x"))).collect()]
    assert np.allclose(got, getattr(np, name)(np.array(values)), rtol=1e-12)


@pytest.mark.parametrize("name", TWO)
def test_binary(spark, name):
    pairs = [(x, y) for x in FLOATS for y in FLOATS]
    rows = spark.createDataFrame(pairs, "x double, y double")
    got = [r[0] for r in rows.select(getattr(n, name)(F.col("x"), F.col("y"))).collect()]
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    with np.errstate(all="ignore"):
        want = getattr(np, name)(a, b)
    bad = [(p, g, w) for p, g, w in zip(pairs, got, want) if not same(g, w)]
    assert not bad, bad[:5]


@pytest.mark.parametrize("name", INT_TWO)
def test_binary_int(spark, name):
    shift = "shift" in name
    left = [0, 1, -1, 7, -7, 12, -18, 2**40, -(2**40)]
    right = [0, 1, 3, 33, 63, 64, 70] if shift else [1, -1, 2, -2, 4, 6, -9, 0]
    pairs = [(x, y) for x in left for y in right]
    rows = spark.createDataFrame(pairs, "x bigint, y bigint")
    got = [r[0] for r in rows.select(getattr(n, name)(F.col("x"), F.col("y"))).collect()]
    fn = np.floor_divide if name == "floor_divide_int" else getattr(np, name)
    with np.errstate(all="ignore"):
        want = fn(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert [(p, g) for p, g, w in zip(pairs, got, want) if g != int(w)] == []


def test_structs_clip_and_counts(spark):
    rows = spark.createDataFrame([(x,) for x in FLOATS], "x double")
    got = rows.select(n.modf(F.col("x")), n.divmod(F.col("x"), F.lit(2.0)), n.clip(F.col("x"), F.lit(-1.0), F.lit(2.0))).collect()
    with np.errstate(all="ignore"):
        frac, whole = np.modf(np.array(FLOATS))
        quot, rest = np.divmod(np.array(FLOATS), 2.0)
        clipped = np.clip(np.array(FLOATS), -1.0, 2.0)
    for i, (m, d, c) in enumerate(got):
        assert same(m[0], frac[i]) and same(m[1], whole[i]) and same(c, clipped[i])
        assert same(d[0], quot[i]) and same(d[1], rest[i]), FLOATS[i]
    ints = [0, 1, -1, 255, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(x,) for x in ints], "x bigint")
    assert [r[0] for r in rows.select(n.bitwise_count(F.col("x"))).collect()] == [int(v) for v in np.bitwise_count(np.array(ints))]
    assert [r[0] for r in rows.select(n.invert(F.col("x"))).collect()] == [~x for x in ints]
    assert [r[0] for r in rows.select(n.ones_like(F.col("x"), "bigint")).collect()] == [1] * len(ints)


def test_one_decimal_rounds_like_python(spark):
    values = [i / 1000 for i in range(0, 100050, 7)] + [0.25, 0.35, 0.75, 78.65, 93.85, 100.0, 0.05, 0.15] + [p / q * 100 for q in (164, 158, 40, 8, 3) for p in range(q + 1)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in rows.select(n.one_decimal(F.col("x"))).collect()]
    assert [(v, g) for v, g in zip(values, got) if g != "%.1f" % v] == []


TEXTS = [
    "", " ", "abc", "ABC", "Abc Def", "aBc", "a1", "12", "1²", "½", "Ⅷ", "été", "ÉTÉ", "\t x \n", "a\tbc\td\r\te\n\tf", "+42", "-7.5", "x--x--x",
    "aaaa", "😀b😀", "  ", "\x1c\x1f", "They're Bill's", "ǅabc", "ªb", "①", "a.b.c", "..a..", "ab" * 9,
]


@pytest.mark.parametrize(
    "name,args",
    [("center", (9, "*")), ("center", (10, "*")), ("ljust", (6, "-")), ("rjust", (6, "-")), ("zfill", (6,)), ("expandtabs", (4,)),
     ("expandtabs", (8,)), ("startswith", ("a",)), ("startswith", ("b", 1, 3)), ("endswith", ("c",)), ("endswith", ("b", 0, 2)), ("find", ("b",)),
     ("find", ("x", 1, -1)), ("find", ("",)), ("rfind", ("a",)), ("rfind", ("--",)), ("rfind", ("x", 0, 4)), ("rfind", ("",)), ("count", ("a",)), ("count", ("aa",)),
     ("count", ("",)), ("count", ("a", 1, 4)), ("isalpha", ()), ("isdecimal", ()), ("isdigit", ()), ("isnumeric", ()), ("isalnum", ()),
     ("isspace", ()), ("islower", ()), ("isupper", ()), ("istitle", ()), ("replace", ("a", "zz")), ("replace", (".", "", 1)), ("replace", ("--", "+", 2)), ("replace", ("a", "b", 0))],
)
def test_string_methods(spark, name, args):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in rows.select(getattr(s, name)(F.col("t"), *args)).collect()]
    want = [getattr(t, name)(*args) for t in TEXTS]
    assert [(t, g, w) for t, g, w in zip(TEXTS, got, want) if g != w] == []


def test_strip_partition_slice(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.col("t")
    got = rows.select(
        s.strip_whitespace(t), s.lstrip_whitespace(t), s.rstrip_whitespace(t), s.strip_chars(t, "a."), s.lstrip_chars(t, "a."),
        s.rstrip_chars(t, "a."), s.partition(t, "--"), s.rpartition(t, "--"), s.str_len(t), s.expandtabs_length(t, 4),
    ).collect()
    for x, r in zip(TEXTS, got):
        assert list(r)[:6] == [x.strip(), x.lstrip(), x.rstrip(), x.strip("a."), x.lstrip("a."), x.rstrip("a.")], x
        assert tuple(r[6]) == x.partition("--") and tuple(r[7]) == x.rpartition("--")
        assert r[8] == len(x) and r[9] == len(x.expandtabs(4))
    cuts = [(None, None, 1), (1, None, 1), (None, -1, 1), (-3, -1, 1), (1, 5, 2), (None, None, 3), (None, None, -1), (4, 0, -2), (-1, None, -2), (2, 1, 1), (0, 9, 2), (None, 1, -1)]
    got = rows.select(*[s.slice(t, *c) for c in cuts]).collect()
    for x, r in zip(TEXTS, got):
        for c, g in zip(cuts, r):
            assert g == x[c[0] : c[1] : c[2]], (x, c)


def test_index_raises(spark):
    rows = spark.createDataFrame([("abc",)], "t string")
    assert rows.select(s.index(F.col("t"), "c"), s.rindex(F.col("t"), "a")).first() == (2, 0)
    with pytest.raises(Exception, match="substring not found"):
        rows.select(s.index(F.col("t"), "z")).collect()


def test_intervals(spark):
    import datetime as dt

    cases = [(dt.timedelta(days=5, seconds=3), dt.timedelta(hours=7)), (dt.timedelta(days=-5, microseconds=1), dt.timedelta(hours=7)), (dt.timedelta(1), dt.timedelta(hours=-5))]
    rows = spark.createDataFrame(cases, "x interval day to second, y interval day to second")
    got = rows.select(n.divide_interval(F.col("x"), F.col("y")), n.divmod_interval(F.col("x"), F.col("y"))).collect()
    for (x, y), (q, d) in zip(cases, got):
        assert q == x / y and tuple(d) == divmod(x, y)


@pytest.mark.parametrize("new", ["-", "$1", "\\\\", ""])
@pytest.mark.parametrize("limit", [None, -1, 0, 1, 2, 5, 40])
def test_replace_of_the_empty_text(spark, new, limit):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    got = [r[0] for r in rows.select(s.replace(F.col("s"), "", new, limit)).collect()]
    assert got == [t.replace("", new, -1 if limit is None else limit) for t in TEXTS]


def test_every_character_that_is_numeric(spark):
    chars = [chr(i) for i in range(0x20, 0x30000) if not 0xD800 <= i < 0xE000 and (chr(i).isnumeric() or i % 97 == 0)]
    rows = spark.createDataFrame([(c,) for c in chars], "s string")
    bad = [(hex(ord(r[0])), r[1]) for r in rows.select("s", s.isnumeric(F.col("s"))).collect() if r[1] != r[0].isnumeric()]
    # The JVM's tables may lack the newest characters.
    assert [b for b in bad if b[1]] == [] and all(int(b[0], 16) > 0xFFFF for b in bad)


def test_any_type_compares(spark):
    rows = spark.sql("select timestamp_ntz'2020-01-01' a, timestamp_ntz'2021-01-01' b, interval 1 day i, interval -2 day j, true t, false f, cast('nan' as float) n, 1.0f o")
    got = rows.select(
        n.less(F.col("a"), F.col("b")), n.minimum(F.col("i"), F.col("j")), n.sign(F.col("j")), n.isfinite(F.col("a")), n.fmax(F.col("t"), F.col("f")),
        n.isnan(F.col("n")), n.minimum(F.col("o"), F.col("n")), n.fmin(F.col("o"), F.col("n")), n.equal(F.col("n"), F.col("n")), n.isinf(F.col("i")),
    ).first()
    assert (got[0], got[1].days, got[2], got[3], got[4], got[5]) == (True, -2, -1.0, True, True, True)
    assert math.isnan(got[6]) and got[7] == 1.0 and got[8] is False and got[9] is False
