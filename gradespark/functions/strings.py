"""Array-library string functions as Column expressions.

Positions are 0-based code points; negative ones count from the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradespark.functions import text

# Digits that are not decimal digits (superscripts, subscripts,
# circled and other digit forms).
_OTHER_DIGITS = (
    r"\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c"
    r"\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
# Letters of Unicode that stand for numbers.
_IDEOGRAPHIC_NUMBERS = (
    "㐅㒃㠪㭍一七万三两九二五亖京亿什仟仨伍佰俩倆億兆兩八六十千卄卅卌叁参參叄四壱壹幺廾廿弌弍弎弐拐拾捌柒"
    "洞漆玖百皕秭肆萬貮貳贰鈎钩阡陆陌陸零參拾兩零六陸什𠀁𠁤𠃢𠄡𠤪𠦃𠦌𠦜𠫪𠫽𠬙𢎐𢦘𣬛𦉭廾"
)
_UPPER = r"[\p{IsUppercase}\p{Lt}]"
_LOWER = r"\p{IsLowercase}"
_CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"


def _lit(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _bounds(s: Column, start: int | None, end: int | None) -> tuple[Column, Column]:
    n = F.char_length(s)

    def place(at: int | None, default: Column) -> Column:
        if at is None:
            return default
        return F.least(F.lit(at), n) if at >= 0 else F.greatest(n + at, F.lit(0))

    return place(start, F.lit(0)), place(end, n)


def _window(s: Column, start: int | None, end: int | None) -> Column:
    low, high = _bounds(s, start, end)
    return F.substring(s, low + 1, F.greatest(high - low, F.lit(0)))


# --- padding and stripping ---------------------------------------------------


def str_len(s):
    return F.char_length(s)


def center(s, width: int, fill: str = " "):
    """Pad both sides; an odd blank goes left where the width is odd."""
    pad = F.greatest(F.lit(width) - F.char_length(s), F.lit(0))
    left = F.floor(pad / 2).cast("int") + (pad % 2) * (width % 2)
    return F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), (pad - left).cast("int")))


def ljust(s, width: int, fill: str = " "):
    return F.concat(s, F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.char_length(s), F.lit(0))))


def rjust(s, width: int, fill: str = " "):
    return F.concat(F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.char_length(s), F.lit(0))), s)


def zfill(s, width: int):
    """Pad with zeros behind a leading sign."""
    signed = s.rlike(r"\A[+-]")
    head = F.when(signed, F.substring(s, 1, 1)).otherwise("")
    body = F.when(signed, F.substring(s, F.lit(2), F.char_length(s))).otherwise(s)
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.char_length(s), F.lit(0)))
    return F.concat(head, zeros, body)


def strip_whitespace(s):
    return text.strip(s)


def lstrip_whitespace(s):
    return text.lstrip(s)


def rstrip_whitespace(s):
    return text.rstrip(s)


def strip_chars(s, chars: str):
    return F.btrim(s, F.lit(chars))


def lstrip_chars(s, chars: str):
    return F.ltrim(s, F.lit(chars))


def rstrip_chars(s, chars: str):
    return F.rtrim(s, F.lit(chars))


def expandtabs(s, tabsize: int = 8):
    """Tabs to blanks up to the next stop; a line end starts over at column 0."""
    if tabsize <= 0:
        return F.translate(s, "\t", "")

    def line(piece: Column) -> Column:
        cells = F.split(piece, "\t", -1)
        grown = F.aggregate(
            F.slice(cells, 2, F.size(cells)),
            F.element_at(cells, 1),
            lambda done, cell: F.concat(
                done, F.repeat(F.lit(" "), F.lit(tabsize) - F.char_length(done) % tabsize), cell
            ),
        )
        return grown

    # Splitting behind each line end keeps the line ends in place.
    return F.array_join(F.transform(F.split(s, r"(?<=[\n\r])", -1), line), "")


def expandtabs_length(s, tabsize: int = 8):
    return F.char_length(expandtabs(s, tabsize))


# --- search ------------------------------------------------------------------


def startswith(s, prefix, start: int | None = None, end: int | None = None):
    return _window(s, start, end).startswith(_lit(prefix))


def endswith(s, suffix, start: int | None = None, end: int | None = None):
    return _window(s, start, end).endswith(_lit(suffix))


def find(s, sub, start: int | None = None, end: int | None = None):
    """First position or -1."""
    low, _ = _bounds(s, start, end)
    at = F.call_function("instr", _window(s, start, end), _lit(sub))
    return F.when(at > 0, low + at - 1).when(at == 0, -1)


def rfind(s, sub, start: int | None = None, end: int | None = None):
    """Last position or -1."""
    low, _ = _bounds(s, start, end)
    window, sub = _window(s, start, end), _lit(sub)
    back = F.call_function("instr", F.reverse(window), F.reverse(sub))
    place = low + F.char_length(window) - F.char_length(sub) - back + 1
    return F.when(back > 0, place).when(back == 0, -1)


def _or_raise(at: Column) -> Column:
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at)


def index(s, sub, start: int | None = None, end: int | None = None):
    """Like ``find``, but a miss is an error."""
    return _or_raise(find(s, sub, start, end))


def rindex(s, sub, start: int | None = None, end: int | None = None):
    return _or_raise(rfind(s, sub, start, end))


def count(s, sub: str, start: int | None = None, end: int | None = None):
    """Non-overlapping occurrences; the empty string fits between all characters."""
    window = _window(s, start, end)
    if sub == "":
        return F.char_length(window) + 1
    gone = F.char_length(window) - F.char_length(F.replace(window, F.lit(sub), F.lit("")))
    return (gone / len(sub)).cast("int")


# --- splitting, replacing, slicing -------------------------------------------


def partition(s, sep: str):
    """(head, sep, tail) around the first separator."""
    at = F.call_function("instr", s, F.lit(sep))
    return F.struct(
        F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s).alias("head"),
        F.when(at > 0, F.lit(sep)).otherwise("").alias("sep"),
        F.when(at > 0, F.substring(s, at + len(sep), F.char_length(s))).otherwise("").alias("tail"),
    )


def rpartition(s, sep: str):
    """(head, sep, tail) around the last separator."""
    at = rfind(s, sep)
    return F.struct(
        F.when(at >= 0, F.substring(s, F.lit(1), at)).otherwise("").alias("head"),
        F.when(at >= 0, F.lit(sep)).otherwise("").alias("sep"),
        F.when(at >= 0, F.substring(s, at + len(sep) + 1, F.char_length(s))).otherwise(s).alias("tail"),
    )


def _spread(s, new: str, most: int | None):
    """``new`` before every character and at the end, ``most`` times from the left."""
    before = lambda text: F.array_join(F.transform(F.split(text, ""), lambda c: F.concat(F.lit(new), c)), "")
    spread = F.when(s == "", "").otherwise(before(s))
    if most is None:
        return F.concat(spread, F.lit(new))
    head = F.substring(s, 1, most)
    head = F.when(head == "", "").otherwise(before(head))
    end = F.when(F.char_length(s) < most, F.lit(new)).otherwise(F.substring(s, F.lit(most + 1), F.char_length(s)))
    return F.concat(head, end)


def replace(s, old: str, new: str, limit: int | None = None):
    """Replace all, or the first ``limit``, occurrences of a literal text."""
    if not old:
        return _spread(s, new, None if limit is None or limit < 0 else limit)
    if limit is None or limit < 0:
        return F.replace(s, F.lit(old), F.lit(new))
    # The last piece of a limited split is the untouched rest.
    escaped = "".join("\\" + c if not c.isalnum() else c for c in old)
    return F.array_join(F.split(s, escaped, limit + 1), new)


def slice(s, start: int | None = None, stop: int | None = None, step: int = 1):  # noqa: A001
    """``s[start:stop:step]``."""
    if step == 0:
        raise ValueError("step must not be 0")
    if step == 1:
        return _window(s, start, stop)
    if step > 1:
        window = _window(s, start, stop)
    else:
        n = F.char_length(s)
        first = n - 1 if start is None else (F.least(F.lit(start), n - 1) if start >= 0 else n + start)
        last = F.lit(-1) if stop is None else (F.lit(stop) if stop >= 0 else F.greatest(n + stop, F.lit(-1)))
        window = F.reverse(F.substring(s, last + 2, F.greatest(first - last, F.lit(0))))
    every = abs(step)
    kept = F.filter(F.split(window, ""), lambda c, i: i % every == 0)
    return F.array_join(kept, "")


# --- classes of text ---------------------------------------------------------


def isalpha(s):
    return s.rlike(r"\A\p{L}+\z")


def isdecimal(s):
    return s.rlike(r"\A\p{Nd}+\z")


def isdigit(s):
    return s.rlike(rf"\A[\p{{Nd}}{_OTHER_DIGITS}]+\z")


def isnumeric(s):
    return s.rlike(rf"\A[\p{{N}}{_IDEOGRAPHIC_NUMBERS}]+\z")


def isalnum(s):
    return s.rlike(r"\A[\p{L}\p{N}]+\z")


def isspace(s):
    return s.rlike(r"(?U)\A[\s\x1c-\x1f]+\z")


def islower(s):
    return s.rlike(_LOWER) & ~s.rlike(_UPPER)


def isupper(s):
    return s.rlike(_UPPER) & ~s.rlike(rf"[{_LOWER}\p{{Lt}}]")


def istitle(s):
    """Capitals only behind uncased characters, small letters only behind cased ones."""
    return (
        s.rlike(_UPPER)
        & ~s.rlike(rf"{_CASED}{_UPPER}")
        & ~s.rlike(rf"(?:\A|(?!{_CASED})(?s:.)){_LOWER}")
    )
