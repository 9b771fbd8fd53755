"""Plain text out of RTF logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradespark.functions.text import let

# A code-unit escape, an ignorable group, a control word.
_UNIT = r"\\u(-?\d+)\??"
_UNIT_RUN = r"(?:\\u-?\d+\??)+"
_GROUP = r"\{\\[^}\n]*\}"
_CONTROL_WORD = r"\\[a-zA-Z]+\d* ?"
_REPLACEMENT = "FFFD"


def _decode_run(run: Column) -> Column:
    """Characters of one unbroken run of code-unit escapes."""
    units = F.transform(
        F.regexp_extract_all(run, F.lit(_UNIT), F.lit(1)),
        lambda n: F.lpad(
            F.hex(F.pmod(n.cast("decimal(38,0)"), F.lit(65536)).cast("bigint")), 4, "0"
        ),
    )

    def high(unit: Column) -> Column:
        return F.coalesce(unit.rlike("^D[89AB]"), F.lit(False))

    def low(unit: Column) -> Column:
        return F.coalesce(unit.rlike("^D[CDEF]"), F.lit(False))

    def pair(units: Column) -> Column:
        # A surrogate without its partner cannot be decoded: U+FFFD.
        return F.transform(
            units,
            lambda u, i: F.when(
                (high(u) & ~low(F.get(units, i + 1))) | (low(u) & ~high(F.get(units, i - 1))),
                F.lit(_REPLACEMENT),
            ).otherwise(u),
        )

    return F.decode(F.unhex(F.array_join(let(units, pair), "")), "UTF-16BE")


def rtf_to_text(rtf: Column) -> Column:
    """Decode escapes, then drop groups, control words and braces."""
    def decode(raw: Column) -> Column:
        return F.array_join(
            F.zip_with(
                F.split(raw, _UNIT_RUN, -1),
                F.regexp_extract_all(raw, F.lit(_UNIT_RUN), F.lit(0)),
                lambda text, run: F.concat(text, F.coalesce(_decode_run(run), F.lit(""))),
            ),
            "",
        )

    decoded = let(rtf, decode)
    text = F.regexp_replace(decoded, _GROUP, "")
    text = F.regexp_replace(text, _CONTROL_WORD, "")
    return F.translate(text, "{}", "")
