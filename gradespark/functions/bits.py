"""16-bit float patterns, read and written arithmetically.

Spark has neither half nor bfloat16. Both are sign, exponent and mantissa;
the value follows from these by exact double arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decode(bits: Column, mantissa_bits: int, exponent_bits: int) -> Column:
    bias = (1 << (exponent_bits - 1)) - 1
    full = (1 << exponent_bits) - 1
    raw = bits.cast("int").bitwiseAND(F.lit(0xFFFF))
    exponent = F.shiftright(raw, mantissa_bits).bitwiseAND(F.lit(full))
    fraction = raw.bitwiseAND(F.lit((1 << mantissa_bits) - 1)).cast("double") / float(1 << mantissa_bits)
    sign = F.when(raw >= 0x8000, F.lit(-1.0)).otherwise(F.lit(1.0))
    magnitude = (
        F.when((exponent == full) & (fraction > 0), F.lit(float("nan")))
        .when(exponent == full, F.lit(float("inf")))
        .when(exponent == 0, fraction * F.lit(2.0 ** (1 - bias)))
        .otherwise((fraction + 1) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    )
    return sign * magnitude


def decode_half(bits: Column) -> Column:
    """IEEE half: 5 exponent bits, 10 mantissa bits."""
    return _decode(bits, 10, 5)


def decode_bfloat16(bits: Column) -> Column:
    """bfloat16: the upper half of a float, 8 exponent and 7 mantissa bits."""
    return _decode(bits, 7, 8)


def dequantize(q: Column, scale: Column, bias: Column) -> Column:
    """Value of an 8-bit code."""
    return scale * q + bias
