"""Exact decimals and quantities: nothing is rounded, an inexact result is an error value (null).

A value has at most 18 significant digits and 18 decimals.  Products and
quotients are taken on the whole numbers that the digits form, and are null
unless the true result fits again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 18
TYPE = f"decimal(38,{SCALE})"
WHOLE = "decimal(38,0)"
#: At most this many significant digits.
DIGITS = 18


def digits(c: Column) -> Column:
    """Significant digits of a decimal."""
    t = F.regexp_replace(F.regexp_replace(F.abs(c).cast("string"), r"(\.\d*?)0+$", "$1"), r"^0\.?0*|\.", "")
    return F.when(c == 0, 1).otherwise(F.length(t))


def exact(c: Column) -> Column:
    """The value if it has at most 18 significant digits, else null."""
    return F.when(digits(c) <= DIGITS, c)


def _term(c: Column) -> Column:
    """An operand of a sum, one digit narrower, so that the sum keeps all 18 decimals; null from 10**19 on."""
    return c.cast(TYPE).try_cast(f"decimal(37,{SCALE})")


def add(a: Column, b: Column) -> Column:
    return exact(F.try_add(_term(a), _term(b)).cast(TYPE))


def sub(a: Column, b: Column) -> Column:
    return exact(F.try_subtract(_term(a), _term(b)).cast(TYPE))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _whole(c: Column) -> Column:
    """The digits of a value's size as a whole number ``n`` without zeros at its end, and how many are decimals, ``s``."""
    one = F.lit(1).cast("decimal(1,0)")

    def parts(size: Column) -> Column:
        floor = F.floor(size)
        # one more, so that the text of a small fraction is never in powers of ten
        fraction = (size % one + one).cast("decimal(20,18)").cast("string").substr(3, SCALE)
        return F.concat(floor.cast(WHOLE).cast("string"), fraction)

    def split(text: Column) -> Column:
        short = F.regexp_replace(text, "0+$", "")
        number = F.when(F.length(short) == 0, F.lit("0")).otherwise(short).try_cast("decimal(18,0)")
        return F.struct(number.alias("n"), (SCALE - F.length(text) + F.length(short)).alias("s"))

    return _let(_let(F.abs(exact(c.cast(TYPE))), parts), split)


def _value(number: Column, decimals: Column, negative: Column) -> Column:
    """``number`` (text of a whole number) with that many decimals; null where the value has no place in TYPE."""

    def text(x: Column) -> Column:
        kept, scale = x["kept"], x["scale"]
        padded = F.lpad(kept, F.greatest(F.length(kept), scale + 1), "0")
        cut = F.length(padded) - scale
        below = F.concat(padded.substr(F.lit(1), cut), F.lit("."), padded.substr(cut + 1, scale))
        plain = F.when(scale > 0, below).otherwise(F.concat(kept, F.repeat(F.lit("0"), -scale)))
        fits = (F.length(kept) <= DIGITS) & (scale <= SCALE)
        signed = F.concat(F.when(negative, "-").otherwise(""), plain)
        return F.when(F.length(kept) == 0, F.lit(0).cast(TYPE)).when(fits, signed.try_cast(TYPE))

    def trimmed(x: Column) -> Column:
        short = F.regexp_replace(x["number"], "0+$", "")
        scale = x["decimals"] - F.length(x["number"]) + F.length(short)
        return F.struct(F.regexp_replace(short, "^0+", "").alias("kept"), scale.alias("scale"))

    return _let(_let(F.struct(number.alias("number"), decimals.alias("decimals")), trimmed), text)


def mul(a: Column, b: Column) -> Column:
    """Product, null where it has more than 18 significant digits or 18 decimals."""

    def product(x: Column) -> Column:
        n = F.try_multiply(x["a"]["n"], x["b"]["n"]).cast("string")
        return _value(n, x["a"]["s"] + x["b"]["s"], x["negative"])

    return _let(F.struct(_whole(a).alias("a"), _whole(b).alias("b"), ((a < 0) != (b < 0)).alias("negative")), product)


def div(a: Column, b: Column) -> Column:
    """Quotient, null where it does not end within 18 significant digits and 18 decimals, or b is 0.

    The divisor's digits have no zero at the end, so it is divisible by two or by
    five, not both; a quotient that ends after more than 36 places has more
    than 18 digits then, and 36 places decide.
    """
    up = F.lit(10**18).cast("decimal(19,0)")

    def step(value: Column, by: Column, before: Column) -> Column:
        def each(v: Column) -> Column:
            rest = (v % by).cast("decimal(18,0)")
            whole = ((v - rest) / by).cast(WHOLE).cast("string")
            return F.struct(F.concat(before, F.lpad(whole, 18, "0")).alias("q"), rest.alias("r"))

        return _let(value.cast(WHOLE), each)

    def quotient(x: Column) -> Column:
        by = x["b"]["n"]
        more = lambda y: step(y["r"] * up, by, y["q"])
        end = lambda y: F.when(y["r"] == 0, _value(y["q"], x["a"]["s"] - x["b"]["s"] + 36, x["negative"]))
        return F.when(by != 0, _let(_let(_let(step(x["a"]["n"], by, F.lit("")), more), more), end))

    return _let(F.struct(_whole(a).alias("a"), _whole(b).alias("b"), ((a < 0) != (b < 0)).alias("negative")), quotient)


def convert(amount: Column, numerator: int, denominator: int) -> Column:
    """A quantity in another unit, by a ratio; null where inexact."""
    return div(mul(amount, F.lit(numerator).cast(TYPE)), F.lit(denominator).cast(TYPE))


def same_unit(a: Column, b: Column) -> Column:
    """Quantities combine only if dimension, unit and revision agree."""
    return (a["dimension"] == b["dimension"]) & (a["unit"] == b["unit"]) & (a["revision"] == b["revision"])
