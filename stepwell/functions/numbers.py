"""Rounding as Python does it, and other scalar helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used (also inside a lambda)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_round(value: Column, digits: int) -> Column:
    """``round(value, digits)`` of the exact binary value, half to even.

    Spark's ``round`` works on the decimal text of a double (2.675 gives 2.68,
    not 2.67), so exact parity needs Python; batches travel as Arrow.
    """

    @F.arrow_udf("double")
    def rounded(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, digits) for v in values.to_pylist()], pa.float64())

    return rounded(value.cast("double"))


def half_even(value: Column) -> Column:
    """The nearest integer as long, ties to even."""
    return F.rint(value).cast("long")


def rate(numerator: Column, denominator: Column) -> Column:
    """Null, not 0, over nothing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def md5_mod(text: Column, modulus: int) -> Column:
    """The 128-bit MD5 of a text, as a number, modulo ``modulus`` (at most 2**55): Horner's rule over hex digits."""
    digits = F.filter(F.split(F.md5(text.cast("binary")), ""), lambda d: d != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % modulus)


def seeded_order(seed: int, *keys: Column) -> Column:
    """A reproducible shuffle order: the MD5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def strip(text: Column) -> Column:
    """Without white space (any Unicode space) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def slug(text: Column) -> Column:
    return F.translate(F.lower(text), " -", "__")


def template_of(task_id: Column) -> Column:
    """A task's template: its id without the last dash and what follows."""
    return F.regexp_replace(task_id, "-[^-]*$", "")
