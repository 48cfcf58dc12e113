"""Two readings of one rule: over columns, and over the plain values of a single call.

A tool is written once against these operations.  ``Columns`` builds an
expression; ``Plain`` computes at once, for a call that a model has just made.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers

OUTCOME = "struct<result: string, error_type: string, error: string>"
ARGUMENT, EXECUTION = "ToolArgumentError", "ToolExecutionError"


class ToolFailure(Exception):
    """kind: the error's class name."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def outcome(result: Column, *failures: tuple[Column, str, Column | str]) -> Column:
    """The first failure whose condition holds, else the result as JSON."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    kind, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, message in reversed(failures):
        kind, why = F.when(condition, F.lit(name)).otherwise(kind), F.when(condition, text(message)).otherwise(why)
    return F.struct(F.when(kind.isNull(), F.to_json(result)).alias("result"), kind.alias("error_type"), why.alias("error"))


class Columns:
    """Arguments are columns; a call is STRUCT<result, error_type, error>."""

    def number(self, v: Column) -> Column:
        return v.cast("double")

    def key(self, v: Column) -> Column:
        return F.lower(numbers.strip(v))

    def stripped(self, v: Column) -> Column:
        return numbers.strip(v)

    def _map(self, table: dict) -> Column:
        return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))

    def lookup(self, table: dict, key: Column) -> Column:
        return F.try_element_at(self._map(table), key)

    def entries(self, table: dict, text: Column) -> Column:
        return F.map_filter(self._map(table), lambda k, v: k.contains(text) | F.lower(v).contains(text))

    def size(self, found: Column) -> Column:
        return F.size(found)

    def by(self, key: Column, cases: dict[str, Callable]) -> Column:
        out = F.lit(None).cast("double")
        for name, value in cases.items():
            out = F.when(key == name, value()).otherwise(out)
        return out

    def choose(self, condition: Column, yes, no) -> Column:
        return F.when(condition, F.lit(yes) if isinstance(yes, str) else yes).otherwise(F.lit(no) if isinstance(no, str) else no)

    def first(self, a: Column, b: Callable[[], Column]) -> Column:
        return F.coalesce(a, b())

    def missing(self, v: Column) -> Column:
        return v.isNull()

    def unusual(self, v: Column) -> Column:
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    def either(self, a: Column, b: Column) -> Column:
        return a | b

    def matches(self, v: Column, pattern: str) -> Column:
        return v.rlike(pattern)

    def magnitude(self, v: Column) -> Column:
        return F.abs(v)

    def ratio(self, a: Column, b: Column) -> Column:
        return F.try_divide(a, b)

    def round(self, v: Column, digits: int) -> Column:
        return numbers.py_round(v, digits)

    def md5_mod(self, text: Column, modulus: int) -> Column:
        return numbers.md5_mod(text, modulus)

    def joined(self, mark: str, *texts: Column) -> Column:
        return F.array_join(F.array_sort(F.array(*texts)), mark)

    def date(self, v: Column) -> Column:
        return F.when(v.rlike(r"^\d+-\d+-\d+$"), F.try_to_date(v, "y-M-d"))

    def year(self, d: Column) -> Column:
        return F.year(d)

    def day_of(self, d: Column) -> Column:
        return F.month(d) * 100 + F.day(d)

    def whole(self, condition: Column) -> Column:
        return condition.cast("int")

    def answer(self, result: Callable[[], dict], *failures) -> Column:
        """failures: (condition, kind, words and values of the message), the first that holds counts."""
        told = [(test(), kind, F.concat(*(F.lit(w) if isinstance(w, str) else w for w in words))) for test, kind, *words in failures]
        return outcome(F.struct(*((F.lit(v) if not isinstance(v, Column) else v).alias(k) for k, v in result().items())), *told)

    def by_python(self, run: Callable[..., dict], *columns: Column) -> Column:
        """A tool in Python over Arrow batches; a ValueError or arithmetic error is an argument error."""

        @F.arrow_udf(OUTCOME)
        def tool(*arrays: pa.Array) -> pa.Array:
            rows = []
            for values in zip(*(a.to_pylist() for a in arrays)):
                try:
                    rows.append({"result": json.dumps(run(*values)), "error_type": None, "error": None})
                except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError) as e:
                    rows.append({"result": None, "error_type": ARGUMENT, "error": str(e) or type(e).__name__})
            return pa.array(rows, pa.struct([("result", pa.string()), ("error_type", pa.string()), ("error", pa.string())]))

        return tool(*columns)


class Plain:
    """Arguments are values; a call gives its result or raises a ToolFailure."""

    def number(self, v):
        return v + 0  # a TypeError for what is no number

    def key(self, v: str) -> str:
        return v.strip().lower()

    def stripped(self, v: str) -> str:
        return v.strip()

    def lookup(self, table: dict, key):
        return table.get(key)

    def entries(self, table: dict, text: str) -> dict:
        return {k: v for k, v in table.items() if text in k or text in v.lower()}

    def size(self, found: dict) -> int:
        return len(found)

    def by(self, key, cases: dict[str, Callable]):
        return cases[key]() if key in cases else None

    def choose(self, condition: bool, yes, no):
        return yes if condition else no

    def first(self, a, b: Callable):
        return b() if a is None else a

    def missing(self, v) -> bool:
        return v is None

    def unusual(self, v) -> bool:
        return not math.isfinite(v)

    def either(self, a: bool, b: bool) -> bool:
        return a or b

    def matches(self, v: str, pattern: str) -> bool:
        import regex

        return regex.search(pattern, v) is not None

    def magnitude(self, v):
        return abs(v)

    def ratio(self, a, b):
        return a / b

    def round(self, v, digits: int):
        return round(v, digits)

    def md5_mod(self, text: str, modulus: int) -> int:
        return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest(), 16) % modulus

    def joined(self, mark: str, *texts: str) -> str:
        return mark.join(sorted(texts))

    def date(self, v: str):
        from datetime import date

        return date(*map(int, v.split("-")))

    def year(self, d) -> int:
        return d.year

    def day_of(self, d) -> int:
        return d.month * 100 + d.day

    def whole(self, condition: bool) -> int:
        return int(condition)

    def answer(self, result: Callable[[], dict], *failures) -> dict:
        for test, kind, *words in failures:
            if test():
                raise ToolFailure(kind, "".join(map(str, words)))
        return result()

    def by_python(self, run: Callable[..., dict], *values) -> dict:
        return run(*values)
