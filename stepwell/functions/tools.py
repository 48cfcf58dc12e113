"""The simulated tools, each written once against ``algebra``.

As a function of columns a tool gives STRUCT<result STRING (JSON), error_type
STRING, error STRING>: failure is a value, never an exception inside a task.
Only two need Python there (expression evaluation and rounding to a column's
number of places); they run on Arrow batches.  ``call_plain`` is the same tool
for one call of a model.
"""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tool_tables as T
from .algebra import ARGUMENT, EXECUTION, Columns, Plain, ToolFailure, outcome

#: name -> tool(algebra, *arguments), in the order of the signature.
RULES: dict[str, Callable] = {}


def rule(f: Callable) -> Callable:
    RULES[f.__name__] = f
    return partial(f, Columns())


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
#: A whole number of more digits cannot be written as text.
_MOST_DIGITS = 4300


def evaluate(expression: str):
    """The value of an arithmetic expression, by a whitelist of syntax nodes."""
    if not expression or set(expression) - set("0123456789+-*/(). "):
        raise ValueError("characters other than digits and + - * / ( ) .")

    def value(node):
        match node:
            case ast.Expression():
                return value(node.body)
            case ast.Constant() if type(node.value) in (int, float):
                return node.value
            case ast.BinOp() if type(node.op) in _OPERATORS:
                a, b = value(node.left), value(node.right)
                if isinstance(node.op, ast.Pow) and isinstance(a, int) and isinstance(b, int) and abs(a) > 1 and b * math.log10(abs(a)) > _MOST_DIGITS:
                    raise ValueError("power too large")
                return _OPERATORS[type(node.op)](a, b)
            case ast.UnaryOp() if type(node.op) in _OPERATORS:
                return _OPERATORS[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    return value(ast.parse(expression.strip(), mode="eval"))


@rule
def calculator(x, expression):
    return x.by_python(lambda e: {"expression": e, "result": evaluate(e)}, expression)


def _rounded_to(value: float, decimals: float) -> dict:
    if not math.isfinite(value):
        raise ValueError("value must be finite")
    if isinstance(decimals, bool) or decimals != int(decimals) or not 0 <= decimals <= 10:
        raise ValueError("decimals must be an integer from 0 to 10")
    return {"value": value, "decimals": int(decimals), "rounded": round(value, int(decimals))}


@rule
def round_number(x, value, decimals):
    return x.by_python(_rounded_to, value, decimals)


@rule
def get_weather(x, city):
    degrees, sky = (x.lookup({k: v[i] for k, v in T.WEATHER.items()}, x.key(city)) for i in (0, 1))
    return x.answer(lambda: {"city": city, "temperature_f": degrees, "condition": sky}, (lambda: x.missing(degrees), EXECUTION, "no weather for ", city))


def _looked_up(name: str, table: dict, argument: str, field: str) -> Callable:
    def tool(x, value):
        found = x.lookup(table, x.key(value))
        return x.answer(lambda: {argument: value, field: found}, (lambda: x.missing(found), EXECUTION, f"unknown {argument} ", value))

    tool.__name__ = name
    return rule(tool)


get_current_time = _looked_up("get_current_time", T.TIMES, "timezone", "current_time")
get_population = _looked_up("get_population", T.POPULATION_MILLIONS, "country", "population_millions")
get_capital = _looked_up("get_capital", T.CAPITALS, "country", "capital")
get_elevation = _looked_up("get_elevation", T.ELEVATIONS_M, "place", "elevation_m")


@rule
def search_knowledge_base(x, query):
    text = x.key(query)
    found = x.entries(T.KNOWLEDGE, text)
    return x.answer(lambda: {"query": query, "matches": found}, (lambda: text == "", ARGUMENT, "empty query"), (lambda: x.size(found) == 0, EXECUTION, "nothing about ", query))


def _converted(x, value, from_unit, to_unit, out):
    return {"value": value, "from_unit": from_unit, "to_unit": to_unit, "converted_value": x.round(out, 2)}


@rule
def convert_temperature(x, value, from_unit, to_unit):
    value, zero = x.number(value), T.ABSOLUTE_ZERO_C
    source, target = (x.lookup(T.TEMPERATURE_UNITS, x.key(u)) for u in (from_unit, to_unit))
    celsius = x.by(source, {"f": lambda: (value - 32) * 5 / 9, "k": lambda: value + zero, "c": lambda: value})
    there = lambda: x.by(target, {"f": lambda: celsius * 9 / 5 + 32, "k": lambda: celsius - zero, "c": lambda: celsius})
    known = lambda: x.either(x.missing(source), x.missing(target))
    return x.answer(lambda: _converted(x, value, from_unit, to_unit, there()), (known, ARGUMENT, "unknown temperature unit"), (lambda: celsius < zero, ARGUMENT, "below absolute zero"))


@rule
def convert_length(x, value, from_unit, to_unit):
    value = x.number(value)
    source, target = (x.lookup(T.METRES, x.key(u)) for u in (from_unit, to_unit))
    known = lambda: x.either(x.missing(source), x.missing(target))
    return x.answer(lambda: _converted(x, value, from_unit, to_unit, value * source / target), (known, ARGUMENT, "unknown length unit"), (lambda: value < 0, ARGUMENT, "negative length"))


@rule
def compare_numbers(x, a, b):
    a, b = x.number(a), x.number(b)
    odd = (lambda: x.either(x.unusual(a), x.unusual(b)), ARGUMENT, "numbers must be finite")
    return x.answer(lambda: {"a": a, "b": b, "larger": x.choose(a == b, "equal", x.choose(a > b, "a", "b")), "difference": x.round(x.magnitude(a - b), 4)}, odd)


@rule
def average_numbers(x, a, b):
    a, b = x.number(a), x.number(b)
    odd = (lambda: x.either(x.unusual(a), x.unusual(b)), ARGUMENT, "numbers must be finite")
    return x.answer(lambda: {"a": a, "b": b, "average": x.round((a + b) / 2, 4)}, odd)


@rule
def calculate_distance(x, origin, destination):
    least, values = T.DISTANCE_KM
    ends = [x.key(origin), x.key(destination)]
    km = lambda: x.md5_mod(x.joined("|", *ends), values) + least
    return x.answer(lambda: {"origin": origin, "destination": destination, "distance_km": km()}, (lambda: x.either(ends[0] == "", ends[1] == ""), ARGUMENT, "places must not be empty"))


def _per_usd(x, currency):
    least, values, unit = T.FALLBACK_RATE
    name = x.first(x.lookup(T.CURRENCY_NAMES, x.key(currency)), lambda: x.key(currency))
    return x.first(x.lookup(T.PER_USD, name), lambda: x.md5_mod(name, values) / unit + least)


@rule
def convert_currency(x, amount, from_currency, to_currency):
    amount = x.number(amount)
    out = lambda: x.round(amount * (_per_usd(x, to_currency) / _per_usd(x, from_currency)), 2)
    empty = lambda: x.either(x.key(from_currency) == "", x.key(to_currency) == "")
    result = lambda: {"amount": amount, "from_currency": from_currency, "to_currency": to_currency, "converted_amount": out()}
    return x.answer(result, (lambda: amount < 0, ARGUMENT, "negative amount"), (empty, ARGUMENT, "currencies must not be empty"))


@rule
def get_stock_price(x, symbol):
    least, values, unit = T.FALLBACK_PRICE
    key = x.key(symbol)
    price = lambda: x.first(x.lookup(T.STOCK_PRICES, key), lambda: x.round(x.md5_mod(key, values) / unit + least, 2))
    return x.answer(lambda: {"symbol": symbol, "price": price()}, (lambda: x.matches(key, r"^$|[^\p{L}]"), ARGUMENT, "not a ticker"))


@rule
def calculate_discount(x, original_price, discount_percentage):
    price, percent = x.number(original_price), x.number(discount_percentage)
    result = lambda: {"original_price": price, "discount_percentage": percent, "discounted_price": x.round(price * (1 - percent / 100), 2)}
    return x.answer(result, (lambda: price < 0, ARGUMENT, "negative price"), (lambda: x.either(percent < 0, percent > 100), ARGUMENT, "percentage outside 0 to 100"))


@rule
def calculate_bmi(x, height, weight):
    height, weight = x.number(height), x.number(weight)
    result = lambda: {"height": height, "weight": weight, "bmi": x.round(x.ratio(weight, height * height), 1)}
    return x.answer(result, (lambda: x.either(height <= 0, weight <= 0), ARGUMENT, "height and weight must be positive"))


@rule
def calculate_tip(x, bill_amount, tip_percentage):
    bill, percent = x.number(bill_amount), x.number(tip_percentage)
    tip = x.round(bill * percent / 100, 2)
    result = lambda: {"bill_amount": bill, "tip_percentage": percent, "tip_amount": tip, "total_amount": x.round(bill + tip, 2)}
    return x.answer(result, (lambda: x.either(bill < 0, percent < 0), ARGUMENT, "negative bill or percentage"))


@rule
def calculate_age(x, birthdate):
    born = x.date(x.stripped(birthdate))
    today = T.TODAY.month * 100 + T.TODAY.day
    result = lambda: {"birthdate": birthdate, "age_years": T.TODAY.year - x.year(born) - x.whole(x.day_of(born) > today)}
    return x.answer(result, (lambda: x.missing(born), ARGUMENT, "not a date"), (lambda: born > T.TODAY, ARGUMENT, "after the reference date"))


def _draw(low, high) -> dict:
    """A number fixed by the two ends: the MD5 of both as text, as a share of the range."""
    if not low < high:
        raise ValueError("min must be below max")
    share = Plain().md5_mod(f"{low}|{high}", T.RANDOM_STEPS) / T.RANDOM_STEPS
    if type(low) is int and type(high) is int:
        drawn = math.trunc(share * (high - low + 1) + low)
        return {"min": low, "max": high, "value": drawn if drawn <= high else low}
    return {"min": low, "max": high, "value": low + (high - low) * share}


@rule
def generate_random_number(x, low, high):
    """Whole numbers if both ends are integers; Python, as its text of a number is hashed."""
    return x.by_python(_draw, low, high)


def call_plain(name: str, arguments: dict) -> dict:
    """The result, or a ToolFailure; whatever else goes wrong in a tool is an argument error."""
    try:
        given = [arguments[n] for n in SIGNATURES[name]]
        if len(given) != len(arguments):
            raise ToolFailure(ARGUMENT, "arguments do not fit")
        return RULES[name](Plain(), *given)
    except ToolFailure:
        raise
    except Exception as e:
        raise ToolFailure(ARGUMENT, f"{type(e).__name__}: {e}") from None


SIGNATURES: dict[str, tuple[str, ...]] = {**T.EXTENDED_TOOLS, **T.CORPUS_TOOLS}


class Registry:
    """Ordered tools by unique name: argument names and a function of columns."""

    def __init__(self):
        self.tools: dict[str, tuple[tuple[str, ...], str, Callable[..., Column]]] = {}

    def register(self, name: str, arguments: tuple[str, ...], tool: Callable[..., Column], description: str = "") -> None:
        if name in self.tools:
            raise ValueError(f"{name} is registered already")
        self.tools[name] = (tuple(arguments), description, tool)

    def has(self, name: str) -> bool:
        return name in self.tools

    def names(self) -> list[str]:
        return list(self.tools)

    def get(self, name: str) -> Callable[..., Column]:
        if name not in self.tools:
            raise KeyError(f"UnknownToolError: {name}")
        return self.tools[name][2]

    def dimension(self, spark: SparkSession) -> DataFrame:
        """ord, tool, canonical_args (sorted), description: the dimension that joins use."""
        rows = [(i, n, sorted(a), d) for i, (n, (a, d, _)) in enumerate(self.tools.items())]
        return spark.createDataFrame(rows, "ord int, tool string, canonical_args array<string>, description string")

    def call(self, tool: Column, arguments: Column) -> Column:
        """Outcome of the named tool on a JSON object of arguments.

        An unknown name, or a set of keys other than the tool's, is an error value.
        """
        keys = F.array_sort(F.json_object_keys(arguments))
        value = lambda k: F.get_json_object(arguments, f"$.{k}")
        out = outcome(F.struct(F.lit(1)), (F.lit(True), "UnknownToolError", F.concat(F.lit("no tool "), F.coalesce(tool, F.lit("null")))))
        for name, (names, _, run) in reversed(self.tools.items()):
            fits = F.coalesce(keys == F.array(*(F.lit(n) for n in sorted(names))), F.lit(False))
            wrong = outcome(F.struct(F.lit(1)), (F.lit(True), "ToolArgumentError", F.lit("arguments do not fit")))
            out = F.when(tool == name, F.when(fits, run(*(_argument(name, n, value(n)) for n in names))).otherwise(wrong)).otherwise(out)
        return out


_NUMBERS = {"value", "a", "b", "amount", "original_price", "discount_percentage", "height", "weight", "bill_amount", "tip_percentage", "min", "max", "decimals"}


def _argument(tool: str, name: str, text: Column) -> Column:
    return text.try_cast("double") if name in _NUMBERS else text


DESCRIPTIONS = {
    "get_weather": "Temperature in Fahrenheit and sky of a city.",
    "calculator": "Value of an arithmetic expression.",
    "search_knowledge_base": "Entries of the knowledge base that hold a text.",
    "get_current_time": "Time in a time zone.",
    "convert_temperature": "A temperature in another unit: Fahrenheit, Celsius or Kelvin.",
    "compare_numbers": "The larger of two numbers and how far they are apart.",
    "get_population": "Population of a country in millions.",
    "get_capital": "Capital of a country.",
    "get_elevation": "Height of a mountain in metres.",
    "convert_length": "A length in another unit: m, km, ft or mi.",
    "average_numbers": "Mean of two numbers.",
    "round_number": "A number rounded to some decimals.",
    "calculate_distance": "Distance of two places in kilometres.",
    "convert_currency": "An amount of money in another currency.",
    "get_stock_price": "Price of a stock by its ticker.",
    "calculate_discount": "Price after a discount in percent.",
    "calculate_bmi": "Body mass index of a height in metres and a weight in kilograms.",
    "calculate_tip": "Tip and total of a bill.",
    "calculate_age": "Age in years of someone born on a date (YYYY-MM-DD).",
    "generate_random_number": "A number between two others.",
}


def schema_of(arguments: tuple[str, ...]) -> dict:
    """The JSON schema of a tool's arguments."""
    return {"type": "object", "properties": {n: {"type": "number" if n in _NUMBERS else "string"} for n in arguments}, "required": list(arguments)}


def _registry(names: dict[str, tuple[str, ...]]) -> Registry:
    out = Registry()
    for n, arguments in names.items():
        out.register(n, arguments, partial(RULES[n], Columns()), DESCRIPTIONS[n])
    return out


def demo_registry() -> Registry:
    return _registry(T.DEMO_TOOLS)


def extended_registry() -> Registry:
    return _registry(T.EXTENDED_TOOLS)


def corpus_registry() -> Registry:
    return _registry(T.CORPUS_TOOLS)
