import json

import pytest
from pyspark.sql import functions as F

from stepwell.functions import tools
from stepwell.functions.algebra import ToolFailure
from stepwell.functions.tools import call_plain

CALLS = [
    ("get_weather", {"city": " Paris "}), ("get_weather", {"city": "Atlantis"}), ("calculator", {"expression": "7 * 8 - 3"}), ("calculator", {"expression": "1 / 0"}), ("calculator", {"expression": "2 ** 3"}),
    ("calculator", {"expression": "a"}), ("search_knowledge_base", {"query": "LoRA"}), ("search_knowledge_base", {"query": " "}), ("search_knowledge_base", {"query": "zebra"}), ("get_current_time", {"timezone": "JST"}),
    ("convert_temperature", {"value": 98.6, "from_unit": "F", "to_unit": "Celsius"}), ("convert_temperature", {"value": -400, "from_unit": "c", "to_unit": "k"}), ("convert_temperature", {"value": 1, "from_unit": "x", "to_unit": "k"}),
    ("compare_numbers", {"a": 2, "b": 2}), ("compare_numbers", {"a": 7.12345, "b": 2}), ("get_population", {"country": "France"}), ("get_capital", {"country": "nowhere"}), ("get_elevation", {"place": "Fuji"}),
    ("convert_length", {"value": 5, "from_unit": "km", "to_unit": "mi"}), ("convert_length", {"value": -5, "from_unit": "km", "to_unit": "mi"}), ("average_numbers", {"a": 1, "b": 2}), ("round_number", {"value": 2.675, "decimals": 2}),
    ("round_number", {"value": 2.675, "decimals": 11}), ("calculate_distance", {"origin": "Rome", "destination": "Oslo"}), ("calculate_distance", {"origin": "", "destination": "Oslo"}),
    ("convert_currency", {"amount": 10, "from_currency": "US Dollars", "to_currency": "Euros"}), ("convert_currency", {"amount": 10, "from_currency": "Florin", "to_currency": "usd"}), ("convert_currency", {"amount": -1, "from_currency": "usd", "to_currency": "eur"}),
    ("get_stock_price", {"symbol": "AAPL"}), ("get_stock_price", {"symbol": "zzz"}), ("get_stock_price", {"symbol": "a1"}), ("calculate_discount", {"original_price": 80, "discount_percentage": 12.5}), ("calculate_discount", {"original_price": 80, "discount_percentage": 101}),
    ("calculate_bmi", {"height": 1.75, "weight": 70}), ("calculate_bmi", {"height": 0, "weight": 70}), ("calculate_tip", {"bill_amount": 33.35, "tip_percentage": 15}), ("calculate_tip", {"bill_amount": -1, "tip_percentage": 15}),
    ("calculate_age", {"birthdate": "1990-09-08"}), ("calculate_age", {"birthdate": "1990-09-09"}), ("calculate_age", {"birthdate": "2030-01-01"}), ("calculate_age", {"birthdate": "soon"}), ("generate_random_number", {"min": 5, "max": 1}),
]


def test_both_readings_agree(spark):
    both = tools.extended_registry()
    for n, (a, d, f) in tools.corpus_registry().tools.items():
        both.register(n, a, f, d)
    df = spark.createDataFrame([(i, n, json.dumps(a)) for i, (n, a) in enumerate(CALLS)], "i int, tool string, arguments string")
    got = df.select("i", both.call(F.col("tool"), F.col("arguments")).alias("o")).select("i", "o.*").orderBy("i").collect()
    for row, (name, arguments) in zip(got, CALLS):
        try:
            want, kind = call_plain(name, arguments), None
        except ToolFailure as e:
            want, kind = None, e.kind
        assert row["error_type"] == kind, (name, arguments, row)
        if want is not None:
            assert json.loads(row["result"]) == pytest.approx(want) if all(isinstance(v, (int, float)) for v in want.values()) else json.loads(row["result"]) == want, (name, row)


def test_unknown_and_wrong_arguments(spark):
    df = spark.createDataFrame([("nothing", "{}"), ("get_weather", '{"town": "Paris"}')], "tool string, arguments string")
    got = df.select(tools.demo_registry().call(F.col("tool"), F.col("arguments"))["error_type"]).collect()
    assert [r[0] for r in got] == ["UnknownToolError", "ToolArgumentError"]
    with pytest.raises(ValueError):
        r = tools.demo_registry()
        r.register("calculator", ("expression",), tools.calculator)


@pytest.mark.parametrize("expression, value", [("15 * 4", 60), ("100 / 5", 20.0), ("7 // 2", 3), ("2 ** 5", 32), ("-(3 + 4)", -7)])
def test_evaluate(expression, value):
    assert tools.evaluate(expression) == value


@pytest.mark.parametrize("expression", ["", "9 ** 9 ** 9", "(1", "1 +", "__import__"])
def test_evaluate_refuses(expression):
    with pytest.raises((ValueError, SyntaxError)):
        tools.evaluate(expression)
