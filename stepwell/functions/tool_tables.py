"""Lookup tables and constants of the simulated tools (fixed values)."""

from __future__ import annotations

from datetime import date

# Results of the tools depend on them.
WEATHER = {
    "paris": (59, "cloudy"),
    "san francisco": (62, "foggy"),
    "tokyo": (71, "clear"),
    "cairo": (95, "sunny"),
    "london": (55, "rainy"),
    "berlin": (52, "overcast"),
    "sydney": (68, "sunny"),
    "mumbai": (88, "humid"),
    "toronto": (48, "windy"),
    "dubai": (102, "clear"),
}
KNOWLEDGE = {
    "unsloth": "Unsloth is a library for fast, memory-efficient LLM fine-tuning.",
    "distillation": "Knowledge distillation trains a smaller student model to match a larger teacher's outputs.",
    "lora": "LoRA fine-tunes a frozen base model via small low-rank adapter matrices.",
    "quantization": "Quantization reduces model weight precision (e.g. 4-bit) to shrink memory footprint with minimal accuracy loss.",
    "perplexity": "Perplexity measures how well a language model predicts a sample of text; lower is better.",
    "tokenizer": "A tokenizer converts raw text into the subword tokens a language model actually operates on.",
    "fine-tuning": "Fine-tuning further trains a pretrained model on task-specific data to specialize its behavior.",
}
TIMES = {
    "utc": "2026-09-08T12:00:00Z",
    "est": "2026-09-08T08:00:00-04:00",
    "jst": "2026-09-08T21:00:00+09:00",
    "pst": "2026-09-08T04:00:00-08:00",
    "cet": "2026-09-08T13:00:00+01:00",
    "ist": "2026-09-08T17:30:00+05:30",
    "aest": "2026-09-08T22:00:00+10:00",
    "gmt": "2026-09-08T12:00:00+00:00",
}
TEMPERATURE_UNITS = {"f": "f", "fahrenheit": "f", "c": "c", "celsius": "c", "k": "k", "kelvin": "k"}
ABSOLUTE_ZERO_C = -273.15
POPULATION_MILLIONS = {"china": 1412, "india": 1408, "united states": 333, "indonesia": 276, "brazil": 214, "japan": 125, "egypt": 109, "germany": 84, "france": 68, "united kingdom": 67}
CAPITALS = {"france": "paris", "japan": "tokyo", "egypt": "cairo", "germany": "berlin", "united kingdom": "london", "india": "new delhi", "brazil": "brasilia", "china": "beijing", "united states": "washington", "indonesia": "jakarta"}
ELEVATIONS_M = {"everest": 8849, "aconcagua": 6961, "denali": 6190, "kilimanjaro": 5895, "elbrus": 5642, "mont blanc": 4808, "matterhorn": 4478, "fuji": 3776}
METRES = {"m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "km": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344}
PER_USD = {"usd": 1.0, "eur": 0.92, "gbp": 0.79, "jpy": 147.0, "cad": 1.36, "aud": 1.52, "cny": 7.2, "inr": 83.0}
CURRENCY_NAMES = {
    "dollar": "usd", "dollars": "usd", "us dollar": "usd", "us dollars": "usd",
    "euro": "eur", "euros": "eur",
    "pound": "gbp", "pounds": "gbp", "british pound": "gbp", "british pounds": "gbp", "sterling": "gbp",
    "yen": "jpy", "japanese yen": "jpy",
    "canadian dollar": "cad", "canadian dollars": "cad",
    "australian dollar": "aud", "australian dollars": "aud",
    "yuan": "cny", "chinese yuan": "cny", "renminbi": "cny",
    "rupee": "inr", "rupees": "inr", "indian rupees": "inr",
}
STOCK_PRICES = {"aapl": 189.50, "msft": 415.20, "googl": 171.30, "amzn": 178.90, "tsla": 242.70, "nvda": 118.10, "meta": 502.30}
TODAY = date(2026, 9, 8)
DISTANCE_KM = (50, 4951)  # least, number of values
FALLBACK_RATE = (0.5, 150, 100)  # least, number of values, values per unit
FALLBACK_PRICE = (10, 49_000, 100)
RANDOM_STEPS = 10_000_000

# Argument names of each tool, in the order of its signature.
DEMO_TOOLS = {
    "get_weather": ("city",),
    "calculator": ("expression",),
    "search_knowledge_base": ("query",),
    "get_current_time": ("timezone",),
    "convert_temperature": ("value", "from_unit", "to_unit"),
    "compare_numbers": ("a", "b"),
}
EXTENDED_TOOLS = {
    **DEMO_TOOLS,
    "get_population": ("country",),
    "get_capital": ("country",),
    "get_elevation": ("place",),
    "convert_length": ("value", "from_unit", "to_unit"),
    "average_numbers": ("a", "b"),
    "round_number": ("value", "decimals"),
}
CORPUS_TOOLS = {
    "calculate_distance": ("origin", "destination"),
    "convert_currency": ("amount", "from_currency", "to_currency"),
    "get_stock_price": ("symbol",),
    "calculate_discount": ("original_price", "discount_percentage"),
    "calculate_bmi": ("height", "weight"),
    "calculate_tip": ("bill_amount", "tip_percentage"),
    "calculate_age": ("birthdate",),
    "generate_random_number": ("min", "max"),
}

# Error classes by category.
TOOL_ERRORS = ("ToolExecutionError", "ToolArgumentError", "ToolTimeoutError")
PROTOCOL_ERRORS = ("ProtocolError", "MalformedCallError", "UnknownToolError", "WrongToolError")
