"""Tool calls in free text.

Braces are counted, also inside strings, which defines what is a parse error.  That
is a prefix sum, so a whole batch of texts is scanned at once: tags, the brace after
each, and the brace that closes it (the next place where the running depth is one
less) come from array operations, and Python sees only the blocks themselves.

``find_calls`` gives the calls of a text as a column, ``ParseCalls`` is the same as a
table function with a row for each call.  ``calls_in`` is the rule for one text.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let, strip

TAG = "<functioncall>"
ROLES = ("USER:", "ASSISTANT:", "FUNCTION RESPONSE:")
CALL = pa.struct([("name", pa.string()), ("arguments", pa.string()), ("arg_keys", pa.list_(pa.string())), ("style", pa.string()), ("char_offset", pa.int32())])
CALLS = "struct<calls: array<struct<name: string, arguments: string, arg_keys: array<string>, style: string, char_offset: int>>, error: string>"

_QUOTED = {q: re.compile(rf"{q}((?:\\.|[^{q}\\])*){q}", re.S) for q in "'\""}


class CallError(ValueError):
    """A call block that does not parse."""


def block_end(text: str, start: int) -> int:
    """One past the brace that matches the one at ``start``; braces in strings count."""
    depth = 0
    for m in re.compile("[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    raise CallError("unbalanced braces")


_NAME = re.compile(r'"name"[^:]*:[^"]*"((?:\\.|[^"\\])*)"', re.S)
_ARGUMENTS = re.compile(r'"arguments"[^:]*:\s*')
_OPENS = re.compile(r"\s*(?=\{)")


def parse_block(block: str) -> tuple[str, dict, str]:
    """(name, arguments, style) of a call block."""
    name = _NAME.search(block)
    if not name:
        raise CallError("no name")
    label = _ARGUMENTS.search(block)
    if not label:
        return name[1], {}, "missing"
    at = label.end()
    quote = block[at : at + 1]
    if quote and quote in _QUOTED:
        inner = _QUOTED[quote].match(block, at)
        if not inner:
            raise CallError("unterminated string")
        style = "string_single_quoted" if quote == "'" else "string_double_quoted"
        value = _value(inner[1])
    elif quote == "{":
        style = "raw_object"
        try:
            value = json.loads(block[at : block_end(block, at)])
        except ValueError as e:
            raise CallError(str(e)) from None
    else:
        raise CallError("arguments are neither text nor object")
    if not isinstance(value, dict):
        raise CallError("arguments are no object")
    return name[1], value, style


def _value(text: str):
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError):
            continue
    raise CallError("arguments do not parse")


def _blocks(chat: str) -> Iterator[tuple[int, str]]:
    """(place of the tag, block) of every call; a tag inside a block is part of its text."""
    after = 0
    for tag in re.finditer(re.escape(TAG), chat):
        if tag.start() < after:
            continue
        opens = _OPENS.match(chat, tag.end())
        if not opens:
            raise CallError("no block after the tag")
        after = block_end(chat, opens.end())
        yield tag.start(), chat[opens.end() : after]


def _call(block: str, place: int) -> dict:
    name, arguments, style = parse_block(block)
    return {"name": name, "arguments": json.dumps(arguments, sort_keys=True), "arg_keys": sorted(map(str, arguments)), "style": style, "char_offset": place}


def calls_in(chat: str | None) -> dict:
    """All calls of a text in order, or the error of the first block that does not parse."""
    found = []
    try:
        for place, block in _blocks(chat or ""):
            found.append(_call(block, place))
    except (CallError, RecursionError) as e:
        return {"calls": None, "error": str(e) or "error"}
    return {"calls": found, "error": None}


_TAG = TAG.encode()
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"]] = True


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a batch of texts, a null as an empty one."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _tags(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every tag that lies in one text."""
    found, at = [], data.find(_TAG)
    while at >= 0:
        found.append(at)
        at = data.find(_TAG, at + 1)
    place = np.array(found, np.int64)
    text = np.searchsorted(offsets, place, "right") - 1
    whole = place + len(_TAG) <= offsets[text + 1]
    return place[whole], text[whole]


def block_ends(data: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """One past the brace that closes each opening one, -1 where none does.

    The running depth changes by one at a brace, so the closing brace is the next
    one that leaves the depth before the opening one.
    """
    braces = np.flatnonzero((data == 0x7B) | (data == 0x7D))
    if not len(braces) or not len(opens):
        return np.full(len(opens), -1)
    depth = np.cumsum(np.where(data[braces] == 0x7B, 1, -1))
    depth -= depth.min() - 2
    n = len(braces)
    key = np.sort(depth * n + np.arange(n))  # places of each depth, in order
    own = np.searchsorted(braces, opens)
    wanted = depth[own] - 1
    k = np.searchsorted(key, wanted * n + own)
    there = k < n
    there[there] = key[k[there]] // n == wanted[there]
    out = np.full(len(opens), -1)
    out[there] = braces[key[k[there]] % n] + 1
    return out


def scan(texts: pa.Array) -> tuple[list[list[dict] | None], list[str | None]]:
    """(calls, error) of every text of a batch, as ``calls_in`` gives them."""
    data, offsets = _bytes_of(texts)
    raw = data.tobytes()
    place, text = _tags(raw, offsets)
    calls: list[list[dict] | None] = [[] for _ in range(len(offsets) - 1)]
    errors: list[str | None] = [None] * len(calls)
    if not len(place):
        return calls, errors
    solid = np.append(np.flatnonzero(~_SPACE[data]), len(data))
    opens = solid[np.searchsorted(solid, place + len(_TAG))]
    inside = opens < offsets[text + 1]
    first = data[np.minimum(opens, len(data) - 1)]
    odd = set(text[inside & (first >= 0x80)].tolist())  # white space beyond ASCII may follow a tag
    good = inside & (first == 0x7B)
    ends = np.full(len(place), -1)
    ends[good] = block_ends(data, opens[good])
    ends[ends > offsets[text + 1]] = -1
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters up to a byte
    char = before[place] - before[offsets[text]]
    after, now = 0, -1
    for i, at, ok, a, b, c in zip(text.tolist(), place.tolist(), good.tolist(), opens.tolist(), ends.tolist(), char.tolist()):
        if i in odd or errors[i] is not None:
            continue
        after = after if i == now else 0
        now = i
        if at < after:  # a tag inside a block is part of its text
            continue
        try:
            if not ok:
                raise CallError("no block after the tag")
            if b < 0:
                raise CallError("unbalanced braces")
            calls[i].append(_call(raw[a:b].decode(), c))
            after = b
        except (CallError, RecursionError) as e:
            calls[i], errors[i] = None, str(e) or "error"
    for i in odd:
        own = calls_in(raw[offsets[i] : offsets[i + 1]].decode())
        calls[i], errors[i] = own["calls"], own["error"]
    return calls, errors


def find_calls(chat: Column) -> Column:
    """STRUCT<calls, error> of every text."""

    @F.arrow_udf(CALLS)
    def parse(texts: pa.Array) -> pa.Array:
        calls, errors = scan(texts)
        return pa.StructArray.from_arrays([pa.array(calls, pa.list_(CALL)), pa.array(errors, pa.string())], names=["calls", "error"])

    return parse(chat)


@F.arrow_udtf(returnType="source_index long, nth int, name string, arguments string, arg_keys array<string>, style string, char_offset int, error string")
class ParseCalls:
    """A table function over (source_index, chat): a row for each call in order, or one with the error of a text that does not parse."""

    def eval(self, chats: pa.RecordBatch) -> Iterator[pa.Table]:
        calls, errors = scan(chats.column(1))
        flat = [{**c, "k": k, "nth": n} for k, own in enumerate(calls) for n, c in enumerate(own or ())]
        flat += [{"k": k, "error": e} for k, e in enumerate(errors) if e is not None]
        column = lambda name, kind: pa.array([c.get(name) for c in flat], kind)
        names = {"nth": pa.int32(), "name": pa.string(), "arguments": pa.string(), "arg_keys": pa.list_(pa.string()), "style": pa.string(), "char_offset": pa.int32(), "error": pa.string()}
        yield pa.table({"source_index": chats.column(0).take(column("k", pa.int64())), **{n: column(n, t) for n, t in names.items()}})


def last_user_before(chat: Column, offset: Column) -> Column:
    """The last user message before a character offset, stripped; null without one."""
    before = F.substring(chat, F.lit(1), offset)
    ends = "|".join(r.replace(" ", r"\s") for r in ROLES)
    return F.when(before.contains("USER:"), strip(F.regexp_extract(before, rf"(?s).*USER:(.*?)(?:{ends}|$)", 1)))


def answer(text: Column) -> Column:
    """STRUCT<kind, name, arguments, text, error, value> of a model's answer; arguments and value are VARIANTs.

    kind is ``call``, ``final`` (no call block) or ``malformed``.  The block is found
    and parsed once.
    """

    def read(s: Column) -> Column:
        value, called = s["value"], s["block"] != ""
        kind_of = lambda v: F.schema_of_variant(v)

        def judged(p: Column) -> Column:
            problem = (
                F.when(value.isNull(), "invalid JSON")
                .when(~kind_of(value).startswith("OBJECT"), "not an object")
                .when(p["name"].isNull() | (kind_of(p["name"]) != "STRING"), "no name")
                .when(p["arguments"].isNotNull() & ~kind_of(p["arguments"]).startswith("OBJECT"), "arguments are no object")
            )
            error = F.when(called, problem)
            good = lambda e: called & e.isNull()
            return let(error, lambda e: F.struct(
                F.when(~called, "final").when(e.isNotNull(), "malformed").otherwise("call").alias("kind"),
                F.when(good(e), F.try_variant_get(p["name"], "$", "string")).alias("name"),
                F.when(good(e), p["arguments"]).alias("arguments"),
                F.when(~called, strip(s["text"])).alias("text"),
                e.alias("error"),
                F.when(good(e), value).alias("value"),
            ))

        parts = F.struct(*(F.try_variant_get(value, f"$.{c}", "variant").alias(c) for c in ("name", "arguments")))
        return let(parts, judged)

    block = F.regexp_extract(text, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    return let(block, lambda b: let(F.struct(text.alias("text"), b.alias("block"), F.try_parse_json(b).alias("value")), read))


def parse_output(text: Column) -> Column:
    """STRUCT<kind, name, arguments, text, error> of a model's answer, arguments as JSON."""
    arguments = lambda s: F.when(s["kind"] == "call", F.coalesce(F.to_json(s["arguments"]), F.lit("{}")))
    return let(answer(text), lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"), arguments(s).alias("arguments"), s["text"].alias("text"), s["error"].alias("error")))
