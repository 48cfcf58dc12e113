"""Chat formatting with a grammar round trip, in SQL functions only.

A conversation is rendered as::

    conversation = mode turn*
    mode         = "<s>" | "<s esc>"
    turn         = "[INST]" role "\\n" text "[/INST]"      (any role but assistant)
                 | text "</s>"                             (assistant)

and neither role nor text may hold a control string.  It is first rendered as
it is (``<s>``) and parsed again; if the parser does not give back the source
turns, its content is escaped (``&``, ``<``, ``[`` and, in roles, line ends) and
it is rendered in the mode ``<s esc>``, which holds no control string and so
always parses back.  Both steps are checked: a conversation that even its escaped
form does not give back fails the query.

The loss mask is a list of runs (length, whether the run is learned) over the
rendered text; only the texts of assistant turns are learned.

Defined cases: null role or text is empty; turns are ordered by (turn, role,
text), a null turn first, and repeated rows are turns of their own; a row without
a conversation id is a conversation of one turn, so such rows gather nowhere; a
very long text is rendered whole; an empty table has no conversation; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"</?s>|<s esc>|\[/?INST\]"
LEARNED_ROLE = "assistant"


def _is_learned(turn: Column) -> Column:
    return turn["role"] == LEARNED_ROLE


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;")):
        if plain != "\n":
            text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    for safe, plain in (("&#10;", "\n"), ("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def render_turn(role: Column, text: Column) -> Column:
    return F.when(role == LEARNED_ROLE, F.concat(text, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), role, F.lit("\n"), text, F.lit("[/INST]")))


def render(turns: Column, escaped: bool) -> Column:
    """The conversation of an array of (role, text) in one mode."""
    role = (lambda t: F.when(_is_learned(t), t["role"]).otherwise(_escape_role(t["role"]))) if escaped else (lambda t: t["role"])
    text = (lambda t: escape(t["text"])) if escaped else (lambda t: t["text"])
    body = F.array_join(F.transform(turns, lambda t: render_turn(role(t), text(t))), "")
    return F.concat(F.lit("<s esc>" if escaped else "<s>"), body)


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, or null where the grammar does not hold."""
    escaped = formatted.startswith("<s esc>")
    body = F.when(escaped, F.substring(formatted, F.lit(8), F.length(formatted))).otherwise(F.substring(formatted, F.lit(4), F.length(formatted)))
    pieces = F.filter(F.split(body, r"(?<=\[/INST\])|(?<=</s>)"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        learned = piece.endswith("</s>")
        inner = F.when(learned, F.substring(piece, F.lit(1), F.length(piece) - 4)).otherwise(F.substring(piece, F.lit(7), F.length(piece) - 13))
        role = F.when(learned, F.lit(LEARNED_ROLE)).otherwise(F.substring_index(inner, "\n", 1))
        text = F.when(learned, inner).otherwise(F.substring(inner, F.length(role) + 2, F.length(inner)))
        proper = F.when(learned, ~inner.rlike(CONTROL)).otherwise(piece.startswith("[INST]") & piece.endswith("[/INST]") & inner.contains("\n") & ~inner.rlike(CONTROL))
        plain = lambda x: F.when(escaped, unescape(x)).otherwise(x)
        return F.struct(plain(role).alias("role"), plain(text).alias("text"), proper.alias("proper"))

    turns = F.transform(pieces, turn)
    return F.when(F.forall(turns, lambda t: t["proper"]), F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def mask_runs(turns: Column, escaped: Column) -> Column:
    """(length, learned) runs that cover the rendered conversation in order."""
    run = lambda n, on: F.struct(n.cast("long").alias("length"), F.lit(on).alias("learned"))
    size = lambda x: F.length(F.when(escaped, escape(x)).otherwise(x))
    role = lambda x: F.length(F.when(escaped, _escape_role(x)).otherwise(x))
    of = lambda t: F.when(_is_learned(t), F.array(run(size(t["text"]), True), run(F.lit(4), False))).otherwise(F.array(run(size(t["text"]) + role(t["role"]) + 14, False)))
    return F.concat(F.array(run(F.when(escaped, 7).otherwise(3), False)), F.flatten(F.transform(turns, of)))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (the source), formatted, escaped, mask_runs and parsed (read back from formatted)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    whole = whole.unionByName(conversations.where("conv_id is null").select("conv_id", F.array(turn).alias("rows")))
    source = whole.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("plain", render(F.col("turns"), False)).withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    formatted = plain.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain")))
    read = formatted.select("conv_id", "turns", "formatted", "escaped", mask_runs(F.col("turns"), F.col("escaped")).alias("mask_runs"), parse(F.col("formatted")).alias("parsed"))
    return read.withColumn("parsed", identical(F.col("parsed"), F.col("turns"), F.col("conv_id")))


def identical(parsed: Column, turns: Column, conv_id: Column) -> Column:
    """The parsed turns; the query fails where they are not the source's."""
    lost = F.raise_error(F.concat(F.lit("conversation not read back: "), F.coalesce(conv_id.cast("string"), F.lit("null"))))
    return F.when(F.coalesce(parsed == turns, F.lit(False)), parsed).otherwise(lost.cast("array<struct<role: string, text: string>>"))


def learned_text(formatted: Column, runs: Column, escaped: Column) -> Column:
    """What lies under the mask in the rendered conversation, unescaped, run after run."""

    def cut(acc: Column, run: Column) -> Column:
        piece = F.substring(formatted, acc["at"], run["length"].cast("int"))
        return F.struct((acc["at"] + run["length"].cast("int")).alias("at"), F.when(run["learned"], F.array_append(acc["said"], piece)).otherwise(acc["said"]).alias("said"))

    pieces = F.aggregate(runs, F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("said")), cut, lambda acc: acc["said"])
    return F.array_join(F.when(escaped, F.transform(pieces, unescape)).otherwise(pieces), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the rendered conversations hold, as read back by the parser and under the mask."""
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.withColumn("learned", learned_text(F.col("formatted"), F.col("mask_runs"), F.col("escaped")))
    return read.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
