"""The registered queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, exact_dups, lm_score, merkle, near_dups, packing, quality_model, quality_rules, token_counts, toxicity, warc

#: Longer documents are over the limit of a context.
TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which every machine has in the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules.apply_rules(spark, _table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op2_sql() -> str:
    """Counts by lists and windows, quantiles of the buckets' least values, fences by group."""
    space = "[ \\t\\n\\x0b\\f\\r]"
    stacked = " union all ".join(f"select doc_id, lang, source, '{r}' as rate, {a} * 10000 // greatest({b}, 1) as v, {prior} as prior, {str(low).lower()} as low from counts where n_words > 0" for r, (a, b, prior, low) in quality_rules.RATES.items())
    ordered = lambda w: f"list_sort(list(bucket) over (partition by {w}))"
    groups = {"o": "lang, source, rate", "g": "lang, rate", "e": "rate"}
    lists = ", ".join(f"{ordered(w)} as {k}_v, count(*) over (partition by {w}) as {k}_n" for k, w in groups.items())
    quarters = ", ".join(f"{k}_v[ceil({k}_n * {q} / 4.0)::int] as {k}_{q}" for k in groups for q in (1, 3))
    absurd = lambda k: f"{k}_3 + {quality_rules.FENCE} * greatest({k}_3 - {k}_1, prior)"
    tails = ", ".join(f"{k}_v[ceil(len(list_filter({k}_v, lambda x: x <= {absurd(k)})) * {quality_rules.TAIL_PERCENT} / 100.0)::int] as {k}_t" for k in groups)
    pick = lambda q: f"case when o_n >= {quality_rules.MIN_GROUP} then o_{q} when g_n >= {quality_rules.MIN_GROUP} then g_{q} else e_{q} end"
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
ws as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') as w from d)),
tri as (select doc_id, pos, word, lead(word, 1) over p as b, lead(word, 2) over p as c from ws window p as (partition by doc_id order by pos)),
often as (select doc_id, pos from tri where c is not null qualify count(*) over (partition by doc_id, word, b, c) > 1),
repeats as (select doc_id, count(distinct pos + k) as n_repeat_words from often, range(3) r(k) group by 1),
nw as (select doc_id, count(*) as n_words from ws group by 1),
ls as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where line <> '' and regexp_replace(line, '{space}', '', 'g') <> '' group by 1),
counts as (
    select d.*, coalesce(n_words, 0) as n_words, length(regexp_replace(t, '{space}', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as n_bangs
    from d left join nw using (doc_id) left join ls using (doc_id) left join repeats using (doc_id)
), rates as ({stacked}),
buckets as (select *, case when v < 128 then v else (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) end as bucket from rates),
listed as (select *, {lists} from buckets), quarters as (select *, {quarters} from listed), tails as (select *, {tails} from quarters),
fenced as (select *, greatest({quality_rules.FENCE} * ({pick(3)} - {pick(1)}), {quality_rules.TAIL} * ({pick("t")} - {pick(3)}), prior * {quality_rules.FENCE} // {quality_rules.FLOOR}) as reach from tails),
inside as (
    select doc_id, bool_and(v <= {pick(3)} + reach and (not low or v >= {pick(1)} - reach)) as ok from fenced group by 1
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(ok, false) as kept
from counts left join inside using (doc_id)
"""


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicate_groups(spark, _table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Both say what ends a turn of the template.
CLASHING_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in CLASHING_TURNS)
    clash = spark.sql(f"select * from values {rows} as t(conv_id, turn, role, text)")
    return chat_format.digests(chat_format.format_conversations(said.unionByName(clash)))


OP5_SQL = """
with said as (
    select conv_id, case when conv_id is null then row_number() over () end as alone, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations
    union all select -1, null, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, null, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
    select *, regexp_matches(body, '</?s>|<s esc>|\\[/?INST\\]') or (role <> 'assistant' and (contains(role, chr(10)) or regexp_matches(role, '</?s>|<s esc>|\\[/?INST\\]'))) as clash,
        length(body) as plain_n, length(body) + 4 * (length(body) - length(replace(body, '&', ''))) + 3 * (length(body) - length(replace(body, '<', ''))) + 4 * (length(body) - length(replace(body, '[', ''))) as safe_n,
        case when role = 'assistant' then 4 else 14 + length(role) end as plain_marks,
        case when role = 'assistant' then 4 else 14 + length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', ''))) + 4 * (length(role) - length(replace(role, '[', ''))) + 4 * (length(role) - length(replace(role, chr(10), ''))) end as safe_marks
    from said
)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
    coalesce(sum(case when role = 'assistant' then plain_n end), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(body, '' order by turn nulls first, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
    (case when bool_or(clash) then 7 + sum(safe_n + safe_marks) else 3 + sum(plain_n + plain_marks) end)::bigint as formatted_chars
from marked group by conv_id, alone
"""


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(spark, _table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    records = warc.read_archives(warc.write_archives(spark, pages), payload=False)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP7_SQL = """
with p as (
    select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages
), f as (
    select *, min(page_id) over (partition by digest) as first_id from p
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
    case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
    case when n >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(merkle.manifest(spark, _table(spark, sf_dir, "documents")))


def _op11_sql() -> str:
    """Levels by recursion over whole runs; the paths of leaves, then of sources, joined and folded one level at a time."""
    fields = {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": "n_chars"}
    of = lambda x: f"coalesce(octet_length(encode({x}::varchar))::varchar || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(of(x) for x in (*fields.values(), text)) + ")"
    lower = f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"
    up = """select g, level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' order by idx)) from {t} where n > 1 group by g, level, idx // 16"""
    siblings = """select m.key, m.level, coalesce(string_agg(o.digest, '' order by o.idx) filter (where o.idx < m.at), '') as before, coalesce(string_agg(o.digest, '' order by o.idx) filter (where o.idx > m.at), '') as after
        from (select k.key, k.g, x.level, k.idx // (16 ** x.level)::bigint as at from {keys} k join (select distinct g, level, n from {t}) x on x.g = k.g and x.n > 1) m join {t} o on o.g = m.g and o.level = m.level and o.idx // 16 = m.at // 16 group by m.key, m.level, m.at"""
    return f"""
with recursive rows as (
    select row_number() over () as key, doc_id, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as n,
        {leaf("text")} as leaf, case when {crc} % 5 = 0 then {leaf(lower)} else {leaf("text")} end as changed from documents
), nodes(g, level, idx, n, digest) as (select g, 0, idx, n, leaf from rows union all {up.format(t="nodes")}),
tops as (select g as idx, g as key, 0 as g, count(*) over () as n, digest from nodes where n = 1),
sources(g, level, idx, n, digest) as (select g, 0, idx, n, digest from tops union all {up.format(t="sources")}),
root as (select digest as root from sources where n = 1),
low as ({siblings.format(keys="rows", t="nodes")}), high as ({siblings.format(keys="tops", t="sources")}),
path as (
    select key, row_number() over (partition by key order by phase, level) as step, before, after from (
        select key, 0 as phase, level, before, after from low union all select r.key, 1, h.level, h.before, h.after from rows r join high h on h.key = r.g)
), folds(key, step, digest) as (
    select key, 0, changed from rows union all select f.key, f.step + 1, sha256(p.before || f.digest || p.after) from folds f join path p on p.key = f.key and p.step = f.step + 1
), ends as (select key, arg_max(digest, step) as folded_root from folds group by key),
proofs as (select key, sha256(string_agg(before || after, '' order by step)) as proof_sha256 from path group by key)
select doc_id, leaf, t.digest as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from rows join (select key as top, digest from tops) t on top = rows.g join ends using (key) left join proofs using (key), root
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


OP12_SQL = """
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) as piece from documents
), w as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as words from pieces),
grams as (select lang, words[i:i + k - 1] as words, k from w, range(1, 5) s(k), unnest(range(1, len(words) - k + 2)) t(i)),
f as (select lang, words, k, count(*) as f from grams group by all),
c as (select lang, words, k, f as a from f where k > 1 and f >= 30),
cuts as (select c.lang, c.words, a, t.cut, l.f as l, r.f as r, (2000000::hugeint * a) // (l.f + r.f) as score from c, range(1, 4) t(cut) join f l on l.lang = c.lang and l.words = c.words[1:t.cut] join f r on r.lang = c.lang and r.words = c.words[t.cut + 1:] where t.cut < c.k),
best as (select *, row_number() over (partition by lang, words order by score, cut) as nth from cuts),
parts as (select lang, c.words[i:i + n - 1] as words, max(a) as longest from c, range(2, 4) s(n), unnest(range(1, len(c.words) - n + 2)) t(i) where n < c.k group by all),
kept as (select b.lang, array_to_string(b.words, ' ') as phrase, a, l, r, score from best b left join parts p on p.lang = b.lang and p.words = b.words where nth = 1 and not coalesce(100 * longest >= 80 * a, false)),
ordered as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept),
n as (select lang, sum(f) as n from f where k = 1 group by 1)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ordered join n using (lang) where rank <= 2000
"""


def op13_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dups.duplicate_groups(spark, _table(spark, sf_dir, "documents"))


OP13_SQL = """
with d as (select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]', '', 'g') as body from documents),
g as (select doc_id, body, first_value(doc_id) over (partition by body order by size desc, doc_id) as keep_id, count(*) over (partition by body) as group_size from d)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from g
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dups": op3_near_dups,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_lm_score": op6_lm_score,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality_model": op10_quality_model,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_collocations": op12_collocations,
    "op13_exact_dups": op13_exact_dups,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": _op2_sql(),
    "op5_chat_format": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op11_merkle_manifest": _op11_sql(),
    "op12_collocations": OP12_SQL,
    "op13_exact_dups": OP13_SQL,
}
