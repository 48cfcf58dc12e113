"""The llm operators against plain-Python versions on small fixtures."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from stepwell.llm import chat_format, decontaminate, doc_stats, elias_fano, hash_table, lm_score, near_dups, packing, quality_model, quality_rules, token_counts, toxicity, warc
from stepwell.llm.queries import ORACLES, QUERIES, vocabulary
from stepwell.llm import text as text_module
from stepwell.llm.text import blocks, words_of

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "a b c d", "same same same same same same", "é à ñ\n\nline\nline", "日本語 テキスト", "x" * 5000, "\U0001f600 ok </s> <s>", "lone\x00nul", "  lead and trail  "]


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 3 else None, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"score": F.lit("clash"), "n_words": F.lit(None).cast("string"), "group_id": F.lit(0), "k0": F.lit(1), "size": F.lit(1)}) if extra else df


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], SMALL) == ""


def test_words():
    for i, j, data, offsets in blocks(pa.array(ODD), 40):
        w = words_of(data, offsets)
        for k in range(i, j):
            own = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[k - i] : w.first[k - i + 1]], w.end[w.first[k - i] : w.first[k - i + 1]])]
            assert own == WORD.findall(ODD[k] or "")


# 1. Token counts


@pytest.fixture(scope="module")
def transducer():
    return token_counts.Transducer(vocabulary("piece_bpe_32k.model"))


def check_counts(transducer, texts):
    got = np.concatenate([transducer.counts(d, o) for _, _, d, o in blocks(pa.array(texts, pa.string()), 10_000)])
    assert got.tolist() == [len(x) for x in transducer.library.encode([t or "" for t in texts])]


def test_counts_equal_library(transducer, corpus):
    check_counts(transducer, corpus["text"].tolist() + ODD + ["a" * 1000, "ab" * 500, " " * 300, "the" * 300 + " " * 17 + "q", "▁▁ ▁a", "=" * 200 + "\n" + "==" * 90])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abeinorst ▁=.\n1é<>/", max_size=200), min_size=1, max_size=4))
def test_counts_of_any_text(transducer, texts):
    check_counts(transducer, texts)


@pytest.mark.parametrize("chunk, warm", [(3, 1), (2, 0), (7, 4), (64, 48)])
def test_chunk_maps_compose(transducer, monkeypatch, chunk, warm):
    monkeypatch.setattr(token_counts, "WARM_UP", warm)  # wrong entry states, which the scan has to mend
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    transducer.forget_runs()
    check_counts(transducer, ["internationalisation" * 20, "thethethethere" * 9, "aaaaaaa" * 13, "x", "ab", "=" * 500, "".join(chr(97 + i * i % 23) for i in range(900))])


def test_counts_with_small_memory(transducer, monkeypatch, corpus):
    monkeypatch.setattr(token_counts, "KNOWN_RUNS", 50)
    monkeypatch.setattr(token_counts, "KNOWN_STEPS", 100)
    transducer.forget_runs()
    check_counts(transducer, corpus["text"].tolist()[:60] + ODD)


def test_counts_of_one_hash(transducer, monkeypatch):
    transducer.forget_runs()
    plain = text_module.Words.hashes
    monkeypatch.setattr(text_module.Words, "hashes", lambda self, data=None, seed=0: plain(self, data, seed) if seed else np.full(len(self.end), 3, np.uint64))
    check_counts(transducer, ["one two one", "two three", "one three two"])
    transducer.forget_runs()


def test_counts_of_a_text_of_very_many_words(transducer):
    digits = np.arange(3_000_000)
    text = " ".join(np.char.add("w", digits.astype(str)).tolist())
    data = np.frombuffer(text.encode(), np.uint8)
    got = transducer.counts(data, np.array([0, len(data)]))
    assert got[0] == len(transducer.library.encode(text))
    assert len(transducer.check) <= token_counts.KNOWN_RUNS


def test_counts_in_spark(spark, transducer):
    got = token_counts.count_tokens(docs_of(spark, ODD, True), vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(transducer.library.encode(t or "")) for t in ODD]
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in ODD]


# 2. Quality rules


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    often = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_base_counts(corpus):
    texts = corpus["text"].tolist() + ODD
    at = 0
    for i, j, data, offsets in blocks(pa.array(texts)):
        c = doc_stats.doc_counts(data, offsets)
        for k in range(i, j):
            assert {n: int(c[n][k - i]) for n in plain_counts("")} == plain_counts(texts[k])
            at += 1
    assert at == len(texts)


def plain_fences(values, prior):
    values = sorted(values)
    q1, q3 = (values[math.ceil(len(values) * q / 4) - 1] for q in (1, 3))
    sane = [v for v in values if v <= q3 + 4 * max(q3 - q1, prior)]
    tail = sane[math.ceil(len(sane) * 98 / 100) - 1]
    reach = max(4 * (q3 - q1), 6 * (tail - q3), 4 * prior // 2)
    return q1 - reach, q3 + reach


def test_groups_get_fences_of_their_own(spark):
    """Two sources whose texts shout differently: what is usual in one is rejected in the other."""
    rng = np.random.default_rng(5)

    def words(share):
        return " ".join(f"Zork{rng.integers(99999)}" if rng.random() < share else f"word{rng.integers(99999)}" for _ in range(80))

    calm, loud = [words(0.02) for _ in range(250)], [words(float(rng.choice([0.1, 0.3, 0.5]))) for _ in range(250)]
    probe = words(0.9)
    rows = [(k, t, "en", "calm") for k, t in enumerate(calm)] + [(1000 + k, t, "en", "loud") for k, t in enumerate(loud)] + [(5000, probe, "en", "calm"), (5001, probe, "en", "loud")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fences = {r["t_source"]: r["hi_upper"] for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.text_rates(docs))).collect()}
    assert fences["loud"] > 1.5 * fences["calm"]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(spark, docs).collect()}
    assert not kept[5000] and kept[5001]
    assert sum(not k for d, k in kept.items() if d < 5000) <= 2


def test_rules_equal_plain_sketches(spark, corpus):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark, docs).collect()}
    groups = collections.defaultdict(lambda: collections.defaultdict(list))
    rate = {d: {r: got[d][a] * 10_000 // max(1, got[d][b]) for r, (a, b, _, _) in quality_rules.RATES.items()} for d in got}
    low = lambda v: int(v) if v < 128 else (int(v) >> (int(v).bit_length() - 7)) << (int(v).bit_length() - 7)
    for d, row in got.items():
        if row["n_words"]:
            for key in ((row["lang"], row["source"]), (row["lang"],), ()):
                for r, v in rate[d].items():
                    groups[key][r].append(low(v))
    for d, row in got.items():
        ok = row["n_words"] >= 50 and 100 * row["n_repeat_words"] <= 50 * row["n_words"]
        assert row["base_failed"] == (not ok)
        for r, (_, _, prior, both) in quality_rules.RATES.items():
            values = next((v for k in ((row["lang"], row["source"]), (row["lang"],)) if len(v := groups[k][r]) >= quality_rules.MIN_GROUP), groups[()][r])
            low_end, high_end = plain_fences(values, prior)
            ok &= rate[d][r] <= high_end and (not both or rate[d][r] >= low_end)
        assert row["kept"] == ok, d


def test_rules_on_odd_rows(spark):
    df = docs_of(spark, ODD + ODD + ["word and other words of a text " * 2 + " ".join(f"w{i}" for i in range(60))], True)
    df = df.withColumns({"q": F.lit("q"), "_q": F.lit("a"), "_group": F.lit("b"), "_fences": F.lit("c"), "row": F.lit("r"), "t_lang": F.lit("t"), "hi_upper": F.lit("h"), "odd.name": F.lit("o")})
    assert quality_rules.apply_rules(spark, df).count() == 2 * len(ODD) + 1
    got = quality_rules.filter_documents(spark, df)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert got.collect() == df.where(F.col("doc_id") == 2 * len(ODD)).collect()
    assert quality_rules.apply_rules(spark, docs_of(spark, [])).count() == 0


# 3. Near duplicates


def plain_groups(texts):
    bags = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        k = min(5, len(w))
        bags[i] = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter()
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            total = sum(bags[i].values()) + sum(bags[j].values()) - shared
            if shared and shared >= 0.8 * total:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.integers(1000)}" for w in words)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    u = rng.integers(1, 2**63, 60).astype(np.uint64)
    a = rng.integers(0, 9, 60)
    b = np.maximum(0, a + rng.integers(-2, 3, 60))
    same = []
    for s in range(40):
        x = near_dups.seeded(u, s + 7)
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = near_dups.signatures(owner, np.concatenate([x[a > 0], x[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        same.append((sig[0] == sig[1]).mean())
    assert np.mean(same) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.02)


def test_groups_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 8)  # large components get several blocks
    rng = np.random.default_rng(2)
    base = [f"w{rng.integers(400)}" for _ in range(120)]
    other = [f"v{rng.integers(50)}" for _ in range(60)]
    texts = [edited(rng, base, 0.012 + 0.03 * rng.random()) for _ in range(60)] + [edited(rng, other, 0.01) for _ in range(15)] + [" ".join(base)] * 3 + ["a b", "a b", "a", "x y z", "\n".join(base)] + ODD + ["twice " * 40, "twice " * 45, "twice " * 80]
    want = plain_groups(texts)
    got = near_dups.near_duplicate_groups(spark, docs_of(spark, texts, True)).orderBy("doc_id").collect()
    assert [r["group_id"] for r in got] == want
    assert near_dups.filter_documents(spark, docs_of(spark, texts)).count() == len(set(want))


def test_groups_of_nothing_and_repeats(spark):
    assert near_dups.near_duplicate_groups(spark, docs_of(spark, [])).count() == 0
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "quite another text under the same id"), (2, "one two three four five six"), (None, "one two three four five six"), (3, "quite another text under the same id"), (None, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_gone", "row", "id", "t", "goes", "n", "odd.name")})
    got = near_dups.near_duplicate_groups(spark, df).collect()
    named = collections.Counter(r["group_id"] for r in got if r["group_id"] < near_dups.SURROGATE)
    assert len(got) == 7 and named in ({1: 3, 3: 2, 4: 1}, {2: 3, 1: 2, 4: 1})  # whichever text of 1 has the smaller hash
    kept = near_dups.filter_documents(spark, df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "", "one two three four five six", "quite another text under the same id"]


# 4. Decontamination


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=15))
def test_alignment(a, b):
    assert decontaminate.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))[0] == plain_alignment(a, b)


def test_leaks(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: " ".join(f"n{rng.integers(3000)}" for _ in range(n))
    items = [" ".join(f"q{k}_{i}" for i in range(30)) for k in range(4)] + [None, "too short", ""]
    w = items[1].split()
    changed = " ".join(x if i % 9 != 8 else "other" for i, x in enumerate(w))
    texts = [noise(80), f"{noise(30)} {items[0]} {noise(900)}", f"{noise(9)} {changed} {noise(9)}", f"{noise(20)} {' '.join(items[2].split()[:8])}", items[3].upper().replace(" ", ", "), None, "", "too short"]
    texts += [f"{noise(5)} {items[0]}"] * 20  # a common passage still has seeds
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, docs_of(spark, texts, True), bench).collect()}
    assert got == {(1, 0), (2, 1), (4, 3), (7, 5)} | {(8 + k, 0) for k in range(20)}  # (7, 5): a short item, word for word
    assert decontaminate.filter_documents(spark, docs_of(spark, texts), bench).count() == len(texts) - 24
    assert decontaminate.find_leaks(spark, docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(spark, docs_of(spark, []), bench).count() == 0


def test_short_items_are_found_verbatim():
    block = decontaminate.benchmark_block(list(range(4)), ["one", "two three", "a b c d", "one two three four five"])
    texts = ["ONE.", "x two, three y", "two x three", "a b c e", "z a b c d", "three two", "one two three four six", ""]
    got = {(i + t, k) for i, _, data, offsets in blocks(pa.array(texts)) for t, k, *_ in decontaminate.leaks_of_texts(block, data, offsets)}
    assert got == {(0, 0), (1, 1), (4, 2), (6, 0), (6, 1), (6, 3)}


def test_leaks_equal_plain(spark, corpus):
    """The whole result against an alignment of every document with every item."""
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    pick = lambda t: [w.lower() for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", t or "")]
    numbers = collections.defaultdict(lambda: len(numbers))
    texts = {r["doc_id"]: np.array([numbers[w] for w in pick(r["text"])], np.uint64) for r in docs.select("doc_id", "text").collect()}
    items = {r["item_id"]: np.array([numbers[w] for w in pick(r["text"])], np.uint64) for r in bench.collect()}
    right = {}
    for d, x in texts.items():
        own = set(x.tolist())
        for i, item in items.items():
            need = decontaminate.MIN_SCORE * len(item)
            if sum(w in own for w in item.tolist()) >= need:  # fewer common words cannot score as much
                score = decontaminate.smith_waterman(item, x)[0] / (decontaminate.MATCH * len(item))
                if score >= decontaminate.MIN_SCORE:
                    right[d, i] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_leaks(spark, docs, bench).collect()}
    assert got == pytest.approx(right) and right


def test_every_alignment_is_found():
    rng = np.random.default_rng(9)
    words = [f"c{k}" for k in range(60)]
    draw = lambda n: [words[k] for k in rng.integers(len(words), size=n)]
    items = [draw(n) for n in (5, 6, 7, 11, 15, 24, 30, 41, 59) for _ in range(3)]
    texts = []
    for item in items:
        for every in (1, 2, 3, 4, 5, 6, 7):
            k = int(rng.integers(every))
            replaced = ["other" if i % every == k else x for i, x in enumerate(item)]
            inserted = [y for i, x in enumerate(item) for y in ([x, "other"] if i % every == k else [x])]
            dropped = [x for i, x in enumerate(item) if i % every != k]
            texts += [draw(20) + t + draw(20) for t in (replaced, inserted, dropped)]
    texts += [f"{x} verbatim".split() for x in (" ".join(item) for item in items)] * 2
    number = {w: i for i, w in enumerate([*words, "other", "verbatim"])}
    numbers = lambda t: np.array([number[w] for w in t], np.uint64)
    right = {(t, i) for t, x in enumerate(texts) for i, item in enumerate(items) if decontaminate.smith_waterman(numbers(item), numbers(x))[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(item)}
    block = decontaminate.benchmark_block(list(range(len(items))), [" ".join(x) for x in items])
    got = {(t + i, k) for i, _, data, offsets in blocks(pa.array([" ".join(x) for x in texts], pa.string())) for t, k, *_ in decontaminate.leaks_of_texts(block, data, offsets)}
    assert got == right and len(right) > 200


def test_edited_copies_leak(spark):
    items = [" ".join(f"e{k}_{i}" for i in range(40)) for k in range(4)]
    texts = [" ".join(x if i % every else "other" for i, x in enumerate(items[k].split())) for k, every in enumerate((4, 5, 6, 7))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for kept in (texts, texts + items):  # alone, and beside verbatim copies
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, docs_of(spark, kept), bench).collect()}
        assert got == {(k, k % 4) for k in range(len(kept))}


# 5. Chat formatting


def test_round_trip(spark):
    hard = ["", "plain", "</s>", "[/INST]", "<s>", "a</s>[INST] b", "&lt;/s&gt; &amp;", "ends with </s", "[INST", "new\nline", "<s esc>", "\U0001f600", None]
    rows = [(k, t, r, x) for k, x in enumerate(hard) for t, r in enumerate(["system", "user", "assistant", "odd\nrole</s>", None])]
    rows += [(99, 0, "user", "tie"), (99, 0, "user", "tie"), (None, None, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parsed", F.lit(1))
    for row in chat_format.format_conversations(df).collect():
        assert row["parsed"] == row["turns"]
        at, learned = 0, []
        for length, on in row["mask_runs"]:
            if on:
                part = row["formatted"][at : at + length]
                learned.append(part.replace("&#10;", "\n").replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&") if row["escaped"] else part)
            at += length
        assert at == len(row["formatted"]) and learned == [t["text"] for t in row["turns"] if t["role"] == "assistant"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_digests_read_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, 2, "assistant", "c&d"), (2, 0, "assistant", "plain"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(df)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = [(r["conv_id"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(formatted).collect()]
    assert sorted(got, key=str) == sorted([(1, 9, sha("a</s>bc&d")), (2, 5, sha("plain")), (None, 1, sha("x")), (None, 1, sha("x"))], key=str)
    shifted = formatted.withColumn("mask_runs", F.transform("mask_runs", lambda r: F.struct(r["length"].alias("length"), (~r["learned"]).alias("learned"))))
    assert not {r["loss_sha256"] for r in chat_format.digests(shifted).collect()} & {g[2] for g in got}


def test_what_is_not_read_back_fails(spark):
    df = spark.createDataFrame([([("user", "a")], [("user", "b")]), ([("user", "a")], None)], "turns array<struct<role: string, text: string>>, parsed array<struct<role: string, text: string>>")
    for row in (0, 1):
        with pytest.raises(Exception, match="not read back"):
            df.select(chat_format.identical(F.col("parsed"), F.col("turns"), F.lit(1))).collect()[row]


def test_native_plan(spark):
    plan = QUERIES["op5_chat_format"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 6. Language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(5001, 10**9))
def test_elias_fano(values, universe):
    v = np.sort(np.array(values, np.uint64))
    raw = elias_fano.dump({f"x.{k}": a for k, a in elias_fano.EliasFano.encode(v, universe).items()})
    e = elias_fano.EliasFano(elias_fano.nested(elias_fano.load(np.frombuffer(raw, np.uint8)), "x"))
    assert e.get(np.arange(len(v))).tolist() == v.tolist()
    q = np.arange(0, 5001, 37).astype(np.uint64)
    zero = np.zeros(len(q), np.int64)
    assert e.successor(q, zero, zero + len(v)).tolist() == np.searchsorted(v, q).tolist()
    first, after = e.get_two(np.arange(max(0, len(v) - 1)))
    assert (first.tolist(), after.tolist()) == (v[:-1].tolist(), v[1:].tolist())
    rng = np.random.default_rng(len(v))
    start = rng.integers(0, len(v) + 1, len(q))
    end = np.minimum(start + rng.integers(0, len(v) + 1, len(q)), len(v))
    assert e.successor(q, start, end).tolist() == [int(s + np.searchsorted(v[s:t], x)) for x, s, t in zip(q, start, end)]


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(2**63, 2**63 + 9), max_size=60))
def test_order_of_numbers(values):
    v = np.array(values, np.uint64)
    assert lm_score.ordered(v).tolist() == np.argsort(v, kind="stable").tolist()
    distinct, back = lm_score.distinct_of(v)
    assert distinct.tolist() == sorted(set(values)) and distinct[back].tolist() == values


def test_language_model_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_GRAMS", 50)  # many shards
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{min(rng.geometric(0.15), 40)}" for _ in range(rng.integers(1, 60))) for _ in range(120)] + ODD
    df = docs_of(spark, texts, True)
    got = {r["doc_id"]: r for r in lm_score.score_documents(spark, df).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(w for i in train for w in tokens[i])
    two, three = collections.Counter(), collections.Counter()
    for i in train:
        x = [None, *tokens[i]]
        two.update(zip(x, x[1:]))
        three.update(zip(x, x[1:], x[2:]))
    two, three = ({k: n for k, n in c.items() if n >= 2} for c in (two, three))
    total, types, d = sum(one.values()), len(one), 0.75
    used1, used2 = collections.Counter(), collections.Counter()
    for (u, v), n in two.items():
        used1[u] += (n - d) / one[u]
    for (u, v, w), n in three.items():
        used2[u, v] += (n - d) / two[u, v]

    def p1(w):
        return (one[w] + 1) / (total + types + 1)

    def p2(v, w):
        return ((two[v, w] - d) / one[v] if (v, w) in two else 0) + (1 - used1[v]) * p1(w) if one[v] else p1(w)

    def p3(u, v, w):
        return p2(v, w) if (u, v) not in used2 else ((three[u, v, w] - d) / two[u, v] if (u, v, w) in three else 0) + (1 - used2[u, v]) * p2(v, w)

    for i, row in got.items():
        x = [None, *tokens[i]]
        base = sum(math.log10(p1(w)) for w in tokens[i])
        score = sum(math.log10(p3(x[k - 2], x[k - 1], x[k]) if k > 1 else p2(x[0], x[1])) for k in range(1, len(x)))
        assert row["base_score"] == pytest.approx(base) and row["train_tokens"] == total
        assert (row["n_tokens"], row["n_known"]) == (len(tokens[i]), sum(one[w] > 0 for w in tokens[i]))
        assert row["held_out"] == (i not in train) and row["score"] == pytest.approx(score, abs=0.02 * len(x))


def test_every_word_is_in_ngrams(spark):
    rng = np.random.default_rng(5)
    filler = [f"f{k}" for k in range(9000)]
    texts = [" ".join(rng.permutation(filler)) for _ in range(12)] + ["za zb zc"] * 5 + ["zc zb za"]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 2 <= sum(i in train for i in range(12, 18)) < sum(i in train for i in range(12))  # the z words are the rarest of 9,003
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in lm_score.score_documents(spark, docs_of(spark, texts)).collect()}
    assert got[12] > 8 and got[17] < got[12] - 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(0, 3), st.integers(-1, 2**31 - 2)), min_size=1, max_size=60))
def test_runs_of_counts(grams):
    u, v, w = np.array(grams, np.int64).T
    pair, w, n = lm_score._tally((u << lm_score.BITS) | v, w, np.ones(len(u), np.int64))
    want = collections.Counter(grams)
    assert [(int(p) >> lm_score.BITS, int(p) & (2**31 - 1), int(x)) for p, x in zip(pair, w)] == sorted(want)
    assert n.tolist() == [want[k] for k in sorted(want)]
    for a, b in zip((pair, w, n), lm_score._unpacked(lm_score._packed(pair, w, n), len(n))):
        assert a.tolist() == b.tolist()


def test_counts_sent_in_many_runs_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = docs_of(spark, [" ".join(f"w{min(rng.geometric(0.1), 60)}" for _ in range(rng.integers(1, 80))) for _ in range(200)] + ODD)
    whole = lm_score.score_documents(spark, df).orderBy("doc_id").collect()
    monkeypatch.setattr(lm_score, "GATHER", 100)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm_score, "SHARD_PAIRS", 200)
    monkeypatch.setattr(lm_score, "SEND_ROWS", 7)
    for a, b in zip(whole, lm_score.score_documents(spark, df).orderBy("doc_id").collect()):
        assert a["score"] == pytest.approx(b["score"])


def test_language_model_of_nothing(spark):
    assert lm_score.score_documents(spark, docs_of(spark, [])).count() == 0


# 7. WARC


def test_splits_own_every_record_once():
    rng = np.random.default_rng(5)
    parts = [warc.encode_record(str(i), f"http://x/{i}\r\n", rng.bytes(int(rng.integers(0, 3000))) + warc.MAGIC * 3, "0" * 64, None if i % 3 else "0") for i in range(60)]
    raw = b"".join(parts)
    for size in (97, 1000, 5000, len(raw)):
        found = [r for s in range(0, len(raw), size) for r in warc.records_in(io.BytesIO(raw), len(raw), s, min(len(raw), s + size))]
        assert [warc.decode_record(r)["page_id"] for r in found] == [str(i) for i in range(60)]


def test_damaged_archives_are_errors():
    rng = np.random.default_rng(6)
    parts = [warc.encode_record(str(i), "u", rng.bytes(700), "0" * 64, None) for i in range(12)]
    raw = b"".join(parts)
    at = len(b"".join(parts[:5]))
    broken = {
        "cut off": raw[:-1], "cut in a body": raw[:-400], "only a head": raw[: len(raw) - len(parts[-1]) + 20], "corrupt body": raw[: at + 300] + b"\0" * 40 + raw[at + 340 :],
        "corrupt head": raw[:at] + b"\0" * 30 + raw[at + 30 :], "leading bytes": b"xx" + raw, "bytes between": raw[:at] + b"junk" + raw[at:], "zeros behind": raw + bytes(900),
    }
    for name, data in broken.items():
        for size in (101, 1000, 4096, len(data)):
            with pytest.raises(warc.DamagedArchive):
                for s in range(0, len(data), size):
                    list(warc.records_in(io.BytesIO(data), len(data), s, min(len(data), s + size)))
                pytest.fail(f"{name}, {size}")


def test_archives_round_trip(spark):
    long = "é" * 200
    rows = [(5, "u5", long), (3, "u3", long), (9, None, None), (1, "u1", "short"), (2, "u2", "short"), (3, "u3", long), (None, "u", "x" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.read_archives(warc.write_archives(spark, pages), split_bytes=64).collect()
    assert len(got) == len(rows)
    types = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert types == {("5", "revisit", "3", 400): 1, ("3", "response", None, 400): 2, ("9", "response", None, 0): 1, ("1", "response", None, 5): 1, ("2", "response", None, 5): 1, (None, "response", None, 150): 1}
    assert all(r["payload_digest"] == hashlib.sha256(long.encode()).hexdigest() for r in got if r["payload_bytes"] == 400)
    assert warc.read_archives(warc.write_archives(spark, pages.limit(0))).count() == 0


# 8. Packing


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == ids.tobytes()
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]] and {r["doc_tokens"] for r in pieces} == {len(ids)}
    for pieces in by_window.values():
        pieces.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        assert total <= 2048 and total & (total - 1) == 0


def test_packing(spark, corpus):
    texts = corpus["text"].tolist() + ODD
    check_packing(packing.pack_documents(docs_of(spark, texts, True).repartition(3), vocabulary("word_bpe_49k.json")).collect(), texts)
    assert packing.pack_documents(docs_of(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_packer_fills_every_window(lengths):
    p = packing.Packer()
    for i, n in enumerate(lengths):
        p.add((i,), n)
        if i % 7 == 0:
            p.pack()
    p.pack(final=True)
    seen = collections.defaultdict(list)
    for _, size, _, pieces in p.drain():
        assert sum(x[0] for x in pieces) == size
        for length, (i,), start in pieces:
            seen[i].append((start, start + length))
    for i, n in enumerate(lengths):
        spans = sorted(seen[i])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_packing_repeats_itself_in_equal_steps(spark, corpus, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 40_000)
    texts = ["tie tie"] * 50 + corpus["text"].tolist() + ["tie tie"] * 50
    runs = [packing.pack_documents(docs_of(spark, texts).coalesce(1), vocabulary("word_bpe_49k.json")).collect() for _ in range(2)]
    assert runs[0] == runs[1]
    check_packing(runs[0], texts)
    steps = collections.defaultdict(lambda: collections.defaultdict(int))
    for r in runs[0]:
        steps[r["tier"]][r["step_group"]] += r["length"]
    for tier, own in steps.items():
        assert sorted(own.values())[1:] == [packing.STEP_TOKENS] * (len(own) - 1) or tier < 256


def ids_of(own, texts):
    out = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        ids, edge = own(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(edge, edge[1:])]
    return out


def test_hash_table(monkeypatch):
    table, keys = hash_table.Table(4), np.random.default_rng(1).integers(0, 2**62, 5000).astype(np.uint64)
    keys = np.unique(np.append(keys, np.uint64(0)))
    for part in np.array_split(keys, 7):
        assert (table.find(part) == -1).all()
        table.put(part, (part & np.uint64(0xFFFF)).astype(np.int64))
    assert (table.find(keys) == (keys & np.uint64(0xFFFF)).astype(np.int64)).all()
    key, first, back = text_module.told_apart(np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert len(key) == 3 and back[0] == back[3] != back[1]


def test_words_of_one_hash(monkeypatch):
    own = packing.WordTokens(vocabulary("word_bpe_49k.json"))
    plain = text_module.Words.hashes
    monkeypatch.setattr(text_module.Words, "hashes", lambda self, data=None, seed=0: plain(self, data, seed) if seed else np.full(len(self.end), 3, np.uint64))
    for t in ("one two one", "two three", "one three two"):
        assert ids_of(own, [t]) == [own.library.encode(t, add_special_tokens=False).ids]


def test_small_caches_give_the_same_ids(monkeypatch, corpus):
    monkeypatch.setattr(packing, "CACHED_WORDS", 30)
    own = packing.WordTokens(vocabulary("word_bpe_49k.json"))
    for t in corpus["text"].tolist()[:40]:
        assert ids_of(own, [t]) == [own.library.encode(t, add_special_tokens=False).ids]


def test_words_equal_whole_texts(corpus):
    own = packing.WordTokens(vocabulary("word_bpe_49k.json"))
    for t in corpus["text"].tolist()[:60] + ["<|endoftext|> a<|startoftext|>b", "é́ é ́x ﬁ İ ẞ", "a\x1cb\x85c\xa0d　e", "it's, don't..."]:
        assert ids_of(own, ["", t]) == [[], own.library.encode(t, add_special_tokens=False).ids]


# 9 and 10. Classifiers


def labelled(spark, n=500):
    rng = np.random.default_rng(6)
    sentence = lambda: " ".join(f"w{rng.integers(200)}" for _ in range(8))
    docs, labels = [], []
    for i in range(n):
        toxic, junk = i % 6 == 0, i % 5 == 0
        parts = [sentence() for _ in range(rng.integers(2, 9))]
        if toxic:
            parts[rng.integers(len(parts))] += " vileword"
        text = ". ".join(parts) + "."
        docs.append((i, text.upper() + "!!! ### |" * 9 if junk else text, "en", "s"))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (n + 2, "x" * 20_000, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_documents(spark, docs.withColumn("score", F.lit("clash")), labels).join(labels, "doc_id", "left").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["toxic"] or 0)
    model = toxicity.train(docs, labels)
    found = toxicity.offending_sentences(spark, docs, model).collect()
    assert found and all("vileword" in f["sentence"].lower() for f in found)
    assert toxicity.filter_documents(spark, docs, labels).count() == sum(not r["toxic"] for r in rows)
    assert toxicity.score_documents(spark, docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity.score_documents(spark, docs.limit(0), labels).count() == 0


def test_noisy_or_gradient():
    rng = np.random.default_rng(8)
    owner = np.repeat(np.arange(12), rng.integers(1, 5, 12))
    at, sentence = rng.integers(0, 4, 90), np.sort(rng.integers(0, len(owner), 90))
    y, w = rng.random(12) < 0.5, rng.normal(size=5)

    def loss(w):
        total = 0.0
        for t in range(12):
            clean = 1.0
            for s in np.flatnonzero(owner == t):
                clean *= 1 - 1 / (1 + math.exp(-(w[4] + w[at[sentence == s]].sum())))
            total -= math.log(1 - clean) if y[t] else math.log(clean)
        return total

    step = 1e-6 * np.eye(5)
    assert toxicity.gradient(w, at, sentence, owner, y) == pytest.approx([(loss(w + h) - loss(w - h)) / 2e-6 for h in step], rel=1e-4)


def test_toxicity_equals_plain(spark):
    """Chosen words and scores against loops over words; the fitted weights are the model's own."""
    docs, labels = labelled(spark, 120)
    model = toxicity.train(docs, labels)
    kept, tag = docs.where("text is not null").toPandas(), {r["doc_id"]: r["toxic"] for r in labels.collect()}
    place = {}

    def features(word):
        if word not in place:
            data = np.frombuffer(word, np.uint8)
            place[word] = toxicity.sentences(data, np.array([0, len(data)]))[0][0]
        return place[word]

    bags = {d: [[features(w.encode().lower()) for w in re.findall(r"[0-9A-Za-z]+", s)] for s in re.split(r"[.!?\n]", t) if re.search(r"[0-9A-Za-z]", s)] for d, t in zip(kept["doc_id"], kept["text"])}
    train = [d for d in bags if d in tag and zlib.crc32(str(d).encode()) % 4 != 2]
    bad, texts, positive = sum(tag[d] for d in train), collections.Counter(), collections.Counter()
    for d in train:
        own = {int(f) for s in bags[d] for w in s for f in w} - {0}
        texts.update(own)
        positive.update(own if tag[d] else ())
    good, n, chosen = len(train) - bad, len(train), set()
    for f, k in texts.items():
        error = math.sqrt(k / n * (1 - k / n) * (1 / bad + 1 / good)) + 1e-9
        if k >= toxicity.MIN_TEXTS and (positive[f] / bad - (k - positive[f]) / good) / error >= toxicity.MIN_Z:
            chosen.add(f)
    assert chosen and set(np.flatnonzero(model.weights)) <= chosen
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, model).collect()}
    for d, own in bags.items():
        clean = 1.0
        for s in own:
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[f].sum()) for f in s))))
        assert got[d] == pytest.approx(1 - clean, abs=1e-6)


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = quality_model.score_documents(spark, docs.withColumn("n_words", F.lit("clash")), labels).join(labels, "doc_id").where("held_out").collect()
    assert rows and all(r["predicted"] == r["quality"] for r in rows)
    assert quality_model.score_documents(spark, docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.5


def test_interactions():
    rng = np.random.default_rng(7)
    x = rng.random((3000, len(quality_model.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    assert (2, 5) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "decontamination", "packing"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(spark, step(spark, docs, SMALL), name)
        assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert rows.select("doc_id").distinct().count() == sizes[-1]
    empty = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SMALL).count() == 0
