"""Merkle manifest, collocations and exact duplicates against plain Python, and word hashes."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwell.llm import collocations, decontaminate, exact_dups, lm_score, merkle, packing, quality_rules
from stepwell.llm.queries import vocabulary
from stepwell.llm.text import blocks, words_of

ODD = [None, "", " \n\t ", "A", "a", "a b", "a  b", "ab", "A b", "é à", "日本語", "x" * 50_000, "x" * 50_000, "nul\x00", "nul", "</s>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Word hashes


def test_words_of_nul_bytes_have_hashes_of_their_own():
    words = [bytes(w) for n in (1, 2, 3, 7, 8, 9) for w in itertools.product(*([(0, 1, 97, 98)] * min(n, 3)), *([(0,)] * max(0, n - 3)))]
    for i, j, data, offsets in blocks(pa.array(words, pa.binary())):
        own = words_of(data, offsets)
        assert (i, j, len(own.start)) == (0, len(words), len(words))
        pairs = set(zip(own.hashes().tolist(), own.hashes(seed=1 << 40).tolist()))
        assert len(pairs) == len(set(own.hashes().tolist())) == len(words)


@pytest.mark.parametrize("texts", [["a b\x00", "a day", "b a\x00 b\x00\x00 day"], ["a day", "b\x00 a", "a\x00 day"]])
def test_packing_of_nul_bytes_equals_the_library(spark, texts):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = texts * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = collections.defaultdict(list)
    for row in packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect():
        got[row["doc_id"]].append((row["start"], np.frombuffer(bytes(row["ids"]), "<u4").tolist()))
    for k, text in enumerate(texts):
        assert sum((ids for _, ids in sorted(got[k])), []) == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_rules_and_scores_tell_nul_bytes_apart(spark):
    docs = spark.createDataFrame([(0, "x y a x y b\x00", "en", "s"), (1, "x y a x y a", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.apply_rules(spark, docs).collect()} == {0: 0, 1: 6}
    docs = spark.createDataFrame([(k, "a a\x00 a\x00\x00" if k % 2 else "a", "en", "s") for k in range(40)], "doc_id long, text string, lang string, source string")
    training = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 != 2]
    for r in lm_score.score_documents(spark, docs).collect():
        assert r["n_known"] == r["n_tokens"] == (4 if r["doc_id"] % 2 else 2)
        assert r["train_tokens"] == sum(4 if k % 2 else 2 for k in training)


# 11. Merkle manifest


def plain_tree(nodes):
    """(root, [(before, after), ...] for each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(at):
            paths[k].append(("".join(runs[p // 16][: p % 16]), "".join(runs[p // 16][p % 16 + 1 :])))
            at[k] = p // 16
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain_leaf(row, low=False):
    text = row["text"]
    if low and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    shown = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def plain_manifest(rows):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        trees.append(plain_tree([plain_leaf(r) for r in by_source[s]]))
    if not trees:
        return []
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for r, path in zip(by_source[s], trees[k][1]):
            path = path + upper[k]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            own = plain_leaf(r, tampered)
            for before, after in path:
                own = sha(before + own + after)
            out.append((r["doc_id"], plain_leaf(r), trees[k][0], root, sha("".join(b + a for b, a in path)), own, own == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check_manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("clash"), "path": F.lit(1), "part": F.lit(None).cast("string"), "idx": F.lit(2)})
    got = merkle.digests(merkle.manifest(spark, docs)).collect()
    want = plain_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_manifest_of_many_sizes_and_sources(spark):
    rows, k = [], 0
    for source, n in ((None, 17), ("", 1), ("a", 16), ("b", 257), ("é", 33), ("z", 2)):
        for _ in range(n):
            rows.append((k * 7 % 1009, source, "en" if k % 3 else None, k if k % 4 else None, ODD[k % len(ODD)] if k % 2 else f"Text {k} Is Ä"))
            k += 1
    check_manifest(spark, rows)


def test_manifest_of_many_sources_makes_a_deep_upper_tree(spark):
    check_manifest(spark, [(k, f"s{k % 270}", "en", k, f"Text {k}") for k in range(300)])


@pytest.mark.parametrize("rows", [[], [(3, None, None, None, None)], [(5, "s", "l", 1, "A")] * 40, [(None, "s", "l", 1, "A"), (1, "s", "l", 1, "A")]])
def test_manifest_of_little_and_of_repeats(spark, rows):
    check_manifest(spark, rows)


def test_proofs_hold_only_for_their_leaf(spark):
    docs = spark.createDataFrame([(k, "s", "en", k, f"Text {k}") for k in range(40)], SCHEMA)
    found = merkle.manifest(spark, docs)
    own = found.select(merkle.folded(F.col("leaf"), F.col("path")).alias("a"), merkle.folded(F.sha2("leaf", 256), F.col("path")).alias("b"), "root").collect()
    assert all(r["a"] == r["root"] != r["b"] for r in own)


# 12. Collocations


def plain_pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", lower)]


def plain_collocations(rows, least, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in plain_pieces(text):
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in own.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in own.items():
            if 100 * inside[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def check_collocations(spark, rows, least, top=2000):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({"id": F.lit(1), "f": F.lit("x"), "phrase": F.lit(None).cast("string"), "n": F.lit(0)})
    got = collocations.collocations(spark, docs, min_count=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, top)


def test_collocations_equal_plain(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary_ = ["The", "of", "a", "a\x00", "état", "x" * 70, "x" * 71, "\x01z", "New", "York", "City", "日本"]
    rows = []
    for k in range(120):
        words = rng.choice(vocabulary_, rng.integers(0, 40), p=np.array([6, 5, 4, 1, 1, 2, 1, 1, 1, 1, 1, 1]) / 25)
        seps = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ; "], len(words), p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append(("".join(w + s for w, s in zip(words, seps)) + " New York City", [None, "und", "en", "fr"][k % 4]))
    rows += [(None, "en"), ("", None), (" \t. ", "de"), ("aa aa aa aa aa aa", "rep"), ("only once here", "one")]
    monkeypatch.setattr(collocations, "BLOCK_TEXT_BYTES", 500)
    check_collocations(spark, rows, 4)
    monkeypatch.setattr(collocations, "BLOCK_PATTERN_BYTES", 700)  # many automata
    monkeypatch.setattr(collocations, "GATHER", 50)
    monkeypatch.setattr(collocations, "RANGE_BITS", 4)
    monkeypatch.setattr(collocations, "CELLS_PER_BYTE", 1)
    monkeypatch.setattr(collocations, "FILTER_BITS", 7)  # lets nearly all through
    check_collocations(spark, rows, 3, top=5)


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("one two", "en")]):
        check_collocations(spark, rows, 2)


def test_a_narrow_sketch_loses_no_phrase(spark, monkeypatch):
    monkeypatch.setattr(collocations, "sketch_bits", lambda n_bytes: collocations.RANGE_BITS)
    monkeypatch.setattr(collocations, "RANGE_BITS", 3)  # eight cells in all: every bound is far too high
    check_collocations(spark, [("to be or not to be", "en"), ("to be is not to do", "en"), ("to be", "fr")], 2)


def test_texts_are_read_no_more_often_for_more_patterns(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice([*"abcdefgh", "x" * 70, "é. b"], 60)), ["en", "fr"][k % 2]) for k in range(60)]
    tags, real = [], collocations.stage
    monkeypatch.setattr(collocations, "stage", lambda spark, df, tag: (tags.append(tag), real(spark, df, tag))[1])
    check_collocations(spark, rows, 3)
    first = tags[:]
    monkeypatch.setattr(collocations, "BLOCK_PATTERN_BYTES", 300)
    monkeypatch.setattr(collocations, "SHARD_TEXT_BYTES", 3000, raising=False)
    monkeypatch.setattr(collocations, "WINDOWS", 50, raising=False)
    check_collocations(spark, rows, 3)
    assert tags == first + first


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n.,\x00é", max_size=30), max_size=4))
def test_guarded_texts_match_whole_words(texts):
    f = collections.Counter()
    for text in texts:
        for words in plain_pieces(text):
            for k in range(1, 4):
                f.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    machine = collocations.automata(repr(list(f)), {"l": (np.arange(len(f)), "\n".join(f))})["l"] if f else None
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        text = collocations.guarded(data, offsets)
        assert {list(f)[k]: n for k, n in collocations.matches(machine, text).items()} == f if f else text == ""


# 13. Exact duplicates


def plain_dups(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub("[ \t-\r]", "", r[1] or "")].append(r)
    out = []
    for body, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out += [(r[0], keep, len(own), sha(body)) for r in own]
    return sorted(out, key=repr)


def check_dups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "content": F.lit(1), "digest": F.lit(2), "size": F.lit(3)})
    got = exact_dups.duplicate_groups(spark, docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == plain_dups(rows)
    for body in {r["text_sha256"] for r in got}:
        own = [r for r in got if r["text_sha256"] == body]
        assert [r["doc_id"] for r in own if r["kept"]] == [own[0]["keep_id"]]


ROWS = [(k, t) for k, t in enumerate(ODD)] + [(90 - k, t) for k, t in enumerate(ODD)] + [(7, "seven"), (7, "seven"), (None, "a b"), (None, "new"), (5, "\x0b\x0c\r"), (200, "b " * 30), (199, "bb" * 15)]


@pytest.mark.parametrize("heavy", [1, 2048])
@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_dups_equal_plain(spark, monkeypatch, hash_bytes, heavy):
    monkeypatch.setattr(exact_dups, "HASH_BYTES", hash_bytes)  # one byte: texts of one hash are told apart by their bytes
    monkeypatch.setattr(exact_dups, "HEAVY_SHARE", heavy)
    check_dups(spark, ROWS + [(1000 + k, f"text {k}") for k in range(300)])


def test_dups_of_nothing(spark):
    check_dups(spark, [])
    check_dups(spark, [(1, None)])


def test_one_row_of_equal_texts_stays(spark):
    rows = ROWS + [(7, "seven")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, id string").withColumn("kept", F.lit(0))
    left = exact_dups.filter_documents(spark, docs)
    assert left.columns == docs.columns
    bodies = [re.sub("[ \t-\r]", "", r["text"] or "") for r in left.collect()]
    assert sorted(bodies) == sorted({re.sub("[ \t-\r]", "", t or "") for _, t in rows})


# 4. Decontamination with words that are drawn as in prose


def zipf_block(n_items, n_words, n_docs, seed=0):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, 20_001)
    draw = lambda n: " ".join(f"w{k}" for k in rng.choice(20_000, n, p=weight / weight.sum()))
    items, texts = [draw(n_words) for _ in range(n_items)], [draw(500) for _ in range(n_docs)]
    known = decontaminate.windows_of(decontaminate.items_of(items))
    counts, total = np.zeros(len(known), np.int64), 0
    for _, _, data, offsets in blocks(pa.array(texts)):
        words, hashes = decontaminate._words(data, offsets)
        total += len(hashes)
        for size in (1, 2):
            g = decontaminate.grams(hashes, words.text_of_word(), words.first, size)[1]
            k = np.minimum(np.searchsorted(known, g), len(known) - 1)
            counts += np.bincount(k[known[k] == g], minlength=len(known))
    return items, texts, decontaminate.benchmark_block(list(range(n_items)), items, known, counts, total)


def test_common_words_start_few_alignments(monkeypatch):
    """4,000 items of 12 words: of 160,000 pairs of text and item next to none is aligned alone, and few stretches are scored."""
    items, texts, block = zipf_block(4000, 12, 40)
    aligned, scored = [], []
    align, score = decontaminate.smith_waterman, decontaminate.score_bounds
    monkeypatch.setattr(decontaminate, "smith_waterman", lambda *a: aligned.append(1) or align(*a))
    monkeypatch.setattr(decontaminate, "score_bounds", lambda i, p: scored.append(len(i)) or score(i, p))
    leaky = [f"{texts[0]} {items[7]} {texts[1]}", f"{texts[2]} {items[9].rsplit(' ', 3)[0]} new words"]
    found = [(i + t, k) for i, _, data, offsets in blocks(pa.array(texts + leaky)) for t, k, *_ in decontaminate.leaks_of_texts(block, data, offsets)]
    assert set(found) == {(40, 7), (41, 9)}
    assert len(aligned) <= 10 and sum(scored) < 200 * len(texts)


def test_rare_seeds_miss_no_alignment_of_common_words():
    items, texts, block = zipf_block(60, 14, 10, seed=5)
    rng = np.random.default_rng(6)
    edited = []
    for k, item in enumerate(items):
        own = item.split()
        for _ in range(6):
            new = [w for w in own if rng.random() > 0.15]
            for at in sorted(rng.integers(0, len(new) + 1, rng.integers(0, 5)), reverse=True):
                new.insert(at, f"w{rng.integers(50)}")
            edited.append(" ".join([*texts[k % 10].split()[:30], *new, *texts[(k + 1) % 10].split()[:30]]))
    number = collections.defaultdict(lambda: len(number))
    numbers = lambda t: np.array([number[w] for w in t.split()], np.uint64)
    right = {(t, i) for t, x in enumerate(edited) for i, item in enumerate(items) if decontaminate.smith_waterman(numbers(item), numbers(x))[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * 14}
    got = {(i + t, k) for i, _, data, offsets in blocks(pa.array(edited)) for t, k, *_ in decontaminate.leaks_of_texts(block, data, offsets)}
    assert got == right and len(right) > 200


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), min_size=6, max_size=6), min_size=1, max_size=4), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=15), min_size=4, max_size=4))
def test_scores_of_many_passages_at_once(items, passages):
    items, passages = [np.array(x, np.uint64) * 7919 for x in items], [np.array(x, np.uint64) * 7919 for x in passages[: len(items)]]
    assert decontaminate.score_bounds(items, passages).tolist() == [decontaminate.smith_waterman(a, b)[0] for a, b in zip(items, passages)]


def test_counts_of_the_corpus(spark):
    items = decontaminate.items_of(["a b c", "c a"])
    known = decontaminate.windows_of(items)
    docs = spark.createDataFrame([("A b, c c a",), ("b",), (None,), ("x a",)], "text string").repartition(2)
    counts, total = decontaminate.corpus_counts(spark, docs, known)
    word = lambda *w: decontaminate._windows(decontaminate.items_of([" ".join(w)])[0], len(w))[0]
    assert total == 8 and {w: int(counts[np.searchsorted(known, word(*w.split()))]) for w in ("a", "b", "c", "a b", "b c", "c a")} == {"a": 3, "b": 2, "c": 2, "a b": 1, "b c": 1, "c a": 1}
