"""The quality model against loops over rows, and the stages of the pipeline against plain Python."""

import bisect
import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepwell.llm import decontaminate, doc_stats, labelled, quality_model, quality_rules, toxicity
from stepwell.llm.queries import vocabulary
from stepwell.llm.text import blocks

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_capitals_beyond_ascii():
    texts = ["École été", "ß é Ü", "Å × ÷", "A a Z z", "Þ", "", "é"]
    for _, _, data, offsets in blocks(pa.array(texts)):
        assert doc_stats.doc_counts(data, offsets)["n_capital_words"].tolist() == [1, 1, 1, 2, 1, 0, 0]


# 10. Quality model


def plain_leaves(rows, depth):
    """[(bins, value), ...] of the greedy tree over (bin, gradient, hessian) rows grouped by bin."""
    score = lambda part: sum(g for _, g, _ in part) ** 2 / (sum(h for *_, h in part) + 1)
    if depth and len(rows) > 1:
        gains = [score(rows[:k]) + score(rows[k:]) for k in range(1, len(rows))]
        k = max(range(len(gains)), key=lambda i: (gains[i], -i))
        if gains[k] > score(rows) + 1e-9:
            return plain_leaves(rows[: k + 1], depth - 1) + plain_leaves(rows[k + 1 :], depth - 1)
    value = sum(g for _, g, _ in rows) / (sum(h for *_, h in rows) + 1)
    return [(b, value) for b, _, _ in rows]


def grouped(bins, y, z, n):
    g, h = [0.0] * n, [0.0] * n
    for b, t, s in zip(bins, y, z):
        p = 1 / (1 + math.exp(-s))
        g[b] += t - p
        h[b] += max(p * (1 - p), 1e-6)
    return [(b, g[b], h[b]) for b in range(n)]


def test_one_round_of_boosting_and_the_ranking_of_pairs_equal_loops(monkeypatch):
    rng = np.random.default_rng(1)
    n, m = 400, len(quality_model.FEATURES)
    x = rng.random((n, m)).round(2)
    y = ((x[:, 1] > 0.6) | (x[:, 3] < 0.2) ^ (x[:, 8] > 0.5)).astype(float)
    monkeypatch.setattr(quality_model, "ROUNDS", 1)
    monkeypatch.setattr(quality_model, "PAIR_ROUNDS", 1)
    monkeypatch.setattr(quality_model, "PAIRS", 3)
    model = quality_model.fit(x, y)
    share = (y.sum() + 1) / (n + 2)
    z = [math.log(share / (1 - share))] * n
    assert model.bias == pytest.approx(z[0])
    for j in range(m):
        cuts = model.edges[j].tolist()
        bins = [bisect.bisect_right(cuts, v) for v in x[:, j].tolist()]
        table = dict(plain_leaves(grouped(bins, y, z, len(cuts) + 1), 2))
        assert model.tables[j].tolist() == pytest.approx([quality_model.RATE * table[b] for b in range(len(cuts) + 1)])
        z = [s + quality_model.RATE * table[b] for s, b in zip(z, bins)]
        assert len({round(v, 12) for v in table.values()}) <= 4
    rough = [[bisect.bisect_right(model.coarse[j].tolist(), v) for v in x[:, j].tolist()] for j in range(m)]

    def best_split(a, b, z):
        """(gain, cut of a, cut of b, value of each quarter)."""
        width = len(model.coarse[b]) + 1
        cells = grouped([p * width + q for p, q in zip(rough[a], rough[b])], y, z, (len(model.coarse[a]) + 1) * width)
        found = (0.0, 0, 0, {})
        for i in range(1, len(model.coarse[a]) + 1):
            for k in range(1, width):
                part = collections.defaultdict(lambda: [0.0, 0.0])
                for c, g, h in cells:
                    own = part[c // width >= i, c % width >= k]
                    own[0] += g
                    own[1] += h
                gain = sum(g * g / (h + 1) for g, h in part.values())
                if gain > found[0] + 1e-12:
                    found = (gain, i, k, {q: g / (h + 1) for q, (g, h) in part.items()})
        return found

    ranked = sorted(((best_split(a, b, z)[0], a, b) for a in range(m) for b in range(a + 1, m)), reverse=True)
    assert model.pairs == [(a, b) for _, a, b in ranked[:3]]
    for (a, b), grid in zip(model.pairs, model.grids):
        _, i, k, value = best_split(a, b, z)
        want = [[quality_model.RATE * value[p >= i, q >= k] for q in range(grid.shape[1])] for p in range(grid.shape[0])]
        assert grid.tolist() == [pytest.approx(w) for w in want]
        z = [s + want[p][q] for s, p, q in zip(z, rough[a], rough[b])]
    assert model.logit(x).tolist() == pytest.approx(z)
    by_hand = [1 / (1 + math.exp(-s)) for s in z]
    assert model.score(x).tolist() == pytest.approx(by_hand)


def test_scores_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality_model.train(docs, labels)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A plain text. " * 3), (4, "A plain text. " * 3), (5, "words and more " * 40_000), (None, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "k0": F.lit(1), "n_words": F.lit(None).cast("int")})
    got = [(r["doc_id"], r["score"]) for r in quality_model.score(spark, odd, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    assert score[1] == score[2] and len({s for d, s in got if d == 4}) == 1
    zeros = model.score(np.zeros((1, len(quality_model.FEATURES))))[0]
    assert score[1] == pytest.approx(zeros)
    assert quality_model.score(spark, odd.limit(0), model).count() == 0
    assert quality_model.score_documents(spark, docs.limit(0), labels).count() == 0


def test_training_rows_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (3, None), (4, ""), (None, "x"), (5, "y" * 100_001), (7, "kept")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, v) for d in range(1, 9) for v in (0, 1)] + [(None, 1), (7, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = {r["doc_id"]: (r["text"], r["label"]) for r in labelled.training_rows(docs, labels, "quality").collect()}
    fold = {r["doc_id"] for r in spark.range(1, 9).withColumnRenamed("id", "doc_id").where(labelled.held_out()).collect()}
    assert set(got) == {1, 4, 7} - fold and all(v[1] == 1 for v in got.values())
    assert labelled.training_rows(docs, labels.limit(0), "quality").count() == 0


# The pipeline


def plain_rates(text):
    w = WORD.findall(text)
    often = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    c = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_upper": len(re.findall("[A-Z]", text)), "n_bangs": len(re.findall("[!?]", text))}
    return c, {r: c[a] * 10_000 // max(1, c[b]) for r, (a, b, _, _) in quality_rules.RATES.items()}


def plain_quality(rows):
    low = lambda v: v if v < 128 else (v >> (v.bit_length() - 7)) << (v.bit_length() - 7)
    groups = collections.defaultdict(lambda: collections.defaultdict(list))
    own = {r["doc_id"]: plain_rates(r["text"] or "") for r in rows}
    for r in rows:
        if own[r["doc_id"]][0]["n_words"]:
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                for name, v in own[r["doc_id"]][1].items():
                    groups[key][name].append(low(v))
    kept = []
    for r in rows:
        c, rates = own[r["doc_id"]]
        ok = c["n_words"] >= 50 and 2 * c["n_repeat_words"] <= c["n_words"]
        for name, (_, _, prior, both) in quality_rules.RATES.items():
            values = sorted(next((v for k in ((r["lang"], r["source"]), (r["lang"],)) if len(v := groups[k][name]) >= quality_rules.MIN_GROUP), groups[()][name]))
            if ok:
                q1, q3 = (values[math.ceil(len(values) * q / 4) - 1] for q in (1, 3))
                sane = [v for v in values if v <= q3 + 4 * max(q3 - q1, prior)]
                reach = max(4 * (q3 - q1), 6 * (sane[math.ceil(len(sane) * 98 / 100) - 1] - q3), 2 * prior)
                ok = rates[name] <= q3 + reach and (not both or rates[name] >= q1 - reach)
        if ok:
            kept.append(r["doc_id"])
    return kept


def plain_firsts(rows):
    """The least id of each group of texts whose 5-word shingle bags are similar by 0.8 or more."""
    bags = {}
    for r in rows:
        w = WORD.findall(r["text"] or "")
        k = min(5, len(w))
        bags[r["doc_id"]] = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter()
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    size = {d: sum(b.values()) for d, b in bags.items()}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) > 0 and not bags[a].keys().isdisjoint(bags[b]):
                shared = sum((bags[a] & bags[b]).values())
                if shared >= 0.8 * (size[a] + size[b] - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [d for d in ids if find(d) == d]


def plain_clean(rows, items):
    pick = lambda t: [w.lower() for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", t or "")]
    numbers = collections.defaultdict(lambda: len(numbers))
    as_numbers = lambda t: np.array([numbers[w] for w in pick(t)], np.uint64)
    items = [as_numbers(t) for t in items]
    kept = []
    for r in rows:
        text = as_numbers(r["text"])
        own = set(text.tolist())
        likely = [i for i in items if sum(w in own for w in i.tolist()) >= decontaminate.MIN_SCORE * len(i) > 0]
        if not any(decontaminate.smith_waterman(i, text)[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(i) for i in likely):
            kept.append(r["doc_id"])
    return kept


def test_every_stage_keeps_what_plain_python_keeps(spark):
    import corpus_pipeline
    import tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in ("row", "q", "group_id", "score", "kept", "t_lang", "k0", "id", "odd.name")})
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(spark, docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    plain = {
        "toxicity": lambda rows: [r["doc_id"] for r in rows if scores[r["doc_id"]] < toxicity.REJECT_FROM],
        "quality_rules": plain_quality,
        "near_duplicates": plain_firsts,
        "decontamination": lambda rows: plain_clean(rows, items),
    }
    for name, step in corpus_pipeline.STAGES[:-1]:
        want = set(plain[name](rows))
        docs = corpus_pipeline.stage(spark, step(spark, docs, SMALL), name)
        assert docs.columns == columns, name
        found = [r.asDict() for r in docs.collect()]
        assert {r["doc_id"] for r in found} == want and len(found) == len(want), name
        assert all(r[c] == f"{c} {r['doc_id']}" for r in found for c in columns[5:]), name
        assert len(found) < len(rows), name  # each stage has something to reject here
        rows = found
    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = collections.defaultdict(dict)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect():
        pieces[r["doc_id"]][r["start"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    assert set(pieces) == {r["doc_id"] for r in rows}
    for r in rows:
        own = pieces[r["doc_id"]]
        assert sum((own[k] for k in sorted(own)), []) == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
