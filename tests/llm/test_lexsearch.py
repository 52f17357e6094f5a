"""Lexical search against plain recomputation of every score."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from almoneda.llm import lexsearch


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute(docs, items, k):
    words = [(d, re.findall(lexsearch.TERM, lower(t or ""))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = {}
    for item, text in items:
        scores = []
        for d, w in words:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in re.findall(lexsearch.TERM, lower(text or "")) if t in df)
            if score > 0:
                scores.append((-score, d is None, d))
        out[item] = [(i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return {i: v for i, v in out.items() if v}


def searched(got):
    out = {}
    for r in got.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "été", "日本", "a1", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, rng.choice([" ", ", ", "\n", "_", "-"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 8, 8, 8, 40])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 9])))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("seed,block,group", [(1, 16, 20_000), (2, 40, 7), (3, 4096, 20_000)])
def test_search_equals_brute_force(spark, seed, block, group):
    """Many equal scores, repeated terms, several blocks a task and several groups of items."""
    docs, items = corpus(seed, 700)
    docs += [(1000, docs[5][1]), (1001, docs[5][1]), (None, docs[6][1]), (1002, None), (1003, ""), (1004, " .-"), (1005, "w59 " * 30_000)]
    items += [(100, None), (101, "..."), (102, "nowhere"), (103, "w0 W0 w0 w59 nowhere")]
    random.Random(seed).shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", "1 AS ids", "2 AS `n.l`", "3 AS score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS item", "2 AS rank")
    assert searched(lexsearch.lexical_search(d, i, 20, group, block)) == brute(docs, items, 20)


def test_repeated_rows_strings_and_empty_tables(spark):
    d = spark.createDataFrame([("x", "a b"), ("x", "a b"), ("y", "a"), ("z", "c")], "doc_id string, text string")
    i = spark.createDataFrame([("q", "a")], "item_id string, text string")
    got = searched(lexsearch.lexical_search(d, i, 2))["q"]
    assert [(r, x) for r, x, _ in got] == [(1, "y"), (2, "x")]
    assert [x for _, x, _ in searched(lexsearch.lexical_search(d, i, 5))["q"]] == ["y", "x", "x"]
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d, i.withColumn("text", i.text.substr(5, 1)))):
        found = lexsearch.lexical_search(a, b)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def blocks_of(rng, n, terms, most):
    rows = [sorted(rng.sample(range(terms), rng.randint(1, most))) for _ in range(n)]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.array([t for r in rows for t in r])
    return rows, cuts, flat


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_trees_bound_what_lies_below(fan):
    rng = random.Random(fan)
    rows, cuts, flat = blocks_of(rng, 333, 30, 6)
    values = np.array([rng.randint(1, 50) for _ in flat])
    trees = lexsearch.MaxTrees(cuts, flat, values, fan)
    assert trees.levels[-1].shape[1] == 1
    for level, nodes in enumerate(trees.levels):
        for row, term in enumerate(trees.known.tolist()):
            for node in range(nodes.shape[1]):
                lo, hi = node * fan ** (level + 1), min((node + 1) * fan ** (level + 1), 333)
                below = [values[p] for d in range(lo, hi) for p in range(cuts[d], cuts[d + 1]) if flat[p] == term]
                assert nodes[row, node] == max(below, default=0)


def test_search_opens_few_nodes_and_all_ties():
    rng = random.Random(9)
    rows, cuts, flat = blocks_of(rng, 4000, 2000, 4)
    values = np.array([rng.randint(1, 9) for _ in flat])
    trees = lexsearch.MaxTrees(cuts, flat, values)
    for q in range(30):
        terms = np.array(sorted(rng.sample(range(2000), 3)))
        query, best = lexsearch.Query(q, terms, np.array([rng.randint(0, 5) for _ in terms])), []
        opened = trees.search(query, best, 3, list(range(4000)))
        w = dict(zip(terms.tolist(), query.weights.tolist()))
        scores = sorted(((-sum(w.get(flat[p], 0) * values[p] for p in range(cuts[d], cuts[d + 1])), d) for d in range(4000)))[:3]
        assert sorted((-s, d.v) for s, d in best) == sorted((int(s), d) for s, d in scores if s < 0)
        assert opened < 80  # of 268 nodes


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexsearch.spans, "hashes", lambda data, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    data = np.frombuffer(b"abc xyz Abc de abcd", np.uint8)
    starts, ends, _ = lexsearch.spans.runs(data, np.array([0, len(data)]), lexsearch._TERM)
    assert lexsearch.Lexicon(["abc", "fg"]).find(data, starts, ends).tolist() == [0, -1, 0, -1, -1]
