"""Phrase mining against a plain recomputation."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from almoneda.llm import phrases


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {k: v for k, v in f.items() if v >= least}
    longer = Counter()
    for (lang, x), c in often.items():
        for m in range(2, len(x)):
            for i in range(len(x) - m + 1):
                longer[lang, x[i : i + m]] = max(longer[lang, x[i : i + m]], c)
    out = {}
    for (lang, x), a in often.items():
        if len(x) < 2 or 100 * longer[lang, x] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, x[:k]] + f[lang, x[k:]]), k, f[lang, x[:k]], f[lang, x[k:]]) for k in range(1, len(x)))
        out.setdefault(lang, []).append((-score, -a, " ".join(x).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top])}


def made(spark, rows):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "text", "h1", "n.x", "word")])
    return spark.createDataFrame([(*r, "h", None, "w") for r in rows], schema).repartition(3)


ROWS = [
    *[("en", "The big RED fox jumps; over the big red fox\tjumps again. the the the the the")] * 5,
    *[("en", f"of the big idea{i % 3} of the red idea{i % 3}, of the x{i}\nof the") for i in range(40)],
    *[(None, "no lang here no lang here")] * 4, ("und", "no lang here"), ("fr", "élan vital élan vital Élan"), ("fr", None), (None, None), ("de", ""), ("de", " .,\n"), ("a'b", "solo"),
    ("en", "of the " * 3000), ("fr", "é" * 70_000 + " fin"),
]


@pytest.mark.parametrize("least,top,pointers", [(3, 2000, 2_000_000), (3, 4, 200), (2, 2000, 50), (30, 5, 1000)])
def test_phrases_equal_brute_force(spark, least, top, pointers):
    """Small tasks make the frequent prefixes hot, so both ways of counting are met."""
    got = phrases.collocations(made(spark, ROWS), least, top, task_pointers=pointers).collect()
    assert {tuple(r) for r in got} == brute(ROWS, least, top) and len(got) == len({tuple(r) for r in got})


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, and floors that doubles would miss."""
    big = 9 * 10**17 + 1
    words = spark.createDataFrame([Row(h=1, lang="x", word="a", f=3 * big, words=1), Row(h=2, lang="x", word="b", f=3 * big - 2, words=1)])
    found = spark.createDataFrame([(1, 2, 0, 0, big), (1, 2, 1, 0, big * 4 // 5)], "h1 long, h2 long, h3 long, h4 long, f long")
    got = {(r.h1, r.h2, r.h3): r for r in phrases._scored(found.filter("h3 = 0"), words).collect()}
    assert got[1, 2, 0].score == 2000000 * big // (6 * big - 2) and (got[1, 2, 0].l, got[1, 2, 0].r) == (3 * big, 3 * big - 2)
    # the longer one occurs at least 0.8 times as often only if the product is exact
    both = phrases._scored(found.unionByName(found.filter("h3 = 0").selectExpr("2L h1", "1L h2", "0L h3", "0L h4", "f")), words).collect()
    assert ((1, 2, 0) in {(r.h1, r.h2, r.h3) for r in both}) == (not 100 * (big * 4 // 5) >= 80 * big)


def test_names_that_collide_are_told(spark):
    rows = [(7, "en", "x", 20), (7, "en", "y", 9), (7, "en", "x", 2), (8, "en", "z", 30), (9, "fr", "z", 3), (5, "en", None, 40), (5, "en", None, 21)]
    got = phrases._by_name(spark.createDataFrame(rows, "h long, lang string, word string, c long"), 30)
    assert {(r.h, r.f, r.words) for r in got.collect()} == {(7, 31, 2), (8, 30, 1), (5, 61, 1)}


def test_grow_is_depth_first_and_complete():
    context = np.array([[1] * 6, [2, 2, 2, 3, 3, 0], [4, 4, 5, 0, 6, 0], [7, 7, 0, 0, 0, 0]], np.uint64)
    got = list(phrases.grow((1,), np.arange(6), context, np.ones(6, np.int64), 2))
    assert got == [((1, 2), 3), ((1, 2, 4), 2), ((1, 2, 4, 7), 2), ((1, 3), 2)]
