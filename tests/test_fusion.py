"""Pages of two rankings against a full sort."""

import random

import pytest

from almoneda import search
from almoneda.spec import FilterSpec


def full(kw, vec, alpha):
    def scaled(r):
        lo, hi = min(r.values(), default=0), max(r.values(), default=0)
        return {k: (v - lo) / (hi - lo) if hi > lo else 1.0 for k, v in r.items()}

    a, b = scaled(kw), scaled(vec)
    return sorted(((round(alpha * b.get(k, 0.0) + (1 - alpha) * a.get(k, 0.0), 9), k) for k in a.keys() | b.keys()), key=lambda x: (-x[0], x[1]))


def df(spark, r):
    return spark.createDataFrame(list(r.items()), "id long, score double").coalesce(2)


@pytest.mark.parametrize("seed,alpha,levels", [(1, 0.5, 1000), (2, 0.2, 4), (3, 1.0, 1000)])
def test_any_page_equals_the_full_sort(spark, seed, alpha, levels):
    """Ids in one ranking alone, and with four levels of score ties everywhere."""
    rng = random.Random(seed)
    kw = {k: float(rng.randint(1, levels)) for k in range(300) if rng.random() < 0.7}
    vec = {k: float(rng.randint(1, levels)) for k in range(300) if rng.random() < 0.8}
    want = full(kw, vec, alpha)
    for k, offset in ((15, 0), (15, 90), (15, 225), (20, len(want) - 5), (5, 1000)):
        for depth in (4, 100):
            got = [(round(r.score, 9), r.id) for r in search.fused_page(df(spark, kw), df(spark, vec), k, offset, alpha, depth).collect()]
            assert got == want[offset : offset + k], (k, offset, depth)


def test_rankings_are_read_no_further_than_needed(spark, monkeypatch):
    kw, vec = ({k: 1000.0 - k for k in range(1000)} for _ in range(2))
    tags, real = [], search.written
    monkeypatch.setattr(search, "written", lambda d, tag: tags.append(tag) or real(d, tag))
    got = search.fused_page(df(spark, kw), df(spark, vec), 5, 0, depth=10)
    assert [r.id for r in got.collect()] == [0, 1, 2, 3, 4] and tags == ["ranking", "ranking", "head", "head", "fused"]


def test_empty_and_equal_rankings(spark):
    some, none = df(spark, {1: 2.0, 2: 2.0}), df(spark, {}).limit(0)
    assert [(r.id, r.score) for r in search.fused_page(some, none, 5).collect()] == [(1, 0.5), (2, 0.5)] and search.fused_page(none, none, 5).collect() == []


def test_search_has_pages_beyond_the_first_hundred(spark):
    docs = spark.createDataFrame([(f"{i:03d}", "casa " * (i % 7 + 1) + f"w{i}", "A", [float(i % 11), 1.0]) for i in range(240)], "sid string, content string, status_code string, embedding array<double>")
    pages = [[r.sid for r in search.search(docs, FilterSpec(), "casa", "hybrid", 50, offset, vector=[1.0, 0.0]).collect()] for offset in range(0, 250, 50)]
    assert [len(p) for p in pages] == [50, 50, 50, 50, 40] and len({x for p in pages for x in p}) == 240
