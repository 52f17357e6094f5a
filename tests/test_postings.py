"""The block-max index against a pass over all documents."""

import random

import pytest

from almoneda.postings import Index
from almoneda.search import bm25, top


def pages(df):
    return [(r.doc_id, round(r.score, 8)) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = ["a"] * 60 + ["b"] * 25 + ["c"] * 10 + ["d"] * 3 + ["e"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 40, 200])))) for i in range(1500)] + [(1500, None), (1501, ""), (1502, "f " * 500), (1503, "f")]
    rows += [(2000 + i, " ".join(["g" if j < (9 if i % 50 == 0 else 1) else "h" for j in range(20 + i % 9)])) for i in range(500)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return Index(spark, str(tmp_path_factory.mktemp("i") / "x"), range_docs=8, first_ranges=4).build(docs)


@pytest.mark.parametrize("terms", [["e"], ["d", "e"], ["a", "e"], ["a", "b"], ["f"], ["g"], ["E", "e", "nothing"], ["nothing"], []])
@pytest.mark.parametrize("k", [1, 20])
def test_best_equal_the_full_scan(docs, index, terms, k):
    want = pages(top(bm25(docs, terms), "doc_id", k)) if terms else []
    assert pages(index.top(terms, k)) == want


def test_fewer_blocks_are_read(index):
    """Ten of 500 documents hold a word often: the blocks of the others can't reach their scores."""
    index.top(["g"], 5)
    assert 0 < index.blocks_read < 0.5 * index.blocks
    index.top(["d", "e"], 5)
    assert 0 < index.blocks_read < index.blocks


def test_only_allowed_documents(spark, docs, index):
    some = docs.filter("doc_id % 7 = 3").select("doc_id")
    assert pages(index.top(["d", "b"], 20, some)) == pages(top(bm25(docs, ["d", "b"], some), "doc_id", 20))


def test_added_documents_change_all_scores(spark, docs, tmp_path):
    index = Index(spark, str(tmp_path / "x"), range_docs=16, most_segments=2, first_ranges=2).build(docs.filter("doc_id % 4 = 0"))
    for i in (1, 2, 3):
        index.add(docs.filter(f"doc_id % 4 = {i}"))
        held = docs.filter(f"doc_id % 4 <= {i}")
        assert pages(index.top(["b", "e"], 20)) == pages(top(bm25(held, ["b", "e"]), "doc_id", 20))
    assert len(index.segments()) == 2 and sum(s[1] for s in index.segments()) == docs.count()
    with pytest.raises(ValueError):
        index.add(docs.filter("doc_id = 9"))


def test_empty_index(spark, docs, tmp_path):
    assert Index(spark, str(tmp_path / "none")).top(["a"], 5).collect() == []
    index = Index(spark, str(tmp_path / "x")).build(docs.limit(0))
    assert index.top(["a"], 5).collect() == [] and index.bm25(["a"]).collect() == []
    assert pages(index.add(docs).top(["e"], 5)) == pages(top(bm25(docs, ["e"]), "doc_id", 5))
