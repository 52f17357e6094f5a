"""Language identification: features and training against plain recomputation, held-out accuracy, edge rows."""

import math
import zlib
from collections import Counter

import numpy as np

from almoneda.llm import langid, registry


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def plain_grams(text):
    """N-grams of 1 to 4 characters of each word between two spaces, except spaces alone."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    return Counter(g for w in words for n in langid.ORDERS for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]).strip())


def test_ngrams_are_those_of_each_word():
    texts = ["Ab cd", "", "12 ?", "été, naïf 日本語!", "a", " x  y ", "Zürich1b"]
    doc, at, n = langid.terms(*chunk(texts))
    for k, text in enumerate(texts):
        want = plain_grams(text)
        assert sorted(n[doc == k].tolist()) == sorted(want.values())  # no two of these share a bin
        alone = langid.terms(*chunk([text]))
        assert at[doc == k].tolist() == alone[1].tolist() and n[doc == k].tolist() == alone[2].tolist()


def test_values_are_tfidf_of_unit_length():
    texts = ["aab ab", "b", "", "ccc ddd ccc"]
    idf = np.random.default_rng(1).random(langid.DIMS) + 0.5
    doc, at, value = langid.weighted(*chunk(texts), idf)
    d2, a2, n2 = langid.terms(*chunk(texts))
    for k in (0, 1, 3):
        raw = [(1 + math.log(n)) * idf[a] for a, n in zip(a2[d2 == k], n2[d2 == k])]
        assert np.allclose(value[doc == k], np.array(raw) / math.sqrt(sum(x * x for x in raw)))


def test_leader_equals_the_published_update():
    """Coordinate by coordinate in plain floats, as the algorithm is written down."""
    rng, dims, classes = np.random.default_rng(3), 12, 3
    leader = langid.Leader(dims, classes, 0.3, 1.0, 0.05, 0.7)
    z, n = [[0.0] * classes for _ in range(dims + 1)], [[0.0] * classes for _ in range(dims + 1)]

    def w(i, c):
        l1 = 0.0 if i == dims else 0.05
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((1.0 + math.sqrt(n[i][c])) / 0.3 + 0.7)

    for _ in range(60):
        at, label = np.sort(rng.choice(dims, 4, replace=False)), int(rng.integers(classes))
        value = rng.random(4)
        leader.learn(at, value, label)
        x = [*zip(at.tolist(), value.tolist()), (dims, 1.0)]
        scores = [sum(v * w(i, c) for i, v in x) for c in range(classes)]
        p = [math.exp(s) / sum(map(math.exp, scores)) for s in scores]
        for i, v in x:
            for c in range(classes):
                g, old = v * (p[c] - (c == label)), w(i, c)
                z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / 0.3 * old
                n[i][c] += g * g
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)
    assert np.allclose(leader.weights(np.arange(dims + 1)), [[w(i, c) for c in range(classes)] for i in range(dims + 1)])


def test_penalty_makes_weights_sparse():
    leader = langid.Leader(50, 2, l1=0.5)
    for i in range(200):
        leader.learn(np.array([i % 2, 2 + i % 48]), np.array([1.0, 0.05]), i % 2)
    w = leader.weights(np.arange(50))
    assert (w[:2] != 0).all() and (w[2:] == 0).all()


def test_temperature_finds_the_scale_of_the_logits():
    rng = np.random.default_rng(5)
    true = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(true)])
    for scale in (0.2, 1.0, 7.0):
        assert abs(langid.temperature(true * scale, labels) / scale - 1) < 0.1
    assert langid.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = registry.QUERIES["op12_language_id"](spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_edge_rows(spark):
    rows = [(str(i), "aaa bab aab", "x", 1) for i in range(40)] + [(str(i), "zzz yzy zzy", "ý", 1) for i in range(40, 80)]
    rows += [(None, "aba", None, 1), ("u", None, "x", 1), ("v", "", None, 1), ("w", "12 !?", "x", 1), ("1", "zzy " * 50_000, None, 1), ("1", "zzy", None, 1), ("1", "zzy", None, 1)]
    schema = "doc_id string, text string, lang string, id int"
    docs = spark.createDataFrame(rows, schema).withColumnRenamed("id", "place.h")
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by["u"] == by["v"] == by["w"] == [("und", 0.0)] and by[None][0][0] == "x" and sorted(x for x, _ in by["1"]) == ["x", "ý", "ý", "ý"]
    assert langid.languages(docs.limit(0)).collect() == []
    none = langid.languages(spark.createDataFrame([("1", "abc", None)], "doc_id string, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    one = langid.languages(spark.createDataFrame([("1", "abc", "q"), ("2", "abc", "q")], "doc_id string, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("q", 1.0)}


def test_sample_is_bounded_and_shared_out(spark):
    rows = [(i, "a" if i % 50 else "b", "t") for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)
    n = {r.lang: r["count"] for r in langid.bounded_sample(docs, 200).groupBy("lang").count().collect()}
    assert n == {"a": 100, "b": 60}


def test_document_frequencies_count_all_rows(spark):
    docs = spark.createDataFrame([("ab",), ("b b",), (None,), ("",)], "text string").repartition(2)
    df = langid.document_frequencies(docs)
    assert df[langid.DIMS] == 4 and df[: langid.DIMS].max() == 2 and df[: langid.DIMS].sum() == len(plain_grams("ab")) + len(plain_grams("b"))
