"""The registered queries of the corpus operators against their SQL, or against plain recomputation."""

import re
import zlib

import duckdb
import pytest

from almoneda.llm import registry
from tests.test_entry import TABLES, plain

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, D), duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)


def test_main_text_query(spark):
    got = registry.QUERIES["op1_main_text"](spark, D).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in got)
    assert all(re.search(r"<article>", pages[r.page_id].html) and r.text for r in got)


def test_decontamination_query(spark):
    from almoneda.llm.decontaminate import myers, normalize

    items = {r.item_id: normalize(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    texts = {r.doc_id: normalize(r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.QUERIES["op4_decontaminate"](spark, D).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        if len(t) > 4000:
            continue
        want = {i: f[0] for i, x in items.items() if (f := myers(x, t, int(0.1 * len(x))))}
        r = got[d]
        assert (r.n_items, set(r.item_ids), r.least_distance, r.kept) == (len(want), set(want), min(want.values(), default=None), not want)


def test_toxicity_query(spark):
    got = registry.QUERIES["op7_toxicity"](spark, D).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_sharding_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = registry.QUERIES["op9_shard_rows"](spark, D).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in docs.items()} and len(got) == len(docs)
    shards = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
