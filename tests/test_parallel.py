"""Steps that Python or one task would hold up: dealt to tasks, or left to Spark's own aggregates."""

import glob

from pyspark.sql import functions as F

from almoneda.plans import sources
from almoneda.streaming.latest import VERSION, fold, latest_wins
from tests.test_streaming import made

D = "/root/testdata/sf0.01"


def test_tender_pages_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(sources, "TASK_PAGES", 200)
    pages = sources.tender_page(spark, D)
    n = spark.read.parquet(f"{D}/part.parquet").count()
    assert pages.count() == n
    counts = [r[0] for r in pages.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert len(counts) == -(-n // 200) and max(counts) <= 2 * 200


def test_a_page_is_walked_once_for_all_labels():
    from almoneda.sources import html

    builder = html._Builder()
    builder.feed("<div>" * 3 + "<p>a<br>b</p></div><ul><li>x</ul></i></div><h4>z</h4>")
    root = builder.root
    every = [root, *root.walk()]

    def within(x):
        return [z for y in x.items if isinstance(y, html.Element) for z in (y, *within(y))]

    assert [x.tag for x in every[1:]] == ["div", "div", "div", "p", "br", "ul", "li", "h4"]
    for x in every:
        assert list(x.walk()) == within(x)
        for tag in ("div", "p", "br", "li", "h4", "none"):
            assert x.tagged(tag) == [y for y in within(x) if y.tag == tag]


def test_latest_state_is_kept_by_aggregates_of_spark(spark):
    versions = spark.createDataFrame(made(5), VERSION)
    found = latest_wins(versions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
    columns = ["sid", "updated", "status_code", "pos", "payload", "history"]
    assert sorted(map(tuple, found.filter("NOT tombstone").select(*columns).collect())) == sorted(map(tuple, fold(versions).select(*columns).collect()))


def test_landed_files_of_the_daily_stream_are_bounded(spark, monkeypatch):
    paths, real = [], sources.workspace
    monkeypatch.setattr(sources, "workspace", lambda s, tag: paths.append(real(s, tag)) or paths[-1])
    monkeypatch.setattr(sources, "LANDED_ROWS", 2_000)
    from almoneda.plans.registry import QUERIES

    assert QUERIES["stream_daily"](spark, D).count()
    landed = next(p for p in paths if "/landing-" in p)
    assert len(glob.glob(f"{landed}/part-*")) == -(-spark.read.parquet(f"{D}/events.parquet").count() // 2_000)
