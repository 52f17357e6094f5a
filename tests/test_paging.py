"""Pages by cursor against one sort."""

import random

import pytest
from pyspark.sql import functions as F

from almoneda.spec import cursor, keyset_page


@pytest.mark.parametrize("ways", [("asc", "asc", "asc"), ("desc", "asc", "asc"), ("desc", "desc", "asc")])
def test_all_pages_joined_equal_one_sort(spark, ways):
    """Ties and nulls in every column but the last."""
    rng = random.Random(str(ways))
    rows = [(rng.choice([None, 1.0, 2.0, 2.5]), rng.choice([None, "x", "y"]), f"s{i:02d}") for i in range(47)]
    df = spark.createDataFrame(rows, "a double, b string, sid string").repartition(3)
    sort = list(zip(("a", "b", "sid"), ways))
    order = [F.col(c).asc_nulls_last() if w == "asc" else F.col(c).desc_nulls_last() for c, w in sort]
    got, after = [], None
    while page := keyset_page(df, sort, after, 10).collect():
        got += page
        after = cursor(page, sort)
    assert got == df.orderBy(*order).collect() and len(got) == 47


def test_the_cursor_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id budget", "cast(id as string) sid").write.parquet(str(tmp_path / "t"))
    page = keyset_page(spark.read.parquet(str(tmp_path / "t")), [("budget", "desc"), ("sid", "asc")], (500, "500"), 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(budget,500)" in plan and [r.budget for r in page.collect()] == [499, 498, 497, 496, 495]
