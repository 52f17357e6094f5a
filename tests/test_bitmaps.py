"""Bitmap facets and the substring index against scans."""

import random
from dataclasses import replace

import pytest

from almoneda import facets
from almoneda.bitmaps import BitmapFacets
from almoneda.hierarchy import cpv_typeahead
from almoneda.spec import FilterSpec
from almoneda.substring import Typeahead

SPEC = FilterSpec(cpv=("45", "0311"), nuts=("ES5", "ES61"), status=("A", "B"), result=("1", "9"), contract_type=("2",), procedure=("1", "3"), pub_from="2020-02-03", pub_to="2021-07-15", deadline_from="2020-06-01", budget_min=0, budget_max=5000.5)


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    rng = random.Random(3)
    pick = lambda *x: rng.choice([*x, None])
    day = lambda: pick(*[f"20{y}-{m:02d}-{d:02d} {h}" for y in (20, 21) for m in (1, 2, 6, 7, 12) for d in (1, 3, 15, 28) for h in ("00:00:00", "23:59:59", "23:59:59.5")])
    rows = [
        (f"s{i}", pick([], ["45000000"], ["45000000", "45200000"], ["03110000", "03110000", None], ["09000000", ""]), pick("ES511", "ES61", "ES6", "", "FR1"), pick("A", "B", "C", ""), pick("1", "9", "2"), pick("2", "3"), pick("1", "3"), day(), day(), pick(0.0, -5.0, 0.75, 1.0, 4096.0, 5000.5, 5000.6, 1e9))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "sid string, cpv array<string>, nuts string, status_code string, result_code string, contract_type_code string, procedure_code string, publication_ts string, deadline_ts string, budget_amount double")
    df = df.withColumns({c: df[c].cast("timestamp") for c in ("publication_ts", "deadline_ts")}).repartition(3).cache()
    return df, BitmapFacets(spark, str(tmp_path_factory.mktemp("b") / "x"), block_rows=300).build(df)


@pytest.mark.parametrize("spec", [SPEC, FilterSpec(), replace(SPEC, cpv=(), nuts=(), result=()), FilterSpec(budget_min=4096.0), FilterSpec(budget_max=-5.0), FilterSpec(status=("none",)), FilterSpec(pub_to="2020-02-03")])
def test_totals_equal_the_scan(held, spec):
    df, maps = held
    assert maps.totals(spec).first().asDict() == facets.totals(df, spec).first().asDict()


@pytest.mark.parametrize("dimension", ["nuts", "status", "result", "contract_type"])
def test_counts_equal_the_scan(held, dimension):
    df, maps = held
    spec = replace(SPEC, result=(), procedure=(), contract_type=())
    assert {tuple(r) for r in maps.count_by(spec, dimension).collect()} == {tuple(r) for r in facets.count_by(df, spec, dimension).collect()}


def test_nodes_equal_the_scan(held):
    df, maps = held
    spec, codes = replace(SPEC, result=(), procedure=(), contract_type=()), ["45000000", "03000000", "45200000", "99000000"]
    assert {tuple(r) for r in maps.nodes(spec, codes).collect()} == {tuple(r) for r in facets.cpv_nodes(df, spec, codes).collect()}


def test_no_contracts(spark, held, tmp_path):
    maps = BitmapFacets(spark, str(tmp_path / "x")).build(held[0].limit(0))
    assert set(maps.totals(SPEC).first()) == {0} and maps.count_by(SPEC, "nuts").collect() == []


@pytest.mark.parametrize("terms", [["45"], ["obra"], ["OBRA", "03"], ["ñ", "z"], ["de"], ["ión de"], ["zzzz", "100%_"], [], ["a b"]])
def test_typeahead_equals_the_scan(spark, tmp_path_factory, terms):
    codes = spark.createDataFrame([("45000000", "Obras de construcción"), ("45200000", "Obra; a b"), ("03000000", "Agua"), ("03110000", None), ("09000000", ""), ("14000000", "Construcción de 100%_puentes"), ("15000000", "ab")], "code string, label string")
    index = Typeahead(spark, str(tmp_path_factory.mktemp("t") / "x")).build(codes)
    for most in (40, 1):
        assert [tuple(r) for r in index.search(terms, most).collect()] == [tuple(r) for r in cpv_typeahead(codes, terms, most).collect()]


def test_rare_codes_take_a_row_each(spark, held, tmp_path):
    from pyspark.sql import functions as F

    df = held[0].withColumn("cpv", F.array(F.lpad(F.substring("sid", 2, 9), 8, "1"), F.lit("45000000")))
    maps = BitmapFacets(spark, str(tmp_path / "x"), block_rows=300).build(df)
    bitmaps = spark.read.parquet(f"{tmp_path}/x/maps")
    assert bitmaps.count() <= bitmaps.select("block").distinct().count() * bitmaps.select("dimension", "value").distinct().count() < 3000
    assert spark.read.parquet(f"{tmp_path}/x/codes").count() == 6000
    spec = FilterSpec(cpv=("11",), status=("A",))
    assert {tuple(r) for r in maps.count_by(spec, "cpv").collect()} == {(v, n) for v, n in df.filter("status_code = 'A'").select(F.explode("cpv").alias("v")).groupBy("v").count().collect()}
    assert maps.totals(spec).first().asDict() == facets.totals(df, spec).first().asDict()
