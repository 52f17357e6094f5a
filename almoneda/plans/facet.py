"""Queries of facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda import facets as A
from almoneda.bitmaps import BitmapFacets
from almoneda.hierarchy import nuts_rollup
from almoneda.plans.registry import query
from almoneda.plans.scalar import _BUCKET
from almoneda.plans.testbind import contracts, table, versions, with_contracts
from almoneda.plans.testbind import VERSIONS
from almoneda.spec import FilterSpec
from almoneda.store import workspace

_SPEC = FilterSpec(cpv=("1", "2"), nuts=("ES1", "ES2", "ES3"), status=("O", "F"), result=("A", "N"), contract_type=("BUILDING", "MACHINERY", "HOUSEHOLD"), procedure=("1", "2", "3"), pub_from="1995-06-01", budget_min=1000.0)
_TESTS = {
    "cpv": "len(list_filter(coalesce(cpv, []), lambda c: starts_with(c, '1') OR starts_with(c, '2'))) > 0", "nuts": "(starts_with(nuts, 'ES1') OR starts_with(nuts, 'ES2') OR starts_with(nuts, 'ES3'))", "status": "status_code IN ('O', 'F')", "result": "result_code IN ('A', 'N')",
    "contract_type": "contract_type_code IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')", "procedure": "procedure_code IN ('1', '2', '3')", "dates": "publication_ts >= TIMESTAMP '1995-06-01'", "budget": "budget_amount >= 1000",
}
_PARTS = ("customer", "nuts", "result", "cpv")


def _where(*without: str) -> str:
    return " AND ".join(v for k, v in _TESTS.items() if k not in without)


def _facet(name: str, dimension: str) -> None:
    c = A.DIMENSIONS[dimension]
    query(name, with_contracts(f"SELECT {c} AS value, count(*) AS n FROM contracts WHERE {_where(dimension)} AND {c} <> '' GROUP BY 1"))(lambda spark, d: A.count_by(contracts(spark, d, *_PARTS), _SPEC, dimension))


for _name, _dimension in (("facet_status", "status"), ("facet_result", "result"), ("facet_type", "contract_type"), ("facet_procedure", "procedure"), ("facet_nuts", "nuts")):
    _facet(_name, _dimension)


@query("facet_total", with_contracts(f"SELECT count(*) AS total FROM contracts WHERE {_where()}"))
def _(spark, d):
    return _SPEC.apply(contracts(spark, d, *_PARTS)).agg(F.count("*").alias("total"))


@query("facet_totals_loo", with_contracts("SELECT " + ", ".join(f"count(*) FILTER ({_where(*k)}) AS {n}" for n, k in [("total", ()), *[(f"t_{x}", (x,)) for x in _TESTS]]) + " FROM contracts"))
def _(spark, d):
    return A.totals(contracts(spark, d, *_PARTS), _SPEC)


@query("facet_budget_hist", with_contracts(f"SELECT 'b' || lpad(CAST(i AS VARCHAR), 2, '0') AS bucket, coalesce(n, 0) AS n FROM range(15) r(i) LEFT JOIN (SELECT {_BUCKET.format(a='budget_amount')} AS b, count(*) AS n FROM contracts WHERE {_where('budget')} GROUP BY 1) ON b = 'b' || lpad(CAST(i AS VARCHAR), 2, '0')"))
def _(spark, d):
    return A.budget_histogram(contracts(spark, d, *_PARTS), _SPEC)


@query("facet_pub_months", with_contracts(f"SELECT strftime(publication_ts, '%Y-%m') AS month, count(*) AS n FROM contracts WHERE {_where('dates')} GROUP BY 1 ORDER BY 1 DESC LIMIT 36"))
def _(spark, d):
    return A.month_histogram(contracts(spark, d, *_PARTS), _SPEC)


@query("facet_deadline_months", with_contracts(f"SELECT strftime(deadline_ts, '%Y-%m') AS month, count(*) AS n FROM contracts WHERE {_where('dates')} GROUP BY 1 ORDER BY 1 DESC LIMIT 36"))
def _(spark, d):
    return A.month_histogram(contracts(spark, d, *_PARTS), _SPEC, "deadline_ts")


@query("facet_months_36", with_contracts("SELECT strftime(publication_ts, '%Y-%m') AS month, count(*) AS n FROM contracts GROUP BY 1 ORDER BY 1 DESC LIMIT 36"))
def _(spark, d):
    return A.month_histogram(contracts(spark, d), FilterSpec())


_NODES = ["11000000", "45000000", "11001000", "02000000", "99999999"]


@query("facet_cpv_nodes", with_contracts(f"""SELECT code, (SELECT count(*) FROM contracts WHERE {_where('cpv')} AND len(list_filter(coalesce(cpv, []), lambda c: starts_with(c, substr(code, 1, CAST(greatest(length(rtrim(code, '0')), 2) AS INTEGER))))) > 0) AS n
FROM (SELECT unnest({_NODES}) AS code)"""))
def _(spark, d):
    return A.cpv_nodes(contracts(spark, d, *_PARTS), _SPEC, _NODES)


@query("range_bucket_counts", with_contracts("""SELECT bucket, (SELECT count(*) FROM contracts WHERE budget_amount >= low AND (high IS NULL OR budget_amount <= high)) AS n FROM (
SELECT 'b' || lpad(CAST(i AS VARCHAR), 2, '0') AS bucket, CASE WHEN i = 0 THEN 0.0 ELSE exp(ln(1000.0) + i * (ln(1e8) - ln(1000.0)) / 15) END AS low, CASE WHEN i < 14 THEN exp(ln(1000.0) + (i + 1) * (ln(1e8) - ln(1000.0)) / 15) END AS high FROM range(15) r(i))"""))
def _(spark, d):
    return A.range_counts(contracts(spark, d), A.budget_edges(spark), "budget_amount")


@query("nuts_rollup", with_contracts("SELECT substr(nuts, 1, 4) AS nuts, count(*) AS n FROM contracts WHERE nuts IS NOT NULL GROUP BY 1"))
def _(spark, d):
    counts = contracts(spark, d, "nuts").filter("nuts IS NOT NULL").groupBy("nuts").agg(F.count("*").alias("n"))
    return nuts_rollup(counts, 2)


@query("facet_grouped", with_contracts("""SELECT grp, sum(n)::BIGINT AS n FROM (VALUES ('abierto', ['1']), ('abierto_s', ['9']), ('restr', ['2']), ('negoc', ['3', '4', '5', '10', '11', '13']), ('deriv', ['7', '12']), ('menor', ['6']), ('otros', ['8', '100', '999'])) g(grp, codes)
LEFT JOIN (SELECT procedure_code, count(*) AS n FROM contracts GROUP BY 1) ON list_contains(codes, procedure_code) GROUP BY grp"""))
def _(spark, d):
    return A.grouped(A.count_by(contracts(spark, d), FilterSpec(), "procedure"), "procedure")


@query("category_watermark", f"WITH {VERSIONS} SELECT category, max(updated) AS watermark FROM versions GROUP BY category")
def _(spark, d):
    from almoneda.ingest import watermarks

    return watermarks(versions(spark, d))


#: Bounds that cut a month and a power of two, on both sides.
_CUT = FilterSpec(cpv=("1", "2"), nuts=("ES1", "ES2", "ES3"), status=("O", "F"), pub_from="1994-02-11", pub_to="1997-10-19", deadline_to="1997-09-30", budget_min=1234.5, budget_max=3e6)
_CUT_TESTS = {k: _TESTS[k] for k in ("cpv", "nuts", "status")} | {
    "dates": "publication_ts >= TIMESTAMP '1994-02-11' AND publication_ts <= TIMESTAMP '1997-10-19 23:59:59' AND deadline_ts <= TIMESTAMP '1997-09-30 23:59:59'", "budget": "budget_amount BETWEEN 1234.5 AND 3e6",
}


def _cut(*without: str) -> str:
    return " AND ".join(v for k, v in _CUT_TESTS.items() if k not in without)


def _bitmaps(spark, d):
    return BitmapFacets(spark, workspace(spark, "bitmaps")).build(contracts(spark, d, *_PARTS))


@query("bitmap_totals", with_contracts("SELECT " + ", ".join(f"count(*) FILTER ({_cut(*k)}) AS {n}" for n, k in [("total", ()), *[(f"t_{x}", (x,)) for x in _TESTS]]) + " FROM contracts"))
def _(spark, d):
    """All leave-one-out totals by AND over bitmaps; the contracts are read when the bitmaps are built."""
    return _bitmaps(spark, d).totals(_CUT)


@query("bitmap_facet_nuts", with_contracts(f"SELECT nuts AS value, count(*) AS n FROM contracts WHERE {_cut('nuts')} AND nuts <> '' GROUP BY 1"))
def _(spark, d):
    return _bitmaps(spark, d).count_by(_CUT, "nuts")


@query("bitmap_facet_result", with_contracts(f"SELECT result_code AS value, count(*) AS n FROM contracts WHERE {_cut()} AND result_code <> '' GROUP BY 1"))
def _(spark, d):
    return _bitmaps(spark, d).count_by(_CUT, "result")


@query("bitmap_cpv_nodes", with_contracts(f"""SELECT code, (SELECT count(*) FROM contracts WHERE {_cut('cpv')} AND len(list_filter(coalesce(cpv, []), lambda c: starts_with(c, substr(code, 1, CAST(greatest(length(rtrim(code, '0')), 2) AS INTEGER))))) > 0) AS n
FROM (SELECT unnest({_NODES}) AS code)"""))
def _(spark, d):
    return _bitmaps(spark, d).nodes(_CUT, _NODES)
