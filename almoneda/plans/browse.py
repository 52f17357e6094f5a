"""Queries of filters, sorting and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda.plans.registry import query
from almoneda.plans.testbind import contracts, table, with_contracts
from almoneda.spec import FilterSpec, browse, cpv_node

_SPEC = FilterSpec(status=("O", "F"), nuts=("ES1", "ES2"), pub_from="1996-01-01", pub_to="1999-12-31", budget_min=1000.0)
_WHERE = "status_code IN ('O', 'F') AND (starts_with(nuts, 'ES1') OR starts_with(nuts, 'ES2')) AND publication_ts >= TIMESTAMP '1996-01-01' AND publication_ts <= TIMESTAMP '1999-12-31 23:59:59' AND budget_amount >= 1000"


def _filter(name: str, spec: FilterSpec, where: str, *parts: str) -> None:
    query(name, with_contracts(f"SELECT sid FROM contracts WHERE {where}"))(lambda spark, d: spec.apply(contracts(spark, d, *parts)).select("sid"))


_filter("filter_cpv_prefix", FilterSpec(cpv=("11", "45")), "len(list_filter(coalesce(cpv, []), lambda c: starts_with(c, '11') OR starts_with(c, '45'))) > 0", "cpv")
_filter("filter_nuts_prefix", FilterSpec(nuts=("ES1", "ES30")), "starts_with(nuts, 'ES1') OR starts_with(nuts, 'ES30')", "nuts")
_filter("filter_status_in", FilterSpec(status=("O",), contract_type=("BUILDING", "MACHINERY"), procedure=("1", "2"), result=("A",)), "status_code = 'O' AND contract_type_code IN ('BUILDING', 'MACHINERY') AND procedure_code IN ('1', '2') AND result_code = 'A'", "customer", "result")
_filter("filter_pub_range", FilterSpec(pub_from="1996-03-01", pub_to="1997-02-28"), "publication_ts >= TIMESTAMP '1996-03-01' AND publication_ts <= TIMESTAMP '1997-02-28 23:59:59'")
_filter("filter_deadline_range", FilterSpec(deadline_from="1996-03-01", deadline_to="1997-02-28"), "deadline_ts >= TIMESTAMP '1996-03-01' AND deadline_ts <= TIMESTAMP '1997-02-28 23:59:59'")
_filter("filter_budget_range", FilterSpec(budget_min=0.0, budget_max=100000.0), "budget_amount >= 0 AND budget_amount <= 100000")
_filter("filter_combined", _SPEC, _WHERE, "nuts")


@query("filter_cpv_node", with_contracts("SELECT sid FROM contracts WHERE len(list_filter(coalesce(cpv, []), lambda c: starts_with(c, '11'))) > 0"))
def _(spark, d):
    return contracts(spark, d, "cpv").filter(cpv_node("11000000")).select("sid")


@query("filter_portal_url", "SELECT page_id FROM pages WHERE contains(url, 'example.com/en')")
def _(spark, d):
    return table(spark, d, "pages").filter(F.contains("url", F.lit("example.com/en"))).select("page_id")


@query("browse_guard", "SELECT CAST(NULL AS VARCHAR) AS sid WHERE false")
def _(spark, d):
    from almoneda.search import search

    return search(contracts(spark, d), FilterSpec(), q=None).select("sid")


@query("browse_sorted", with_contracts(f"SELECT sid, budget_amount FROM contracts WHERE {_WHERE} ORDER BY budget_amount, sid LIMIT 50"))
def _(spark, d):
    return browse(contracts(spark, d, "nuts"), _SPEC, "budget_amount asc", k=50).select("sid", "budget_amount")


@query("browse_page", with_contracts(f"SELECT sid, status_code, nuts, publication_ts, budget_amount FROM contracts WHERE {_WHERE} ORDER BY publication_ts DESC NULLS LAST, sid LIMIT 15 OFFSET 15"))
def _(spark, d):
    return browse(contracts(spark, d, "nuts"), _SPEC, "DROP TABLE desc", k=15, offset=15).select("sid", "status_code", "nuts", "publication_ts", "budget_amount")


@query("browse_total", with_contracts(f"SELECT count(*) AS total FROM contracts WHERE {_WHERE}"))
def _(spark, d):
    return _SPEC.apply(contracts(spark, d, "nuts")).agg(F.count("*").alias("total"))


@query("search_projection", with_contracts("SELECT sid, 'Contrato ' || sid AS title, status_code, result_code, contract_type_code, procedure_code, budget_amount, nuts, publication_ts, deadline_ts FROM contracts"))
def _(spark, d):
    c = contracts(spark, d, "customer", "nuts", "result")
    return c.select("sid", F.concat(F.lit("Contrato "), "sid").alias("title"), "status_code", "result_code", "contract_type_code", "procedure_code", "budget_amount", "nuts", "publication_ts", "deadline_ts")


@query("point_lookup", with_contracts("SELECT sid, status_code, budget_amount FROM contracts WHERE sid = '42'"))
def _(spark, d):
    return contracts(spark, d).filter(F.col("o_orderkey") == 42).select("sid", "status_code", "budget_amount").limit(1)


@query("browse_keyset", with_contracts(f"""SELECT * FROM (SELECT sid, budget_amount, CAST((row_number() OVER (ORDER BY budget_amount DESC NULLS LAST, sid) - 1) // 40 AS INTEGER) AS page FROM contracts WHERE {_WHERE}) WHERE page < 4"""))
def _(spark, d):
    """Four pages, each by the cursor of the one before it, as one sort would give them."""
    from almoneda.spec import cursor, keyset_page

    sort, after, pages = [("budget_amount", "desc"), ("sid", "asc")], None, []
    found = _SPEC.apply(contracts(spark, d, "nuts")).select("sid", "budget_amount")
    for n in range(4):
        page = keyset_page(found, sort, after, 40)
        pages.append(page.withColumn("page", F.lit(n)))
        after = cursor(page.collect(), sort)  # 40 rows
        if after is None:
            break
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


@query("duplicate_keys", "SELECT CAST(l_orderkey AS VARCHAR) AS sid, CAST(l_linenumber AS VARCHAR) AS lot_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    """What a uniqueness constraint on (contract, lot) would reject."""
    from almoneda.plans.testbind import table
    from almoneda.store import duplicate_keys

    lots = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("sid"), F.col("l_linenumber").cast("string").alias("lot_id"))
    return duplicate_keys(lots, "sid", "lot_id")


_STATE = {"status": ["O", "F"], "nuts": ["ES1", "ES2"], "cpv": [], "result": "", "budget_min": 1000.0, "budget_max": None, "open_only": True}
_STATE_SQL = {"status": "status_code IN ('O', 'F')", "nuts": "(starts_with(nuts, 'ES1') OR starts_with(nuts, 'ES2'))", "deadline": "deadline_ts >= TIMESTAMP '1996-01-01'", "budget": "budget_amount >= 1000"}


def _state_sql(**other: str | None) -> str:
    return " AND ".join(v for v in (_STATE_SQL | other).values() if v)


@query("filter_state", with_contracts(f"SELECT sid, status_code, deadline_ts FROM contracts WHERE {_state_sql()}"))
def _(spark, d):
    """A state of the filter form: empty values go, and `open_only` means deadlines from today on."""
    return FilterSpec.from_params(_STATE, "1996-01-01").apply(contracts(spark, d, "nuts")).select("sid", "status_code", "deadline_ts")


@query("filter_text", with_contracts(f"SELECT sid, status_code, deadline_ts FROM contracts WHERE {_state_sql()}"))
def _(spark, d):
    """The same filters by their text."""
    return contracts(spark, d, "nuts").filter(FilterSpec.from_params(_STATE, "1996-01-01").to_text()).select("sid", "status_code", "deadline_ts")


_REMOVED = [("nuts", "ES1", {"nuts": "starts_with(nuts, 'ES2')"}), ("nuts", "ES2", {"nuts": "starts_with(nuts, 'ES1')"}), ("status", "O", {"status": "status_code = 'F'"}), ("status", "F", {"status": "status_code = 'O'"}), ("deadline_from", "1996-01-01", {"deadline": None}), ("budget_min", "1000.0", {"budget": None})]


@query("active_filters", with_contracts(" UNION ALL ".join(f"SELECT '{k}' AS field, '{v}' AS value, count(*) AS n FROM contracts WHERE {_state_sql(**x)}" for k, v, x in _REMOVED)))
def _(spark, d):
    """The filter values in force, each with the total once it is removed."""
    from almoneda.facets import without_each

    return without_each(contracts(spark, d, "nuts"), FilterSpec.from_params(_STATE, "1996-01-01"))


@query("filter_query_string", with_contracts("""SELECT sid, array_to_string(list_concat(CASE WHEN status_code <> '' THEN ['status=' || url_encode(status_code)] ELSE [] END, CASE WHEN contracting_authority <> '' THEN ['q=' || url_encode('~* ' || contracting_authority)] ELSE [] END,
list_transform(coalesce(cpv, []), lambda c: 'cpv=' || url_encode(c)), CASE WHEN nuts <> '' THEN ['nuts=' || url_encode(nuts)] ELSE [] END), '&') AS qs FROM contracts"""))
def _(spark, d):
    """Of each contract the link to a search for its like: empty parameters left out, lists repeated."""
    from almoneda.functions.scalar import query_strings

    c = contracts(spark, d, "customer", "nuts", "cpv")
    return c.select("sid", query_strings({"status": F.array("status_code"), "q": F.array(F.concat(F.lit("~* "), "contracting_authority")), "cpv": F.col("cpv"), "nuts": F.array("nuts")}).alias("qs"))


@query("group_toggled", with_contracts("SELECT 'on' AS step, count(*) AS n FROM contracts WHERE procedure_code IN ('1', '2', '3', '4', '5', '10', '11', '13') UNION ALL SELECT 'off', count(*) FROM contracts WHERE procedure_code IN ('1', '2')"))
def _(spark, d):
    """A group of codes that is chosen in part is switched on as a whole, then off; the filter follows."""
    from almoneda.facets import GROUPS, group_toggle

    codes = GROUPS["procedure"]["negoc"]
    on = group_toggle(codes, ("1", "2", "3"))
    c = contracts(spark, d)
    total = lambda step, chosen: FilterSpec(procedure=chosen).apply(c).agg(F.lit(step).alias("step"), F.count("*").alias("n"))
    return total("on", on).unionByName(total("off", group_toggle(codes, on)))


@query("load_more", with_contracts(f"SELECT page, count(*) AS shown, count(*) + page * 500 < max(total) AS more FROM (SELECT CAST((row_number() OVER (ORDER BY sid) - 1) // 500 AS INTEGER) AS page, count(*) OVER () AS total FROM contracts WHERE {_WHERE}) GROUP BY page"))
def _(spark, d):
    """(page, shown, more) of all pages of 500: how many rows each shows, and whether another follows."""
    from almoneda.spec import pages

    return pages(_SPEC.apply(contracts(spark, d, "nuts")), 500)
