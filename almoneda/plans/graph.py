"""Queries of the award graph: line items as lots, suppliers as companies, customers as authorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda import graph as G
from almoneda.plans.registry import query
from almoneda.plans.testbind import cpv_code, table


def awards(spark, d):
    """Lots won. Every eleventh supplier has no number. seq orders the repeated (order, line) pairs."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    return li.select(
        F.col("l_orderkey").cast("string").alias("sid"), F.col("l_linenumber").cast("string").alias("lot_id"), F.when(F.col("l_suppkey") % 11 != 0, F.concat(F.when(F.col("l_suppkey") % 13 == 0, "U").otherwise("B"), F.col("l_suppkey").cast("string"))).alias("nif"),
        F.concat("s_name", F.when(F.col("l_quantity") > 25, " S.L.").otherwise("")).alias("name"), F.col("l_extendedprice").alias("amount"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("award_date"), "l_partkey",
        F.struct("l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"),
    )


_AWARDS = """awards AS (SELECT CAST(l_orderkey AS VARCHAR) AS sid, CAST(l_linenumber AS VARCHAR) AS lot_id, l_orderkey || ':' || l_linenumber AS lot_key, CASE WHEN l_suppkey % 11 <> 0 THEN (CASE WHEN l_suppkey % 13 = 0 THEN 'U' ELSE 'B' END) || l_suppkey END AS nif,
  s_name || CASE WHEN l_quantity > 25 THEN ' S.L.' ELSE '' END AS name, l_extendedprice AS amount, strftime(l_shipdate, '%Y-%m-%d') AS award_date, l_partkey, row_number() OVER (ORDER BY l_shipdate, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS seq
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
won AS (SELECT nif, lot_key, max_by(amount, seq) AS amount, max_by(award_date, seq) AS award_date, max_by(name, seq) AS name_display, upper(replace(regexp_replace(max_by(name, seq), '[^A-Za-z0-9]', ' ', 'g'), ' S L ', '')) AS name_norm FROM awards WHERE nif IS NOT NULL GROUP BY nif, lot_key),
lots AS (SELECT lot_key, max_by(sid, seq) AS sid, max_by(amount, seq) AS amount FROM awards WHERE nif IS NOT NULL GROUP BY lot_key),
classified AS (SELECT DISTINCT lot_key, lpad(CAST(p_size AS VARCHAR), 2, '0') AS cpv FROM awards JOIN part ON l_partkey = p_partkey WHERE nif IS NOT NULL),
tendered AS (SELECT CAST(o_orderkey AS VARCHAR) AS sid, CAST(o_custkey AS VARCHAR) AS authority FROM orders),
located AS (SELECT CAST(o_orderkey AS VARCHAR) AS sid, 'ES' || (c_nationkey % 10) || '0' AS nuts FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _sql(q: str) -> str:
    return f"WITH {_AWARDS}\n{q}"


def classified(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring(F.expr(cpv_code()), 1, 2).alias("cpv"))
    return awards(spark, d).filter("nif IS NOT NULL").join(p, "l_partkey").select(F.concat_ws(":", "sid", "lot_id").alias("lot_key"), "cpv").distinct()


def tendered(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sid"), F.col("o_custkey").cast("string").alias("authority"))


def located(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("ES"), F.pmod("c_nationkey", F.lit(10)).cast("string"), F.lit("0")).alias("nuts"))
    return table(spark, d, "orders").join(c, "o_custkey").select(F.col("o_orderkey").cast("string").alias("sid"), "nuts")


def contracts(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sid"), F.col("o_orderstatus").alias("status_code"))


@query("graph_contracts", _sql("SELECT CAST(o_orderkey AS VARCHAR) AS sid, o_orderstatus AS status_code FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT sid FROM awards WHERE nif IS NOT NULL)"))
def _(spark, d):
    return G.contract_nodes(contracts(spark, d), awards(spark, d))


@query("graph_companies", _sql("SELECT nif, bool_or(starts_with(nif, 'U')) AS is_ute FROM awards WHERE nif IS NOT NULL GROUP BY nif"))
def _(spark, d):
    return G.company_nodes(awards(spark, d))


@query("graph_lots", _sql("SELECT lot_key, sid, amount FROM lots"))
def _(spark, d):
    return G.lot_nodes(awards(spark, d))


@query("graph_won", _sql("SELECT nif, lot_key, amount, award_date, name_display FROM won"))
def _(spark, d):
    return G.won_edges(awards(spark, d)).drop("name_norm")


@query("graph_tendered", _sql("SELECT t.sid, authority FROM tendered t WHERE t.sid IN (SELECT sid FROM awards WHERE nif IS NOT NULL)"))
def _(spark, d):
    return tendered(spark, d).join(awards(spark, d).filter("nif IS NOT NULL").select("sid"), "sid", "left_semi").distinct()


@query("graph_classified", _sql("SELECT lot_key, cpv FROM classified"))
def _(spark, d):
    return classified(spark, d)


@query("graph_located", _sql("SELECT l.sid, nuts FROM located l WHERE l.sid IN (SELECT sid FROM awards WHERE nif IS NOT NULL)"))
def _(spark, d):
    return located(spark, d).join(awards(spark, d).filter("nif IS NOT NULL").select("sid"), "sid", "left_semi").distinct()


@query("graph_canonical_name", _sql("""SELECT nif, name FROM (SELECT nif, min(name_display) AS name, row_number() OVER (PARTITION BY nif ORDER BY count(*) DESC, base) AS r
  FROM (SELECT nif, name_display, replace(name_display, ' S.L.', '') AS base FROM won) GROUP BY nif, base) WHERE r = 1"""))
def _(spark, d):
    return G.canonical_names(G.won_edges(awards(spark, d)))


@query("graph_tombstones", _sql("""SELECT (SELECT count(DISTINCT sid) FROM awards WHERE nif IS NOT NULL AND CAST(sid AS BIGINT) % 7 <> 0) AS contracts, (SELECT count(*) FROM lots WHERE CAST(sid AS BIGINT) % 7 <> 0) AS lots,
  (SELECT count(*) FROM won JOIN lots USING (lot_key) WHERE CAST(sid AS BIGINT) % 7 <> 0) AS won, (SELECT count(DISTINCT nif) FROM awards WHERE nif IS NOT NULL) AS companies"""))
def _(spark, d):
    a = awards(spark, d)
    gone = contracts(spark, d).filter(F.col("sid").cast("long") % 7 == 0).select("sid")
    left = G.drop_contracts(gone, G.contract_nodes(contracts(spark, d), a), G.lot_nodes(a), G.won_edges(a))
    counts = [x.agg(F.count("*").alias(n)) for x, n in zip((*left, G.company_nodes(a)), ("contracts", "lots", "won", "companies"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])  # one row each


_MINE = "SELECT w.*, l.sid FROM won w JOIN lots l USING (lot_key) WHERE nif = 'B3'"
_COUNTS = "count(DISTINCT m.sid) AS n_contracts, count(DISTINCT m.lot_key) AS n_lots, count(DISTINCT cpv) AS n_cpv, count(DISTINCT authority) AS n_authorities"
_FAN = f"FROM ({_MINE}) m LEFT JOIN classified c ON c.lot_key = m.lot_key LEFT JOIN tendered t ON t.sid = m.sid"


@query("company_profile", _sql(f"SELECT {_COUNTS}, (SELECT round(sum(amount), 2) FROM ({_MINE})) AS total_amount {_FAN}"))
def _(spark, d):
    a = awards(spark, d)
    return G.company_profile("B3", G.won_edges(a), G.lot_nodes(a), classified(spark, d), tendered(spark, d))


@query("company_profile_fanout", _sql(f"SELECT {_COUNTS}, round(sum(m.amount), 2) AS total_amount {_FAN}"))
def _(spark, d):
    a = awards(spark, d)
    return G.company_profile("B3", G.won_edges(a), G.lot_nodes(a), classified(spark, d), tendered(spark, d), fanout=True)


@query("company_contracts", _sql(f"SELECT m.sid, m.lot_key, m.amount, m.award_date, authority, o_orderstatus AS status_code FROM ({_MINE}) m JOIN orders ON CAST(o_orderkey AS VARCHAR) = m.sid LEFT JOIN tendered t ON t.sid = m.sid ORDER BY m.award_date DESC NULLS FIRST, m.lot_key, authority LIMIT 20 OFFSET 5"))
def _(spark, d):
    a = awards(spark, d)
    return G.company_contracts("B3", G.won_edges(a), G.lot_nodes(a), contracts(spark, d), tendered(spark, d), 20, 5).select("sid", "lot_key", "amount", "award_date", "authority", "status_code")


@query("company_contracts_total", _sql(f"SELECT count(DISTINCT sid) AS total FROM ({_MINE})"))
def _(spark, d):
    a = awards(spark, d)
    return G.won_edges(a).filter("nif = 'B3'").join(G.lot_nodes(a).select("lot_key", "sid"), "lot_key").agg(F.countDistinct("sid").alias("total"))


@query("contract_neighborhood", _sql("""SELECT l.sid, authority, nuts, l.lot_key, (SELECT string_agg(nif, ',' ORDER BY nif) FROM won w WHERE w.lot_key = l.lot_key) AS winners, (SELECT string_agg(cpv, ',' ORDER BY cpv) FROM classified c WHERE c.lot_key = l.lot_key) AS cpvs
  FROM lots l LEFT JOIN tendered t ON t.sid = l.sid LEFT JOIN located o ON o.sid = l.sid WHERE l.sid = '7'"""))
def _(spark, d):
    a = awards(spark, d)
    return G.contract_neighborhood("7", contracts(spark, d), G.lot_nodes(a), G.won_edges(a), classified(spark, d), tendered(spark, d), located(spark, d))


@query("similar_companies", _sql("""SELECT w.nif, count(DISTINCT w.lot_key) AS shared_lots, count(DISTINCT c.cpv) AS shared_cpvs FROM classified c JOIN won w ON w.lot_key = c.lot_key AND w.nif <> 'B3'
  WHERE c.cpv IN (SELECT k.cpv FROM won v JOIN classified k ON k.lot_key = v.lot_key WHERE v.nif = 'B3') AND c.cpv IN (SELECT cpv FROM classified GROUP BY cpv HAVING count(DISTINCT lot_key) >= 2)
  GROUP BY w.nif ORDER BY shared_lots DESC, w.nif LIMIT 10"""))
def _(spark, d):
    return G.similar_companies("B3", G.won_edges(awards(spark, d)), classified(spark, d))


@query("graph_merged", _sql("SELECT (SELECT count(*) FROM won) AS won, (SELECT count(*) FROM lots) AS lots, (SELECT count(DISTINCT nif) FROM awards WHERE nif IS NOT NULL) AS companies, (SELECT count(*) FROM classified) AS classified"))
def _(spark, d):
    a = awards(spark, d)
    parts = [a.filter(F.pmod(F.col("sid").cast("long"), F.lit(3)) == i) for i in range(3)]
    batches = [{"won": G.won_edges(p), "lots": G.lot_nodes(p), "companies": G.company_nodes(p)} for p in parts]
    batches[0]["classified"] = classified(spark, d)
    batches.append({"won": G.won_edges(a.limit(0)), "lots": G.lot_nodes(a)})  # nothing won, so nothing is added
    merged = G.merge_batches(batches)
    G.check_unique({"lots": merged["lots"], "companies": merged["companies"].dropDuplicates(["nif"])})
    counts = [merged[t].agg(F.count("*").alias(t)) for t in ("won", "lots", "classified")] + [merged["companies"].agg(F.countDistinct("nif").alias("companies"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])  # one row each


def _in_batches(spark, d):
    """The award graph after two batches: all orders, then one in five once more, every lot won by a company's other name and
    the lots of one in ten by another company too; one in seven goes with the second."""
    from almoneda.graph_store import GraphStore, batch_tables
    from almoneda.store import discard, workspace, written

    key = F.col("sid").cast("long")
    a = written(awards(spark, d), "awards")
    g = GraphStore(spark, workspace(spark, "graph"))
    g.apply("b1", batch_tables(a))
    again = a.filter(key % 5 == 0).withColumn("name", F.concat(F.lit("NEW "), "name")).withColumn("nif", F.when((key % 10 == 0) & F.col("nif").isNotNull(), "B9999").otherwise(F.col("nif")))
    gone = contracts(spark, d).filter(key % 7 == 0).select("sid")
    g.apply("b2", batch_tables(again.join(gone, "sid", "left_anti")), gone)
    discard(a)
    return g


_BATCHES = _sql(""", d AS (SELECT sid, lot_key, nif, name, CAST(sid AS BIGINT) AS k, seq FROM awards WHERE nif IS NOT NULL AND CAST(sid AS BIGINT) % 7 <> 0),
later AS (SELECT CASE WHEN k % 10 = 0 THEN 'B9999' ELSE nif END AS nif, lot_key, max_by('NEW ' || name, seq) AS name FROM d WHERE k % 5 = 0 GROUP BY CASE WHEN k % 10 = 0 THEN 'B9999' ELSE nif END, lot_key),
edges AS (SELECT nif, lot_key, name FROM later UNION ALL SELECT nif, lot_key, max_by(name, seq) FROM d WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.nif = d.nif AND l.lot_key = d.lot_key) GROUP BY nif, lot_key)""")


@query("graph_in_batches", _BATCHES + """, c AS (SELECT nif, upper(replace(regexp_replace(name, '[^A-Za-z0-9]', ' ', 'g'), ' S L ', '')) AS norm, count(*) AS n, min(name) AS name FROM edges GROUP BY ALL),
  t AS (SELECT nif, arg_min(name, (-n, norm)) AS canonical_name FROM c GROUP BY nif) SELECT nif, lot_key, name AS name_display, canonical_name FROM edges JOIN t USING (nif)""")
def _(spark, d):
    """Edges, and the names of their companies as signed counts keep them."""
    g = _in_batches(spark, d)
    return g.read("won").join(g.read("companies"), "nif").select("nif", "lot_key", "name_display", "canonical_name")
