"""Queries of the ingest core, over events as versions of notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda import ingest as I
from almoneda.plans.registry import query
from almoneda.plans.testbind import VERSIONS, contracts, versions
from almoneda.store import SnapshotStore, workspace

_HALF = "2024-01-15"
_CTE = f"""WITH {VERSIONS},
e AS (SELECT * FROM versions WHERE NOT tombstone), gone AS (SELECT DISTINCT sid FROM versions WHERE tombstone),
latest AS (SELECT sid, max_by(updated, (updated, pos)) AS updated, max_by(status_code, (updated, pos)) AS status_code, max_by(pos, (updated, pos)) AS pos, max_by(amount, (updated, pos)) AS amount FROM e GROUP BY sid),
hist AS (SELECT sid, string_agg(x, '|' ORDER BY x) AS history FROM (SELECT DISTINCT sid, substr(updated, 1, 10) || ' ' || status_code AS x FROM e) GROUP BY sid)
"""
_TEXT = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["date"], x["code"])), "|")


@query("collapse_latest", _CTE + "SELECT sid, updated, status_code, pos, amount FROM latest")
def _(spark, d):
    return I.collapse_latest(versions(spark, d)).select("sid", "updated", "status_code", "pos", "amount")


@query("status_history", _CTE + "SELECT sid, history FROM hist")
def _(spark, d):
    return I.status_history(versions(spark, d)).select("sid", _TEXT("history").alias("history"))


@query("status_history_sorted", _CTE + "SELECT sid, CAST(count(*) AS INTEGER) AS n, min(x) AS first_event, max(x) AS last_event FROM (SELECT DISTINCT sid, substr(updated, 1, 10) || ' ' || status_code AS x FROM e) GROUP BY sid")
def _(spark, d):
    h = I.status_history(versions(spark, d)).withColumn("x", F.transform("history", lambda x: F.concat_ws(" ", x["date"], x["code"])))
    return h.select("sid", F.size("x").alias("n"), F.get("x", F.lit(0)).alias("first_event"), F.element_at("x", -1).alias("last_event"))


@query("collapse_tombstoned", _CTE + "SELECT sid, updated, status_code, history FROM latest JOIN hist USING (sid) WHERE sid NOT IN (SELECT sid FROM gone)")
def _(spark, d):
    return I.collapse(versions(spark, d)).select("sid", "updated", "status_code", _TEXT("history").alias("history"))


def _by_user(spark, d):
    """Versions of users, so that a contract lives in both halves of the log."""
    v = versions(spark, d).withColumn("sid", F.substring_index("sid", "-", 1))
    return v.filter(F.col("updated") < _HALF), v.filter(F.col("updated") >= F.lit("2024-01-10"))


_TWO = f"""WITH {VERSIONS}, v AS (SELECT * REPLACE (string_split(sid, '-')[1] AS sid) FROM versions),
o AS (SELECT sid, max(updated) AS updated, max_by(status_code, (updated, pos)) AS status_code FROM v WHERE NOT tombstone AND updated < '{_HALF}' GROUP BY sid),
n AS (SELECT sid, max(updated) AS updated, max_by(status_code, (updated, pos)) AS status_code FROM v WHERE NOT tombstone AND updated >= '2024-01-10' GROUP BY sid),
h AS (SELECT sid, string_agg(x, '|' ORDER BY x) AS history FROM (SELECT DISTINCT sid, substr(updated, 1, 10) || ' ' || status_code AS x FROM v WHERE NOT tombstone) GROUP BY sid),
fresh AS (SELECT n.sid, n.updated, n.status_code FROM n LEFT JOIN o USING (sid) WHERE o.updated IS NULL OR n.updated > o.updated)
"""


@query("stale_guard", _TWO + "SELECT sid, updated FROM fresh")
def _(spark, d):
    old, new = _by_user(spark, d)
    return I.guard_stale(I.collapse_latest(new), I.collapse_latest(old)).select("sid", "updated")


@query("history_merge", _TWO + "SELECT sid, history FROM h WHERE sid IN (SELECT sid FROM o) AND sid IN (SELECT sid FROM n)")
def _(spark, d):
    old, new = (I.status_history(x) for x in _by_user(spark, d))
    return old.join(new.withColumnRenamed("history", "more"), "sid").select("sid", _TEXT(I.merge_histories(F.col("history"), F.col("more"))).alias("history"))


@query("upsert_latest", _TWO + "SELECT sid, updated, status_code FROM fresh UNION ALL SELECT sid, updated, status_code FROM o WHERE sid NOT IN (SELECT sid FROM fresh)")
def _(spark, d):
    old, new = (I.collapse_latest(x) for x in _by_user(spark, d))
    return I.upsert(old, I.guard_stale(new, old).drop("stored_updated")).select("sid", "updated", "status_code")


@query("apply_tombstones", _CTE + "SELECT sid, status_code FROM latest WHERE sid NOT IN (SELECT sid FROM gone)")
def _(spark, d):
    v = versions(spark, d)
    return I.collapse_latest(v).join(v.filter("tombstone").select("sid"), "sid", "left_anti").select("sid", "status_code")


@query("ingest_stats", _CTE + "SELECT (SELECT count(*) FROM latest WHERE sid NOT IN (SELECT sid FROM gone)) AS upserted, (SELECT count(*) FROM versions WHERE tombstone) AS deleted, (SELECT count(*) FROM versions WHERE NOT tombstone) AS records")
def _(spark, d):
    v = versions(spark, d)
    seen = v.agg(F.count_if("tombstone").alias("deleted"), F.count_if(~F.col("tombstone")).alias("records"))
    return I.collapse(v).agg(F.count("*").alias("upserted")).crossJoin(F.broadcast(seen))  # one row each


def _store(spark):
    return SnapshotStore(spark, workspace(spark, "store"))


@query("create_if_missing", "SELECT true AS first, false AS second, 0 AS n")
def _(spark, d):
    store, schema = _store(spark), "sid string, updated string"
    first, second = store.ensure(schema), store.ensure(schema)
    return store.read().agg(F.count("*").alias("n")).select(F.lit(first).alias("first"), F.lit(second).alias("second"), "n")


@query("insert_raw", "SELECT sid, status_code, count(*) AS n FROM (SELECT CAST(o_orderkey AS VARCHAR) AS sid, o_orderstatus AS status_code FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders WHERE o_orderkey % 10 = 0) GROUP BY ALL")
def _(spark, d):
    store, rows = _store(spark), contracts(spark, d).select("sid", "status_code")
    store.insert(rows, "1")
    store.insert(rows.filter(F.col("sid").cast("long") % 10 == 0), "2")
    store.insert(rows, "2")  # a batch counts once
    return store.read().groupBy("sid", "status_code").agg(F.count("*").alias("n"))


@query("insert_or_replace", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status_code FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 3 = 0")
def _(spark, d):
    store, rows = _store(spark), contracts(spark, d).select("sid", "status_code")
    store.upsert(rows.filter(F.col("sid").cast("long") % 3 == 0), "1")
    store.upsert(rows.filter(F.col("sid").cast("long") % 10 == 0).withColumn("status_code", F.lit("new")), "2")
    return store.read()


@query("reconcile_stored", _TWO + "SELECT f.sid, f.updated, f.status_code, h.history FROM fresh f JOIN h USING (sid)")
def _(spark, d):
    store = _store(spark)
    old, new = (x.filter("NOT tombstone") for x in _by_user(spark, d))
    store.replace(I.collapse(old), "stored")
    return I.apply(store, new, "year").select("sid", "updated", "status_code", _TEXT(F.col("history")).alias("history"))


def _loaded(spark, d):
    """All orders, then a batch that changes one in 150, one that removes one in 300, and one that adds one in 700 again."""
    store, rows = _store(spark), contracts(spark, d).select("sid", "status_code")
    every = lambda n: rows.filter(F.col("sid").cast("long") % n == 0)
    store.replace(rows, "all")
    store.upsert(every(150).withColumn("status_code", F.lit("new")), "changed")
    store.delete(every(300).select("sid"), "removed")
    store.insert(every(700).withColumn("status_code", F.lit("again")), "added")
    return store


@query("store_log_rows", """SELECT CAST(o_orderkey AS VARCHAR) AS sid, CASE WHEN o_orderkey % 150 = 0 THEN 'new' ELSE o_orderstatus END AS status_code FROM orders WHERE o_orderkey % 300 <> 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'again' FROM orders WHERE o_orderkey % 700 = 0""")
def _(spark, d):
    return _loaded(spark, d).read()


@query("store_log_written", """SELECT 'all' AS batch, count(*) AS rows FROM orders UNION ALL SELECT 'changed', count(*) FROM orders WHERE o_orderkey % 150 = 0
  UNION ALL SELECT 'removed', count(*) FROM orders WHERE o_orderkey % 300 = 0 UNION ALL SELECT 'added', count(*) FROM orders WHERE o_orderkey % 700 = 0""")
def _(spark, d):
    """A batch writes its own rows and no others."""
    return _loaded(spark, d).commits().select("batch", "rows")


@query("ingest_skipped", _TWO + "SELECT (SELECT count(*) FROM n) AS records, (SELECT count(*) FROM fresh) AS upserted, (SELECT count(*) FROM n) - (SELECT count(*) FROM fresh) AS skipped")
def _(spark, d):
    """The second half of the log, its early part a second time, against a store of the first: what isn't newer is skipped."""
    store = _store(spark)
    old, new = (x.filter("NOT tombstone") for x in _by_user(spark, d))
    again = old.filter(F.col("updated") >= F.lit("2024-01-10"))
    store.replace(I.collapse(old), "stored")
    _, stats = I.apply_counted(store, new.unionByName(again), "year")
    return spark.createDataFrame([(stats["records"], stats["upserted"], stats["skipped"])], "records long, upserted long, skipped long")
