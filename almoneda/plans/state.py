"""Queries of state folds, over events as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda import state as X
from almoneda.plans.registry import query
from almoneda.plans.testbind import table
from almoneda.store import workspace

_LOG = "log AS (SELECT user_id, event_id % 50 AS item_id, CASE WHEN event_type = 'view' THEN 'remove' ELSE 'save' END AS action, ts, CASE WHEN event_type = 'purchase' THEN 'title ' || event_id END AS title FROM events WHERE event_type IN ('signup', 'purchase', 'view'))"
_STATE = f"""{_LOG}, s AS (SELECT user_id, item_id, max(ts) AS saved_at, max_by(title, ts) FILTER (title IS NOT NULL) AS title FROM log WHERE action = 'save' GROUP BY ALL),
st AS (SELECT s.user_id, s.item_id, saved_at, title, (SELECT min(ts) FROM log r WHERE r.action = 'remove' AND r.user_id = s.user_id AND r.item_id = s.item_id AND r.ts > s.saved_at) AS removed_at FROM s)"""


def _log(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase", "view"))
    return e.select("user_id", F.pmod("event_id", F.lit(50)).alias("item_id"), F.when(F.col("event_type") == "view", "remove").otherwise("save").alias("action"), "ts", F.when(F.col("event_type") == "purchase", F.concat(F.lit("title "), F.col("event_id").cast("string"))).alias("title"))


def _likes(spark, d):
    e = table(spark, d, "events").filter("event_type = 'click'")
    return e.select("user_id", F.pmod("event_id", F.lit(50)).alias("result_id"), "event_id", "ts", "value")


@query("first_write_wins", "SELECT user_id, event_id % 50 AS result_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL")
def _(spark, d):
    return X.first_write(_likes(spark, d), ["user_id", "result_id"], "ts").select("user_id", "result_id", "event_id")


@query("last_write_wins", "SELECT user_id, event_id % 50 AS result_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY ALL")
def _(spark, d):
    return X.last_write(_likes(spark, d), ["user_id", "result_id"], "ts").select("user_id", "result_id", "event_id", "value")


@query("saved_state_fold", f"WITH {_STATE} SELECT user_id, item_id, removed_at IS NULL AS active, saved_at, removed_at, title FROM st")
def _(spark, d):
    return X.saved_state(_log(spark, d))


@query("saved_list_page", f"WITH {_STATE} SELECT item_id, saved_at FROM st WHERE user_id = 8 AND removed_at IS NULL ORDER BY saved_at DESC, item_id LIMIT 10 OFFSET 2")
def _(spark, d):
    return X.saved_page(X.saved_state(_log(spark, d)), 8, 10, 2).select("item_id", "saved_at")


@query("saved_count", f"WITH {_STATE} SELECT user_id, count(*) AS n FROM st WHERE removed_at IS NULL GROUP BY user_id")
def _(spark, d):
    return X.saved_state(_log(spark, d)).filter("active").groupBy("user_id").agg(F.count("*").alias("n"))


@query("delete_anti", "SELECT DISTINCT user_id, event_id % 50 AS result_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = e.user_id AND r.event_id % 50 = e.event_id % 50)")
def _(spark, d):
    gone = table(spark, d, "events").filter("event_type = 'error'").select("user_id", F.pmod("event_id", F.lit(50)).alias("result_id"))
    return _likes(spark, d).select("user_id", "result_id").distinct().join(gone, ["user_id", "result_id"], "left_anti")


@query("last_seen", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))


@query("normalized_key_lookup", "SELECT c_custkey FROM customer WHERE c_custkey = 17")
def _(spark, d):
    users = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" User"), F.col("c_custkey").cast("string"), F.lit("@Example.COM ")).alias("email"))
    return X.by_email(users, "  USER17@example.com").select("c_custkey")


@query("token_valid", "SELECT user_id, max(event_id) AS token FROM events WHERE event_type = 'signup' AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20' GROUP BY user_id")
def _(spark, d):
    t = table(spark, d, "events").filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("token"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))
    return X.valid_tokens(t, "2024-01-20").groupBy("user_id").agg(F.max("token").alias("token"))


@query("append_event", "SELECT user_id, event_type, '{\"k\":\"' || (props ->> '$.k') || '\"}' AS context_json, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL UNION ALL SELECT user_id, event_type, NULL, count(*) FROM events WHERE event_type = 'view' GROUP BY ALL")
def _(spark, d):
    path = workspace(spark, "events")
    e = table(spark, d, "events").select("user_id", "event_type", F.lit(None).cast("string").alias("item_id"), F.when(F.col("event_type") != "view", F.from_json("props", "map<string,string>")).alias("context"), "ts")
    for kind in ("view", "not view"):
        X.append_events(e.filter(F.col("event_type") == "view" if kind == "view" else F.col("event_type") != "view"), path)
    return spark.read.parquet(path).groupBy("user_id", "event_type", "context_json").agg(F.count("*").alias("n"))
