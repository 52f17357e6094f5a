"""Domain views over the test tables, for Spark and as SQL for the oracle. Columns are added only when a plan needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parts of a task, whose rows in the table are few bytes and become four rows each.
TASK_PARTS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cpv_code() -> str:
    return "concat(lpad(cast(p_size as string), 2, '0'), lpad(cast(p_partkey % 1000000 as string), 6, '0'))"


def contracts(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Orders as contracts. parts: customer (type, authority), nuts, result, cpv."""
    o = table(spark, sf_dir, "orders")
    out = o.select(
        F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey").cast("string").alias("sid"), F.col("o_orderstatus").alias("status_code"), F.substring("o_orderpriority", 1, 1).alias("procedure_code"),
        (F.col("o_totalprice") * F.pow(F.lit(10.0), F.pmod("o_orderkey", F.lit(5)) - 1)).alias("budget_amount"), F.col("o_orderdate").alias("publication_ts"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("deadline_ts"),
    )
    if "customer" in parts or "nuts" in parts:
        c = table(spark, sf_dir, "customer")
        out = out.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("contract_type_code"), F.col("c_name").alias("contracting_authority"), "c_nationkey"), "o_custkey", "left")
    if "nuts" in parts:
        n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        nuts = n.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("ES"), F.col("r_regionkey").cast("string"), F.pmod("n_nationkey", F.lit(10)).cast("string"), F.lit("0")).alias("nuts"), F.col("n_name").alias("nuts_label"))
        out = out.join(F.broadcast(nuts), "c_nationkey", "left")  # 25 nations
    if "result" in parts or "cpv" in parts:
        li = table(spark, sf_dir, "lineitem")
        aggs = [F.max("l_returnflag").alias("result_code")] if "result" in parts else []
        if "cpv" in parts:
            li = li.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
            aggs.append(F.sort_array(F.collect_set(F.expr(cpv_code()))).alias("cpv"))
        out = out.join(li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*aggs), "o_orderkey", "left")
    return out


#: The same views as DuckDB CTEs.
CONTRACTS = """res AS (SELECT l_orderkey, max(l_returnflag) AS result_code, list_sort(list(DISTINCT lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0')) FILTER (p_partkey IS NOT NULL)) AS cpv
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
contracts AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey AS VARCHAR) AS sid, o_orderstatus AS status_code, substr(o_orderpriority, 1, 1) AS procedure_code,
  o_totalprice * pow(10.0, o_orderkey % 5 - 1) AS budget_amount, o_orderdate AS publication_ts, o_orderdate + INTERVAL 30 DAY AS deadline_ts, c_mktsegment AS contract_type_code, c_name AS contracting_authority,
  'ES' || r_regionkey || (n_nationkey % 10) || '0' AS nuts, n_name AS nuts_label, result_code, cpv
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN res ON l_orderkey = o_orderkey)"""


def with_contracts(sql: str) -> str:
    return f"WITH {CONTRACTS}\n{sql}"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notices: several versions of a contract, errors being tombstones."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("sid"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated"), F.col("event_type").alias("status_code"),
        F.col("event_id").alias("pos"), (F.col("event_type") == "error").alias("tombstone"), F.col("value").alias("amount"), (F.col("event_id") % 3).cast("string").alias("category"),
    )


VERSIONS = """versions AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS sid, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS updated, event_type AS status_code, event_id AS pos, event_type = 'error' AS tombstone,
  value AS amount, CAST(event_id % 3 AS VARCHAR) AS category FROM events)"""


def cpv_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as classification codes: each part's code, and its ancestors at 2, 4 and 6 digits, with labels."""
    p = table(spark, sf_dir, "part").select(F.expr(cpv_code()).alias("leaf"), "p_name")
    p = p.repartition(max(1, -(-p.count() // TASK_PARTS)))
    up = p.select(F.explode(F.array(F.rpad(F.substring("leaf", 1, 2), 8, "0"), F.rpad(F.substring("leaf", 1, 4), 8, "0"), F.rpad(F.substring("leaf", 1, 6), 8, "0"), F.col("leaf"))).alias("code"), "p_name")
    return up.groupBy("code").agg(F.min("p_name").alias("label"))


CPV_DIM = """cpv_dim AS (SELECT code, min(p_name) AS label FROM (SELECT unnest([rpad(substr(leaf, 1, 2), 8, '0'), rpad(substr(leaf, 1, 4), 8, '0'), rpad(substr(leaf, 1, 6), 8, '0'), leaf]) AS code, p_name
  FROM (SELECT lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS leaf, p_name FROM part)) GROUP BY code)"""
