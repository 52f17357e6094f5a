"""The latest state of each notice as a stateful stream: version, history and tombstone are kept by key.

Whatever the micro-batches and however late a version, what has been put out last for a key equals the fold of all its
versions at once (ingest.collapse): the greatest time wins, then the latest arrival; the history holds every status; a
tombstone is for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda import ingest
from almoneda.store import SnapshotStore, written

#: What a version carries, and what is put out.
VERSION = "sid string, updated string, status_code string, pos bigint, tombstone boolean, payload string"
LATEST = "sid string, updated string, status_code string, pos bigint, payload string, tombstone boolean, history string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_wins(versions: DataFrame) -> DataFrame:
    """The latest state (LATEST) of each key of a stream or table of versions (VERSION); on a stream in update mode, that of
    the keys a micro-batch meets. Versions without a key are left aside.

    State of a key is Spark's own, of three aggregates: the winning version, the statuses by date, whether it is tombstoned.
    """
    live = ~F.coalesce("tombstone", F.lit(False))
    at = F.coalesce("updated", F.lit(""))
    event = F.struct(F.substring(at, 1, 10).alias("date"), F.coalesce("status_code", F.lit("")).alias("code"))
    kept = versions.filter("sid IS NOT NULL").groupBy("sid").agg(
        F.max(F.when(live, F.struct(at.alias("at"), "pos", "updated", "status_code", "payload"))).alias("v"), F.collect_set(F.when(live, event)).alias("events"), F.max(~live).alias("tombstone"),
    )
    text = F.array_join(F.transform(F.array_sort("events"), lambda x: F.trim(F.concat_ws(" ", x["date"], x["code"]))), "|")
    return kept.select("sid", "v.updated", "v.status_code", "v.pos", "v.payload", "tombstone", text.alias("history"))


def keep_latest(versions: DataFrame, store: SnapshotStore, checkpoint: str) -> None:
    """Runs all there is of a stream of versions into a store: rows of changed keys, tombstoned ones removed."""
    spark: SparkSession = versions.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)

    def put(batch: DataFrame, n: int) -> None:
        batch = written(batch, "changes")  # its state is updated once
        store.change(f"state{n}", replace=batch.filter("NOT tombstone").drop("tombstone"), remove=batch.filter("tombstone").select("sid"))

    try:
        latest_wins(versions).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fold(versions: DataFrame) -> DataFrame:
    """The same in one batch: (sid, updated, status_code, pos, payload, history)."""
    text = F.array_join(F.transform("history", lambda x: F.trim(F.concat_ws(" ", F.coalesce(x["date"], F.lit("")), F.coalesce(x["code"], F.lit(""))))), "|")
    return ingest.collapse(versions.filter("sid IS NOT NULL")).withColumn("history", text)
