"""From versions of notices to one latest state each.

versions: (sid, updated, status_code, pos, tombstone, ...); `updated` is ISO 8601 text in one offset, pos the arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoneda.store import Conflict, SnapshotStore, written


def _entries(versions: DataFrame) -> DataFrame:
    return versions.filter("NOT tombstone")


def collapse_latest(versions: DataFrame) -> DataFrame:
    """The latest version of each sid: greatest `updated`, then latest arrival. No sort and no window: one aggregate."""
    cols = [c for c in versions.columns if c not in ("sid", "tombstone")]
    last = _entries(versions).groupBy("sid").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("updated", F.lit("")), "pos")).alias("v"))
    return last.select("sid", "v.*")


def status_history(versions: DataFrame) -> DataFrame:
    """(sid, history): distinct (date, code) of all versions in order; a contract has a handful of them."""
    event = F.struct(F.nullif(F.substring("updated", 1, 10), F.lit("")).alias("date"), F.col("status_code").alias("code"))
    return _entries(versions).groupBy("sid").agg(F.sort_array(F.collect_set(event)).alias("history"))


def collapse(versions: DataFrame) -> DataFrame:
    """Latest state with history, without what the same batch tombstones, whenever that was."""
    versions = versions.drop("history")  # of one version alone
    gone = versions.filter("tombstone").select("sid").distinct()
    return collapse_latest(versions).join(status_history(versions), "sid").join(gone, "sid", "left_anti")


def merge_histories(a, b):
    """Two histories as one, without repeats, in order."""
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<struct<date:string,code:string>>")), F.coalesce(b, F.array().cast("array<struct<date:string,code:string>>")))))


def guard_stale(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows that are newer than what is stored, with `stored_history`; unknown times are let through."""
    s = stored.select("sid", F.col("updated").alias("stored_updated"), *([F.col("history").alias("stored_history")] if "history" in stored.columns else []))
    return incoming.join(s, "sid", "left").filter(F.coalesce(F.col("updated") > F.col("stored_updated"), F.lit(True)))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "sid") -> DataFrame:
    """A snapshot with incoming rows in place of stored ones of the same key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def ingest(stored: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot after the batch, rows written): collapse, stale guard, history merge, upsert, tombstones."""
    fresh = guard_stale(collapse(versions), stored)
    fresh = fresh.withColumn("history", merge_histories(F.col("history"), F.col("stored_history"))).drop("stored_updated", "stored_history")
    gone = versions.filter("tombstone").select("sid").distinct()
    return upsert(stored.join(gone, "sid", "left_anti"), fresh), fresh


def apply(store: SnapshotStore, versions: DataFrame, batch: str) -> DataFrame | None:
    """Brings versions into a store, once a batch id: the rows written, or None if the batch has been applied."""
    found = apply_counted(store, versions, batch)
    return found[0] if found else None


def apply_counted(store: SnapshotStore, versions: DataFrame, batch: str, attempts: int = 5) -> tuple[DataFrame, dict[str, int]] | None:
    """apply(...) with what became of the batch: `records`, its latest states less those it tombstones; `upserted`, those
    written; `skipped`, those not newer than what is stored; `deleted`, its tombstones.

    What is stored of the batch's keys is read, and only rows that changed are written. If another writer changed their
    parts meanwhile, all is done again from what is stored then.
    """
    if store.applied(batch):
        return None
    versions = written(versions.drop("history"), "batch")
    gone = versions.filter("tombstone").select("sid").distinct()
    collapsed = written(collapse(versions), "collapsed")
    for attempt in range(attempts):
        since = store.version()
        now = store.rows_of(collapsed.select("sid")) if since else None
        if now is None:  # all is new
            fresh = collapsed
        else:
            fresh = guard_stale(collapsed, now if "history" in now.columns else collapsed.limit(0))
            fresh = written(fresh.withColumn("history", merge_histories(F.col("history"), F.col("stored_history"))).drop("stored_updated", "stored_history"), "fresh")
        try:
            if not store.change(batch, replace=fresh, remove=gone, since=since):
                return None
            break
        except Conflict:
            if attempt + 1 == attempts:
                raise
    records, upserted = collapsed.count(), fresh.count()
    return fresh, {"records": records, "upserted": upserted, "deleted": versions.filter("tombstone").count(), "skipped": records - upserted}


def changed_only(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows in which any derived column differs from what is stored; null equals null. pairs: derived -> stored."""
    same = F.lit(True)
    for new, old in pairs.items():
        same = same & F.col(new).eqNullSafe(F.col(old))
    return df.filter(~same)


def watermarks(versions: DataFrame) -> DataFrame:
    """(category, watermark): the greatest `updated` of each category."""
    return versions.groupBy("category").agg(F.max("updated").alias("watermark"))
