"""Incremental ingest: a landing folder of feed files as a stream, each batch applied once to a snapshot."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda import ingest
from almoneda.store import SnapshotStore


def run_stream(versions: DataFrame, store: SnapshotStore, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> None:
    """Applies all files that are there. `versions` is a stream as almoneda.ingest takes it.

    A batch writes its own rows alone. One that is repeated after a failure is found and skipped. `after` gets each batch's
    rows, for a second store; if it fails, the ingest goes on.
    """

    def apply(batch: DataFrame, n: int) -> None:
        fresh = ingest.apply(store, batch, f"batch{n}")
        if after and fresh is not None:
            try:
                after(fresh)
            except Exception as e:  # noqa: BLE001  the second store never stops the first
                print(f"second store: {e}")

    versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def walk_pages(first: str, load: Callable[[str], tuple[str | None, str | None]], watermark: str | None, most: int = 1000) -> list[str]:
    """Pages from the newest on, until one holds nothing newer than the watermark. load: url -> (its newest, next url)."""
    seen, url = [], first
    while url and len(seen) < most:
        newest, following = load(url)
        seen.append(url)
        if watermark and newest and newest <= watermark:
            break
        url = following
    return seen


def backfill(feeds: list[dict], process: Callable[[dict], None], may_run: Callable[[], bool] = lambda: True, pause: Callable[[], None] = lambda: time.sleep(600)) -> tuple[list[str], dict[str, str]]:
    """All feeds from the oldest year on; before each it waits, pause by pause, until may_run says so. A feed that fails
    doesn't stop the others."""
    done, failed = [], {}
    for f in sorted(feeds, key=lambda x: (x["year"], x["category"])):
        while not may_run():
            pause()
        try:
            process(f)
            done.append(f["name"])
        except Exception as e:  # noqa: BLE001  isolated by feed
            failed[f["name"]] = str(e)
    return done, failed


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts by tumbling window.

    On a stream, rows later than the watermark are dropped, and a window goes out once the watermark has passed its end. A
    table has no late rows: all count.
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
