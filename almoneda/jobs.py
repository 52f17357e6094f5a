"""Ingest jobs over feeds: daily walk, back-fill, reconciliation of the running year.

The daily walk fetches pages one after the other, as each names the next, and puts them into the shared folder; Spark reads them
from there. Archives are downloaded and unpacked by executors. `fetch` stands in for the network.
"""

from __future__ import annotations

import datetime
import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda import extract, ingest
from almoneda.graph_store import GraphStore, of_contracts
from almoneda.sources import feeds
from almoneda.store import SnapshotStore, workspace, written
from almoneda.streaming.daily import backfill, walk_pages

#: Tables of the store and the columns each begins with.
TABLES = {
    "contracts": "sid string, updated string, status_code string, category string",
    "companies": "sid string, name string, content string, embedding array<float>",
    "criteria": "sid string, expediente string, criteria_json string, criteria_summary string, source_url string, extracted_at timestamp",
    "chunks": "sid string, expediente string, pliego_type string, chunk_index int, chunk_title string, chunk_text string, source_pdf_url string",
}


class Jobs:
    def __init__(self, spark: SparkSession, home: str, fetch: Callable[[str], bytes] | None = None, year: int | None = None):
        self.spark, self.home, self.fetch, self.year = spark, home.rstrip("/"), fetch, year or datetime.date.today().year
        self.store = SnapshotStore(spark, f"{self.home}/contracts")
        self.graph = GraphStore(spark, f"{self.home}/graph")

    def init_schema(self) -> dict[str, bool]:
        """Makes the tables that aren't there; which were made."""
        return {name: SnapshotStore(self.spark, f"{self.home}/{name}").ensure(ddl) for name, ddl in TABLES.items()}

    def init_graph(self) -> None:
        """Makes the tables of the award graph, brings in the stored contracts if it has none, and checks its keys."""
        self.graph.ensure()
        if not self.graph.stores["contracts"].version() and self.store.version():
            self.graph.apply("first", of_contracts(self.store.read()))
        self.graph.check()

    def land(self, url: str, name: str) -> tuple[str, str]:
        """(path, batch id) of a file fetched into the shared folder; the id follows from what the file holds."""
        content = feeds.download(url, self.fetch)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{workspace(self.spark, 'feed')}/{name}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(content))
        out.close()
        return path.toString(), hashlib.sha256(content).hexdigest()[:32]

    def process(self, path: str | list[str], category: str, batch: str) -> dict[str, int]:
        """Brings feed files into the store; what became of them (see ingest.apply_counted). A batch counts once."""
        entries = extract.contracts(feeds.entries(self.spark, path, category))
        gone = feeds.tombstones(self.spark, path, category).select("sid", F.col("when").alias("updated"), "category", F.lit(True).alias("tombstone"))
        versions = entries.unionByName(gone, allowMissingColumns=True)
        found = ingest.apply_counted(self.store, versions, batch)
        if found is None:
            return {"records": 0, "upserted": 0, "deleted": 0, "skipped": 0}
        try:
            self.graph.apply(batch, of_contracts(found[0]), gone.select("sid"))
        except Exception as e:  # noqa: BLE001  the graph never stops the ingest
            print(f"graph, {category}: {e}")
        return found[1]

    def watermark(self, category: str) -> str | None:
        now = self.store.read(TABLES["contracts"])
        return now.filter(F.col("category") == category).agg(F.max("updated")).first()[0]

    def daily(self, most: int = 1000) -> dict[str, int]:
        """Pages of every channel from the newest on, down to one that holds nothing new; pages by channel."""
        out = {}
        for category, _, _, _ in feeds.CHANNELS:
            before = self.watermark(category)

            def load(url: str, category=category) -> tuple[str | None, str | None]:
                path, batch = self.land(url, "page.atom")
                self.process(path, category, batch)
                newest = feeds.entries(self.spark, path, category).agg(F.max("updated")).first()[0]
                return newest, feeds.next_link(self.spark, path)

            out[category] = len(walk_pages(feeds.head_url(category), load, before, most))
        return out

    def _archive(self, feed: dict) -> None:
        """Brings the archive of one channel and year into the store; executors download and unpack it."""
        members = written(feeds.fetched_members(self.spark, [feed["url"]], self.fetch), "archive")
        first = members.select("digest").first()
        if first:
            self.process(feeds.unpacked(members, workspace(self.spark, "members")), feed["category"], first.digest[:32])

    def _feeds(self) -> list[dict]:
        return [r.asDict() for r in feeds.catalog(self.spark, self.year).collect()]  # a row a channel and year

    def backfill(self, may_run: Callable[[], bool] = lambda: True, pause: Callable[[], None] = lambda: time.sleep(600)) -> tuple[list[str], dict[str, str]]:
        """All archives, oldest year first, each once may_run says so; (done, failed with why)."""
        return backfill(self._feeds(), self._archive, may_run, pause)

    def reconcile(self) -> tuple[list[str], dict[str, str]]:
        """The running year's archives once more, merged into what is stored."""
        return backfill([f for f in self._feeds() if f["incremental"]], self._archive)


def contracts_of(jobs: Jobs) -> DataFrame:
    """The contracts a store holds."""
    return jobs.store.read(TABLES["contracts"])
