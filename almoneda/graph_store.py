"""The award graph kept up to date by batches: what a batch changes follows from its own contracts and companies.

Edges, lots and contracts are kept by contract, so that a batch reads the contracts it holds. What changes of a company's WON
edges becomes signed counts by number and name, whose sums give its most frequent name; no other company is looked at.

A batch is worked out in full and written aside before any table changes, and each table takes it once, so a batch that failed
half way is finished by giving it again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almoneda import extract, graph
from almoneda.functions.scalar import normalize_name
from almoneda.store import SnapshotStore, save

#: Tables in the order they are written, the key each is kept by, and their columns.
KEYS = {"contracts": "sid", "lots": "sid", "won": "sid", "authorities": "authority", "tendered": "sid", "classified": "sid", "located": "sid", "names": "nif", "companies": "nif"}
SCHEMAS = {
    "contracts": "sid string", "lots": "sid string, lot_key string, amount double", "won": "sid string, nif string, lot_key string, amount double, award_date string, name_norm string, name_display string",
    "authorities": "authority string, name string, org_top_level string", "tendered": "sid string, authority string", "classified": "sid string, lot_key string, cpv string", "located": "sid string, nuts string",
    "companies": "nif string, is_ute boolean, canonical_name string", "names": "nif string, name_norm string, name_display string, n long",
}
#: What identifies a row of a contract's table.
_ROW = {"contracts": ["sid"], "lots": ["sid", "lot_key"], "won": ["sid", "nif", "lot_key"], "tendered": ["sid", "authority"], "classified": ["sid", "lot_key", "cpv"], "located": ["sid", "nuts"]}


def _edges(awards: DataFrame) -> DataFrame:
    """Won edges, each with the contract of its lot's last write. Awards are dealt by lot, once for both."""
    won = awards.filter("nif IS NOT NULL").select(F.concat_ws(":", "sid", "lot_id").alias("lot_key"), "nif", "sid", "amount", "award_date", "name", "seq").repartition("lot_key")
    last = won.groupBy("lot_key", "nif").agg(F.max_by(F.struct("sid", "amount", "award_date", "name", "seq"), "seq").alias("v")).select("lot_key", "nif", "v.*")
    sid = F.max_by("sid", "seq").over(Window.partitionBy("lot_key"))  # of a lot's few edges
    return last.select(sid.alias("sid"), "nif", "lot_key", "amount", "award_date", "name").withColumn("name_norm", normalize_name("name")).withColumnRenamed("name", "name_display")


def batch_tables(awards: DataFrame, contracts: DataFrame | None = None) -> dict[str, DataFrame]:
    """A batch's rows by table. awards: (sid, lot_id, nif, name, amount, award_date, seq[, cpv]); contracts: (sid[,
    contracting_authority_id, contracting_authority, org_top_level, nuts_code]). Contracts without an award to a known company
    are no part of the graph."""
    won = awards.filter("nif IS NOT NULL")
    sids = won.select("sid").distinct()
    held = contracts.join(sids, "sid", "left_semi") if contracts is not None else sids
    lots = graph.lot_nodes(awards)
    out = {
        "contracts": held.select("sid"), "lots": lots.select("sid", "lot_key", "amount"),
        "won": _edges(awards),
        "companies": graph.company_nodes(awards).withColumn("canonical_name", F.lit(None).cast("string")),
    }
    if "cpv" in awards.columns:
        out["classified"] = won.select("sid", F.concat_ws(":", "sid", "lot_id").alias("lot_key"), F.explode("cpv").alias("cpv")).distinct()
    if contracts is not None and "contracting_authority_id" in contracts.columns:
        known = held.filter(F.col("contracting_authority_id").isNotNull())
        out["tendered"] = known.select("sid", F.col("contracting_authority_id").alias("authority")).distinct()
        out["authorities"] = known.groupBy(F.col("contracting_authority_id").alias("authority")).agg(F.max("contracting_authority").alias("name"), F.max("org_top_level").alias("org_top_level"))
    if contracts is not None and "nuts_code" in contracts.columns:
        out["located"] = held.filter(F.col("nuts_code").isNotNull()).select("sid", F.col("nuts_code").alias("nuts")).distinct()
    return out


def signed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(nif, name_norm, name_display, n): by how much each count of edges changes; nothing where it doesn't."""
    side = lambda df, sign: df.select("nif", "name_norm", "name_display", F.lit(sign).cast("long").alias("n"))
    return side(before, -1).unionByName(side(after, 1)).groupBy("nif", "name_norm", "name_display").agg(F.sum("n").alias("n")).filter("n <> 0")


def top_names(names: DataFrame) -> DataFrame:
    """(nif, canonical_name) of counts by number and name: the least spelling of the most frequent name, the least of equals."""
    by_name = names.groupBy("nif", "name_norm").agg(F.sum("n").alias("n"), F.min("name_display").alias("name"))
    return by_name.groupBy("nif").agg(F.min_by("name", F.struct(-F.col("n"), "name_norm")).alias("canonical_name"))


def _at_once(f, tables: list[str]) -> dict:
    """f of each table. Edges, which are large, come first and alone, so that their shuffle files and those of lots aren't
    there together; the jobs of the others are small and don't wait for each other."""
    done = {t: f(t) for t in tables if t == "won"}
    with ThreadPoolExecutor(4) as pool:
        small = [t for t in tables if t != "won"]
        return done | dict(zip(small, pool.map(f, small)))


class GraphStore:
    """The tables of the graph below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.stores = {t: SnapshotStore(spark, f"{self.path}/{t}", key) for t, key in KEYS.items()}

    def ensure(self) -> None:
        for t, s in self.stores.items():
            s.ensure(SCHEMAS[t])

    def read(self, table: str) -> DataFrame:
        return self.stores[table].read(SCHEMAS[table])

    def _of(self, table: str, keys: DataFrame) -> DataFrame:
        found = self.stores[table].rows_of(keys)
        return found if found is not None else self.spark.createDataFrame([], SCHEMAS[table])

    def apply(self, batch: str, tables: dict[str, DataFrame], gone: DataFrame | None = None) -> bool:
        """Brings a batch of batch_tables in, once a batch id, and takes the contracts of `gone` (sid) out with their lots
        and edges; False if it is there already.

        A contract's edges and lots are merged: those of earlier versions stay beside new ones, equal keys take the new
        values. A company is a joint venture if any batch says so. Companies stay when their last edge goes, with the name
        they had.
        """
        if self.stores["companies"].applied(batch):  # the last to be written
            return False
        aside = f"{self.path}/pending/{batch}"
        if not self._done(aside):
            self._work_out(aside, tables, gone)
        def put(table: str) -> None:
            if self._done(f"{aside}/{table}"):
                out = f"{aside}/out-{table}" if self._done(f"{aside}/out-{table}") else f"{aside}/gone" if table in _ROW else None
                keys = self.spark.read.parquet(out).toDF(KEYS[table]) if out else None
                self.stores[table].change(batch, replace=self.spark.read.parquet(f"{aside}/{table}"), remove=keys)
                if table != "companies":
                    self._forget(f"{aside}/{table}")

        _at_once(put, [t for t in self.stores if t != "companies"])
        put("companies")  # says that the batch is in
        self._forget(aside)
        return True

    def _forget(self, folder: str) -> None:
        """Deletes a folder, its mark first, so that what is left of it after a crash counts as gone."""
        store = self.stores["contracts"]
        for x in (f"{folder}/_SUCCESS", folder):
            store._fs.delete(store._path(x), True)

    def _done(self, folder: str) -> bool:
        store = self.stores["contracts"]
        return store._fs.exists(store._path(f"{folder}/_SUCCESS"))

    def _work_out(self, aside: str, tables: dict[str, DataFrame], gone: DataFrame | None) -> None:
        """Writes what each table takes of a batch: rows in place of those of their keys, and keys to take out."""

        def keep(df: DataFrame, name: str) -> DataFrame:
            save(df, f"{aside}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{aside}/{name}")

        none = {t: self.spark.createDataFrame([], ddl) for t, ddl in SCHEMAS.items()}
        gone = keep((gone if gone is not None else none["contracts"]).select("sid").distinct(), "gone")

        def merge(table: str) -> DataFrame | None:
            if table not in tables and not self.stores[table].version():
                return None
            row, new = _ROW[table], tables.get(table, none[table]).select(*none[table].columns).join(gone, "sid", "left_anti")
            if not self.stores[table].version():  # nothing to merge with
                before, after = none[table], keep(new, table)
            else:
                new = keep(new, f"new-{table}")
                sids = new.select("sid").distinct()
                before = self._of(table, sids.unionByName(gone))
                after = keep(before.join(sids, "sid", "left_semi").join(new.select(row), row, "left_anti").unionByName(new), table)
            change = keep(signed_names(before, after), "change") if table == "won" else None
            self._forget(f"{aside}/new-{table}")
            return change

        change = _at_once(merge, list(_ROW))["won"]
        change = none["names"] if change is None else change
        nifs = change.select("nif").distinct()
        counts = self._of("names", nifs).unionByName(change).groupBy("nif", "name_norm", "name_display").agg(F.sum("n").alias("n")).filter("n > 0")
        names = keep(counts, "names")
        keep(nifs.join(names.select("nif").distinct(), "nif", "left_anti"), "out-names")
        new = tables.get("companies", none["companies"]).select("nif", "is_ute")
        seen = nifs.unionByName(new.select("nif")).distinct()
        old = self._of("companies", seen)
        ute = old.select("nif", "is_ute").unionByName(new).groupBy("nif").agg(F.bool_or("is_ute").alias("is_ute"))
        # a company whose edges don't change keeps its name
        named = ute.join(top_names(names), "nif", "left").join(old.select("nif", F.col("canonical_name").alias("had")), "nif", "left")
        keep(named.select("nif", "is_ute", F.coalesce("canonical_name", "had").alias("canonical_name")), "companies")
        if "authorities" in tables:
            keep(tables["authorities"], "authorities")
        store = self.stores["contracts"]
        store._fs.create(store._path(f"{aside}/_SUCCESS"), True).close()

    def check(self) -> None:
        """Raises ValueError if two nodes share a key."""
        graph.check_unique({t: self.read(t) for t in ("companies", "contracts", "lots", "authorities")})


def of_contracts(fresh: DataFrame) -> dict[str, DataFrame]:
    """The batch of contracts as extract.contracts gives them."""
    lots = fresh.select("sid", F.explode("lot_results").alias("r")).select("sid", "r.lot_id", F.col("r.cpv").alias("cpv"))
    codes = lots.groupBy("sid", "lot_id").agg(F.array_distinct(F.flatten(F.collect_list("cpv"))).alias("cpv"))  # a contract's lots
    return batch_tables(extract.awards(fresh).join(codes, ["sid", "lot_id"], "left"), fresh)

