"""A table of rows by key as a log of small files: upserts, inserts and deletes without a transactional format.

Keys are dealt to parts by the leading bits of their hash. A commit adds a file of its rows alone to each part that it touches;
deletes are rows too. Reading merges a part's files by commit order, and parts that have one file are read as they are. A part
with many files has the newest of them joined, each file only with ones of its own size, and the whole part written anew only
once what was added is a share of it; parts that grow are then split by one more bit.

The log has one small file a commit, which a rename that may not replace puts in place, so two writers never take one number.
"""

from __future__ import annotations

import json
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def workspace(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; on
    a cluster that would be a folder of one machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="almoneda-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/almoneda/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying, _tidying_lock = {}, threading.Lock()


@contextmanager
def tidy(spark: SparkSession):
    """While this is open, by any number of threads, Spark removes a query's shuffle files once it has ended."""
    key = spark._jsparkSession.sessionUUID()
    with _tidying_lock:
        n, before = _tidying.get(key) or (0, spark.conf.get(_CLEANUP))
        spark.conf.set(_CLEANUP, "true")
        _tidying[key] = n + 1, before
    try:
        yield
    finally:
        with _tidying_lock:
            n, before = _tidying.pop(key)
            if n > 1:
                _tidying[key] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, path: str, *by: str) -> None:
    """Writes df as Parquet in place of what is there; the shuffle files that led to it go."""
    with tidy(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back, for tables that a plan uses more than once."""
    path = workspace(df.sparkSession, tag)
    save(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that `written` wrote and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Conflict(RuntimeError):
    """Another writer changed a part since it was read."""


#: What a row does to the rows of its key in earlier commits. Fixed values.
ADD, REPLACE, REMOVE = 0, 1, 2
_HASH_BITS = 31
#: Commits between two files of the whole state, which bounds how much of the log is read.
_STATE_EVERY = 16


class SnapshotStore:
    """Rows by key. `depth`: bits of the hash that number the parts at first.

    A part's files are joined once there are more than `most_files` additions, the whole part once they hold a `share` of
    its rows, and parts are split once they hold more than `part_rows` on average.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "sid", depth: int = 4, most_files: int = 8, share: float = 0.25, part_rows: int = 4_000_000):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.depth, self.most_files, self.share, self.part_rows = depth, most_files, share, part_rows
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = hadoop.FileContext.getFileContext(self._path(self.path).toUri(), spark._jsc.hadoopConfiguration())

    # --- the log

    def _names(self, folder: str) -> list[str]:
        root = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, folder: str, name: str, content: str) -> bool:
        """Writes a small file as a whole; False if it is there already."""
        aside, final = self._path(f"{self.path}/aside/{uuid.uuid4().hex}"), self._path(f"{self.path}/{folder}/{name}")
        out = self._fs.create(aside, True)
        out.write(bytearray(content.encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        try:
            self._files.rename(aside, final, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            self._fs.delete(aside, True)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def _state(self) -> dict:
        """n: the last commit; depth; files: what the table consists of; recent: batches of the commits since the last
        file of the whole state; dropped: folders no longer part of it, by commit."""
        names = self._names("log")
        whole = [x for x in names if x.endswith(".state")]
        state = json.loads(self._text(f"log/{whole[-1]}")) if whole else {"n": 0, "depth": self.depth, "files": [], "dropped": {}}
        state["recent"] = {}
        state["dropped"] = {k: n for k, n in state["dropped"].items() if n > state["n"] - 256}  # older ones are told by their age
        for x in (x for x in names if x.endswith(".json")):
            if int(x.split(".")[0]) > state["n"]:
                self._play(state, json.loads(self._text(f"log/{x}")))
        return state

    @staticmethod
    def _play(state: dict, entry: dict) -> None:
        state["n"], state["depth"] = entry["n"], entry["depth"]
        known = {f["name"] for f in state.setdefault("fields", [])}
        state["fields"] += [f for f in entry["fields"] if f["name"] not in known]
        gone = {(f["folder"], f["part"]) for f in entry["removes"]}
        state["files"] = [f for f in state["files"] if (f["folder"], f["part"]) not in gone] + entry["adds"]
        live = {f["folder"] for f in state["files"]}
        state["dropped"] |= {f["folder"]: entry["n"] for f in entry["removes"] if f["folder"] not in live}
        state["recent"][entry["n"]] = entry["batch"]

    def _commit(self, batch: str | None, depth: int, adds: list[dict], removes: list[dict], since: int | None = None, schema: T.StructType | None = None) -> int:
        """Puts a commit at the end of the log. since: the commit that was read; a later one of the same parts is a
        conflict, as is one that removed what this removes."""
        while True:
            state = self._state()
            if batch is not None and self._known(state, batch):
                raise Conflict(f"batch {batch} is there already")
            if any(not f["whole"] and f["depth"] < state["depth"] for f in adds):
                raise Conflict("parts were split meanwhile")
            for k in range(since + 1, state["n"] + 1) if since is not None else ():
                other = json.loads(self._text(f"log/{k:012d}.json"))  # a join of files changes no rows
                if other["batch"] is not None and any(_meet((a["depth"], a["part"]), (b["depth"], b["part"])) for a in adds for b in other["adds"] + other["removes"]):
                    raise Conflict("a part was changed meanwhile")
            live = {(f["folder"], f["part"]) for f in state["files"]}
            if any((f["folder"], f["part"]) not in live for f in removes):
                raise Conflict("a file was joined meanwhile")
            n = state["n"] + 1
            entry = {"n": n, "batch": batch, "depth": max(depth, state["depth"]), "adds": [{**f, "n": n} if f["n"] is None else f for f in adds], "removes": removes, "fields": schema.jsonValue()["fields"] if schema else []}
            if not self._put("log", f"{n:012d}.json", json.dumps(entry)):
                continue
            if batch is not None:
                self._put("applied", batch, "")
            if n % _STATE_EVERY == 0:
                self._play(state, entry)
                for x in state.pop("recent").values():  # a crash may have left out their marks
                    if x is not None:
                        self._put("applied", x, "")
                self._put("log", f"{n:012d}.state", json.dumps(state))
            return n

    def _known(self, state: dict, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/applied/{batch}")) or batch in state["recent"].values()

    def versions(self) -> list[tuple[int, str]]:
        """(commit, folder) of the folders with rows that are part of the table, or were."""
        state = self._state()
        return sorted({(f["n"], f["folder"]) for f in state["files"]} | {(n, folder) for folder, n in state["dropped"].items()})

    def commits(self) -> DataFrame:
        """(n, batch, rows, files): what each commit wrote; a null batch joined files."""
        log = [json.loads(self._text(f"log/{x}")) for x in self._names("log") if x.endswith(".json")]
        return self.spark.createDataFrame([(e["n"], e["batch"], sum(f["rows"] for f in e["adds"]), len(e["adds"])) for e in log], "n long, batch string, rows long, files int")

    def version(self) -> int:
        """The number of the last commit."""
        return self._state()["n"]

    def applied(self, batch: str) -> bool:
        return self._known(self._state(), batch)

    # --- parts

    def _hash(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(1 << _HASH_BITS)).cast("int")

    def _part(self, depth: int) -> Column:
        return F.shiftright(self._hash(), _HASH_BITS - depth)

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts that hold the keys of rows; no more numbers than there are parts."""
        return [r[0] for r in rows.select(self._part(self._state()["depth"])).distinct().collect()]

    def _groups(self, state: dict) -> dict[tuple[int, int], list[dict]]:
        """Files by part, oldest first. A part is what its oldest whole file covers; later files may cover less of it."""
        roots = {(f["depth"], f["part"]) for f in state["files"] if f["whole"]}
        out: dict[tuple[int, int], list[dict]] = {}
        for f in state["files"]:
            up = next((r for d in range(f["depth"] + 1) if (r := (d, f["part"] >> (f["depth"] - d))) in roots), None)
            out.setdefault(up or (self._first(state), f["part"] >> max(0, f["depth"] - self._first(state))), []).append(f)
        return {k: sorted(v, key=lambda f: f["n"]) for k, v in out.items()}

    @staticmethod
    def _first(state: dict) -> int:
        return min((f["depth"] for f in state["files"]), default=state["depth"])

    @staticmethod
    def _schema(state: dict) -> T.StructType:
        """The columns of all commits, in order of appearance."""
        return T.StructType.fromJson({"type": "struct", "fields": [{**f, "nullable": True} for f in state["fields"]]})

    def _raw(self, state: dict, files: list[dict]) -> DataFrame:
        """The rows of files with `_op` and `_n`, the commit they came with."""
        paths = [f"{self.path}/data/{f['folder']}/_part={f['part']}" for f in files]
        rows = self.spark.read.schema(self._schema(state).add("_op", "byte").add("_n", "long")).parquet(*paths)
        commits = {f["folder"]: f["n"] for f in files}
        order = self.spark.createDataFrame(pa.table({"_folder": pa.array(list(commits), pa.string()), "_commit": pa.array(commits.values(), pa.int64())}))  # no tasks make it
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/_part=\d+/[^/]*$", 1)
        named = rows.select("*", folder.alias("_folder")).join(F.broadcast(order), "_folder")  # a row a folder
        return named.withColumn("_n", F.coalesce("_n", "_commit")).drop("_folder", "_commit")

    def _merged(self, rows: DataFrame, marks: bool = False) -> DataFrame:
        """Rows that no later commit replaced or removed; with marks, also the last removal or replacement of each key."""
        last = rows.filter(F.col("_op") != ADD).groupBy(F.col(self.key).alias("_key")).agg(F.max("_n").alias("_last"))
        held = rows.join(last, F.col(self.key).eqNullSafe(F.col("_key")), "left").filter(F.coalesce(F.col("_n") >= F.col("_last"), F.lit(True))).drop("_key", "_last")
        return held.dropDuplicates([self.key, "_op", "_n"]).filter(F.col("_op") == REMOVE).unionByName(held.filter(F.col("_op") != REMOVE)) if marks else held.filter(F.col("_op") != REMOVE)

    def _read(self, state: dict, groups: dict[tuple[int, int], list[dict]]) -> DataFrame | None:
        plain = [f for g in groups.values() if len(g) == 1 for f in g]
        mixed = [f for g in groups.values() if len(g) > 1 for f in g]
        out = [self._raw(state, plain).filter(F.col("_op") != REMOVE)] if plain else []
        out += [self._merged(self._raw(state, mixed))] if mixed else []
        if not out:
            return None
        return (out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)).drop("_op", "_n")

    def read(self, schema=None, parts: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some parts. Without any: an empty table if a schema is given or known, else None."""
        state = self._state()
        groups = self._groups(state)
        if parts is not None:
            groups = {k: v for k, v in groups.items() if any(p >> (state["depth"] - k[0]) == k[1] for p in parts)}
        found = self._read(state, groups)
        if found is not None and parts is not None and groups:
            found = found.filter(self._part(state["depth"]).isin(parts)) if len(parts) <= 1000 else found
        if found is not None:
            return found
        if schema is None and state.get("fields"):
            schema = self._schema(state)
        if schema is None and self._fs.exists(self._path(f"{self.path}/schema")):
            schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.createDataFrame([], schema) if schema is not None else None

    def rows_of(self, keys: DataFrame) -> DataFrame | None:
        """The rows whose key is in `keys` (one column); only their parts are read."""
        found = self.read(parts=self.touched(keys.toDF(self.key)))
        return found.join(keys.toDF(self.key).distinct(), self.key, "left_semi") if found is not None else None

    def ensure(self, schema) -> bool:
        """Makes the table if it isn't there; False if it is."""
        if self._names("log") or self._fs.exists(self._path(f"{self.path}/schema/_SUCCESS")):
            return False
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/schema")
        return True

    # --- changes

    def _write(self, rows: DataFrame, depth: int, whole: bool, n: int | None = None) -> list[dict]:
        """Rows with `_op` and `_n` in a folder of their own, a file a part; what the log says of them."""
        folder = uuid.uuid4().hex
        out = rows.withColumn("_part", self._part(depth))
        save(out.hint("rebalance", "_part"), f"{self.path}/data/{folder}", "_part")
        if not any(x.startswith("_part=") for x in self._names(f"data/{folder}")):
            return []
        back = self.spark.read.parquet(f"{self.path}/data/{folder}").groupBy("_part").agg(F.count("*").alias("rows")).collect()  # one a part
        return [{"folder": folder, "depth": depth, "part": r["_part"], "rows": r["rows"], "whole": whole, "n": n} for r in back]

    def change(self, batch: str, replace: DataFrame | None = None, remove: DataFrame | None = None, add: DataFrame | None = None, since: int | None = None) -> bool:
        """One commit: rows in place of those of the same key, keys to remove (absent ones tolerated), rows beside what is
        there; False if the batch is there already.

        since: the number of the commit that the rows were made from; raises Conflict if their parts changed after it.
        Only these rows are written. Then parts that are due are joined.
        """
        if self.applied(batch):
            return False
        marked = []
        for df, op in ((add, ADD), (replace, REPLACE), (remove, REMOVE)):
            if df is not None:
                marked.append((df.select(self.key) if op == REMOVE else df).withColumn("_op", F.lit(op).cast("byte")))
        rows = marked[0]
        for more in marked[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        schema = rows.drop("_op").schema
        while True:
            depth = self._state()["depth"]
            files = self._write(rows.withColumn("_n", F.lit(None).cast("long")), depth, False)
            try:
                self._commit(batch, depth, files, [], since, schema)
                break
            except Conflict:
                self._forget(files)
                if self.applied(batch):
                    return False
                if since is not None:
                    raise
        self.compact()
        return True

    def _forget(self, files: list[dict]) -> None:
        for folder in {f["folder"] for f in files}:
            self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)

    def insert(self, rows: DataFrame, batch: str) -> bool:
        """Rows beside what is there, whatever their keys; False if the batch is there already."""
        return self.change(batch, add=rows)

    def upsert(self, rows: DataFrame, batch: str) -> bool:
        """Rows in place of those of the same key; False if the batch is there already."""
        return self.change(batch, replace=rows)

    def delete(self, keys: DataFrame, batch: str) -> bool:
        """What is there less some keys, absent ones tolerated; False if nothing is there or the batch is."""
        return bool(self._state()["files"]) and self.change(batch, remove=keys)

    def replace(self, df: DataFrame, batch: str) -> bool:
        """df as all there is."""
        state = self._state()
        if self._known(state, batch):
            return False
        files = self._write(df.withColumns({"_op": F.lit(REPLACE).cast("byte"), "_n": F.lit(None).cast("long")}), state["depth"], True)
        self._commit(batch, state["depth"], files, state["files"], schema=df.schema)
        return True

    # --- upkeep

    def _due(self, group: list[dict]) -> tuple[str, list[dict]] | None:
        """What to join of a part's files: all of them, or the newest that are of a size."""
        added = [f for f in group if not f["whole"]]
        base = sum(f["rows"] for f in group) - sum(f["rows"] for f in added)
        if len(added) > self.most_files and sum(f["rows"] for f in added) >= self.share * base:
            return "whole", group
        if len(added) <= self.most_files:
            return None
        newest, total = [added[-1]], added[-1]["rows"]
        for f in reversed(added[:-1]):
            if len(newest) >= 2 and f["rows"] > 2 * total:
                break
            newest.insert(0, f)
            total += f["rows"]
        return "newest", newest

    def compact(self, everything: bool = False) -> int:
        """Joins the files of parts that are due, or of all that have several; how many files went."""
        state = self._state()
        groups = self._groups(state)
        due = {k: ("whole", g) if everything else self._due(g) for k, g in groups.items() if len(g) > 1}
        due = {k: v for k, v in due.items() if v}
        gone = 0
        for kind in ("whole", "newest"):
            files = [f for k, g in due.values() if k == kind for f in g]
            if not files:
                continue
            depth = state["depth"]
            if kind == "whole":
                total = sum(f["rows"] for f in state["files"])
                while total > self.part_rows << depth and depth < _HASH_BITS - 1:
                    depth += 1
            rows = self._merged(self._raw(state, files), marks=kind == "newest")
            last = max(f["n"] for f in files)
            if kind == "whole":
                rows = rows.withColumns({"_op": F.lit(REPLACE).cast("byte"), "_n": F.lit(last).cast("long")})
            made = self._write(rows, depth, kind == "whole", last)
            try:
                self._commit(None, depth, made, files)
                gone += len(files)
            except Conflict:  # the next commit tries again
                self._forget(made)
        return gone

    def vacuum(self, keep: int = 2, grace: float = 3600.0) -> int:
        """Deletes folders that no row of the table is in, but for those dropped by the last `keep` commits, and unfinished
        ones older than `grace` seconds; returns how many went. Their batches stay known as applied."""
        state = self._state()
        live = {f["folder"] for f in state["files"]} | {x for x, n in state["dropped"].items() if n > state["n"] - keep + 1}
        gone = 0
        for x in self._names("data"):
            path = self._path(f"{self.path}/data/{x}")
            old = x in state["dropped"] or self._fs.getFileStatus(path).getModificationTime() < (time.time() - grace) * 1000
            if x not in live and old:
                self._fs.delete(path, True)
                gone += 1
        return gone


def _meet(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two parts (depth, number) share keys."""
    d = min(a[0], b[0])
    return a[1] >> (a[0] - d) == b[1] >> (b[0] - d)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has: what a uniqueness constraint would reject."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
