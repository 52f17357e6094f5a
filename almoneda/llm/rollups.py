"""Token counts kept up to date by signed deltas, in batches that commit once. DataFrame functions only.

A change is an insert, a delete or a revision of a document's count under a tokenizer version. It becomes signed rows: +1
document and +tokens for what comes, -1 and -tokens for what goes. Their sums by source, language and version are
additive, so a batch adds a few rows to the store whatever its size, and totals are sums over batches.

A batch's sums are one small table, and its commit is the next entry of a log, a small file renamed into place: the batch is
there as a whole or not at all, and never twice. Now and then the totals so far are written with the number of the last entry
in them; totals are then read from there, and from the entries since. What a commit or a reading costs doesn't depend on how
many batches came before.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda.llm.shared import WORD, discard, map_rows, materialize, new_path, spread_join

KEYS = ["source", "lang", "version"]
SUMS = ["docs", "tokens"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"
#: Native counters by tokenizer version: words, and letters, digits or single marks in runs. Fixed patterns.
COUNTERS = {"words-1": WORD, "pieces-1": r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text by one of COUNTERS, as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[version])), F.lit(0)).cast("long")


def count_with_tokenizer(docs: DataFrame, path: str, text: str = "text", count_col: str = "tokens") -> DataFrame:
    """docs with the tokens of each text by the tokenizer file at `path` (JSON of the tokenizers library), as last column.

    The file must be at that path on every executor. Null texts count 0.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from almoneda.llm.shared import free_name

    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs.columns, count_col), T.LongType())])
    at = docs.columns.index(text)

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or Tokenizer.from_file(path)
            for i in range(0, batch.num_rows, 200):
                p = batch.slice(i, 200)
                found = [len(tokenizer.encode(x.as_py(), add_special_tokens=False).ids) if x.is_valid else 0 for x in p.column(at)]
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(found, pa.int64())], schema.names)

    return map_rows(docs, run, schema)


def signed_rows(changes: DataFrame) -> DataFrame:
    """Signed rows (source, lang, version, docs, tokens) of changes (op, old, new).

    old and new are structs (source, lang, version, tokens): old is what the store counts so far, new what it shall
    count. insert takes new, delete takes old, revise takes both; a revision may change any of the four. Null tokens
    count 0, and a null op or a null struct where one is needed adds nothing. Null sources, languages and versions are
    groups of their own.
    """
    side = lambda name, sign: F.struct(F.col(f"{name}.source").alias("source"), F.col(f"{name}.lang").alias("lang"), F.col(f"{name}.version").alias("version"), F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col(f"{name}.tokens"), F.lit(0)) * sign).cast("long").alias("tokens"))
    comes = F.when(F.col("op").isin("insert", "revise") & F.col("new").isNotNull(), F.array(side("new", 1)))
    goes = F.when(F.col("op").isin("delete", "revise") & F.col("old").isNotNull(), F.array(side("old", -1)))
    none = F.array().cast(f"array<struct<{SCHEMA.replace(' string', ':string').replace(' long', ':long')}>>")
    return changes.select(F.inline(F.concat(F.coalesce(comes, none), F.coalesce(goes, none))))


def rollup(rows: DataFrame) -> DataFrame:
    """Sums by source, language and version; summed in each task before the shuffle."""
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Store:
    """Totals in a folder that driver and executors share, on a file system with atomic renames.

    data/<name>: the sums of a batch. log/<thousand>/<number>: an entry, which holds a batch's id and that name. totals/<name>:
    sums of all entries up to one; versions/<number> holds that name and the entry's number. ids/<part>/<batch>: says that a
    batch has an entry; each entry that is in a version has one.
    """

    #: Entries a folder of the log, and versions that are kept.
    FOLDER, KEPT = 1000, 8

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 32):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        jvm = spark._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)

    def _names(self, folder: str) -> list[str]:
        root = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _put(self, folder: str, name: str, content: str) -> bool:
        """Writes a small file as a whole; False if it is there already. A rename that may not replace decides a race."""
        aside, final = self._path(f"{self.path}/.aside/{uuid.uuid4().hex}"), self._path(f"{self.path}/{folder}/{name}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray(content.encode()))
        out.close()
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._files.rename(aside, final, kinds)
        except Exception:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def _get(self, folder: str, name: str) -> str:
        return self._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._path(f"{self.path}/{folder}/{name}")), "UTF-8")

    def _has(self, folder: str, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{folder}/{name}"))

    @staticmethod
    def _marker(batch: str) -> str:
        """Folder of a batch's id."""
        return f"ids/{zlib.crc32(batch.encode()) % 4096:03x}"

    def _entry(self, number: int) -> tuple[str, str]:
        return f"log/{number // self.FOLDER:09d}", f"{number:012d}"

    def _since(self) -> tuple[int, str | None, int, list[tuple[str, str]]]:
        """Number, totals and last entry of the last version, and (batch, name) of the entries since, in order."""
        versions = self._names("versions")
        totals, last = self._get("versions", versions[-1]).split("\n") if versions else (None, "-1")
        found, number = [], int(last) + 1
        while True:
            folder = self._entry(number)[0]
            there = [n for n in self._names(folder) if int(n) >= number]
            found += [tuple(self._get(folder, n).split("\n")) for n in there]
            number += len(there)
            if not there or number % self.FOLDER:
                return int(versions[-1]) if versions else 0, totals, int(last), found

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if a batch of that id is there already, and then no changes are read or written.

        Of two commits of one id at the same time one wins; the other returns False, and its sums count for nothing.
        """
        if not batch or any(c in batch for c in "/=:\\ \n") or batch[0] in "._":
            raise ValueError("a batch id has no slashes, colons, blanks, line ends or equals signs, and starts with no dot or underscore")
        _, _, last, since = self._since()
        # Entries up to `last` had their ids marked before the version was written; the others are at hand.
        if batch in dict(since) or self._has(self._marker(batch), batch):
            return False
        name, number = uuid.uuid4().hex, last + 1 + len(since)
        rollup(signed_rows(changes)).write.parquet(f"{self.path}/data/{name}")
        while not self._put(*self._entry(number), f"{batch}\n{name}"):
            if self._get(*self._entry(number)).split("\n")[0] == batch:
                self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
                return False
            number += 1  # another batch took it: no number is passed unseen
        self._put(self._marker(batch), batch, name)
        if len(since) + 1 >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> bool:
        """Adds the entries since the last version to its totals; False if another process wrote the same version first."""
        version, totals, last, since = self._since()
        if not since:
            return False
        name = uuid.uuid4().hex
        self._sums(totals, since).write.parquet(f"{self.path}/totals/{name}")
        for batch, data in since:
            self._put(self._marker(batch), batch, data)  # a commit that was cut off may have left it out
        if not self._put("versions", f"{version + 1:012d}", f"{name}\n{last + len(since)}"):
            return False
        for old in self._names("versions")[: -self.KEPT]:
            self._fs.delete(self._path(f"{self.path}/versions/{old}"), False)
        return True

    def _sums(self, totals: str | None, since: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{self.path}/data/{name}" for _, name in since] + ([f"{self.path}/totals/{totals}"] if totals else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return rollup(self.spark.read.schema(SCHEMA).parquet(*paths))

    def totals(self) -> DataFrame:
        """The totals kept so far and the batches since; groups whose documents and tokens are both back at 0 are left out."""
        _, totals, _, since = self._since()
        return self._sums(totals, since).filter("docs <> 0 OR tokens <> 0")


def op10_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents after three batches, each committed twice.

    1. Every document comes, counted by words-1. 2. Of documents with one text all but the one of least id go. 3. What
    is left is counted anew by pieces-1.

    - Null texts count as empty ones. A null id is never the least; a text that only null ids have keeps each of them. Rows
      that repeat the least id of a text all stay. An empty table has no totals.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    count = lambda version: F.struct("source", "lang", F.lit(version).alias("version"), count_tokens(F.col("text"), version).alias("tokens"))
    # A copy is known by its text's SHA-256; ids and counts travel, texts don't.
    marked = materialize(docs.select("doc_id", count("words-1").alias("w"), count("pieces-1").alias("p"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("h")), "counts")
    least = materialize(marked.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "least")
    ruled = materialize(spread_join(marked, least, ["h"], "rows").select("w", "p", F.col("doc_id").eqNullSafe(F.col("least")).alias("stays")), "ruled")
    none = F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>")
    store = Store(spark, new_path(spark, "rollups"), compact_after=2)
    for _ in range(2):
        store.commit("1-insert", ruled.select(F.lit("insert").alias("op"), none.alias("old"), F.col("w").alias("new")))
        store.commit("2-delete", ruled.filter("NOT stays").select(F.lit("delete").alias("op"), F.col("w").alias("old"), none.alias("new")))
        store.commit("3-revise", ruled.filter("stays").select(F.lit("revise").alias("op"), F.col("w").alias("old"), F.col("p").alias("new")))
    discard(marked, least)
    return store.totals()


ORACLE_SQL = r"""
SELECT source, lang, 'pieces-1' AS version, count(*) AS docs, CAST(sum(coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')), 0)) AS BIGINT) AS tokens
FROM documents d WHERE doc_id = (SELECT min(doc_id) FROM documents e WHERE coalesce(e.text, '') = coalesce(d.text, '')) GROUP BY source, lang
"""
