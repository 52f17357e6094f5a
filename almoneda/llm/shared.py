"""Folders and tables that survive lost executors, and small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: At most so many keys can each have more than one in HOT_KEYS of all rows; such keys may be broadcast.
HOT_KEYS = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; on a
    cluster that would be a folder of one machine, so it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="almoneda-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/almoneda/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here, and lost executors cost nothing.

    Later plans read only the columns they need, which a checkpoint() of rows could not give. Once the table is written,
    Spark removes the shuffle files that led to it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote and nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._table_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """The inner join of two written tables; right has one row a key, and its column `rows` counts left's rows of it.

    Keys that have more than one in HOT_KEYS of all rows are fewer than HOT_KEYS. They are broadcast, so the rows of a hot
    key stay in the tasks that read them; the other keys are joined by a shuffle.
    """
    total, most = right.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    if most * HOT_KEYS <= total or most < 200:
        return left.join(right, on)
    is_hot = (F.col(rows) * HOT_KEYS > total) & (F.col(rows) >= 200)
    hot = right.filter(is_hot)
    cold = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.filter(~is_hot), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) whatever the columns' names: those with dots are no names to it."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    names = plain.names

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*schema.names)


def n_words(text: Column | str) -> Column:
    """Words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(taken: list[str], wish: str) -> str:
    """`wish`, with underscores appended until no column has that name (names match without case, as in Spark)."""
    low = {x.lower() for x in taken}
    while wish.lower() in low:
        wish += "_"
    return wish
