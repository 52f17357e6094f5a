"""Near-duplicate documents by SetSketch registers of word shingles, verified on the full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoneda.llm import textcore
from almoneda.llm.setsketch import SetSketch
from almoneda.llm.shared import free_name, materialize, spread_join
from almoneda.llm.simjoin import link_groups

SHINGLE = 5


def text_hash(text: str) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col(text)).alias("text_hash")


def sketches(docs: DataFrame, sketch: SetSketch, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, node, short, n, sig) for each row of docs (doc_id, text).

    node names the set by 128 bits, short by the first 64 of them; both are null where it is empty.
    """

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in textcore.chunks(batch.column(1)):
                node, size, sig = [], [], []
                for s in textcore.shingle_sets(data, offsets, shingle):
                    size.append(len(s))
                    node.append(textcore.set_key(s) if len(s) else None)
                    sig.append(sketch.registers(s).tobytes() if len(s) else None)
                short = [None if x is None else int.from_bytes(x[:8], "big", signed=True) for x in node]
                arrays = [pa.array(node, pa.binary()), pa.array(short, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *arrays], ["doc_id", "text_hash", "node", "short", "n", "sig"])

    return docs.select("doc_id", "text", text_hash("text")).mapInArrow(run, "doc_id long, text_hash long, node binary, short long, n int, sig binary")


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, sketch: SetSketch = SetSketch(), shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of docs; other columns are left aside.

    Two documents are linked when den * |intersection| >= num * |union| of their sets of distinct word shingles (A-Z
    lowered; a text of fewer words is one shingle). component_id is the least doc_id reachable over links; kept is
    doc_id = component_id.

    - Null and empty texts, or texts without words, have an empty set: linked with nothing and kept.
    - Equal sets are one node, however many rows hold them, so copies cost one row each.
    - Rows that repeat a doc_id are judged each by its own text; those that hold the least doc_id of their group are all
      kept. A null doc_id is never the least; a group without any other has a null component_id, and of it the rows of
      the least text_hash are kept.
    - An empty table gives an empty table.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(sketches(plain, sketch, shingle), "sketches")
    holder = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    merged = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("short").alias("short"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(holder).alias("least"), F.count("*").alias("rows"))
    nodes = materialize(merged, "nodes")

    def texts_of(needed: DataFrame) -> DataFrame:
        """A row that holds the set: its text hash tells it from others of its id."""
        at = nodes.join(needed, "node", "left_semi").select("node", F.col("least.doc_id").alias("holder"), F.col("least.text_hash").alias("holder_hash"))
        found = plain.withColumn("text_hash", text_hash("text")).join(at.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("text_hash") == F.col("holder_hash")))
        return found.select("node", "text").dropDuplicates(["node"])

    labels = link_groups(
        nodes, texts_of, lambda d, o: textcore.shingle_sets(d, o, shingle), sketch.band_keys, sketch.bands,
        lambda ru, rv, nu, nv: sketch.plausible(ru, rv, nu, nv, num / den), np.uint16, num, den,
    )
    linked = materialize(nodes.select("node", "least", "rows").join(labels, "node"), "linked")
    leasts = materialize(linked.groupBy("component").agg(F.min("least").alias("group"), F.count("*").alias("nodes")), "leasts")
    groups = spread_join(linked.drop("least"), leasts, ["component"], "nodes").select("node", "group", "rows")
    alone = nodes.join(labels, "node", "left_anti").select("node", F.col("least").alias("group"), "rows")
    groups = materialize(groups.unionByName(alone), "groups")
    full = spread_join(rows.filter("node IS NOT NULL").select("doc_id", "text_hash", "n", "node"), groups, ["node"], "rows")
    of_group = F.col("doc_id").eqNullSafe(F.col("group.doc_id")) & (F.col("doc_id").isNotNull() | (F.col("text_hash") == F.col("group.text_hash")))
    n = F.col("n").cast("long").alias("n_shingles")
    full = full.select("doc_id", n, F.col("group.doc_id").alias("component_id"), of_group.alias("kept"), "text_hash")
    empty = rows.filter("node IS NULL").select("doc_id", n, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash")
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps; of rows with one doc_id and text, one."""
    mark, of_id, of_hash = (free_name(docs.columns, x) for x in ("__text_hash", "__id", "__hash"))
    kept = materialize(near_duplicates(docs, num, den, doc_id=doc_id, text=text).filter("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "kept")
    keys = kept.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash))
    found = docs.withColumn(mark, text_hash(text)).join(keys.hint("shuffle_hash"), F.col(doc_id).cast("long").eqNullSafe(F.col(of_id)) & (F.col(mark) == F.col(of_hash)), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        found = found.dropDuplicates([doc_id, mark])
    return found.drop(mark)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """All documents at a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85, 100).drop("text_hash")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n_shingles + y.n_shingles - i)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d),
c AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.d = n.doc_id
"""
