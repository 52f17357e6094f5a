"""Connected components by contraction within tasks, level by level, over tables of links.

Each task draws the links it has together by union-find and names a root for every node it met. A node that tasks gave
different roots links these roots: they are the links of the next level, of which there are far fewer. A level is one
shuffle and one written table, so a lost executor costs no earlier level, and a node has at most one row a task in it,
however many links it has. The number of tasks follows the number of links.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almoneda.llm.shared import materialize

#: Links that one task draws together.
LINKS_PER_TASK = 200_000
_MASK = (1 << 64) - 1


def _contract(edges: DataFrame) -> DataFrame:
    """(node, root) for every node a task meets in edges (u, v); roots are least by name, of numbers by a hash of them.

    Names that are hashes already, and hashed numbers, keep chains from being in order, which would take a level a link.
    """
    kind = edges.schema["u"].dataType.simpleString()
    hashed = not isinstance(edges.schema["u"].dataType, (T.BinaryType, T.StringType))

    def run(batches):
        up: dict = {}
        rank = (lambda x: (x * 0x9E3779B97F4A7C15 ^ x >> 7) * 0xBF58476D1CE4E5B9 & _MASK) if hashed else (lambda x: x)

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        found = None
        for batch in batches:
            found = batch.schema.types[0]
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                if rank(a) < rank(b):
                    up[b] = a
                else:
                    up[a] = b
        if up:
            nodes = list(up)
            for i in range(0, len(nodes), 50_000):
                part = nodes[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, found), pa.array([root(x) for x in part], found)], ["node", "root"])

    return edges.select("u", "v").mapInArrow(run, f"node {kind}, root {kind}")


def components(links: DataFrame, levels: int = 60) -> DataFrame:
    """(node, component) for every node in links (a, b), a written table; component is the least node reachable.

    Repeated, reversed and self links do no harm; links with a null end are ignored. Nodes of any type with an order. No
    links, no nodes.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    known: list[DataFrame] = []
    while n := edges.count():
        if len(known) == levels:
            raise RuntimeError(f"components did not settle in {levels} levels")
        stars = _contract(edges.coalesce(n // LINKS_PER_TASK + 1))
        level = stars.groupBy("node").agg(F.collect_set("root").alias("roots"))  # a root a task at most
        known.append(materialize(level.select("node", F.array_min("roots").alias("root"), "roots"), "level"))
        edges = known[-1].filter(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct()
    if not known:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = known[-1].select("node", F.col("root").alias("component"))
    for level in reversed(known[:-1]):
        above = out.select(F.col("node").alias("root"), F.col("component").alias("above"))
        out = level.select("node", "root").join(above, "root", "left").select("node", F.coalesce("above", "root").alias("component"))
    if isinstance(links.schema["a"].dataType, (T.BinaryType, T.StringType)):
        return out
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return out.join(least, "component").select("node", F.col("least").alias("component"))
