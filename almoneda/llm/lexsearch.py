"""Ranked lexical search by branch and bound over hierarchical max trees.

One reading of the texts counts what the formula needs (documents, words, documents of each asked term) and leaves the asked
terms' postings by blocks of documents. A second one builds, for each term of a block, a tree of ranges of documents whose
nodes hold the greatest contribution of a document below. A query's bound of a range is the weighted sum of its terms' nodes;
the range of the highest bound is opened first, down to documents, whose sums are exact. A query's best documents so far,
over all blocks of a task, are the bar: ranges below it stay closed, ranges that equal it are opened for ties.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from almoneda.llm import spans, textcore
from almoneda.llm.shared import discard, materialize
from almoneda.llm.textcore import U

#: A term: letters and digits of ASCII, and everything beyond ASCII. Fixed values.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
#: Documents of a block and children of a node.
BLOCK, FAN = 4096, 16
#: Items are searched in groups of at most so many items and different terms; a group's terms and weights go to every
#: task. A single item may have more terms.
GROUP_TERMS = 20_000


def item_terms(text: str | None) -> Counter:
    """The terms of an item with their repeats, A-Z lowered."""
    return Counter(x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(TERM, text or ""))


class Lexicon:
    """Numbers of the asked terms; a word is found by its hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
        starts = ends - [len(r) for r in raw]
        names = spans.hashes(data, starts, ends)
        order = np.argsort(names, kind="stable")
        self.names, self.numbers = names[order], order
        self.data, self.starts, self.sizes = data, starts, ends - starts
        if len(np.unique(names)) < len(names):
            raise ValueError("asked terms share a hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for those not asked for."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.names):
            return out
        names = spans.hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        hit = np.flatnonzero(self.names[at] == names)
        number = self.numbers[at[hit]]
        same = self.sizes[number] == ends[hit] - starts[hit]
        hit, number = hit[same], number[same]
        size = self.sizes[number]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = textcore._LOWER[data[np.repeat(starts[hit], size) + step]] == self.data[np.repeat(self.starts[number], size) + step]
        if len(hit):
            right = np.logical_and.reduceat(equal, first)
            out[hit[right]] = number[right]
        return out


def postings(docs: DataFrame, lexicon, block: int = BLOCK) -> DataFrame:
    """Blocks of at most about twice `block` documents (id, text): (ids, sizes, cuts, terms, tfs, dfs, n, l).

    sizes: terms of each document with repeats; document i's asked terms are terms[cuts[i]:cuts[i + 1]], by number, with
    tfs. n and l: documents with a term, and all terms, of the block. lexicon: a broadcast Lexicon. Only documents that hold
    an asked term are listed.
    """
    kind = docs.schema["id"].dataType

    def run(batches):
        words = lexicon.value
        held: list[tuple] = []
        listed = n = total = 0

        def done():
            ids = pa.concat_arrays([h[0] for h in held])
            sizes, docs_, terms, tfs = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
            cuts = np.searchsorted(docs_, np.arange(len(ids) + 1))
            one = lambda x, t: pa.array([x], pa.list_(t))
            listed_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [listed_ids, one(sizes, pa.int64()), one(cuts, pa.int32()), one(terms, pa.int32()), one(tfs, pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.int64())],
                ["ids", "sizes", "cuts", "terms", "tfs", "n", "l"],
            )

        for batch in (b.slice(s, block) for b in batches for s in range(0, b.num_rows, block)):
            for i, j, data, offsets in textcore.chunks(batch.column(1)):
                starts, ends, firsts = spans.runs(data, offsets, _TERM)
                sizes = np.diff(firsts)
                n, total = n + int((sizes > 0).sum()), total + len(starts)
                found = words.find(data, starts, ends)
                on = found >= 0
                width = len(words.names) + 1
                keys, tf = np.unique(spans.owners(firsts)[on] * width + found[on], return_counts=True)
                doc, term = keys // width, keys % width
                used = np.unique(doc)
                held.append((batch.column(0).slice(i, j - i).take(pa.array(used)), sizes[used], np.searchsorted(used, doc) + listed, term.astype(np.int32), tf))
                listed += len(used)
                if listed >= block:
                    yield done()
                    held, listed, n, total = [], 0, 0, 0
        if held:
            yield done()

    return docs.select("id", "text").mapInArrow(run, f"ids array<{kind.simpleString()}>, sizes array<long>, cuts array<int>, terms array<int>, tfs array<long>, n long, l long")


@dataclass
class Query:
    """An item: its terms' numbers, and the weight of each times its repeats in the item."""

    item: object
    terms: np.ndarray
    weights: np.ndarray


class MaxTrees:
    """For each term of a block a tree over ranges of its documents: level k has a node for every FAN ** (k + 1) of them,
    with the greatest contribution below."""

    def __init__(self, cuts: np.ndarray, terms: np.ndarray, values: np.ndarray, fan: int = FAN):
        self.cuts, self.terms, self.values, self.fan = cuts, terms, values, fan
        self.docs = len(cuts) - 1
        self.known, number = np.unique(terms, return_inverse=True)
        doc = np.repeat(np.arange(self.docs), np.diff(cuts))
        width = -(-max(self.docs, 1) // fan)
        low = np.zeros((len(self.known), width), np.int64)
        np.maximum.at(low, (number, doc // fan), values)
        self.levels = [low]
        while self.levels[-1].shape[1] > 1:
            last = self.levels[-1]
            padded = np.zeros((len(last), -(-last.shape[1] // fan) * fan), np.int64)
            padded[:, : last.shape[1]] = last
            self.levels.append(padded.reshape(len(last), -1, fan).max(axis=2))

    def search(self, query: Query, best: list[tuple], k: int, ids: list) -> int:
        """Puts the block's documents of positive score that belong to the query's k best into the heap `best`, of (score,
        reversed id, id); gives the number of nodes opened."""
        at = np.searchsorted(self.known, query.terms)
        here = np.flatnonzero((at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == query.terms)) if len(self.known) else np.zeros(0, np.int64)
        if not len(here):
            return 0
        rows, w = at[here], query.weights[here]
        full = np.zeros(int(self.known[-1]) + 1, np.int64)
        full[self.known[rows]] = w
        opened, top = 0, len(self.levels) - 1
        heap = [(-int(b), top, r) for r, b in enumerate(w @ self.levels[top][rows]) if b > 0]
        heapq.heapify(heap)
        while heap:
            bound, level, node = heapq.heappop(heap)
            if len(best) >= k and -bound < best[0][0]:
                break  # so are all others
            opened += 1
            first = node * self.fan
            if level:
                below = self.levels[level - 1]
                for r, b in enumerate((w @ below[rows, first : first + self.fan]).tolist()):
                    if b > 0 and (len(best) < k or b >= best[0][0]):
                        heapq.heappush(heap, (-b, level - 1, first + r))
                continue
            last = min(first + self.fan, self.docs)
            a, b = self.cuts[first], self.cuts[last]
            sums = np.concatenate([[0], np.cumsum(full[self.terms[a:b]] * self.values[a:b])])
            scores = sums[self.cuts[first + 1 : last + 1] - a] - sums[self.cuts[first:last] - a]
            for d in np.flatnonzero(scores > (best[0][0] - 1 if len(best) >= k else 0)).tolist():
                _offer(best, k, int(scores[d]), ids[first + d])
        return opened


class _Last:
    """Orders ids from last to first, nulls before all."""

    __slots__ = ("v",)

    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return (self.v is None) > (other.v is None) if self.v is None or other.v is None else self.v > other.v

    def __eq__(self, other):
        return self.v == other.v


def _offer(best: list[tuple], k: int, score: int, doc) -> None:
    entry = (score, _Last(doc))
    if len(best) < k:
        heapq.heappush(best, entry)
    elif best[0] < entry:
        heapq.heapreplace(best, entry)


def _ranked(blocks: DataFrame, queries, n: int, total: int, k: int) -> DataFrame:
    """(item, doc, score): the k best of each query among the blocks that a task reads. queries: broadcast."""
    kind, item_kind = blocks.schema["ids"].dataType.elementType, queries.kind

    def run(batches) -> Iterator[pa.RecordBatch]:
        asked = queries.sent.value
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, cuts, terms, tfs = (batch.column(c)[r].values for c in range(5))
                sizes, cuts, terms, tfs = (x.to_numpy() for x in (sizes, cuts, terms, tfs))
                m = 100 - 25 + (25 * sizes * n) // total
                trees = MaxTrees(cuts, terms, (1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, np.diff(cuts))))
                ids = ids.to_pylist()
                for q, heap in zip(asked, best):
                    trees.search(q, heap, k, ids)
        rows = [(q.item, d.v, s) for q, heap in zip(asked, best) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((queries.item_arrow, queries.doc_arrow, pa.int64()))], ["item", "doc", "score"])

    return blocks.select("ids", "sizes", "cuts", "terms", "tfs").mapInArrow(run, f"item {item_kind}, doc {kind.simpleString()}, score long")


@dataclass
class _Asked:
    sent: object
    kind: str
    item_arrow: pa.DataType
    doc_arrow: pa.DataType


def _groups(items: DataFrame, most: int) -> Iterator[list[tuple[object, Counter]]]:
    """The items (item, text) in groups of at most `most` items and different terms; the driver holds one group."""
    held, seen = [], set()
    for r in items.toLocalIterator():
        terms = item_terms(r.text)
        if held and (len(held) >= most or len(seen | terms.keys()) > most):
            yield held
            held, seen = [], set()
        held.append((r.item, terms))
        seen |= terms.keys()
    if held:
        yield held


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 20, group_terms: int = GROUP_TERMS, block: int = BLOCK,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest positive score, equal ones by id.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms, tf of them this one, adds the weight
    times (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, for each time the item has the term.

    - Null and empty texts have no terms and aren't counted; items without terms have no rows. Texts are read whole.
    - Documents that repeat an id are ranked each on its own; a null id is last among equals. Items that repeat an id are
      ranked together: the k best pairs of such an item and a document.
    - Other columns are left aside, whatever their names. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    kinds = {x: asked.schema["item"].dataType if x == "item" else plain.schema["id"].dataType for x in ("item", "id")}
    found = []
    for group in _groups(asked, group_terms):
        terms = sorted(set().union(*[c.keys() for _, c in group]))
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        blocks = materialize(postings(plain, spark.sparkContext.broadcast(Lexicon(terms)), block), "postings")
        n, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
        df = dict(blocks.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most group_terms rows
        weight = np.array([floor(1000 * log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        queries = []
        for item, counts in group:
            at = np.array(sorted(number[t] for t in counts), np.int64)
            queries.append(Query(item, at, weight[at] * np.array([counts[terms[i]] for i in at], np.int64)))
        sent = _Asked(spark.sparkContext.broadcast(queries), kinds["item"].simpleString(), to_arrow_type(kinds["item"]), to_arrow_type(kinds["id"]))
        found.append(materialize(_ranked(blocks, sent, n, total, k), "ranked"))
        discard(blocks)
    if not found:
        return asked.limit(0).join(plain.limit(0), F.lit(True)).select(F.col("item").alias("item_id"), F.lit(1).alias("rank"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item; edge rows as lexical_search says."""
    return lexical_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = rf"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
d AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM low WHERE len(w) > 0),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS t FROM benchmark) GROUP BY item_id, t),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p, c GROUP BY t, nn),
x AS (SELECT p.rid, d.doc_id, p.t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * d.n * nn) // ll)) AS v FROM p JOIN d ON d.rid = p.rid, c),
s AS (SELECT item_id, rid, doc_id, CAST(sum(times * wt * v) AS BIGINT) AS score FROM q JOIN x USING (t) JOIN f USING (t) GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""
