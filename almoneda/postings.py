"""An inverted index whose postings lie in blocks with score bounds, so that the best documents are found without reading all.

A segment's documents are dealt to ranges of about `range_docs` documents of like length. A row holds the postings of one term
in one range, so a frequent term is many rows, however frequent it is, and rows are sorted by term and range: a query reads
the row groups of its terms. Beside the postings a row says what its documents score at most, for any mean length.

A search adds the bounds of each range, scores the ranges of highest bounds, more of them while that raises the
score of the page's last row, and then those alone whose bound reaches that score. Documents are added as new segments, of which the smallest are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda.search import B, K1, n_tokens, plain_terms, score_terms, tokens, top
from almoneda.store import written

#: Ranges that go out to all tasks by name; more are joined.
MOST_BROADCAST = 100_000
#: Documents whose terms are counted at once.
DOCS = 512


def _weight(n: int, df: int) -> Column:
    return F.ln(1 + (F.lit(n) - F.lit(df) + 0.5) / (F.lit(df) + 0.5))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl, term, tf) of documents (doc_id, words). A document is one row, so its terms are counted where it is."""
    for batch in batches:
        for i in range(0, batch.num_rows, DOCS):
            p = batch.slice(i, DOCS)
            dl = p.column(1).value_lengths().to_numpy(zero_copy_only=False)
            words = p.column(1).flatten().dictionary_encode()
            many = max(len(words.dictionary), 1)
            found, tf = np.unique(np.repeat(np.arange(p.num_rows), dl) * many + words.indices.to_numpy(), return_counts=True)
            doc = found // many
            yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(doc)), pa.array(dl[doc], pa.int32()), words.dictionary.take(pa.array(found % many)), pa.array(tf, pa.int32())], ["doc_id", "dl", "term", "tf"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, place, df, peaks, posts) of postings (term, place, doc_id, tf, dl) that are sorted by term and place.

    peaks: of the postings of like frequency the highest frequency and the least length: no posting scores more than these.
    """
    held: list[pa.RecordBatch] = []

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        term, place, doc, tf, dl = (c.chunk(0) for c in rows.columns)
        ends = np.append(starts, rows.num_rows)
        group, n, length = np.repeat(np.arange(len(starts)), np.diff(ends)), tf.to_numpy(), dl.to_numpy()
        level = group * 32 + np.log2(n).astype(int)
        order = np.argsort(level, kind="stable")
        first = np.flatnonzero(np.diff(level[order], prepend=-1))
        peaks = pa.StructArray.from_arrays([pa.array(np.maximum.reduceat(n[order], first)), pa.array(np.minimum.reduceat(length[order], first))], ["tf", "dl"])
        of = np.searchsorted(group[order][first], np.arange(len(starts) + 1)).astype(np.int32)
        posts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([doc, tf, dl], ["doc_id", "tf", "dl"]))
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([term.take(at), place.take(at), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(of), peaks), posts], ["term", "place", "df", "peaks", "posts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        term, place = rows.column(0).chunk(0), rows.column(1).to_numpy()
        new = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (place[1:] != place[:-1])
        cuts = np.flatnonzero(new) + 1
        if len(cuts):
            yield made(rows.slice(0, cuts[-1]), np.concatenate([[0], cuts[:-1]]))
            rows = rows.slice(cuts[-1])
        held = rows.to_batches()  # the last list may go on in the next batch
    if held:
        yield made(pa.Table.from_batches(held), np.zeros(1, np.int64))


class Index:
    """Documents (doc_id, text) in a folder. One writer at a time: a second one that writes the same version fails.

    - Null texts have no terms; such documents count in the corpus totals.
    - An id is a document's name: adding one that is there raises ValueError.
    """

    def __init__(self, spark: SparkSession, path: str, range_docs: int = 128, most_segments: int = 8, first_ranges: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.range_docs, self.most_segments, self.first_ranges = range_docs, most_segments, first_ranges
        #: Blocks that the last search scored, and blocks of its terms.
        self.blocks_read = self.blocks = 0

    # --- segments

    def _version(self) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/*/_SUCCESS"))
        return max((int(s.getPath().getParent().getName()) for s in found or []), default=0)

    def segments(self) -> list[tuple[str, int, int]]:
        """(name, documents, tokens) of the segments that make the index now; their number is bounded by merging."""
        version = self._version()
        rows = self.spark.read.parquet(f"{self.path}/versions/{version:08d}").collect() if version else []
        return sorted((r["name"], r["docs"], r["tokens"]) for r in rows)

    def _commit(self, segments: list[tuple[str, int, int]]) -> None:
        df = self.spark.createDataFrame(segments, "name string, docs long, tokens long").coalesce(1)
        df.write.parquet(f"{self.path}/versions/{self._version() + 1:08d}")

    def _read(self, table: str, segments: list[tuple[str, int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/segments/{s[0]}/{table}" for s in segments])

    def _segment(self, lengths: DataFrame, counts: DataFrame) -> tuple[str, int, int]:
        """Writes a segment of documents (doc_id, dl) and their (doc_id, dl, term, tf)."""
        name = uuid.uuid4().hex
        lengths.write.parquet(f"{self.path}/segments/{name}/docs")
        kind = F.floor(F.log2(F.col("dl") + 1.0)).cast("int")
        sizes = self.spark.read.parquet(f"{self.path}/segments/{name}/docs").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()  # at most 32 kinds of length
        many = F.create_map(*[F.lit(x) for r in sizes for x in (r["kind"], -(-r["n"] // self.range_docs))]) if sizes else F.create_map(F.lit(0), F.lit(1))
        place = F.shiftleft(kind.cast("long"), 48) + F.pmod(F.xxhash64("doc_id"), F.element_at(many, kind).cast("long"))
        # One shuffle: ranges of (term, place) are dealt and sorted as rows of numbers, and lists are made where they lie.
        dealt = counts.withColumn("place", place).select("term", "place", "doc_id", "tf", "dl").repartitionByRange("term", "place").sortWithinPartitions("term", "place", "doc_id")
        kind_of_id = counts.schema["doc_id"].dataType.simpleString()
        rows = dealt.mapInArrow(_lists, f"term string, place long, df int, peaks array<struct<tf:int,dl:int>>, posts array<struct<doc_id:{kind_of_id},tf:int,dl:int>>")
        rows.select(F.lit(name).alias("segment"), "term", "place", "df", "peaks", "posts").write.parquet(f"{self.path}/segments/{name}/postings")
        return name, sum(r["n"] for r in sizes), sum(r["tokens"] or 0 for r in sizes)

    def _of_texts(self, docs: DataFrame, doc_id: str, text: str) -> tuple[str, int, int]:
        lengths = docs.select(F.col(doc_id).alias("doc_id"), n_tokens(text).alias("dl"))
        words = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("ws"))
        counts = words.mapInArrow(_counts, f"doc_id {words.schema['doc_id'].dataType.simpleString()}, dl int, term string, tf int")
        return self._segment(lengths, written(counts, "term-counts"))

    def build(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        """The index holds these documents and no others."""
        self._commit([self._of_texts(docs, doc_id, text)])
        return self

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        """Adds documents; what is there isn't read but for its ids, and merged only as segments grow in number."""
        held = self.segments()
        ids = docs.select(F.col(doc_id).alias("doc_id"))
        if held and not ids.join(self._read("docs", held).select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("some documents are in the index already")
        held.append(self._of_texts(docs, doc_id, text))
        if len(held) > self.most_segments:
            held.sort(key=lambda s: s[1])
            small, held = held[: self.most_segments // 2 + 1], held[self.most_segments // 2 + 1 :]
            counts = self._read("postings", small).select("term", F.explode("posts").alias("p")).select("p.doc_id", "p.dl", "term", "p.tf")
            held.append(self._segment(self._read("docs", small), counts))
        self._commit(held)
        return self

    # --- searches

    def _found(self, terms: list[str]) -> tuple[DataFrame, int, float, list[int]]:
        """(postings of the terms, documents, mean length, documents a term)."""
        held = self.segments()
        n, mean = sum(s[1] for s in held), sum(s[2] for s in held) / max(sum(s[1] for s in held), 1)
        found = self._read("postings", held).filter(F.col("term").isin(*terms))
        sums = {r["term"]: (r["df"], r["rows"]) for r in found.groupBy("term").agg(F.sum("df").alias("df"), F.count("*").alias("rows")).collect()}  # a row a term asked for
        self.blocks = self.blocks_read = sum(s[1] for s in sums.values())
        return found, n, mean, [sums.get(t, (0, 0))[0] for t in terms]

    def _scored(self, found: DataFrame, terms: list[str], n: int, mean: float, df: list[int], allowed: DataFrame | None) -> DataFrame:
        posts = found.select("term", F.explode("posts").alias("p")).select("p.doc_id", "p.dl", "term", "p.tf")
        if allowed is not None:
            posts = posts.join(allowed, "doc_id", "left_semi")
        rows = posts.groupBy("doc_id").agg(F.max("dl").alias("dl"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        return score_terms(rows.withColumns({"n": F.lit(n), "avgdl": F.lit(mean), **{f"df{i}": F.lit(x) for i, x in enumerate(df)}}), len(terms))

    def bm25(self, terms: list[str], allowed: DataFrame | None = None) -> DataFrame:
        """(doc_id, score) of all documents that hold a term; `allowed` (doc_id) restricts what is returned."""
        terms = plain_terms(terms)
        if not terms or not self.segments():
            return self.spark.createDataFrame([], "doc_id long, score double")
        found, n, mean, df = self._found(terms)
        return self._scored(found, terms, n, mean, df, allowed)

    def top(self, terms: list[str], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(doc_id, score): the first k rows of `bm25`, of which only the ranges that can hold one of them are scored."""
        terms = plain_terms(terms)
        if not terms or not self.segments():
            return self.spark.createDataFrame([], "doc_id long, score double")
        found, n, mean, df = self._found(terms)
        at_most = lambda w: F.array_max(F.transform("peaks", lambda p: w * p["tf"] * (K1 + 1) / (p["tf"] + K1 * (1 - B + B * p["dl"] / F.lit(mean)))))
        bound = F.lit(0.0)
        for t, x in zip(terms, df):
            bound = F.when(F.col("term") == t, at_most(_weight(n, x))).otherwise(bound)
        ranges = written(found.select("segment", "place", bound.alias("bound")).groupBy("segment", "place").agg(F.sum("bound").alias("bound"), F.count("*").alias("rows")), "ranges")

        def of(chosen: DataFrame) -> DataFrame:
            size, rows = chosen.agg(F.count("*"), F.sum("rows")).first()
            self.blocks_read = max(self.blocks_read, rows or 0)  # ranges are taken from the top, so one pass holds the other
            keys = chosen.select("segment", "place")
            return self._scored(found.join(F.broadcast(keys) if size <= MOST_BROADCAST else keys, ["segment", "place"], "left_semi"), terms, n, mean, df, allowed)

        self.blocks_read, some, total = 0, max(self.first_ranges, k // self.range_docs * 2), ranges.count()
        while True:
            rows, bar = top(of(ranges.orderBy(F.desc("bound"), "segment", "place").limit(some)), "doc_id", k).agg(F.count("*"), F.min("score")).first()
            # Sums may differ in their last digits, and rows are ordered by rounded scores.
            reach = ranges.filter(F.col("bound") >= bar - 1e-8) if rows == k else ranges
            if some >= total or reach.count() <= 4 * some:
                return top(of(reach), "doc_id", k)
            some *= 4  # a few more ranges may raise the bar
