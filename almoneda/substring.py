"""Codes whose label holds a term, by postings of the label's pieces of two and three characters, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pieces(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a lowered text."""
    t = F.lower(text)
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


class Typeahead:
    """Codes (code, label) in a folder, sorted by code, and postings (piece, code, label) sorted by piece.

    A search reads the postings of each term's rarest piece alone, as rows are sorted by piece, and tests the label that lies
    with them; codes are found by their prefix. How many postings a piece has is a table of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, codes: DataFrame) -> Typeahead:
        order = lambda d, *c: d.repartitionByRange(*c).sortWithinPartitions(*c).write.mode("overwrite")
        order(codes.select("code", "label"), "code").parquet(f"{self.path}/codes")
        posts = codes.select(F.explode(F.concat(pieces(F.col("label"), 2), pieces(F.col("label"), 3))).alias("piece"), "code", "label")
        order(posts, "piece", "code").parquet(f"{self.path}/postings")
        sizes = self.spark.read.parquet(f"{self.path}/postings").groupBy("piece").agg(F.count("*").alias("n"))
        order(sizes, "piece").parquet(f"{self.path}/sizes")
        return self

    def _rarest(self, terms: list[str]) -> dict[str, str]:
        """Of each term the piece with fewest postings; a term with a piece that no label has is left out."""
        n = lambda t: min(len(t), 3)
        cut = {t: [t[i : i + n(t)] for i in range(len(t) - n(t) + 1)] for t in terms}
        sizes = {r["piece"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/sizes").filter(F.col("piece").isin(*{p for c in cut.values() for p in c})).collect()}  # pieces of the terms
        return {t: min(c, key=lambda p: (sizes[p], p)) for t, c in cut.items() if all(p in sizes for p in c)}

    def search(self, terms: list[str], most: int = 40) -> DataFrame:
        """(code, label): the first codes, in order, that start with a term or whose label holds it, without regard to case.
        Terms of one letter are ignored."""
        terms = [t for t in dict.fromkeys(terms) if len(t) >= 2]
        found = self.spark.read.parquet(f"{self.path}/codes").limit(0)
        for t in terms:
            found = found.unionByName(self.spark.read.parquet(f"{self.path}/codes").filter(F.col("code").startswith(t)))
        low = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.lower("t")).collect()] if terms else []
        for t, piece in self._rarest(low).items() if low else ():
            found = found.unionByName(self.spark.read.parquet(f"{self.path}/postings").filter((F.col("piece") == piece) & F.contains(F.lower("label"), F.lit(t))).select("code", "label"))
        return found.distinct().orderBy("code").limit(most)
