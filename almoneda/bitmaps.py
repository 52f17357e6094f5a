"""Facet counts from bitmaps: contracts are numbered in blocks, and each value of a dimension has a bitmap a block.

Filters are bitmaps joined by OR within a dimension and by AND over dimensions, a count is the number of bits left, and a
dimension's own filter is left out by leaving its bitmap out of the AND. The contracts themselves aren't read. A range of dates
or amounts is the bitmaps of the cells (months, powers of two) that it covers, and of a cell that a bound cuts the numbers that
stand beside it. Codes are many and most are rare, so they have no bitmaps but a row for each contract that holds one, in order
of codes, of which a prefix is a range; a bitmap is made of those that a question needs.

Files hold blocks of their own, so a block's bitmaps are joined where they are and a question's shuffle grows with the blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almoneda.facets import DIMENSIONS
from almoneda.spec import FilterSpec
from almoneda.store import written

#: Bits of a bitmap, as Spark's functions have them. Fixed value.
BITS = 32_768
#: Ranges: name, column, what a cell is called; names are in the order of the numbers.
RANGES = {
    "publication": ("publication_ts", lambda c: F.date_format(c, "yyyy-MM")),
    "deadline": ("deadline_ts", lambda c: F.date_format(c, "yyyy-MM")),
    "budget": ("budget_amount", lambda c: F.when(F.isnan(c), F.lit("9999")).when(c <= 0, F.lit("0000")).otherwise(F.format_string("%04d", F.floor(F.log2(c)).cast("int") + 2000))),
}


def _number(column: str) -> Column:
    """A date's microseconds, exact, or an amount."""
    return F.unix_micros(column) if column != "budget_amount" else F.col(column)


class BitmapFacets:
    """Bitmaps of contracts (sid and the columns of the dimensions) in a folder. sid is a key and never null.

    Null values have no bitmap; neither have empty codes as values of a facet. Dates without a zone are read in the session's,
    which has to be the same when counts are asked for.
    """

    def __init__(self, spark: SparkSession, path: str, block_rows: int = BITS // 2):
        self.spark, self.path, self.block_rows = spark, path.rstrip("/"), block_rows

    def build(self, df: DataFrame) -> BitmapFacets:
        wanted = ["sid", *DIMENSIONS.values(), *[c for c, _ in RANGES.values()]]
        stamps = {c: F.col(c).cast("timestamp") for c in ("publication_ts", "deadline_ts")}
        df = written(df.select(*wanted).withColumns(stamps), "contracts")
        parts = max(-(-df.count() // self.block_rows), 1)
        # A part's rows mostly fill one bitmap; what is more goes to the next one, in blocks of the part's own.
        row = F.row_number().over(Window.partitionBy("part").orderBy("sid")) - 1
        at = df.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(parts))).withColumn("row", row)
        # Blocks of a part stay in its task from here on, so nothing more is shuffled.
        at = at.select(*wanted[1:], "part", (F.col("part") * (1 << 20) + F.floor(F.col("row") / BITS)).alias("block"), F.pmod("row", F.lit(BITS)).cast("long").alias("bit"))
        one = lambda c: F.filter(F.array(F.col(c).cast("string")), lambda x: x.isNotNull() & (x != ""))
        values = {k: one(c) for k, c in DIMENSIONS.items() if k != "cpv"}
        values |= {k: one_cell for k, (c, cell) in RANGES.items() for one_cell in [F.when(F.col(c).isNotNull(), F.array(cell(F.col(c))))]}
        every = F.lit(["*"])
        entry = lambda k, v: F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("dimension"), x.alias("value")))
        rows = at.select("part", "block", "bit", F.explode(F.concat(*[entry(k, v) for k, v in {**values, "*": every}.items()])).alias("e")).select("e.*", "part", "block", "bit")
        maps = rows.groupBy("part", "block", "dimension", "value").agg(F.bitmap_construct_agg("bit").alias("bits")).drop("part")
        order = lambda d, *c: d.sortWithinPartitions(*c).write.mode("overwrite").option("compression", "zstd")  # noqa: E731  most bits of a rare value are zero
        order(maps, "dimension", "value", "block").parquet(f"{self.path}/maps")
        number = lambda k, c, cell: F.struct(F.lit(k).alias("dimension"), cell(F.col(c)).alias("value"), (F.lit(None).cast("long") if k == "budget" else _number(c)).alias("whole"), (_number(c) if k == "budget" else F.lit(None).cast("double")).alias("amount"))
        numbers = at.select("block", "bit", F.explode(F.array(*[number(k, c, cell) for k, (c, cell) in RANGES.items()])).alias("e")).select("e.*", "block", "bit").filter("value IS NOT NULL AND (whole IS NOT NULL OR amount IS NOT NULL)")
        order(numbers, "dimension", "value", "block").parquet(f"{self.path}/numbers")
        codes = at.select("block", "bit", F.explode(F.array_distinct(F.filter("cpv", lambda x: x.isNotNull() & (x != "")))).alias("value"))
        order(codes.select("value", "block", "bit"), "value", "block").parquet(f"{self.path}/codes")
        return self

    def _codes(self, stems: list[str] | tuple[str, ...]) -> DataFrame:
        """(value, block, bit) of the codes that start with any stem."""
        return self.spark.read.parquet(f"{self.path}/codes").filter(reduce(lambda a, b: a | b, [F.col("value").startswith(x) for x in stems]))

    def _maps(self, test: Column) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/maps").filter(test)

    def _range(self, k: str, low: Column | None, high: Column | None) -> DataFrame:
        """(block, bits) of a dimension's numbers from low to high, both ends included."""
        cell, number = RANGES[k][1], F.col("amount" if k == "budget" else "whole")
        ends = self.spark.range(1).select(*[(cell(x) if x is not None else F.lit(None)).cast("string").alias(n) for n, x in (("lo", low), ("hi", high))]).first()
        plain = lambda x: x.cast("double") if k == "budget" else F.unix_micros(x)
        inside = F.col("dimension") == k
        if low is not None:
            inside &= F.col("value") > ends["lo"]
        if high is not None:
            inside &= F.col("value") < ends["hi"]
        cut = self.spark.read.parquet(f"{self.path}/numbers").filter((F.col("dimension") == k) & F.col("value").isin(*{x for x in ends if x is not None}))
        if low is not None:
            cut = cut.filter(number >= plain(low))
        if high is not None:
            cut = cut.filter(number <= plain(high))
        return self._maps(inside).select("block", "bits").unionByName(cut.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _tests(self, spec: FilterSpec) -> dict[str, list[DataFrame]]:
        """Of each dimension that is filtered the bitmaps (block, bits) that all must hold."""
        out: dict[str, list[DataFrame]] = {}
        for k in DIMENSIONS:
            if getattr(spec, k):
                if k == "cpv":
                    out[k] = [self._codes(spec.cpv).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))]
                    continue
                held = reduce(lambda a, b: a | b, [F.col("value").startswith(x) for x in spec.nuts]) if k == "nuts" else F.col("value").isin(*getattr(spec, k))
                out[k] = [self._maps((F.col("dimension") == k) & held).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))]
        day = lambda x, end="": F.lit(f"{x}{end}").cast("timestamp") if x else None
        dates = [self._range(k, day(a), day(b, " 23:59:59")) for k, a, b in (("publication", spec.pub_from, spec.pub_to), ("deadline", spec.deadline_from, spec.deadline_to)) if a or b]
        amount = lambda x: None if x is None else F.lit(float(x))
        if dates:
            out["dates"] = dates
        if spec.budget_min is not None or spec.budget_max is not None:
            out["budget"] = [self._range("budget", amount(spec.budget_min), amount(spec.budget_max))]
        return out

    def selected(self, spec: FilterSpec) -> DataFrame:
        """(without, block, bits): contracts under all filters ('') and under all but each one."""
        tests = self._tests(spec)
        needed = {w: 1 + sum(len(v) for k, v in tests.items() if k != w) for w in ("", *tests)}
        use = lambda k, d: d.select(F.explode(F.lit([w for w in needed if w != k])).alias("without"), "block", "bits")
        sides = [use("*", self._maps(F.col("dimension") == "*"))] + [use(k, d) for k, v in tests.items() for d in v]
        both = reduce(DataFrame.unionByName, sides).groupBy("without", "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        # A block without a bitmap of a filter holds none of its contracts.
        return both.filter(F.col("n") == F.element_at(F.create_map(*[F.lit(x) for kv in needed.items() for x in kv]), F.col("without"))).drop("n")

    def totals(self, spec: FilterSpec) -> DataFrame:
        """One row: the total under all filters, and for each dimension the total without its own."""
        counts = self.selected(spec).groupBy("without").agg(F.sum(F.bitmap_count("bits")).alias("n"))
        active = set(self._tests(spec))
        names = ["cpv", "nuts", "status", "result", "contract_type", "procedure", "dates", "budget"]
        n = lambda w: F.coalesce(F.max(F.when(F.col("without") == w, F.col("n"))), F.lit(0))
        return counts.agg(n("").alias("total"), *[n(k if k in active else "").alias(f"t_{k}") for k in names])

    def count_by(self, spec: FilterSpec, dimension: str) -> DataFrame:
        """(value, n) of a dimension under all filters but its own; for codes (`cpv`) contracts with the code."""
        if dimension != "cpv":
            return self._counts(spec, dimension, self._maps(F.col("dimension") == dimension))
        codes = self.spark.read.parquet(f"{self.path}/codes")
        byte = F.conv(F.hex(F.substring("chosen", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return codes.join(self._chosen(spec, "cpv"), "block").filter(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1).groupBy("value").agg(F.count("*").alias("n"))

    def nodes(self, spec: FilterSpec, codes: list[str]) -> DataFrame:
        """(code, n): contracts with any code under each node, the cpv filter left out."""
        from almoneda.functions.scalar import cpv_prefix

        nodes = self.spark.createDataFrame([(c,) for c in dict.fromkeys(codes)], "code string").withColumn("value", cpv_prefix("code"))
        stems = [r["value"] for r in nodes.select("value").distinct().collect()]  # the nodes asked for
        if not stems:
            return nodes.select("code", F.lit(0).cast("long").alias("n"))
        under = self._codes(stems).select(F.explode(F.filter(F.lit(stems), lambda x: F.startswith(F.col("value"), x))).alias("value"), "block", "bit")
        counts = self._counts(spec, "cpv", under.groupBy("value", "block").agg(F.bitmap_construct_agg("bit").alias("bits")))
        return nodes.join(counts, "value", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))

    def _chosen(self, spec: FilterSpec, dimension: str) -> DataFrame:
        """(block, chosen): contracts under all filters but a dimension's own."""
        left = dimension if dimension in self._tests(spec) else ""
        return self.selected(spec).filter(F.col("without") == left).select("block", F.col("bits").alias("chosen"))

    def _counts(self, spec: FilterSpec, dimension: str, maps: DataFrame) -> DataFrame:
        met = maps.join(self._chosen(spec, dimension), "block").select("value", "block", F.explode(F.array("bits", "chosen")).alias("bits"))
        return met.groupBy("value", "block").agg(F.bitmap_and_agg("bits").alias("bits")).groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n")).filter("n > 0")
