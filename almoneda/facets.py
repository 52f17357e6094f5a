"""Counts by dimension, each under all filters but its own, and histograms over fixed grids."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda.functions import scalar as S
from almoneda.spec import FilterSpec

DIMENSIONS = {"cpv": "cpv", "nuts": "nuts", "status": "status_code", "result": "result_code", "contract_type": "contract_type_code", "procedure": "procedure_code"}
#: Groups of codes that are shown as one. Fixed values.
GROUPS = {
    "result": {"adj": ("1", "2", "8", "9", "10", "11"), "des": ("3", "6", "7"), "can": ("4", "5")},
    "contract_type": {"obras": ("3", "31", "32"), "serv": ("2", "21", "22"), "sum": ("1",), "otros": ("40", "50", "7", "8")},
    "procedure": {"abierto": ("1",), "abierto_s": ("9",), "restr": ("2",), "negoc": ("3", "4", "5", "10", "11", "13"), "deriv": ("7", "12"), "menor": ("6",), "otros": ("8", "100", "999")},
}


def count_by(df: DataFrame, spec: FilterSpec, dimension: str) -> DataFrame:
    """(value, n) of a dimension under all other filters; null and empty values are left out."""
    c = DIMENSIONS[dimension]
    return spec.apply(df, dimension).filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))


def totals(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row: the total under all filters, and a total for each dimension without its own. One scan, one aggregate."""
    tests = spec.dimensions()
    flags = {k: F.coalesce(p, F.lit(False)) for k, p in tests.items()}
    every = lambda keys: reduce(lambda a, b: a & b, [F.col(f"is_{k}") for k in keys], F.lit(True))
    marked = df.select(*[p.alias(f"is_{k}") for k, p in flags.items()]) if flags else df.select(F.lit(1))
    names = ["cpv", "nuts", "status", "result", "contract_type", "procedure", "dates", "budget"]
    return marked.agg(F.count_if(every(tests)).alias("total"), *[F.count_if(every([k for k in tests if k != n])).alias(f"t_{n}") for n in names])


def without_each(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """(field, value, n): of each filter value in force, the total once it is removed. One scan, one aggregate."""
    active = spec.active()
    if not active:
        return df.sparkSession.createDataFrame([], "field string, value string, n long")
    tests = [spec.without(k, v).predicate() for k, v in active]
    counts = df.agg(*[F.count_if(F.lit(True) if t is None else F.coalesce(t, F.lit(False))).alias(f"n{i}") for i, t in enumerate(tests)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.lit(str(v)).alias("value"), F.col(f"n{i}").alias("n")) for i, (k, v) in enumerate(active)])))


def budget_edges(spark: SparkSession) -> DataFrame:
    """(bucket, low, high) of the budget grid; the first starts at 0, the last is open."""
    step = (math.log(S.BUDGET_MAX) - math.log(S.BUDGET_MIN)) / S.BUDGET_BINS
    at = lambda i: F.exp(F.lit(math.log(S.BUDGET_MIN)) + i * F.lit(step))
    i = F.col("id")
    return spark.range(S.BUDGET_BINS).select(F.format_string("b%02d", i).alias("bucket"), F.when(i == 0, F.lit(0.0)).otherwise(at(i)).alias("low"), F.when(i < S.BUDGET_BINS - 1, at(i + 1)).alias("high"))


def budget_histogram(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """(bucket, n) over the whole grid, the budget filter left out."""
    counts = spec.apply(df, "budget").groupBy(S.budget_bucket("budget_amount").alias("bucket")).agg(F.count("*").alias("n"))
    return budget_edges(df.sparkSession).select("bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def month_histogram(df: DataFrame, spec: FilterSpec, column: str = "publication_ts", months: int = 36) -> DataFrame:
    """(month, n) of the last months that occur, date filters left out."""
    m = spec.apply(df, "dates").filter(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return m.orderBy(F.desc("month")).limit(months)


def cpv_nodes(df: DataFrame, spec: FilterSpec, codes: list[str]) -> DataFrame:
    """(code, n): contracts with any code under each of at most 50 nodes, the cpv filter left out.

    Every code is exploded to its stems of 2 to 8 digits, once a contract, and met by equality with the nodes' stems.
    """
    nodes = df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(codes[:50])], "code string").withColumn("stem", S.cpv_prefix("code"))
    stems = F.array_distinct(F.flatten(F.transform("cpv", lambda c: F.transform(F.sequence(F.lit(2), F.lit(8)), lambda n: F.substring(c, F.lit(1), n)))))
    under = spec.apply(df, "cpv").select("sid", F.explode(stems).alias("stem")).join(F.broadcast(nodes), "stem").groupBy("code").agg(F.count("*").alias("n"))
    return nodes.select("code").join(under, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def range_counts(df: DataFrame, grid: DataFrame, value: Column | str) -> DataFrame:
    """(bucket, n) of a grid (bucket, low, high) whose ranges hold both ends: a value on an edge counts twice.

    The grid is a fixed handful of rows, so each value is tested against an array of them.
    """
    edges = grid.agg(F.collect_list(F.struct("bucket", "low", "high")).alias("edges"))
    v = F.col(value) if isinstance(value, str) else value
    inside = lambda e: (v >= e["low"]) & (e["high"].isNull() | (v <= e["high"]))
    found = df.filter(v.isNotNull()).crossJoin(F.broadcast(edges)).select(F.explode(F.filter("edges", inside)).alias("e")).groupBy("e.bucket").agg(F.count("*").alias("n"))
    return grid.select("bucket").join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def grouped(counts: DataFrame, dimension: str) -> DataFrame:
    """(group, n) from (value, n): sums by group of codes, null where no code of the group occurs."""
    rows = [(g, c) for g, codes in GROUPS[dimension].items() for c in codes]
    m = counts.sparkSession.createDataFrame(rows, "grp string, value string")
    return F.broadcast(m).join(counts, "value", "left").groupBy("grp").agg(F.sum("n").alias("n"))


def group_active(codes: tuple[str, ...], chosen: tuple[str, ...]) -> bool:
    return bool(codes) and set(codes) <= set(chosen)


def group_toggle(codes: tuple[str, ...], chosen: tuple[str, ...]) -> tuple[str, ...]:
    """The choice with a group switched: a whole one off, a part or none of it on."""
    return tuple(c for c in chosen if c not in codes) if group_active(codes, chosen) else tuple(dict.fromkeys((*chosen, *codes)))


def month_grid(span: DataFrame, most: int) -> DataFrame:
    """(month, first_day, last_day) of the last `most` months of one span (lo, hi)."""
    m = span.select(F.explode(F.expr("sequence(trunc(lo, 'MM'), trunc(hi, 'MM'), interval 1 month)")).alias("m"))
    return m.orderBy(F.desc("m")).limit(most).select(F.date_format("m", "yyyy-MM").alias("month"), F.col("m").alias("first_day"), F.last_day("m").alias("last_day"))


def month_axes(spark: SparkSession, today: str, back: int = 36, ahead: int = 18) -> DataFrame:
    """(axis, month, day_from, day_to): the months up to now and from now on; ranges end on each month's last day."""
    now = F.trunc(F.lit(today).cast("date"), "MM")
    row = spark.range(1).select(F.explode(F.array(F.struct(F.lit("past").alias("axis"), F.lit(1 - back).alias("a"), F.lit(0).alias("b")), F.struct(F.lit("next").alias("axis"), F.lit(0).alias("a"), F.lit(ahead - 1).alias("b")))).alias("x"))
    m = row.select("x.axis", F.explode(F.sequence(F.col("x.a"), F.col("x.b"))).alias("i")).select("axis", F.add_months(now, F.col("i")).alias("m"))
    return m.select("axis", F.date_format("m", "yyyy-MM").alias("month"), F.col("m").alias("day_from"), F.last_day("m").alias("day_to"))
