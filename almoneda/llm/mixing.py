"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

A document's key is 48 bits of a hash of its id and text. Taking the documents of a source whose key lies below a threshold takes
a random part of it, and a larger budget takes a superset: thresholds are nested. The threshold of a budget is found
without sorting: sizes are summed by source and by the key's first 12 bits, the one bucket that the budget cuts is
refined by the next 12 bits, and so on. Each level reads only the documents of the boundary buckets, 1/4096 of those
before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almoneda.llm.shared import free_name, materialize, n_words
from almoneda.llm.sharding import number_copies

LEVELS, BITS = 4, 12


def hash_key(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of the MD5 of the id as text, a newline and the text; a null counts as empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text)]
    return F.conv(F.substring(F.md5(F.concat(parts[0], F.lit("\n"), parts[1]).cast("binary")), 1, 12), 16, 10).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size), written, with `rank` from 0 in order of code point, null last.

    Sources are dealt by range, ranked within each range, and the ranges' counts tell where each begins.
    """
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    dealt = materialize(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    first = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first"))  # a row a range
    rank = F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return materialize(dealt.join(first, "range").select("source", "source_size", rank.alias("rank")), "ranked")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target): a budget of share * all sizes, split by weight, none above most * its size.

    Sources in order of code point, null last, weigh `weights` in turn. What a source can't take is shared again by
    weight among the others until none is above its limit: a round sums what the full ones take and what the others weigh,
    and ends when no other is full at that level. If all limits together are below the budget, every source stands at its
    limit. No task sees all sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = _ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        is_full = F.col("limit") < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        taken, open_weight, now = ranked.agg(F.coalesce(F.sum(F.when(is_full, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)), F.count_if(is_full)).first()
        if now == full:
            break
        full, level = now, (share * total - taken) / open_weight if open_weight else float("inf")
    return ranked.select("source", "source_size", "weight", F.least(F.col("limit"), F.lit(level) * F.col("weight")).cast("double").alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold, part): keys below the threshold, and `part` of the rows that have it, fill the source's budget.

    sized: (source, key, size); budgets: (source, budget double). Of the documents in order of key, those are taken
    whose middle lies within the budget, so what is taken differs from it by half a document at most. A budget that
    covers the source has the threshold 2^48.
    """
    top = LEVELS * BITS
    live = budgets.filter("budget > 0").select(F.col("source").alias("s"), "budget", F.lit(0.0).cast("double").alias("before"), F.lit(0).cast("long").alias("prefix"))
    rows = sized.filter("size > 0")
    done = None
    for level in range(1, LEVELS + 1):
        shift = top - level * BITS
        if level > 1:
            near = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", shift + BITS) == F.col("prefix"))
            rows = rows.join(live.select("s", "prefix"), near).drop("s", "prefix")
            if level == 2:
                rows = materialize(rows, "boundary")
        hist = rows.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("n"), F.count("*").alias("rows"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        placed = hist.join(live, F.col("source").eqNullSafe(F.col("s"))).withColumn("through", F.col("before") + F.sum("n").over(run)).withColumn("start", F.col("through") - F.col("n"))
        inside = F.col("through") <= F.col("budget")
        cut = ~inside & (F.col("start") < F.col("budget"))
        found = placed.groupBy("source").agg(
            F.max(F.when(inside, F.col("bucket") + 1)).alias("full"), F.max(F.when(cut, F.col("bucket"))).alias("bucket"), F.max(F.when(cut, F.col("start"))).alias("start"),
            F.first("budget").alias("budget"), F.first("prefix").alias("prefix"), F.max(F.when(~inside, F.lit(1))).alias("over"),
            F.max(F.when(cut, F.col("n"))).alias("n"), F.max(F.when(cut, F.col("rows"))).alias("rows"),
        )
        found = materialize(found, "threshold")
        least = F.col("prefix") * (1 << BITS)
        # Where no bucket is cut, the threshold is the end of the last whole one (or of everything).
        whole = F.when(F.col("over").isNull() & (level == 1), F.lit(1 << top)).otherwise(F.coalesce("full", least) * (1 << shift))
        last = F.lit(level == LEVELS)  # where a bucket is one key
        some = F.floor((F.col("budget") - F.col("start")) * F.col("rows") / F.col("n") + 0.5)
        every = some >= F.col("rows")
        ended = found.filter(F.col("bucket").isNull() | last).select(
            "source", F.coalesce(F.when(every, F.col("bucket") + 1), F.col("bucket"), whole).cast("long").alias("threshold"), F.when(~every, some).otherwise(0).cast("long").alias("part"),
        )
        done = ended if done is None else done.unionByName(ended)
        live = found.filter(F.col("bucket").isNotNull()).select(F.col("source").alias("s"), "budget", F.col("start").alias("before"), F.col("bucket").alias("prefix"))
    return done


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target and taken: the words that a mix to the target weights takes of each document.

    A target of several times its source repeats all its documents so many whole times and those below the threshold
    once more. taken is size times repeats, 3 repeats at most.

    - Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in order.
    - Rows that repeat an id with another text have keys of their own. Rows that agree in both share a key; where a source's
      threshold is theirs, they are numbered and as many are taken as its budget needs.
    - An empty table gives an empty table. Columns named like the new ones are overwritten by them only if they are
      not columns of docs; otherwise the new ones get underscores appended.
    """
    size, source_size, target, taken = (free_name(docs.columns, x) for x in ("size", "source_size", "target", "taken"))
    narrow = docs.select(F.col(source).alias("source"), hash_key(F.col(doc_id), F.col(text)).alias("key"), n_words(F.col(text)).alias("size"))
    narrow = materialize(narrow, "sizes")  # every level reads it, and texts only once
    targets = materialize(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = thresholds(narrow, plan.select("source", "budget")).withColumnRenamed("source", "cut_source")
    taken_names = [*docs.columns, size, source_size, target, taken]
    of, n, goal, times, cut, part, key = (free_name(taken_names, x) for x in ("__source", "__n", "__target", "__whole", "__cut", "__part", "__key"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        F.col("source").alias(of), F.col("source_size").alias(n), F.col("target").alias(goal), F.col("whole").alias(times),
        *[F.coalesce(c, F.lit(0)).alias(to) for c, to in (("threshold", cut), ("part", part))],
    )
    plan = materialize(plan, "plan")
    out = docs.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, F.col(f"`{source}`").eqNullSafe(F.col(of)), "left").withColumn(key, hash_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))

    def done(df: DataFrame, more: Column) -> DataFrame:
        df = df.withColumn(size, n_words(F.col(f"`{text}`"))).withColumns({source_size: F.col(n).cast("long"), target: F.col(goal)})
        df = df.withColumn(taken, (F.col(size) * (F.col(times) + F.when(more, 1).otherwise(0))).cast("long"))
        return df.select(*[F.col(f"`{c}`") for c in docs.columns], size, source_size, target, taken)

    below, split = F.col(key) < F.col(cut), F.col(part) > 0
    if plan.filter(split).isEmpty():
        return done(out, below)
    # the rows of a threshold that is taken in part, and the others
    at = F.coalesce(split & (F.col(key) == F.col(cut)), F.lit(False))
    row, number = (free_name([*out.columns, *taken_names], x) for x in ("__row", "__number"))
    shared = materialize(out.filter(at).withColumn(row, F.monotonically_increasing_id()), "shared")
    value = shared.select(F.col(row), F.col(key), F.coalesce(F.col(of).cast("string"), F.lit("")).alias("a"), F.col(of).isNull().alias("b"))
    numbered = number_copies(value, [key, "a", "b"], row, 64, number).select(row, number)
    return done(out.filter(~at), below).unionByName(done(shared.join(numbered, row), F.col(number) < F.col(part)))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights 5, 2, 1 in turn at 100% of all sizes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 12) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 + 1]::DOUBLE AS weight,
        3.0::DOUBLE * source_size AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM w
      WINDOW p AS (ORDER BY lim / weight, source IS NULL, CAST(source AS BLOB) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(lim, coalesce(max(CASE WHEN level * weight <= lim THEN level END) OVER () * weight, lim))::DOUBLE AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, k, sum(size) AS n, count(*) AS c, sum(sum(size)) OVER (PARTITION BY source ORDER BY k) AS through FROM d GROUP BY source, k)
SELECT d.doc_id, d.size, b.source_size, b.target,
  CAST(d.size * (b.whole + CASE WHEN b.target > b.whole * b.source_size AND row_number() OVER (PARTITION BY d.source, d.k) <= floor((b.target - b.whole * b.source_size - (g.through - g.n)) * g.c / g.n + 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.k = g.k
"""
