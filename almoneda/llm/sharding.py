"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix. DataFrame functions only.

1. Rows are dealt to P partitions by a hash of the whole row and of its number among equal rows, so that equal rows are
   spread like any others. All that is drawn is drawn over ids and hashes, and written, so a lost task redoes the very
   same deal.
2. From the partitions' row counts a matrix P x S is drawn: how many rows each partition sends to each shard. Its law
   is that of a uniformly random permutation cut into shards: multivariate hypergeometric with both margins fixed.
   It is drawn by halving: a node holds the rows that all shards still want from a range of partitions, and its left
   half takes a hypergeometric share of them.
3. Each partition permutes its rows (rank by a hash) and cuts them by its row of the matrix.
4. Whole rows go to their shard, where a second hash permutes them again; its high bits deal the shard into blocks that
   many tasks rank side by side, and the blocks' counts give each block's first slot.

P grows with the row count, so no task ever holds more than a bounded number of rows, however few the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almoneda.llm.shared import free_name, materialize


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with `name` standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _walk(start: str, step: str, steps: str, goal: str, at: str) -> str:
    """SQL that adds weights from 1 on, each the last one times `step`; `at` is kept where the sum first reaches goal.

    A goal below 0 is never reached: then the walk only sums.
    """
    zero = f"struct(double(1) as w, double({start}) as sum, double(-1) as at)"
    found = f"if(a.at < 0 and {goal} >= 0 and a.sum + a.w >= {goal}, {at}, a.at)"
    return f"aggregate({steps}, {zero}, (a, i) -> struct(a.w * {step} as w, a.sum + a.w as sum, {found} as at))"


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the marked items among `drawn` of `total` items of which `marked` are marked, by inversion of uniform u.

    The weights are walked from the mode outwards by their exact ratios, over 12 standard deviations and at least 24
    steps on each side; what lies beyond weighs less than a double can hold. The arguments are doubles.
    """
    up = "((p.k - (q.mode + i)) * (p.n - (q.mode + i)) / ((q.mode + i + 1) * (p.t - p.k - p.n + q.mode + i + 1)))"
    down = "((q.mode - i) * (p.t - p.k - p.n + q.mode - i) / ((p.k - q.mode + i + 1) * (p.n - q.mode + i + 1)))"
    above = "sequence(0, int(least(q.high - q.mode, q.reach)))"
    below = "sequence(1, int(least(q.mode - q.low, q.reach)))"
    # Below the mode the first weight is that of mode - 1, so its walk starts one step down.
    first = "(q.mode * (p.t - p.k - p.n + q.mode) / ((p.k - q.mode + 1) * (p.n - q.mode + 1)))"

    def fall(start: str, goal: str) -> str:
        walk = _walk(start, down, below, goal, "q.mode - i").replace("struct(double(1) as w", f"struct(double({first}) as w", 1)
        return f"if(q.mode > q.low, {walk}, struct(double(0) as w, double({start}) as sum, double(-1) as at))"

    rise = lambda goal: _walk("0", up, above, goal, "q.mode + i")
    found = f"if(g.goal <= g.up, greatest({rise('g.goal')}.at, q.low), {_let(fall('g.up', 'g.goal') + '.at', 'at', 'if(at >= 0, at, q.mode)')})"
    sums = f"struct({rise('double(-1)')}.sum as up, {fall('0', 'double(-1)')}.sum as down)"
    body = _let(sums, "s", _let(f"struct({u} * (s.up + s.down) as goal, s.up as up)", "g", found))
    low, high = "greatest(double(0), p.n + p.k - p.t)", "least(p.n, p.k)"
    mode = f"least({high}, greatest({low}, double(floor((p.n + 1) * (p.k + 1) / (p.t + 2)))))"
    reach = "double(ceil(12 * sqrt(p.n * (p.k / p.t) * (1 - p.k / p.t) * (p.t - p.n) / greatest(p.t - 1, double(1))) + 24))"
    inner = _let(f"struct({low} as low, {high} as high, {mode} as mode, {reach} as reach)", "q", body)
    drawn_from = _let(f"struct({total} as t, {marked} as k, {drawn} as n)", "p", inner)
    return f"case when {drawn} <= 0 or {marked} <= 0 then double(0) when {marked} >= {total} then {drawn} when {drawn} >= {total} then {marked} else {drawn_from} end"


def _share(wants: str, drawn: str, salt: str, n_shards: int) -> Column:
    """How many of `drawn` rows go to each shard when shards still want `wants`: a multivariate hypergeometric draw."""
    u = f"((shiftrightunsigned(xxhash64({salt}, s), 11) + 0.5D) / {float(1 << 53)!r}D)"
    got = f"if(s = {n_shards - 1}, c.drawn, bigint({_hypergeometric('double(c.total)', 'double(element_at(' + wants + ', s + 1))', 'double(c.drawn)', u)}))"
    step = _let(got, "y", f"struct(c.total - element_at({wants}, s + 1) as total, c.drawn - y as drawn, concat(c.out, array(y)) as out)")
    start = f"struct(aggregate({wants}, 0L, (a, x) -> a + x) as total, bigint({drawn}) as drawn, cast(array() as array<bigint>) as out)"
    return F.expr(f"aggregate(sequence(0, {n_shards - 1}), {start}, (c, s) -> {step}, c -> c.out)")


def communication_matrix(counts: DataFrame, n_partitions: int, n_shards: int, seed: int) -> DataFrame:
    """(part, ends): `ends[s]` is the rank before which the rows of shard s end in that partition.

    counts: (part long, n long), partitions without rows may be missing. n_partitions must be a power of two. Shard
    sizes differ by one at most, lower shards first. The list of counts has one entry a partition, each entry standing
    for tens of thousands of rows, and halves at every level.
    """
    spark = counts.sparkSession
    every = spark.range(n_partitions).select(F.col("id").alias("part")).join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rows = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)
    node = every.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("x")).select(F.lit(0).cast("long").alias("node"), F.col("x.n").alias("ns"))
    node = node.select("node", "ns", F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.floor(rows / n_shards).cast("long") + F.when(s < rows % n_shards, 1).otherwise(0)).alias("wants"))
    # One column object serves all levels: a level knows its width from its counts.
    half = F.expr("cast(size(ns) div 2 as int)")
    left = _share("wants", "aggregate(slice(ns, 1, cast(size(ns) div 2 as int)), 0L, (a, x) -> a + x)", f"{seed}, size(ns), node", n_shards)
    halves = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.slice("ns", 1, half).alias("ns"), F.col("left").alias("wants")),
        F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("ns", half + 1, half).alias("ns"), F.zip_with("wants", "left", lambda a, b: a - b).alias("wants")),
    )
    for level in range(1, n_partitions.bit_length()):
        if level % 6 == 0:  # enough nodes to deal them out
            node = node.repartition(F.col("node"))
        node = node.select("node", "ns", "wants", left.alias("left")).select(F.explode(halves).alias("h")).select("h.*")
    ends = F.aggregate("wants", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")), lambda a: a["out"])
    return node.select(F.col("node").alias("part"), ends.alias("ends"))


def number_copies(rows: DataFrame, value: list[str], row_id: str, n_groups: int, number: str) -> DataFrame:
    """rows with `number` (long): 0, 1, ... among the rows that agree in the columns `value`, which hold no nulls.

    The rows of a value are numbered in up to n_groups groups by a hash of row_id, which no two rows share, and a group
    starts where the ones before it end. So a value that all rows have still is numbered by many tasks.
    """
    group, first = free_name(rows.columns, "__group"), free_name(rows.columns, "__start")
    keys = [*value, group]
    grouped = rows.withColumn(group, F.pmod(F.xxhash64(row_id), F.lit(n_groups)))
    ranked = grouped.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(row_id)).cast("long") - 1)
    before = Window.partitionBy(*value).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn(first, F.sum("__n").over(before)).filter(F.col(first) > 0).drop("__n")
    return ranked.join(starts, keys, "left").withColumn(number, F.col(number) + F.coalesce(first, F.lit(0))).drop(group, first)


def shard_rows(df: DataFrame, n_shards: int = 16, seed: int = 17, rows_per_task: int = 65_536, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with `shard` (int) and `slot` (long): a uniformly random permutation cut into n_shards runs.

    Law: rows. Shard counts differ by one at most, and slots run gapless from 0 in each shard. The result depends on
    the rows, n_shards, seed and rows_per_task alone, not on how the input is partitioned, so reruns agree.

    - Nulls and empty or very long texts are hashed like any value. Rows equal in every column are numbered, and each is
      dealt by its number too: copies spread over partitions, shards and slots like unlike rows. They are
      interchangeable: which copy gets which slot can't be told apart.
    - An empty table gives an empty table. Names of own columns are changed where df has them already; if `shard` or
      `slot` itself is taken, underscores are appended.
    - Columns of map type can't be hashed; leave them out or cast them first.
    """
    taken = df.columns
    row_id, part, order, again, rank, block = (free_name(taken, f"__{x}") for x in ("row", "part", "order", "again", "rank", "block"))
    shard_col, slot_col = free_name(taken, shard_col), free_name(taken, slot_col)
    columns = [F.col(f"`{c}`") for c in taken]
    # Ids hold from here on, as the rows are read back with them.
    whole = materialize(df.withColumn(row_id, F.monotonically_increasing_id()), "rows")
    n = whole.count()
    n_parts = 64
    while n_parts * rows_per_task < n:
        n_parts *= 2
    # Hashes pass over nulls, so it is hashed too which columns are null.
    nulls = [c.isNull() for c in columns]
    values = whole.select(F.col(row_id), F.xxhash64(F.lit(seed), *columns, *nulls).alias("__v"), F.xxhash64(F.lit(seed + 1), *columns, *nulls).alias("__w"))
    copies = number_copies(values, ["__v", "__w"], row_id, n_parts, "__copy")
    key = lambda i: F.xxhash64(F.lit(seed + i), "__v", "__w", "__copy")
    keyed = materialize(copies.select(row_id, F.pmod(key(2), F.lit(n_parts)).cast("long").alias(part), key(3).alias(order), key(4).alias(again)), "keyed")
    counts = keyed.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(counts, n_parts, n_shards, seed).withColumnsRenamed({"part": part, "ends": "__ends"})
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(order, again)).cast("long") - 1)
    to_shard = F.size(F.filter("__ends", lambda e: e <= F.col(rank))).cast("int")
    to_block = F.shiftrightunsigned(F.col(again), 64 - (n_parts.bit_length() - 1)).cast("long")
    deal = materialize(ranked.join(matrix, part).select(row_id, again, to_shard.alias(shard_col), to_block.alias(block)), "deal")

    counts = deal.groupBy(shard_col, block).agg(F.count("*").alias("__n"))
    start = free_name([*taken, shard_col, slot_col], "__first")
    first = counts.withColumn(start, F.sum("__n").over(Window.partitionBy(shard_col).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))).select(shard_col, block, F.coalesce(start, F.lit(0)).alias(start))
    dealt = whole.join(deal, row_id).join(first, [shard_col, block])
    slot = F.col(start) + F.row_number().over(Window.partitionBy(shard_col, block).orderBy(again)) - 1
    return dealt.withColumn(slot_col, slot.cast("long")).select(*columns, shard_col, slot_col)


def op9_shard_rows(spark, sf_dir: str) -> DataFrame:
    """Law `rows`: all documents, whole, into shards 0 to 15. Size is the UTF-8 bytes of the text dealt plus 1."""
    dealt = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary")).cast("long")
    return dealt.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
