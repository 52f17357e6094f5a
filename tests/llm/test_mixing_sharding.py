import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from almoneda.llm import mixing, sharding


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        t = {s: most * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s] + 1e-9]
        if not over:
            return t
        capped |= set(over)


def rows():
    rng = random.Random(2)
    out = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "b", "c", "é", None] + ["hot"] * 5)) for i in range(600)]
    return out + [(9000, None, "a"), (9001, "", "only empty"), (9002, "x " * 50_000, "b"), (None, "n u l l", "c"), (3, "again again", "c")]


def test_mix_meets_targets(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("taken", F.lit("mine"))
    got = mixing.mix(df.repartition(6)).collect()
    again = mixing.mix(df.repartition(2)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    sizes, taken, t, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        n = len((r.text or "").split())
        assert r.size == n and r.taken_ in {n * k for k in range(4)} and r.taken == "mine"
        sizes[r.source] += n
        taken[r.source] += r.taken_
        longest[r.source] = max(longest[r.source], n)
        t[r.source] = r.target
    want = targets(sizes)
    for s in sizes:
        assert math.isclose(t[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - t[s]) <= longest[s] / 2 + 4
    assert mixing.mix(df.limit(0)).count() == 0


def test_repeated_ids_still_meet_the_target(spark):
    docs = [(i % 2 or None, f"{i} " + "w " * 9, "a") for i in range(40)] + [(9, "x " * 4000, "b"), (10, "y " * 400, "c")]
    taken, target = defaultdict(int), {}
    for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(taken["a"] - target["a"]) <= 5.5


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    sizes = {f"site{i}.é" if i % 3 else f"Site{i}": rng.choice([0, 1, 7, 50, 10_000]) for i in range(500)} | {None: 40, "": 3}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_thresholds_are_nested(spark):
    docs = [(i, "w " * (i % 9 + 1), "s") for i in range(400)]
    sized = spark.createDataFrame(docs, "doc_id long, text string, source string").select("doc_id", "source", mixing.hash_key(F.col("doc_id"), F.col("text")).alias("key"), F.lit(3).cast("long").alias("size"))
    before = -1
    for budget in (0.5, 10.0, 90.0, 600.0, 1199.0, 1200.0, 5000.0):
        cut = mixing.thresholds(sized, spark.createDataFrame([("s", budget)], "source string, budget double")).first().threshold
        n = sized.filter(F.col("key") < cut).count()
        assert cut >= before and abs(3 * n - min(budget, 1200)) <= 1.5
        before = cut


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000])
def test_shards_are_exact_and_gapless(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise("same").alias("text"), F.lit(1).alias("slot"))
    got = sharding.shard_rows(df.repartition(3), 16)
    assert got.columns == ["doc_id", "text", "slot", "shard", "slot_"]
    found = got.collect()
    assert sorted(r.doc_id for r in found) == list(range(n))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot_)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    if n == 1000:
        again = {(r.doc_id, r.shard, r.slot_) for r in sharding.shard_rows(df.repartition(7), 16).collect()}
        assert again == {(r.doc_id, r.shard, r.slot_) for r in found}
        assert {(r.doc_id, r.shard) for r in sharding.shard_rows(df, 16, seed=3).collect()} != {(r.doc_id, r.shard) for r in found}


def test_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(None, None)] * 40 + [(1, "a" * 200_000)] * 9, "doc_id long, text string")
    found = sharding.shard_rows(df, 4).select("doc_id", "shard", "slot").collect()
    assert len({(r.shard, r.slot) for r in found}) == 49 and sorted(Counter(r.shard for r in found).values()) == [12, 12, 12, 13]


def test_hypergeometric_law(spark):
    total, marked, drawn, n = 60, 25, 18, 20_000
    u = "((shiftrightunsigned(xxhash64(id), 11) + 0.5D) / 9007199254740992.0D)"
    x = spark.range(n).select(F.expr(sharding._hypergeometric(f"double({total})", f"double({marked})", f"double({drawn})", u)).alias("x"))
    got = {int(r.x): r["count"] for r in x.groupBy("x").count().collect()}
    chi = 0.0
    for k in range(drawn + 1):
        p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        if n * p >= 5:
            chi += (got.get(k, 0) - n * p) ** 2 / (n * p)
    assert sum(got.values()) == n and chi < 40  # about 13 degrees of freedom
    edge = spark.sql(f"SELECT {sharding._hypergeometric('double(5)', 'double(5)', 'double(3)', '0.5D')} a, {sharding._hypergeometric('double(5)', 'double(0)', 'double(3)', '0.5D')} b, {sharding._hypergeometric('double(9)', 'double(4)', 'double(9)', '0.1D')} c").first()
    assert tuple(edge) == (3.0, 0.0, 4.0)


def test_matrix_margins(spark):
    counts = spark.createDataFrame([(i, (i * 37) % 50) for i in range(60)], "part long, n long")
    rows_ = sharding.communication_matrix(counts, 64, 5, 1).collect()
    sent = {r.part: [b - a for a, b in zip([0, *r.ends], r.ends)] for r in rows_}
    assert len(sent) == 64 and all(min(v) >= 0 for v in sent.values())
    assert all(sum(sent[i]) == (i * 37) % 50 for i in range(60))
    columns = [sum(v[s] for v in sent.values()) for s in range(5)]
    assert max(columns) - min(columns) <= 1


def test_equal_texts_spread(spark):
    """A third of the rows share a text; no shard takes more of them than chance allows."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    got = [r["count"] for r in sharding.shard_rows(df, 16).filter("text = 'copy'").groupBy("shard").count().collect()]
    assert len(got) == 16 and all(abs(x - 62.5) < 32 for x in got)


def test_shard_query_deals_whole_documents(spark, sf_dir, monkeypatch):
    """The query hands every column to shard_rows, and its digests tell what came out: texts swapped on the way show."""
    seen, deal = [], sharding.shard_rows

    def swapped(df, *args):
        seen.append(df.columns)
        return deal(df, *args).withColumn("text", F.lit("swapped"))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(r.doc_id, r.shard, r.slot) for r in deal(docs, 16).select("doc_id", "shard", "slot").collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.op9_shard_rows(spark, sf_dir).collect()} == want
    monkeypatch.setattr(sharding, "shard_rows", swapped)
    assert {r.size for r in sharding.op9_shard_rows(spark, sf_dir).collect()} == {8} and seen == [docs.columns]


def test_equal_rows_spread(spark):
    """Rows equal in every column go to all shards and aren't neighbours there, whatever the partitions of the input."""
    df = spark.range(1600).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.shard_rows(df, 16).collect()
    copies = [r for r in found if r.doc_id == -1]
    counts = Counter(r.shard for r in copies)
    assert len(copies) == 800 and len(counts) == 16 and all(abs(n - 50) < 25 for n in counts.values())
    slots = defaultdict(set)
    for r in copies:
        slots[r.shard].add(r.slot)
    assert sum(s + 1 in x for x in slots.values() for s in x) < 550  # about 400 by chance, 784 side by side
    assert Counter(map(tuple, sharding.shard_rows(df.repartition(7), 16).collect())) == Counter(map(tuple, found))


def test_copies_are_numbered_in_groups(spark):
    rows = spark.range(900).select("id", F.when(F.col("id") < 500, 1).otherwise(F.col("id") % 50 + 2).alias("v"))
    got = defaultdict(list)
    for r in sharding.number_copies(rows, ["v"], "id", 8, "k").collect():
        got[r.v].append(r.k)
    assert len(got) == 51 and all(sorted(x) == list(range(len(x))) for x in got.values())


def test_copies_of_one_row_are_taken_as_needed(spark):
    """30 equal rows make one source; half of a further source is one row repeated. Each comes within half a row of its target."""
    rows = [(1, "w " * 10, "a")] * 30 + [(k, "w " * 10, "b") for k in range(100)] + [(7, "w " * 10, "c")] * 40 + [(200 + k, "w " * 10, "c") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for weights in ((5, 2, 1), (1, 1, 1), (3, 1, 2), (1, 9, 4)):
        got = mixing.mix(docs, weights).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
        assert all(abs(r.n - r.target) <= 5.0 + 1e-9 and r.most <= 3 for r in got), got


@pytest.mark.parametrize("name", ["mix", "shard", "lines", "one"])
def test_internal_names_may_be_columns(spark, name):
    """A table that has every name an operator uses inside, as columns of its own."""
    from almoneda.llm import linededup, neardup

    inside = "__source __n __target __whole __cut __part __key __row __number __text_hash __id __hash __gone __first __order __again __rank __block __ends __copy __v __w size source_size taken shard slot n_lines n_removed clean_text key a b of row".split()
    docs = spark.createDataFrame([(k, f"line {k} of words and more words to be alike\nshared line of many words here", "s" if k % 2 else None) for k in range(12)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(inside)])
    run = {"mix": mixing.mix, "shard": sharding.shard_rows, "lines": linededup.dedup_lines, "one": neardup.one_of_each}[name]
    plain, full = run(docs.select("doc_id", "text", "source")), run(docs)
    assert full.columns[: len(docs.columns)] == docs.columns and full.count() == plain.count()
    new = [c for c in plain.columns if c not in ("doc_id", "text", "source")]
    if name in ("mix", "lines"):
        a, b = ({tuple(r) for r in df.select("doc_id", *df.columns[len(df.columns) - len(new) :]).collect()} for df in (plain, full))
        assert a == b
