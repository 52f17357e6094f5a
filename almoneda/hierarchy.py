"""Classification and region hierarchies as joins over code tables (code, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoneda.functions import scalar as S


def cpv_ancestors(codes: DataFrame) -> DataFrame:
    """(code, path): labels of the ancestors that exist, from the division down; codes without any are left out."""
    level = S.cpv_level("code")
    ups = F.array_distinct(F.transform(F.sequence(F.lit(2), F.greatest(level - 1, F.lit(2))), lambda n: F.rpad(F.substring(F.col("code"), F.lit(1), n), 8, "0")))
    up = codes.filter(level > 2).select("code", F.explode(F.filter(ups, lambda u: u != F.col("code"))).alias("up"))
    named = up.hint("merge").join(codes.select(F.col("code").alias("up"), "label"), "up")  # both sides grow with the codes
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("up", "label"))), lambda x: x["label"])  # six at most
    return named.groupBy("code").agg(F.array_join(ordered, " > ").alias("path"))


def cpv_children(codes: DataFrame) -> DataFrame:
    """(parent, child): codes exactly one level below."""
    level = S.cpv_level("code")
    parent = codes.withColumn("lvl", level).filter("lvl < 8").select(F.col("code").alias("parent"), F.col("lvl").alias("plvl"), F.substring("code", F.lit(1), F.col("lvl")).alias("stem"))
    child = codes.withColumn("lvl", level).filter("lvl > 2").select(F.col("code").alias("child"), (F.col("lvl") - 1).alias("plvl"), F.substring("code", F.lit(1), F.col("lvl") - 1).alias("stem"))
    return parent.join(child, ["plvl", "stem"]).select("parent", "child")


def miller_columns(codes: DataFrame, path: list[str], levels: list[int] | None = None) -> DataFrame:
    """(col, code, label): divisions, then for each step of a drill path the codes one level below it.

    levels overrides the level that each step's code is read at, for codes that end in zeros on purpose.
    """
    level = S.cpv_level("code")
    out = codes.filter(level == 2).select(F.lit(0).alias("col"), "code", "label")
    for i, step in enumerate(path):
        n = levels[i] if levels else max(len(step.split("-")[0].ljust(8, "0").rstrip("0")), 2)
        out = out.unionByName(codes.filter((level == n + 1) & F.col("code").startswith(step[:n])).select(F.lit(i + 1).alias("col"), "code", "label"))
    return out


def cpv_typeahead(codes: DataFrame, terms: list[str], most: int = 40) -> DataFrame:
    """The first codes, in order, that start with a term or whose label holds it; terms of one letter are ignored."""
    tests = [F.col("code").startswith(t) | F.contains(F.lower("label"), F.lit(t.lower())) for t in terms if len(t) >= 2]
    if not tests:
        return codes.limit(0)
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return codes.filter(test).orderBy("code").limit(most).select("code", "label")


def nuts_rollup(counts: DataFrame, level: int) -> DataFrame:
    """(nuts, n) summed to regions of a level from (nuts, n)."""
    return counts.groupBy(S.nuts_truncate("nuts", level).alias("nuts")).agg(F.sum("n").alias("n"))
