"""Stages of the corpus pipeline, in order; each works on all that its predecessor kept.

Every stage but the last returns the columns of `documents`, whatever further columns they have; the last adds each
document's shard and slot (underscores are appended to a name that is taken). Stages are tables in, tables out: nulls in any
column, empty and very long texts, ties, repeated rows and empty tables are rows like others, as each stage says.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda.llm import decontaminate, mixing, neardup, sharding, toxicity
from almoneda.llm.shared import free_name, materialize


def _columns(docs):
    return [F.col(f"`{c}`") for c in docs.columns]


def toxic_out(spark, docs, sf_dir):
    """Operator 7: documents that the classifier rejects (score of 0.7 or more) go.

    Null and empty texts get the score of an empty text. Rows that repeat an id are each scored by their own text; a null
    id is never labelled. Without usable labels plain insults decide.
    """
    model = toxicity.learned_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_rows(docs, model)
    return scored.filter(F.col(f"`{scored.columns[-1]}`") < 0.7).select(*_columns(docs))


def near_copies_out(spark, docs, sf_dir):
    """Operator 3: of each group of documents alike by 0.8 or more, the one of least id stays.

    Documents without words are alike nothing and stay. Of rows with one id and text one stays; rows that repeat an id with
    another text are judged by their own. A group of null ids keeps the row of the least text hash.
    """
    return neardup.one_of_each(docs, 4, 5)


def benchmark_out(spark, docs, sf_dir):
    """Operator 4: documents with a benchmark item in them go.

    Null and empty texts hold none and stay, as all do if there are no items. Texts of any length are searched whole.
    """
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size(f"`{found.columns[-1]}`") == 0).select(*_columns(docs))


def mix_sources(spark, docs, sf_dir):
    """Operator 8: each document as often as the mix takes it, 3 times at most.

    Documents without words have no size and are never taken. A null source is a source of its own. Rows that agree in id
    and text are taken together.
    """
    mixed = mixing.mix(docs)
    size, taken = (F.col(f"`{mixed.columns[i]}`") for i in (-4, -1))
    times = F.when(size > 0, (taken / size).cast("int")).otherwise(F.lit(0))
    copies = F.explode(F.array_repeat(F.lit(1), times))  # none where the mix takes none
    return mixed.select(*_columns(docs), copies.alias(free_name(docs.columns, "__copy"))).select(*_columns(docs))


def shard(spark, docs, sf_dir):
    """Operator 9: all that is left, dealt to 16 shards; rows equal in every column are dealt apart."""
    return sharding.shard_rows(docs, 16)


STAGES = [("toxicity", toxic_out), ("near-duplicates", near_copies_out), ("decontamination", benchmark_out), ("mixing", mix_sources), ("sharding", shard)]
#: The classifier and edit distances can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
