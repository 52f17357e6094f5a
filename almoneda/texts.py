"""Paragraph search and chunks of long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms that mark clauses of administrative and of technical documents. Fixed values.
PCAP_TERMS = ("penalidad", "penalización", "pago", "certificación", "modificación", "subcontratación", "seguro", "cesión", "resolución", "solvencia", "garantía")
PPT_TERMS = ("entregable", "fase", "sla", "nivel de servicio", "perfil", "experiencia", "titulación", "certificación", "iso", "tecnología", "software", "hardware", "lugar")


#: White space as Python and Java both see it.
_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def strip(text: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def extract_paragraphs(docs: DataFrame, terms: tuple[str, ...], max_chars: int = 4000, separator: str = "\n\n", least: int = 50) -> DataFrame:
    """(doc_id, picked): paragraphs by how often they hold the terms, as many as fit, ending at the first that doesn't.

    Each is followed by a blank line, and one fits if it and all before it, with their blank lines, have max_chars
    characters at most. Paragraphs of at most `least` characters and those without a term are left out; equal scores keep
    their order.
    """
    p = docs.select("doc_id", F.posexplode(F.split("text", separator))).select("doc_id", "pos", strip("col").alias("p")).filter(F.length("p") > least)
    low = F.lower("p")
    score = F.lit(0)
    for t in terms:
        score = score + (F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)
    p = p.withColumn("score", score.cast("int")).filter("score > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    fits = p.withColumn("through", F.sum(F.length("p") + 2).over(w) - 2).filter(F.col("through") <= max_chars)
    picked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "p"))), lambda x: F.concat(x["p"], F.lit("\n\n")))  # max_chars at most
    return fits.groupBy("doc_id").agg(F.array_join(picked, "").alias("picked"))


def excerpts(docs: DataFrame, terms: tuple[str, ...], max_chars: int = 8000, separator: str = "\n\n") -> DataFrame:
    """(doc_id, excerpt): the paragraphs picked, or the text's first max_chars characters if none was. Null texts are empty."""
    picked = extract_paragraphs(docs, terms, max_chars, separator)
    return docs.join(picked, "doc_id", "left").select("doc_id", F.coalesce("picked", F.left(F.col("text"), F.lit(max_chars)), F.lit("")).alias("excerpt"))


def prompt_text(text: Column | str, most: int = 40_000) -> Column:
    """What of a text a prompt takes."""
    return F.left(F.col(text) if isinstance(text, str) else text, F.lit(most))


def chunk(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, chunk_index, chunk_text): non-blank parts, numbered from 0."""
    parts = F.filter(F.transform(F.split("text", separator), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("chunk_index", "chunk_text"))


def chunk_list(docs: DataFrame, separator: str = "\n\n", page_break: str = "\f", heading: str = r"^#+\s+") -> DataFrame:
    """(doc_id, chunk_index, chunk_title, chunk_page_number, chunk_text): non-blank parts of pages, headings as titles.

    A part that `heading` matches is the title of those up to the next and no chunk of its own; parts before any have an
    empty title. Pages count from 1, chunks from 0.
    """
    pages = docs.select("doc_id", F.posexplode(F.split("text", page_break)).alias("page", "part"))
    parts = pages.select("doc_id", "page", F.posexplode(F.split("part", separator)).alias("pos", "x")).select("doc_id", "page", "pos", strip("x").alias("x")).filter("x <> ''")
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    is_title = F.rlike("x", F.lit(heading))
    titled = parts.withColumn("is_title", is_title).withColumn("title", F.last(F.when(is_title, F.regexp_replace("x", heading, "")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    index = F.row_number().over(order) - 1
    return titled.filter("NOT is_title").select("doc_id", index.alias("chunk_index"), F.coalesce("title", F.lit("")).alias("chunk_title"), (F.col("page") + 1).alias("chunk_page_number"), F.col("x").alias("chunk_text"))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): chunks in order, a blank line between."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])
    return chunks.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("text"))
