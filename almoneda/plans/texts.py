"""Queries of document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda import texts as X
from almoneda.plans.registry import query
from almoneda.plans.testbind import table

_COUNT = lambda t: f"CAST((length(lower(p)) - length(replace(lower(p), '{t}', ''))) / {len(t)} AS INTEGER)"


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _picked(most: int) -> str:
    return f"""l AS (SELECT doc_id, i - 1 AS pos, {_STRIP('parts[i]')} AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) u(i)),
s AS (SELECT doc_id, pos, p, {_COUNT('the')} + {_COUNT('onre')} AS score FROM l WHERE length(p) > 50),
c AS (SELECT *, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(p) AS through FROM s WHERE score > 0),
x AS (SELECT doc_id, string_agg(p || chr(10) || chr(10), '' ORDER BY score DESC, pos) AS picked FROM c WHERE through <= {most} GROUP BY doc_id)"""


@query("extractive_search", f"WITH {_picked(4000)} SELECT doc_id, picked FROM x")
def _(spark, d):
    return X.extract_paragraphs(table(spark, d, "documents"), ("the", "onre"), separator="\n")


@query("extract_or_truncate", f"WITH {_picked(8000)} SELECT doc_id, coalesce(picked, substr(text, 1, 8000)) AS excerpt, length(substr(text, 1, 40000)) AS prompt_chars FROM documents LEFT JOIN x USING (doc_id)")
def _(spark, d):
    docs = table(spark, d, "documents")
    return X.excerpts(docs, ("the", "onre"), separator="\n").join(docs.select("doc_id", F.length(X.prompt_text("text")).cast("long").alias("prompt_chars")), "doc_id")


@query("chunk_list", f"""WITH p AS (SELECT doc_id, page, x AS part, string_split(x, '. ') AS parts FROM (SELECT doc_id, i - 1 AS page, pages[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents), unnest(range(1, len(pages) + 1)) u(i))),
q AS (SELECT doc_id, page, i AS pos, {_STRIP('parts[i]')} AS x FROM p, unnest(range(1, len(parts) + 1)) u(i)),
t AS (SELECT *, regexp_matches(x, '^\\S+$') AS is_title FROM q WHERE x <> ''),
u AS (SELECT *, last_value(CASE WHEN is_title THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS INTEGER) AS chunk_index, coalesce(title, '') AS chunk_title, CAST(page + 1 AS INTEGER) AS chunk_page_number, x AS chunk_text FROM u WHERE NOT is_title""")
def _(spark, d):
    got = X.chunk_list(table(spark, d, "documents"), separator=r"\. ", page_break="\n", heading=r"^(?=\S+$)")
    return got


@query("chunk_documents", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, p AS chunk_text FROM (SELECT doc_id, i, trim(parts[i]) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) u(i)) WHERE p <> ''")
def _(spark, d):
    return X.chunk(table(spark, d, "documents"))


@query("chunk_concat", "SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, trim(parts[i]) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) u(i)) WHERE p <> '' GROUP BY doc_id")
def _(spark, d):
    return X.join_chunks(X.chunk(table(spark, d, "documents")))
