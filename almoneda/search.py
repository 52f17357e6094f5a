"""BM25, vector and hybrid retrieval as DataFrame plans. Every ranking has a total order: score, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoneda.spec import FilterSpec, browse
from almoneda.store import written

K1, B = 1.2, 0.75


#: A letter or digit, as `tokens` sees it.
_L = r"[\p{L}\p{N}]"


def tokens(text) -> Column:
    """Lowered runs of letters and digits."""
    t = F.col(text) if isinstance(text, str) else text
    spaced = F.trim(F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\p{L}\p{N}]+", " ")))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def n_tokens(text) -> Column:
    """How many `tokens` a text has; no array of words is built."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(t, F.lit("")), F.lit(f"{_L}+"))


def term_counts(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dl, tf0, tf1, ...): tokens of each document, and how many are each term. No array of words is built."""
    plain = F.coalesce(F.col(text), F.lit(""))
    count = lambda t: F.regexp_count(F.lower(plain), F.lit(f"(?<!{_L}){t}(?!{_L})"))
    return docs.select(F.col(doc_id).alias("doc_id"), n_tokens(text).alias("dl"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)])


def score_terms(hits: DataFrame, n_terms: int) -> DataFrame:
    """(doc_id, score) of rows (doc_id, dl, n, avgdl, tf0, df0, ...)."""
    idf = lambda i: F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: F.when(F.col(f"tf{i}") > 0, idf(i) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    score = F.lit(0.0)
    for i in range(n_terms):
        score = score + part(i)
    return hits.select("doc_id", score.alias("score"))


def plain_terms(terms: list[str]) -> list[str]:
    """Lowered terms of letters and digits, without repeats."""
    return [t for t in dict.fromkeys(t.lower() for t in terms) if t and t.isalnum()]


def bm25(docs: DataFrame, terms: list[str], allowed: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of documents that hold a term. One pass over the texts, which writes a few numbers a document.

    Document counts and mean length are those of all docs; `allowed` (doc_id) restricts what is returned, not them. For
    many queries over one corpus, see postings.Index.
    """
    terms = plain_terms(terms)
    counted = written(term_counts(docs, terms, doc_id, text), "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = counted.filter(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0), F.lit(0)) > 0)
    if allowed is not None:
        hits = hits.join(allowed, "doc_id", "left_semi")
    return score_terms(hits.crossJoin(F.broadcast(stats)), len(terms))  # one row


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: list[float], vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, score): certainty (1 + cosine) / 2 of every vector to one query, computed in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    norm = F.sqrt(_dot(F.col(embedding), F.col(embedding)))
    cos = F.when(norm * length > 0, _dot(F.col(embedding), q) / (norm * length)).otherwise(0.0)
    return vectors.select(F.col(vec_id), ((1 + cos) / 2).alias("score"))


def certainty(a: str, b: str) -> Column:
    """(1 + cosine) / 2 of two vector columns; 0.5 where one is null or zeros."""
    lengths = F.sqrt(_dot(F.col(a), F.col(a))) * F.sqrt(_dot(F.col(b), F.col(b)))
    return (1 + F.when(lengths > 0, _dot(F.col(a), F.col(b)) / lengths).otherwise(0.0)) / 2


def top(scored: DataFrame, key: str, k: int, offset: int = 0) -> DataFrame:
    return scored.orderBy(F.round("score", 9).desc(), key).offset(offset).limit(k)


def fuse(keyword: DataFrame, vector: DataFrame, alpha: float = 0.5, candidates: int = 100) -> DataFrame:
    """(id, score) of two rankings (id, score): each scaled to 0..1 over its candidates, mixed alpha to the vectors.

    A missing side counts 0; a ranking of equal scores counts 1.
    """

    def scaled(r: DataFrame, name: str) -> DataFrame:
        r = written(top(r, "id", candidates), "candidates")  # scored once
        ends = r.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        return r.crossJoin(F.broadcast(ends)).select("id", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias(name))

    both = scaled(keyword, "kw").join(scaled(vector, "vec"), "id", "full")
    return both.select("id", (alpha * F.coalesce("vec", F.lit(0.0)) + (1 - alpha) * F.coalesce("kw", F.lit(0.0))).alias("score"))


def fused_page(keyword: DataFrame, vector: DataFrame, k: int, offset: int = 0, alpha: float = 0.5, depth: int = 100, at_once: int = 50_000) -> DataFrame:
    """(id, score): one page of two rankings (id, score), each scaled to 0..1 over all its rows and mixed alpha to the vectors,
    whatever the offset.

    Both rankings are read from the top, further and further, until no id that neither has shown can enter the page: such
    an id has at most the mix of the two scores read last. A missing side counts 0; a ranking of equal scores counts 1.
    Once a ranking would be read beyond `at_once` rows, both are joined whole.
    """
    sides = []
    for r in (keyword, vector):
        r = written(r.select("id", "score"), "ranking")  # scored once
        lo, hi, n = r.agg(F.min("score"), F.max("score"), F.count("*")).first()
        scaled = (F.col("score") - lo) / (hi - lo) if n and hi > lo else F.lit(1.0)
        sides.append((r.select("id", scaled.alias("score")), n))
    (kw, n_kw), (vec, n_vec) = sides
    mixed = lambda a, b: a.withColumnRenamed("score", "kw").join(b.withColumnRenamed("score", "vec"), "id", "full").select("id", (alpha * F.coalesce("vec", F.lit(0.0)) + (1 - alpha) * F.coalesce("kw", F.lit(0.0))).alias("score"))
    depth, wanted = max(depth, 2 * (offset + k)), offset + k
    while depth < max(n_kw, n_vec) and depth <= at_once:
        heads = [written(top(r, "id", depth), "head") for r, _ in sides]
        least = [h.agg(F.min("score")).first()[0] if n > depth else 0.0 for h, (_, n) in zip(heads, sides)]  # of a ranking read whole nothing is left
        bar = alpha * (least[1] or 0.0) + (1 - alpha) * (least[0] or 0.0)
        seen = F.broadcast(heads[0].select("id").unionByName(heads[1].select("id")).distinct())  # at most 2 * depth ids
        fused = written(mixed(kw.join(seen, "id", "left_semi"), vec.join(seen, "id", "left_semi")), "fused")
        n, last = top(fused, "id", wanted).agg(F.count("*"), F.min(F.round("score", 9))).first()
        if n == wanted and last > round(bar, 9):
            return top(fused, "id", k, offset)
        depth *= 4
    return top(mixed(kw, vec), "id", k, offset)


def search(df: DataFrame, spec: FilterSpec, q: str | None = None, mode: str = "hybrid", k: int = 15, offset: int = 0, alpha: float = 0.5, sort: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """One page of results. Without a text it browses, and without a text or filter it is empty.

    df needs sid, and for texts `content`, for vectors `embedding`. Keyword statistics are those of all of df.
    """
    if not q and not spec.active():
        return df.limit(0)
    if not q:
        return browse(df, spec, sort, k, offset)
    k, found = min(max(k, 1), 50), spec.apply(df)
    keyword = vectors = None
    if mode in ("keyword", "hybrid"):
        keyword = bm25(df, tokens_of(q), found.select(F.col("sid").alias("doc_id")), "sid", "content").withColumnRenamed("doc_id", "id")
    if mode in ("vector", "hybrid"):
        from almoneda.providers import embed_one

        vectors = cosine(found, vector or embed_one(q), "sid", "embedding").withColumnRenamed("sid", "id")
    page = top(keyword if vectors is None else vectors, "id", k, offset) if keyword is None or vectors is None else fused_page(keyword, vectors, k, offset, alpha)
    return df.join(page.withColumnRenamed("id", "sid"), "sid").orderBy(F.desc("score"), "sid")


def tokens_of(q: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in q.lower()).split()


def company_documents(companies: DataFrame) -> DataFrame:
    """(sid, content) of companies (nif, name, ...): the text that company search looks through, all fields named."""
    fields = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in companies.columns if c != "nif"]
    return companies.select(F.col("nif").alias("sid"), F.concat_ws(". ", *fields).alias("content"))


def search_companies(companies: DataFrame, q: str, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """(sid, content, score): hybrid search over company documents (sid, content), embedded here unless they are already."""
    from almoneda.providers import embed

    docs = companies if "embedding" in companies.columns else embed(companies)
    return search(docs, FilterSpec(), q, "hybrid", k, alpha=alpha).select("sid", "content", F.round("score", 6).alias("score"))


def criteria_of(stored: DataFrame, sid: str, schema: str) -> DataFrame:
    """(sid, criteria): the stored criteria of one contract as a struct; LookupError if there are none."""
    found = stored.filter(F.col("sid") == sid).select("sid", F.from_json("criteria_json", schema).alias("criteria")).limit(1)
    if found.isEmpty():
        raise LookupError(sid)
    return found
