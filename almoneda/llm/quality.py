"""Quality rules: base counts and repetition, then the divergence of a document from its language's reference.

Two histograms describe a document: its characters by class, and its words among the language's common words. Both are
compared with the language's reference by Jensen-Shannon distance (base 2, so from 0 to 1), each with a guard of least
length below which it isn't judged. A reference is a frozen table, or the sum over trusted documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoneda.llm import textcore
from almoneda.llm.shared import WORD, materialize

#: Character classes; every code point is in one of them. Fixed values.
CLASSES = {
    "lower": r"[a-z]",
    "upper": r"[A-Z]",
    "digit": r"[0-9]",
    "space": r"[\x20\x09-\x0D]",
    "stop": r"[.,;:!?]",
    "symbol": r"[#*$%&|<>]",
    "other_ascii": r"[\x00-\x08\x0E-\x1F\x22\x27-\x29\x2B\x2D\x2F\x3D\x40\x5B-\x60\x7B\x7D-\x7F]",
    "beyond": r"[^\x00-\x7F]",
}
#: Short common words a language; a document's histogram has one bin each and one for all other words. Fixed values.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "he", "for", "it", "with", "as", "on", "be", "at", "by", "this", "are", "or", "from", "an", "a", "not"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur", "ne", "se", "il", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o"),
}
_CLASS_OF = np.full(256, 6, np.int64)  # by byte; a byte that continues a code point is never counted
_CLASS_OF[97:123], _CLASS_OF[65:91], _CLASS_OF[48:58], _CLASS_OF[128:] = 0, 1, 2, 7
_CLASS_OF[[9, 10, 11, 12, 13, 32]] = 3
_CLASS_OF[[ord(c) for c in ".,;:!?"]] = 4
_CLASS_OF[[ord(c) for c in "#*$%&|<>"]] = 5


def _repeats(hashes: np.ndarray, size: int) -> int:
    """Words inside windows of `size` words that occur at least twice, the first occurrence included."""
    runs = textcore.window_hashes(hashes, size)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    cover = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _common_hashes() -> dict[str, np.ndarray]:
    out = {}
    for lang, words in COMMON.items():
        data = " ".join(words).encode()
        out[lang] = textcore.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes()
    return out


def measures(docs: DataFrame, window: int = 8) -> DataFrame:
    """For each row of docs (id, lang, text): the counts of the contract, and histograms `classes` and `commons`.

    The text's words are stripped of nothing but lowered in A-Z for the common words; a language without a list has one
    bin, all words.
    """
    schema = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, commons array<long>"

    def run(batches):
        commons = _common_hashes()
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, data, offsets in textcore.chunks(batch.column(2)):
                words = textcore.Words(data, offsets)
                hashes, low = words.hashes(lower=False), words.hashes()
                begins = (data & 0xC0) != 0x80
                point = np.concatenate([[0], np.cumsum(begins)])
                in_words = point[words.ends] - point[words.starts]
                chars = np.concatenate([[0], np.cumsum(in_words)])
                kinds = np.where(begins, _CLASS_OF[data], 8)
                line = data == 10
                line_ends = np.flatnonzero(line)
                out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "commons")}
                for k in range(j - i):
                    a, b = int(words.firsts[k]), int(words.firsts[k + 1])
                    s, e = int(offsets[k]), int(offsets[k + 1])
                    hist = np.bincount(kinds[s:e], minlength=9)[:8]
                    out["n_words"].append(b - a)
                    out["word_chars"].append(int(chars[b] - chars[a]))
                    out["n_symbols"].append(int(hist[5]))
                    out["n_repeat_words"].append(_repeats(hashes[a:b], window) if b - a > window else 0)
                    lines = data[s:e].tobytes().split(b"\n") if np.searchsorted(line_ends, e) > np.searchsorted(line_ends, s) else []
                    seen: dict[bytes, int] = {}
                    for x in lines:
                        if x.strip(b" \t\n\x0b\x0c\r"):
                            seen[x] = seen.get(x, 0) + 1
                    out["n_dup_lines"].append(sum(seen.values()) - len(seen))
                    out["classes"].append(hist.tolist())
                    own = commons.get(langs[i + k])
                    if own is None:
                        out["commons"].append([b - a])
                    else:
                        at = np.searchsorted(own_sorted := np.sort(own), low[a:b])
                        hit = own_sorted[np.minimum(at, len(own) - 1)] == low[a:b]
                        bins = np.argsort(own, kind="stable")[at[hit]]
                        out["commons"].append([*np.bincount(bins, minlength=len(own)).tolist(), int((~hit).sum())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *[pa.array(out[k], pa.int64()) for k in list(out)[:5]], *[pa.array(out[k], pa.list_(pa.int64())) for k in list(out)[5:]]],
                    ["id", "lang", *out],
                )

    return docs.select("id", "lang", "text").mapInArrow(run, schema)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms (arrays of counts of one length, not all zero): 0 for equal shapes, 1 for disjoint."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    shares = F.zip_with(p, q, lambda x, y: F.struct((x / total(p)).alias("p"), (y / total(q)).alias("q")))
    terms = F.transform(shares, lambda s: 0.5 * (term(s["p"], (s["p"] + s["q"]) / 2) + term(s["q"], (s["p"] + s["q"]) / 2)))
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """(ref_lang, ref_classes, ref_commons): the histograms of each language, summed over all documents given."""
    wide = {c: max(len(COMMON[x]) for x in COMMON) + 1 if c == "commons" else len(CLASSES) for c in ("classes", "commons")}
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}_{k}") for c in wide for k in range(wide[c])]
    flat = measured.groupBy("lang").agg(*sums)
    bins = lambda c: F.transform(F.filter(F.array(*[f"{c}_{k}" for k in range(wide[c])]), lambda x: x.isNotNull()), lambda x: x.cast("double"))
    return flat.select(F.col("lang").alias("ref_lang"), bins("classes").alias("ref_classes"), bins("commons").alias("ref_commons"))


def language_references(measured: DataFrame, failed: Column, trusted: DataFrame | None = None, least_reference: int = 2_000) -> DataFrame:
    """references(...) of the documents in `trusted` (id) that haven't failed; of all that haven't, for languages where
    those have fewer than least_reference words. What other documents say then doesn't move a language's reference."""
    passed = measured.filter(~failed)
    if trusted is None:
        return references(passed)
    known = materialize(passed.join(trusted.select("id").distinct(), "id", "left_semi"), "trusted")
    enough = materialize(known.groupBy("lang").agg(F.sum("n_words").alias("n")).filter(F.col("n") >= least_reference).select(F.col("lang").alias("sure")), "languages")
    same = F.col("lang").eqNullSafe(F.col("sure"))
    return references(known.join(enough, same, "left_semi")).unionByName(references(passed.join(enough, same, "left_anti")))


def quality(
    docs: DataFrame, refs: DataFrame | None = None, trusted: DataFrame | None = None, least_words: int = 20, most_repeats: int = 30, guard_chars: int = 200, guard_words: int = 100,
    most_classes: float = 0.3, most_commons: float = 0.29, least_reference: int = 2_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """doc_id, the base counts, base_failed, js_classes, js_commons and kept for every row of docs.

    base_failed: fewer than least_words words, or more than most_repeats percent of the words in repeated 8-word windows.
    kept: not base_failed, and for each histogram that is long enough (guard_chars characters, guard_words words) a
    distance of at most most_classes and most_commons; a shorter one is not judged and its distance is null.

    refs: frozen references, as language_references gives them and a table can hold them. Without, they are made here from
    the documents whose ids are in `trusted` (id), and for a language without enough of those from all its documents.

    - Null and empty texts have counts of 0 and fail. A null language is one of its own. A language without a list of common
      words, or without a reference, isn't judged by what it lacks.
    - Repeated rows are judged alike, each on its own. An empty table gives an empty table. Other columns are left aside.
    """
    measured = materialize(measures(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))), "measures")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    if refs is None:
        refs = materialize(language_references(measured, failed, trusted, least_reference), "references")
    if refs.count() <= 10_000:
        refs = F.broadcast(refs)
    d = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    d = d.withColumns({
        "js_classes": F.when(chars >= guard_chars, jensen_shannon(as_double("classes"), F.col("ref_classes"))),
        "js_commons": F.when(F.col("n_words") >= guard_words, jensen_shannon(as_double("commons"), F.col("ref_commons"))),
    })
    fine = (F.coalesce("js_classes", F.lit(0.0)) <= most_classes) & (F.coalesce("js_commons", F.lit(0.0)) <= most_commons)
    return d.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept"), "js_classes", "js_commons")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents by the default rules; references from the documents that labels call good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select(F.col("doc_id").cast("long").alias("id"))
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted=good).drop("js_classes", "js_commons")


def _oracle() -> str:
    classes = ", ".join(f"len(regexp_extract_all(t, '{p}'))" for p in CLASSES.values())
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())
    js = lambda h, r: (
        f"(SELECT sqrt(greatest(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)), 0))"
        f" FROM (SELECT unnest({h}) / list_sum({h})::DOUBLE AS p, unnest({r}) / list_sum({r})::DOUBLE AS q))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        CASE lang {lists} ELSE [] END AS cw FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
h AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, x) >= 2),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, 8)) AS k FROM h) GROUP BY rid),
v AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}') GROUP BY rid),
c AS (SELECT rid, list(n ORDER BY bin) AS commons FROM (
        SELECT rid, bin, count(word) AS n FROM (
          SELECT b.rid, b.bin, m.word FROM (SELECT rid, unnest(range(0, len(cw) + 1)) AS bin FROM w) b
          LEFT JOIN (SELECT rid, word, CASE WHEN list_position(cw, word) IS NULL THEN len(cw) ELSE list_position(cw, word) - 1 END AS bin FROM (SELECT rid, cw, unnest(regexp_extract_all(low, '{WORD}')) AS word FROM w)) m
          ON m.rid = b.rid AND m.bin = b.bin) GROUP BY rid, bin) GROUP BY rid),
a AS (SELECT w.doc_id, w.lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '{CLASSES["symbol"]}')) AS BIGINT) AS n_symbols, CAST(coalesce(v.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        [{classes}] AS classes, c.commons FROM w LEFT JOIN r USING (rid) LEFT JOIN v USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a),
k AS (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS trusted FROM b WHERE NOT base_failed),
e AS (SELECT lang FROM k WHERE trusted GROUP BY lang HAVING sum(n_words) >= 2000),
f AS (SELECT * FROM k WHERE trusted OR NOT EXISTS (SELECT 1 FROM e WHERE e.lang IS NOT DISTINCT FROM k.lang)),
rc AS (SELECT lang, list(n ORDER BY bin) AS ref_classes FROM (SELECT lang, bin, sum(n) AS n FROM (SELECT lang, unnest(classes) AS n, generate_subscripts(classes, 1) AS bin FROM f) GROUP BY lang, bin) GROUP BY lang),
rw AS (SELECT lang, list(n ORDER BY bin) AS ref_commons FROM (SELECT lang, bin, sum(n) AS n FROM (SELECT lang, unnest(commons) AS n, generate_subscripts(commons, 1) AS bin FROM f) GROUP BY lang, bin) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(CASE WHEN list_sum(classes) >= 200 THEN {js("classes", "ref_classes")} END, 0) <= 0.3
    AND coalesce(CASE WHEN n_words >= 100 THEN {js("commons", "ref_commons")} END, 0) <= 0.29 AS kept
FROM b LEFT JOIN rc ON rc.lang IS NOT DISTINCT FROM b.lang LEFT JOIN rw ON rw.lang IS NOT DISTINCT FROM b.lang
"""


ORACLE_SQL = _oracle()
