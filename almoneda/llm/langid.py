"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Every n-gram of 1 to 4 letters within a word (its ends count as a letter) falls into one of `dims` bins. Document frequencies
are summed over all labelled documents; the weights come from a bounded sample of them, by follow-the-regularised-leader with
elastic-net penalties, so most weights are zero; a temperature fitted on rows left aside makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almoneda.llm import textcore
from almoneda.llm.shared import discard, materialize
from almoneda.llm.textcore import U, mix64

ORDERS = (1, 2, 3, 4)
DIMS = 1 << 17
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lowered letter, or a space if it is none."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def terms(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, count) of the n-grams of each text of a chunk, ordered by text and bin."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letters = _letters()[points]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    keep = letters != 32
    keep[1:] |= (letters[:-1] != 32) & (doc[1:] == doc[:-1])  # one space after each word
    letters, doc = letters[keep], doc[keep]
    n_docs = len(offsets) - 1
    chars = np.full(len(letters) + n_docs + 1, 32, np.uint64)  # a space before each text and after the last
    chars[np.arange(len(letters)) + doc + 1] = letters
    owner = np.repeat(np.arange(n_docs + 1), np.append(np.bincount(doc, minlength=n_docs) + 1, 1))
    spaces = np.concatenate([[0], np.cumsum(chars == 32)])
    keys, rolled = [], np.zeros(len(chars), U)
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * U(0x9E3779B97F4A7C15) + chars[n - 1 : n - 1 + m] + U(1)
        if n not in ORDERS:
            continue
        inner = spaces[n - 1 : n - 1 + m] - spaces[1 : 1 + m] if n > 1 else spaces[1 : 1 + m] - spaces[:m]
        fit = inner <= 0 if n > 1 else inner == 0
        if n == 2:
            fit &= (spaces[2 : 2 + m] - spaces[:m]) < 2
        i = np.flatnonzero(fit)
        keys.append(owner[i] * dims + (mix64(rolled[i] ^ U(n << 56)) & U(dims - 1)).astype(np.int64))
    keys = np.sort(np.concatenate(keys))
    begin = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(keys)))
    return keys[begin] // dims, keys[begin] % dims, counts


def weighted(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, value): TF-IDF of unit length, (1 + ln count) times idf."""
    doc, at, n = terms(data, offsets, len(idf))
    value = (1 + np.log(n)) * idf[at]
    size = np.sqrt(np.bincount(doc, value * value, len(offsets) - 1))
    return doc, at, value / np.maximum(size[doc], 1e-12)


class Leader:
    """FTRL-Proximal for softmax regression: one weight a bin and class, kept as the sums z and n."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z, self.n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))  # the last row is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)[:, None]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits, from 0.02 to 50, under which the labels are likeliest, where each label leaves one part
    in N + 2 to all languages alike (else rows without an error would ask for certainty). The loss has one least point,
    so thirds of the range are dropped in turn."""
    if not len(labels):
        return 1.0
    blur = 1 / (len(labels) + 2)

    def loss(x):
        z = logits * np.exp(x)
        own = (1 - blur) * z[np.arange(len(z)), labels] + blur * z.mean(1)
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - own).mean())

    lo, hi = np.log(1 / 50), np.log(1 / 0.02)
    for _ in range(60):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp(-(lo + hi) / 2))


@dataclass
class Model:
    """langs in order; idf of each bin; rows: bin to row of weights or -1; the last row of weights is the bias."""

    langs: list[str]
    idf: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its language, -1 if it has no letter, and the probability."""
        n = len(offsets) - 1
        best, score = np.full(n, -1), np.zeros(n)
        doc, at, value = weighted(data, offsets, self.idf)
        if not self.langs or not len(doc):
            return best, score
        row = self.rows[at]
        on = row >= 0
        logits = np.stack([np.bincount(doc[on], value[on] * self.weights[row[on], k], n) for k in range(len(self.langs))], axis=1) + self.weights[-1]
        p = softmax(logits / self.temperature)
        has = np.bincount(doc, minlength=n) > 0
        best[has], score[has] = p[has].argmax(1), p[has].max(1)
        return best, score


def document_frequencies(labelled: DataFrame, dims: int = DIMS) -> np.ndarray:
    """In how many texts each bin occurs, and in the last place the number of texts. labelled: (text)."""

    def run(batches):
        n = np.zeros(dims + 1, np.int64)
        for batch in batches:
            for i, j, data, offsets in textcore.chunks(batch.column(0)):
                n[:dims] += np.bincount(terms(data, offsets, dims)[1], minlength=dims)
                n[dims] += j - i
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bin", "n"])

    summed = labelled.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most dims + 1 rows
    out = np.zeros(dims + 1, np.int64)
    out[summed["bin"].to_numpy()] = summed["n"].to_numpy()
    return out


def bounded_sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """(h, lang, text): at most max_rows rows of labelled (id, lang, text), of each language as many as there are, up to
    its share; those of the least hash of their ids. Rows that can't be among them go before texts are read on."""
    spark = labelled.sparkSession
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = max(1, counts.count())
    share = max(1, max_rows // n_langs)
    h = F.xxhash64(F.lit(12), F.col("id"))
    likely = F.least(F.lit(1.0), (2.0 * share + 20) / F.col("n"))
    limits = counts.select(F.col("lang").alias("of"), likely.alias("likely"))
    if n_langs <= 10_000:
        limits = F.broadcast(limits)
    near = labelled.withColumn("h", h).join(limits, F.col("lang") == F.col("of")).filter(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("likely") * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h", F.xxhash64("text"))
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share).select("h", "lang", "text").limit(max_rows)


def fit(labelled: DataFrame, max_rows: int = 6_000, dims: int = DIMS, epochs: int = 3) -> Model:
    """A model from (id, lang, text): document frequencies from all rows, weights from at most max_rows of them, of
    which every fifth is left aside for the temperature."""
    df = document_frequencies(labelled, dims)
    idf = np.log((1 + df[dims]) / (1 + df[:dims])) + 1
    sample = materialize(bounded_sample(labelled, max_rows), "langs")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())  # at most max_rows
    if not langs:
        discard(sample)
        return Model([], idf, np.full(dims, -1), np.zeros((1, 0)), 1.0)
    number = {x: i for i, x in enumerate(langs)}

    def learn(batches) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, j, data, offsets in textcore.chunks(batch.column(2)):
                doc, at, value = weighted(data, offsets, idf)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                for k, (h, lang) in enumerate(zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist())):
                    rows.append((h, number[lang], at[cuts[k] : cuts[k + 1]].astype(np.int32), value[cuts[k] : cuts[k + 1]].astype(np.float32)))
        rows = [r for r in rows if len(r[2])]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        aside = [r for i, r in enumerate(rows) if i % 5 == 4] if len(rows) >= 50 else []
        leader = Leader(dims, len(langs))
        for _ in range(epochs):
            for i, (_, label, at, value) in enumerate(rows):
                if not aside or i % 5 != 4:
                    leader.learn(at, value, label)
        w = leader.weights(np.arange(dims + 1))
        logits = np.array([v @ w[a] + w[-1] for _, _, a, v in aside]).reshape(-1, len(langs))
        t = temperature(logits, np.array([r[1] for r in aside], np.int64))
        on = np.flatnonzero((w[:-1] != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([on.tolist()], pa.list_(pa.int32())), pa.array([w[[*on.tolist(), dims]].astype(np.float32).tobytes()]), pa.array([t])], ["bins", "w", "t"])

    got = sample.coalesce(1).mapInArrow(learn, "bins array<int>, w binary, t double").first()
    discard(sample)
    rows = np.full(dims, -1)
    rows[got.bins] = np.arange(len(got.bins))
    return Model(langs, idf, rows, np.frombuffer(bytes(got.w), np.float32).reshape(-1, len(langs)).astype(float), got.t)


def _held(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def languages(docs: DataFrame, max_rows: int = 6_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, by a model of its rows with a language that aren't held
    out (crc32(doc_id as text) mod 4 is not 2). The prediction reads the text alone; at most max_rows rows fit the weights.

    - Null texts and those without a letter are `und` with score 0, as is all if no row has a language. Long texts are
      read whole.
    - A null id counts as the empty text for the remainder. Rows that repeat an id or a text are each predicted and each
      counted. Of equal probabilities the first language in code point order wins.
    - ids keep their type; other columns are left aside, whatever their names. An empty table gives an empty table.
    """
    plain = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    model = fit(plain.filter(~_held(F.col("id")) & F.col("lang").isNotNull()), max_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most dims times languages
    kind = plain.schema["id"].dataType

    def run(batches):
        model = sent.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for i, j, data, offsets in textcore.chunks(batch.column(2)):
                best, score = model.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names[best].tolist(), pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "held_out", "lang_pred", "score"])

    out = plain.select("id", _held(F.col("id")).alias("held_out"), "text")
    return out.mapInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, lang_pred string, score double")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out; edge rows as languages says."""
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
