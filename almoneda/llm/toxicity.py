"""Toxicity by gradient-boosted trees over a few dense features, calibrated by isotonic regression.

Fitting works on a bounded sample of labelled rows (max_rows, those with the least hash of their id) and yields a small
model: a lexicon of terms with weights, trees, and the calibration steps. Scoring covers every row.

Lexicon: for each word its stems of 3 to 7 letters and the word itself are terms; terms found much more often in toxic
than in other documents of the sample enter with the log of that ratio as weight. It starts from a list of plain
insults. Words are also looked up after undoing obfuscation (digits and symbols for letters, dots between letters).

Terms are counted on one half of the sample and trees fitted on the other, so a term's weight never saw the rows whose
features it shapes; trees are calibrated on out-of-fold scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almoneda.llm.shared import free_name, map_rows, materialize

#: Plain insults in four languages, to start from. Fixed values.
INSULTS = (
    "idiot", "moron", "clown", "loser", "scum", "pathetic", "disgusting", "trash", "worthless", "stupid", "imbecile", "pig", "jerk", "creep", "liar",
    "idiota", "imbécil", "estúpido", "basura", "asqueroso", "inútil", "payaso", "escoria", "patético", "idiote", "imbécile", "stupide", "ordure",
    "dégoûtant", "minable", "nul", "crétin", "dumm", "dummkopf", "trottel", "abschaum", "ekelhaft", "wertlos", "müll", "erbärmlich", "versager",
)
#: Second person, in the same languages. Fixed values.
SECOND = frozenset(("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"))
#: What stands for letters in obfuscated words. Fixed values.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SHOUTED, _OTHER, _RUN = re.compile(r"\b[A-Z]{3,}\b"), re.compile(r"[^\w\s!?]"), re.compile(r"(\S)\1{3,}")
FEATURES = (
    "sum_per_word", "strong_per_word", "max_weight", "n_strong", "seed_per_word", "near_second", "second_per_word", "capitals", "shouted",
    "exclamations", "questions", "other_punctuation", "obfuscated", "obfuscated_hits", "mean_top3", "log_words", "long_runs", "distinct_strong",
)
STRONG = 1.5


def _stems(word: str) -> set[str]:
    return {word[:n] for n in range(3, 8) if n < len(word)} | {word} if len(word) >= 3 else {word}


def _tokens(text: str) -> tuple[list[str], list[str]]:
    """Lowered letter runs of the text, and words that obfuscation may hide."""
    words, hidden = [], []
    for token in _TOKEN.findall(text):
        low = token.lower()
        if low.isalpha():
            words.append(low)
            continue
        parts = _LETTERS.findall(low)
        words += parts
        core = low.strip(".,;:!?\"'()[]<>|#%&")
        if core and not core.isalpha() and (len(parts) > 1 or any(c in "0134577@$!" for c in core)):
            plain = core.translate(LEET)
            if plain.isalpha() and len(plain) >= 4:
                hidden.append(plain)
    return words, hidden


class Tokens:
    """Features of texts by a lexicon. What a token adds is worked out once and kept, for up to `most` tokens.

    Tokens are what stands between ASCII white space. A token's weight is that of its heaviest word; it is strong from
    STRONG on, and near the second person within 5 tokens of such a word.
    """

    #: What is summed over tokens.
    COLUMNS = ("weight", "strong", "seeds", "second", "capitals", "shouted", "exclamations", "questions", "other", "hidden", "hits", "runs")

    def __init__(self, lexicon: dict[str, float], most: int = 500_000):
        self.lexicon, self.most = lexicon, most
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.rows: dict[tuple, int] = {(0.0,) * (len(self.COLUMNS) + 1): 0}  # most tokens add nothing
        self.table = np.zeros((1, len(self.COLUMNS)))

    def _weight(self, word: str) -> float:
        """The heaviest term of a word: itself, or one of its stems of 3 to 7 letters."""
        get = self.lexicon.get
        best = get(word, 0.0)
        for n in range(3, min(8, len(word))):
            v = get(word[:n])
            if v is not None and v > best:
                best = v
        return best

    def _row(self, text: str) -> tuple:
        """What a token adds: COLUMNS, and for a strong token a number of its own."""
        word = text if text.isalpha() else text.rstrip(".,;:!?")
        if word.isalpha():
            low = word.lower()
            weight, marks = self._weight(low), len(text) - len(word)
            loud, asks = (text.count("!"), text.count("?")) if marks else (0, 0)
            upper = 0 if low == word else sum(map(str.isupper, word))
            shouted = int(upper > 2 and upper == len(word) and word.isascii())
            runs = len(_RUN.findall(text)) if len(text) > 3 else 0
            own = len(self.ids) if weight >= STRONG else 0.0
            return (weight, float(weight >= STRONG), float(low in _SEEDS), float(low in SECOND), upper, shouted, loud, asks, marks - loud - asks, 0.0, 0.0, runs, own)
        words, hidden = _tokens(text)
        weight = max(map(self._weight, words), default=0.0)
        return (
            weight, float(weight >= STRONG), sum(w in _SEEDS for w in words), float(any(w in SECOND for w in words)), sum(map(str.isupper, text)), len(_SHOUTED.findall(text)), text.count("!"), text.count("?"), len(_OTHER.findall(text)),
            len(hidden), sum(self._weight(h) >= STRONG for h in hidden), len(_RUN.findall(text)), len(self.ids) if weight >= STRONG else 0.0,
        )

    def _add(self, token: bytes) -> int:
        row = self._row(token.decode())
        i = self.ids[token] = self.rows.setdefault(row, len(self.rows))
        return i

    def features(self, text: str) -> list[float]:
        """The dense features of one whole text, in the order of FEATURES; an empty text has zeros."""
        tokens = text.encode("utf-8", "replace").split()
        if not tokens:
            return [0.0] * len(FEATURES)
        if len(self.ids) > self.most:
            self._clear()
        get, add = self.ids.get, self._add
        ids = np.array([add(t) if (i := get(t)) is None else i for t in tokens])
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array([r[:-1] for r in list(self.rows)[len(self.table) :]], float)])
        rows, n, size = self.table[ids], len(ids), len(text)
        s = dict(zip(self.COLUMNS, rows.sum(0).tolist()))
        strong, second, near = np.flatnonzero(rows[:, 1]), np.flatnonzero(rows[:, 3]), 0
        if len(strong) and len(second):
            at = np.searchsorted(second, strong)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - strong), np.abs(second[np.maximum(at - 1, 0)] - strong))
            near = int((gap <= 5).sum())
        top = np.partition(rows[:, 0], n - 3)[-3:] if n > 3 else rows[:, 0]
        return [
            s["weight"] / n, s["strong"] / n, float(top.max()), math.log1p(s["strong"]), s["seeds"] / n, near / n, s["second"] / n, s["capitals"] / size, s["shouted"] / n, s["exclamations"] / n, s["questions"] / n,
            s["other"] / size, s["hidden"] / n, s["hits"], float(top.mean()), math.log1p(n), s["runs"] / n, float(len(np.unique(ids[strong]))),
        ]


_SEEDS = frozenset(INSULTS)


@dataclass
class Trees:
    """Boosted regression trees on binned features, fitted to the logistic loss with a histogram per node."""

    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = None  # per tree: feature, threshold bin, value; nodes as a heap

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1).astype(np.int16)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: int = 10, ridge: float = 1.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 48))) for f in range(x.shape[1])]
        binned, n_bins = cls.bins(x, edges), 50
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        model = cls(edges, float(np.log(p / (1 - p))), [])
        score = np.full(len(y), model.base)
        flat = binned + np.arange(x.shape[1], dtype=np.int32) * n_bins
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            feature, cut, value = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, int), np.zeros(2 ** (depth + 1) - 1)
            at = np.zeros(len(y), int)
            for node in range(2**depth - 1):
                rows = np.flatnonzero(at == node)
                if len(rows):
                    value[node] = rate * g[rows].sum() / (h[rows].sum() + ridge)
                if len(rows) < 2 * least:
                    continue
                size = x.shape[1] * n_bins
                idx = flat[rows].ravel()
                total = lambda w: np.bincount(idx, np.repeat(w, x.shape[1]), size).reshape(x.shape[1], n_bins).cumsum(1)  # noqa: B023, E731
                gl, hl, nl = total(g[rows]), total(h[rows]), total(np.ones(len(rows)))
                gt, ht = g[rows].sum(), h[rows].sum()
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-6:
                    continue
                feature[node], cut[node] = divmod(best, n_bins)
                right = binned[rows, feature[node]] > cut[node]
                at[rows] = 2 * node + 1 + right
            for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
                rows = at == node
                if rows.any():
                    value[node] = rate * g[rows].sum() / (h[rows].sum() + ridge)
            model.trees.append((feature, cut, value))
            score += value[at]
        return model

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out, rows = self.bins(x, self.edges), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = at < len(feature)
                inner[inner] = feature[at[inner]] >= 0
                if not inner.any():
                    break
                r = rows[inner]
                at[r] = 2 * at[r] + 1 + (binned[r, feature[at[r]]] > cut[at[r]])
            out += value[at]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the least-squares rising fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, first score, last score
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == s:  # ties are one point
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ps = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return xs, ps


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, from 0 to 1. The raw score breaks ties between calibrated steps in the last thousandth."""
        raw = self.trees.raw(x)
        steps = np.interp(raw, *self.knots)
        return np.clip(0.999 * steps + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def plain_model() -> Model:
    """Without labels to learn from: any plain insult is toxic."""
    edges = [np.zeros(1)] * len(FEATURES)
    at = FEATURES.index("max_weight")
    edges[at] = np.array([STRONG])
    stump = (np.array([at]), np.array([0]), np.array([0.0, -2.0, 2.0]))
    return Model({w: 3.0 for w in INSULTS}, Trees(edges, 0.0, [stump]), (np.array([-1.0, 1.0]), np.array([0.1, 0.9])))


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, plain): documents of the sample (text, toxic) with the term, counted once a document."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                counts: dict[str, list[int]] = {}
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for term in {s for w in set(_tokens(text or "")[0]) for s in _stems(w)}:
                        counts.setdefault(term, [0, 0])[0 if toxic else 1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "toxic", "plain"])

    pairs = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, plain long")
    return pairs.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def fit(labelled: DataFrame, max_rows: int = 20_000, least_docs: int = 4) -> Model:
    """A model from (id, text, toxic), fitted on at most max_rows ids: those with the least hash.

    Of rows that repeat an id the one with the least hash of its text counts. Rows with a null label are ignored. The
    lexicon holds every term that tells enough, so it is bounded by the sample's words. Without labels of both kinds the
    model knows the plain insults only.
    """
    usable = labelled.filter("toxic IS NOT NULL").withColumn("h", F.xxhash64(F.lit(5), F.col("id")))
    keys = usable.groupBy("id", "h").agg(F.max("toxic").alias("toxic")).orderBy("h", "id").limit(max_rows).toPandas()  # bounded by max_rows
    if keys["toxic"].nunique() < 2:
        return plain_model()
    last = int(keys["h"].iloc[-1])
    one = F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")
    rows = materialize(usable.filter(F.col("h") <= last).groupBy("id", "h").agg(one, F.max("toxic").alias("toxic")), "labelled")
    for_terms = F.pmod(F.col("h"), F.lit(2)) == 0
    n_toxic, n_plain = (int((keys["toxic"][keys["h"] % 2 == 0] == k).sum()) for k in (1, 0))
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("plain") + 0.5) / (n_plain + 1.0))
    found = term_counts(rows.filter(for_terms)).filter(F.col("toxic") >= least_docs).withColumn("weight", ratio).filter("weight >= 1.0")
    top = found.select("term", "weight").toPandas()  # bounded by the sample's words
    lexicon = {w: 2.0 for w in INSULTS} | dict(zip(top["term"], top["weight"].astype(float)))
    data = with_features(rows.filter(~for_terms).select("id", "text", "toxic"), lexicon).toPandas()  # bounded by max_rows
    data = data.sort_values("id", kind="stable")
    x, y = np.array(data["x"].tolist(), float).reshape(len(data), -1), data["toxic"].to_numpy(float)
    fold = (np.arange(len(y)) * 7919) % 5
    if len(y) < 20 or len(set(y)) < 2:
        return plain_model()
    out_of_fold = np.zeros(len(y))
    for k in range(5):
        out_of_fold[fold == k] = Trees.fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, Trees.fit(x, y), isotonic(out_of_fold, y))


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(id, toxic, x) with the features of (id, text, toxic)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(lexicon)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                p = batch.slice(i, 500)
                x = [tokens.features(t or "") for t in p.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "toxic", "x"])

    return rows.select("id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "id long, toxic int, x array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; other columns are left aside.

    labels: (doc_id, toxic). A document whose crc32(doc_id as text) mod 3 is 1 is held out of fitting. The score sees
    the text alone.

    - Null texts are empty; empty texts get the score of their (zero) features. Long texts are read whole.
    - A null id counts as the empty text for the remainder and is never labelled. Rows that repeat an id are each scored;
      an id labelled twice takes the greater label.
    - Without usable labels the plain insults decide. An empty table gives an empty table.
    """
    docs = docs.select(F.col(doc_id), F.col(text))
    model = learned_model(docs, labels, max_rows, doc_id, text)
    scored = score_rows(docs, model, text)
    held = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    score = F.col(scored.columns[-1])
    return scored.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def score_rows(docs: DataFrame, model: Model, text: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the model's score as last column, underscores appended to its name if docs has it."""
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs.columns, score_col), T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches):
        tokens = Tokens(model.lexicon)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                p = batch.slice(i, 500)
                x = np.array([tokens.features(t.as_py() or "") for t in p.column(at)])
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(model.score(x))], schema.names)

    return map_rows(docs, run, schema)


def learned_model(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model of the labelled documents that aren't held out."""
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    held = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    return fit(plain.filter(~held).join(marks, F.col("id") == F.col("label_id")).select("id", "text", "toxic"), max_rows)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of the labelled ones that aren't held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels)
