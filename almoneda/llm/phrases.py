"""Phrase collocations by contiguous pattern growth.

A first reading counts words. A second one finds which pairs can't be frequent, by counts of hashed pairs of frequent words,
which may be too high but never too low. A third one projects every occurrence of a word that may begin a frequent pair: a
pointer with the words to its right, up to the length of a phrase, cut where the next pair can't be frequent. All pointers of
a prefix meet in one task, which grows the prefix to the right, depth first, as long as what follows is frequent. Prefixes with
more pointers than a task should hold are spread by what follows them, and counted by whole phrase instead.

Words travel as 64-bit names; the first reading finds names that a frequent word shares with another, and then starts again
with other names, so counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almoneda.llm import spans, textcore
from almoneda.llm.shared import discard, materialize
from almoneda.llm.textcore import U, mix64

#: Bytes that end a piece, and those that only end a word. Fixed values.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_STOP, _WORD = np.zeros(256, bool), np.ones(256, bool)
_STOP[list(STOPS)] = True
_WORD[list(STOPS + BLANKS)] = False
#: Bits of the filters for frequent words and pairs; a fixed size, so that they may be sent to every task.
FILTER_BITS = 1 << 25
#: Pointers that a task is dealt on average, at most; a prefix of more than a quarter of that is spread.
TASK_POINTERS = 2_000_000
LONGEST = 4
_ZSTD = pa.Codec("zstd", compression_level=1)
_KEYS = [f"h{i}" for i in range(1, LONGEST + 1)]


def _named(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seed: int):
    """(starts, ends, texts' numbers, names) of a chunk's words; the name depends on the language too."""
    starts, ends, firsts = spans.runs(data, offsets, _WORD)
    doc = spans.owners(firsts)
    return starts, ends, doc, np.maximum(mix64(spans.hashes(data, starts, ends, seed) + langs[doc]), U(1))


def _lang_keys(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in set(langs)}
    return np.array([known[x] for x in langs], U)


class _Counts:
    """Counts of names, with each name's word and language as first seen."""

    def __init__(self):
        self.names, self.counts, self.fresh, self.words, self.langs, self.totals = np.zeros(0, U), np.zeros(0, np.int64), [], [], [], {}

    def add(self, data, starts, ends, doc, names, langs: list[str]) -> None:
        for lang, n in zip(langs, np.bincount(doc, minlength=len(langs)).tolist()):
            self.totals[lang] = self.totals.get(lang, 0) + n
        got, first, n = np.unique(names, return_index=True, return_counts=True)
        at = np.searchsorted(self.names, got)
        old = np.zeros(len(got), bool)
        if len(self.names):
            old = self.names[np.minimum(at, len(self.names) - 1)] == got
        self.counts[at[old]] += n[old]
        new, first = got[~old], first[~old]
        self.names, self.counts = np.insert(self.names, at[~old], new), np.insert(self.counts, at[~old], n[~old])
        self.fresh.append(new)
        self.words.append(spans.texts_of(data, starts[first], ends[first]))
        self.langs.append(pa.array(langs, pa.string()).take(pa.array(doc[first])))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for names, words, langs in zip(self.fresh, self.words, self.langs):
            n = self.counts[np.searchsorted(self.names, names)]
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), langs, words, pa.array(n)], ["h", "lang", "word", "c"])
        k = list(self.totals)
        yield pa.RecordBatch.from_arrays([pa.array(_lang_keys(k).view(np.int64)), pa.array(k, pa.string()), pa.nulls(len(k), pa.string()), pa.array([self.totals[x] for x in k], pa.int64())], ["h", "lang", "word", "c"])


def word_counts(docs: DataFrame, least: int, seed: int = 0) -> DataFrame:
    """(h, lang, word, f, words) of names with f >= least, and for each language a row with a null word, where f counts all
    its words. words: how many words share the name. docs: (lang, text), without null languages."""

    def run(batches):
        found = _Counts()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, data, offsets in textcore.chunks(batch.column(1)):
                found.add(data, *_named(data, offsets, _lang_keys(langs[i:j]), seed), langs[i:j])
                if len(found.names) > 1_000_000:
                    yield from found.batches()
                    found = _Counts()
        yield from found.batches()

    return _by_name(docs.select("lang", "text").mapInArrow(run, "h long, lang string, word string, c long"), least)


def _by_name(partial: DataFrame, least: int) -> DataFrame:
    """word_counts of what the tasks counted: (h, lang, word, c)."""
    exact = partial.repartition("h").groupBy("h", "lang", "word").agg(F.sum("c").alias("c"))
    named = exact.groupBy("h", F.isnull("word").alias("whole")).agg(F.sum("c").alias("f"), F.count("*").alias("words"), F.first("lang").alias("lang"), F.first("word").alias("word"))
    return named.filter(F.col("whole") | (F.col("f") >= least)).select("h", "lang", "word", "f", "words")


def _filter(df: DataFrame, name: str) -> np.ndarray:
    """FILTER_BITS bits, packed, with the bit of each value of a column set: what has no bit isn't in the column."""
    bit = F.col(name).bitwiseAND(FILTER_BITS - 1) + 1  # Spark's bitmaps count from 1
    parts = df.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("b")).collect()
    # one row for each 32,768 bits, whatever the number of values
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        block = np.frombuffer(bytes(r.b), np.uint8)
        at = (r.k - 1) * 4096
        out[at : at + len(block)] = block
    return out


def _set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values & U(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _width(total: int) -> int:
    """Bits of a pair's key in a corpus of `total` words."""
    return min(max(total.bit_length() + 5, 32), 56)


def _pairs(names: np.ndarray) -> np.ndarray:
    """64 bits for each word and its successor."""
    return mix64(names[:-1] * U(0xC6A4A7935BD1E995) + names[1:])


class _Chunks:
    """Words of a task's texts, chunk by chunk: (names, joined), where joined[i] says that words i and i + 1 are in one
    piece and both may be frequent."""

    def __init__(self, batches, bits: np.ndarray, seed: int):
        self.batches, self.bits, self.seed = batches, bits, seed

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in self.batches:
            langs = batch.column(0).to_pylist()
            for i, j, data, offsets in textcore.chunks(batch.column(1)):
                starts, ends, doc, names = _named(data, offsets, _lang_keys(langs[i:j]), self.seed)
                if len(names) < 2:
                    continue
                stops = np.concatenate([[0], np.cumsum(_STOP[data])])
                often = _set(self.bits, names)
                yield names, often[:-1] & often[1:] & (doc[1:] == doc[:-1]) & (stops[starts[1:]] == stops[ends[:-1]])


def pair_filter(docs: DataFrame, often: np.ndarray, total: int, least: int, seed: int, tasks: int) -> np.ndarray:
    """The bits of all pairs that occur at least `least` times, and few others.

    Pairs are counted by the leading bits of their hash, five more than number the corpus' words: pairs that share these are
    counted as one, which can only be too many. So sorted, a pair is a difference of two bytes or so.
    """
    spark = docs.sparkSession
    width = _width(total)
    sent = spark.sparkContext.broadcast(often)

    def count(batches):
        held, n = [], 0

        def done():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = (keys >> U(width - 31)).astype(np.int64) * tasks >> 31  # ranges of keys
            cuts = np.searchsorted(bucket, np.arange(tasks + 1))
            full = [k for k in range(tasks) if cuts[k] < cuts[k + 1]]
            rows = [_planes(keys[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]) for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "rows"])

        for names, joined in _Chunks(batches, sent.value, seed):
            held.append(_pairs(names)[joined] >> U(64 - width))
            n += len(held[-1])
            if n >= 2_000_000:
                yield done()
                held, n = [], 0
        if n:
            yield done()

    def sum_up(batches):
        at, parts = None, []

        def done():
            keys, counts = (np.concatenate(x) for x in zip(*map(_of_planes, parts)))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            often = np.add.reduceat(counts[order], cuts) >= least
            return pa.RecordBatch.from_arrays([pa.array(keys[cuts][often].view(np.int64))], ["pair"])

        for batch in batches:
            for bucket, rows in zip(*[c.to_pylist() for c in batch.columns]):
                if at is not None and bucket != at:
                    yield done()
                    parts = []
                at = bucket
                parts.append(rows)
        if at is not None:
            yield done()

    counted = docs.select("lang", "text").mapInArrow(count, "bucket int, rows binary")
    dealt = counted.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    # by their leading bits: the filter takes the low ones of a key
    return _filter(dealt.mapInArrow(sum_up, "pair long"), "pair")


def _planes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte plane by byte plane, compressed."""
    steps = np.diff(keys, prepend=U(0))
    body = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(keys).to_bytes(8, "big") + _ZSTD.compress(body, asbytes=True)


def _of_planes(rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(rows[:8], "big")
    body = np.frombuffer(_ZSTD.decompress(rows[8:], 12 * n, asbytes=True), np.uint8)
    steps = np.ascontiguousarray(body[: 8 * n].reshape(8, n).T).view(U).ravel()
    return np.cumsum(steps, dtype=U), np.ascontiguousarray(body[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def _windows(names: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The projected pointers: rows of LONGEST names, 0 where the context ends. joined[i]: words i and i + 1 may be a
    frequent pair."""
    at = np.flatnonzero(joined)
    out = np.zeros((LONGEST, len(at)), U)
    out[0], on = names[at], np.ones(len(at), bool)
    for k in range(1, LONGEST):
        on = on & joined[np.minimum(at + k - 1, len(joined) - 1)] & (at + k - 1 < len(joined))
        out[k, on] = names[at[on] + k]
    return out


def _pack(windows: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """(bucket, whole, rows) of windows: those of hot prefixes as counts of whole phrases, dealt by phrase, the others as
    pointers, dealt by prefix. Equal ones are joined; order and names make no difference to what is counted."""
    spread = np.isin(windows[0], hot) if len(hot) else np.zeros(windows.shape[1], bool)
    yield from _dealt(windows[:, ~spread], False, buckets)
    for k in range(2, LONGEST + 1):
        x = windows[:, spread & (windows[k - 1] != 0)]
        x[k:] = 0
        yield from _dealt(x, True, buckets)


def _dealt(x: np.ndarray, whole: bool, buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    q = x[0].copy()
    for k in range(1, LONGEST):
        q = mix64(q * U(0xC6A4A7935BD1E995) + x[k])
    bucket = ((mix64(q if whole else x[0]) >> U(20)) % U(buckets)).astype(np.int32)
    order = np.lexsort((q, bucket)) if whole else np.lexsort((q, x[0], bucket))
    x, bucket = x[:, order], bucket[order]
    at = np.flatnonzero(np.append(x.shape[1] > 0, (x[:, 1:] != x[:, :-1]).any(axis=0)))
    n = np.diff(np.append(at, len(bucket))).astype(np.uint32)
    x, bucket = x[:, at], bucket[at]
    cuts = np.flatnonzero(np.append(len(bucket) > 0, bucket[1:] != bucket[:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), whole, _coded(x[:, a:b], n[a:b])


def _coded(x: np.ndarray, n: np.ndarray) -> bytes:
    """Rows of names with their counts: the names once, then for each row their places among them, compressed."""
    names, place = np.unique(x, return_inverse=True)
    small = len(names) <= 1 << 16
    body = np.array([len(n), len(names)], np.int64).tobytes() + names.tobytes() + place.astype(np.uint16 if small else np.uint32).tobytes() + n.tobytes()
    return len(body).to_bytes(8, "big") + _ZSTD.compress(body, asbytes=True)


def _decoded(rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = _ZSTD.decompress(rows[8:], int.from_bytes(rows[:8], "big"), asbytes=True)
    n, k = np.frombuffer(body, np.int64, 2).tolist()
    names = np.frombuffer(body, U, k, 16)
    kind = np.dtype(np.uint16 if k <= 1 << 16 else np.uint32)
    place = np.frombuffer(body, kind, n * LONGEST, 16 + 8 * k)
    return names[place].reshape(LONGEST, n), np.frombuffer(body, np.uint32, n, 16 + 8 * k + kind.itemsize * n * LONGEST)


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = [_decoded(p) for p in parts]
    return np.concatenate([x for x, _ in rows], axis=1), np.concatenate([n for _, n in rows]).astype(np.int64)


def grow(prefix: tuple[int, ...], pointers: np.ndarray, context: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(phrase, count) of each frequent phrase that begins with prefix and is longer, depth first: the pointers are
    divided by the word that follows, and each frequent one is grown in turn."""
    depth = len(prefix)
    follows = context[depth, pointers]
    on = follows != 0
    pointers, follows = pointers[on], follows[on]
    if not len(pointers):
        return
    order = np.argsort(follows, kind="stable")
    pointers, follows = pointers[order], follows[order]
    cuts = np.flatnonzero(np.append(True, follows[1:] != follows[:-1]))
    counts = np.add.reduceat(weights[pointers], cuts)
    ends = np.append(cuts[1:], len(follows))
    for i in np.flatnonzero(counts >= least).tolist():
        longer = (*prefix, int(follows[cuts[i]]))
        yield longer, int(counts[i])
        if len(longer) < LONGEST:
            yield from grow(longer, pointers[cuts[i] : ends[i]], context, weights, least)


def _bucket_phrases(pointers: list[bytes], wholes: list[bytes], least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    if pointers:
        context, weights = _unpack(pointers)
        order = np.argsort(context[0], kind="stable")
        prefix = context[0, order]
        cuts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        total = np.add.reduceat(weights[order], cuts)
        for a, b, n in zip(cuts.tolist(), [*cuts[1:].tolist(), len(prefix)], total.tolist()):
            if n >= least:
                yield from grow((int(prefix[a]),), order[a:b], context, weights, least)
    if wholes:
        x, n = _unpack(wholes)
        order = np.lexsort(x)
        x, n = x[:, order], n[order]
        cuts = np.flatnonzero(np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0)))
        total = np.add.reduceat(n, cuts)
        for i in np.flatnonzero(total >= least).tolist():
            yield tuple(v for v in x[:, cuts[i]].tolist() if v), int(total[i])


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int, seed: int = 0, task_pointers: int = TASK_POINTERS) -> DataFrame:
    """(h1, h2, h3, h4, f): the phrases of 2 to 4 names that occur at least `least` times; 0 follows a shorter phrase."""
    spark = docs.sparkSession
    total = int(words.filter("word IS NULL").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_pointers))
    hot = np.array([r.h for r in words.filter(F.col("word").isNotNull() & (F.col("f") * 4 * tasks > total)).select("h").collect()], np.int64).view(U)  # fewer than 4 a task
    often = _filter(words.filter("word IS NOT NULL"), "h")
    pairs = pair_filter(docs, often, total, least, seed, tasks)
    width = _width(total)
    sent = spark.sparkContext.broadcast((often, pairs, np.sort(hot)))
    buckets = 2 * tasks

    def project(batches):
        often, pairs, hot = sent.value
        held, n = [], 0
        for names, joined in _Chunks(batches, often, seed):
            joined[joined] = _set(pairs, _pairs(names)[joined] >> U(64 - width))
            held.append(_windows(names, joined))
            n += held[-1].shape[1]
            if n >= 1_000_000:
                yield from _rows(_pack(np.concatenate(held, axis=1), hot, buckets))
                held, n = [], 0
        if n:
            yield from _rows(_pack(np.concatenate(held, axis=1), hot, buckets))

    def mine(batches):
        at, pointers, wholes = None, [], []

        def done():
            found = list(_bucket_phrases(pointers, wholes, least))
            keys = np.zeros((len(found), LONGEST), U)
            for i, (phrase, _) in enumerate(found):
                keys[i, : len(phrase)] = phrase
            return pa.RecordBatch.from_arrays([*[pa.array(keys[:, k].view(np.int64)) for k in range(LONGEST)], pa.array([f for _, f in found], pa.int64())], [*_KEYS, "f"])

        for batch in batches:
            for bucket, whole, rows in zip(*[c.to_pylist() for c in batch.columns]):
                if at is not None and bucket != at:
                    yield done()
                    pointers, wholes = [], []
                at = bucket
                (wholes if whole else pointers).append(rows)
        if at is not None:
            yield done()

    projected = docs.select("lang", "text").mapInArrow(project, "bucket int, whole boolean, rows binary")
    dealt = projected.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(mine, ", ".join(f"{k} long" for k in [*_KEYS, "f"]))


def _rows(packed) -> Iterator[pa.RecordBatch]:
    got = list(packed)
    for i in range(0, len(got), 256):
        part = got[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part]), pa.array([p[2] for p in part], pa.binary())], ["bucket", "whole", "rows"])


def _part(a: int, b: int) -> list[Column]:
    """Words a to b - 1 of a phrase, as a key of its own."""
    return [F.col(_KEYS[a + i]) if a + i < b else F.lit(0).cast("long") for i in range(LONGEST)]


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(h1..h4, a, l, r, score) of the phrases that no longer one holds by 80 in 100, each with its worst cut."""
    ones = words.filter("word IS NOT NULL").select(F.col("h").alias("h1"), *[F.lit(0).cast("long").alias(k) for k in _KEYS[1:]], "f")
    counts = phrases.unionByName(ones)
    size = sum((F.col(k) != 0).cast("int") for k in _KEYS)
    sized = phrases.withColumn("size", size)
    asks = []  # (key asked for, phrase that asks, cut, side)
    for n in range(2, LONGEST + 1):
        for cut in range(1, n):
            for side, (a, b) in (("l", (0, cut)), ("r", (cut, n))):
                key = F.struct(*[c.alias(k) for c, k in zip(_part(a, b), _KEYS)])
                asks.append(F.when(F.col("size") == n, F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), key.alias("key"))))
    asked = sized.select(*[F.col(k).alias(f"o{k}") for k in _KEYS], F.col("f").alias("a"), F.explode(F.filter(F.array(*asks), lambda x: x.isNotNull())).alias("q"))
    asked = asked.select(*[f"o{k}" for k in _KEYS], "a", "q.cut", "q.side", *[F.col(f"q.key.{k}") for k in _KEYS])
    answered = asked.join(counts, _KEYS)
    null = F.lit(None).cast("long")
    sides = {f"{s}{c}": F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f")) for c in range(1, LONGEST) for s in "lr"}
    own = answered.select(*[F.col(f"o{k}").alias(k) for k in _KEYS], "a", *[v.alias(k) for k, v in sides.items()], null.alias("longer"))
    inner = []  # what a phrase of n words holds
    for n in range(3, LONGEST + 1):
        for m in range(2, n):
            for a in range(n - m + 1):
                inner.append(F.when(F.col("size") == n, F.struct(*[c.alias(k) for c, k in zip(_part(a, a + m), _KEYS)])))
    held = sized.select(F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("q"), "f").select("q.*", null.alias("a"), *[null.alias(k) for k in sides], F.col("f").alias("longer"))
    got = own.unionByName(held).groupBy(*_KEYS).agg(*[F.max(c).alias(c) for c in ["a", *sides, "longer"]])
    kept = got.filter(F.col("a").isNotNull() & ~F.coalesce(_wide(F.col("longer")) * 100 >= _wide(F.col("a")) * 80, F.lit(False)))
    cuts = F.array(*[
        F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(f"(CAST(a AS DECIMAL(19,0)) * 2000000BD) div (CAST(l{c} AS DECIMAL(19,0)) + r{c})").cast("long").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
        for c in range(1, LONGEST)
    ])
    worst = F.array_min(F.filter(cuts, lambda x: x.isNotNull()))
    return kept.select(*_KEYS, "a", worst.alias("w")).select(*_KEYS, "a", "w.l", "w.r", "w.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text: str = "text", lang: str = "lang", task_pointers: int = TASK_POINTERS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, count and text.

    Words are runs of anything but blanks and stops, A-Z lowered; phrases of 2 to 4 words lie within pieces between stops.
    a, l, r: how often the phrase and the two parts of its worst cut occur; n: all words of the language. A phrase needs
    `least` occurrences; it goes if a longer one that holds it occurs at least 0.8 times as often.

    - Null and empty texts have no words; long ones are read whole. A null language is `und`, together with rows that say so.
    - Repeated rows count each time. Equal scores and counts are ranked by phrase, so ranks are unique.
    - Other columns are left aside, whatever their names. An empty table gives an empty table.
    """
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    for seed in range(8):
        words = materialize(word_counts(plain, least, seed), "words")
        if words.filter(F.col("word").isNotNull() & (F.col("words") > 1)).isEmpty():
            break
        discard(words)
    else:
        raise ValueError("names collide under every seed")
    phrases = materialize(frequent_phrases(plain, words, least, seed, task_pointers), "phrases")
    name = words.filter("word IS NOT NULL").select("h", "word")
    first = words.filter("word IS NOT NULL").select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"))
    scored = _scored(phrases, words).join(first, "h1")
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64(*_KEYS), F.lit(64))).orderBy(F.desc("score"), F.desc("a"))
    # no phrase below these can be among the first; those that tie with the last stay
    near = scored.withColumn("near", F.rank().over(salted)).filter(F.col("near") <= top).drop("near")
    for k in range(2, LONGEST + 1):
        near = near.join(name.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), f"h{k}", "left")
    spelled = near.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(1, LONGEST + 1)]).alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = spelled.withColumn("near", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).filter(F.col("near") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    whole = words.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(whole, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over all documents; edge rows as collocations says."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w[i:i + k - 1] AS x FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, x, count(*) AS f FROM g GROUP BY lang, x HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, x, f AS a, unnest(range(1, len(x))) AS k FROM f WHERE len(x) >= 2),
s AS (SELECT c.lang, c.x, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.x = c.x[:c.k] JOIN f r ON r.lang = c.lang AND r.x = c.x[c.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
i AS (SELECT lang, x[j:j + m - 1] AS x, max(f) AS f FROM (SELECT lang, x, f, m, unnest(range(1, len(x) - m + 2)) AS j FROM (SELECT *, unnest(range(2, len(x))) AS m FROM f WHERE len(x) >= 3)) GROUP BY ALL),
o AS (SELECT b.*, array_to_string(b.x, ' ') AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.x = b.x WHERE i.f IS NULL OR NOT 100::HUGEINT * i.f >= 80::HUGEINT * b.a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000
"""
