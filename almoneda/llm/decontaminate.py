"""Benchmark decontamination: test items found in documents up to an edit budget.

An item of m characters may differ by k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece must occur
unchanged (pigeonhole), so an Aho-Corasick automaton over all pieces finds every place worth a look in one pass over the
text. The pieces are the leaves of a tree of halvings: a node of budget b has two halves of budgets that sum to b - 1,
and if the node occurs within b edits, one of its halves occurs within its own budget. A hit is therefore followed
upwards: its parent is verified around it with Myers' bit-parallel distance, then that one's parent, up to the item.
Chance hits end at the first step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almoneda.llm.shared import free_name, map_rows, materialize


def normalize(text: str | None) -> str:
    """Lowered, each run of white space one space, none at the ends."""
    return " ".join((text or "").lower().split())


def normalize_with_map(text: str) -> tuple[str, list[int]]:
    """normalize(text) and, for each of its characters, the index in text it comes from."""
    out, at, space = [], [], False
    for i, c in enumerate(text):
        for low in c.lower():
            if low.isspace():
                space = bool(out)
            else:
                if space:
                    out.append(" ")
                    at.append(i)
                    space = False
                out.append(low)
                at.append(i)
    return "".join(out), at


def myers(pattern: str, text: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of pattern in text within `most` edits, the first end of the best; or None.

    Bit-parallel over Python integers, so a pattern of any length is one word.
    """
    m = len(pattern)
    if masks is None:
        masks = pattern_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


@dataclass
class Node:
    """A part of an item: its place in the item, its budget, and the part it is half of."""

    item: int
    start: int
    text: str
    budget: int
    parent: Node | None
    #: Of a leaf: parts of the other half of its parent and their places from the leaf's start. The parent's budget e is
    #: one less than their number, so one of them occurs unchanged within e of its place (pigeonhole once more).
    signs: tuple[tuple[str, int], ...] = ()

    def __post_init__(self):
        if self.budget <= 0 and self.parent is not None:
            rest, whole = self.start - self.parent.start, self.parent.text
            low, high = (0, rest) if rest else (len(self.text), len(whole))
            n = self.parent.budget + 1
            cuts = [low + (high - low) * i // n for i in range(n + 1)]
            self.signs = tuple((whole[a:b], a - rest) for a, b in zip(cuts, cuts[1:]))


def piece_tree(item: int, text: str, budget: int, start: int = 0, parent: Node | None = None) -> list[Node]:
    """The leaves (budget 0) of the tree of halvings of an item."""
    node = Node(item, start, text, budget, parent)
    if budget <= 0:
        return [node]
    left = (budget - 1) // 2  # pieces are shared out as evenly as budgets: budget + 1 leaves in all
    cut = len(text) * (left + 1) // (budget + 1)
    return piece_tree(item, text[:cut], left, start, node) + piece_tree(item, text[cut:], budget - 1 - left, start + cut, node)


#: Blocks of scripts that are written without spaces. Fixed values.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x1B000, 0x1B16F), (0x20000, 0x323AF))


def _runs_on(text: str, at: int) -> bool:
    """Whether a word goes on across a place in a text."""
    pair = text[at - 1 : at + 1] if at else ""
    return len(pair) == 2 and pair.isalnum() and not any(a <= ord(c) <= b for c in pair for a, b in UNSPACED)


class Matcher:
    """Finds items (id, text) in texts, each with its share `rate` of edits whatever its length. Where an item below least_chars
    normalized characters begins and ends, so must a word: it would be met within others by chance. Scripts without spaces
    have no such ends."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, text in items:
            text = normalize(text)
            if text:
                for leaf in piece_tree(len(self.items), text, int(rate * len(text))):
                    pieces.setdefault(leaf.text, []).append(leaf)
                self.items.append((item_id, text))
        self.least_chars = least_chars
        self.masks: dict[str, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for text, leaves in pieces.items():
            self.automaton.add_word(text, leaves)
        if pieces:
            self.automaton.make_automaton()

    def _climb(self, leaf: Node, at: int, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item around a leaf that occurs at `at`, if every part on the way is near."""
        node = leaf
        if node.parent is None:
            return 0, at, at + len(node.text)
        origin = at - leaf.start
        while node.parent is not None:
            node = node.parent
            low = max(0, origin + node.start - node.budget)
            window = text[low : origin + node.start + len(node.text) + node.budget]
            if node.text not in self.masks:
                self.masks[node.text] = pattern_masks(node.text)
            found = myers(node.text, window, node.budget, self.masks[node.text])
            if found is None:
                return None
        end = low + found[1]
        back = myers(node.text[::-1], window[: found[1]][::-1], found[0])  # where the best one begins
        return found[0], end - back[1] if back else low, end

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item in a whole text; offsets in the text."""
        if not self.items or not text:
            return []
        plain = normalize(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried = set()
        for end, leaves in self.automaton.iter(plain):
            for leaf in leaves:
                if best.get(leaf.item, (1,))[0] == 0:
                    continue
                at = end + 1 - len(leaf.text)
                if leaf.parent:
                    e = leaf.parent.budget
                    for part, place in leaf.signs:
                        if plain.find(part, max(0, at + place - e), max(0, at + place + len(part) + e)) >= 0:
                            break
                    else:
                        continue
                key = (id(leaf.parent) if leaf.parent else id(leaf), at - leaf.start)
                if key in tried:  # both halves of a part hit on one diagonal
                    continue
                tried.add(key)
                found = self._climb(leaf, at, plain)
                if found and len(self.items[leaf.item][1]) < self.least_chars and (_runs_on(plain, found[1]) or _runs_on(plain, found[2])):
                    continue  # a short item within a longer word
                if found and (leaf.item not in best or found < best[leaf.item]):
                    best[leaf.item] = found
        if not best:
            return []
        same, index = normalize_with_map(text)
        assert len(same) == len(plain)
        return sorted((self.items[i][0], d, index[s] if s < len(index) else len(text), index[e - 1] + 1) for i, (d, s, e) in best.items())


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least_chars: int = 25, block_bytes: int = 4_000_000, text: str = "text", hits_col: str = "hits") -> DataFrame:
    """docs with `hits`: an array of (item_id, distance, start, end), one entry for each item that occurs in the text.

    benchmark: (item_id, text). Texts are compared lowered and with runs of white space as one space; distance counts
    edits of such characters, start and end are code points of the text as it is. For each item the best occurrence is
    given, the first of equals as the search meets them.

    The items are sent to the executors in blocks of at most block_bytes of text, of which the driver holds one at a time.
    A benchmark of one block takes one pass and no shuffle. For a larger one the rows are numbered and written, each block
    is a pass over them that writes the rows with hits, and these are joined back.

    - Null and empty texts have no hits; so have null and blank items. Items below least_chars characters begin and end where
      words do, in scripts that have spaces. Items with equal text are each reported; repeated rows of an item count once.
    - Long texts are searched whole. An empty table on either side gives rows without hits.
    - `hits` gets underscores appended if docs has that column.
    """
    hits_col = free_name(docs.columns, hits_col)
    items = benchmark.select("item_id", F.col("text").alias("t")).filter("t IS NOT NULL AND item_id IS NOT NULL").distinct()
    if items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] <= block_bytes:
        return _search(docs, [(r["item_id"], r["t"]) for r in items.orderBy("item_id", "t").collect()], rate, least_chars, text, hits_col)
    row = free_name([*docs.columns, hits_col], "__row")
    whole = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # ids hold from here on
    found = None
    for block in _blocks(items, block_bytes):
        hits = _search(whole.select(row, text), block, rate, least_chars, text, hits_col).filter(F.size(hits_col) > 0).select(row, hits_col)
        hits = materialize(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(hits_col))).alias(hits_col))  # one entry an item
    out = whole.join(merged, row, "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(hits_col, F.array().cast(HITS)).alias(hits_col))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items (item_id, t) in blocks of at most block_bytes of text, or of one longer item."""
    block, size = [], 0
    for r in items.orderBy("item_id", "t").toLocalIterator():
        if block and size + len(r["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def _search(docs: DataFrame, items: list[tuple[int, str]], rate: float, least_chars: int, text: str, hits_col: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(hits_col, HITS)])
    at = docs.columns.index(text)
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(items, rate, least_chars)
            for i in range(0, batch.num_rows, 500):
                p = batch.slice(i, 500)
                found = [[dict(zip(("item_id", "distance", "start", "end"), h)) for h in matcher.find(t.as_py())] for t in p.column(at)]
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(found, arrow)], schema.names)

    return map_rows(docs, run, schema)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: a document with any item in it is not kept."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = F.col("hits")
    return find_leaks(docs.select("doc_id", "text"), items).select(
        "doc_id", F.size(hits).cast("long").alias("n_items"), F.transform(hits, lambda h: h["item_id"]).alias("item_ids"),
        F.array_min(F.transform(hits, lambda h: h["distance"])).alias("least_distance"), (F.size(hits) == 0).alias("kept"),
    )
