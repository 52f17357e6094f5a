"""Fuzzy line dedup: MinHash of character shingles, bands, exact Jaccard similarity, union-find, one line a component.

Lines are named by 128 bits of their text; bands hold the first 64 of them, which can only add candidates. Texts of lines
are fetched for lines that share a band, and documents are rewritten where they lose a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoneda.llm import textcore
from almoneda.llm.components import components
from almoneda.llm.setsketch import band_keys
from almoneda.llm.shared import discard, free_name, materialize, spread_join
from almoneda.llm.simjoin import bucket_rows, in_blocks, local_leads, repeated, settle, verify
from almoneda.llm.textcore import U, mix64

#: Runs of 8 characters are rare enough that bands of 4 minima seldom meet by chance; 20 bands of 4 miss a pair at a
#: similarity of 0.8 three times in 100,000.
SHINGLE, BANDS, ROWS = 8, 20, 4
#: Sets with more empty bins take their minima over all members by one pass a bin.
DIRECT = 12
#: Blocks of lines and band rows are dealt to so many parts at least, which bounds what is sorted at once.
PARTS = 1024
#: Lines that a task meets so often at once send one row to the part of their name.
OFTEN = 8
_raw = mix64(np.arange(2 * BANDS * ROWS, dtype=U) + U(77))
_MUL, _ADD = (_raw[: BANDS * ROWS] >> U(32)).astype(np.uint32) | np.uint32(1), (_raw[BANDS * ROWS :] >> U(32)).astype(np.uint32)
_EMPTY = np.uint32(0xFFFFFFFF)
#: A line as it travels: 128 bits of name, document, line number. count: the lines it stands for, 0 if another row counts it.
LINE = np.dtype([("short", np.int64), ("low", np.int64), ("doc", np.int64), ("hash", np.int64), ("line", np.int32), ("count", np.int32), ("known", np.bool_)])
#: Kinds of blocks and rows: band rows or buckets, band rows with leads, lines that differ, lines that are repeated, names in buckets.
BUCKET, LED, NODE, AGAIN, NEEDED = range(5)


def _binned(runs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, BANDS * ROWS) minima of each set's members by bin: a member's upper bits choose its bin, its lower ones count."""
    m = BANDS * ROWS
    slot = runs >> U(48)
    slot *= U(m)
    slot >>= U(16)
    slot = slot.view(np.int64)
    slot += np.repeat(np.arange(0, len(n) * m, m), n)
    out = np.full(len(n) * m, _EMPTY, np.uint32)
    np.minimum.at(out, slot, runs.astype(np.uint32))
    return out.reshape(len(n), m)


def minima(runs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, BANDS * ROWS) MinHash values of sets of 64-bit hashes, n members each, none empty, one after the other.

    As in fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017), each member is first hashed to one bin, whose least
    member counts; then every member is hashed to every bin that is still empty. So a bin's first member in the union of
    two sets is drawn uniformly, and they agree in each bin as often as they are alike.
    """
    out = _binned(runs, n)
    row, column = np.nonzero(out == _EMPTY)
    if not len(row):
        return out
    h, firsts = (runs >> U(32)).astype(np.uint32), np.cumsum(n) - n
    few = np.bincount(row, minlength=len(n)) <= DIRECT
    some = few[row]
    r, c = row[some], column[some]
    if len(r):
        size = n[r]
        cuts = np.cumsum(size) - size
        hashed = h[np.repeat(firsts[r] - cuts, size) + np.arange(size.sum())]
        hashed *= np.repeat(_MUL[c], size)
        hashed += np.repeat(_ADD[c], size)
        out[r, c] = np.minimum.reduceat(hashed, cuts)
    if not few.all():
        h, size = h[np.repeat(~few, n)], n[~few]
        cuts = np.cumsum(size) - size
        least, hashed = np.empty((BANDS * ROWS, len(size)), np.uint32), np.empty_like(h)
        for m in range(BANDS * ROWS):
            np.multiply(h, _MUL[m], out=hashed)
            hashed += _ADD[m]
            np.minimum.reduceat(hashed, cuts, out=least[m])
        here = out[~few]
        out[~few] = np.where(here == _EMPTY, least.T, here)
    return out


def keys_of(members: np.ndarray) -> np.ndarray:
    """Band keys of a set of 64-bit shingle hashes."""
    return band_keys(minima(members, np.array([len(members)])), BANDS, ROWS)[0]


def _sets(data, offsets):
    return textcore.char_sets(data, offsets, SHINGLE)


class _Lines:
    """The lines of a chunk of texts that aren't blank: byte ranges, document, line number and name of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        newlines = np.flatnonzero(data == 10)
        ends = np.union1d(newlines, offsets[1:])  # an end at each text's end, whether or not a line ends there
        starts = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10) * (ends[:-1] < len(data))]) if len(ends) else ends
        keep = ends > starts
        for k in np.flatnonzero(keep & textcore._SPACE[data[np.minimum(starts, len(data) - 1)]] if len(data) else keep).tolist():  # a line that begins with a space
            keep[k] = not textcore._SPACE[data[starts[k] : ends[k]]].all()
        self.starts, self.ends = starts[keep], ends[keep]
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.number = np.searchsorted(newlines, self.starts) - np.searchsorted(newlines, offsets[np.minimum(self.doc, len(offsets) - 2)])
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
        self.names = [digest(view[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def _halves(names: list[bytes]) -> np.ndarray:
    """(n, 2) the upper and lower 64 bits of names."""
    return np.frombuffer(b"".join(names), np.dtype(">i8")).reshape(-1, 2).astype(np.int64)


def _names(lines: np.ndarray) -> pa.Array:
    """The 128-bit names of LINE rows."""
    data = np.stack([lines["short"], lines["low"]], axis=1).astype(">i8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(np.arange(0, 16 * len(lines) + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def _in_order(lines: np.ndarray) -> np.ndarray:
    """The order of LINE rows by name, and of a name by document (null first), text and line."""
    return np.lexsort((lines["line"], lines["hash"], lines["doc"], lines["known"], lines["low"], lines["short"]))


def _starts(lines: np.ndarray) -> np.ndarray:
    """Where names begin in LINE rows ordered by name."""
    short, low = lines["short"], lines["low"]
    return np.flatnonzero(np.concatenate([np.ones(min(len(lines), 1), bool), (short[1:] != short[:-1]) | (low[1:] != low[:-1])]))


def line_blocks(lines: np.ndarray, tasks: int) -> pa.RecordBatch:
    """(part, kind, rows): LINE rows that each count once, dealt to parts by name.

    Of a name with OFTEN rows or more the first row counts for all and goes by name; the others go to any part, by document.
    """
    part = lines["short"].astype(U) % U(tasks)
    some = np.flatnonzero(repeated(lines["short"]))
    if len(some):
        some = some[_in_order(lines[some])]
        starts = _starts(lines[some])
        size = np.diff(np.append(starts, len(some)))
        often = size >= OFTEN
        loose = np.repeat(often, size)
        loose[starts] = False
        lines["count"][some[starts[often]]] = size[often]
        lines["count"][some[loose]] = 0
        part[some[loose]] = mix64(lines["doc"][some[loose]].astype(U)) % U(tasks)
    order = np.argsort(part, kind="stable")
    part, lines = part[order].astype(np.int32), lines[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    blocks = [lines[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), NODE, np.int32)), pa.array(blocks, pa.binary())], ["part", "kind", "rows"])


def merged_lines(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line of each name, with the count of all; every line of names that have several) of the LINE rows of a part."""
    loose = lines["count"] == 0
    counted, loose = lines[~loose], lines[loose]
    many = repeated(counted["short"])
    some = counted[many]
    some = some[_in_order(some)]
    starts = _starts(some)
    first, size = some[starts], np.diff(np.append(starts, len(some)))
    first["count"] = np.add.reduceat(some["count"], starts) if len(starts) else 0
    single = counted[~many]
    again = np.concatenate([some[np.repeat(first["count"] > 1, size)], single[single["count"] > 1], loose])
    return np.concatenate([first, single]), again


def blocks_of(docs: DataFrame, tasks: int, remembered: int = 250_000) -> DataFrame:
    """(part, kind, rows) blocks for `tasks` parts: every line that isn't blank, numbered from 0, and the band rows of
    every distinct line of SHINGLE code points or more; shorter ones are alike only if equal.

    A task leaves out bands of lines it has lately seen, so copies cost little.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            doc, text_hash, known = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys, shorts, found, held = [], [], [], 0

            def given():
                yield line_blocks(np.concatenate(found), tasks)  # noqa: B023
                if keys:  # noqa: B023
                    rows = in_blocks(local_leads(np.concatenate(keys), np.concatenate(shorts)), tasks)  # noqa: B023
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1).cast(pa.int32()), rows.column(2)], ["part", "kind", "rows"])

            for i, _, data, offsets in textcore.chunks(batch.column(2), 1 << 17):  # arrays of its size stay in cache
                x = _Lines(data, offsets)
                if not x.names:
                    continue
                halves, row = _halves(x.names), x.doc + i
                lines = np.empty(len(x.names), LINE)
                for name, value in zip(LINE.names, (halves[:, 0], halves[:, 1], doc[row], text_hash[row], x.number, 1, known[row])):
                    lines[name] = value
                found.append(lines)
                held += len(lines)
                points, begins = textcore.code_points(data)
                starts, ends = (x.starts, x.ends) if begins is None else (np.searchsorted(begins, x.starts), np.searchsorted(begins, x.ends))
                fresh = []
                for k in np.flatnonzero(ends - starts >= SHINGLE).tolist():
                    if x.names[k] not in seen:
                        seen.add(x.names[k])
                        fresh.append(k)
                if len(seen) > remembered:
                    seen.clear()
                if fresh:
                    first = starts[fresh]
                    n = ends[fresh] - first - SHINGLE + 1  # shingles within the line
                    runs = textcore.point_runs(points, SHINGLE)[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]  # of these lines alone
                    table = band_keys(minima(runs, n), BANDS, ROWS)
                    keys.append(table.ravel())
                    shorts.append(np.repeat(halves[fresh, 0], BANDS))
                    held += table.size
                if held > 600_000:
                    yield from given()
                    keys, shorts, found, held = [], [], [], 0
            if held:
                yield from given()

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "part int, kind int, rows binary")


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """blocks (part, kind, rows) with all of a part in one task, one after the other; a task has many parts."""
    return blocks.select("part", "kind", "rows").repartition(min(parts, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part", "kind")


def _by_part(batches) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    part, held = None, []
    for batch in batches:
        for p, kind, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((kind, x))
    if held:
        yield part, held


def line_table(docs: DataFrame, parts: int) -> DataFrame:
    """A written table of four kinds of rows, from one reading of docs and one shuffle of blocks:

    - BUCKET: key, short and lead of `simjoin.buckets`, and whether the key may have several such rows;
    - AGAIN: node, doc_id, text_hash, line of every line whose name has several rows;
    - NODE: part, and a block of LINE rows: the first of each name, with the count of all;
    - NEEDED: part, and a block of the short names that buckets have.
    """
    types = {"key": pa.int64(), "short": pa.int64(), "lead": pa.int64(), "several": pa.bool_(), "node": pa.binary(), "doc_id": pa.int64(), "text_hash": pa.int64(), "line": pa.int32(), "part": pa.int32(), "rows": pa.binary()}

    def rows(kind: int, n: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[columns.get(c, pa.nulls(n, t)) for c, t in types.items()]], ["kind", *types])

    def run(batches):
        shared, again, firsts, held = [], [], [], 0

        def given():
            if shared:
                x = np.concatenate(shared, axis=1)
                yield rows(BUCKET, x.shape[1], key=pa.array(x[0]), short=pa.array(x[1]), lead=pa.array(x[2]), several=pa.array(x[3] == 1))
                names = np.unique(x[1:3])
                part = (names.astype(U) % U(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, names = part[order], names[order]
                starts = np.flatnonzero(np.concatenate([part[:1] == part[:1], part[1:] != part[:-1]]))
                blocks = [names[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(names)])]
                yield rows(NEEDED, len(starts), part=pa.array(part[starts]), rows=pa.array(blocks, pa.binary()))
            if again:
                x = np.concatenate(again)
                yield rows(AGAIN, len(x), node=_names(x), doc_id=pa.array(x["doc"], mask=~x["known"]), text_hash=pa.array(x["hash"]), line=pa.array(x["line"]))
            if firsts:
                yield rows(NODE, len(firsts), part=pa.array([p for p, _ in firsts], pa.int32()), rows=pa.array([x for _, x in firsts], pa.binary()))

        for part, blocks in _by_part(batches):
            bands, lines = [(kind == LED, x) for kind, x in blocks if kind != NODE], [np.frombuffer(x, LINE) for kind, x in blocks if kind == NODE]
            held += sum(len(x) for _, x in blocks)
            if bands:
                shared.append(np.stack(bucket_rows(bands)))
            if lines:
                first, more = merged_lines(np.concatenate(lines))
                firsts.append((part, first.tobytes()))
                again.append(more)
            if held > 1 << 24:  # bytes
                yield from given()
                shared, again, firsts, held = [], [], [], 0
        yield from given()

    schema = "kind int, key long, short long, lead long, several boolean, node binary, doc_id long, text_hash long, line int, part int, rows binary"
    return materialize(_dealt(blocks_of(docs, parts), parts).mapInArrow(run, schema), "lines", **{"parquet.enable.dictionary": "false"})


def line_nodes(table: DataFrame, parts: int) -> DataFrame:
    """(node, short, first, rows, shares), written, of a line_table: one row a distinct line that shares a bucket or has several rows."""

    def run(batches):
        for _, blocks in _by_part(batches):  # of a part, NODE comes first
            lines = [np.frombuffer(x, LINE) for kind, x in blocks if kind == NODE]
            names = [np.frombuffer(x, np.int64) for kind, x in blocks if kind == NEEDED]
            if lines:
                x = np.concatenate(lines)
                shares = np.isin(x["short"], np.concatenate(names)) if names else np.zeros(len(x), bool)
                keep = shares | (x["count"] > 1)
                x, shares = x[keep], shares[keep]
                yield pa.RecordBatch.from_arrays([_names(x), pa.array(x["short"]), pa.array(x["doc"], mask=~x["known"]), pa.array(x["hash"]), pa.array(x["line"]), pa.array(x["count"].astype(np.int64)), pa.array(shares)], ["node", "short", "doc_id", "text_hash", "line", "rows", "shares"])

    found = _dealt(table.filter(F.col("kind").isin(NODE, NEEDED)), parts).mapInArrow(run, "node binary, short long, doc_id long, text_hash long, line int, rows long, shares boolean")
    return materialize(found.select("node", "short", F.struct("doc_id", "text_hash", "line").alias("first"), "rows", "shares"), "line-nodes")


def _newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), an array, with the value computed once though body's lambdas use it often."""
    return F.flatten(F.transform(F.array(value), body))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text), written, of the lines wanted (node, first): each is cut from the document that holds it first."""
    lists = wanted.groupBy(F.col("first.doc_id").alias("holder"), F.col("first.text_hash").alias("holder_hash")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "node")).alias("wanted"))  # lines of one document
    held = docs.join(lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("text_hash") == F.col("holder_hash"))).select("text", "wanted")
    cut = _with(F.split("text", "\n"), lambda parts: F.transform("wanted", lambda x: F.struct(x["node"].alias("node"), F.get(parts, x["line"]).alias("text"))))
    texts = materialize(held.select(F.inline(cut)), "line-texts")
    if texts.count() == texts.select("node").distinct().count():
        return texts
    return materialize(texts.dropDuplicates(["node"]), "line-texts")  # documents that repeat as a whole


def line_groups(docs: DataFrame, nodes: DataFrame, shared: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(node, component) of the lines that have links.

    docs: (doc_id, text_hash, text); written tables: nodes (node, short, first), one row a distinct line that shares a
    bucket, and shared (key, short, lead, several), the buckets.
    """
    texts = _texts(docs, nodes)
    known = nodes.select("short", "node")
    stars = shared.filter("short <> lead").select(F.col("short").alias("a"), F.col("lead").alias("b")).distinct()
    stars = stars.join(known.select(F.col("short").alias("a"), F.col("node").alias("na")), "a").join(known.select(F.col("short").alias("b"), F.col("node").alias("nb")), "b")
    stars = materialize(stars.select(F.col("na").alias("a"), F.col("nb").alias("b")), "line-stars")
    links = materialize(verify(stars, texts, _sets, num, den), "line-links")
    labels = materialize(components(links), "line-labels")
    # Of a key with one row, both nodes have been compared.
    more = settle(shared.filter("several"), known, labels, lambda needed: texts.join(needed, "node", "left_semi"), _sets, num, den)
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)), "line-labels")
    discard(texts, stars, links, more)
    return labels


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, text_hash, removed): the line numbers, in order, that dedup_lines takes out of a document; those with any.

    docs: (doc_id, text_hash, text).
    """
    parts = max(PARTS, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = line_table(docs, parts)
    nodes = line_nodes(table, parts)
    candidates = nodes.filter("shares")
    shared = table.filter(F.col("kind") == BUCKET).select("key", "short", "lead", "several")
    labels = line_groups(docs, candidates, shared, num, den)
    linked = materialize(candidates.drop("short", "shares").join(labels, "node"), "linked")
    stays = materialize(linked.groupBy("component").agg(F.min("first").alias("stays"), F.count("*").alias("nodes")), "stays")
    of_group = spread_join(linked, stays, ["component"], "nodes").select("node", "first", "stays", "rows")
    repeats = nodes.filter("rows > 1").join(labels, "node", "left_anti").select("node", "first", F.col("first").alias("stays"), "rows")
    place = materialize(of_group.unionByName(repeats), "places")
    again = table.filter(F.col("kind") == AGAIN).select("node", "doc_id", "text_hash", "line")
    copies = spread_join(again, place.filter("rows > 1").select("node", "stays", "rows"), ["node"], "rows").select("doc_id", "text_hash", "line", "stays")
    single = place.filter("rows = 1").select("first.doc_id", "first.text_hash", "first.line", "stays")
    here = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash")) & (F.col("line") == F.col("stays.line"))
    gone = copies.unionByName(single).filter(~here)
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text", clean_col: str = "clean_text") -> DataFrame:
    """docs with the text left when each group of alike lines keeps one, as last column, and its counts before it.

    Lines (split at \\n) are linked when den * |intersection| >= num * |union| of their sets of runs of 8 code points, a
    shorter line being one run; groups are the connected components. Of a group the first line stays: least doc_id, then
    the text's hash, then line number. Lines of ASCII white space alone are left as they are.
    n_lines, n_removed: lines of the row, and those removed.

    - Null and empty texts have no lines, and stay as they are. A null doc_id comes first in order.
    - Rows that repeat a doc_id with another text are documents of their own. Rows that repeat both can't be told apart:
      they lose and keep the same lines.
    - Very long lines and texts are taken whole. An empty table gives an empty table. Columns of docs named like the new
      ones give those underscores.
    """
    n_lines, n_removed, clean = (free_name(docs.columns, c) for c in ("n_lines", "n_removed", clean_col))
    mark, of_id, of_hash, lost = (free_name(docs.columns, x) for x in ("__text_hash", "__id", "__hash", "__gone"))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    gone = removed_lines(plain, num, den).withColumnsRenamed({"doc_id": of_id, "text_hash": of_hash, "removed": lost})
    out = docs.withColumn(mark, F.xxhash64(F.col(text))).join(gone.hint("shuffle_hash"), F.col(doc_id).cast("long").eqNullSafe(F.col(of_id)) & (F.col(mark) == F.col(of_hash)), "left")
    parts = F.split(F.col(text), "\n")
    left = _with(parts, lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), lost), lambda i: F.get(p, i)))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.coalesce(_newlines(F.col(text)) + 1, F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(n_removed),
        F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(clean),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents at a similarity of 0.8; the text that is left as its length and checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("clean_chars"), F.crc32(F.col("clean_text").cast("binary")).cast("long").alias("clean_crc32"))
