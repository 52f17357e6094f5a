"""Links between sets whose Jaccard similarity reaches a threshold, from banded signatures to exact verification.

Nodes are distinct sets, named by 128 bits; bands and buckets hold the first 64 of them. The sets that share a band make a
bucket, and the work in buckets is arranged so that a bucket of a third of all nodes is still dealt to many tasks and
never expanded into all pairs:

1. Stars. Every node is paired with the least node of each of its buckets. A key that a task meets often is first reduced
   to that task's least node (its other nodes are paired with this one), so a hot key sends one row a task. Signatures
   rule out pairs that can't reach the threshold; what is left is verified on the full sets, in blocks of a star's nodes
   with one copy of its centre each. Links give components.
2. A bucket is settled when the nodes that weren't all paired with one are in one component. The others are cut into blocks
   of about BLOCK nodes, and each pair of blocks compares its nodes: signatures, where there are any, first name those that
   may have a link to another component, and only these are sent on with their full sets. Only links that join
   components leave a task.

So any two nodes that share a band are compared, ruled out by their signatures, or already connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda.llm.components import components
from almoneda.llm.shared import discard, materialize, spread_join
from almoneda.llm.textcore import U, chunks, mix64

#: Nodes of a bucket that are compared in one task; a larger bucket is cut into pairs of such blocks.
BLOCK = 256
#: Nodes of a star that are verified with one copy of its centre.
STAR = 256
#: Band rows that a task is dealt, of 16 bytes each, or 24 with their lead.
BAND_ROWS = 1_000_000

#: (registers of u, of v, sizes of u, of v) -> which pairs may reach the threshold.
Plausible = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: (bytes of texts, offsets) -> the set of each text.
Sets = Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def local_leads(key: np.ndarray, short: np.ndarray, often: int = 8) -> pa.RecordBatch:
    """(key, short, lead) of the band rows that a task has at hand.

    lead is null but for keys of `often` rows or more: there the least node has itself for lead, and others have it.
    """
    lead, known = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    place = key >> 6 & 0xFFFFF
    some = np.flatnonzero((np.bincount(place, minlength=1 << 20) >= often)[place])  # few others share a place
    if len(some):
        some = some[np.argsort(key[some], kind="stable")]
        k = key[some]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(starts, len(k)))
        known[some] = np.repeat(count >= often, count)
        lead[some] = np.repeat(np.minimum.reduceat(short[some], starts), count)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(short), pa.array(lead, mask=~known)], ["key", "short", "lead"])


def bucket_tasks(spark: SparkSession, rows: int) -> int:
    """The tasks that about so many band rows are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BAND_ROWS + 1)


def in_blocks(rows: pa.RecordBatch, tasks: int) -> pa.RecordBatch:
    """(part, led, rows) of the (key, short, lead) that local_leads gives: the band rows of a task as few rows of many numbers.

    Rows of a key that have no lead, or have themselves, are dealt to one of `tasks` parts; those with another lead to any.
    led: whether the rows have leads. A block holds its keys, then its short names, then its leads.
    """
    key, short, lead = (rows.column(i).fill_null(0).to_numpy() for i in range(3))
    known = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
    part = (key.view(U) >> U(6)) % U(tasks)  # the low 6 bits are the band
    away = known & (lead != short)
    part[away] = mix64(short[away].view(U)) % U(tasks)
    group = (part * U(2) + known.astype(U)).astype(np.uint16 if tasks < 1 << 15 else np.int64)
    order = np.argsort(group, kind="stable")
    group, key, short = group[order], key[order], short[order]
    lead = lead[order] if known.any() else lead
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    of = group[starts].astype(np.int64)
    blocks = [b"".join(x[a:b].tobytes() for x in (key, short, lead)[: 2 + k % 2]) for k, a, b in zip(of.tolist(), starts.tolist(), [*starts[1:].tolist(), len(group)])]
    return pa.RecordBatch.from_arrays([pa.array((of >> 1).astype(np.int32)), pa.array(of % 2 == 1), pa.array(blocks, pa.binary())], ["part", "led", "rows"])


#: Of what in_blocks gives.
BLOCKS = "part int, led boolean, rows binary"


def band_rows(nodes: DataFrame, keys: Callable[[np.ndarray], np.ndarray], dtype, tasks: int) -> DataFrame:
    """Band rows, in blocks, of every node (short long, sig binary); keys gives one key a band, its low 6 bits the band."""

    def run(batches):
        for batch in batches:
            found = [keys(matrix(batch.slice(i, 4096).column(1), dtype)) for i in range(0, batch.num_rows, 4096)]
            if found:
                table = np.concatenate(found)
                yield in_blocks(local_leads(table.ravel(), np.repeat(batch.column(0).to_numpy(), table.shape[1])), tasks)

    return nodes.select("short", "sig").mapInArrow(run, BLOCKS)


def shared_keys(key: np.ndarray, short: np.ndarray, lead: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, short, lead) rows of `buckets` for all rows of some keys; lead counts where known."""
    own = known & (lead == short)
    led = known & ~own
    out = [(key[led], short[led], lead[led])]
    key, short, own = key[~led], short[~led], own[~led]
    order = np.argsort(key)
    k = key[order]
    many = np.zeros(len(k), bool)
    many[1:] = k[1:] == k[:-1]
    many[:-1] |= many[1:]
    alone = order[~many]
    alone = alone[own[alone]]
    out.append((key[alone], short[alone], short[alone]))
    some = order[many]
    some = some[np.lexsort((short[some], key[some]))]
    if len(some):
        k, n = key[some], short[some]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])  # rows may repeat
        flagged = np.logical_or.reduceat(own[some], np.flatnonzero(fresh))
        k, n = k[fresh], n[fresh]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        least = n[first][np.cumsum(first) - 1]
        # A node that leads others of its task makes the bucket's least one a member like any other.
        out += [(k[~first], n[~first], least[~first]), (k[flagged], least[flagged], least[flagged])]
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values equal another one."""
    order = np.argsort(values)
    v, many, out = values[order], np.zeros(len(values), bool), np.zeros(len(values), bool)
    many[1:] = v[1:] == v[:-1]
    many[:-1] |= many[1:]
    out[order] = many
    return out


def bucket_rows(held: list[tuple[bool, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, short, lead) rows of `buckets` for the blocks (led, rows) of a part, and whether the key may have other rows."""
    rows = [np.frombuffer(x, np.int64).reshape(2 + led, -1) for led, x in held]
    sizes, led = [x.shape[1] for x in rows], [k for k, _ in held]
    key, short = (np.concatenate([x[i] for x in rows]) for i in (0, 1))
    lead = np.concatenate([x[2] if k else np.zeros(n, np.int64) for x, k, n in zip(rows, led, sizes)])
    held.clear()
    del rows
    known = np.repeat(led, sizes)
    n_led = int((known & (lead != short)).sum())  # come first; their bucket's least node has a row with itself
    key, short, lead = shared_keys(key, short, lead, known)
    several = short == lead
    several[:n_led] = True
    several[n_led:] |= repeated(key[n_led:])
    return key, short, lead, several


def buckets(bands: DataFrame, tasks: int) -> DataFrame:
    """(key, short, lead) of keys that several nodes share, repeated rows removed. bands: blocks of band rows for `tasks` parts.

    Every node but the least of its bucket has a row, with a lead that it is to be paired with. Where some were paired
    with a lead of their own task, the bucket's least node has a row too, with itself: not all were paired with it. One
    shuffle, a task a part.
    """

    def run(batches):
        held = [(led, x) for batch in batches for led, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in bucket_rows(held)[:3]], ["key", "short", "lead"])

    return bands.repartitionById(tasks, F.col("part")).mapInArrow(run, "key long, short long, lead long")


def screen(edges: DataFrame, nodes: DataFrame, plausible: Plausible, dtype) -> DataFrame:
    """The edges (a, b) of short names as (a, b) of full names, without those that the signatures rule out.

    nodes: (node, short, n, sig). Rows are dealt by a, so a star's centre is read by many tasks; its signature is small.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                p = batch.slice(i, 2048)
                ok = plausible(matrix(p.column(2), dtype), matrix(p.column(4), dtype), p.column(3).to_numpy(), p.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([p.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    counts = materialize(edges.groupBy("b").agg(F.count("*").alias("rows")), "star-sizes")
    named = nodes.select(F.col("short").alias("b"), F.col("node").alias("nb"), F.col("sig").alias("sb"), F.col("n").alias("size_b"))
    centres = materialize(named.join(counts, "b"), "centres")
    u = nodes.select(F.col("short").alias("a"), F.col("node").alias("na"), F.col("sig").alias("sa"), F.col("n").alias("size_a"))
    pairs = spread_join(edges, centres, ["b"], "rows").join(u, "a")
    return pairs.select(F.col("na").alias("a"), F.col("nb").alias("b"), "sa", "size_a", "sb", "size_b").mapInArrow(run, "a binary, b binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def verify(edges: DataFrame, texts: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """The edges (a, b) of a written table with den * |intersection| >= num * |union| on the full sets of texts (node, text).

    The nodes of a star are dealt in blocks of about STAR, each with one copy of the centre's text.
    """

    def run(batches):
        centre, kept = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                p = batch.slice(i, 64)
                ok = []
                for b, member, s in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), sets_of(p.column(3), sets)):
                    if not member:
                        centre, kept = b, s
                    fits = member and b == centre and den * min(len(s), len(kept)) >= num * max(len(s), len(kept))  # by their sizes
                    both = overlap(s, kept) if fits else 0
                    ok.append(both > 0 and den * both >= num * (len(s) + len(kept) - both))
                yield pa.RecordBatch.from_arrays([p.column(k).filter(pa.array(ok, pa.bool_())) for k in (2, 0)], ["a", "b"])

    counts = materialize(edges.groupBy("b").agg(F.count("*").alias("rows")), "star-sizes")
    blocks = F.ceil(F.col("rows") / STAR).cast("int")
    members = spread_join(edges, counts, ["b"], "rows").select("b", F.pmod(F.xxhash64("a"), blocks).cast("int").alias("block"), F.lit(True).alias("member"), "a")
    centres = counts.select("b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(False).alias("member"), F.col("b").alias("a"))
    dealt = members.unionByName(centres).join(texts.select(F.col("node").alias("a"), "text"), "a").repartition("b", "block").sortWithinPartitions("b", "block", "member")
    return dealt.select("b", "member", "a", "text").mapInArrow(run, "a binary, b binary")


def sets_of(column: pa.Array, sets: Sets) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column):
        yield from sets(data, offsets)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of groups): rows that agree in the first `keys` columns come together, and groups are never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held = table.to_batches()
            continue
        yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts[:-1]])
        held = table.slice(cuts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.zeros(1, np.int64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy().copy()


def overlaps(members: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """(n, n) numbers of members that each two of n sorted sets share, of the pairs wanted; others may stay 0."""
    n = len(members)
    if n > 16 and wanted.sum() > 4 * n:
        sizes = [len(x) for x in members]
        _, ids, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        shared = count > 1  # what one set alone has is in no intersection
        row = np.repeat(np.arange(n), sizes)[shared[ids]]
        ids = (np.cumsum(shared) - 1)[ids[shared[ids]]]
        width = int(shared.sum())
        if width * n < 40 * max(len(ids), 1):  # dense enough for products of matrices, in stripes that stay small
            out = np.zeros((n, n), np.float32)
            order = np.argsort(ids, kind="stable")
            row, ids = row[order], ids[order]
            for first in range(0, width, 8192):
                a, b = np.searchsorted(ids, [first, first + 8192])
                marks = np.zeros((n, min(8192, width - first)), np.float32)
                marks[row[a:b], ids[a:b] - first] = 1
                out += marks @ marks.T
            return out.astype(np.int64)
    out = np.zeros((n, n), np.int64)
    for x, y in zip(*(k.tolist() for k in np.nonzero(wanted))):
        out[x, y] = overlap(members[x], members[y])
    return out


def compare(members: list[np.ndarray], comp: np.ndarray, block: np.ndarray, across: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Of one pair of blocks of a bucket: links between different components, as many as it takes to join them.

    Every pair of nodes of different components (and, if across, blocks) whose sizes allow a link is compared on the full sets.
    """
    if len(members) == 2:
        m, n = len(members[0]), len(members[1])
        if comp[0] == comp[1] or den * min(m, n) < num * max(m, n):
            return []
        both = overlap(*members)
        return [(1, 0)] if den * both >= num * (m + n - both) else []
    sizes = np.array([len(x) for x in members])
    wanted = np.triu((comp[:, None] != comp[None]) & (den * np.minimum(sizes[:, None], sizes[None]) >= num * np.maximum(sizes[:, None], sizes[None])), 1)
    if across:
        wanted &= block[:, None] != block[None]
    both = overlaps(members, wanted)
    near = wanted & (den * both >= num * (sizes[:, None] + sizes[None] - both))
    found = []
    for x, z in zip(*(k.tolist() for k in np.nonzero(near))):
        if comp[z] != comp[x]:
            comp[comp == comp[z]] = comp[x]
            found.append((z, x))
    return found


def _dealt(member: DataFrame, block_size: int) -> DataFrame:
    """member (key, node, comp, members) with block, and a row for each pair (i, j) of blocks it is to be compared in."""
    blocks = F.ceil(F.col("members") / block_size).cast("int")
    out = member.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("members", "other")


def _likely(member: DataFrame, nodes: DataFrame, plausible: Plausible, dtype) -> DataFrame:
    """The rows (key, node, comp) of member whose signature doesn't rule out a link to another component of their bucket."""

    def run(batches):
        for rows, starts in whole_groups(batches, 3):
            sig, n = matrix(rows.column("sig").combine_chunks(), dtype), rows.column("n").to_numpy()
            comp, block = _codes(rows.column("comp")), rows.column("block").to_numpy()
            across = rows.column("i").to_numpy() != rows.column("j").to_numpy()
            keep = np.zeros(rows.num_rows, bool)
            us, vs, held = [], [], 0

            def judge():
                u, v = np.concatenate(us), np.concatenate(vs)
                ok = plausible(sig[u], sig[v], n[u], n[v])  # noqa: B023
                keep[u[ok]] = keep[v[ok]] = True  # noqa: B023

            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                for x in range(a, b - 1):
                    y = np.arange(x + 1, b)
                    y = y[(comp[y] != comp[x]) & ((block[y] != block[x]) | ~across[x])]
                    if len(y):
                        us.append(np.full(len(y), x))
                        vs.append(y)
                        held += len(y)
                    if held > 4096:  # pairs at once
                        judge()
                        us, vs, held = [], [], 0
            if held:
                judge()
            yield from rows.filter(pa.array(keep)).select(["key", "node", "comp"]).to_batches()

    rows = _dealt(member, BLOCK).join(nodes.select("node", "n", "sig"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select("key", "i", "j", "block", "node", "comp", "n", "sig").mapInArrow(run, "key long, node binary, comp binary").distinct()


def settle(shared: DataFrame, known: DataFrame, labels: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets: Sets, num: int, den: int, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) between different components that meet in a bucket.

    shared: buckets(...); known: (short, node); labels: (node, component). likely, if given, cuts the members of buckets
    (key, node, comp, members) to (key, node, comp) of those that may have such a link.
    """
    member = shared.select("key", "short").distinct().join(known, "short").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    member = materialize(member, "members")

    def unsettled(member: DataFrame, tag: str) -> DataFrame:
        names = [F.bit_xor(F.xxhash64("node", F.lit(i))) for i in range(2)]  # of the set of members; buckets of the same nodes need one comparison
        keys = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), names[0].alias("x"), names[1].alias("y")).filter("lo <> hi")
        open_keys = materialize(keys.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members"), "open-keys")
        return materialize(spread_join(member, open_keys, ["key"], "members").select("key", "node", "comp", "members"), tag)

    open_rows = unsettled(member, "unsettled")
    if likely is not None:
        chosen = materialize(likely(open_rows), "likely")
        discard(open_rows)
        open_rows = unsettled(chosen, "unsettled")
    texts = texts_of(open_rows.select("node").distinct())

    def run(batches):
        for rows, starts in whole_groups(batches, 3):
            comp, block = _codes(rows.column("comp")), rows.column("block").to_numpy()
            across = rows.column("i").to_numpy() != rows.column("j").to_numpy()
            node, a_side, b_side = rows.column("node").combine_chunks(), [], []
            members = list(sets_of(rows.column("text").combine_chunks(), sets))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                for z, x in compare(members[a:b], comp[a:b].copy(), block[a:b], bool(across[a]), num, den):
                    a_side.append(a + z)
                    b_side.append(a + x)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(k, pa.int64())) for k in (a_side, b_side)], ["a", "b"])

    rows = _dealt(open_rows, BLOCK).join(texts.select("node", "text"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(rows.select("key", "i", "j", "block", "node", "comp", "text").mapInArrow(run, "a binary, b binary"), "settled")
    discard(member, open_rows)
    return found


def link_groups(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets: Sets, keys: Callable[[np.ndarray], np.ndarray], bands: int, plausible: Plausible, dtype, num: int, den: int) -> DataFrame:
    """(node, component) for all nodes that have links; component is the least node of the group.

    nodes: a written table (node binary, short long, n int, sig binary), one row a distinct set, none empty. texts_of:
    given (node), their (node, text); only nodes with candidates are asked for. A link: den * |intersection| >= num * |union|.
    """
    tasks = bucket_tasks(nodes.sparkSession, bands * nodes.count())
    shared = materialize(buckets(band_rows(nodes, keys, dtype, tasks), tasks), "buckets")
    stars = materialize(shared.filter("short <> lead").select(F.col("short").alias("a"), F.col("lead").alias("b")).distinct(), "stars")
    likely_stars = materialize(screen(stars, nodes, plausible, dtype), "screened")
    ends = likely_stars.select(F.col("a").alias("node")).union(likely_stars.select("b")).distinct()
    texts = materialize(texts_of(ends), "texts")
    links = materialize(verify(likely_stars, texts, sets, num, den), "confirmed")
    discard(stars, likely_stars, texts)
    labels = materialize(components(links), "labels")
    more = settle(shared, nodes.select("short", "node"), labels, lambda needed: materialize(texts_of(needed), "set-texts"), sets, num, den, lambda member: _likely(member, nodes, plausible, dtype))
    if more.isEmpty():
        return labels
    return materialize(components(links.unionByName(more)), "labels")
