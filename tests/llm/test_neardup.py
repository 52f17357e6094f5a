import random
import re

import numpy as np
import pytest

from almoneda.llm import linededup, neardup, textcore
from almoneda.llm.components import components
from almoneda.llm.setsketch import SetSketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, num, den):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t).capitalize() if rng.random() < 0.3 else " ".join(t))
    texts += ["", "   \n\t", "one two", "One TWO", "é à b", "x", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return [(i * 3 % 101 + 1000 * (i // 101), t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5)])
def test_groups_equal_brute_force(spark, num, den):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), num, den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute(rows, num, den)


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(None, None, "x"), (None, base, "x"), (5, base, None), (5, base, "y"), (7, "", "z"), (8, base + " tail", "z"), (9, "long " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {}
    for r in neardup.near_duplicates(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert sorted(got[None], key=str) == sorted([(0, None, True), (46, 5, False)], key=str)
    assert got[5] == [(46, 5, True)] * 2 and got[7] == [(0, 7, True)] and got[8] == [(47, 5, False)] and got[9] == [(1, 9, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "9", "None"]


def test_large_bucket_is_settled(spark, monkeypatch):
    """Copies that drift: most aren't alike the least of the bucket, yet all hang together."""
    from almoneda.llm import simjoin

    monkeypatch.setattr(simjoin, "BLOCK", 4)
    rng, rows = random.Random(5), []
    words = [f"v{i}" for i in range(120)]
    for i in range(40):
        words = list(words)
        words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute(rows, 85, 100)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    s = SetSketch()
    a, b = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    assert (np.maximum(s.registers(a), s.registers(b)) == s.registers(np.union1d(a, b))).all()
    near, far = np.concatenate([a[:460], b[:40]]), np.concatenate([a[:250], b[:250]])
    ok = lambda x: bool(s.plausible(s.registers(a)[None], s.registers(x)[None], np.array([500]), np.array([len(x)]), 0.8)[0])
    assert ok(near) and ok(a) and not ok(far)


def test_words_and_shingles_by_hand():
    texts = ["a b\tc\x0bd  e f", "", " x ", "É é ß a b c"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    arr = np.frombuffer(data, np.uint8)
    words = textcore.Words(arr, offsets)
    assert np.diff(words.firsts).tolist() == [6, 0, 1, 5]
    assert [len(s) for s in textcore.shingle_sets(arr, offsets)] == [2, 0, 1, 1]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    lines = [(d, i, x) for d, t in rows if t for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} or {x} for _, _, x in lines]
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(lines):
        groups.setdefault(root(i), []).append(x[:2])
    gone = {x for g in groups.values() for x in g if x != min(g)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) if t else t for d, t in rows}


def test_lines_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(90).collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "short\n\n" + rows[0][1]), (10_003, "ñ" * 30 + "\n" + "ñ" * 31)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'mine' AS clean_text")
    got = linededup.dedup_lines(df.repartition(4))
    assert got.columns == ["doc_id", "text", "clean_text", "n_lines", "n_removed", "clean_text_"]
    assert {r.doc_id: r.clean_text_ for r in got.collect()} == brute_lines(rows)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_query_digests_the_text_that_is_left(spark, tmp_path):
    import zlib

    long = "a line of some length that several documents have"
    rows = [(1, f"{long}\nanother line of its own, long enough"), (2, f"{long}s\n\nñandú: what is left of the second document\n{long}"), (3, long), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    left = brute_lines(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.clean_chars, r.clean_crc32) for r in linededup.op2_line_dedup(spark, str(tmp_path)).collect()}
    n_lines, n_removed = {1: 2, 2: 4, 3: 1, 4: 0, 5: 1}, {1: 0, 2: 2, 3: 1, 4: 0, 5: 0}
    assert got == {d: (n_lines[d], n_removed[d], *((None, None) if t is None else (len(t), zlib.crc32(t.encode())))) for d, t in left.items()}


def test_bands_find_nearly_all_pairs_at_the_threshold():
    assert (1 - 0.8**linededup.ROWS) ** linededup.BANDS <= 3e-5
    keys = linededup.keys_of(np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert (keys & 63).tolist() == list(range(linededup.BANDS))


def test_short_lines_go_by_equality(spark, tmp_path):
    import zlib

    rows = [(1, "Ietzte.\n\n \t\nñ\nIetzte"), (2, "Ietzte.\n\n \t\nñandú\nñ"), (3, "Ietzte.\nIetzte."), (4, "Ietzte. \nIETZTE.")]
    want = {1: rows[0][1], 2: "\n \t\nñandú", 3: "", 4: rows[3][1]}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.clean_text for r in linededup.dedup_lines(df).collect()} == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.clean_crc32 for r in linededup.op2_line_dedup(spark, str(tmp_path)).collect()} == {d: zlib.crc32(t.encode()) for d, t in want.items()}


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    a, b = "the first text has this line alone", "nothing of it is found in the second one"
    rows = [(1, a), (5, a), (5, b), (None, b), (5, b), (6, "x" * 200_000 + "\n" + a)]
    got = sorted((str(r.doc_id), r.text[:40], r.n_removed, r.clean_text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", a, 0, a), ("5", a, 1, ""), ("5", b[:40], 1, ""), ("None", b[:40], 0, b), ("5", b[:40], 1, ""), ("6", "x" * 40, 1, "x" * 200_000)])


def test_hot_lines_and_keys(spark, monkeypatch):
    """A third of all lines share their bands: they are drawn together within tasks, split into blocks, and joined by broadcast."""
    from almoneda.llm import simjoin

    monkeypatch.setattr(simjoin, "STAR", 8)
    monkeypatch.setattr(simjoin, "BLOCK", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = " ".join(word() for _ in range(12))
    rows = []
    for i in range(260):
        near = list(base)
        near[rng.randrange(len(near))] = "Z"
        rows.append((i, "\n".join(["".join(near) if i % 2 else base, "same line in all of them", " ".join(word() for _ in range(6))])))
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {r.doc_id: r.clean_text for r in got.collect()} == brute_lines(rows)


def test_local_leads_by_hand():
    from almoneda.llm.simjoin import local_leads

    got = local_leads(np.array([7, 7, 7, 5, 7]), np.array([4, 2, 9, 1, 2]), often=3).to_pylist()
    assert [(r["key"], r["short"], r["lead"]) for r in got] == [(7, 4, 2), (7, 2, 2), (7, 9, 2), (5, 1, None), (7, 2, 2)]


def test_null_id_group_keeps_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base + " more"), (None, "only this one, by itself, stays too")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2 and rows[2][1] in {r.text for r in got}


def test_buckets_pair_or_hold_every_two_nodes_of_a_key():
    """Over rows that several tasks drew together: two nodes of a key are paired, or both are members of its bucket."""
    from collections import defaultdict

    from almoneda.llm.simjoin import local_leads, shared_keys

    rng = np.random.default_rng(4)
    for _ in range(200):
        parts, nodes = [], defaultdict(set)
        for _ in range(rng.integers(1, 4)):
            n = rng.integers(1, 40)
            key, short = rng.integers(0, 6, n), rng.integers(0, 15, n)
            for k, s in zip(key.tolist(), short.tolist()):
                nodes[k].add(s)
            parts.append(local_leads(key, short, often=4))
        column = lambda i: np.concatenate([p.column(i).fill_null(0).to_numpy() for p in parts])  # noqa: B023, E731
        known = np.concatenate([p.column(2).is_valid().to_numpy(zero_copy_only=False) for p in parts])
        pairs, members = defaultdict(set), defaultdict(set)
        for k, s, lead in zip(*(x.tolist() for x in shared_keys(column(0), column(1), column(2), known))):
            assert lead in nodes[k] and s in nodes[k] and lead <= s
            members[k].add(s)
            pairs[k].add((lead, s))
        for k, found in nodes.items():
            assert all((a, b) in pairs[k] or {a, b} <= members[k] for a in found for b in found if a < b)


def test_band_rows_travel_in_blocks_by_key():
    """Few rows of many numbers leave a task; all rows of a key that have no lead of another name meet in one part."""
    from almoneda.llm.simjoin import in_blocks, local_leads

    rng = np.random.default_rng(6)
    key = rng.integers(-(2**63), 2**63 - 1, 500)[rng.integers(0, 500, 40_000) % np.where(rng.random(40_000) < 0.5, 500, 3)]
    rows = local_leads(key, rng.integers(-(2**63), 2**63 - 1, 40_000), often=60)
    blocks, got, parts = in_blocks(rows, 7).to_pylist(), [], {}
    assert len(blocks) <= 14 and {b["part"] for b in blocks} <= set(range(7))
    for b in blocks:
        table = np.frombuffer(b["rows"], np.int64).reshape(2 + b["led"], -1)
        for k, s, lead in zip(*(x.tolist() for x in table[:2]), table[2].tolist() if b["led"] else [None] * table.shape[1]):
            got.append((k, s, lead))
            if lead is None or lead == s:
                parts.setdefault(k, set()).add(b["part"])
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order((r["key"], r["short"], r["lead"]) for r in rows.to_pylist())
    assert all(len(x) == 1 for x in parts.values()) and len(set.union(*parts.values())) == 7
    assert in_blocks(rows.slice(0, 0), 7).num_rows == 0


def test_minima_agree_as_often_as_sets_are_alike():
    """Of sets of any size; and pairs at the threshold are missed no more often than by minima that know nothing of each other."""
    rng = np.random.default_rng(5)
    for union in (5, 10, 40, 200):
        members = rng.integers(0, 2**64, (3000, union), dtype=np.uint64)
        a, b = (np.concatenate([members[:, : union * 4 // 5], x], 1) for x in np.array_split(members[:, union * 4 // 5 :], 2, axis=1))
        of_a, of_b = (linededup.minima(x.ravel(), np.full(len(x), x.shape[1])) for x in (a, b))
        assert (of_a[7] == linededup.minima(a[7][::-1].copy(), np.array([a.shape[1]]))[0]).all()
        assert abs((of_a == of_b).mean() - 0.8) < 0.01
        assert (of_a == of_b).reshape(-1, linededup.BANDS, linededup.ROWS).all(2).any(1).sum() >= 2998


def test_merged_lines_equal_brute_force_and_hot_names_travel_once():
    rng = np.random.default_rng(3)
    whole = np.zeros(4000, linededup.LINE)
    for name, high in (("short", 900), ("low", 2), ("doc", 50), ("hash", 3), ("line", 9)):
        whole[name] = rng.integers(0, high, len(whole))
    whole["short"][:2000], whole["count"], whole["known"] = 7, 1, rng.random(len(whole)) < 0.9
    whole["doc"][~whole["known"]] = 0
    names = lambda x: (int(x["short"]), int(x["low"]))
    want = {}
    for x in whole:
        want.setdefault(names(x), []).append((bool(x["known"]), int(x["doc"]), int(x["hash"]), int(x["line"])))
    parts, hot = {}, 0
    for block in np.array_split(whole.copy(), 4):
        for row in linededup.line_blocks(block, 5).to_pylist():
            found = np.frombuffer(row["rows"], linededup.LINE)
            parts.setdefault(row["part"], []).append(found)
            hot += int(((found["short"] == 7) & (found["count"] > 0)).sum())
    assert hot <= 4 * 2 * linededup.OFTEN
    first, again = zip(*(linededup.merged_lines(np.concatenate(x)) for x in parts.values()))
    first, again = np.concatenate(first), np.concatenate(again)
    value = lambda x: (bool(x["known"]), int(x["doc"]), int(x["hash"]), int(x["line"]))
    assert sorted((names(x), value(x), int(x["count"])) for x in first) == sorted((k, min(v), len(v)) for k, v in want.items())
    assert sorted((names(x), value(x)) for x in again) == sorted((k, x) for k, v in want.items() if len(v) > 1 for x in v)


def test_pairs_whose_sizes_forbid_a_link_are_not_compared(monkeypatch):
    from almoneda.llm import simjoin

    asked, overlap = [], simjoin.overlap
    monkeypatch.setattr(simjoin, "overlap", lambda a, b: asked.append((len(a), len(b))) or overlap(a, b))
    members = [np.arange(n, dtype=np.uint64) for n in (10, 11, 40, 100)]
    assert simjoin.compare(members, np.arange(4), np.zeros(4, int), False, 4, 5) == [(1, 0)] and asked == [(10, 11)]
    assert simjoin.compare(members[::3], np.arange(2), np.zeros(2, int), False, 4, 5) == [] and len(asked) == 1


def test_only_keys_with_several_rows_are_looked_at_again():
    from almoneda.llm.simjoin import bucket_rows

    block = lambda *rows: np.array(rows, np.int64).T.tobytes()
    key, short, lead, several = bucket_rows([(False, block((1, 5), (1, 4), (2, 6), (3, 7), (3, 8))), (False, block((3, 9))), (True, block((4, 1, 1), (5, 3, 2)))])
    assert set(zip(*(x.tolist() for x in (key, short, lead, several)))) == {(1, 5, 4, False), (3, 8, 7, True), (3, 9, 7, True), (4, 1, 1, True), (5, 3, 2, True)}
