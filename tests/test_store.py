"""The log store against a plain model of rows by key."""

import random
import threading

import pytest

from almoneda import ingest
from almoneda.store import Conflict, SnapshotStore


def table(spark, rows, ddl="sid string, v long"):
    return spark.createDataFrame(rows, ddl).coalesce(1)


def held(store):
    return sorted(map(tuple, store.read("sid string, v long").select("sid", "v").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_equals_the_model(spark, tmp_path, seed):
    """Upserts, inserts and deletes of repeated, null and absent keys, with joins of files and splits of parts between."""
    rng, model = random.Random(seed), {}
    store = SnapshotStore(spark, str(tmp_path / "s"), depth=1, most_files=3, share=0.3, part_rows=12)
    keys = [*"abcdefghijkl", None]
    for i in range(22):
        some = rng.sample(keys, rng.randint(1, 5))
        rows = [(k, i * 10 + j) for k in some for j in range(rng.choice([1, 1, 2]))]
        op = rng.choice(["upsert", "upsert", "insert", "delete"]) if i else "upsert"
        if op == "delete":
            store.delete(table(spark, [(k,) for k in some], "sid string"), f"b{i}")
            for k in some:
                model.pop(k, None)
        else:
            assert getattr(store, op)(table(spark, rows), f"b{i}") and not getattr(store, op)(table(spark, rows), f"b{i}")
            for k in some:
                model[k] = (model.get(k, []) if op == "insert" else []) + [v for x, v in rows if x == k]
        if i % 4 == 3:
            assert held(store) == sorted(((k, v) for k, vs in model.items() for v in vs), key=str)
    before = held(store)
    store.compact(everything=True)
    assert held(store) == before == held(SnapshotStore(spark, str(tmp_path / "s"))) and store._state()["depth"] > 1
    assert store.vacuum(0) > 0 and held(store) == before and store.applied("b0")
    part = store.touched(table(spark, [("a",)], "sid string"))
    assert {r.sid for r in store.read(parts=part).collect()} >= {"a"} & model.keys()
    assert sorted(r.v for r in store.rows_of(table(spark, [("a",), ("a",), ("zz",)], "sid string")).collect()) == sorted(model.get("a", []))


def test_a_small_batch_writes_its_own_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.replace(spark.range(20_000).selectExpr("cast(id as string) sid", "id v"), "all")
    store.upsert(spark.range(100).selectExpr("cast(id * 7 as string) sid", "-1L v"), "few")
    store.delete(spark.range(50).selectExpr("cast(id as string) sid"), "gone")
    assert [r.rows for r in store.commits().orderBy("n").collect()] == [20_000, 100, 50]
    assert store.read().count() == 19_950 and store.read().filter("v = -1").count() == 100 - len([k for k in range(0, 50, 7)])


def test_upkeep_writes_a_bounded_multiple(spark, tmp_path):
    """Many batches of one size: files a part stay few, and what is written in all is a small multiple of the rows."""
    store = SnapshotStore(spark, str(tmp_path / "s"), depth=0, most_files=4)
    store.replace(spark.range(3000).selectExpr("cast(id as string) sid", "id v"), "all")
    for i in range(14):
        store.upsert(spark.range(20).selectExpr(f"cast(id + {i * 20} as string) sid", f"{i}L v"), f"b{i}")
        assert all(len(g) <= 6 for g in store._groups(store._state()).values())
    assert store.commits().groupBy().sum("rows").first()[0] <= 3000 + 14 * 20 * 4
    assert store.read().count() == 3000


def test_two_writers(spark, tmp_path):
    a, b = (SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    assert a.upsert(table(spark, [("x", 1)]), "1")
    since = b.version()
    assert a.upsert(table(spark, [("x", 2)]), "2")
    with pytest.raises(Conflict):
        b.change("3", replace=table(spark, [("x", 3)]), since=since)
    assert held(a) == [("x", 2)] and not b.applied("3") and b.change("3", replace=table(spark, [("x", 3)]), since=b.version())
    jobs = [threading.Thread(target=s.upsert, args=(table(spark, [(k, 9)]), k)) for s, k in ((a, "p"), (b, "q"), (a, "r"), (b, "s"))]
    for t in jobs:
        t.start()
    for t in jobs:
        t.join()
    assert held(b) == [("p", 9), ("q", 9), ("r", 9), ("s", 9), ("x", 3)] and a.version() == 7


def test_commits_beyond_a_state_file_and_lost_marks(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), depth=0, most_files=100)
    for i in range(18):
        store.upsert(table(spark, [(f"k{i % 3}", i)]), f"b{i}")
    store._fs.delete(store._path(f"{store.path}/applied/b17"), False)  # as if the writer had died before its mark
    assert store.applied("b17") and store.applied("b2") and not store.applied("b18") and held(store) == [("k0", 15), ("k1", 16), ("k2", 17)]


def test_new_columns_and_empty_batches(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.read() is None and store.upsert(table(spark, []), "0") and store.read().columns == ["sid", "v"] and store.read().count() == 0
    store.upsert(table(spark, [("a", 1)]), "1")
    store.upsert(table(spark, [("b", 2, "x")], "sid string, v long, more string"), "2")
    assert {(r.sid, r.v, r.more) for r in store.read().collect()} == {("a", 1, None), ("b", 2, "x")}


def test_ingest_tells_what_it_skipped(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    v = lambda *rows: spark.createDataFrame(rows, "sid string, updated string, status_code string, pos long, tombstone boolean, category string")
    assert ingest.apply_counted(store, v(("a", "2024-01-02", "PUB", 1, False, "c"), ("b", "2024-01-01", "PUB", 2, False, "c")), "1")[1] == {"records": 2, "upserted": 2, "deleted": 0, "skipped": 0}
    fresh, stats = ingest.apply_counted(store, v(("a", "2024-01-02", "EV", 3, False, "c"), ("b", "2024-01-03", "EV", 4, False, "c"), ("d", None, None, 5, True, "c")), "2")
    assert stats == {"records": 2, "upserted": 1, "deleted": 1, "skipped": 1} and [r.sid for r in fresh.collect()] == ["b"]
