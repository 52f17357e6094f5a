"""The maintained award graph against tables built anew from everything that was written."""

import random

import pytest

from almoneda.graph_store import GraphStore, batch_tables, signed_names, top_names

AWARDS = "sid string, lot_id string, nif string, name string, amount double, award_date string, seq long"


class Model:
    """Edges by contract as plain dictionaries; names follow the edges, and a company without any keeps its last one."""

    def __init__(self):
        self.edges, self.ute, self.names = {}, {}, {}

    def apply(self, rows, gone):
        for sid, lot, nif, name, amount, date, seq in sorted(rows, key=lambda r: r[6]):
            if nif is not None:
                self.ute[nif] = self.ute.get(nif, False) or nif.startswith("U")
                if sid not in gone:
                    self.edges[sid, nif, f"{sid}:{lot}"] = (amount, name)
        for k in [k for k in self.edges if k[0] in gone]:
            del self.edges[k]
        counts = {}
        for (_, nif, _), (_, name) in self.edges.items():
            counts.setdefault(nif, {}).setdefault(name.upper(), []).append(name)
        for nif, by in counts.items():
            self.names[nif] = min(by.items(), key=lambda x: (-len(x[1]), x[0]))[1]
            self.names[nif] = min(self.names[nif])


@pytest.mark.parametrize("seed", [4, 5])
def test_batches_equal_a_rebuild(spark, tmp_path, seed):
    rng, model, g = random.Random(seed), Model(), GraphStore(spark, str(tmp_path / "g"))
    names = ["Acme", "ACME", "Beta", "beta", "Gamma"]
    for b in range(4):
        rows = [(str(rng.randint(1, 8)), str(rng.randint(1, 2)), rng.choice(["B1", "B2", "U3", None]), rng.choice(names), float(rng.randint(1, 99)), None, b * 1000 + i) for i in range(rng.choice([3, 8]))]
        gone = [str(k) for k in rng.sample(range(1, 9), b % 3)]
        tables = batch_tables(spark.createDataFrame(rows, AWARDS).coalesce(1))
        assert g.apply(f"b{b}", tables, spark.createDataFrame([(k,) for k in gone], "sid string")) and not g.apply(f"b{b}", tables)
        model.apply(rows, set(gone))
    assert {(r.sid, r.nif, r.lot_key): (r.amount, r.name_display) for r in g.read("won").collect()} == model.edges
    assert {r.lot_key for r in g.read("lots").collect()} == {k[2] for k in model.edges} and {r.sid for r in g.read("contracts").collect()} == {k[0] for k in model.edges}
    assert {r.nif: (r.is_ute, r.canonical_name) for r in g.read("companies").collect()} == {k: (v, model.names.get(k)) for k, v in model.ute.items()}
    assert all(r.n > 0 for r in g.read("names").collect())
    g.check()


def test_a_batch_that_failed_half_way_is_finished(spark, tmp_path, monkeypatch):
    g = GraphStore(spark, str(tmp_path / "g"))
    rows = lambda *x: batch_tables(spark.createDataFrame(x, AWARDS).coalesce(1))
    g.apply("1", rows(("1", "1", "B1", "Old", 1.0, None, 1), ("2", "1", "B1", "Old", 1.0, None, 2)))
    second = rows(("1", "1", "B1", "New", 1.0, None, 3), ("2", "1", "B1", "New", 1.0, None, 4))
    real = g.stores["names"].change
    monkeypatch.setattr(g.stores["names"], "change", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        g.apply("2", second)
    assert {r.name_display for r in g.read("won").collect()} == {"New"} and g.read("companies").first().canonical_name == "Old"
    monkeypatch.setattr(g.stores["names"], "change", real)
    assert g.apply("2", second) and g.read("companies").first().canonical_name == "New" and g.read("names").count() == 1


def test_only_the_companies_of_a_batch_are_written(spark, tmp_path):
    g = GraphStore(spark, str(tmp_path / "g"))
    g.apply("all", batch_tables(spark.range(300).selectExpr("cast(id as string) sid", "'1' lot_id", "concat('B', id % 50) nif", "'N' name", "1.0D amount", "cast(null as string) award_date", "id seq")))
    g.apply("few", batch_tables(spark.createDataFrame([("900", "1", "B7", "N", 1.0, None, 1)], AWARDS)))
    written = {t: [r.rows for r in g.stores[t].commits().orderBy("n").collect()] for t in ("won", "names", "companies")}
    assert written == {"won": [300, 1], "names": [50, 1], "companies": [50, 1]}
    assert g.read("names").filter("nif = 'B7'").first().n == 7


def test_signed_names_and_ties(spark):
    e = lambda *x: spark.createDataFrame(x, "nif string, name_norm string, name_display string")
    got = signed_names(e(("1", "A", "a"), ("1", "A", "a"), ("1", "B", "b")), e(("1", "A", "a"), ("1", "B", "b"), ("2", "C", "c")))
    assert {tuple(r) for r in got.collect()} == {("1", "A", "a", -1), ("2", "C", "c", 1)}
    n = spark.createDataFrame([("1", "B", "b", 2), ("1", "A", "y", 1), ("1", "A", "x", 1)], "nif string, name_norm string, name_display string, n long")
    assert [tuple(r) for r in top_names(n).collect()] == [("1", "x")]


def test_of_extracted_contracts(spark, tmp_path):
    from almoneda.graph_store import of_contracts

    result = "array<struct<lot_id:string,winner_name:string,winner_nif:string,amount:double,award_date:string,cpv:array<string>>>"
    rows = [("1", "t", 1, [("1", "Acme SL", "b-1", 5.0, None, ["45", "45", "03"]), ("2", "Acme SL", "B1", None, None, None)], "L1", "Lugo", "Top", "ES112"), ("2", "t", 2, [("1", "Nobody", None, 1.0, None, ["45"])], "L2", "x", None, "ES1")]
    c = spark.createDataFrame(rows, f"sid string, updated string, pos long, lot_results {result}, contracting_authority_id string, contracting_authority string, org_top_level string, nuts_code string")
    g = GraphStore(spark, str(tmp_path / "g"))
    g.apply("1", of_contracts(c))
    rows = lambda t, *cols: sorted(tuple(r) for r in g.read(t).select(*cols).collect())
    assert rows("won", "nif", "lot_key", "amount") == [("B1", "1:1", 5.0), ("B1", "1:2", 0.0)] and rows("classified", "lot_key", "cpv") == [("1:1", "03"), ("1:1", "45")]
    assert rows("tendered", "sid", "authority") == [("1", "L1")] and rows("authorities", "authority", "name", "org_top_level") == [("L1", "Lugo", "Top")] and rows("located", "sid", "nuts") == [("1", "ES112")]
    g.check()


def test_awards_are_shuffled_once_for_edges(spark):
    rows = [("1", "2:3", "B1", "Acme SL", 1.0, None, 1), ("1:2", "3", "B2", "Beta", 2.0, "d", 2), ("1:2", "3", "B2", "Gamma", 3.0, "e", 1), ("4", "1", None, "No", 1.0, None, 3)]
    won = batch_tables(spark.createDataFrame(rows, AWARDS).repartition(3))["won"]
    got = won.select("sid", "nif", "lot_key", "amount", "award_date", "name_norm", "name_display").collect()
    assert sorted(map(tuple, got)) == [("1:2", "B1", "1:2:3", 1.0, None, "ACME", "Acme SL"), ("1:2", "B2", "1:2:3", 2.0, "d", "BETA", "Beta")]
    assert won._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
    assert won._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1


def test_a_written_table_leaves_no_shuffle_files(spark):
    import os
    import time

    from almoneda.store import discard, written

    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    had, setting = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    found = written(spark.range(1000, numPartitions=3).groupBy("id").count(), "t")
    for _ in range(50):
        if not shuffled() - had:
            break
        time.sleep(0.1)
    assert not shuffled() - had and spark.conf.get(setting) == before and found.count() == 1000
    path = found.inputFiles()[0]
    discard(found)
    assert not os.path.exists(path.removeprefix("file://"))
