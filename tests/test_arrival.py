"""Entries of equal time are ordered by arrival, whatever files and splits Spark makes tasks of."""

import io
import zipfile

from pyspark.sql import functions as F

from almoneda.ingest import collapse_latest
from almoneda.sources import feeds


def entry(i, title):
    return f"<entry><id>https://x/s/{i}</id><updated>2024-01-01T00:00:00Z</updated><ContractFolderStatus><ContractFolderID>{title}</ContractFolderID></ContractFolderStatus></entry>"


def page(entries):
    return "<feed>\n" + "\n".join(entries) + "\n</feed>"


def latest(spark, path):
    e = feeds.entries(spark, path, "c").select("sid", "updated", F.col("status.ContractFolderID").alias("title"), "pos", F.lit(False).alias("tombstone"))
    return {r.sid: r.title for r in collapse_latest(e).collect()}


def test_last_entry_of_the_last_file_holds(spark, tmp_path):
    filler = [entry(f"f{k}", "x" * 200) for k in range(400)]
    (tmp_path / "a1.atom").write_text(page([*filler, entry(1, "FIRST"), entry(2, "only"), entry(3, "early"), *filler, entry(3, "late")]))
    (tmp_path / "b2.atom").write_text(page([entry(1, "SECOND")]))
    (tmp_path / "c3.atom").write_text(page([*filler, entry(4, "c")]))
    want = {"1": "SECOND", "2": "only", "3": "late", "4": "c"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("134217728", "20000"):  # files packed together, the largest first; then each by itself
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert {k: v for k, v in latest(spark, str(tmp_path)).items() if k in want} == want
            listed = [str(tmp_path / n) for n in ("c3.atom", "b2.atom", "a1.atom")]
            assert latest(spark, listed)["1"] == "FIRST"
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_splits_of_one_file_are_ordered(spark, tmp_path):
    """A source that reads a file in splits gives each the place of its first byte."""
    (tmp_path / "t.txt").write_text("\n".join(f"line {i:06d}" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = spark.read.text(str(tmp_path)).select("value", feeds.arrival(spark, str(tmp_path)).alias("pos"))
        assert lines.rdd.getNumPartitions() > 5
        assert [r.value for r in lines.orderBy("pos").collect()] == [f"line {i:06d}" for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_members_of_archives_come_in_order_of_their_names(spark, tmp_path):
    for name, members in (("2024.zip", {"b.atom": [entry(1, "3"), entry(2, "x")], "a.atom": [entry(1, "2")]}), ("2023.zip", {"z.atom": [entry(1, "1"), entry(2, "w")]})):
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w") as z:
            for m, entries in members.items():
                z.writestr(m, page(entries))
        (tmp_path / name).write_bytes(blob.getvalue())
    folder = feeds.unpacked(feeds.zip_members(spark, str(tmp_path / "*.zip")), str(tmp_path / "out"))
    assert latest(spark, folder) == {"1": "3", "2": "x"}


def test_of_rows_with_one_code_the_last_holds(spark, tmp_path):
    row = lambda c, n: f'<Row><Value ColumnRef="code"><SimpleValue>{c}</SimpleValue></Value><Value ColumnRef="nombre"><SimpleValue>{n}</SimpleValue></Value></Row>'
    (tmp_path / "S.gc").write_text("<l>" + "".join(row(c, f"{c}-{k}") for k in range(30) for c in "ab") + "</l>")
    assert {(r.code, r.label) for r in feeds.codelist(spark, str(tmp_path / "S.gc")).collect()} == {("a", "a-29"), ("b", "b-29")}


def test_archives_are_fetched_by_tasks(spark):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("b.atom", "two")
        z.writestr("a.atom", "one")
    content = blob.getvalue()
    got = feeds.fetched_members(spark, ["https://h/1.zip", "https://h/2.zip"], lambda url: content).collect()
    assert sorted((r.archive, r.number, r.name, r.content) for r in got) == [(f"https://h/{k}.zip", i, n, c) for k in (1, 2) for i, (n, c) in enumerate((("a.atom", "one"), ("b.atom", "two")))]
    assert len({r.digest for r in got}) == 1


def test_backfill_waits_for_its_hours():
    from almoneda.streaming.daily import backfill

    clock, seen = [10], []
    feeds_ = [{"name": n, "year": y, "category": "c"} for n, y in (("b", 2021), ("a", 2020), ("c", 2022))]

    def pause():
        clock[0] += 6

    def process(f):
        seen.append((f["name"], clock[0]))
        clock[0] += 3

    done, failed = backfill(feeds_, process, lambda: clock[0] % 24 >= 22 or clock[0] % 24 < 2, pause)
    assert done == ["a", "b", "c"] and not failed and seen == [("a", 22), ("b", 25), ("c", 46)]
