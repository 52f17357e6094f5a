"""Feed files that tests and queries write: bounded files, whole documents, all orders."""

from pyspark.sql import functions as F

from almoneda.plans import sources
from almoneda.sources import feeds

D = "/root/testdata/sf0.001"


def per_file(spark, path, tag="entry"):
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value").collect()
    assert all(t.value.startswith("<feed") and t.value.rstrip().endswith("</feed>") and t.value.count("<feed") == 1 for t in text)
    return [t.value.count(f"<{tag}>") for t in text]


def test_files_of_a_feed_grow_in_number(spark):
    n = spark.read.parquet(f"{D}/orders.parquet").count()
    path = sources.written_feed(spark, D, entries=50)
    sizes = per_file(spark, path)
    assert sum(sizes) == n and max(sizes) <= 100 and len(sizes) >= n // 50
    e = feeds.entries(spark, path, "test")
    assert e.count() == n and e.select("sid").distinct().count() == n


def test_pages_are_bounded_and_arrive_in_order(spark):
    path, pages = sources._pages(spark, D, entries=100)
    orders = spark.read.parquet(f"{D}/orders.parquet")
    assert max(per_file(spark, path)) <= 200
    for listed, want in ((path, "5"), (pages, "5"), (pages[::-1], "0")):
        e = feeds.entries(spark, listed, "test").filter(F.col("sid").cast("long") % 60 == 0)
        last = e.groupBy("sid").agg(F.max_by(F.col("status.ContractFolderID"), "pos").alias("v")).collect()
        assert len(last) == orders.filter("o_orderkey % 60 = 0").count() and {r.v for r in last} == {f"v{want}"}


def test_pages_of_a_stream_are_bounded(spark, tmp_path):
    from almoneda.sources import feed_stream

    n = spark.read.parquet(f"{D}/orders.parquet").filter("o_orderkey % 8 < 2").count()
    url, many = sources.feed_stream_pages(spark, D, f"file:{tmp_path}/web", range(2), entries=20)
    found, times = [], []
    while url:
        time, following = feed_stream.head(url)
        with feed_stream._open(url, 9) as f:
            found.append([k for k, _ in feed_stream.parts_read(f)].count("entry"))
        url, times = following, [*times, time]
    assert sum(found) == n and max(found) <= 60 and len(found) > n // 40 and times == sorted(set(times), reverse=True) and len(found) <= many


def test_parts_read_in_steps_equal_those_of_the_whole():
    import io

    from almoneda.sources.feed_stream import parts, parts_read

    text = '<feed><x/><a:deleted-entry ref="ñ"/><entry><id>é</id><deleted-entry ref="in"/></entry>\n<entries/><at:deleted-entry ref="2"><at:comment/></at:deleted-entry><n:entry a=">"><id>€</id>\n</n:entry ><entry>open<deleted-entry a="1"/></feed>'
    for step in (1, 2, 3, 7, 1000):
        assert list(parts_read(io.BytesIO(text.encode()), step)) == list(parts(text))


def test_files_take_a_fraction_of_their_text(spark):
    for path in (sources.written_feed(spark, D), sources._pages(spark, D)[0]):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0]
        text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).agg(F.sum(F.octet_length("value"))).first()[0]
        assert files * 5 < text


def test_packed_pages_are_unpacked(tmp_path):
    import gzip

    from almoneda.sources import feed_stream

    (tmp_path / "p.atom.gz").write_bytes(gzip.compress(b"<feed><updated>u</updated><entry>") + gzip.compress("é</entry></feed>".encode()))
    for url in (f"{tmp_path}/p.atom.gz", f"file:{tmp_path}/p.atom.gz"):
        with feed_stream._open(url, 9) as f:
            assert list(feed_stream.parts_read(f, 10)) == [("entry", "<entry>é</entry>")]
        assert feed_stream.head(url)[0] == "u"


def test_entries_of_a_stream_are_parsed_once_and_keep_their_text(spark):
    from almoneda.sources import feed_stream

    entry = '<n:entry xmlns:n="u"><n:id>https://x/s/1</n:id><n:updated>2024-01-01</n:updated><a.b:ContractFolderStatus><c:ContractFolderID>E ref:X</c:ContractFolderID><LocatedContractingParty><a.b:ParentLocatedParty><a.b:PartyName><a.b:Name>Alta</a.b:Name></a.b:PartyName></a.b:ParentLocatedParty></LocatedContractingParty></a.b:ContractFolderStatus></n:entry>'
    rows = [("entry", entry), ("entry", "<entry><id>https://x/s/2</id></entry>"), ("deleted-entry", '<at:deleted-entry ref="https://x/s/3/" when="2024-01-02"><at:comment/></at:deleted-entry>')]
    df = spark.createDataFrame([("c", "p", "t", i, *r) for i, r in enumerate(rows)], feed_stream.ROW)
    v = feed_stream.versions(df)
    nodes = [x for x in v._jdf.queryExecution().executedPlan().toString().splitlines() if "from_xml(" in x]
    assert len(nodes) == 1
    live, dead = v.orderBy("sid").collect()
    assert (live.sid, live.updated, live.expediente, live.org_top_level, live.tombstone) == ("1", "2024-01-01", "E ref:X", "Alta", False)
    assert (dead.sid, dead.updated, dead.category, dead.tombstone) == ("3", "2024-01-02", "c", True)
    assert {k for k, x in dead.asDict().items() if x is not None} == {"sid", "updated", "category", "pos", "tombstone"}
