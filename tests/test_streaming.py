"""Stateful streams against the fold of all versions at once, and feeds read as streams of pages."""

import random

import pytest

from almoneda.store import SnapshotStore
from almoneda.streaming.latest import VERSION, fold, keep_latest


def made(seed):
    """Versions of few keys: equal times, unknown times and codes, repeats, tombstones, any arrival."""
    rng = random.Random(seed)
    rows = []
    for pos in range(60):
        sid = rng.choice(["a", "b", "c", "d", "e", "f", None])
        dead = rng.random() < 0.04
        rows.append((sid, rng.choice([None, *[f"2024-01-0{d}T0{h}:00:00" for d in range(1, 5) for h in range(2)]]), None if dead else rng.choice(["PUB", "EV", None]), pos, dead, f"p{pos}"))
    return rows


@pytest.mark.parametrize("seed,files", [(1, 1), (1, 6), (2, 4)])
def test_any_split_into_batches_equals_the_fold(spark, tmp_path, seed, files):
    rows = made(seed)
    random.Random(files).shuffle(rows)
    store, land = SnapshotStore(spark, str(tmp_path / "s"), depth=1), str(tmp_path / "land")

    def run():
        keep_latest(spark.readStream.schema(VERSION).option("maxFilesPerTrigger", 2).parquet(land), store, str(tmp_path / "cp"))

    for k in range(files):
        spark.createDataFrame(rows[k::files], VERSION).coalesce(1).write.mode("append").parquet(land)
        if k in (0, files // 2):
            run()  # and again from the checkpoint
    run()
    run()
    columns = ["sid", "updated", "status_code", "pos", "payload", "history"]
    want = fold(spark.createDataFrame(rows, VERSION)).select(*columns).collect()
    got = store.read("sid string, updated string, status_code string, pos bigint, payload string, history string").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def page(path, day, ids, following=None, code="PUB", gone=()):
    entry = lambda i: f'<entry><id>https://x/s/{i}</id><link href="https://l/{i}"/><updated>2024-01-{day:02d}T00:00:00Z</updated><cac:ContractFolderStatus xmlns:cac="urn:a"><cbc:ContractFolderStatusCode>{code}</cbc:ContractFolderStatusCode></cac:ContractFolderStatus></entry>'
    links = '<link rel="self" href="me"/>' + (f'<link href="{following}" rel="next"/>' if following else "")
    dead = "".join(f'<at:deleted-entry ref="https://x/s/{i}" when="2024-01-{day:02d}T00:00:00Z"/>' for i in gone)
    path.write_text(f"<?xml version='1.0'?><feed xmlns='urn:f'><updated>2024-01-{day:02d}T00:00:00Z</updated>{links}\n{dead}{''.join(map(entry, ids))}</feed>")
    return str(path)


@pytest.mark.parametrize("remember", [True, False])
def test_feed_resumes_where_it_was(spark, tmp_path, remember):
    from almoneda import ingest
    from almoneda.sources import feed_stream

    feed_stream.register(spark)
    store, newest, read = SnapshotStore(spark, str(tmp_path / "s"), depth=1), tmp_path / "head.atom", []

    def run():
        options = {"category": "c"} | ({"remember": str(tmp_path / "remember")} if remember else {})
        stream = spark.readStream.format("feed").options(**options).load(str(newest))

        def put(rows, n):
            read.append(sorted({r.page.rsplit("/", 1)[1] for r in rows.select("page").distinct().collect()}))
            ingest.apply(store, feed_stream.versions(rows), f"b{n}")

        stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    state = lambda: {r.sid: (r.status_code, [h.code for h in r.history]) for r in store.read().collect()}
    one = page(tmp_path / "p1.atom", 1, [1, 2, 3])
    two = page(tmp_path / "p2.atom", 2, [2, 4], one, "EV")
    page(newest, 3, [5], two, gone=[3])
    run()
    assert read == [["head.atom", "p1.atom", "p2.atom"]] and state() == {"1": ("PUB", ["PUB"]), "2": ("EV", ["PUB", "EV"]), "4": ("EV", ["EV"]), "5": ("PUB", ["PUB"])}
    page(tmp_path / "p1.atom", 1, [1, 99])  # what was read is not read again, or 99 would be there
    three = page(tmp_path / "p3.atom", 3, [5], two)
    page(newest, 4, [1], three, "RES")
    run()
    run()
    assert [r for r in read[1:] if r] == [["head.atom"]] and "99" not in state() and state()["1"] == ("RES", ["PUB", "RES"])


def test_only_the_beginning_of_a_page_is_read_for_its_link(tmp_path):
    from almoneda.sources import feed_stream

    url = page(tmp_path / "big.atom", 5, range(20_000), "older.atom")

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, k=-1):
            got = self.f.read(k)
            self.n += len(got)
            return got

        __enter__, __exit__ = lambda self: self, lambda self, *a: self.f.close()

    opened, real = [], feed_stream._open
    feed_stream._open = lambda *a: opened.append(Counted(real(*a))) or opened[-1]
    try:
        assert feed_stream.head(url) == ("2024-01-05T00:00:00Z", "older.atom") and opened[0].n <= feed_stream.STEP
    finally:
        feed_stream._open = real
    assert feed_stream.head(page(tmp_path / "last.atom", 1, [])) == ("2024-01-01T00:00:00Z", None)


def test_parts_of_a_page():
    from almoneda.sources.feed_stream import parts

    text = '<feed><a:deleted-entry ref="1"/><entry><id>x</id></entry>\n<at:deleted-entry ref="2" when="3"><at:comment type="C"/></at:deleted-entry><n:entry a=">"><id>é</id>\n</n:entry ></feed>'
    assert [k for k, _ in parts(text)] == ["deleted-entry", "entry", "deleted-entry", "entry"] and [x for _, x in parts(text)][3].endswith("</n:entry >")
    assert list(parts("<feed><entries/></feed>")) == []
