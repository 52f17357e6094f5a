import io
import zipfile

import pytest
from pyspark.sql import functions as F

from almoneda import extract, facets, graph, ingest, state, texts
from almoneda.hierarchy import cpv_ancestors, cpv_children, nuts_rollup
from almoneda.search import bm25, fuse, search
from almoneda.sources import feeds, html
from almoneda.spec import FilterSpec, sort_order
from almoneda.store import SnapshotStore, duplicate_keys
from almoneda.streaming import daily

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:cbc="urn:a" xmlns:cac="urn:b" xmlns:at="http://purl.org/atompub/tombstones/1.0">
<link rel="self" href="https://x/a"/><link rel="next" href="https://contrataciondelestado.es/p2.atom"/>
<at:deleted-entry ref="https://x/s/44" when="2024-02-01T00:00:00Z"><at:comment type="CERRADA"/></at:deleted-entry>
<entry><id>https://x/s/11/</id><link href="https://l/11"/><updated>2024-01-02T00:00:00Z</updated><cac:ContractFolderStatus><cbc:ContractFolderID>X</cbc:ContractFolderID>
 <cbc:ContractFolderStatusCode listURI="http://x/S.gc">RES</cbc:ContractFolderStatusCode>
 <cac:ProcurementProject><cbc:Name>  </cbc:Name><cac:BudgetAmount><cbc:TaxExclusiveAmount currencyID="EUR">no</cbc:TaxExclusiveAmount><cbc:TotalAmount>5</cbc:TotalAmount></cac:BudgetAmount>
  <cac:RequiredCommodityClassification><cbc:ItemClassificationCode>03110000</cbc:ItemClassificationCode></cac:RequiredCommodityClassification></cac:ProcurementProject>
 <cac:ProcurementProjectLot><cbc:ID schemeName="x">1</cbc:ID><cac:ProcurementProject><cbc:Name>L1</cbc:Name><cac:RequiredCommodityClassification><cbc:ItemClassificationCode>45000000</cbc:ItemClassificationCode></cac:RequiredCommodityClassification></cac:ProcurementProject></cac:ProcurementProjectLot>
 <cac:TenderResult><cbc:ReceivedTenderQuantity>3.7</cbc:ReceivedTenderQuantity><cbc:SMEAwardedIndicator>TRUE</cbc:SMEAwardedIndicator><cac:WinningParty><cac:PartyIdentification><cbc:ID>b-1</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>Acme SL</cbc:Name></cac:PartyName></cac:WinningParty>
  <cac:AwardedTenderedProject><cbc:ProcurementProjectLotID>1</cbc:ProcurementProjectLotID><cac:LegalMonetaryTotal><cbc:PayableAmount>9.5</cbc:PayableAmount></cac:LegalMonetaryTotal></cac:AwardedTenderedProject></cac:TenderResult>
 <cac:TenderResult><cac:WinningParty><cac:PartyName><cbc:Name>Nobody</cbc:Name></cac:PartyName></cac:WinningParty></cac:TenderResult></cac:ContractFolderStatus></entry>
<entry><id>https://x/s/12</id><updated>2024-01-03T00:00:00Z</updated></entry></feed>"""


@pytest.fixture()
def feed(tmp_path):
    (tmp_path / "f.atom").write_text(FEED)
    return str(tmp_path / "f.atom")


def test_feed(spark, feed):
    e = feeds.entries(spark, feed, "mayores")
    assert [(r.sid, r.updated, r.link) for r in e.orderBy("sid").collect()] == [("11", "2024-01-02T00:00:00Z", "https://l/11"), ("12", "2024-01-03T00:00:00Z", None)]
    assert [tuple(r) for r in feeds.tombstones(spark, feed, "c").collect()] == [("44", "2024-02-01T00:00:00Z", "CERRADA", "c")]
    assert feeds.next_link(spark, feed, "https://new.example") == "https://new.example/p2.atom"
    rows = extract.contracts(e).collect()
    assert len(rows) == 1  # an entry without a status is no contract
    r = rows[0]
    assert (r.title, r.budget_amount, r.cpv, r.n_bids, r.sme_awarded, r.adjudicatario, r.adjudicatario_nif) == (None, None, ["03110000", "45000000"], 3, True, "Acme SL", "b-1")
    assert [(x.lot_id, x.winner_nif, x.amount, x.name) for x in r.lot_results] == [("1", "b-1", 9.5, "L1"), ("0", None, None, None)]
    assert [(a.lot_id, a.nif) for a in extract.awards(extract.contracts(e)).orderBy("lot_id").collect()] == [("0", None), ("1", "B1")]


def test_codelist_and_zip(spark, tmp_path):
    (tmp_path / "S.gc").write_text("<l>" + "".join(f'<Row><Value ColumnRef="code"><SimpleValue>{c}</SimpleValue></Value><Value ColumnRef="nombre"><SimpleValue>{n}</SimpleValue></Value><Value ColumnRef="name"><SimpleValue>{m}</SimpleValue></Value></Row>' for c, n, m in (("1", "Suministros", "Supplies"), ("2", " ", "Services"), ("3", "", ""), ("1", "Otra", "x"))) + "</l>")
    assert {(r.code, r.label) for r in feeds.codelist(spark, str(tmp_path / "S.gc")).collect()} == {("1", "Otra"), ("2", "Services"), ("3", "3")}
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("b/2.atom", "two")
        z.writestr("a.txt", "no")
    (tmp_path / "z.zip").write_bytes(blob.getvalue())
    assert [(r.name, r.content) for r in feeds.zip_members(spark, str(tmp_path / "z.zip")).collect()] == [("b/2.atom", "two")]


def test_catalog_and_download(spark):
    rows = feeds.catalog(spark, 2023).collect()
    assert len(rows) == 12 + 8 + 6 + 2 and sum(r.incremental for r in rows) == 4
    assert feeds.download("u", fetch=lambda u: b"x" + u.encode()) == b"xu"


def test_html_criteria():
    page = """<h4>Garantía Requerida Definitiva</h4><ul><li><span>Porcentaje</span><div class='noremarca'>5,0 %</div></li></ul><span>Directiva de aplicación</span><div class='noremarca'>2014/24</div>
    <a href='https://x/GetDocumentByIdServlet?1'>Pliego</a><a href='https://drive.google.com/2'> </a></p></div>"""
    got = html.parse(page)
    assert (got["garantia_definitiva_pct"], got["directiva_aplicacion"], got["pdf_links"], got["n_links"]) == (5.0, "2014/24", [{"nombre": "Pliego", "url": "https://x/GetDocumentByIdServlet?1"}], 2)
    empty = html.parse(None)
    assert set(empty) == set(html.FIELDS) and not any(empty.values())
    assert html.number("1.000,50 €") == 1000.5 and html.number("x") is None and html.number("..") is None
    html.parse("<div>" * 20_000 + "</p>" * 20_000)


def test_pdf_pages():
    import zlib

    from almoneda.sources import pdf

    packed = zlib.compress(b"BT (a \\(b\\) \\101) Tj T* [(c) 3 (d)] TJ ET")
    content = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode /Length 1>> stream\n" + packed + b"\nendstream endobj 2 0 obj <</Length 2>> stream\nBT (two) Tj ET\nendstream endobj 3 0 obj <</Filter /FlateDecode>> stream\nbroken\nendstream"
    assert pdf.pages_of(content) == ["a (b) A\ncd", "two"] and pdf.read_text(content) == "a (b) A\ncd\n\ntwo\n\n" and pdf.read_text(b"") == ""


def test_pdf_by_type_or_first_bytes(spark):
    from almoneda.sources import pdf

    files = spark.createDataFrame([(1, bytearray(b"%PDF-1"), None), (2, bytearray(b"<html>"), "text/html"), (3, bytearray(b"x"), "application/PDF"), (4, None, None)], "id long, content binary, kind string")
    assert sorted((r.id, r.text) for r in pdf.pdf_text(files, lambda c: f"{len(c)} bytes", content_type="kind").collect()) == [(1, "6 bytes"), (3, "1 bytes")]


def test_regions_of_topology(spark, tmp_path):
    from almoneda.sources import geo

    (tmp_path / "t.json").write_text('{"type":"Topology","objects":{"nuts":{"geometries":[{"id":"ES1","properties":{"na":"Norte"}},{"id":"FR1","properties":{"na":"x"}},{"properties":{"NUTS_ID":"ES2"}}]}}}')
    assert sorted(map(tuple, geo.regions(spark, str(tmp_path / "t.json")).collect())) == [("ES1", "Norte"), ("ES2", "")]


def test_parents_nest_without_bound(spark, tmp_path):
    deep = "".join(f"<cac:ParentLocatedParty><cac:PartyName><cbc:Name>Nivel {i} &amp; más</cbc:Name></cac:PartyName>" for i in range(30)) + "</cac:ParentLocatedParty>" * 30
    (tmp_path / "d.atom").write_text(f'<feed xmlns:cbc="urn:a" xmlns:cac="urn:b"><entry><id>1</id><updated>2024</updated><cac:ContractFolderStatus><cac:LocatedContractingParty>{deep}</cac:LocatedContractingParty></cac:ContractFolderStatus></entry></feed>')
    assert extract.contracts(feeds.entries(spark, str(tmp_path / "d.atom"), "c")).first().org_top_level == "Nivel 29 & más"


def versions(spark, rows):
    return spark.createDataFrame(rows, "sid string, updated string, status_code string, pos long, tombstone boolean, amount double")


def test_collapse_is_idempotent_and_order_free(spark):
    rows = [("a", "2026-01-01T00", "PUB", 1, False, 1.0), ("a", "2026-02-01T00", "EV", 2, False, 2.0), ("a", "2026-02-01T00", "ADJ", 3, False, 3.0), ("b", "2026-01-01T00", "PUB", 4, False, 1.0), ("b", None, None, 5, True, None), ("c", None, "PUB", 6, False, 0.0)]
    for order in (rows, rows[::-1]):
        got = {r.sid: (r.status_code, [(h.date, h.code) for h in r.history]) for r in ingest.collapse(versions(spark, order)).collect()}
        assert got == {"a": ("ADJ", [("2026-01-01", "PUB"), ("2026-02-01", "ADJ"), ("2026-02-01", "EV")]), "c": ("PUB", [(None, "PUB")])}


def test_stale_guard_and_history(spark):
    stored = ingest.collapse(versions(spark, [("a", "2026-02-01", "PUB", 1, False, 1.0)]))
    snapshot, fresh = ingest.ingest(stored, versions(spark, [("a", "2026-03-01", "EV", 2, False, 2.0)]))
    assert [(r.status_code, [h.code for h in r.history]) for r in snapshot.collect()] == [("EV", ["PUB", "EV"])] and fresh.count() == 1
    snapshot, fresh = ingest.ingest(stored, versions(spark, [("a", "2026-01-15", "EV", 2, False, 2.0)]))
    assert fresh.count() == 0 and snapshot.first().status_code == "PUB"


def test_store_and_stream(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(x, "sid string, v int")
    assert store.upsert(rows(("a", 1), ("b", 1)), "1") and not store.upsert(rows(("a", 9)), "1")
    assert store.upsert(rows(("b", 2), ("c", 2)), "2") and store.delete(rows(("a", 0), ("zz", 0)), "3")
    assert sorted(map(tuple, store.read().collect())) == [("b", 2), ("c", 2)] and duplicate_keys(store.read(), "sid").count() == 0
    before = len(store.versions())
    assert store.vacuum(1) >= 0 and store.read().count() == 2 and len(store.versions()) <= before
    assert store.upsert(rows(*[(k, 7) for k in "abcdefghijklmnopqrstuvwxyz"]), "all") and store.replace(rows(("b", 2), ("c", 2)), "4") and store.vacuum(1) > 0
    assert not any(store.upsert(rows(("a", 9)), b) for b in ("1", "2", "all"))  # vacuumed batches stay known
    assert store.insert(rows(("b", 3)), "5") and sorted(map(tuple, store.read().collect())) == [("b", 2), ("b", 3), ("c", 2)]
    assert not store.ensure("sid string") and SnapshotStore(spark, str(tmp_path / "e")).ensure("sid string") and SnapshotStore(spark, str(tmp_path / "e")).read().columns == ["sid"]
    land = tmp_path / "land"
    v = versions(spark, [("a", "2026-01-01", "PUB", 1, False, 1.0), ("b", "2026-01-01", "PUB", 2, False, 1.0)])
    v.write.parquet(str(land))
    out = SnapshotStore(spark, str(tmp_path / "out"))
    seen = []

    def run():
        daily.run_stream(spark.readStream.schema(v.schema).parquet(str(land)), out, str(tmp_path / "cp"), after=lambda df: seen.append(df.count()) or 1 / 0)

    run()
    versions(spark, [("a", "2026-01-02", "EV", 3, False, 1.0), ("b", None, None, 4, True, None)]).write.mode("append").parquet(str(land))
    run()
    run()
    assert [(r.sid, r.status_code, len(r.history)) for r in out.read().collect()] == [("a", "EV", 2)] and seen == [2, 1]


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    land, out = tmp_path / "land", tmp_path / "out"
    rows = lambda *x: spark.createDataFrame([(t, "k", v) for t, v in x], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)

    def step(*x):
        rows(*x).write.mode("append").parquet(str(land))
        stream = daily.event_windows(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(land)))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    step(("2024-01-01 10:05:00", 1.0), ("2024-01-01 10:50:00", 2.0))
    step(("2024-01-01 12:00:00", 4.0), ("2024-01-01 10:55:00", 8.0))  # the second is within the watermark yet
    step(("2024-01-01 10:10:00", 16.0), ("2024-01-01 14:00:00", 32.0))  # the first is too late by now
    step(("2024-01-01 16:00:00", 64.0))
    got = {str(r.start): (r.n, r.total) for r in spark.read.parquet(str(out)).collect()}
    assert got["2024-01-01 10:00:00"] == (3, 11.0) and got["2024-01-01 12:00:00"] == (1, 4.0)


def test_jobs(spark, tmp_path):
    """A walk over two pages of one channel, a second one that stops at the watermark, and the archives of a year."""
    from almoneda.jobs import Jobs

    entry = lambda i, day, code: f'<entry><id>https://x/s/{i}</id><link href="https://l/{i}"/><updated>2024-01-{day:02d}T00:00:00Z</updated><ContractFolderStatus><ContractFolderStatusCode>{code}</ContractFolderStatusCode></ContractFolderStatus></entry>'
    page = lambda body, nxt=None: f"<feed>{f'<link rel=\"next\" href=\"{nxt}\"/>' if nxt else ''}{body}</feed>".encode()
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("a.atom", page(entry(1, 9, "RES") + entry(7, 1, "PUB")))
    web = {feeds.head_url("placsp_mayores"): page(entry(1, 3, "EV") + '<deleted-entry ref="https://x/s/2" when="2024-01-03T00:00:00Z"/>', "p2"), "p2": page(entry(1, 1, "PUB") + entry(2, 1, "PUB") + entry(3, 2, "PUB"))}
    web |= {feeds.head_url(c): page("") for c, *_ in feeds.CHANNELS if c != "placsp_mayores"}
    asked = []

    def fetch(url):
        asked.append(url)
        return web.get(url) or (blob.getvalue() if url.endswith(".zip") else b"")

    jobs = Jobs(spark, str(tmp_path / "home"), fetch, year=2012)
    assert all(jobs.init_schema().values()) and not any(jobs.init_schema().values())
    assert jobs.daily() == {"placsp_mayores": 2, "externos_mayores": 1, "placsp_menores": 1, "propios": 1}
    state = lambda: {r.sid: (r.status_code, [h.code for h in r.history]) for r in jobs.store.read().collect()}
    assert state()["1"] == ("EV", ["EV"]) and "3" in state()
    assert jobs.watermark("placsp_mayores") == "2024-01-03T00:00:00Z"
    asked.clear()
    assert jobs.daily()["placsp_mayores"] == 1 and "p2" not in asked
    done, failed = jobs.reconcile()
    assert done == ["placsp_mayores_2012"] and not failed
    assert state()["1"] == ("RES", ["EV", "RES"]) and "7" in state()
    jobs.init_graph()


def test_walk_and_backfill():
    pages = {"p1": ("3", "p2"), "p2": ("2", "p3"), "p3": ("1", None)}
    assert daily.walk_pages("p1", pages.get, "2") == ["p1", "p2"] and daily.walk_pages("p1", pages.get, None) == ["p1", "p2", "p3"]
    feeds_ = [{"name": n, "year": y, "category": "c"} for n, y in (("new", 2024), ("bad", 2020), ("old", 2019))]
    done, failed = daily.backfill(feeds_, lambda f: 1 / 0 if f["name"] == "bad" else None)
    assert done == ["old", "new"] and list(failed) == ["bad"]


def test_spec():
    s = FilterSpec.from_params({"cpv": ["45"], "status": [], "open_only": True, "budget_min": 0, "q": "x"}, today="2026-01-01")
    assert s.active() == [("cpv", "45"), ("deadline_from", "2026-01-01"), ("budget_min", 0)]
    assert FilterSpec().active() == [] and s.without("cpv", "45").cpv == () and s.without("budget_min").budget_min is None
    assert facets.group_toggle(("1", "2"), ("1",)) == ("1", "2") and facets.group_toggle(("1", "2"), ("1", "2", "9")) == ("9",)


def test_spec_as_text_selects_the_same(spark, sf_dir):
    from almoneda.plans.testbind import contracts
    from almoneda.spec import has_more

    c = contracts(spark, sf_dir, "customer", "nuts", "result", "cpv")
    for spec in (FilterSpec(status=("O",), nuts=("ES1",), budget_min=1000.0), FilterSpec(cpv=("1", "2"), pub_from="1995-01-01", pub_to="1996-12-31"), FilterSpec(contract_type=("x' OR 1 = 1 --",))):
        assert c.filter(spec.to_text()).count() == spec.apply(c).count()
    assert FilterSpec().to_text() == "" and has_more(31, 15, 15) and not has_more(30, 15, 15) and has_more(None, 0, 15) and not has_more(None, 0, 14)


def test_sort_allow_list(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "sid string, budget_amount double").withColumn("publication_ts", F.lit("2024-01-01").cast("timestamp"))
    assert [r.sid for r in df.orderBy(*sort_order("budget_amount asc", df.columns)).collect()] == ["a", "c", "b"]
    assert [r.sid for r in df.orderBy(*sort_order("DROP TABLE desc", df.columns)).collect()] == ["a", "b", "c"]


def test_facet_properties(spark, sf_dir):
    from almoneda.plans.testbind import contracts

    c = contracts(spark, sf_dir, "customer", "nuts", "result", "cpv")
    spec = FilterSpec(status=("O",), nuts=("ES1",), budget_min=1000.0)
    t = facets.totals(c, spec).first()
    assert all(t[f"t_{d}"] >= t.total for d in ("cpv", "nuts", "status", "result", "contract_type", "procedure", "dates", "budget"))
    hist = facets.budget_histogram(c, spec)
    assert hist.count() == 15 and hist.agg(F.sum("n")).first()[0] == spec.apply(c, "budget").filter("budget_amount > 0").count()


def test_hierarchies(spark):
    codes = spark.createDataFrame([("45000000", "Construcción"), ("45200000", "Construcción completa"), ("45210000", "Edificios"), ("45211000", "Viviendas"), ("45100000", "Preparación"), ("03000000", "Agro")], "code string, label string")
    assert {r.code: r.path for r in cpv_ancestors(codes).collect()}["45211000"] == "Construcción > Construcción completa > Edificios"
    assert {r.child for r in cpv_children(codes).filter("parent = '45000000'").collect()} == {"45100000", "45200000"}
    counts = spark.createDataFrame([("ES300", 900), ("ES511", 100), ("ES512", 50)], "nuts string, n long")
    assert {r.nuts: r.n for r in nuts_rollup(counts, 2).collect()} == {"ES30": 900, "ES51": 150}


def awards(spark, rows):
    return spark.createDataFrame(rows, "sid string, lot_id string, nif string, name string, amount double, award_date string, seq long")


def test_graph(spark):
    a = awards(spark, [("1", "1", "B1", "Acme SL", 10.0, "2020-01-01", 1), ("1", "1", "B1", "Acme SL", 12.0, "2020-01-02", 2), ("1", "2", "B1", "OTHERNAME SA", 5.0, None, 3), ("2", "1", "B1", "Acme, S.L.", 7.0, "2021-01-01", 4), ("2", "2", None, "Nobody", 1.0, None, 5), ("3", "1", "U9", "UTE X", 1.0, None, 6)])
    won, lots = graph.won_edges(a), graph.lot_nodes(a)
    assert {(r.nif, r.lot_key): r.amount for r in won.collect()} == {("B1", "1:1"): 12.0, ("B1", "1:2"): 5.0, ("B1", "2:1"): 7.0, ("U9", "3:1"): 1.0}
    assert {r.nif: r.is_ute for r in graph.company_nodes(a).collect()} == {"B1": False, "U9": True}
    assert {r.nif: r.name for r in graph.canonical_names(won).collect()}["B1"] == "Acme SL"
    contracts = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "sid string")
    held = graph.contract_nodes(contracts, a)
    assert held.count() == 3
    left = graph.drop_contracts(spark.createDataFrame([("1",)], "sid string"), held, lots, won)
    assert [x.count() for x in left] == [2, 2, 2] and graph.company_nodes(a).count() == 2
    classified = spark.createDataFrame([("1:1", "45"), ("1:2", "45"), ("3:1", "45"), ("2:1", "03")], "lot_key string, cpv string")
    assert [(r.nif, r.shared_lots) for r in graph.similar_companies("B1", won, classified).collect()] == [("U9", 1)]
    tendered = spark.createDataFrame([("1", "X"), ("1", "Y"), ("2", "X")], "sid string, authority string")
    p, f = (graph.company_profile("B1", won, lots, classified, tendered, fanout=x).first() for x in (False, True))
    assert (p.n_contracts, p.n_lots, p.n_cpv, p.n_authorities, p.total_amount, f.total_amount) == (2, 3, 2, 2, 24.0, 41.0)


def test_index_equals_one_pass(spark, sf_dir, tmp_path):
    from almoneda.postings import Index

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = Index(spark, str(tmp_path / "i"), range_docs=8).build(docs)
    for terms in (["the", "idiot"], ["onre", "ONRE", "no such word"], ["und"]):
        assert {r.doc_id: round(r.score, 9) for r in index.bm25(terms).collect()} == {r.doc_id: round(r.score, 9) for r in bm25(docs, terms).collect()}
    some = docs.filter("doc_id % 3 = 0").select("doc_id")
    assert {r.doc_id for r in index.bm25(["the"], some).collect()} == {r.doc_id for r in bm25(docs, ["the"], some).collect()}


def test_search(spark):
    docs = spark.createDataFrame([("1", "roja casa roja", "A"), ("2", "casa azul", "A"), ("3", "coche", "B"), ("4", None, "A")], "sid string, content string, status_code string")
    got = {r.doc_id: r.score for r in bm25(docs, ["casa", "roja"], None, "sid", "content").collect()}
    assert set(got) == {"1", "2"} and got["1"] > got["2"] > 0
    assert search(docs, FilterSpec()).count() == 0
    assert [r.sid for r in search(docs, FilterSpec(status=("A",)), "casa", "keyword").collect()] == ["2", "1"]
    kw = spark.createDataFrame([(1, 5.0), (2, 1.0)], "id long, score double")
    vec = spark.createDataFrame([(2, 0.9), (3, 0.9)], "id long, score double")
    assert {r.id: r.score for r in fuse(kw, vec, 0.5).collect()} == {1: 0.5, 2: 0.5, 3: 0.5}


def test_state(spark):
    log = spark.createDataFrame([(1, "x", "save", 1, "t"), (1, "x", "remove", 2, None), (1, "x", "save", 3, None), (1, "y", "save", 1, "u"), (1, "y", "remove", 5, None), (1, "y", "remove", 6, None), (2, "z", "remove", 1, None)], "user_id long, item_id string, action string, ts long, title string")
    got = {(r.user_id, r.item_id): (r.active, r.saved_at, r.removed_at, r.title) for r in state.saved_state(log).collect()}
    assert got == {(1, "x"): (True, 3, None, "t"), (1, "y"): (False, 1, 5, "u")}
    users = spark.createDataFrame([("A@x.com",)], "email string")
    with pytest.raises(ValueError):
        state.add_user(users, spark.createDataFrame([(" a@X.com ",)], "email string"))
    assert state.by_email(users, " a@x.COM").count() == 1


@pytest.mark.parametrize("second,kept", [(3_997 - 60, 2), (3_998 - 60, 2), (3_999 - 60, 1), (4_000 - 60, 1), (4_001 - 60, 1)])
def test_paragraph_budget_at_its_limit(spark, second, kept):
    """A paragraph fits if what was picked, blank lines included, and it have 4,000 characters: 60 + 2 + n <= 4,000."""
    first = "pago pago " + "x" * 50
    text = first + "\n\n" + "\u00a0\t" + "pago " + "y" * (second - 5) + " \n"
    got = texts.extract_paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"), ("pago",)).first().picked
    assert got.count("\n\n") == kept and got.endswith("\n\n")


def test_excerpts_and_chunk_list(spark):
    docs = spark.createDataFrame([(1, "no clause here " * 700), (2, None), (3, "pago " * 20)], "doc_id long, text string")
    got = {r.doc_id: r.excerpt for r in texts.excerpts(docs, ("pago",)).collect()}
    assert got == {1: ("no clause here " * 700)[:8000], 2: "", 3: ("pago " * 20).strip() + "\n\n"}
    md = spark.createDataFrame([(1, "intro\n\n# One\n\nfirst\fsecond\n\n## Two\n\n\n\nthird"), (2, None)], "doc_id long, text string")
    assert [(r.chunk_index, r.chunk_title, r.chunk_page_number, r.chunk_text) for r in texts.chunk_list(md).orderBy("chunk_index").collect()] == [(0, "", 1, "intro"), (1, "One", 1, "first"), (2, "One", 2, "second"), (3, "Two", 2, "third")]


def test_paragraphs(spark):
    long = "pago " + "x" * 60
    docs = spark.createDataFrame([(1, f"{long}\n\n{long} pago seguro\n\ncorto pago\n\n{'y' * 80}"), (2, None)], "doc_id long, text string")
    assert [r.picked for r in texts.extract_paragraphs(docs, ("pago", "seguro")).collect()] == [f"{long} pago seguro\n\n{long}\n\n"]
    assert texts.join_chunks(texts.chunk(docs, "\n\n")).filter("doc_id = 1").first().text.count("\n\n") == 3


def test_analyze_and_embed(spark):
    from almoneda.providers import analyze, embed, embed_batch

    df = spark.createDataFrame([(1, "ISO 9001 y software"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.verdict, [q.met for q in r.requirements]) for r in analyze(df, ["iso", "software", "grúa"]).collect()}
    assert got == {1: ("YES", [True, True, False]), 2: ("NO", [False, False, False])}
    texts_ = [(i, f"text {i}") for i in range(7)]
    seen = {r.doc_id: [round(x, 4) for x in r.embedding] for r in embed(spark.createDataFrame(texts_, "doc_id long, content string"), batch=2).collect()}
    assert seen == {i: [round(x, 4) for x in embed_batch([t])[0]] for i, t in texts_}


def test_providers(spark):
    import json

    from almoneda import providers as P

    df = spark.createDataFrame([(1, "El pago es a 30 días. La garantía es del 5%. Otra cosa."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: json.loads(r.pcap) for r in P.ask(df.withColumn("prompt", P.pcap_prompt("text")), "prompt", P.extract_pcap, "pcap", "string").collect()}
    assert got[1] == {"pago": ["El pago es a 30 días"], "garantía": ["La garantía es del 5%"]} and got[2] == {}
    made = df.select(P.criteria_prompt("risks", F.struct(F.lit("a").alias("x"), F.lit("").alias("y"))).alias("prompt"))
    assert P.ask(made, "prompt", P.outline, "risks", "string").first().risks.endswith("bidder. x")
    sent = []
    ask = P.http_model("http://m", "gemma", as_json=True, post=lambda u, b: sent.append((u, json.loads(b))) or b'{"response": "ok"}')
    assert ask(["p"]) == ["ok"] and sent == [("http://m/api/generate", {"model": "gemma", "prompt": "p", "stream": False, "format": "json"})]
    assert P.http_model("http://m", "x", post=lambda u, b: b"no json")(["p"]) == [""]


def test_companies_and_criteria(spark):
    from almoneda.search import company_documents, criteria_of, search_companies

    c = company_documents(spark.createDataFrame([("B1", "Obras Norte", "Lugo"), ("B2", "Software Sur", None)], "nif string, name string, city string"))
    assert {r.sid: r.content for r in c.collect()} == {"B1": "name: Obras Norte. city: Lugo", "B2": "name: Software Sur"}
    assert search_companies(c, "software").first().sid == "B2"
    stored = spark.createDataFrame([("7", '{"a": 1}')], "sid string, criteria_json string")
    assert criteria_of(stored, "7", "a int").first().criteria.a == 1
    with pytest.raises(LookupError):
        criteria_of(stored, "8", "a int")


def test_folder_must_be_named_on_a_cluster(spark):
    from almoneda.store import workspace

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn", "getConf": staticmethod(lambda: type("G", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(ValueError):
        workspace(Cluster, "x")
