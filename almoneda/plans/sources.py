"""Queries of sources: feeds written from the test tables and read again."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from almoneda import extract
from almoneda.plans.registry import query
from almoneda.plans.testbind import VERSIONS, table, versions
from almoneda.sources import feeds, geo, html, pdf
from almoneda.store import SnapshotStore, workspace


#: Entries of a written feed file, and of a page of short entries. A reader takes a file as a whole, so files are bounded
#: and their number grows with the input.
FILE_ENTRIES, PAGE_ENTRIES = 20_000, 200_000
#: Rows of a landed file, and tender pages of a task, whose rows in the table are few bytes.
LANDED_ROWS, TASK_PAGES = 100_000, 2_000


def _entry():
    """An order as a feed entry, one lot and one result each for orders of even key."""
    key, money = F.col("o_orderkey").cast("string"), F.format_string("%.2f", "o_totalprice")
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    lot = part('<ProcurementProjectLot><ID schemeName="l"> 1 </ID><ProcurementProject><Name>Lote ', key, '</Name><BudgetAmount><TaxExclusiveAmount currencyID="EUR">', money, "</TaxExclusiveAmount></BudgetAmount><RequiredCommodityClassification><ItemClassificationCode>03110000</ItemClassificationCode></RequiredCommodityClassification></ProcurementProject></ProcurementProjectLot>")
    result = part('<TenderResult><ResultCode listURI="http://x/TenderResultCode-2.0.gc">8</ResultCode><AwardDate>2020-05-01</AwardDate><ReceivedTenderQuantity>3.0</ReceivedTenderQuantity><SMEAwardedIndicator>true</SMEAwardedIndicator><WinningParty><PartyIdentification><ID schemeName="NIF">B', key, "</ID></PartyIdentification><PartyName><Name>Acme ", key, " SL</Name></PartyName></WinningParty><AwardedTenderedProject><ProcurementProjectLotID>1</ProcurementProjectLotID><LegalMonetaryTotal><PayableAmount>", money, "</PayableAmount></LegalMonetaryTotal></AwardedTenderedProject></TenderResult>")
    even = F.pmod("o_orderkey", F.lit(2)) == 0
    xml = part(
        "<entry><id>https://x/sindicacion/", key, "/</id><link href=\"https://x/", key, "\"/><updated>", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '</updated><cac-place-ext:ContractFolderStatus><cbc:ContractFolderID>E-', key, '</cbc:ContractFolderID><cbc-place-ext:ContractFolderStatusCode listURI="http://x/StatusCode.gc">', "o_status",
        "</cbc-place-ext:ContractFolderStatusCode><LocatedContractingParty><BuyerProfileURIID>https://p/", key, "</BuyerProfileURIID><Party><PartyIdentification><ID schemeName=\"DIR3\">L0", key, "</ID></PartyIdentification><PartyName><Name>Entidad</Name></PartyName><PostalAddress><CityName>Lugo</CityName><Country><Name>España</Name></Country></PostalAddress></Party><ParentLocatedParty><PartyName><Name>Media</Name></PartyName><ParentLocatedParty><PartyName><Name>Alta</Name></PartyName></ParentLocatedParty></ParentLocatedParty></LocatedContractingParty>",
        "<ProcurementProject><Name> Obra ", key, '</Name><TypeCode listURI="http://x/ContractCode.gc">1</TypeCode><BudgetAmount><EstimatedOverallContractAmount>', money, "</EstimatedOverallContractAmount><TotalAmount>", money, "</TotalAmount></BudgetAmount><RequiredCommodityClassification><ItemClassificationCode>45000000</ItemClassificationCode></RequiredCommodityClassification>",
        '<RealizedLocation><CountrySubentityCode listURI="http://x/NUTS-2021.gc">ES112</CountrySubentityCode></RealizedLocation></ProcurementProject>',
        F.when(even, lot).otherwise(""), F.when(even, result).otherwise(""),
        '<TenderingTerms><FundingProgramCode>NO-EU</FundingProgramCode></TenderingTerms><TenderingProcess><ProcedureCode listURI="http://x/SyndicationTenderingProcessCode-2.07.gc">9</ProcedureCode><TenderSubmissionDeadlinePeriod><EndDate>', F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"), "</EndDate></TenderSubmissionDeadlinePeriod></TenderingProcess>",
        "<ValidNoticeInfo><NoticeTypeCode>DOC_CN</NoticeTypeCode><AdditionalPublicationStatus><AdditionalPublicationDocumentReference><IssueDate>", F.date_format("o_orderdate", "yyyy-MM-dd"), "</IssueDate></AdditionalPublicationDocumentReference></AdditionalPublicationStatus></ValidNoticeInfo>",
        "<GeneralDocument><GeneralDocumentDocumentReference><Attachment><ExternalReference><URI>https://d/", key, "/1.pdf</URI></ExternalReference></Attachment></GeneralDocumentDocumentReference><GeneralDocumentDocumentReference><Attachment><ExternalReference><URI>https://d/", key, "/2.pdf</URI></ExternalReference></Attachment></GeneralDocumentDocumentReference></GeneralDocument>",
        "</cac-place-ext:ContractFolderStatus></entry>",
    )
    return F.replace(xml, F.lit("o_status"), F.col("o_orderstatus"))


def entry_xml(spark, d):
    """(o_orderkey, xml): every order as an entry."""
    return table(spark, d, "orders").select("o_orderkey", _entry().alias("xml"))


def _documents(spark, rows, keys, count, head, value, path):
    """Writes a document for each of the keys, of which there are `count` different ones: head, a line a row, end. Rows are
    dealt to files before their text is made, and files are compressed, as entries are long and alike."""
    place = rows.select(*keys).distinct().select(*keys, F.explode(F.lit([0, 2])).alias("place"))
    dealt = rows.withColumn("place", F.lit(1)).unionByName(place, allowMissingColumns=True).repartition(count, *keys).sortWithinPartitions(*keys, "place")
    text = F.when(F.col("place") == 0, head).when(F.col("place") == 2, F.lit("</feed>")).otherwise(value)
    dealt.select(*keys, text.alias("value")).write.partitionBy(*keys).option("compression", "gzip").text(path)
    return path


def _dealt(spark, d, entries):
    """(orders, parts): orders with `file`, 0 to 7, and `part`, of which a file has `parts`."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    parts = max(1, -(-o.count() // (8 * entries)))
    return o.withColumns({"file": F.pmod("o_orderkey", F.lit(8)), "part": F.pmod(F.xxhash64("o_orderkey"), F.lit(parts))}), parts


def _gone():
    """A tombstone beside every hundredth order."""
    return F.when(F.pmod("o_orderkey", F.lit(100)) == 0, F.concat(F.lit('<at:deleted-entry ref="https://x/sindicacion/'), F.col("o_orderkey").cast("string"), F.lit('" when="2024-01-01T00:00:00Z"><at:comment type="CERRADA"/></at:deleted-entry>'))).otherwise("")


def written_feed(spark, d, entries=FILE_ENTRIES):
    """The path of feed files of all orders, with a tombstone for every hundredth. A file is one document, an entry a line."""
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:cbc="urn:a" xmlns:cac-place-ext="urn:b" xmlns:cbc-place-ext="urn:c" xmlns:at="http://purl.org/atompub/tombstones/1.0"><link rel="next" href="https://contrataciondelestado.es/next.atom"/>'
    o, parts = _dealt(spark, d, entries)
    return _documents(spark, o, ["file", "part"], 8 * parts, F.lit(head), F.concat(_gone(), _entry()), workspace(spark, "feed"))


def parsed(spark, d):
    return extract.contracts(feeds.entries(spark, written_feed(spark, d), "test"))


@query("extract_contracts", """SELECT CAST(o_orderkey AS VARCHAR) AS sid, 'E-' || o_orderkey AS expediente, 'Obra ' || o_orderkey AS title, o_orderstatus AS status_code, 'Alta' AS org_top_level, round(o_totalprice, 2) AS budget_amount,
  CASE WHEN o_orderkey % 2 = 0 THEN '45000000,03110000' ELSE '45000000' END AS cpvs, CASE WHEN o_orderkey % 2 = 0 THEN 'B' || o_orderkey END AS adjudicatario_nif, CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS n_bids FROM orders""")
def _(spark, d):
    return parsed(spark, d).select("sid", "expediente", "title", "status_code", "org_top_level", "budget_amount", F.array_join("cpv", ",").alias("cpvs"), "adjudicatario_nif", "n_bids")


@query("extract_status", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderstatus AS history, '1' AS contract_type_code, 'ContractCode.gc' AS contract_type_list, '9' AS procedure_code, 'DOC_CN' AS notice_type, round(o_totalprice, 2) AS estimated_value FROM orders")
def _(spark, d):
    events = F.array_join(F.transform("history", lambda h: F.concat_ws("|", h["date"], h["code"])), ";")
    return parsed(spark, d).select("sid", events.alias("history"), "contract_type_code", "contract_type_list", "procedure_code", "notice_type", "estimated_value")


@query("extract_places", """SELECT CAST(o_orderkey AS VARCHAR) AS sid, 'Entidad' AS contracting_authority, 'L0' || o_orderkey AS contracting_authority_id, 'https://p/' || o_orderkey AS buyer_profile_url, 'ES112' AS nuts_code, 'NUTS-2021.gc' AS nuts_list, 'Lugo' AS city, 'España' AS country,
  strftime(o_orderdate, '%Y-%m-%d') AS publication_date, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS submission_deadline, 'NO-EU' AS funding_program, 'https://d/' || o_orderkey || '/1.pdf https://d/' || o_orderkey || '/2.pdf' AS document_urls FROM orders""")
def _(spark, d):
    return parsed(spark, d).select(
        "sid", "contracting_authority", "contracting_authority_id", "buyer_profile_url", "nuts_code", "nuts_list", "city", "country", "publication_date", "submission_deadline", "funding_program", F.array_join("document_urls", " ").alias("document_urls"),
    )


@query("extract_award", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) END AS awarded_amount, CASE WHEN o_orderkey % 2 = 0 THEN '8' END AS result_code, CASE WHEN o_orderkey % 2 = 0 THEN 'TenderResultCode-2.0.gc' END AS result_list, CASE WHEN o_orderkey % 2 = 0 THEN '2020-05-01' END AS award_date, CASE WHEN o_orderkey % 2 = 0 THEN 'Acme ' || o_orderkey || ' SL' END AS adjudicatario, CASE WHEN o_orderkey % 2 = 0 THEN true END AS sme_awarded FROM orders")
def _(spark, d):
    return parsed(spark, d).select("sid", "awarded_amount", "result_code", "result_list", "award_date", "adjudicatario", "sme_awarded")


@query("explode_lots", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, '1' AS lot_id, 'Lote ' || o_orderkey AS name, round(o_totalprice, 2) AS amount FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, d):
    return parsed(spark, d).select("sid", F.explode("lots").alias("x")).select("sid", "x.lot_id", "x.name", "x.amount")


@query("explode_lot_results", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, '1' AS lot_id, 'Lote ' || o_orderkey AS name, '03110000' AS cpvs, 'B' || o_orderkey AS winner_nif, round(o_totalprice, 2) AS amount, true AS sme_awarded FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, d):
    return parsed(spark, d).select("sid", F.explode("lot_results").alias("x")).select("sid", "x.lot_id", "x.name", F.array_join("x.cpv", ",").alias("cpvs"), "x.winner_nif", "x.amount", "x.sme_awarded")


@query("codelist_decode", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, CASE o_orderstatus WHEN 'O' THEN 'Abierta' WHEN 'F' THEN 'Formalizada' ELSE o_orderstatus END AS status_label FROM orders")
def _(spark, d):
    lists = spark.createDataFrame([("StatusCode.gc", "O", "Abierta"), ("StatusCode.gc", "F", "Formalizada"), ("Other.gc", "P", "wrong list")], "list_file string, code string, label string")
    return extract.decode(parsed(spark, d).select("sid", "status_code", "status_list"), lists, "status").select("sid", "status_label")


@query("scan_atom_entries", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated, 'https://x/' || o_orderkey AS link, 'E-' || o_orderkey AS expediente FROM orders")
def _(spark, d):
    return feeds.entries(spark, written_feed(spark, d), "test").select("sid", "updated", "link", F.col("status.ContractFolderID").alias("expediente"))


def _pages(spark, d, n=6, entries=PAGE_ENTRIES):
    """(folder, pages): n pages, page k with every (k + 1)th order under the title vk, all of one time, so that sizes
    are unlike and only arrival decides. A page is a folder of files."""
    o = table(spark, d, "orders").select("o_orderkey")
    parts = max(1, -(-o.count() // entries))
    o = o.withColumn("part", F.pmod(F.xxhash64("o_orderkey"), F.lit(parts))).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(F.pmod("o_orderkey", F.col("page") + 1) == 0)
    xml = F.concat(F.lit("<entry><id>https://x/s/"), F.col("o_orderkey").cast("string"), F.lit("</id><updated>2024-01-01T00:00:00Z</updated><ContractFolderStatus><ContractFolderID>v"), F.col("page").cast("string"), F.lit("</ContractFolderID></ContractFolderStatus></entry>"))
    path = _documents(spark, o, ["page", "part"], n * parts, F.lit("<feed>"), xml, workspace(spark, "pages"))
    return path, [f"{path}/page={k}" for k in range(n)]


_LAST_PAGE = " ".join(f"WHEN o_orderkey % {k + 1} = 0 THEN 'v{k}'" for k in range(5, 0, -1))


@query("feed_arrival", f"SELECT CAST(o_orderkey AS VARCHAR) AS sid, CASE {_LAST_PAGE} ELSE 'v0' END AS expediente FROM orders")
def _(spark, d):
    """Equal times in files of unlike sizes: the entry of the last page holds."""
    from almoneda.ingest import collapse_latest

    path, _ = _pages(spark, d)
    e = feeds.entries(spark, path, "test").select("sid", "updated", F.col("status.ContractFolderID").alias("expediente"), "pos", F.lit(False).alias("tombstone"))
    return collapse_latest(e).select("sid", "expediente")


@query("feed_arrival_listed", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, 'v0' AS expediente FROM orders")
def _(spark, d):
    """The same files listed newest first: the first page is read last, and it has all orders."""
    from almoneda.ingest import collapse_latest

    _, pages = _pages(spark, d)
    e = feeds.entries(spark, pages[::-1], "test").select("sid", "updated", F.col("status.ContractFolderID").alias("expediente"), "pos", F.lit(False).alias("tombstone"))
    return collapse_latest(e).select("sid", "expediente")


@query("scan_tombstones", "SELECT CAST(o_orderkey AS VARCHAR) AS sid, '2024-01-01T00:00:00Z' AS gone_at, 'CERRADA' AS reason FROM orders WHERE o_orderkey % 100 = 0")
def _(spark, d):
    return feeds.tombstones(spark, written_feed(spark, d), "test").select("sid", F.col("when").alias("gone_at"), "reason")


@query("scan_codelist", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS label FROM nation")
def _(spark, d):
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    name = F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.col("n_name")).otherwise(" ")
    value = lambda ref, v: F.concat(F.lit(f'<Value ColumnRef="{ref}"><SimpleValue>'), v, F.lit("</SimpleValue></Value>"))
    path = workspace(spark, "gc")
    rows = table(spark, d, "nation").select(F.concat(F.lit("<Row>"), value("code", code), value("nombre", name), F.lit("</Row>")).alias("x"))
    rows.agg(F.concat(F.lit("<l>"), F.array_join(F.collect_list("x"), ""), F.lit("</l>")).alias("value")).write.text(path)  # 25 rows
    return feeds.codelist(spark, path).select("code", "label")


@query("scan_zip", "SELECT 'nations' || r_regionkey || '.zip' AS archive, 'deep/' || n_nationkey || '.atom' AS name, '<feed>' || n_name || ' ñ</feed>' AS content FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    path = workspace(spark, "zip")
    nations = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 nations
    for region in sorted({r["n_regionkey"] for r in nations}):
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w") as z:
            for r in nations:
                if r["n_regionkey"] == region:
                    z.writestr(f"deep/{r['n_nationkey']}.atom", f"<feed>{r['n_name']} ñ</feed>")
            z.writestr("readme.txt", "no feed")
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/nations{region}.zip")
        out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path)
        out.write(bytearray(blob.getvalue()))
        out.close()
    return feeds.zip_members(spark, path).select(F.regexp_extract("archive", "([^/]+)$", 1).alias("archive"), "name", "content")


@query("feed_next_link", "SELECT 'https://example.org/next.atom' AS href")
def _(spark, d):
    path = workspace(spark, "next")
    one = spark.range(1).select(F.lit('<feed><link rel="self" href="https://a/b"/><link href="https://contrataciondelestado.es/next.atom" rel="next"/><entry><link rel="next" href="no"/></entry></feed>').alias("value"))
    one.write.text(path)
    return spark.createDataFrame([(feeds.next_link(spark, path, "https://example.org"),)], "href string")


@query("catalog_expand", "SELECT category || '_' || y AS name, category, y AS year, y = 2026 AS incremental FROM (VALUES ('placsp_mayores', 2012), ('externos_mayores', 2016), ('placsp_menores', 2018), ('propios', 2022)) c(category, since), (SELECT CAST(unnest(range(2012, 2027)) AS INTEGER) AS y) WHERE y >= since")
def _(spark, d):
    return feeds.catalog(spark, 2026).select("name", "category", "year", "incremental")


@query("distinct_list_uris", "SELECT 'https://x/' || f AS uri, f AS file FROM (VALUES ('StatusCode.gc'), ('ContractCode.gc'), ('TenderResultCode-2.0.gc'), ('NUTS-2021.gc'), ('SyndicationTenderingProcessCode-2.07.gc')) t(f)")
def _(spark, d):
    return feeds.list_uris(entry_xml(spark, d))


def tender_page(spark, d):
    """(page_id, html): parts as tender pages, with values that follow from the key."""
    key, pct = F.col("p_partkey").cast("string"), F.pmod("p_partkey", F.lit(9)).cast("string")
    box = lambda *x: ["<div class='noremarca'>", *x, "</div>"]
    parts = [
        "<html><head><title>Pliego ", key, "</title><script>var x = '<h4>';</script></head><body><h3>Contrato Sujeto a regulación armonizada", *box(F.when(F.pmod("p_partkey", F.lit(2)) == 0, "Sí").otherwise("No")), "</h3>",
        "<ul><li><span>Directiva de aplicación</span>", *box("2014/", key), "</li><li><span>Plazo de Ejecución</span></li><ul><li>", *box(pct, " Mes(es)"), "</li></ul></ul>",
        "<div><a href='https://x/GetDocumentByIdServlet?", key, "'>Pliego ", key, "</a><a href='/y'>otro</a></div><ul><li><span>Descripción del procedimiento</span></li> abierto &amp; simple ", key, "</ul>",
        "<div><span>Condiciones especiales de ejecución de Contrato</span><ul><li>", *box("social"), *box("ambiental ", key), "</li></ul></div>",
        "<h4>Garantía Requerida Definitiva</h4><ul><li><span>Porcentaje</span>", *box(pct, ",5 %"), "</li><h5>Plazo de constitución</h5><ul><li>", *box("1", pct, " Día(s)"), "</li></ul></ul><h4>Garantía Requerida Complementaria</h4><ul><li><span>Porcentaje</span>", *box("1.000,", pct), "</li></ul>",
        "<h4>Requisitos de participación de los licitadores</h4><ul><li><span>Número de Empleados</span>", *box("mínimo ", pct), "</li><h5>Clasificación empresarial</h5><ul><li>", *box("C2"), "</li></ul><h5>Condiciones de admisión</h5><ul><li>Capacidad <b>", key, "</b></li><li>No prohibición</li></ul>",
        "<h5>Motivos de exclusión</h5><ul><li>", *box("-"), *box("Corrupción"), "</li></ul></ul><h4>Preparación de oferta</h4><ul><li><span>Sobre</span>", *box("A-", key), "<span>Tipo de Oferta</span>", *box("técnica"), "</li></ul><h4>Preparación de oferta</h4><ul><li><span>Sobre</span>", *box("B"), "</li></ul>",
        "<h5>Criterios de Adjudicación</h5><ul><ul><li>", *box("Precio ", key), "</li><ul><li><span>Subtipo Criterio</span> : Precio</li><li><span>Ponderación</span> : 6", pct, ",5</li></ul></ul></ul>",
        "<h4>Plazo de Validez de la Oferta</h4><ul><li>", *box("3 Mes(es)"), "</li></ul><h3>Apertura de Ofertas</h3>", *box("El día 0", pct, "/02/2024 a las 10:00"), "<h5>Lugar</h5><ul><li>", *box("Sala ", key), "</li></ul></body></html>",
    ]
    p = table(spark, d, "part").select("p_partkey")
    return p.repartition(max(1, -(-p.count() // TASK_PAGES))).select(F.col("p_partkey").cast("long").alias("page_id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("html"))


_K, _P = "CAST(p_partkey AS VARCHAR)", "CAST(p_partkey % 9 AS VARCHAR)"


@query("html_criteria", f"""SELECT CAST(p_partkey AS BIGINT) AS page_id, 'Pliego ' || {_K} AS title, 2 AS n_links, p_partkey % 2 = 0 AS regulacion_armonizada, '2014/' || {_K} AS directiva_aplicacion, {_P} || ' Mes(es)' AS plazo_ejecucion,
  'Pliego ' || {_K} || ' https://x/GetDocumentByIdServlet?' || {_K} AS pdf_links, 'abierto & simple ' || {_K} AS descripcion_procedimiento, 'social;ambiental ' || {_K} AS condiciones_especiales, (p_partkey % 9) + 0.5 AS garantia_definitiva_pct,
  CAST(10 + p_partkey % 9 AS INTEGER) AS garantia_plazo_dias, 1000 + (p_partkey % 9) / 10.0::DOUBLE AS garantia_complementaria_pct, CAST(p_partkey % 9 AS INTEGER) AS num_empleados_min, 'C2' AS clasificacion_empresarial, 'Capacidad ' || {_K} || ';No prohibición' AS condiciones_admision,
  'Corrupción' AS motivos_exclusion, 'A-' || {_K} || '/técnica;B/' AS sobres, 'Precio ' || {_K} || '/Precio/6' || {_P} || '.5' AS criterios_adjudicacion, '3 Mes(es)' AS plazo_validez_oferta, 'El día 0' || {_P} || '/02/2024 a las 10:00' AS apertura_fecha, 'Sala ' || {_K} AS apertura_lugar FROM part""")
def _(spark, d):
    joined = lambda c, sep, *fs: F.array_join(F.transform(c, lambda x: F.concat_ws(sep, *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fs])), ";").alias(c)
    out = html.criteria(tender_page(spark, d))
    lists = {c: F.array_join(c, ";").alias(c) for c in ("condiciones_especiales", "clasificacion_empresarial", "condiciones_admision", "motivos_exclusion")}
    lists |= {"pdf_links": joined("pdf_links", " ", "nombre", "url"), "sobres": joined("sobres", "/", "descripcion", "tipo"), "criterios_adjudicacion": joined("criterios_adjudicacion", "/", "nombre", "subtipo", "ponderacion")}
    return out.select(*[lists.get(c, F.col(c)) for c in out.columns])


@query("page_links", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title, CAST(len(regexp_extract_all(html, '<a href')) AS INTEGER) AS n_links FROM pages")
def _(spark, d):
    return html.criteria(table(spark, d, "pages")).select("page_id", F.col("title").isNotNull().alias("has_title"), "n_links")


@query("pdf_text", "SELECT item_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') || ' (1)' || chr(10) || chr(10) || 'page two' || chr(10) || chr(10) AS text FROM benchmark WHERE item_id % 5 <> 0")
def _(spark, d):
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj <</Length 9>> stream\nBT /F1 9 Tf ("), F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.lit(" \\(1\\)) Tj ET\nendstream endobj 2 0 obj <</Length 9>> stream\nBT [(page) -20 ( two)] TJ ET\nendstream endobj"))
    files = table(spark, d, "benchmark").select("item_id", F.when(F.pmod("item_id", F.lit(5)) == 0, F.lit("<html>")).otherwise(body).cast("binary").alias("content"))
    return pdf.pdf_text(files)


@query("scan_regions", "SELECT 'ES' || n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey < 2")
def _(spark, d):
    path = workspace(spark, "geo")
    code = F.concat(F.when(F.col("n_regionkey") < 2, "ES").otherwise("FR"), F.col("n_nationkey").cast("string"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(code.alias("NUTS_ID"), F.col("n_name").alias("NAME_LATN")).alias("properties"), F.struct(F.lit("Point").alias("type")).alias("geometry"))
    table(spark, d, "nation").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)  # 25 features
    return geo.regions(spark, path)


@query("codelist_json", "SELECT 'status.gc' AS list_file, '{' || string_agg('\"' || l_linestatus || '\":\"' || n || '\"', ',' ORDER BY l_linestatus) || '}' AS json FROM (SELECT l_linestatus, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY l_linestatus)")
def _(spark, d):
    codes = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("code")).agg(F.count("*").cast("string").alias("label"))
    return feeds.codelist_json(codes.withColumn("list_file", F.lit("status.gc")))


@query("stream_daily", f"""WITH {VERSIONS}, gone AS (SELECT DISTINCT sid FROM versions WHERE tombstone) SELECT sid, max(updated) AS updated, max_by(status_code, (updated, pos)) AS status_code FROM versions WHERE NOT tombstone AND sid NOT IN (SELECT sid FROM gone) GROUP BY sid""")
def _(spark, d):
    from almoneda.streaming.daily import run_stream

    land, store = workspace(spark, "landing"), SnapshotStore(spark, workspace(spark, "store"))
    v = versions(spark, d)
    v.repartition(max(1, -(-v.count() // LANDED_ROWS))).write.parquet(land)
    run_stream(spark.readStream.schema(v.schema).parquet(land), store, workspace(spark, "stream"))
    return store.read().select("sid", "updated", "status_code")


@query("stream_latest", f"""WITH {VERSIONS}, e AS (SELECT * FROM versions WHERE NOT tombstone AND sid NOT IN (SELECT sid FROM versions WHERE tombstone)),
h AS (SELECT sid, string_agg(x, '|' ORDER BY x) AS history FROM (SELECT DISTINCT sid, substr(updated, 1, 10) || ' ' || status_code AS x FROM e) GROUP BY sid)
SELECT sid, max(updated) AS updated, max_by(status_code, (updated, pos)) AS status_code, max_by(pos, (updated, pos)) AS pos, any_value(history) AS history FROM e JOIN h USING (sid) GROUP BY sid""")
def _(spark, d):
    """Versions in three files, dealt without regard to time, a file a micro-batch: many come late."""
    from almoneda.streaming.latest import VERSION, keep_latest

    land, store = workspace(spark, "landing"), SnapshotStore(spark, workspace(spark, "store"))
    v = versions(spark, d).withColumn("payload", F.col("amount").cast("string")).select("sid", "updated", "status_code", "pos", "tombstone", "payload")
    v.repartitionByRange(3, F.xxhash64("pos")).write.parquet(land)
    keep_latest(spark.readStream.schema(VERSION).option("maxFilesPerTrigger", 1).parquet(land), store, workspace(spark, "stream"))
    return store.read().select("sid", "updated", "status_code", "pos", "history")


@query("stream_feed", """SELECT CAST(o_orderkey AS VARCHAR) AS sid, o_orderstatus AS status_code, CAST(CASE WHEN o_orderkey % 8 = 7 THEN 2 ELSE 1 END AS INTEGER) AS run
  FROM orders WHERE o_orderkey % 100 <> 0""")
def _(spark, d):
    """Linked pages of all orders, in eight groups. A first run meets seven of them; a second one, from its checkpoint, the
    eighth alone."""
    from almoneda import ingest
    from almoneda.sources import feed_stream

    feed_stream.register(spark)
    store, home = SnapshotStore(spark, workspace(spark, "store")), workspace(spark, "web")
    runs = []
    for run, groups in ((1, range(7)), (2, [7])):
        newest, n_pages = feed_stream_pages(spark, d, home, groups)
        stream = spark.readStream.format("feed").options(category="test", remember=f"{home}/remember", most=str(n_pages + 1)).load(newest)

        def put(rows, n, run=run):
            runs.append((run, n))
            ingest.apply(store, feed_stream.versions(rows).withColumn("run", F.lit(run)), f"run{run}-{n}")

        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read().select("sid", "status_code", "run")


def feed_stream_pages(spark, d, home, groups, entries=FILE_ENTRIES):
    """(the newest of the pages of all groups up to these, how many there are): pages of orders by group, each with its time
    and the link to the one before it."""
    o, parts = _dealt(spark, d, entries)
    o = o.filter(F.col("file").isin(*groups)).withColumn("page", F.col("file") * parts + F.col("part")).drop("file", "part")
    first, end = min(groups) * parts, (max(groups) + 1) * parts
    # A page that no order falls to is left out, and the next one links to the one before it.
    there = [r[0] for r in o.select("page").distinct().orderBy("page").collect()]
    before = dict(zip(there, [first - 1, *there]))
    link = lambda p: f'<link rel="next" href="{home}/page={p}/page.atom.gz"/>' if p >= 0 else ""
    links = F.create_map(*[F.lit(x) for p in there for x in (p, link(before[p]))])
    time = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01"), "yyyy-MM-dd") + F.col("page")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = _documents(spark, o, ["page"], len(there), F.concat(F.lit("<feed><updated>"), time, F.lit("</updated>"), F.try_element_at(links, F.col("page"))), F.concat(_gone(), _entry()), workspace(spark, "page"))
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    system = fs.Path(made).getFileSystem(conf)
    for p in there:
        part = next(x.getPath() for x in system.listStatus(fs.Path(f"{made}/page={p}")) if x.getPath().getName().startswith("part-"))
        system.mkdirs(fs.Path(f"{home}/page={p}"))
        system.rename(part, fs.Path(f"{home}/page={p}/page.atom.gz"))
    system.mkdirs(fs.Path(f"{home}/head"))
    fs.FileUtil.copy(system, fs.Path(f"{home}/page={there[-1]}/page.atom.gz"), system, fs.Path(f"{home}/head/page.atom.gz"), False, True, conf)  # the newest also has a name of its own
    return f"{home}/head/page.atom.gz", end


@query("ext_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from almoneda.streaming.daily import event_windows

    return event_windows(table(spark, d, "events"))
