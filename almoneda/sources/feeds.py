"""Readers of syndication feeds, code lists and archives."""

from __future__ import annotations

import hashlib
import io
import re
import tempfile
import urllib.request
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almoneda import schema
from almoneda.functions.scalar import last_segment

#: Feed channels: name, number, file stem, first year. Fixed values.
CHANNELS = (
    ("placsp_mayores", 643, "licitacionesPerfilesContratanteCompleto3", 2012), ("externos_mayores", 1044, "PlataformasAgregadasSinMenores", 2016),
    ("placsp_menores", 1143, "contratosMenoresPerfilesContratantes", 2018), ("propios", 1383, "EMP_SectorPublico", 2022),
)


def _xml(spark: SparkSession, path: str | list[str], tag: str, ddl: str) -> DataFrame:
    """The elements of a name in files, those of folders within included. A task reads a file as a whole."""
    return spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", tag).option("ignoreNamespace", "true").schema(ddl).load(path)


#: A file's place among those of a read, where its split begins, and the row's place in the split.
ARRIVAL = "struct<page:string,block:bigint,place:bigint>"


def arrival(spark: SparkSession, path: str | list[str]) -> Column:
    """The order in which rows of files arrive, as a struct that sorts so: files of a list as listed, those of a folder by
    path, rows of a file as they stand in it, however Spark packs files and splits into tasks.

    Within a split Spark numbers rows as it reads them; the number's upper part is the task's and says nothing, so it
    comes last, after what tells splits apart.
    """
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    page = file
    if not isinstance(path, str):
        hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        if len(path) > 1000:
            raise ValueError("more than 1,000 files: put them into a folder, in order of their paths")
        full = [re.sub("^file:/+", "file:/", (p := hadoop(x)).getFileSystem(conf).makeQualified(p).toUri().toString()) for x in path]
        place = F.create_map(*[F.lit(x) for i, p in enumerate(full) for x in (p, f"{i:09d}")])
        # what isn't listed itself lies in a listed folder: it comes with that folder, by path
        inside = [F.when(F.startswith(file, F.lit(f"{p.rstrip('/')}/")), F.concat(F.lit(f"{i:09d}/"), file)) for i, p in enumerate(full)]
        page = F.coalesce(F.try_element_at(place, file), *inside, file)
    return F.struct(page.alias("page"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def entries(spark: SparkSession, path: str | list[str], category: str) -> DataFrame:
    """(sid, updated, link, status, category, file, pos): the entries of feed files; pos orders them by arrival."""
    e = _xml(spark, path, "entry", schema.ENTRY)
    return e.select(
        last_segment("id").alias("sid"), "updated", F.get("link", F.lit(0))["_href"].alias("link"), F.col("ContractFolderStatus").alias("status"), F.lit(category).alias("category"),
        F.col("_metadata.file_path").alias("file"), arrival(spark, path).alias("pos"),
    )


def tombstones(spark: SparkSession, path: str | list[str], category: str) -> DataFrame:
    """(sid, when, reason, category): entries that feeds declare deleted."""
    t = _xml(spark, path, "deleted-entry", schema.TOMBSTONE)
    return t.select(last_segment("_ref").alias("sid"), F.col("_when").alias("when"), F.col("comment._type").alias("reason"), F.lit(category).alias("category"))


def next_link(spark: SparkSession, path: str, host: str | None = None) -> str | None:
    """The feed's own link to its next page: of the links before the first entry, the one with rel=next."""
    head = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)^(.*?)(?:<(?:\w+:)?entry[\s>]|$)", 1).alias("head"))
    tag = F.regexp_extract("head", r"(?s)<(?:\w+:)?link\b[^>]*\brel\s*=\s*[\"']next[\"'][^>]*>", 0)
    row = head.select(F.nullif(F.regexp_extract(tag, r"\bhref\s*=\s*[\"']([^\"']+)", 1), F.lit("")).alias("href")).first()
    href = row["href"].replace("&amp;", "&") if row and row["href"] else None
    return re.sub(r"^https?://(?:www\.)?contrataciondelestado\.es", host, href) if href and host else href


def codelist(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(list_file, code, label): rows of genericode files; the label is the Spanish name, else the name, else the code.

    Of rows with one code the last in the file holds.
    """
    r = _xml(spark, path, "Row", schema.CODELIST_ROW).select("Value", last_segment(F.col("_metadata.file_path")).alias("list_file"), arrival(spark, path).alias("pos"))
    value = lambda name: F.nullif(F.trim(F.get(F.filter("Value", lambda v: v["_ColumnRef"] == name), F.lit(0))["SimpleValue"]), F.lit(""))
    named = r.select("list_file", value("code").alias("code"), F.coalesce(value("nombre"), value("name"), value("code")).alias("label"), "pos").filter("code IS NOT NULL")
    return named.groupBy("list_file", "code").agg(F.max_by("label", "pos").alias("label"))


def codelist_json(codes: DataFrame) -> DataFrame:
    """(list_file, json): each code list as one JSON object, codes in order. A list is a few thousand codes."""
    entries = F.sort_array(F.collect_list(F.struct("code", "label")))
    return codes.groupBy("list_file").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def fetched_members(spark: SparkSession, urls: list[str], fetch: Callable[[str], bytes] | None = None, suffix: str = ".atom") -> DataFrame:
    """(archive, number, name, content, digest) as zip_members, of archives over HTTP: a task downloads each to its own disk,
    so no archive passes through the driver. digest: SHA-256 of the archive."""

    def run(frames):
        for pdf in frames:
            for url in pdf["url"]:
                with tempfile.TemporaryFile() as f:
                    digest = hashlib.sha256()
                    with io.BytesIO(fetch(url)) if fetch else _opened(url, 600) as source:
                        while part := source.read(1 << 20):
                            digest.update(part)
                            f.write(part)
                    with zipfile.ZipFile(f) as z:
                        for number, name in enumerate(sorted(n for n in z.namelist() if n.endswith(suffix))):
                            yield pd.DataFrame({"archive": [url], "number": [number], "name": [name], "content": [z.read(name).decode("utf-8", "replace")], "digest": [digest.hexdigest()]})

    asked = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)))
    return asked.mapInPandas(run, "archive string, number int, name string, content string, digest string")


def unpacked(members: DataFrame, folder: str) -> str:
    """The members of archives, each a file of its own below `folder`, whose paths are in the order of archive and name."""
    members = members.select(last_segment("archive").alias("archive"), F.lpad(F.col("number").cast("string"), 9, "0").alias("member"), F.col("content").alias("value"))
    members.repartition("archive", "member").write.partitionBy("archive", "member").text(folder)
    return folder


def list_uris(xml_texts: DataFrame, column: str = "xml") -> DataFrame:
    """(uri, file): the distinct code list addresses that entries name, over HTTPS."""
    found = F.explode(F.regexp_extract_all(column, F.lit(r"\blistURI(?:ID)?\s*=\s*\"([^\"]+)\""), F.lit(1)))
    uri = xml_texts.select(found.alias("u")).select(F.regexp_replace("u", "^http:", "https:").alias("uri")).distinct()
    return uri.select("uri", last_segment("uri").alias("file"))


def zip_members(spark: SparkSession, path: str, suffix: str = ".atom") -> DataFrame:
    """(archive, number, name, content): the members of ZIP files with a suffix, numbered by name; each archive is opened
    by one task."""

    def run(frames):
        for pdf in frames:
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for number, name in enumerate(sorted(n for n in z.namelist() if n.endswith(suffix))):
                        yield pd.DataFrame({"archive": [archive], "number": [number], "name": [name], "content": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, number int, name string, content string")


#: Where the feeds are. Fixed value.
BASE = "https://contrataciondelsectorpublico.gob.es/sindicacion"


def head_url(category: str, base: str = BASE) -> str:
    """The newest page of a channel."""
    number, stem = next((n, s) for c, n, s, _ in CHANNELS if c == category)
    return f"{base}/sindicacion_{number}/{stem}.atom"


def catalog(spark: SparkSession, year: int, base: str = BASE) -> DataFrame:
    """(name, category, url, year, incremental): a feed for each channel and year, the running one incremental."""
    rows = spark.createDataFrame([(*c,) for c in CHANNELS], "category string, number int, stem string, since int")
    out = rows.filter(F.col("since") <= year).select("category", "number", "stem", F.explode(F.sequence(F.col("since"), F.lit(year))).alias("year"))
    return out.select(
        F.format_string("%s_%d", "category", "year").alias("name"), "category", F.format_string(f"{base}/sindicacion_%d/%s_%d.zip", "number", "stem", "year").alias("url"), "year", (F.col("year") == year).alias("incremental"),
    )


def download(url: str, fetch: Callable[[str], bytes] | None = None, timeout: float = 600) -> bytes:
    """A file over HTTP, redirects followed and certificates checked; `fetch` stands in for the network in tests."""
    if fetch:
        return fetch(url)
    with _opened(url, timeout) as r:
        return r.read()


def _opened(url: str, timeout: float):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "almoneda/0.1"}), timeout=timeout)  # noqa: S310
