"""Feeds as a streaming source: pages that name the next older one, from the newest down to what has been read.

An offset holds the newest time read and the pages of its batch with their times. A batch reads those of its pages that are newer
than where it starts, so a restart goes on where the last batch ended and a batch that is repeated reads the same pages. The
driver reads the beginning of each new page alone (its time and its next link); the pages themselves are read by executors, a
task each, and parsed by Spark.
"""

from __future__ import annotations

import codecs
import gzip
import json
import re
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from almoneda import extract, schema
from almoneda.functions.scalar import last_segment

ROW = "category string, page string, page_updated string, place int, kind string, xml string"
_BEGINS = re.compile(r"<((?:[\w.-]+:)?(entry|deleted-entry))[\s>/]")
_TIME = re.compile(r"<(?:[\w.-]+:)?updated\s*>\s*([^<]*?)\s*<")
_LINK = re.compile(r"<(?:[\w.-]+:)?link\b[^>]*>")
#: Bytes of a page read at a time while looking for its first entry.
STEP = 16_384
#: Characters of entries that a task hands over at a time.
BATCH = 4 << 20


def _open(url: str, timeout: float):
    """A page; a file whose name ends in .gz is unpacked as it is read (by Arrow where it opens it)."""
    if re.match(r"https?://", url):
        return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "almoneda/0.1"}), timeout=timeout)  # noqa: S310
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return gzip.open(url) if url.endswith(".gz") else open(url, "rb")
    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", url))
    return system.open_input_stream(path)


def _create(url: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url if "://" in url else "file:///" + re.sub("^(file:)?/+", "", url))
    return system.open_output_stream(path)


def head(url: str, timeout: float = 600) -> tuple[str | None, str | None]:
    """(time, next page) of a page, from what stands before its first entry; the rest isn't read."""
    text = b""
    with _open(url, timeout) as f:
        while more := f.read(STEP):
            text += more
            if _BEGINS.search(text.decode("utf-8", "replace")):
                break
    plain = text.decode("utf-8", "replace")
    first = _BEGINS.search(plain)
    plain = plain[: first.start()] if first else plain
    time = _TIME.search(plain)
    for link in _LINK.findall(plain):
        if re.search(r"\brel\s*=\s*[\"']next[\"']", link) and (href := re.search(r"\bhref\s*=\s*[\"']([^\"']+)", link)):
            return time and time[1], href[1].replace("&amp;", "&")
    return time and time[1], None


def _end(text: str, begin: re.Match) -> int:
    """Where an element ends of which the beginning was found; 0 if that isn't in the text."""
    head = text.find(">", begin.end(1))
    if head > 0 and text[head - 1] == "/":
        return head + 1
    tail = re.compile(rf"</{re.escape(begin[1])}\s*>").search(text, begin.end(1))
    return tail.end() if tail else 0


def parts(text: str) -> Iterator[tuple[str, str]]:
    """(kind, XML) of the entries and deleted entries of a page, in order."""
    at = 0
    while begin := _BEGINS.search(text, at):
        end = _end(text, begin)
        if end:
            yield begin[2], text[begin.start() : end]
        at = end or begin.end()


def parts_read(f, step: int = 1 << 20) -> Iterator[tuple[str, str]]:
    """parts(...) of an open page, of which only what isn't complete yet is held."""
    decoder, text, more = codecs.getincrementaldecoder("utf-8")("replace"), "", b"x"
    while more:
        more = f.read(step)
        text += decoder.decode(more, final=not more)
        at = 0
        while begin := _BEGINS.search(text, at):
            end = _end(text, begin)
            if end:
                yield begin[2], text[begin.start() : end]
            elif more:
                break  # it ends further on
            at = end or begin.end()
        text = text[begin.start() if begin else max(at, text.rfind("<")) :]


class Page(InputPartition):
    def __init__(self, url: str, updated: str | None):
        self.url, self.updated = url, updated


class FeedReader(DataSourceStreamReader):
    """Offsets are {"updated": the newest page's time, "batch": [[url, time], ...] oldest first}.

    Options: path, the newest page; category; most, pages of a walk; timeout; remember, a file in the shared folder that keeps
    the last offset, so that a restart needn't walk down to the oldest page again (without it only beginnings are read again).
    """

    def __init__(self, options: dict):
        self.first, self.category, self.remember = options["path"], options.get("category", ""), options.get("remember")
        self.most, self.timeout = int(options.get("most", 1000)), float(options.get("timeout", 600))
        self.at = self._remembered() or self.initialOffset()

    def _remembered(self) -> dict | None:
        if not self.remember:
            return None
        try:
            with _open(self.remember, self.timeout) as f:
                return json.loads(f.read())
        except (OSError, ValueError):
            return None

    def initialOffset(self) -> dict:
        return {"updated": None, "batch": []}

    def latestOffset(self) -> dict:
        """The pages that are newer than the last offset, by walking from the newest; the last offset if there are none."""
        found, url, seen = [], self.first, set()
        while url and url not in seen and len(found) < self.most:
            seen.add(url)
            time, following = head(url, self.timeout)
            if self.at["updated"] and time and time <= self.at["updated"]:
                break
            found.append([url, time])
            url = following
        if not found or (not any(t for _, t in found) and found[::-1] == self.at["batch"]):
            return self.at
        self.at = {"updated": max([t for _, t in found if t] + [self.at["updated"] or ""]) or None, "batch": found[::-1]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """A task a page; a page without a time counts as read if the last batch had it."""
        old = {tuple(x) for x in start["batch"]}
        return [Page(url, time) for url, time in end["batch"] if (url, time) not in old and (not time or not start["updated"] or time > start["updated"])]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        def batch(place: int, rows: list[tuple[str, str]]) -> pa.RecordBatch:
            n, same = len(rows), lambda x: pa.repeat(pa.scalar(x, pa.string()), len(rows))
            kinds, xml = zip(*rows)
            columns = [same(self.category), same(page.url), same(page.updated), pa.array(range(place, place + n), pa.int32()), pa.array(kinds, pa.string()), pa.array(xml, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROW.split(", ")])

        with _open(page.url, self.timeout) as f:
            place, held, size = 0, [], 0
            for kind, xml in parts_read(f):
                held.append((kind, xml))
                size += len(xml)
                if size >= BATCH:
                    yield batch(place, held)
                    place, held, size = place + len(held), [], 0
            if held:
                yield batch(place, held)

    def commit(self, end: dict) -> None:
        if self.remember:
            with _create(self.remember) as f:
                f.write(json.dumps(end).encode())


class FeedSource(DataSource):
    """spark.readStream.format("feed").option("category", ...).load(newest page): rows of ROW."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return ROW

    def streamReader(self, schema) -> FeedReader:  # noqa: ARG002
        return FeedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)


def versions(rows: DataFrame) -> DataFrame:
    """Versions of notices, as ingest.apply takes them, of rows of a feed. pos orders them by the page's time and place.

    Pages are read once and an entry is parsed once: as the element of an array, since Spark would repeat the parser in a filter.
    """
    pos = F.struct(F.concat_ws(" ", F.coalesce("page_updated", F.lit("")), "page").alias("page"), F.lit(0).cast("long").alias("block"), F.col("place").cast("long").alias("place")).alias("pos")
    dead = F.col("kind") == "deleted-entry"
    e = F.explode(F.array(F.when(~dead, F.from_xml("xml", schema.ENTRY_STRUCT, {"ignoreNamespace": "true"}))))
    attribute = lambda name: F.when(dead, F.nullif(F.regexp_extract("xml", rf"^<[^>]*?\s{name}\s*=\s*[\"']([^\"']*)", 1), F.lit("")))
    read = rows.select("category", pos, dead.alias("tombstone"), attribute("ref").alias("ref"), attribute("when").alias("when"), e.alias("e"))
    either = lambda gone, there: F.when(F.col("tombstone"), gone).otherwise(there)
    out = extract.contracts(read.select(
        either(last_segment("ref"), last_segment("e.id")).alias("sid"), either(F.col("when"), F.col("e.updated")).alias("updated"), F.get("e.link", F.lit(0))["_href"].alias("link"), F.col("e.ContractFolderStatus").alias("status"), "category", "pos", "tombstone",
    ))
    known = ("sid", "updated", "category", "pos", "tombstone")  # all that a tombstone says
    return out.select(*[c if c in known else F.when(~F.col("tombstone"), F.col(c)).alias(c) for c in out.columns])
