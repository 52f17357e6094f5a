"""Text of PDF files. The provider that reads a file is a parameter; the one here reads plain and deflated text streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STREAM = re.compile(rb"<<((?:[^>]|>(?!>))*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")|(T\*|Td|TD|ET)", re.S)
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
#: Escapes in strings of the format. Fixed values.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(s: bytes) -> bytes:
    return re.sub(rb"\\(\d{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


def pages_of(content: bytes) -> list[str]:
    """The text of each content stream that shows text, in file order."""
    out = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        parts = []
        for array, single, move in _SHOWN.findall(body):
            parts.append(b"\n" if move else b"".join(_plain(x) for x in _STRING.findall(array or single)))
        text = b"".join(parts).decode("cp1252", "replace").strip("\n")
        if text:
            out.append(text)
    return out


def read_text(content: bytes) -> str:
    """Pages with a blank line after each; empty if the file can't be read."""
    return "".join(f"{p}\n\n" for p in pages_of(content))


def pdf_text(files: DataFrame, provider: Callable[[bytes], str] = read_text, content: str = "content", content_type: str | None = None) -> DataFrame:
    """The rows of files that are PDFs, by their type or their first bytes, with `text` instead of the content."""
    is_pdf = F.instr(F.substring(content, 1, 5).cast("string"), "%PDF") > 0
    if content_type:
        is_pdf = is_pdf | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))
    rest = [c for c in files.columns if c != content]
    schema = files.select(*rest).schema.add("text", "string")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 20):
                p = batch.slice(i, 20)
                texts = [provider(x.as_py() or b"") for x in p.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*p.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return files.filter(F.coalesce(is_pdf, F.lit(False))).select(*rest, content).mapInArrow(run, schema)
