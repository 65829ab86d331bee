"""Page text of PDF files. The reader of the bytes is a parameter; the one here understands plain, uncomplicated files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The texts of a file's pages in order; in the place of a page that cannot be read, the error that it raised.
Extractor = Callable[[bytes], "list[str | Exception]"]
SCHEMA = "document_id string, document_name string, version string, page_number int, original_text string, ocr_warning boolean, errors array<string>"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)|T\*|\bT[dD]\b|'|\bTj\b|\bTJ\b|\bET\b", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_CHARACTER = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}


class PlainPdf:
    """The pages of a file in the order of their objects, for literal strings and flate or no compression: len() and [k]."""

    def __init__(self, content: bytes) -> None:
        if not content.startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        self._objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        self._pages = [body for body in self._objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", body)]

    def __len__(self) -> int:
        return len(self._pages)

    def __getitem__(self, k: int) -> str:
        held = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", self._pages[k])
        ids = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", held[1])] if held else []
        return "\n".join(_shown(self._objects.get(i, b"")) for i in ids)


def open_plain_pdf(path: str) -> PlainPdf:
    with open(path, "rb") as f:
        return PlainPdf(f.read())


def plain_pdf_pages(content: bytes) -> list[str | Exception]:
    """Texts of the pages; in the place of one that cannot be read, what it raised."""
    pages = PlainPdf(content)
    return [_text_or_error(pages, k) for k in range(len(pages))]


def _text_or_error(pages: Sequence[str], k: int) -> str | Exception:
    try:
        return pages[k]
    except Exception as error:  # whatever a damaged stream raises: the other pages are still read
        return error


def _shown(body: bytes) -> str:
    found = _STREAM.search(body)
    if not found:
        return ""
    stream = zlib.decompress(found[1]) if b"FlateDecode" in body else found[1]
    out, line = [], b""
    for m in _SHOW.finditer(stream):
        if m[0].startswith(b"("):
            line += _ESCAPE.sub(lambda e: _CHARACTER.get(e[1], b"") or (bytes([int(e[1], 8) & 255]) if e[1].isdigit() else b""), m[0][1:-1])
        elif m[0] in (b"T*", b"Td", b"TD", b"'", b"ET") and line:
            out.append(line)
            line = b""
    return "\n".join(x.decode("cp1252", "replace") for x in [*out, line] if x)


def read_pages(spark: SparkSession, path: str, extractor: Extractor = plain_pdf_pages, version: str = "") -> DataFrame:
    """A row for each page of the files under path (which must exist): its number from 1, its text, and the file's errors.

    A page that cannot be read is an empty one with an error and a warning. A file that cannot be opened gives one row
    with an error and no page number.
    """
    kind = pa.list_(pa.struct([("n", pa.int32()), ("t", pa.string()), ("e", pa.string())]))

    def extract(contents: pa.Array) -> pa.Array:
        out = []
        for x in contents:
            try:
                read = enumerate(extractor(x.as_py()), 1)
                out.append([{"n": k, "t": "", "e": f"Page {k}: failed to extract text — {t}"} if isinstance(t, Exception) else {"n": k, "t": t, "e": None} for k, t in read])
            except Exception as error:  # whatever a damaged file makes the extractor raise
                out.append([{"n": None, "t": "", "e": str(error)}])
        return pa.array(out, kind)

    files = spark.read.format("binaryFile").load(path)
    pages = files.select("path", F.explode(F.arrow_udf(extract, "array<struct<n: int, t: string, e: string>>").asNondeterministic()("content")).alias("p"))
    name = F.substring_index("path", "/", -1)
    return pages.select(
        F.regexp_replace(name, r"\.[^.]*\z", "").alias("document_id"), name.alias("document_name"), F.lit(version).alias("version"), F.col("p.n").alias("page_number"), F.col("p.t").alias("original_text"),
        F.col("p.e").isNotNull().alias("ocr_warning"), F.array_compact(F.array("p.e")).alias("errors"),
    )
