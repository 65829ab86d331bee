"""A Spark data source of document pages: `spark.read.format("document_pages")`.

Files are never rows: a row is a page. Small files share a partition up to PART bytes; a larger one is cut into parts of
about PART bytes, each its share of the file's pages, so one long document is read by many tasks. The driver lists names
and sizes only. `opener` (an option, "module:function", or an argument of `document_pages`) opens a file by its path and
gives its pages as a sequence of texts: len() and [k], which may raise for a page. Paths are those of a folder that all
executors see; for files in a store that only Spark reads, use `pdf.read_pages`, which gives the same
rows, but for empty files: Spark leaves these out, and here they are told as errors.
"""

from __future__ import annotations

import glob
import importlib
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .pdf import SCHEMA, _text_or_error

PART = 8 << 20
OPENER = "inkdiff.sources.pdf:open_plain_pdf"


@dataclass
class Part(InputPartition):
    """Files, or with `of` > 1 the k-th of so many parts of one file."""

    paths: list[str]
    k: int = 0
    of: int = 1


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "")
        self.version = options.get("version", "")
        self.part = int(options.get("partbytes", PART))
        self.opener = options.get("opener", OPENER)

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        held, size = [], 0
        for path, n in _files(self.path):
            if n > self.part:
                parts = -(-n // self.part)
                out += [Part([path], k, parts) for k in range(parts)]
                continue
            if held and size + n > self.part:
                out.append(Part(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Part(held)] if held else out

    def read(self, partition: Part) -> Iterator[tuple]:
        module, _, name = self.opener.partition(":")
        opener = getattr(importlib.import_module(module), name)
        for path in partition.paths:
            yield from _rows(opener, path, self.version, partition.k, partition.of)


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files of a folder, a file itself, or those that a pattern fits."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        found = [e.path for e in os.scandir(path) if e.is_file() and not e.name.startswith((".", "_"))]
    else:
        found = [path] if os.path.exists(path) else glob.glob(path)
        if not found:
            raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
    return [(p, os.path.getsize(p)) for p in sorted(found)]


def _rows(opener: Callable[[str], Sequence[str]], path: str, version: str, k: int, of: int) -> Iterator[tuple]:
    name = os.path.basename(path)
    document = name.rsplit(".", 1)[0] if "." in name else name
    try:
        pages = opener(path)
        n = len(pages)
    except Exception as error:  # whatever a damaged file makes the opener raise, told once
        if k == 0:
            yield document, name, version, None, "", True, [str(error)]
        return
    for i in range(n * k // of, n * (k + 1) // of):
        text = _text_or_error(pages, i)
        failed = isinstance(text, Exception)
        yield document, name, version, i + 1, "" if failed else text, failed, [f"Page {i + 1}: failed to extract text — {text}"] if failed else []


class DocumentPages(DataSource):
    """Options: path, version, opener, partbytes."""

    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def document_pages(spark: SparkSession, path: str, opener: str = OPENER, version: str = "", part_bytes: int = PART) -> DataFrame:
    """A row for each page of the files under path, as `pdf.read_pages` gives them; the order of rows is not fixed."""
    spark.dataSource.register(DocumentPages)
    return spark.read.format("document_pages").option("opener", opener).option("version", version).option("partbytes", part_bytes).load(path)
