"""Office files as a Spark data source, and documents written as office files.

``spark.read.format("clauselake_office").load(path)`` gives the blocks of all docx and xlsx
files below a folder. Partitions are made by bytes. A file that is of no such format, or is
broken, is one row with an error and stops no other.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .formats import BLOCK, _docx_rows, _xlsx_rows

NAME = "clauselake_office"
SCHEMA = f"path string, {BLOCK}, error string"
# Fixed value: the code of a file that is not of a format taken in.
REFUSED = "E101"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _rows(data: bytes) -> list[tuple]:
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    if any(n.startswith("word/") for n in names):
        return _docx_rows(data)
    if any(n.startswith("xl/") for n in names):
        return _xlsx_rows(data)
    raise KeyError("neither a document nor a workbook")


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("partitionBytes", str(64 << 20)))

    def partitions(self) -> list[_Files]:
        """Files in the order of their paths, in runs of about ``partitionBytes``."""
        system, path = _open(self.path)
        found = sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        runs, size = [], 0
        for file in found:
            if not runs or size + file.size > self.most:
                runs.append([])
                size = 0
            runs[-1].append(file.path)
            size += file.size
        return [_Files(r) for r in runs]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as file:
                data = file.read()
            try:
                rows = [(path, *row, None) for row in _rows(data)]
            except (KeyError, IndexError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                rows = [(path, 0, None, None, None, None, REFUSED)]
            yield from rows


class OfficeSource(DataSource):
    """Options: path, a folder; partitionBytes, about how many bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_office(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """(path, idx, kind, text, page, style, error) of the office files below ``path``."""
    spark.dataSource.register(OfficeSource)
    return spark.read.format(NAME).option("partitionBytes", str(partition_bytes)).load(path)


# ------------------------------------------------------------------------------- writing

_SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
#: Characters that XML cannot hold, and the carriage return, which it reads as a line feed.
_UNFIT = dict.fromkeys([*range(9), 0x0B, 0x0C, 0x0D, *range(0x0E, 0x20), *range(0xD800, 0xE000), 0xFFFE, 0xFFFF])


def as_docx(blocks: list[tuple[str, str]]) -> bytes:
    """A document of blocks (kind, text): headings, texts, and tables as lines of cells parted by tabs."""

    def said(text: str) -> str:
        return f'<w:r><w:t xml:space="preserve">{escape(text.translate(_UNFIT))}</w:t></w:r>'

    def block(kind: str, text: str) -> str:
        if kind == "table":
            rows = ["".join(f"<w:tc><w:p>{said(c)}</w:p></w:tc>" for c in line.split("\t")) for line in text.split("\n")]
            return "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
        style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if kind == "heading" else ""
        return f"<w:p>{style}{said(text)}</w:p>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_SPACE}><w:body>{"".join(block(k, t) for k, t in blocks)}</w:body></w:document>')
    return out.getvalue()


def write_docx(docs: DataFrame, path: str) -> DataFrame:
    """Writes a docx for each row (name, blocks array<struct<kind,text>>) under ``path``; returns (name, bytes) as written.

    A name is written again if its task is run again. Rows with null blocks become files
    that no reader takes.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            sizes = []
            for name, blocks in batch[["name", "blocks"]].itertuples(index=False):
                data = b"PK\x03\x04" if blocks is None else as_docx([(b["kind"], b["text"]) for b in blocks])
                with system.open_output_stream(f"{folder}/{name}") as file:
                    file.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"name": batch["name"], "bytes": sizes})

    return docs.select("name", F.col("blocks")).mapInPandas(write, "name string, bytes long")
