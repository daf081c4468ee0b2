"""Spreadsheets and line files: XLSX as a PySpark data source, rosters and label sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet, each cell where its reference puts it."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        name = min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
        for row in ElementTree.fromstring(book.read(name)).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                at = 0
                for ch in re.match("[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(ch) - 64
                value = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else None if value is None else value.text
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                at = at or len(cells) + 1
                cells += [None] * (at - len(cells))
                cells[at - 1] = text
            yield cells


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        files = [root] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".xlsx"))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition):
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.value) as f:
            for i, cells in enumerate(xlsx_rows(f.read())):
                yield partition.value.rpartition("/")[2], i, cells


class XlsxSource(DataSource):
    """Rows (file, row, cells) of the first sheet of each workbook under a path, a file a partition."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "file string, row int, cells array<string>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").option("path", path).load()


def roster(lines: DataFrame) -> DataFrame:
    """hub, priority, name, aliases, status and note of roster lines; lines with # and blank ones are comments, commas too many are the note's."""
    p = F.split("value", ",", 6)
    at = lambda i: F.trim(F.coalesce(F.get(p, F.lit(i)), F.lit("")))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)"))
    aliases = F.filter(F.transform(F.split(at(3), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(at(0).alias("hub"), at(1).alias("priority"), at(2).alias("name"), aliases.alias("aliases"), at(4).alias("status"), at(5).alias("note")).where("hub <> 'hub'")


def label_cell(value, legacy: dict[str, str] | None = None):
    """A label as written, for comparison: trimmed, lower case, inner space as underscore, legacy names replaced; empty is null."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")
    for a, b in (legacy or {}).items():
        v = F.when(v == a, b).otherwise(v)
    return F.nullif(v, F.lit(""))
