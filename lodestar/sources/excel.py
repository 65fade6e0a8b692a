"""Excel sheets, read by Spark as binary files and unpacked in its tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch.
BATCH = 1000
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes, sheet: int = 0) -> Iterator[list[str | None]]:
    """The cells of each row as text, in column order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for row in ElementTree.fromstring(z.read(sheets[sheet])).iterfind(".//m:row", NS):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.findall("m:c", NS)):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else i
                value = c.findtext("m:v", None, NS)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
                cells[at] = value
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_excel(spark: SparkSession, path: str, sheet: str = "0") -> DataFrame:
    """The first row names the columns; numbers are cast where all values of a column are numbers."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = enumerate(sheet_rows(content.as_py(), int(sheet)))
                while part := list(islice(rows, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int32()), pa.array([c for _, c in part], pa.list_(pa.string()))], ["pos", "cells"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(unpack, "pos int, cells array<string>")
    head = rows.where("pos = 0").first()
    names = [n or f"column{i + 1}" for i, n in enumerate(head["cells"])] if head else []
    df = rows.where("pos > 0").select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
    if not names:
        return df
    checks = df.agg(*(F.count_if(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast("double").isNull()).alias(f"b{i}") for i, n in enumerate(names)), *(F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names))).first()
    return df.select(*((F.col(f"`{n}`").cast("double") if checks[f"b{i}"] == 0 and checks[f"n{i}"] else F.col(f"`{n}`")).alias(n) for i, n in enumerate(names)))
