"""File sources and sinks: manifests, tolerant JSON lines, spreadsheets, archives, whole pages, partitioned exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "source_id string, url string, title string, file_type string, checksum_sha256 string, local_path string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header, by name; missing columns are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(MANIFEST)))


def new_sources(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose url and checksum aren't known yet; null checksums count as empty."""
    key = lambda df: df.withColumn("_c", F.coalesce("checksum_sha256", F.lit("")))
    return key(manifest).join(key(known).select("url", "_c").distinct(), ["url", "_c"], "left_anti").drop("_c")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; an unreadable line gives a row with status 'corrupt' and the line itself."""
    full = T.StructType.fromDDL(schema).add("_corrupt", "string")
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    names = [f.name for f in full.fields if f.name != "_corrupt"]
    bad = F.col("_corrupt").isNotNull()
    return df.select(*(F.when(bad, F.lit("corrupt")).otherwise(F.col(n)).alias(n) if n == "status" else F.col(n) for n in names), F.col("_corrupt").alias("raw_line"))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, row_number long, column_number long, ref string, value string"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, column, ref, value) of every filled cell of an xlsx file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = (targets.get(sheet.get(_REL)) or "").lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if part not in names:
                continue
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_NS}row"):
                for c in row.iter(f"{_NS}c"):
                    ref, kind, v = c.get("r") or "", c.get("t"), c.find(f"{_NS}v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        value = shared[int(v.text)] if kind == "s" else v.text
                    if value != "":
                        yield sheet.get("name") or "", int(row.get("r") or 0), _column(ref), ref, value


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks of a folder; a file that is no workbook gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = [(p, *c) for c in workbook_cells(data)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
                    continue
                for low in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[low : low + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5])], ["path", "sheet", "row_number", "column_number", "ref", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def workbook_rows(cells: DataFrame) -> DataFrame:
    """path, sheet, row_number, line: the cells of each row joined by a bar in their order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_number", "value"))), lambda x: x["value"]), " | ")
    return cells.groupBy("path", "sheet", "row_number").agg(joined.alias("line"))


def header_records(cells: DataFrame, header_row: int) -> DataFrame:
    """path, sheet, row_number, record: rows below a header row as maps from header to value."""
    head = cells.where(F.col("row_number") == header_row).select("path", "sheet", "column_number", F.trim("value").alias("name"))
    body = cells.where(F.col("row_number") > header_row).join(head, ["path", "sheet", "column_number"])
    return body.groupBy("path", "sheet", "row_number").agg(F.map_from_entries(F.array_distinct(F.sort_array(F.collect_list(F.struct("name", "value"))))).alias("record"))


def read_archives(spark: SparkSession, path: str, most: int = 250_000) -> DataFrame:
    """path, entry, size, text: the entries of zip archives; text of small text-like entries, null for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for i in z.infolist():
                            small = i.file_size <= most and re.search(r"\.(txt|xml|xsd|csv|html?|json|md)$", i.filename, re.I)
                            out.append((p, i.filename, i.file_size, z.read(i).decode("utf-8", "replace") if small else None))
                except zipfile.BadZipFile:
                    continue
                if out:
                    a, e, s, t = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(e), pa.array(s, pa.int64()), pa.array(t, pa.string())], ["path", "entry", "size", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, entry string, size long, text string")


def export_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header, a folder for each value of `by`."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def export_package(df: DataFrame, group: str, path: str) -> None:
    """One JSON document per group that holds its rows in order."""
    rest = [c for c in df.columns if c != group]
    df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("items")).write.mode("overwrite").json(path)
