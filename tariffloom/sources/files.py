"""Price-list archives and office files as DataFrames, by Spark's binary reader and the standard library."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_filename, split_path, split_synonyms
from ..session import ship

SUPPORTED = ("pdf", "docx", "xlsx", "xls")
LARGEST = 200 * 1024 * 1024
ENDS = 1 << 16  # bytes of a file's ends in which an archive's parts are looked for
#: Entries, their bytes and rows after which a task passes on what it has read.
ENTRIES, BYTES, ROWS = 500, 1 << 24, 5000
#: Column names of catalogue files by the field that they mean.
CATALOGUE_NAMES = {
    "service_name": ("service_name", "name", "наименование", "название", "услуга", "атауы"), "synonyms": ("synonyms", "синонимы"), "category": ("category", "категория", "раздел"),
    "subcategory": ("subcategory", "подкатегория"), "icd_code": ("icd_code", "icd", "мкб"), "code": ("code", "код"),
}


def binary(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of files."""
    ship(spark)
    return spark.read.format("binaryFile").load(path)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def detect_format(name: Column, content: Column) -> Column:
    """By the first bytes: pdf, docx or xlsx (by the parts that the archive names), xls; the extension decides between or instead."""
    head = F.hex(F.substring(content, 1, 8))
    # the archive's directory, which names its parts, is at its end, and the first part's name at its start
    body = F.decode(F.concat(F.substring(content, 1, ENDS), F.when(F.length(content) > ENDS, F.substring(content, -ENDS, ENDS)).otherwise(F.lit("").cast("binary"))), "ISO-8859-1")
    ext = extension(name)
    zipped = F.when(F.contains(body, F.lit("word/document.xml")), "docx").when(F.contains(body, F.lit("xl/")), "xlsx").when(ext.isin("docx", "xlsx"), ext).otherwise("unknown")
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), zipped).when(head.startswith("D0CF11E0A1B11AE1"), F.when(ext == "xls", "xls").otherwise("unknown")).when(ext.isin(*SUPPORTED), ext).otherwise("unknown")


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def entry_name(info: zipfile.ZipInfo) -> str | None:
    """The name of a member that may be read: no folder, no way out of the archive, a supported kind, not too large."""
    name = info.filename.replace("\\", "/")
    unsafe = name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/")
    if info.is_dir() or unsafe or name.rsplit(".", 1)[-1].lower() not in SUPPORTED or info.file_size > LARGEST:
        return None
    return name


def zip_counts(files: DataFrame) -> DataFrame:
    """archive, n: members of a supported kind, told by the archive's directory alone; empty ones count, broken archives have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = []
            for content in b["content"]:
                try:
                    counts.append(sum(entry_name(info) is not None for info in zipfile.ZipFile(io.BytesIO(content)).infolist()))
                except zipfile.BadZipFile:
                    counts.append(0)
            yield pd.DataFrame({"archive": b["path"], "n": counts})

    return files.select("path", "content").mapInPandas(run, "archive string, n long")


def zip_entries(files: DataFrame) -> DataFrame:
    """archive, name, content of each archive's members of a supported kind that are not empty; broken archives give none."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    name = entry_name(info)
                    if name:
                        with archive.open(info) as f:
                            data = f.read(LARGEST + 1)
                        if 0 < len(data) <= LARGEST:
                            yield path, name, data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            columns = zip(zip(*out), (pa.string(), pa.string(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["archive", "name", "content"])

        out, size = [], 0
        for member in members(batches):
            if out and (len(out) >= ENTRIES or size + len(member[2]) > BYTES):
                yield packed()
                out, size = [], 0
            out.append(member)
            size += len(member[2])
        if out:
            yield packed()

    return files.select("path", "content").mapInArrow(run, "archive string, name string, content binary").withColumn("safe_name", safe_filename(F.col("name")))


@lru_cache(1 << 12)
def local(tag: str) -> str:
    """An element's name without its namespace."""
    return tag.rsplit("}", 1)[-1]


@lru_cache(1 << 12)
def column_number(letters: str) -> int:
    """A column's place, from 0, by its letters."""
    column = 0
    for ch in letters:
        column = 26 * column + ord(ch) - 64
    return column - 1


def cell_text(value) -> str:
    """As written: nothing for none, whole numbers without a point, dates in ISO form."""
    if value is None or value != value:
        return ""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, member) in the workbook's order, sheets called by their file; in order of names if the workbook doesn't tell."""
    found = sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        target = {e.get("Id"): e.get("Target", "").removeprefix("/xl/") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        ids = [v for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet") or e.tag == "sheet" for k, v in e.attrib.items() if k.endswith("}id")]
        told = [f"xl/{target[i]}" for i in ids if f"xl/{target.get(i)}" in found]
        found = told + [n for n in found if n not in told]
    return [(n.rsplit("/", 1)[-1].removesuffix(".xml"), n) for n in found]


LETTERS = re.compile("[A-Z]+")


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str], int]]:
    """(sheet, row number, cells, level) of every sheet of an XLSX file; level is the first filled column plus indents."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(si.tag) == "si"]
    for sheet, name in sheets(book):
        for k, row in enumerate(e for e in ElementTree.fromstring(book.read(name)).iter() if local(e.tag) == "row"):
            cells: list[str] = []
            for c in row:
                letters = LETTERS.match(c.get("r", ""))
                column = column_number(letters[0]) if letters else len(cells)
                value = "".join([t.text or "" for t in c.iter() if local(t.tag) in ("v", "t")])
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif value and c.get("t") in (None, "n"):
                    try:
                        value = cell_text(float(value))
                    except ValueError:
                        pass
                cells += [""] * (column + 1 - len(cells))
                cells[column] = value
            first = next((i for i, c in enumerate(cells) if c.strip()), None)
            if first is not None:
                yield sheet, k, cells, first + (len(cells[first]) - len(cells[first].lstrip())) // 2


def document_rows(content: bytes) -> Iterator[tuple[str, int, list[str], int]]:
    """(table, row number, cells, level) of a DOCX file's tables and headings, with tracked changes accepted."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))

    def text(e) -> str:
        kind = local(e.tag)
        if kind in ("del", "moveFrom", "delText"):
            return ""
        return (e.text or "" if kind == "t" else "") + "".join([text(x) for x in e]) + ("\n" if kind == "p" else "")

    tables, nth = 0, 0
    for block in next((e for e in body if local(e.tag) == "body"), body):
        if local(block.tag) == "tbl":
            for row in (r for r in block if local(r.tag) == "tr"):
                yield f"table{tables}", nth, [text(c).strip() for c in row if local(c.tag) == "tc"], 0
                nth += 1
            tables += 1
        elif local(block.tag) == "p":
            style = next((v for s in block.iter() if local(s.tag) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
            m = re.search(r"(?i)(?:heading|заголовок)\s*(\d)", style)
            if m and text(block).strip():
                yield f"table{tables}", nth, [text(block).strip()], int(m[1]) - 1
                nth += 1


#: What reads a format's content: rows of (table, row number, cells, level or None).
READERS: dict[str, Callable[[bytes], Iterable[tuple]]] = {}


def reads(file_format: str):
    """Registers a function as the reader of a format; a later one takes its place."""

    def register(reader: Callable[[bytes], Iterable[tuple]]):
        READERS[file_format] = reader
        return reader

    return register


reads("xlsx")(sheet_rows)
reads("docx")(lambda content: ((table, k, cells, None) for table, k, cells, _ in document_rows(content)))


def formats() -> list[str]:
    """Formats that can be read."""
    return sorted(READERS)


def first_sheet(content: bytes) -> Iterator[tuple[str, int, list[str], int]]:
    first = None
    for row in sheet_rows(content):
        first = first or row[0]
        if row[0] != first:
            return
        yield row


def tables(files: DataFrame, readers: dict[str, Callable[[bytes], Iterable[tuple]]] | None = None) -> DataFrame:
    """file, table_id, row_idx, cells, hint of files (name, content, other columns but content are passed on) whose detected
    format has a reader (one of READERS unless given); broken ones give none. Works on streams of files as well."""
    kept = [f for f in files.schema.fields if f.name not in ("content", "name")]
    readers = dict(READERS if readers is None else readers)
    told = files.withColumn("_format", detect_format(F.col("name"), F.col("content"))).where(F.col("_format").isin(*readers))
    names = [*(f.name for f in kept), "file", "table_id", "row_idx", "cells", "hint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            passed = b.columns[: len(kept)]

            def packed() -> pa.RecordBatch:
                at, *columns = zip(*out)
                made = [pa.array(c, t, from_pandas=True) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32()))]
                return pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in passed] + made, names=names)

            out = []
            for at, (name, kind) in enumerate(zip(b.column("name").to_pylist(), b.column("_format").to_pylist())):
                try:
                    out += [(at, name, f"{name}#{t}", k, cells, level) for t, k, cells, level in readers[kind](b.column("content")[at].as_py())]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
                if len(out) >= ROWS:
                    yield packed()
                    out = []
            if out:
                yield packed()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["file string, table_id string, row_idx int, cells array<string>, hint int"])
    return told.select(*(F.col(f"`{f.name}`") for f in kept), "name", "_format", "content").mapInArrow(run, schema)


def catalogue_sheets(files: DataFrame) -> DataFrame:
    """file, row, service_name, synonyms, category, icd_code, code of the first sheet of catalogue workbooks (name, content): its
    first row names the columns, in any case; rows without a service's name are left out, and so are files without such a
    column."""
    rows = tables(files.select("name", "content"), {"xlsx": first_sheet})
    first = Window.partitionBy("file").orderBy("row_idx")
    rows = rows.withColumn("_header", F.transform(F.first("cells").over(first), lambda c: F.lower(F.trim(c)))).withColumn("_at", F.row_number().over(first)).where("_at > 1")

    def cell(field: str) -> Column:
        at = F.coalesce(*(F.nullif(F.array_position("_header", F.lit(n)), F.lit(0).cast("long")) for n in CATALOGUE_NAMES[field]))
        return F.nullif(F.trim(F.get("cells", (at - 1).cast("int"))), F.lit(""))

    told = rows.select("file", F.col("row_idx").alias("row"), cell("service_name").alias("service_name"), split_synonyms(cell("synonyms")).alias("synonyms"), cell("category").alias("category"), cell("icd_code").alias("icd_code"), cell("code").try_cast("int").alias("code"))
    return told.where("service_name IS NOT NULL")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """service_name, synonyms, category_path, category, icd_code, code of a JSON list, or of an object's services or items."""
    raw = spark.read.option("multiLine", True).json(path)
    for key in ("services", "items"):
        if key in raw.columns:
            raw = raw.select(F.explode(key).alias("_r")).select("_r.*")
    known = {c.lower(): c for c in raw.columns}
    kinds = dict(raw.dtypes)

    def named(field: str) -> Column:
        hit = next((known[n] for n in CATALOGUE_NAMES[field] if n in known), None)
        return F.lit(None).cast("string") if hit is None else F.col(f"`{hit}`")

    synonyms_of = next((known[n] for n in CATALOGUE_NAMES["synonyms"] if n in known), None)
    synonyms = F.col(synonyms_of) if synonyms_of and kinds[synonyms_of].startswith("array") else split_synonyms(named("synonyms").cast("string"))
    path_ = F.concat(split_path(named("category").cast("string")), split_path(named("subcategory").cast("string")))
    path_ = F.filter(F.col("category_path"), lambda x: F.trim(x) != "") if "category_path" in known and kinds["category_path"].startswith("array") else path_
    out = raw.select(F.trim(named("service_name")).alias("service_name"), synonyms.alias("synonyms"), F.when(F.size(path_) > 0, path_).alias("category_path"), named("icd_code").cast("string").alias("icd_code"), named("code").cast("string").try_cast("int").alias("code"))
    return out.where("service_name <> ''").withColumn("category", F.try_element_at("category_path", F.lit(1)))
