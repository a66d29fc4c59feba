"""Queries over archives of office files, which Spark writes from the tables, with their SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import files
from . import domain

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
AT_ONCE = 200  # archives that a task holds


def packed(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An XLSX file whose sheets come in the given order, whatever their files are called; strings are inline."""

    def cell(column: int, row: int, value) -> str:
        place = f'{chr(65 + column)}{row + 1}'
        if value is None:
            return ""
        return f'<c r="{place}"><v>{value}</v></c>' if isinstance(value, (int, float)) else f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    def sheet(rows: list[list]) -> str:
        body = "".join(f'<row r="{r + 1}">{"".join(cell(c, r, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
        return f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'

    listed = "".join(f'<sheet name="{name}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, name in enumerate(sheets))
    links = "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/{name}.xml"/>' for k, name in enumerate(sheets))
    told = {"xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>"}
    return packed(told | {f"xl/worksheets/{name}.xml": sheet(rows) for name, rows in sheets.items()})


def letter(rows: list[list[str]]) -> bytes:
    """A DOCX file with one table."""
    body = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in rows)
    return packed({"word/document.xml": f'<w:document xmlns:w="{WORDS}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>'})


def archives(spark, d):
    """path, content: an archive for each fifty orders, with a workbook of two sheets, a letter, and what must be left out."""

    def build(keys: list[int], prices: list[int]) -> bytes:
        lines = [[f"Услуга {k}", float(c)] for k, c in zip(keys, prices)]
        book = workbook({"sheet2": [["Название", "Цена"], *lines], "sheet1": [[None, "Итого", len(lines)]]})
        return packed({"price/list.xlsx": book, "письмо.docx": letter([[n, f"{int(p)} тг"] for n, p in lines]), "../evil.xlsx": book, "empty.xlsx": b"", "notes.txt": "x", "broken.docx": b"PK\x03\x04 no archive"})

    def run(batches):
        for whole in batches:
            for b in (whole.slice(at, AT_ONCE) for at in range(0, whole.num_rows, AT_ONCE)):
                groups = b.column("g").to_pylist()
                made = [build(*row) for row in zip(b.column("keys").to_pylist(), b.column("prices").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([f"archive{g}.zip" for g in groups], pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    orders = domain.read(spark, d, "orders").groupBy(F.expr("o_orderkey div 50").alias("g")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("rows"))
    return orders.select("g", F.col("rows.o_orderkey").alias("keys"), F.col("rows.o_custkey").alias("prices")).mapInArrow(run, "path string, content binary")


def archive_rows(spark, d):
    found = files.tables(files.zip_entries(archives(spark, d)).drop("safe_name"))
    return found.select("archive", "file", F.element_at(F.split("table_id", "#"), -1).alias("sheet"), "row_idx", F.array_join("cells", "|").alias("cells"), F.coalesce("hint", F.lit(-1)).alias("hint"))


def archive_counts(spark, d):
    return files.zip_counts(archives(spark, d))


HEADERS = (("Наименование", "Синонимы", "Раздел", "МКБ", "Код"), ("NAME", "synonyms", "category", "ICD", "code"))


def catalogue_workbooks(spark, d):
    """Catalogues of a hundred services each, with headers in two languages, and rows without a name."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        header = [f" {h} " for h in HEADERS[key[0] % 2]]
        rows = rows.sort_values("p_partkey")
        lines = [[None if k % 10 == 3 else n, f"{b}; {n} ,{b.lower()}", t, None if k % 4 == 0 else f"I{k}", k if k % 3 else "нет"] for k, n, b, t in zip(rows["p_partkey"].tolist(), rows["p_name"], rows["p_brand"], rows["p_type"])]
        return pd.DataFrame({"name": [f"catalogue{key[0]}.xlsx"], "content": [workbook({"sheet2": [header, *lines], "sheet1": [["name"], ["not read"]]})]})

    parts = domain.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.expr("p_partkey div 100").alias("g"))
    found = files.catalogue_sheets(parts.groupBy("g").applyInPandas(build, "name string, content binary"))
    return found.select("file", "service_name", F.array_join("synonyms", "|").alias("synonyms"), "category", F.coalesce("icd_code", F.lit("-")).alias("icd_code"), F.coalesce("code", F.lit(-1)).alias("code"))


QUERIES = {f.__name__: f for f in (archive_rows, archive_counts, catalogue_workbooks)}
SQL = {
    "archive_rows": """WITH o AS (SELECT *, 'archive' || (o_orderkey // 50) || '.zip' AS archive, row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey, o_custkey) AS n FROM orders)
SELECT archive, 'price/list.xlsx' AS file, 'sheet2' AS sheet, CAST(n AS INTEGER) AS row_idx, 'Услуга ' || o_orderkey || '|' || o_custkey AS cells, 0 AS hint FROM o
UNION ALL SELECT archive, 'письмо.docx', 'table0', CAST(n - 1 AS INTEGER), 'Услуга ' || o_orderkey || '|' || o_custkey || ' тг', -1 FROM o
UNION ALL SELECT DISTINCT archive, 'price/list.xlsx', 'sheet2', 0, 'Название|Цена', 0 FROM o
UNION ALL SELECT archive, 'price/list.xlsx', 'sheet1', 0, '|Итого|' || count(*), 1 FROM o GROUP BY archive""",
    "archive_counts": "SELECT DISTINCT 'archive' || (o_orderkey // 50) || '.zip' AS archive, 4::BIGINT AS n FROM orders",
    "catalogue_workbooks": """SELECT 'catalogue' || (p_partkey // 100) || '.xlsx' AS file, p_name AS service_name, p_brand || '|' || p_name AS synonyms, p_type AS category, CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE 'I' || p_partkey END AS icd_code,
  CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_partkey END::INTEGER AS code FROM part WHERE p_partkey % 10 <> 3""",
}
