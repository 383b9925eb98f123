"""Sources in files of other kinds: spreadsheets, SQLite databases, JSON configuration, folders. Contents are read on the executors, a file in a row."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: rows that a sheet can have
SHEET_ROWS = 1_048_576


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the file, or of all files under the folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """S3: row numbers (from 1) and cells as texts of the first sheet of an .xlsx file; cells left out are ''."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for _, row in ET.iterparse(book.open(first)):
            if row.tag != f"{_SHEET}row":
                continue
            cells: list[str] = []
            for cell in row.iter(f"{_SHEET}c"):
                column = 0
                for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (column - 1 - len(cells))
                value = cell.findtext(f"{_SHEET}v") or ""
                inline = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                cells.append(shared[int(value)] if cell.get("t") == "s" else inline or value)
            yield int(row.get("r")), cells
            row.clear()


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """S3: path, row_number (the first below the header is 2) and fields by header; blank rows are left out. Row order is in row_number."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = sheet_rows(content)
                _, header = next(rows, (1, []))
                found = [(n, {h: v for h, v in zip(header, [*cells, *[""] * len(header)], strict=False) if h}) for n, cells in rows if any(cells)]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([name] * len(found), pa.string()), "row_number": pa.array([n for n, _ in found], pa.int32()),
                    "fields": pa.array([list(f.items()) for _, f in found], pa.map_(pa.string(), pa.string())),
                })

    return files(spark, path).select("path", "content").mapInArrow(run, "path string, row_number int, fields map<string,string>")


def workbook(rows: list[list[str]]) -> bytes:
    """An .xlsx file with one sheet of texts, byte for byte the same for the same rows."""
    if len(rows) > SHEET_ROWS:
        raise ValueError(f"a sheet has {SHEET_ROWS} rows at most")
    sheet, parts = ET.Element("worksheet", xmlns=_SHEET[1:-1]), {}
    data = ET.SubElement(sheet, "sheetData")
    for n, cells in enumerate(rows, 1):
        row = ET.SubElement(data, "row", r=str(n))
        for value in cells:
            text = ET.SubElement(ET.SubElement(ET.SubElement(row, "c", t="inlineStr"), "is"), "t")
            text.text, text.attrib["xml:space"] = value, "preserve"
    office, relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts["[Content_Types].xml"] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{relations}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_SHEET[1:-1]}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{relations}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    parts["xl/worksheets/sheet1.xml"] = ET.tostring(sheet, encoding="unicode")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(zipfile.ZipInfo(name), text if text.startswith("<?") else f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return out.getvalue()


def _opened(content: bytes) -> sqlite3.Connection:
    found = sqlite3.connect(":memory:")
    found.deserialize(content)
    return found


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str], versions: tuple[int, ...] | None = None) -> DataFrame:
    """A table of a SQLite file, every column text, null kept. With versions, only a database of such a user_version that has just these columns is read."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                base = _opened(content)
                have = [r[1] for r in base.execute(f'PRAGMA table_info("{table}")')]
                if versions is not None:
                    version = base.execute("PRAGMA user_version").fetchone()[0]
                    if version not in versions or sorted(have) != sorted(columns):
                        raise ValueError(f"{table}: version {version} with columns {have} is not supported")
                cursor = base.execute("SELECT " + ", ".join(f'CAST("{c}" AS TEXT)' if c in have else "NULL" for c in columns) + f' FROM "{table}"')
                while rows := cursor.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=columns)

    return files(spark, path).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def integrity(spark: SparkSession, path: str) -> DataFrame:
    """Path, sha256 of the bytes, and whether SQLite finds the database whole."""

    def run(batches):
        for batch in batches:
            whole = [_opened(c).execute("PRAGMA integrity_check").fetchone()[0] == "ok" for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "sha256": batch.column("sha256"), "whole": pa.array(whole)})

    return files(spark, path).select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(run, "path string, sha256 string, whole boolean")


def configuration(spark: SparkSession, path: str, defaults: dict, given: dict) -> dict:
    """The defaults, over them the JSON object in the file (if there is one), over that what is given and not None. Unknown names in the file are refused."""
    stored = {}
    if _exists(spark, path):
        stored = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    if not isinstance(stored, dict) or set(stored) - set(defaults):
        raise ValueError(f"{path}: not an object of {sorted(defaults)}")
    return defaults | stored | {k: v for k, v in given.items() if v is not None}


#: S5, fixed values: what a file's name says of its source, the first that fits
SOURCE_KINDS = (("maps", "GOOGLE_MAPS"), ("search", "GOOGLE_SEARCH"), ("daily", "DAILY_EXPORT"), ("master", "MASTER"))


def source_kind(path: Column) -> Column:
    name, kind = F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit("OTHER")
    for word, own in reversed(SOURCE_KINDS):
        kind = F.when(F.contains(name, F.lit(word)), own).otherwise(kind)
    return kind


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct files under a folder with their source kind: of equal ones the first path, and no spreadsheet whose name a CSV file beside it has."""
    found = files(spark, folder).select("path", F.sha2("content", 256).alias("sha256"))
    once = found.groupBy("sha256").agg(F.min("path").alias("path"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    tables = once.where(F.endswith(F.lower("path"), F.lit(".csv"))).select(stem.alias("_stem")).distinct()
    mirrors = once.where(F.endswith(F.lower("path"), F.lit(".xlsx"))).join(tables, stem == F.col("_stem"), "left_semi").select("path")
    return once.join(mirrors, "path", "left_anti").select("path", "sha256", source_kind(F.col("path")).alias("kind"))


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A whole file, replaced at once: written beside its place and renamed."""
    fs, where = _at(spark, path)
    _, beside = _at(spark, f"{path}.new")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{path} was not replaced")


def append_xlsx(df: DataFrame, path: str) -> int:
    """K3: rows added to a spreadsheet by its header; new columns come after it. Returns the rows in it. Refuses more rows than a sheet has."""
    spark = df.sparkSession
    header, rows = [], []
    if _exists(spark, path):
        held = [r.content for r in files(spark, path).select("content").collect()]  # one file of SHEET_ROWS at most
        rows = [cells for _, cells in sheet_rows(bytes(held[0]))]
        header, rows = rows[0], rows[1:]
    header = [*header, *(c for c in df.columns if c not in header)]
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    for r in texts.limit(SHEET_ROWS).toLocalIterator():
        rows.append([r[c] if c in df.columns else "" for c in header])
    write_file(spark, path, workbook([header, *rows]))
    return len(rows)
