"""File sources: repository walks, documents, manifests, git diffs, change detection, statistics."""

from __future__ import annotations

import functools
import html
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types that a parser owns
EXTENSIONS = {"py": "python", "java": "java", "kt": "kotlin", "cs": "csharp", "vb": "vb", "cpp": "cplus", "cc": "cplus", "c": "cplus", "h": "cplus", "hpp": "cplus", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "php": "php", "go": "go", "rs": "rust", "sql": "sql", "pks": "plsql", "pkb": "plsql", "html": "html", "css": "css"}
EXCLUDED = ["node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv", "venv"]
DOCUMENTS = ["pdf", "docx", "pptx", "xlsx", "md", "txt"]
PLSQL = [r"(?i)\bcreate\s+(or\s+replace\s+)?(package|procedure|function|trigger|type)\b", r"(?i)\bdeclare\b", r"(?i)\bbegin\b", r"(?i)\bexception\s+when\b", r"(?i)%(row)?type\b", r"(?i)\bdbms_\w+"]
SQL = [r"(?i)\bcreate\s+table\b", r"(?i)\binsert\s+into\b", r"(?i)\balter\s+table\b", r"(?i)\bselect\b.+\bfrom\b", r"(?i)\bcreate\s+(unique\s+)?index\b"]


def owned_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, parser, length, modified) of files below root that some parser owns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return with_parser(files.select("path", "length", F.col("modificationTime").alias("modified")))


def with_parser(files: DataFrame) -> DataFrame:
    """Files (path, ...) with the parser that owns their extension; excluded folders and unowned files go."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    inside = F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, EXCLUDED)) + ")/")
    return files.where(~inside).withColumn("parser", F.try_element_at(table, F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))).where("parser is not null")


def sql_dialect(text: Column) -> Column:
    """sql or plsql by counts of strong patterns outside comments; a tie above 0 is plsql, none is sql."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    count = lambda patterns: sum((bare.rlike(p).cast("int") for p in patterns), F.lit(0))
    a, b = count(PLSQL), count(SQL)
    return F.when((a > 0) & (a >= b), "plsql").otherwise("sql")


def is_sensitive(path: Column, globs: list[str]) -> Column:
    """Whether a path or its file name matches one of the globs."""
    pattern = "|".join("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g) for g in globs)
    return path.rlike(f"^(?:{pattern})$") | F.element_at(F.split(path, "/"), -1).rlike(f"^(?:{pattern})$")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_cells(data: bytes) -> Iterator[tuple[str, int, int, str | None, str | None, str]]:
    """(sheet, r, c, value, formula, type) of the cells of a workbook, with shared strings put in; rows and columns from 1."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for name in sheets:
            for cell in ElementTree.fromstring(z.read(name)).iter(f"{_MAIN}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", "A1")).groups()
                column = functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0)
                kind, value, formula = cell.get("t", "n"), cell.findtext(f"{_MAIN}v"), cell.findtext(f"{_MAIN}f")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                yield name.rsplit("/", 1)[-1][:-4], int(row), column, value, None if formula is None else "=" + formula, kind


def _document_text(name: str, data: bytes) -> str:
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in ("md", "txt"):
        return data.decode("utf-8", errors="ignore")
    if kind == "xlsx":
        rows: dict[tuple[str, int], list[str]] = {}
        for sheet, r, _, value, _, _ in _sheet_cells(data):
            if value is not None and value.strip():
                rows.setdefault((sheet, r), []).append(value)
        return "\n".join("\t".join(x) for x in rows.values())
    if kind in ("docx", "pptx"):
        inner = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}[kind]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            order = sorted((n for n in z.namelist() if re.fullmatch(inner, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
            parts = [z.read(n).decode("utf-8", errors="ignore") for n in order]
        paragraphs = re.split(r"</(?:w:p|a:p)>", "\n".join(parts))
        texts = (html.unescape("".join(re.findall(r"<(?:w:t|a:t)(?: [^>]*)?>([^<]*)<", p))) for p in paragraphs)
        return "\n".join(t for t in texts if t.strip())
    from pypdf import PdfReader  # only where it is installed

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sheet, r, c, value, formula, type) of the cells of all workbooks below a folder; a file that is no workbook
    gives one row with its error as the value and `error` as the type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(".xlsx")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet", "r", "c", "value", "formula", "type"]
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    cells = _sheet_cells(data)
                    while rows := [(path, *x) for x in itertools.islice(cells, 50_000)]:
                        yield pd.DataFrame(rows, columns=columns)
                except Exception as e:
                    yield pd.DataFrame([(path, None, None, None, f"{type(e).__name__}: {e}", None, "error")], columns=columns)

    return files.mapInPandas(run, "path string, sheet string, r int, c int, value string, formula string, type string")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of the documents below a folder; a file that can't be read has an error and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(DOCUMENTS)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((path, _document_text(path, data), None))
                except Exception as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.mapInPandas(run, "path string, text string, error string")


def diff_entries(lines: DataFrame) -> DataFrame:
    """(status, old_path, new_path) of name-status lines (value): A, M, D and R<score> rows."""
    p = F.split("value", "\t")
    kind = F.substring(F.trim(p[0]), 1, 1)
    rows = lines.select(kind.alias("status"), F.when(kind.isin("D", "M"), p[1]).when(kind == "R", p[1]).alias("old_path"), F.when(kind.isin("A", "M"), p[1]).when(kind == "R", F.get(p, F.lit(2))).alias("new_path"))
    return rows.where(F.col("status").isin("A", "M", "D", "R"))


def changed_and_deleted(entries: DataFrame) -> DataFrame:
    """(path, change) with changed for new contents and deleted for old paths; a rename is both."""
    gone = entries.where("status in ('D', 'R')").select(F.col("old_path").alias("path"), F.lit("deleted").alias("change"))
    new = entries.where("status in ('A', 'M', 'R')").select(F.col("new_path").alias("path"), F.lit("changed").alias("change"))
    return gone.unionByName(new).where("path is not null").distinct()


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Paths of a manifest: a JSON list, {"files": [...]}, or lines; those outside root go."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    listed = F.coalesce(F.from_json(F.get_json_object("t", "$.files"), "array<string>"), F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")))
    rows = whole.select(F.explode(F.when(listed.isNotNull(), listed).otherwise(F.split("t", r"\r?\n"))).alias("path")).select(F.regexp_replace(F.trim("path"), r"\\", "/").alias("path"))
    prefix = root.rstrip("/") + "/"
    rows = rows.select(F.when(F.col("path").startswith(prefix), F.substring(F.col("path"), len(prefix) + 1, 1 << 20)).otherwise(F.col("path")).alias("path"))
    return rows.where((F.col("path") != "") & ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")).distinct()


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted between states (path, hash); unchanged paths have no row."""
    o, n = old.select("path", F.col("hash").alias("h0")), new.select("path", F.col("hash").alias("h1"))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified")
    return o.join(n, "path", "full").select("path", change.alias("change")).where("change is not null")


def line_statistics(raw: DataFrame) -> DataFrame:
    """(language, files, blank, comment, code) of JSON reports (value) that map languages to counts."""
    kind = "map<string, struct<nFiles: long, blank: long, comment: long, code: long>>"
    rows = raw.select(F.explode(F.from_json("value", kind)).alias("language", "n")).where(~F.col("language").isin("header"))
    return rows.select("language", F.col("n.nFiles").alias("files"), "n.blank", "n.comment", "n.code").where("files is not null")
