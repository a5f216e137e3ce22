"""Readers of document corpora, manifests, sidecars and sheets.

Every reader is a Spark file source with an explicit schema; nothing is listed
on the driver except where a rule needs it. Missing files are Spark's own error.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id bigint, category string, title string, organization string, source_url string, local_path string, pages int, bytes bigint, sha256 string, loaded_at timestamp"
SIDECAR = "document_id string, source string, source_sha256 string"


def canonical_corpus(spark: SparkSession, root: str) -> DataFrame:
    """SRC01, SRC02: ``<root>/<id>/document.md``, one level, strict UTF-8; names that begin with a dot are left out.

    One file that isn't UTF-8 fails the read.
    """
    files = spark.read.format("binaryFile").load(f"{root}/*/document.md")
    text = F.decode("content", "UTF-8")
    checked = F.when(F.encode(text, "UTF-8") == F.col("content"), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
    rows = files.select(F.regexp_extract("path", r"([^/]+)/document\.md$", 1).alias("document_id"), checked.alias("content"), "path")
    return rows.where(~F.col("document_id").startswith("."))


def recursive_markdown(spark: SparkSession, root: str) -> DataFrame:
    """SRC03: every ``*.md`` below a folder with its path from that folder on; unreadable files are skipped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).text(root, wholetext=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    above = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    whole = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return rows.select("value", F.substring(whole, len(above) + 1, 1 << 30).alias("relative_path"))


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC09: whole text files."""
    return spark.read.text(path, wholetext=True).select("value")


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC04: a manifest with or without a byte-order mark; hashes validated and lower-cased.

    A hash that isn't 64 hex digits fails the read.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("enforceSchema", True).schema(MANIFEST).csv(path)
    digest = F.lower(F.trim("sha256"))
    return rows.withColumn("sha256", F.when(digest.rlike("^[0-9a-f]{64}$"), digest).otherwise(F.raise_error(F.concat(F.lit("bad hash: "), F.coalesce("sha256", F.lit("null")))).cast("string")))


def duplicate_hashes(rows: DataFrame) -> DataFrame:
    """Hashes that stand in several manifest rows."""
    return rows.groupBy(F.lower("sha256").alias("sha256")).agg(F.count("*").alias("n")).where("n > 1")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """SRC05: three keys of JSON objects; others are ignored, a broken file fails."""
    return spark.read.schema(SIDECAR).option("mode", "FAILFAST").json(path)


def joined_text(*parts: Column) -> Column:
    """SRC06, SRC07: the non-blank members of array columns, joined in order."""
    return F.concat_ws(" ", F.filter(F.concat(*parts), lambda x: F.trim(x) != ""))


def sheets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """SRC08: one CSV a sheet, united with the sheet's name; columns that a sheet lacks are null."""
    out = None
    for name, path in paths.items():
        part = spark.read.option("header", True).csv(path).withColumn("sheet", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def sniffed(text: str) -> str:
    """SRC18: the separator among comma, semicolon, tab, bar and colon; comma where none is clear.

    The one that gives the most records the width of the first, over all
    records; of equal ones the wider, then the earlier in that order.
    """
    best, choice = (0.0, 1), ","
    for mark in ",;\t|:":
        widths = [len(r) for r in csv.reader(io.StringIO(text), delimiter=mark) if r] if mark in text else []
        if widths and widths[0] > 1:
            found = (sum(w == widths[0] for w in widths) / len(widths), widths[0])
            if found > best:
                best, choice = found, mark
    return choice


def csv_grid(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SRC18: cells ``(key, row, col, text, is_header)`` of CSV texts; ragged rows keep what they have."""

    @F.pandas_udf("array<struct<row:int,col:int,text:string,is_header:boolean>>")
    def run(s: pd.Series) -> pd.Series:
        def grid(x: str | None) -> list[dict]:
            lines = csv.reader(io.StringIO(x or ""), delimiter=sniffed(x or ""))
            return [{"row": i, "col": j, "text": c, "is_header": i == 0} for i, line in enumerate(lines) for j, c in enumerate(line)]

        return s.map(grid)

    return rows.select(key, F.explode(run(F.col(text))).alias("x")).select(key, "x.row", "x.col", "x.text", "x.is_header")


#: Formats by extension.
FORMATS = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "html": "html", "htm": "html", "xhtml": "html", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl",
    "xml": "xml", "nxml": "jats", "xbrl": "xbrl", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "odt": "odt", "odp": "odp", "ods": "ods", "eml": "email", "vtt": "webvtt",
    "adoc": "asciidoc", "asciidoc": "asciidoc", "tex": "latex", "epub": "epub", "boxnote": "boxnote", "dclg": "doclang", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "wav": "audio", "mp3": "audio", "mp4": "video",
}


def format_of(path: str | None, head: bytes | None) -> str:
    """SRC16: the format by the first bytes, then by extension, then by content."""
    start = (head or b"")[:1024]
    name = (path or "").lower()
    by_name = FORMATS.get(name.rsplit(".", 1)[-1] if "." in name else "", "")
    if start.startswith(b"%PDF-"):
        return "pdf"
    if start.startswith(b"PK\x03\x04"):
        return by_name if by_name in ("docx", "pptx", "xlsx", "odt", "odp", "ods", "epub") else "zip"
    if start.startswith((b"\x89PNG", b"\xff\xd8\xff", b"II*\x00", b"MM\x00*")):
        return "image"
    text = start.lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if text.startswith(b"webvtt"):
        return "webvtt"
    if by_name:
        return by_name
    if text.startswith((b"<!doctype html", b"<html")):
        return "html"
    if text.startswith(b"<?xml"):
        return "jats" if b"<article" in text else "xbrl" if b"xbrl" in text else "xml"
    if text.startswith((b"{", b"[")):
        return "json"
    return "text" if text else "empty"


def formats(rows: DataFrame, path: str, head: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([format_of(a, b) for a, b in zip(p, h, strict=True)], dtype=object)

    return rows.select(path, run(F.col(path), F.col(head)).alias("format"))


def page_range(rows: DataFrame, page: str, first: int, last: int, most: int | None = None) -> DataFrame:
    """SRC29: pages within a closed range, before anything is decoded."""
    if first < 1 or last < first:
        raise ValueError("pages count from 1 and the range must not be empty")
    return rows.where(F.col(page).between(first, last if most is None else min(last, first + most - 1)))
