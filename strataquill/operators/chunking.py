"""Splitters and token windows over plain texts.

A null text has no chunk; an empty one neither, unless said otherwise.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import tokens


def checked(size: int, overlap: int) -> tuple[int, int]:
    """CHK01: a size above 0 and an overlap of 0 or more below it."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a size above 0 and an overlap of 0 or more below the size are needed")
    return size, overlap


def token_counts(rows: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """CHK02: tokens of every text by a tokenizer file, code points without one; none for a null."""
    if vocabulary is None:
        return rows.select(key, F.coalesce(F.length(text), F.lit(0)).alias("tokens"))
    shared = rows.sparkSession.sparkContext.broadcast(tokens.vocabulary_text(vocabulary))

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        count = tokens.counter(shared.value)
        return s.map(lambda x: count(x) if x else 0)

    return rows.select(key, run(F.col(text)).alias("tokens"))


def token_windows(rows: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK05: windows of ``size`` code points, ``size - overlap`` apart; blank ones are left out."""
    checked(size, overlap)
    step = size - overlap
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / F.lit(float(step))).cast("int")
    cut = rows.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    content = F.substring(F.col(text), F.col("window_no") * step + 1, F.lit(size))
    return cut.select(key, "window_no", content.alias("content")).where(F.col("content").rlike(r"[^ \t\n\r\f\x0b]"))


def section_identity(document_id: Column, kind: Column, level: Column, start: Column) -> Column:
    """CHK08: section id, the digest of the canonical JSON of its fields."""
    record = F.struct(document_id.alias("document_id"), level.alias("heading_level"), kind.alias("kind"), start.alias("source_start"))
    return F.concat(F.lit("sec_"), F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256))


def fixed_chunks(rows: DataFrame, size: int, overlap: int, key: str = "document_id", text: str = "markdown") -> DataFrame:
    """CHK12: short texts whole, others at second-level headings, others at fixed steps."""
    checked(size, overlap)
    step = size - overlap
    marks = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / F.lit(step)).cast("int"))
    steps = F.transform(marks, lambda k: F.substring(F.col(text), k * step + 1, F.lit(size)))
    pieces = F.when(F.length(text) <= size, F.array(text)).when(F.col(text).contains("\n## "), F.split(text, "\n## ", -1)).otherwise(steps)
    return rows.where(F.col(text) != "").select(key, F.explode(pieces).alias("piece"))


def header_chunks(lines: DataFrame) -> DataFrame:
    """CHK13: lines grouped from one heading of levels 1 to 3 to the next, headings kept."""
    level = F.when(F.col("line").startswith("# "), 1).when(F.col("line").startswith("## "), 2).when(F.col("line").startswith("### "), 3)
    order = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("level", level).withColumn("run", F.count("level").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return runs.groupBy("document_id", "run").agg(F.max("level").alias("level"), joined.alias("content"))


def _pieces(rows: DataFrame, key: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    source = rows.where(F.col(text) != "").select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, p) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, p in enumerate(cut(t))]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((b.schema.field(0).type, pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece_no", "content"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, piece_no int, content string")


def merged(parts: list[str], separator: str, size: int, overlap: int) -> list[str]:
    """Parts joined greedily up to ``size``; the next chunk starts with trailing parts of up to ``overlap``."""
    out: list[str] = []
    group: list[str] = []
    length = 0
    for p in parts:
        more = len(p) + (len(separator) if group else 0)
        if group and length + more > size:
            out.append(separator.join(group))
            while group and (length > overlap or length + len(p) + len(separator) > size):
                length -= len(group[0]) + (len(separator) if len(group) > 1 else 0)
                group.pop(0)
            more = len(p) + (len(separator) if group else 0)
        group.append(p)
        length += more
    if group:
        out.append(separator.join(group))
    return [x.strip() for x in out if x.strip()]


def character_chunks(rows: DataFrame, separator: str, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK14: split at one separator, then merge up to the size."""
    checked(size, overlap)
    return _pieces(rows, key, text, lambda t: merged([p for p in t.split(separator) if p], separator, size, overlap))


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split at the first separator that occurs; parts beyond the size go on with the next ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(separator) if separator else list(text)) if p]
    out: list[str] = []
    small: list[str] = []
    for p in parts:
        if len(p) <= size:
            small.append(p)
            continue
        out += merged(small, separator, size, overlap)
        small = []
        out += recursive_split(p, size, overlap, rest) if rest else [p]
    return out + merged(small, separator, size, overlap)


def recursive_chunks(rows: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK15: ordered separators, coarse ones first."""
    checked(size, overlap)
    return _pieces(rows, key, text, lambda t: recursive_split(t, size, overlap))


def semantic_breaks(rows: DataFrame, group: str, order: str, vector: str, share: float) -> DataFrame:
    """CHK16: a new chunk where the cosine distance to the item before exceeds the group's percentile."""
    w = Window.partitionBy(group).orderBy(order)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    before = rows.withColumn("p", F.lag(vector).over(w))
    distance = 1 - dot(F.col(vector), F.col("p")) / F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("p"), F.col("p")))
    apart = before.select(group, order, distance.alias("d"))
    cuts = apart.groupBy(group).agg(F.percentile("d", share).alias("cut"))
    at = F.when(F.round("d", 9) > F.round("cut", 9), 1).otherwise(0)
    return apart.join(cuts, group).select(group, order, F.sum(at).over(w).alias("chunk"))


def simple_sentences(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences by plain end marks before white space; blank ones are left out."""
    parts = F.filter(F.split(text, r"[.!?]+\s+", -1), lambda x: x.rlike(r"\S"))
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("pos", "sentence"))


def sentence_windows(sentences: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """CHK17: each sentence with its neighbours."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-n, n)
    return sentences.select(key, "pos", "sentence", F.array_join(F.collect_list("sentence").over(w), " ").alias("window"))


def sentence_chunks(rows: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK18: whole sentences joined up to the size; longer ones are cut at the size."""
    import re

    def cut(t: str) -> list[str]:
        parts = [x for s in re.split(r"(?<=[.!?。！？])\s+", t) if s.strip() for x in ([s] if len(s) <= size else [s[i : i + size] for i in range(0, len(s), size)])]
        return merged(parts, " ", size, 0)

    return _pieces(rows, key, text, cut)


def hybrid_chunks(leaves: DataFrame, size: int) -> DataFrame:
    """CHK19: neighbouring leaves of one section merged while they fit; windows and tables stay alone."""
    lengths = F.array_sort(F.collect_list(F.struct("chunk_index", F.length("content").alias("n"), "unit", "content")))
    grouped = leaves.groupBy("document_id", "section_ordinal").agg(lengths.alias("xs"))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["unit"] == "packed") & (F.element_at(acc, -1)["unit"] == "packed") & (F.length(F.element_at(acc, -1)["content"]) + x["n"] + 2 <= size),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["chunk_index"].alias("chunk_index"), F.lit("packed").alias("unit"), F.concat_ws("\n\n", F.element_at(acc, -1)["content"], x["content"]).alias("content")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x["chunk_index"].alias("chunk_index"), x["unit"].alias("unit"), x["content"].alias("content")))))
    start = F.array().cast("array<struct<chunk_index:int,unit:string,content:string>>")
    return grouped.select("document_id", "section_ordinal", F.explode(F.aggregate("xs", start, step)).alias("x")).select("document_id", "section_ordinal", "x.chunk_index", "x.unit", "x.content")


def document_titles(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(document_id, title)`` through the hash; the smallest title where there are several."""
    at = manifest.where("title is not null").groupBy(F.lower("sha256").alias("hash")).agg(F.min("title").alias("title"))
    return reports.select("document_id", F.lower("source_sha256").alias("hash")).distinct().join(at, "hash").groupBy("document_id").agg(F.min("title").alias("title"))


def match_scores(pairs: DataFrame, boost: float = 0.92) -> DataFrame:
    """HIE13: likeness of heading and title; one that holds the other scores at least ``boost``."""
    def likeness(a: str | None, b: str | None) -> float:
        a, b = " ".join((a or "").casefold().split()), " ".join((b or "").casefold().split())
        if not a or not b:
            return 0.0
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        return max(ratio, boost) if a in b or b in a else ratio

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(likeness(x, y), 6) for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("score", run("heading", "title"))
