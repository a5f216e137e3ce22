"""Markdown structure as DataFrames: lines, markers, headings, tables, sections, blocks, leaves.

Each parser reads one text a row (Arrow batches, no shuffle). A null text has
no rows; an empty one is one empty line. Columns besides the id and the text
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import markdown_blocks as M
from strataquill.functions import packing, tokens
from strataquill.operators.ordered import carried

MARKER = r"^\s*<!-- PDF page ([1-9][0-9]*) -->\s*$"


def _parsed(documents: DataFrame, columns: str, kinds: list[pa.DataType], rows: Callable[[str, str], list[tuple]]) -> DataFrame:
    source = documents.where("document_id is not null and markdown is not null").select("document_id", "markdown")
    names = ["document_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(d, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate([pa.string(), *kinds])], names=names)

    return source.mapInArrow(run, "document_id string, " + columns)


INT, TEXT, FLAG = pa.int32(), pa.string(), pa.bool_()


def lines(documents: DataFrame) -> DataFrame:
    """STR01: every line with its number; an empty last line counts."""
    return documents.where("markdown is not null").select("document_id", F.posexplode(F.split("markdown", "\n", -1)).alias("line_no", "line"))


def page_of(line: Column) -> Column:
    """Page number of a marker line, else null."""
    found = F.regexp_extract(line, MARKER, 1)
    return F.when(found != "", found.cast("int"))


def markers(documents: DataFrame) -> DataFrame:
    """STR02: page markers."""
    return lines(documents).select("document_id", "line_no", page_of(F.col("line")).alias("page")).where("page is not null")


def marker_faults(documents: DataFrame) -> DataFrame:
    """STR03: malformed markers, none at all, text before the first, pages that go back."""
    at = lines(documents).withColumn("page", page_of(F.col("line")))
    rows = carried(at, ["document_id"], ["line_no"], F.floor(F.col("line_no") / 4_096), {"prior": F.col("page")}, False)
    malformed = rows.where(F.col("page").isNull() & F.col("line").contains("<!-- PDF page")).select("document_id", "line_no", F.lit("malformed").alias("fault"))
    backwards = rows.where("page < prior").select("document_id", "line_no", F.lit("backwards").alias("fault"))
    early = rows.where(F.col("prior").isNull() & F.col("page").isNull() & F.col("line").rlike(r"\S")).groupBy("document_id").agg(F.min("line_no").alias("line_no"))
    none = at.groupBy("document_id").agg(F.count("page").alias("n")).where("n = 0").select("document_id", F.lit(None).cast("int").alias("line_no"), F.lit("none").alias("fault"))
    return malformed.unionByName(backwards).unionByName(early.withColumn("fault", F.lit("early text"))).unionByName(none)


def line_pages(documents: DataFrame) -> DataFrame:
    """STR04, JOI14: the page of every line, that of the last marker at or before it; before the first marker its page.

    Lines are sorted within buckets, not documents; a document's first page is one row.
    """
    at = lines(documents).withColumn("own", page_of(F.col("line")))
    found = carried(at, ["document_id"], ["line_no"], F.floor(F.col("line_no") / 4_096), {"active": F.col("own")}, True)
    first = at.where("own is not null").groupBy("document_id").agg(F.min_by("own", "line_no").alias("first"))
    return found.join(first, "document_id", "left").select("document_id", "line_no", "line", "own", "active", F.coalesce("active", "first").alias("page"))


def span_pages(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """STR05: ``spans(document_id, section_id, first, last)`` with their page range, by two equi-joins."""
    at = line_pages(documents).select("document_id", "line_no", "page")
    start = at.select("document_id", F.col("line_no").alias("first"), F.col("page").alias("page_start"))
    end = at.select("document_id", (F.col("line_no") + 1).alias("last"), F.col("page").alias("page_end"))
    return spans.join(start, ["document_id", "first"]).join(end, ["document_id", "last"]).select("document_id", "section_id", "first", "last", "page_start", "page_end")


def span_text(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """STR06, HIE06: text of each span without page markers.

    A document meets all its spans in one row and is split once; a span's text is
    sliced from those lines.
    """
    wanted = spans.groupBy("document_id").agg(F.collect_list(F.struct("section_id", "first", "last")).alias("spans"))
    own = documents.select("document_id", F.split("markdown", "\n", -1).alias("ls")).join(wanted, "document_id")
    part = lambda s: F.slice(F.col("ls"), s["first"] + 1, F.greatest(s["last"] - s["first"], F.lit(0)))
    text = lambda s: F.struct(s["section_id"].alias("section_id"), F.array_join(F.filter(part(s), lambda x: ~x.rlike(MARKER)), "\n").alias("text"))
    return own.select("document_id", F.explode(F.transform("spans", text)).alias("x")).select("document_id", "x.section_id", "x.text")


def headings(documents: DataFrame) -> DataFrame:
    """STR07: headings outside fences, HTML blocks, lists and quotes."""
    return _parsed(documents, "level int, heading string, start_line int, end_line int", [INT, TEXT, INT, INT], lambda _, t: [(b.level, b.text, b.start, b.end) for b in M.blocks(t) if b.kind == "heading"])


def tables(documents: DataFrame) -> DataFrame:
    """STR08: spans of pipe tables."""
    return _parsed(documents, "start_line int, end_line int, source string", [INT, INT, TEXT], lambda _, t: [(b.start, b.end, b.text) for b in M.blocks(t) if b.kind == "table"])


def terminal_sections(documents: DataFrame) -> DataFrame:
    """STR10: spans of text between headings, with ordinals."""
    def rows(_: str, t: str) -> list[tuple]:
        ls = t.split("\n")
        return [(s.ordinal, s.level, s.heading, s.start, s.end, s.unheaded, M.kept_text(ls, s.start, s.end)) for s in M.terminal_sections(t)]

    return _parsed(documents, "ordinal int, level int, heading string, start_line int, end_line int, unheaded boolean, body string", [INT, INT, TEXT, INT, INT, FLAG, TEXT], rows)


def section_blocks(documents: DataFrame) -> DataFrame:
    """STR11: blocks of each terminal section, without markers and headings; parsed once a document."""
    def rows(_: str, t: str) -> list[tuple]:
        found = M.blocks(t)
        inside = [b for b in found if b.kind not in ("marker", "heading")]
        return [(s.ordinal, i, b.kind, b.start, b.end) for s in M.terminal_sections(t, found) for i, b in enumerate(x for x in inside if s.start <= x.start and x.end <= s.end)]

    return _parsed(documents, "ordinal int, block_no int, kind string, start_line int, end_line int", [INT, INT, TEXT, INT, INT], rows)


def owning_headings(documents: DataFrame) -> DataFrame:
    """STR12: the heading of each headed terminal section, by its end line and level."""
    h = headings(documents).select("document_id", F.col("end_line").alias("start_line"), "level", F.col("start_line").alias("heading_line"))
    return terminal_sections(documents).where("level is not null").select("document_id", "ordinal", "level", "start_line").join(h, ["document_id", "start_line", "level"])


def leaves(documents: DataFrame, size: int = 768, overlap: int = 96, vocabulary: str | None = None) -> DataFrame:
    """CHK01-CHK09: leaf chunks; sizes are tokens of the tokenizer file ``vocabulary``, code points without one."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a size above 0 and an overlap of 0 or more below the size are needed")
    columns = ["chunk_id", "section_id", "chunk_index", "page_start", "page_end", "content", "unit", "section_ordinal"]
    schema = "chunk_id string, section_id string, chunk_index int, page_start int, page_end int, content string, unit string, section_ordinal int"
    shared = documents.sparkSession.sparkContext.broadcast(tokens.vocabulary_text(vocabulary)) if vocabulary else None

    def rows(d: str, t: str) -> list[tuple]:
        count = len if shared is None else tokens.counter(shared.value)
        return [tuple(x[c] for c in columns) for x in packing.leaves(d, t, size, overlap, count)]

    return _parsed(documents, schema, [TEXT, TEXT, INT, INT, INT, TEXT, TEXT, INT], rows)


def leaf_faults(found: DataFrame, size: int = 768) -> DataFrame:
    """CHK10: leaves that break an invariant; none is expected."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    rows = found.withColumn("expected", F.row_number().over(order) - 1).withColumn("copies", F.count("*").over(Window.partitionBy("chunk_id")))
    checks = {
        "empty": F.trim("content") == "",
        "oversize": (F.length("content") > size) & (F.col("unit") != "table"),
        "pages": F.col("page_start") > F.col("page_end"),
        "gap": F.col("expected") != F.col("chunk_index"),
        "duplicate": F.col("copies") > 1,
    }
    fault = F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items()))))
    return rows.select("document_id", "chunk_index", fault.alias("fault"))


def section_refs(documents: DataFrame) -> DataFrame:
    """CHK11: one reference a heading, and a root where text stands outside headings."""
    def rows(d: str, t: str) -> list[tuple]:
        found = M.blocks(t)
        refs = [(packing.section_id(d, "heading", b.level, b.start), "heading", b.level, b.text, b.start, b.end) for b in found if b.kind == "heading"]
        if any(s.level is None for s in M.terminal_sections(t, found)):
            refs.insert(0, (packing.section_id(d, "document_root", None, 0), "document_root", None, None, 0, t.count("\n") + 1))
        return refs

    return _parsed(documents, "section_id string, kind string, level int, heading string, start_line int, end_line int", [TEXT, TEXT, INT, TEXT, INT, INT], rows)


def section_spans(documents: DataFrame) -> DataFrame:
    """Sections as code point spans: own text [x, y) up to the next heading, with its subsections [x, whole)."""
    def rows(d: str, t: str) -> list[tuple]:
        heads = [(b.level, b.start) for b in M.blocks(t) if b.kind == "heading"]
        starts = [0]
        for line in t.split("\n"):
            starts.append(starts[-1] + len(line) + 1)
        starts[-1] = len(t)
        ends, stack = [len(t)] * len(heads), []
        for i, (level, line) in enumerate(heads):
            while stack and heads[stack[-1]][0] >= level:
                ends[stack.pop()] = starts[line]
            stack.append(i)
        at = [starts[line] for _, line in heads] + [len(t)]
        out = [(f"{d}#{x}", x, y, whole, t[x:y]) for x, y, whole in zip(at, at[1:], ends)]
        return out if not at[0] else [(f"{d}#lead", 0, at[0], at[0], t[: at[0]]), *out]

    return _parsed(documents, "span_id string, x int, y int, whole int, content string", [TEXT, INT, INT, INT, TEXT], rows)
