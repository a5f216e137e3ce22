"""Single documents of other formats as blocks: HTML, WebVTT, e-mail, Office, XML.

Each reader is a function of one text or file content; ``as_blocks`` runs it
over a column in Arrow batches. What can't be parsed gives no block.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Block = tuple[str, int, str]  # kind, level, text

HIDDEN = {"script", "style", "template", "noscript", "head"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Blocks and tables of an HTML text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.tables: list[list[tuple[int, int, int, int, bool, str]]] = []
        self.text: list[str] = []
        self.kind, self.level = "paragraph", 0
        self.lists = 0
        self.hidden, self.depth = "", 0
        self.open_tables: list[dict] = []
        self.cell: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.text = []
        self.kind, self.level = "paragraph", 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth:
            self.depth += tag == self.hidden
            return
        if tag not in VOID and (tag in HIDDEN or "hidden" in a):
            self.hidden, self.depth = tag, 1
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in ("p", "div", "section", "article", "blockquote", "pre", "ul", "ol", "dl", "title"):
            if self.cell is None:
                self.flush()
            self.lists += tag in ("ul", "ol")
        elif tag == "li":
            self.flush()
            self.kind, self.level = "list_item", max(1, self.lists)
        elif tag == "br":
            (self.cell if self.cell is not None else self.text).append(" ")
        elif tag == "table":
            self.flush()
            self.open_tables.append({"rows": -1, "taken": set(), "cells": [], "span": (1, 1), "head": False})
        elif tag == "tr" and self.open_tables:
            self.close_cell()
            self.open_tables[-1]["rows"] += 1
        elif tag in ("td", "th") and self.open_tables:
            self.close_cell()
            number = lambda n: max(1, int(a[n])) if (a.get(n) or "").isdigit() else 1
            self.open_tables[-1].update(span=(number("rowspan"), number("colspan")), head=tag == "th")
            self.cell = []

    def close_cell(self) -> None:
        if self.cell is None or not self.open_tables:
            return
        t = self.open_tables[-1]
        row, col = max(0, t["rows"]), 0
        while (row, col) in t["taken"]:
            col += 1
        height, width = t["span"]
        t["taken"] |= {(row + i, col + j) for i in range(height) for j in range(width)}
        t["cells"].append((row, row + height, col, col + width, t["head"], " ".join("".join(self.cell).split())))
        self.cell = None

    def handle_endtag(self, tag):
        if self.depth:
            self.depth -= tag == self.hidden
            return
        if re.fullmatch("h[1-6]", tag) or tag in ("p", "li", "div", "section", "article", "blockquote", "pre", "title"):
            if self.cell is None:
                self.flush()
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = max(0, self.lists - 1)
        elif tag in ("td", "th", "tr"):
            self.close_cell()
        elif tag == "table" and self.open_tables:
            self.close_cell()
            self.tables.append(self.open_tables.pop()["cells"])

    def handle_data(self, data):
        if not self.depth:
            (self.cell if self.cell is not None else self.text).append(data)


def _read(text: str) -> _Reader:
    r = _Reader()
    r.feed(text)
    r.close()
    r.close_cell()
    r.flush()
    while r.open_tables:
        r.tables.append(r.open_tables.pop()["cells"])
    return r


def html_blocks(text: str) -> list[Block]:
    """SRC19: headings, paragraphs and list items; hidden elements are left out."""
    return _read(text).blocks


def html_cells(text: str) -> list[tuple[int, int, int, int, int, bool, str]]:
    """SRC20: ``(table, r0, r1, c0, c1, header, text)``, spans placed on the grid."""
    return [(i, *c) for i, t in enumerate(_read(text).tables) for c in t]


def webvtt_blocks(text: str) -> list[Block]:
    """SRC23: cues in order; the level is the start in milliseconds."""
    out = []
    for part in re.split(r"\n\s*\n", text.replace("\r", "").removeprefix("﻿")):
        m = re.search(r"(?:(\d+):)?(\d\d):(\d\d)\.(\d{3})\s+-->\s+\S+[^\n]*\n([\s\S]+)", part)
        if m:
            h, mi, s, ms = int(m[1] or 0), int(m[2]), int(m[3]), int(m[4])
            out.append(("cue", ((h * 60 + mi) * 60 + s) * 1000 + ms, re.sub(r"<[^>]*>", "", " ".join(m[5].split()))))
    return out


def email_blocks(text: str) -> list[Block]:
    """SRC23: subject and body of a message; of several bodies the plain one."""
    m = email.message_from_string(text, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    content = body.get_content() if body is not None else ""
    blocks = html_blocks(content) if body is not None and body.get_content_type() == "text/html" else [("paragraph", 0, " ".join(p.split())) for p in re.split(r"\n\s*\n", content) if p.strip()]
    return ([("heading", 1, str(m["subject"]))] if m["subject"] else []) + blocks


def asciidoc_blocks(text: str) -> list[Block]:
    """SRC23: headings, list items and paragraphs."""
    out: list[Block] = []
    for part in re.split(r"\n\s*\n", text.replace("\r", "")):
        for line in part.split("\n") if re.match(r"[=*.\-] ?", part) else [" ".join(part.split())]:
            if m := re.match(r"(={1,6})\s+(.+)", line):
                out.append(("heading", len(m[1]), m[2].strip()))
            elif m := re.match(r"([*.\-]+)\s+(.+)", line):
                out.append(("list_item", len(m[1]), m[2].strip()))
            elif line.strip():
                out.append(("paragraph", 0, line.strip()))
    return out


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def office_blocks(content: bytes) -> list[Block]:
    """SRC24: paragraphs and headings of DOCX, PPTX and ODF texts, cells of XLSX; styles give heading levels."""
    out: list[Block] = []
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return out
    names = archive.namelist()
    shared = [" ".join(t.text or "" for t in s.iter() if _name(t) == "t") for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    parts = [n for n in ("word/document.xml", "content.xml") if n in names] + sorted((n for n in names if re.fullmatch(r"(ppt/slides/slide|xl/worksheets/sheet)\d+\.xml", n)), key=lambda n: (n.split("/")[0], int(re.search(r"(\d+)\.xml", n)[1])))
    for n in parts:
        for e in ElementTree.fromstring(archive.read(n)).iter():
            tag = _name(e)
            if tag == "c" and n.startswith("xl/"):
                value = next((v.text or "" for v in e.iter() if _name(v) in ("v", "t")), "")
                kind = next((v for k, v in e.attrib.items() if k == "t"), "")
                out.append(("cell", 0, shared[int(value)] if kind == "s" and value.isdigit() else value))
            elif tag in ("p", "h") and not n.startswith("xl/"):
                text = "".join(t.text or "" for t in e.iter() if _name(t) == "t") if n != "content.xml" else "".join(e.itertext())
                style = next((v for x in e.iter() if _name(x) == "pStyle" for v in x.attrib.values()), "")
                level = re.search(r"[Hh]eading\s*(\d)", style) or next((re.match(r"(\d)", v) for k, v in e.attrib.items() if k.endswith("outline-level")), None)
                if text.strip():
                    out.append(("heading", int(level[1]), text.strip()) if level else ("paragraph", 0, text.strip()))
    return out


def xml_blocks(text: str) -> list[Block]:
    """SRC25: titles and paragraphs of JATS-like XML; the level is the depth of sections."""
    out: list[Block] = []

    def walk(e, depth: int) -> None:
        tag = _name(e)
        if tag in ("article-title", "title", "invention-title"):
            out.append(("heading", max(1, depth), " ".join("".join(e.itertext()).split())))
        elif tag == "p":
            out.append(("paragraph", 0, " ".join("".join(e.itertext()).split())))
        else:
            for child in e:
                walk(child, depth + (tag == "sec"))

    try:
        walk(ElementTree.fromstring(text), 1)
    except ElementTree.ParseError:
        return []
    return [b for b in out if b[2]]


def as_blocks(rows: DataFrame, key: str, content: str, reader: Callable[..., list[Block]]) -> DataFrame:
    """``(key, block_no, kind, level, text)`` by one of the readers, or another callable."""
    source = rows.where(F.col(content).isNotNull()).select(key, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(reader(t))]
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[key, "block_no", "kind", "level", "text"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, block_no int, kind string, level int, text string")
