"""Packed and binary documents: EPUB, spreadsheets, Office and OpenDocument files, PDF.

Each reader is a function of one file's bytes. What can't be parsed gives
nothing. Members of an archive are read up to ``MEMBER_BYTES``; a larger one is
an error, since it may be a bomb.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.sources.documents import Block, html_blocks
from strataquill.sources.markup_readers import children, inner, kept, local, parsed, squeezed

MEMBER_BYTES = 512 << 20


class Archive:
    """Members of a ZIP file as XML; empty where the bytes are none."""

    def __init__(self, content: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            self.names = self.zip.namelist()
        except zipfile.BadZipFile:
            self.zip, self.names = None, []

    def text(self, name: str) -> str:
        if name not in self.names:
            return ""
        if self.zip.getinfo(name).file_size > MEMBER_BYTES:
            raise ValueError(f"{name} has more than {MEMBER_BYTES} bytes")
        return self.zip.read(name).decode("utf-8-sig", "replace")

    def xml(self, name: str):
        text = self.text(name)
        return parsed(text) if text else None

    def targets(self, name: str) -> dict[str, str]:
        """Paths by id of a part's relations."""
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        return {} if root is None else {r.get("Id"): (r.get("Target", "").lstrip("/") if r.get("Target", "").startswith("/") else posixpath.normpath(posixpath.join(folder, r.get("Target", "")))) for r in root}


def numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def attribute(e, name: str) -> str | None:
    """An attribute by its local name."""
    return None if e is None else next((v for k, v in e.attrib.items() if local(k) == name), None)


def first(e, *names: str):
    return next((x for x in e.iter() if local(x.tag) in names), None)


def epub_blocks(content: bytes) -> list[Block]:
    """SRC23: the title, and the blocks of the content files in reading order."""
    z = Archive(content)
    container = z.xml("META-INF/container.xml")
    path = attribute(first(container, "rootfile"), "full-path") if container is not None else None
    package = z.xml(path) if path else None
    if package is None:
        return []
    title = next((inner(x) for x in package.iter() if local(x.tag) == "title"), "")
    files = {x.get("id"): x.get("href", "") for x in package.iter() if local(x.tag) == "item"}
    order = [files.get(x.get("idref"), "") for x in package.iter() if local(x.tag) == "itemref"]
    out: list[Block] = [("title", 1, title)]
    for name in order:
        out += html_blocks(z.text(posixpath.normpath(posixpath.join(posixpath.dirname(path), name.split("#")[0]))))
    return kept(out)


# --- spreadsheets -------------------------------------------------------------------------------------------------------------------

Cell = tuple[str, int, int, int, int, str]  # sheet, row, column, height, width, text


def place(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference like ``AB12``."""
    m = re.match(r"\$?([A-Za-z]+)\$?(\d+)", ref)
    col = 0
    for ch in m[1].upper():
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def xlsx_cells(content: bytes) -> list[Cell]:
    """SRC08, SRC22: cells of every sheet in order; a merged cell has its extent, what it covers is left out."""
    z = Archive(content)
    book = z.xml("xl/workbook.xml")
    if book is None:
        return []
    shared = z.xml("xl/sharedStrings.xml")
    strings = [] if shared is None else ["".join(t.text or "" for t in s.iter() if local(t.tag) == "t") for s in shared]
    targets = z.targets("xl/workbook.xml")
    out: list[Cell] = []
    for sheet in (s for s in book.iter() if local(s.tag) == "sheet"):
        root = z.xml(targets.get(attribute(sheet, "id"), ""))
        if root is None:
            continue
        spans: dict[tuple[int, int], tuple[int, int]] = {}
        hidden: set[tuple[int, int]] = set()
        for m in (x for x in root.iter() if local(x.tag) == "mergeCell"):
            a, _, b = m.get("ref", "").partition(":")
            (r0, c0), (r1, c1) = place(a), place(b or a)
            spans[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
            hidden |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
        row, col = -1, -1
        for e in root.iter():
            if local(e.tag) == "row":
                row, col = int(e.get("r", row + 2)) - 1, -1
            elif local(e.tag) == "c":
                row, col = place(e.get("r")) if e.get("r") else (row, col + 1)
                kind, value = e.get("t", ""), "".join(x.text or "" for x in e.iter() if local(x.tag) in ("v", "t"))
                if kind == "s" and value.isdigit() and int(value) < len(strings):
                    value = strings[int(value)]
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                if value and (row, col) not in hidden:
                    out.append((sheet.get("name", ""), row, col, *spans.get((row, col), (1, 1)), value))
    return out


def as_cells(rows: DataFrame, key: str, content: str, reader: Callable[[bytes], list[Cell]] = xlsx_cells) -> DataFrame:
    """``(key, sheet, row, col, height, width, text)`` of a column of files."""
    source = rows.where(F.col(content).isNotNull()).select(key, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c in reader(t)]
            kinds = (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[key, "sheet", "row", "col", "height", "width", "text"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, sheet string, row int, col int, height int, width int, text string")


# --- Office and OpenDocument --------------------------------------------------------------------------------------------------------


def row_text(cells: list[tuple[str, int]]) -> str:
    """A table row; a cell over several columns is followed by as many empty ones."""
    return " | ".join(x for text, span in cells for x in (text, *[""] * (span - 1)))


def whole(value: str | None, default: int = 1) -> int:
    return int(value) if value and value.isdigit() else default


def docx_blocks(z: Archive) -> Iterator[Block]:
    body = z.xml("word/document.xml")

    def text_of(e) -> str:
        return "".join(x.text or "" if local(x.tag) == "t" else "\t" if local(x.tag) == "tab" else " " if local(x.tag) in ("br", "cr") else "" for x in e.iter())

    def walk(e) -> Iterator[Block]:
        for c in e:
            tag = local(c.tag)
            if tag == "p":
                style = next((v for x in c.iter() if local(x.tag) == "pStyle" for v in x.attrib.values()), "")
                head = re.search(r"(?i)heading\s*(\d)", style)
                numbers = first(c, "numPr")
                if head or style.lower() == "title":
                    yield "heading", int(head[1]) if head else 1, squeezed(text_of(c))
                elif numbers is not None or style.lower().startswith("list"):
                    yield "list_item", 1 + whole(attribute(first(c, "ilvl"), "val"), 0) if numbers is not None else 1, squeezed(text_of(c))
                else:
                    yield "paragraph", 0, squeezed(text_of(c))
            elif tag == "tbl":
                for i, r in enumerate(children(c, "tr")):
                    cells = []
                    for x in children(r, "tc"):
                        merged = first(x, "vMerge")
                        covered = merged is not None and attribute(merged, "val") != "restart"
                        cells.append(("" if covered else squeezed(" ".join(text_of(p) for p in x.iter() if local(p.tag) == "p")), whole(attribute(first(x, "gridSpan"), "val"))))
                    yield "table_row", i, row_text(cells)
            else:
                yield from walk(c)

    if body is not None:
        yield from walk(body)


def pptx_blocks(z: Archive) -> Iterator[Block]:
    for name in numbered(z.names, r"ppt/slides/slide(\d+)\.xml"):
        root = z.xml(name)
        for shape in (x for x in root.iter() if local(x.tag) in ("sp", "graphicFrame")) if root is not None else ():
            kind = attribute(first(shape, "ph"), "type") or ""
            if local(shape.tag) == "graphicFrame":
                for i, r in enumerate(x for x in shape.iter() if local(x.tag) == "tr"):
                    cells = [("" if attribute(c, "vMerge") in ("1", "true") else inner(c), whole(attribute(c, "gridSpan"))) for c in children(r, "tc") if attribute(c, "hMerge") not in ("1", "true")]
                    yield "table_row", i, row_text(cells)
                continue
            for p in (x for x in shape.iter() if local(x.tag) == "p"):
                text = squeezed("".join(x.text or "" for x in p.iter() if local(x.tag) == "t"))
                properties = next(iter(children(p, "pPr")), None)
                listed = properties is not None and first(properties, "buChar", "buAutoNum") is not None or kind == "body" and attribute(properties, "lvl") is not None
                if "itle" in kind:
                    yield "heading", 1, text
                elif listed:
                    yield "list_item", 1 + whole(attribute(properties, "lvl"), 0), text
                else:
                    yield "paragraph", 0, text


def odf_blocks(z: Archive) -> Iterator[Block]:
    root = z.xml("content.xml")

    def walk(e, lists: int) -> Iterator[Block]:
        for c in e:
            tag = local(c.tag)
            if tag == "h":
                yield "heading", whole(attribute(c, "outline-level")), inner(c)
            elif tag == "p":
                yield ("list_item", lists, inner(c)) if lists else ("paragraph", 0, inner(c))
            elif tag == "table":
                n = 0
                for r in (x for x in c.iter() if local(x.tag) == "table-row"):
                    cells = [(" ".join(inner(p) for p in x.iter() if local(p.tag) == "p"), whole(attribute(x, "number-columns-spanned"))) for x in children(r, "table-cell")]
                    if any(t for t, _ in cells):
                        yield "table_row", n, row_text(cells)
                        n += 1
            elif tag not in ("annotation", "tracked-changes"):
                yield from walk(c, lists + (tag == "list"))

    if root is not None:
        yield from walk(next((x for x in root.iter() if local(x.tag) == "body"), root), 0)


def package_blocks(content: bytes) -> list[Block]:
    """SRC24: headings, paragraphs, list items by level and table rows of DOCX, PPTX and OpenDocument files; rows of XLSX sheets."""
    z = Archive(content)
    if "word/document.xml" in z.names:
        return kept(list(docx_blocks(z)))
    if "content.xml" in z.names:
        return kept(list(odf_blocks(z)))
    if "xl/workbook.xml" in z.names:
        rows: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for sheet, row, col, _, _, text in xlsx_cells(content):
            rows.setdefault((sheet, row), []).append((col, text))
        return [("table_row", row, " | ".join(t for _, t in sorted(cells))) for (_, row), cells in rows.items()]
    return kept(list(pptx_blocks(z)))


# --- PDF ----------------------------------------------------------------------------------------------------------------------------

PDF_TOKEN = re.compile(rb"<<|>>|\[|\]|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%{}]*|[^\s<>\[\]()/%{}]+")


def pdf_string(raw: bytes, at: int) -> tuple[bytes, int]:
    """Bytes and end of the literal string that begins at ``at``."""
    out, depth, i = bytearray(), 1, at + 1
    plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
    while i < len(raw):
        c = raw[i]
        if c == 0x5C and i + 1 < len(raw):
            m = re.compile(rb"[0-7]{1,3}").match(raw, i + 1)
            if m:
                out.append(int(m[0], 8) & 255)
                i = m.end()
            elif raw[i + 1] in (10, 13):
                i += 3 if raw[i + 1 : i + 3] == b"\r\n" else 2
            else:
                out.append(plain.get(raw[i + 1], raw[i + 1]))
                i += 2
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            return bytes(out), i + 1
        out.append(c)
        i += 1
    return bytes(out), i


def pdf_tokens(raw: bytes) -> Iterator[bytes | tuple[str, bytes]]:
    """Names, numbers and operators as bytes, strings as ``("s", bytes)``; comments are left out."""
    at = 0
    while at < len(raw):
        c = raw[at]
        if c == 0x28:
            text, at = pdf_string(raw, at)
            yield "s", text
        elif c == 0x25:
            m = re.compile(rb"[\r\n]").search(raw, at)
            at = m.end() if m else len(raw)
        elif m := PDF_TOKEN.match(raw, at):
            token, at = m[0], m.end()
            if token[:1] == b"<" and token != b"<<":
                digits = re.sub(rb"\s", b"", token[1:-1])
                yield "s", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                yield token
        else:
            at += 1


class Pdf:
    """Objects of a PDF file with plain or Flate streams; encrypted files have no text."""

    def __init__(self, raw: bytes) -> None:
        self.objects: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", raw):
            end = raw.find(b"endobj", m.end())
            body = raw[m.end() : end if end >= 0 else len(raw)]
            s = re.search(rb"stream\r?\n", body)
            number = int(m[1])
            if s:
                # a stream may hold the word itself, so its own length decides where it is given
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: s.start()])
                begin = m.end() + s.end()
                stop = begin + int(size[1]) if size else raw.find(b"endstream", begin)
                self.objects[number] = body[: s.start()]
                self.streams[number] = raw[begin : stop if stop >= 0 else len(raw)]
            else:
                self.objects[number] = body
        self.readable = b"/Encrypt" not in raw
        for number in [n for n, b in self.objects.items() if b"/ObjStm" in b]:
            data, head = self.data(number), self.objects[number]
            n, offset = self.number(head, b"N"), self.number(head, b"First")
            places = [int(x) for x in data[:offset].split()[: 2 * n]]
            for i in range(0, len(places) - 1, 2):
                stop = offset + places[i + 3] if i + 3 < len(places) else len(data)
                self.objects.setdefault(places[i], data[offset + places[i + 1] : stop])

    def number(self, body: bytes, key: bytes) -> int:
        m = re.search(rb"/" + key + rb"\s+(\d+)(\s+\d+\s+R)?", body)
        if m and m[2]:
            m = re.search(rb"(\d+)", self.objects.get(int(m[1]), b""))
        return int(m[1]) if m else 0

    def data(self, number: int) -> bytes:
        raw, head = self.streams.get(number, b""), self.objects.get(number, b"")
        if b"FlateDecode" in head:
            try:
                inflater = zlib.decompressobj()
                data = inflater.decompress(raw, MEMBER_BYTES)
            except zlib.error:
                return b""
            if inflater.unconsumed_tail:
                raise ValueError(f"a stream has more than {MEMBER_BYTES} bytes")
            return data
        return b"" if b"/Filter" in head else raw

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """Objects that a key refers to, one or an array."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def dictionary(self, body: bytes, key: bytes) -> bytes:
        """A dictionary below a key, by itself or by reference."""
        m = re.search(rb"/" + key + rb"\s*(<<|(\d+)\s+\d+\s+R)", body)
        if not m:
            return b""
        if m[2]:
            return self.objects.get(int(m[2]), b"")
        depth = 0
        for x in re.compile(rb"<<|>>").finditer(body, m.start(1)):
            depth += 1 if x[0] == b"<<" else -1
            if not depth:
                return body[m.start(1) : x.end()]
        return body[m.start(1) :]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """Page objects in order, each with the resources that count for it."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        stack = [(n, b"") for n in self.refs(root, b"Pages")]
        out, seen = [], set()
        while stack:
            n, above = stack.pop()
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            own = self.dictionary(body, b"Resources") or above
            kids = self.refs(body, b"Kids")
            if re.search(rb"/Type\s*/Pages\b", body):
                stack += [(k, own) for k in reversed(kids)]
            elif body:
                out.append((body, own))
        return out

    def unicode_map(self, font: bytes) -> dict[bytes, str]:
        """Text by code of a font with a ToUnicode table."""
        out: dict[bytes, str] = {}
        for n in self.refs(font, b"ToUnicode"):
            table = self.data(n)
            text = lambda b: bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
                out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    low, high, size = int(a, 16), int(b, 16), len(a) // 2
                    begin = text(c)
                    for i in range(min(high - low + 1, 65_536)):
                        out[(low + i).to_bytes(size, "big")] = begin[:-1] + chr(ord(begin[-1]) + i) if begin else ""
        return out


def decoded(text: bytes, table: dict[bytes, str]) -> str:
    if not table:
        return text.decode("utf-16-be", "replace")[1:] if text[:2] == b"\xfe\xff" else text.decode("cp1252", "replace")
    size = max(map(len, table))
    return "".join(table.get(text[i : i + size], "") for i in range(0, len(text), size))


def pdf_lines(content: bytes) -> list[tuple[int, float, float, float, str]]:
    """SRC10, SRC27: ``(page, x, y, size, text)`` of the text lines in drawing order; pages count from 1, y from the bottom.

    Text of plain and Flate streams; scanned, encrypted and other files have none.
    """
    pdf = Pdf(content)
    out: list[tuple[int, float, float, float, str]] = []
    if not pdf.readable:
        return out
    for no, (page, resources) in enumerate(pdf.pages(), 1):
        fonts = pdf.dictionary(resources, b"Font")
        tables = {name: pdf.unicode_map(pdf.objects.get(int(n), b"")) for name, n in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", fonts)}
        stack: list = []
        line = [0.0, 0.0]
        lead, size, scale, table = 0.0, 0.0, 1.0, {}
        lines: list[list] = []

        def number(i: int, stack: list = stack) -> float:
            try:
                return float(stack[i])
            except (ValueError, TypeError, IndexError):
                return 0.0

        def show(parts: list, lines: list = lines) -> None:
            text = "".join(decoded(p[1], table) if isinstance(p, tuple) else " " if p < -200 else "" for p in parts)
            same = lines and abs(lines[-1][1] - line[1]) < 0.5 and lines[-1][2] == size * scale
            if same:
                lines[-1][3] += text
            else:
                lines.append([line[0], line[1], size * scale, text])

        for token in pdf_tokens(b"\n".join(pdf.data(n) for n in pdf.refs(page, b"Contents"))):
            if isinstance(token, tuple) or re.fullmatch(rb"[-+.\d]+|/.*|\[|\]", token):
                stack.append(token)
                continue
            if token == b"Tf" and len(stack) > 1:
                table, size = tables.get(stack[-2][1:] if isinstance(stack[-2], bytes) else b"", {}), number(-1)
            elif token == b"BT":
                line, scale = [0.0, 0.0], 1.0
            elif token in (b"Td", b"TD"):
                line = [line[0] + number(-2) * scale, line[1] + number(-1) * scale]
                lead = -number(-1) if token == b"TD" else lead
            elif token == b"Tm":
                line, scale = [number(-2), number(-1)], abs(number(-3)) or 1.0
            elif token == b"TL":
                lead = number(-1)
            elif token in (b"T*", b"'", b'"'):
                line = [line[0], line[1] - lead * scale]
            if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], tuple):
                show([stack[-1]])
            elif token == b"TJ":
                show([x if isinstance(x, tuple) else float(x) for x in stack if isinstance(x, tuple) or re.fullmatch(rb"-?\d*\.?\d+", x)])
            stack.clear()
        out += [(no, x, y, s, squeezed(t)) for x, y, s, t in lines if t.strip()]
    return out


def pdf_blocks(content: bytes) -> list[Block]:
    """SRC10: lines gathered to paragraphs by their distance, larger ones as headings, with a marker block for each page."""
    lines = pdf_lines(content)
    if not lines:
        return []
    sizes: dict[float, int] = {}
    for *_, size, text in lines:
        sizes[round(size, 1)] = sizes.get(round(size, 1), 0) + len(text)
    body = max(sizes, key=lambda s: (sizes[s], -s))
    larger = sorted((s for s in sizes if s > 1.1 * body), reverse=True)
    out: list[Block] = []
    page, last = 0, (0.0, 0.0)
    for no, _, y, size, text in lines:
        if no != page:
            out.append(("page", no, f"page {no}"))
            page, last = no, (0.0, 0.0)
        s = round(size, 1)
        near = last[1] == s and 0 <= last[0] - y <= 1.6 * s
        if near and out[-1][0] != "page":
            out[-1] = (*out[-1][:2], out[-1][2].removesuffix("-") + ("" if out[-1][2].endswith("-") else " ") + text)
        else:
            out.append(("heading", min(6, larger.index(s) + 1), text) if s in larger else ("paragraph", 0, text))
        last = (y, s)
    return out
