"""The dispatch table of readers: one operator for a column of files of any known format."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions import markdown_blocks
from strataquill.sources import documents, files, markup_readers, packages
from strataquill.sources.documents import Block


def markdown_reader(text: str) -> list[Block]:
    return [(b.kind, b.level or 0, b.text) for b in markdown_blocks.blocks(text) if b.kind != "marker" and b.text.strip()]


def text_reader(text: str) -> list[Block]:
    return [("paragraph", 0, " ".join(p.split())) for p in text.replace("\r", "").split("\n\n") if p.strip()]


def csv_reader(text: str) -> list[Block]:
    import csv
    import io

    return [("table_row", i, " | ".join(r)) for i, r in enumerate(csv.reader(io.StringIO(text), delimiter=files.sniffed(text)))]


def xml_reader(text: str) -> list[Block]:
    """XML by its root element."""
    for reader in (markup_readers.patent_blocks, markup_readers.xbrl_blocks):
        if found := reader(text):
            return found
    root = markup_readers.parsed(text)
    name = "" if root is None else markup_readers.local(root.tag)
    return markup_readers.doclang_blocks(text) if name in ("doclang", "doctag") else markup_readers.jats_blocks(text)


#: Readers of texts and of bytes by format; formats of models (images, sound, film) are in ``operators.models``.
TEXT_READERS: dict[str, Callable[[str], list[Block]]] = {
    "markdown": markdown_reader, "text": text_reader, "html": documents.html_blocks, "csv": csv_reader, "webvtt": documents.webvtt_blocks, "email": documents.email_blocks,
    "asciidoc": documents.asciidoc_blocks, "latex": markup_readers.latex_blocks, "boxnote": markup_readers.boxnote_blocks, "jats": markup_readers.jats_blocks, "uspto": markup_readers.patent_blocks,
    "xbrl": markup_readers.xbrl_blocks, "doclang": markup_readers.doclang_blocks, "xml": xml_reader,
}
BYTE_READERS: dict[str, Callable[[bytes], list[Block]]] = {
    "pdf": packages.pdf_blocks, "epub": packages.epub_blocks, **dict.fromkeys(("docx", "pptx", "xlsx", "odt", "odp", "ods", "zip"), packages.package_blocks),
}


def blocks_of(kind: str | None, content: bytes | None) -> list[Block]:
    """Blocks of one file; none for a null, an unknown format or a broken file."""
    if content is None:
        return []
    if kind in BYTE_READERS:
        return BYTE_READERS[kind](content)
    reader = TEXT_READERS.get(kind or "")
    return reader(content.decode("utf-8-sig", "replace")) if reader else []


def converted(rows: DataFrame, key: str, kind: str, content: str) -> DataFrame:
    """``(key, format, block_no, kind, level, text)`` of files with their formats (column ``kind``) and bytes."""
    source = rows.select(key, F.col(kind).alias("format"), content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, f, i, *x) for k, f, c in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, x in enumerate(blocks_of(f, c))]
            kinds = (b.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[key, "format", "block_no", "kind", "level", "text"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, format string, block_no int, kind string, level int, text string")
