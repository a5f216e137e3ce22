"""Leaf chunks of one Markdown text: whole blocks packed up to a size, with overlap between neighbours."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

from strataquill.functions import markdown_blocks as M

Count = Callable[[str], int]


class Unit(NamedTuple):
    text: str
    spans: tuple[tuple[int, int], ...]
    parts: tuple[M.Block, ...]
    kind: str  # packed, window, table


def windows(text: str, size: int, overlap: int, count: Count = len) -> list[str]:
    """Windows of ``size`` tokens, ``size - overlap`` apart, sliced from the text by the tokens' offsets; blank ones are left out.

    A counter without offsets counts code points.
    """
    spans = count.offsets(text) if hasattr(count, "offsets") else None
    n = len(text) if spans is None else len(spans)
    out, start = [], 0
    while True:
        end = min(start + size, n)
        part = text[start:end] if spans is None else text[spans[start][0] : spans[end - 1][1]] if end > start else ""
        if part.strip():
            out.append(part)
        if end >= n:
            return out
        start += size - overlap


def pack(lines: list[str], parts: list[M.Block], size: int, overlap: int, count: Count = len) -> list[Unit]:
    """Greedy packing of a section's blocks, then overlap by whole blocks.

    The size that decides is that of the joined text, blank lines between blocks
    included. A table beyond the size stays whole and alone; another block beyond
    it becomes windows. Overlap takes whole blocks from the end of the unit
    before (as it came out), never tables, windows or across them.
    """

    def joined(group: list[M.Block]) -> str:
        return M.kept_text(lines, group[0].start, group[-1].end)

    units: list[Unit] = []
    current: list[M.Block] = []

    def flush() -> None:
        if current:
            text = joined(current)
            if text.strip():
                units.append(Unit(text, ((current[0].start, current[-1].end),), tuple(current), "packed"))
            current.clear()

    for b in parts:
        text = joined([b])
        n = count(text)
        if not n:
            continue
        if n > size:
            flush()
            if b.kind == "table":
                units.append(Unit(text, ((b.start, b.end),), (b,), "table"))
            else:
                units += [Unit(w, ((b.start, b.end),), (), "window") for w in windows(text, size, overlap, count)]
            continue
        if current and count(joined([*current, b])) > size:
            flush()
        current.append(b)
    flush()
    out: list[Unit] = []
    for u in units:
        before = out[-1] if out else None
        head: list[M.Block] = []
        if overlap and before and before.kind == u.kind == "packed" and before.parts and u.parts:
            for b in reversed(before.parts):
                trial = [b, *head]
                if b.kind == "table" or count(joined(trial)) > overlap or count(joined(trial) + "\n\n" + u.text) > size:
                    break
                head = trial
        if head:
            text = joined(head) + "\n\n" + u.text
            u = Unit(text, ((head[0].start, head[-1].end), *u.spans), (*head, *u.parts), "packed")
        out.append(u)
    return out


def digest(prefix: str, record: dict) -> str:
    """Identity of a record: SHA-256 of its JSON with sorted keys and no blanks."""
    text = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return prefix + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def section_id(document_id: str, kind: str, level: int | None, start: int) -> str:
    return digest("sec_", {"document_id": document_id, "heading_level": level, "kind": kind, "source_start": start})


def leaves(document_id: str, text: str, size: int = 768, overlap: int = 96, count: Count = len) -> list[dict]:
    """The leaves of one document, in order."""
    lines = text.split("\n")
    found = M.blocks(text)
    markers = [(b.start, b.level) for b in found if b.kind == "marker"]
    heads = {b.end: b for b in found if b.kind == "heading"}
    out: list[dict] = []
    for s in M.terminal_sections(text, found):
        h = heads.get(s.start) if s.level is not None else None
        sec = section_id(document_id, "heading", h.level, h.start) if h else section_id(document_id, "document_root", None, 0)
        inside = [b for b in found if b.kind not in ("marker", "heading") and s.start <= b.start and b.end <= s.end]
        for u in pack(lines, inside, size, overlap, count):
            pages = [M.page_range(markers, a, b) for a, b in u.spans]
            first, last = min((p[0] for p in pages if p[0] is not None), default=None), max((p[1] for p in pages if p[1] is not None), default=None)
            leaf = {"document_id": document_id, "section_id": sec, "chunk_index": len(out), "page_start": first, "page_end": last, "content": u.text}
            leaf["chunk_id"] = digest("chk_", leaf)
            out.append(leaf | {"unit": u.kind, "section_ordinal": s.ordinal})
    return out
