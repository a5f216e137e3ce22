"""Top-level Markdown blocks of one text: a line scanner after the CommonMark and GFM block rules.

Lines are what splitting on a line feed gives; spans are half open and count
from 0. Fences, HTML blocks, lists, quotes and indented code hide what looks
like a heading or a table inside them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MARKER = re.compile(r"\s*<!-- PDF page ([1-9]\d*) -->\s*")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\r?$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\r?$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\r?$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|\r?$)")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\r?$")
HTML_OPEN = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
)
#: Names that open an HTML block which a blank line ends.
BLOCK_NAMES = "address article aside base blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
HTML_BLOCK = re.compile(r" {0,3}</?(?:" + "|".join(BLOCK_NAMES) + r")(?:\s|/?>|$)", re.I)
HTML_ALONE = re.compile(r" {0,3}<(?:/[A-Za-z][\w-]*\s*|[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?)>\s*$")


class Block(NamedTuple):
    kind: str  # heading, table, fence, code, html, list, quote, rule, paragraph, marker
    start: int
    end: int
    level: int
    text: str


def blank(line: str) -> bool:
    return not line.strip()


def indent(line: str) -> int:
    width = 0
    for ch in line:
        if ch == " ":
            width += 1
        elif ch == "\t":
            width += 4 - width % 4
        else:
            break
    return width


def cells(line: str) -> int:
    """Number of cells of a pipe row."""
    row = re.sub(r"\\\|", "", line.strip())
    return row.removeprefix("|").removesuffix("|").count("|") + 1


def starts_block(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = ITEM.match(line)
    return bool(
        ATX.match(line)
        or FENCE.match(line)
        or RULE.match(line)
        or line.lstrip().startswith(">") and indent(line) < 4
        or item and item.group(3).strip("\r") != "" and item.group(2)[:-1] in ("", "1")
        or HTML_BLOCK.match(line)
        or any(p.match(line) for p, _ in HTML_OPEN)
    )


def blocks(text: str) -> list[Block]:
    lines = text.split("\n")
    n, at, out = len(lines), 0, []
    while at < n:
        line = lines[at]
        if blank(line):
            at += 1
            continue
        start = at
        if m := MARKER.fullmatch(line):
            out.append(Block("marker", at, at + 1, int(m.group(1)), line))
            at += 1
            continue
        if indent(line) >= 4:
            at += 1
            while at < n and (blank(lines[at]) or indent(lines[at]) >= 4):
                at += 1
            while blank(lines[at - 1]):
                at -= 1
            out.append(Block("code", start, at, 0, ""))
            continue
        if m := ATX.match(line):
            out.append(Block("heading", at, at + 1, len(m.group(1)), (m.group(2) or "").strip()))
            at += 1
            continue
        if (m := FENCE.match(line)) and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            mark = m.group(1)
            close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*\r?$")
            at += 1
            while at < n and not close.match(lines[at]):
                at += 1
            at = min(n, at + 1)
            out.append(Block("fence", start, at, 0, ""))
            continue
        if RULE.match(line):
            out.append(Block("rule", at, at + 1, 0, ""))
            at += 1
            continue
        html_end = next((e for p, e in HTML_OPEN if p.match(line)), None)
        if html_end is not None:
            while at < n and not html_end.search(lines[at]):
                at += 1
            at = min(n, at + 1)
            out.append(Block("html", start, at, 0, ""))
            continue
        if HTML_BLOCK.match(line) or HTML_ALONE.match(line):
            while at < n and not blank(lines[at]):
                at += 1
            out.append(Block("html", start, at, 0, ""))
            continue
        if line.lstrip().startswith(">"):
            at += 1
            while at < n and not blank(lines[at]) and (lines[at].lstrip().startswith(">") or not starts_block(lines[at])):
                at += 1
            out.append(Block("quote", start, at, 0, ""))
            continue
        if m := ITEM.match(line):
            at = _list_end(lines, at, m)
            out.append(Block("list", start, at, 0, ""))
            continue
        if "|" in line and at + 1 < n and DELIMITER.match(lines[at + 1]) and cells(line) == cells(lines[at + 1]) and ("|" in lines[at + 1] or cells(line) > 1):
            at += 2
            while at < n and not blank(lines[at]) and not starts_block(lines[at]) and not MARKER.fullmatch(lines[at]):
                at += 1
            out.append(Block("table", start, at, 0, "\n".join(lines[start:at])))
            continue
        at += 1
        heading = 0
        while at < n and not blank(lines[at]) and not MARKER.fullmatch(lines[at]):
            if m := SETEXT.match(lines[at]):
                heading = 1 if m.group(1)[0] == "=" else 2
                break
            if starts_block(lines[at]):
                break
            at += 1
        if heading:
            out.append(Block("heading", start, at + 1, heading, " ".join(x.strip() for x in lines[start:at])))
            at += 1
        else:
            out.append(Block("paragraph", start, at, 0, ""))
    return out


def _list_end(lines: list[str], at: int, first: re.Match) -> int:
    """End of the list that begins at ``at``: items, their indented lines and lazy paragraph lines."""
    n, kind = len(lines), first.group(2)[-1]
    content = len(first.group(1)) + len(first.group(2)) + 1
    at, end, gap = at + 1, at + 1, False
    while at < n:
        line = lines[at]
        if blank(line):
            gap = True
            at += 1
            continue
        m = ITEM.match(line)
        if MARKER.fullmatch(line):
            break
        if indent(line) >= content:
            pass
        elif m and m.group(2)[-1] == kind and not RULE.match(line):
            content = len(m.group(1)) + len(m.group(2)) + 1
        elif gap or starts_block(line):
            break
        gap = False
        at += 1
        end = at
    return end


class Section(NamedTuple):
    ordinal: int
    level: int | None
    heading: str | None
    start: int
    end: int
    unheaded: bool


def kept_text(lines: list[str], start: int, end: int) -> str:
    """Lines of a span without page markers."""
    return "\n".join(x for x in lines[start:end] if not MARKER.fullmatch(x))


def section_ends(headings: list[Block], n_lines: int) -> list[int]:
    """The next heading of the same or a higher level, else the end of the text."""
    ends, open_ = [n_lines] * len(headings), []
    for i, h in enumerate(headings):
        while open_ and headings[open_[-1]].level >= h.level:
            ends[open_.pop()] = h.start
        open_.append(i)
    return ends


def terminal_sections(text: str, found: list[Block] | None = None) -> list[Section]:
    """Spans that hold the text between headings, in document order."""
    lines = text.split("\n")
    heads = [b for b in (blocks(text) if found is None else found) if b.kind == "heading"]
    if not heads:
        return [Section(0, None, None, 0, len(lines), True)]
    spans: list[tuple[int | None, str | None, int, int]] = []
    if kept_text(lines, 0, heads[0].start).strip():
        spans.append((None, None, 0, heads[0].start))
    ends = section_ends(heads, len(lines))
    for i, h in enumerate(heads):
        following = heads[i + 1] if i + 1 < len(heads) else None
        if following and following.level > h.level:
            if kept_text(lines, h.end, following.start).strip():
                spans.append((h.level, h.text, h.end, following.start))
        else:
            spans.append((h.level, h.text, h.end, ends[i]))
    return [Section(k, *s, False) for k, s in enumerate(spans)]


def page_range(markers: list[tuple[int, int]], start: int, end: int) -> tuple[int | None, int | None]:
    """First and last page of a span; nulls in a text without markers."""
    if not markers:
        return None, None
    first = next((p for line, p in reversed(markers) if line <= start), markers[0][1])
    inside = [p for line, p in markers if start <= line < end]
    return first, inside[-1] if inside else first
