"""Texts of structured formats as blocks: LaTeX, Box Notes, JATS, patents, XBRL, DocLang.

Each reader is a function of one text that gives blocks ``(kind, level, text)``
in document order; what can't be parsed gives no block. Blank texts of blocks
are left out, runs of white space are one blank but in code and formulas.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from strataquill.sources.documents import Block, html_blocks


def squeezed(text: str) -> str:
    return " ".join(text.split())


def kept(blocks: list[Block]) -> list[Block]:
    return [b for b in blocks if b[2].strip()]


# --- LaTeX --------------------------------------------------------------------------------------------------------------------------

#: Depths of LaTeX's sections.
TEX_DEPTHS = {"part": -1, "chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
TEX_LISTS = frozenset("itemize enumerate description".split())
TEX_CODE = frozenset("verbatim lstlisting minted".split())
TEX_FORMULAS = frozenset("equation align alignat gather multline eqnarray displaymath flalign".split())
TEX_TABLES = frozenset("tabular array longtable tabularx".split())
TEX_SILENT = frozenset("label cite citep citet index vspace hspace usepackage documentclass bibliography bibliographystyle input include newcommand renewcommand centering maketitle tableofcontents".split())
TEX_TOKEN = re.compile(r"\\begin\{(?P<begin>[A-Za-z]+\*?)\}|\\end\{(?P<end>[A-Za-z]+\*?)\}|\\(?P<name>[A-Za-z]+)\*?|\\(?P<sign>[^A-Za-z])|(?P<blank>\n[ \t]*\n\s*)|(?P<display>\$\$|\\\[)|(?P<inline>\$)|(?P<brace>[{}])|(?P<tie>~)")


def tex_group(text: str, at: int) -> tuple[str, int]:
    """Content and end of the brace or bracket group at ``at``; ``('', at)`` where there is none."""
    pair = {"{": "}", "[": "]"}.get(text[at : at + 1])
    if not pair:
        return "", at
    depth = 0
    for m in re.compile(r"\\.|[{}\[\]]", re.S).finditer(text, at):
        if m[0] == text[at]:
            depth += 1
        elif m[0] == pair:
            depth -= 1
            if not depth:
                return text[at + 1 : m.start()], m.end()
    return text[at + 1 :], len(text)


def tex_plain(text: str) -> str:
    """Inline LaTeX as text; formulas stay."""
    text = re.sub(r"\\href\{[^{}]*\}", "", text)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    text = re.sub(r"\\(?:" + "|".join(TEX_SILENT) + r")\*?(?:\[[^\[\]]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\([%&#_{}$])", "\x00\\1", text)
    text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\[\]]*\])?|(?<!\x00)[{}]", "", text)
    return squeezed(text.replace("\x00", "").replace("~", " ").replace("\\\\", " "))


def latex_blocks(text: str) -> list[Block]:
    """SRC23: headings (levels from the shallowest that is used), paragraphs, list items, code, formulas, table rows."""
    text = re.sub(r"(?<!\\)%[^\n]*\n?", "", text)
    out: list[Block] = []
    title = re.search(r"\\title\b", text)
    if title:
        out.append(("heading", 1, tex_plain(tex_group(text, title.end())[0])))
    body = re.search(r"\\begin\{document\}([\s\S]*?)(?:\\end\{document\}|\Z)", text)
    text = body[1] if body else text
    top = min((TEX_DEPTHS[n] for n in re.findall(r"\\([a-z]+)\*?[\[{]", text) if n in TEX_DEPTHS), default=1)
    base = 2 if title else 1
    parts: list[str] = []
    lists: list[str] = []
    item = False

    def flush() -> None:
        nonlocal item
        out.append(("list_item", len(lists), tex_plain("".join(parts))) if item else ("paragraph", 0, tex_plain("".join(parts))))
        parts.clear()
        item = False

    at = 0
    while m := TEX_TOKEN.search(text, at):
        parts.append(text[at : m.start()])
        at = m.end()
        name = (m["begin"] or "").rstrip("*")
        if name in TEX_CODE | TEX_FORMULAS | TEX_TABLES or m["display"] or m["sign"] == "[":
            flush()
            close = f"\\end{{{m['begin']}}}" if name else "$$" if m["display"] == "$$" else "\\]"
            stop = text.find(close, at)
            inner, at = (text[at:stop], stop + len(close)) if stop >= 0 else (text[at:], len(text))
            if name in TEX_TABLES:
                while inner[:1] in ("{", "["):
                    inner = inner[tex_group(inner, 0)[1] :]
                rows = [r for r in re.split(r"\\\\", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", inner)) if r.strip()]
                out += [("table_row", i, " | ".join(tex_plain(c) for c in re.split(r"(?<!\\)&", r))) for i, r in enumerate(rows)]
            else:
                out.append(("code" if name in TEX_CODE else "formula", 0, inner.strip()))
        elif m["begin"] or m["end"]:
            flush()
            if name in TEX_LISTS:
                lists.append(name)
            elif m["end"] and m["end"].rstrip("*") in TEX_LISTS and lists:
                lists.pop()
        elif m["name"] == "item":
            flush()
            item = True
        elif m["name"] in TEX_DEPTHS or m["name"] == "caption":
            flush()
            _, at = tex_group(text, at) if text[at : at + 1] == "[" else ("", at)
            inner, at = tex_group(text, at)
            out.append(("heading", min(6, TEX_DEPTHS[m["name"]] - top + base), tex_plain(inner)) if m["name"] in TEX_DEPTHS else ("caption", 0, tex_plain(inner)))
        elif m["name"] == "title":
            _, at = tex_group(text, at)
        elif m["blank"]:
            flush()
        else:
            parts.append(m[0])
    parts.append(text[at:])
    flush()
    return kept(out)


# --- Box Notes ----------------------------------------------------------------------------------------------------------------------


def _note_text(node: dict) -> str:
    if node.get("type") == "text":
        return node.get("text") or ""
    if node.get("type") == "hard_break":
        return " "
    return "".join(_note_text(c) for c in node.get("content") or ())


def boxnote_blocks(text: str) -> list[Block]:
    """SRC23: the node tree of a note; notes of the old schema give nothing."""
    try:
        doc = json.loads(text).get("doc")
    except (json.JSONDecodeError, AttributeError):
        return []
    out: list[Block] = []
    stack: list[tuple[dict, int]] = [(doc, 0)] if isinstance(doc, dict) else []
    while stack:
        node, depth = stack.pop()
        kind, inner = node.get("type"), [c for c in node.get("content") or () if isinstance(c, dict)]
        if kind == "heading":
            out.append(("heading", int((node.get("attrs") or {}).get("level") or 1), squeezed(_note_text(node))))
        elif kind == "paragraph":
            out.append(("list_item" if depth else "paragraph", depth, squeezed(_note_text(node))))
        elif kind == "code_block":
            out.append(("code", 0, _note_text(node).strip()))
        elif kind == "table":
            out += [("table_row", i, " | ".join(squeezed(_note_text(c)) for c in r.get("content") or ())) for i, r in enumerate(inner)]
        else:
            deeper = depth + (kind in ("bullet_list", "ordered_list", "check_list"))
            stack += [(c, deeper) for c in reversed(inner)]
    return kept(out)


# --- XML ----------------------------------------------------------------------------------------------------------------------------


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def parsed(text: str):
    """Root of an XML text without its document type (entities other than XML's own are dropped); None where it's broken."""
    bare = re.sub(r"<!DOCTYPE[^\[>]*(?:\[[\s\S]*?\]\s*)?>|&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)\w+;", "", text).lstrip("﻿ \n\r\t")
    try:
        return ElementTree.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", bare))
    except ElementTree.ParseError:
        return None


def inner(e) -> str:
    return squeezed("".join(e.itertext()))


def children(e, *names: str) -> list:
    return [c for c in e if local(c.tag) in names]


def outer(e, without) -> str:
    """Text of an element without that of children of these names."""
    return squeezed("".join([e.text or "", *((c.tail or "") if local(c.tag) in without else "".join(c.itertext()) + (c.tail or "") for c in e)]))


def table_blocks(e) -> Iterator[Block]:
    rows = [r for r in e.iter() if local(r.tag) in ("tr", "row")]
    for i, r in enumerate(rows):
        yield "table_row", i, " | ".join(inner(c) for c in r if local(c.tag) in ("td", "th", "entry"))


NESTED = ("list", "disp-formula", "table-wrap", "fig")


def jats_blocks(text: str) -> list[Block]:
    """SRC25: title, authors, abstract, sections, lists, tables, formulas, captions and references of an article."""
    root = parsed(text)
    out: list[Block] = []
    if root is None:
        return out

    def walk(e, depth: int, lists: int) -> None:
        tag = local(e.tag)
        if tag == "article-title":
            out.append(("heading", 1, inner(e)))
        elif tag == "contrib":
            names = [n for n in e.iter() if local(n.tag) in ("surname", "given-names")]
            out.append(("author", 0, squeezed(" ".join(inner(n) for n in sorted(names, key=lambda n: local(n.tag))))))
        elif tag == "title":
            out.append(("heading", max(2, depth), inner(e)))
        elif tag == "list-item":
            for c in e:
                if local(c.tag) == "list":
                    walk(c, depth, lists)
                else:
                    out.append(("list_item", lists, inner(c)))
        elif tag in ("table-wrap", "fig"):
            out.extend(("caption", 0, " ".join(inner(x) for x in (*children(e, "label"), c))) for c in children(e, "caption"))
            out.extend(table_blocks(e))
        elif tag in ("disp-formula", "tex-math"):
            tex = next((x for x in e.iter() if local(x.tag) == "tex-math"), e)
            out.append(("formula", 0, "".join(tex.itertext()).strip()))
        elif tag == "ref":
            out.append(("reference", 0, " ".join(inner(c) for c in e if local(c.tag) != "label")))
        elif tag == "p":
            out.append(("paragraph", 0, outer(e, NESTED)))
            for c in children(e, *NESTED):
                walk(c, depth, lists)
        elif tag not in ("journal-meta", "permissions", "aff", "article-id", "pub-date"):
            for c in e:
                walk(c, depth + (tag in ("sec", "abstract", "ack", "app")), lists + (tag == "list"))

    walk(root, 1, 0)
    return kept(out)


#: By dialect of patent XML, elements of title, abstract, headings, paragraphs and claims.
PATENT_DIALECTS = {
    "us-patent-grant": ("invention-title", "abstract", "heading", "p", "claim"),
    "us-patent-application": ("invention-title", "abstract", "heading", "p", "claim"),
    "PATDOC": ("B540", "SDOAB", "H", "PARA", "CLM"),
    "patent-application-publication": ("title-of-invention", "subdoc-abstract", "heading", "paragraph", "claim"),
}


def patent_blocks(text: str) -> list[Block]:
    """SRC25: title, abstract, description, tables and claims of a patent, in three XML dialects and the tagged text of before 2002."""
    if re.match(r"\s*PATN\b", text):
        return tagged_patent_blocks(text)
    root = parsed(text)
    names = None if root is None else PATENT_DIALECTS.get(local(root.tag))
    if names is None:
        return []
    title, abstract, heading, paragraph, claim = names
    out: list[Block] = []

    def walk(e, inside: str) -> None:
        tag = local(e.tag)
        if tag == title:
            out.append(("heading", 1, inner(e)))
        elif tag == heading:
            level = next((v for k, v in e.attrib.items() if k.lower() in ("level", "lvl")), "1")
            out.append(("heading", 1 + (int(level) if level.isdigit() else 1), inner(e)))
        elif tag == claim:
            out.append(("claim", 0, inner(e)))
        elif tag in ("table", "tgroup"):
            out.extend(table_blocks(e))
        elif tag == paragraph:
            out.append(("abstract" if inside else "paragraph", 0, outer(e, ("tables", "table"))))
            for x in children(e, "tables", "table"):
                out.extend(table_blocks(x))
        else:
            for c in e:
                walk(c, inside or (tag if tag == abstract else ""))

    walk(root, "")
    return kept(out)


def tagged_patent_blocks(text: str) -> list[Block]:
    """Lines of a four-letter section or a field and its text; further lines are indented."""
    out: list[Block] = []
    section, field, parts = "", "", []

    def flush() -> None:
        value = squeezed(" ".join(parts))
        if section == "PATN" and field == "TTL":
            out.append(("heading", 1, value))
        elif field == "PAC":
            out.append(("heading", 2, value))
        elif section == "ABST" and field.startswith("PA"):
            out.append(("abstract", 0, value))
        elif section in ("CLMS", "DCLM") and field.startswith("PA"):
            out.append(("claim", 0, value))
        elif section in ("BSUM", "DETD", "DRWD", "GOVT", "PARN") and field.startswith("PA"):
            out.append(("paragraph", 0, value))

    for line in text.split("\n"):
        m = re.match(r"([A-Z][A-Z0-9]{2,3})(?:\s+(.*))?\s*$", line)
        if m:
            flush()
            parts = [m[2] or ""]
            if m[2] is None and len(m[1]) == 4:
                section, field = m[1], ""
            else:
                field = m[1]
        else:
            parts.append(line)
    flush()
    return kept(out)


def xbrl_facts(text: str) -> list[tuple[str, str, str, str]]:
    """``(concept, value, period, unit)`` of an instance's facts, in order."""
    root = parsed(text)
    if root is None or local(root.tag) != "xbrl":
        return []
    periods, units = {}, {}
    for e in root:
        if local(e.tag) == "context":
            dates = [inner(x) for x in e.iter() if local(x.tag) in ("instant", "startDate", "endDate")]
            members = [inner(x) for x in e.iter() if local(x.tag) in ("explicitMember", "typedMember")]
            periods[e.get("id")] = "/".join(dates) + "".join(f" [{m}]" for m in members)
        elif local(e.tag) == "unit":
            units[e.get("id")] = "/".join(inner(x).split(":")[-1] for x in e.iter() if local(x.tag) == "measure")
    return [(local(e.tag), "".join(e.itertext()).strip(), periods.get(e.get("contextRef"), ""), units.get(e.get("unitRef"), "")) for e in root.iter() if e.get("contextRef")]


def xbrl_blocks(text: str) -> list[Block]:
    """SRC25: facts as ``concept = value unit (period)``; facts that hold HTML as its blocks."""
    out: list[Block] = []
    for concept, value, period, unit in xbrl_facts(text):
        if re.search(r"<[A-Za-z][^<>]*>", value):
            out += [("heading", 2, concept), *html_blocks(value)]
        else:
            out.append(("fact", 0, squeezed(f"{concept} = {value} {unit}") + f" ({period})"))
    return kept(out)


#: Cells of a DocLang table; the last ends a row.
DOCLANG_CELLS = frozenset("fcel ched rhed srow ecel lcel ucel xcel nl".split())

DOCLANG_LISTS = ("list", "unordered_list", "ordered_list")


def doclang_blocks(text: str) -> list[Block]:
    """SRC25: titles, headings, texts, lists, code, formulas, captions and tables."""
    root = parsed(text)
    out: list[Block] = []
    if root is None:
        return out

    def rows(e) -> Iterator[Block]:
        row: list[str] = []
        n = 0
        for c in e:
            tag = local(c.tag)
            if tag == "nl":
                yield "table_row", n, " | ".join(row)
                row, n = [], n + 1
            elif tag in DOCLANG_CELLS:
                row.append(squeezed("".join(c.itertext()) + (c.tail or "")))
        if row:
            yield "table_row", n, " | ".join(row)

    def walk(e, lists: int) -> None:
        tag = local(e.tag)
        if tag == "title":
            out.append(("heading", 1, inner(e)))
        elif tag in ("heading", "section_header"):
            level = e.get("level", "1")
            out.append(("heading", 1 + (int(level) if level.isdigit() else 1), inner(e)))
        elif tag in ("text", "paragraph", "footnote"):
            out.append(("paragraph", 0, inner(e)))
        elif tag in ("list_item", "list_text"):
            out.append(("list_item", max(1, lists), outer(e, DOCLANG_LISTS)))
            for c in children(e, *DOCLANG_LISTS):
                walk(c, lists)
        elif tag in ("code", "formula"):
            out.append((tag, 0, "".join(e.itertext()).strip()))
        elif tag == "caption":
            out.append(("caption", 0, inner(e)))
        elif tag in ("otsl", "table") and any(local(c.tag) in DOCLANG_CELLS for c in e):
            out.extend(("caption", 0, inner(c)) for c in children(e, "caption"))
            out.extend(rows(e))
        else:
            for c in e:
                walk(c, lists + (tag in DOCLANG_LISTS))

    walk(root, 0)
    return kept(out)
