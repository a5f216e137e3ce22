"""Markup residue in Markdown: HTML, wiki and LaTeX, by consensus paths of a host (problem 2).

1. Every page is parsed once into a tree of containers: elements, templates,
   tables, links, environments, commands. One pass finds the marks, a stack
   pairs them, so the time is linear in the text, closed or not.
2. A container's generalised path is the chain of labels from the page down to
   it: name and class without digits, a label that recurs closes the loop
   (``html:ul/html:li/html:ul`` is ``html:ul``), the nearest ``PATH_DEPTH``
   labels count. Its scores are how surely it is markup (known names, partners,
   attributes) and how much of it is running text (text density, for blocks
   less their link density).
3. The scores are votes. Spark sums them by host (the host of the manifest's
   ``source_url``) and path. A path wins where its mean certainty reaches
   ``SURE``; the content of a winner is kept where its mean text score reaches
   ``KEEP``. Paths seen fewer than ``MIN_VOTES`` times at a host follow the vote
   of all hosts.
4. Every page is extracted again by the winning paths of its host. Containers
   of winning paths are markup: their lines are reported, their marks converted,
   their content kept or dropped. Containers of other paths only look like
   markup and stay as they stand.

The lines of every page's containers are kept with their paths, so extracting
the lines again is a join with the winners and doesn't read the texts again.

Markdown's own marks, autolinks, backslash escapes, fenced and inline code,
formulas and page markers are no markup; they are passed over in the same scan.
Headings, lists, tables, links, quotations, code and formulas become Markdown.

Defined results: a null Markdown gives a null text and no lines; an empty one an
empty text; an element without an end is its tag alone, another construct that
isn't closed counts up to the end of its line; rows delivered again count once;
a document without a manifest row has the host ''.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.session import cut_lineage

KEEP, SURE, MIN_VOTES, PATH_DEPTH = 0.25, 0.5, 5, 8

#: HTML element names.
HTML_NAMES = frozenset(
    """
    a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption
    center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer
    form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark
    marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp
    script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time
    title tr track tt u ul var video wbr ref references nowiki gallery math poem syntaxhighlight onlyinclude includeonly noinclude
    """.split()
)
#: Elements without content.
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr references".split())
#: Elements that stand in lines of their own.
BLOCKS = frozenset(
    """
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form gallery h1 h2 h3
    h4 h5 h6 head header hgroup html li main menu nav ol p poem pre section summary syntaxhighlight table tbody td tfoot th thead tr ul
    """.split()
)
#: Elements that a start tag of the same row ends, and the elements that bound the search.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
BOUNDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",)}
#: HTML attributes that stand without a value.
BARE_ATTRIBUTES = "noshade|nowrap|checked|selected|disabled|readonly|multiple|hidden|compact|ismap|declare|defer|async|autoplay|controls|loop|muted|open|required|reversed|border|novalidate|download|itemscope"
#: Environments that hold formulas, and those that hold code.
FORMULAS = "equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign"
CODE_ENVIRONMENTS = frozenset("verbatim verbatim* lstlisting minted Verbatim".split())
#: Behaviour switches of wiki pages.
SWITCHES = "TOC|NOTOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NOINDEX|INDEX|HIDDENCAT|NOGALLERY|NOTITLECONVERT|DISAMBIG"

ATTRIBUTE = rf"""\s++(?:[A-Za-z_:@][\w:.@-]*+\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]+)|(?i:{BARE_ATTRIBUTES})(?=[\s/>]))"""
FENCE = re.compile(r"^ {0,3}(?P<f>`{3,}+(?!.*`)|~{3,}+).*$", re.M)
PAGE = re.compile(r"^[ \t]*<!-- PDF page .*?-->[ \t\r]*$", re.M)

#: Marks; none of them looks further than its own line, tag or attribute value.
MARK = re.compile(
    rf"""(?=[<&\\`${{\[~_='])(?:
    (?P<ticks>`++)
  | (?P<dollar>\$\$?)
  | (?P<display>\\[\[(])
  | (?P<auto><[A-Za-z][A-Za-z0-9+.-]{{1,31}}:[^\s<>]*> | <[\w.+-]+@[\w.-]+>)
  | (?P<comment><!-- | <!\[CDATA\[ | <![A-Za-z][^<>]*> | <\?[A-Za-z][^<>]*\?>)
  | (?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*(?::[A-Za-z][\w.-]*|-[\w.-]+)?)(?P<attr>(?:{ATTRIBUTE})*+)\s*+/?> | (?i:<(?P<loose>table|script|style)\b[^<>]*>))
  | (?P<entity>&(?:[A-Za-z][A-Za-z0-9]{{1,31}}|\#\d{{1,7}}|\#[xX][0-9A-Fa-f]{{1,6}});)
  | (?P<wtable>\{{\|)
  | (?P<template>\{{\{{(?=[\w\#:!/ ]))
  | (?P<wlink>\[\[(?=\s*[^\W\d]|\s*[:\#/]))
  | (?P<elink>\[(?:https?|ftp|mailto|news|irc):[^\s\[\]]+(?:[ \t][^\[\]\n]*)?\](?![(:]))
  | (?P<quotes>''++)
  | (?P<sign>(?<!~)~{{3,5}}(?!~))
  | (?P<switch>__(?:{SWITCHES})__)
  | (?P<whead>(?:^|(?<=\n))(?P<eq>={{1,6}})[ \t]*[^=\s][^\n]*?(?P=eq)[ \t\r]*(?=\n|\Z))
  | (?P<env>\\begin\{{(?P<e>[A-Za-z]+\*?)\}})
  | (?P<command>\\(?:[A-Za-z]{{2,}}\*?|[A-Za-z](?=\{{)))
  | (?P<escape>\\[!-/:-@\[-`{{-~])
    )""",
    re.X,
)
#: What may close a mark, by name.
CLOSERS = {
    "-->": r"-->",
    "]]>": r"\]\]>",
    "display[": r"\\\]",
    "display(": r"\\\)",
    "blank": r"\n(?=\s*\n)",
    "script": r"(?i:</script\s*>)",
    "style": r"(?i:</style\s*>)",
    "nowiki": r"(?i:</nowiki\s*>)",
    "math": r"(?i:</math\s*>)",
    "syntaxhighlight": r"(?i:</syntaxhighlight\s*>)",
    "quotes": r"(?<=[^\s'])'{2,5}(?!')",
    "\n": r"\n",
}


def partners(text: str, opens: str, closes: str) -> dict[int, int]:
    """End of every balanced group by its start, in one pass; brackets balance within a line, what isn't closed is left out."""
    n = len(opens)
    # doubled marks count from the inner end of a run
    marks = re.compile(rf"{re.escape(opens[0])}{{{n},}}|{re.escape(closes[0])}{{{n},}}" + (r"|\n" if opens == "[" else ""))
    ends: dict[int, int] = {}
    stack: list[int] = []
    for m in marks.finditer(text):
        start, end = m.span()
        if text[start] == opens[0]:
            stack.extend(range(end - (end - start) // n * n, end, n))
        elif text[start] == closes[0]:
            for at in range(start + n, end + 1, n):
                if not stack:
                    break
                ends[stack.pop()] = at
        else:
            stack.clear()
    return ends


def code_spans(text: str) -> list[tuple[int, int]]:
    """Fenced code and page marker lines, half open."""
    spans = [(m.start(), m.end()) for m in PAGE.finditer(text)] if "<!-- PDF page " in text else []
    at = 0
    while m := FENCE.search(text, at):
        mark = m.group("f")
        close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t\r]*$", re.M).search(text, m.end() + 1)
        end = close.end() if close else len(text)
        spans.append((m.start(), end))
        at = max(end, m.end() + 1)
        if at >= len(text):
            break
    return sorted(spans)


class Page:
    """One text with the partners of its marks, each kind found once, when first asked for."""

    PAIRS = {"{{": "}}", "{": "}", "[": "]"}

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: dict[str, object] = {}

    def cached(self, key: str, make: Callable):
        if key not in self.found:
            self.found[key] = make()
        return self.found[key]

    def group_end(self, at: int, opens: str) -> int:
        """End of the balanced group that begins at ``at``; -1 where it isn't closed."""
        return self.cached("group" + opens, lambda: partners(self.text, opens, self.PAIRS[opens])).get(at, -1)

    def after(self, name: str, at: int, pattern: str | None = None) -> tuple[int, int] | None:
        """The first closing mark that starts at or after ``at``."""
        starts, ends = self.cached("close" + name, lambda: self.spans(pattern or CLOSERS[name]))
        i = bisect_left(starts, at)
        return (starts[i], ends[i]) if i < len(starts) else None

    def spans(self, pattern: str) -> tuple[list[int], list[int]]:
        spans = [m.span() for m in re.finditer(pattern, self.text)]
        return [a for a, _ in spans], [b for _, b in spans]

    def line_end(self, at: int) -> int:
        nxt = self.after("\n", at)
        return nxt[0] if nxt else len(self.text)

    def line_of(self, at: int) -> int:
        """Line breaks before ``at``."""
        return bisect_left(self.cached("close\n", lambda: self.spans("\n"))[0], at)

    def line_start(self, at: int) -> int:
        line = self.line_of(at)
        return self.found["close\n"][0][line - 1] + 1 if line else 0

    def paired(self, key: str, pattern: str) -> dict[int, tuple[int, int]]:
        """Closing mark by the start of its opening one; ``pattern`` has the groups ``open`` and ``name``."""

        def make() -> dict[int, tuple[int, int]]:
            out, stacks = {}, {}
            for m in re.finditer(pattern, self.text, re.M):
                stack = stacks.setdefault(m.group("name"), [])
                if m.group("open"):
                    stack.append(m.start("open"))
                elif stack:
                    out[stack.pop()] = (m.start("close"), m.end("close"))
            return out

        return self.cached("pairs" + key, make)


def arguments(page: Page, at: int) -> list[tuple[int, int]]:
    """Bracket and brace groups of a command that ends at ``at``."""
    out, text = [], page.text
    while at < len(text) and text[at] in "{[":
        end = page.group_end(at, text[at])
        if end < 0:
            break
        out.append((at, end))
        at = end
    return out


class Node:
    """A container: ``[start, end)`` with its content ``[a, b)``; ``close`` is the span of an element's end tag."""

    __slots__ = ("start", "a", "b", "end", "kind", "name", "attr", "args", "sure", "children", "path", "own", "text", "link", "solid", "close", "parts")

    def __init__(self, start: int, a: int, b: int, end: int, kind: str, name: str = "", attr: str = "", args=(), sure: float = 1.0) -> None:
        self.start, self.a, self.b, self.end = start, a, b, end
        self.kind, self.name, self.attr, self.args, self.sure = kind, name, attr, args, sure
        self.children: list[Node] = []
        self.close: tuple[int, int] | None = None
        self.path: tuple[str, ...] = ()
        self.text = self.link = self.solid = 0
        self.parts: list = []


def marks(page: Page) -> list[Node]:
    """The containers but for elements' extents: every tag is a node of its own here. In order of their starts, properly nested."""
    text, spans, k, at = page.text, code_spans(page.text), 0, 0
    out: list[Node] = []
    inside: list[Node] = []

    def add(node: Node) -> bool:
        if inside and node.end > inside[-1].b:
            return False  # crosses the container it stands in
        out.append(node)
        if node.a < node.b and node.kind not in ("tag", "comment", "raw", "code"):
            inside.append(node)
        return True

    while m := MARK.search(text, at):
        start, end = m.span()
        kind = m.lastgroup
        if inside and start >= inside[-1].b:
            at = max(at, inside.pop().end)
            continue
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] <= start:
            at = spans[k][1]
            continue
        at = end
        if kind == "ticks":
            same = page.cached("ticks", lambda: _runs(text, "`")).get(end - start, [])
            i = bisect_left(same, end)
            stop, blank = (same[i] if i < len(same) else -1), page.after("blank", end)
            at = stop + end - start if stop >= 0 and not (blank and blank[0] < stop) else end
        elif kind == "dollar":
            at = _formula_end(text, start, end)
        elif kind == "display":
            stop = page.after("display" + text[start + 1], end)
            at = stop[1] if stop else end
        elif kind == "comment":
            if end - start == 4 or text.startswith("<![", start):
                stop = page.after("-->" if end - start == 4 else "]]>", end)
                if stop is None and end - start != 4:
                    continue
                at = stop[1] if stop else page.line_end(start)
            if not add(Node(start, at, at, at, "comment")):
                at = end
        elif kind == "tag":
            name = (m["loose"] or m["name"]).lower()
            if name in ("script", "style") and text[start + 1] != "/" and (stop := page.after(name, end)) and add(Node(start, stop[1], stop[1], stop[1], "raw", name)):
                at = stop[1]
                continue
            attr = m["attr"] if m["name"] else text[start + 1 + len(name) : end - 1]
            sure = 1.0 if name in HTML_NAMES or ":" in name or attr else 0.2
            add(Node(start, end, end, end, "tag", ("/" if text[start + 1] == "/" else "") + name, attr or "", sure=sure if m["name"] else 0.0))
            if text[start + 1] != "/" and name in ("nowiki", "math", "syntaxhighlight") and text[end - 2] != "/" and (stop := page.after(name, end)):
                at = stop[0]
        elif kind == "entity":
            if html.unescape(m[0]) != m[0]:
                add(Node(start, end, end, end, "entity"))
        elif kind == "wtable":
            stop = page.paired("wtable", r"^[ \t>]*(?:(?P<open>\{\|)|(?P<close>\|\}))(?P<name>)").get(start)
            if stop:
                add(Node(start, end, stop[0], stop[1], "wtable"))
        elif kind == "template":
            stop = page.group_end(start, "{{")
            a, b, z = (end, stop - 2, stop) if stop > 0 else (end, page.line_end(start), page.line_end(start))
            add(Node(start, a, b, z, "template", re.compile(r"\s*([^\s|{}]*)").match(text, end, b).group(1).lower()))
        elif kind == "wlink":
            stop = page.group_end(start, "[")
            if stop > 0 and page.group_end(start + 1, "[") == stop - 1 and stop - start > 4:
                head = re.compile(r"\s*([^\[\]|\n]*)").match(text, end, stop - 2).group(1)
                add(Node(start, end, stop - 2, stop, "wlink", head.split(":", 1)[0].strip().lower() if ":" in head else "link"))
            else:
                at = start + 1
        elif kind == "elink":
            blank = re.compile(r"[ \t]").search(text, start, end)
            add(Node(start, blank.end() if blank else start + 1, end - 1, end, "elink"))
        elif kind == "quotes":
            stop = page.after("quotes", end + 1) if 2 <= end - start <= 5 and text[end : end + 1].strip() else None
            if stop and stop[0] < page.line_end(start):
                add(Node(start, end, stop[0], stop[1], "quotes"))
        elif kind in ("sign", "switch"):
            add(Node(start, end, end, end, kind))
        elif kind == "whead":
            n = len(m["eq"])
            b = start + len(m[0].rstrip()) - n
            at = start + n
            if not add(Node(start, at, b, end, "whead", str(n))):
                at = end
        elif kind == "env":
            name, base = m["e"], m["e"].rstrip("*")
            if base in FORMULAS.split("|") and (stop := page.after("end" + base, end, rf"\\end\{{{base}\*?\}}")):
                at = stop[1]
                continue
            if name in CODE_ENVIRONMENTS:
                stop = page.after("end" + name, end, rf"\\end\{{{re.escape(name)}\}}")
            else:
                stop = page.paired("env", r"(?:(?P<open>\\begin)|(?P<close>\\end(?=\{)))\{(?P<name>[A-Za-z]+\*?)\}").get(start)
                stop = stop and (stop[0], stop[1] + len(name) + 2)
            line = page.line_end(start)
            node = Node(start, end, *(stop or (line, line)), "code" if name in CODE_ENVIRONMENTS and stop else "env", name)
            if add(node) and node.kind == "code":
                at = node.end
        elif kind == "command":
            before, args = text[start - 1 : start] if start else "", arguments(page, end)
            if before and (before.isalnum() or before in ":\\/") and text[end : end + 1] not in ("{", "["):
                continue
            stop = args[-1][1] if args else end
            if not add(Node(start, end, stop, stop, "command", m[0][1:], args=args)):
                add(Node(start, end, end, end, "command", m[0][1:]))
    return out


def _runs(text: str, ch: str) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for m in re.finditer(re.escape(ch) + "++", text):
        out.setdefault(m.end() - m.start(), []).append(m.start())
    return out


def _formula_end(text: str, start: int, end: int) -> int:
    """End of the formula that a dollar sign begins; ``end`` where it begins none."""
    if end - start == 2:
        stop = text.find("$$", end)
        return stop + 2 if stop >= 0 else end
    before, first = text[start - 1 : start] if start else "", text[end : end + 1]
    if before and (before in "\\$" or before.isalnum() or before == "_") or not first.strip() or first == "$":
        return end
    stop = text.find("$", end)
    if stop < 0 or text.find("\n", end, stop) >= 0 or text[stop - 1].isspace():
        return end
    return end if (after := text[stop + 1 : stop + 2]) and (after == "$" or after.isdecimal()) else stop + 1


def pair_elements(page: Page, nodes: list[Node]) -> set[int]:
    """Gives every element its extent; returns the indexes of the end tags that belong to one.

    A table hides what was open before it. An element that may go without its end
    tag ends before the next of its row, at the end of its parent or at a blank line.
    """
    stack: list[int] = []
    frames: list[dict[str, list[int]]] = [{}]
    used: set[int] = set()

    def pop_to(depth: int, at: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            n = nodes[i]
            if n.name == "table":
                frames.pop()
            else:
                frames[-1][n.name].pop()
            if n.name in ENDED_BY and n.name != "option":
                blank = page.after("blank", n.start)
                n.b = n.end = max(n.a, min(at, blank[0] if blank else at))

    for i, n in enumerate(nodes):
        if n.kind != "tag":
            continue
        name = n.name
        if name[0] == "/":
            opens = frames[-1].get(name[1:])
            if name == "/table":
                opens = [frames[-1]["at"]] if len(frames) > 1 else None
            if not opens:
                continue
            depth = opens[-1] if name != "/table" else opens[0]
            o = nodes[stack[depth]]
            pop_to(depth + 1, n.start)
            stack.pop()
            frames.pop() if name == "/table" else opens.pop()
            o.b, o.end, o.close = n.start, n.end, (n.start, n.end)
            used.add(i)
            continue
        if name in VOID or page.text[n.end - 2] == "/":
            continue
        own = frames[-1]
        for other in ENDED_BY.get(name, ("p",) if name in BLOCKS else ()):
            opens = own.get(other)
            bound = max((own[x][-1] for x in BOUNDS.get(name, ()) if own.get(x)), default=-1)
            if opens and opens[-1] > bound:
                pop_to(opens[-1], n.start)
        if name == "table":
            frames.append({"at": len(stack)})
        else:
            own.setdefault(name, []).append(len(stack))
        stack.append(i)
    pop_to(0, len(page.text))
    return used


def tree(text: str) -> tuple[Page, Node, list[Node]]:
    """``(page, root, nodes)``; the nodes in order of their starts, with path, certainty and text counts."""
    page = Page(text)
    found = marks(page)
    used = pair_elements(page, found) if any(n.kind == "tag" for n in found) else set()
    root = Node(0, 0, len(text), len(text), "page")
    stack, nodes, taken = [root], [], set()
    for i, n in enumerate(found):
        while stack[-1] is not root and n.start >= stack[-1].b:
            stack.pop()
        if i in used and n.start in taken:
            continue
        if n.kind == "tag" and n.end > stack[-1].b and n.a < n.end:
            n.b = n.end = n.a  # its end tag stands outside the container that it stands in
            n.close = None
        if n.kind == "tag":
            if n.name == "table" and n.close:
                n.kind = "table"
            elif n.sure == 0.0:
                continue
            if n.close:
                taken.add(n.close[0])
                n.sure = max(n.sure, 0.6)
        label, above = label_of(n, page), stack[-1].path
        n.path = above[: above.index(label) + 1] if label in above else (*above, label)[-PATH_DEPTH:]
        stack[-1].children.append(n)
        nodes.append(n)
        if n.a < n.b:
            stack.append(n)
    for n in reversed(nodes):
        measure(n, page)
    return page, root, nodes


def label_of(n: Node, page: Page) -> str:
    """Name and class without digits."""
    if n.kind in ("env", "code", "command"):
        return re.sub(r"\d+", "", f"tex:env:{n.name.lower()}" if n.kind != "command" else f"tex:{n.name.lower()}")
    if n.kind in ("tag", "table", "raw", "comment", "entity"):
        of = re.search(r"""(?:^|\s)class\s*=\s*["']?\s*([A-Za-z][\w-]*)""", n.attr) if n.attr else None
        return re.sub(r"(?<!h)\d+", "", f"html:{n.name.lstrip('/') or n.kind}" + (f".{of.group(1).lower()}" if of else ""))
    return re.sub(r"\d+", "", f"wiki:template:{n.name}" if n.kind == "template" else f"wiki:{n.name}" if n.kind == "wlink" else f"wiki:{n.kind}")


#: What isn't running text in a container: keys, addresses, separators.
NO_TEXT = re.compile(r"https?:\S+|(?<![A-Za-z])[A-Za-z]++:[\w.-]++|(?<!\w)\w++\s*+=|[{}\[\]|&]")


def measure(n: Node, page: Page) -> None:
    """Counts letters and digits of the content's running text, those in links, and all that is no white space."""
    at = n.a
    for c in [*n.children, None]:
        gap = page.text[at : c.start if c else n.b]
        if gap:
            n.solid += len(gap) - sum(map(str.isspace, gap))
            n.text += sum(map(str.isalnum, NO_TEXT.sub(" ", gap)))
        if c:
            n.text, n.link, n.solid, at = n.text + c.text, n.link + c.link, n.solid + c.solid, c.end
    if n.kind in ("wlink", "elink") or n.kind == "tag" and n.name == "a" or n.kind == "command" and n.name in ("href", "url"):
        n.link = n.text


def text_score(n: Node) -> float:
    """How much of a container is running text."""
    if n.kind in ("comment", "raw", "sign", "switch"):
        return 0.0
    if n.kind in ("entity", "code", "whead", "quotes", "elink") or n.kind == "tag" and n.a >= n.b:
        return 1.0
    if n.kind in ("tag", "table", "wtable", "env"):
        return (1.0 - (n.link / n.text if n.name in BLOCKS or n.kind != "tag" else 0.0)) if n.text else float(n.solid > 0 or n.kind == "env")
    if n.kind == "command":
        return 1.0 if not n.solid else n.text / n.solid if n.name != "url" else 1.0
    return min(1.0, n.text / max(1, n.solid))


def running_text(text: str, start: int, end: int, kind: str) -> float:
    """Text score of the construct of that kind that begins at ``start``; 0 where there is none."""
    return next((text_score(n) for n in tree(text[start:end])[2] if n.kind == kind), 0.0)


def constructs(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, kind, name)`` of foreign markup, outermost, in order; an element's tags are constructs of their own."""
    last = 0
    for n in tree(text)[2]:
        for start, end in extents(n):
            if start >= last and n.sure >= SURE:
                last = end
                yield start, end, n.kind, n.name


def extents(n: Node) -> list[tuple[int, int]]:
    """What of the text a container's marks cover: an element's tags, all of another construct."""
    return [(n.start, n.a), *([n.close] if n.close else [])] if n.kind == "tag" else [(n.start, n.end)]


def summary(text: str) -> dict[str, list]:
    """Per path ``[containers, certainty, text score, line spans]``; spans are inclusive, merged, without page marker lines."""
    page, _, nodes = tree(text)
    out: dict[str, list] = {}
    for n in nodes:
        s = out.setdefault("/".join(n.path), [0, 0.0, 0.0, []])
        s[0], s[1], s[2] = s[0] + 1, s[1] + n.sure, s[2] + text_score(n)
        s[3] += [(page.line_of(a), page.line_of(b)) for a, b in extents(n)]
    skip = [page.line_of(m.start()) for m in PAGE.finditer(text)] if out and "<!-- PDF page" in text else []
    for s in out.values():
        s[3] = without(merged(s[3]), skip)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(spans: list[tuple[int, int]], gone: list[int]) -> list[tuple[int, int]]:
    """Spans without the lines of the sorted list ``gone``."""
    out = []
    for a, b in spans:
        for g in gone[bisect_left(gone, a) : bisect_left(gone, b + 1)]:
            if a < g:
                out.append((a, g - 1))
            a = g + 1
        if a <= b:
            out.append((a, b))
    return out


# --- conversion ---------------------------------------------------------------------------------------------------------------------

#: Commands whose argument isn't text.
SILENT = frozenset("label cite citep citet index vspace hspace newpage clearpage noindent centering usepackage documentclass bibliography input include pagebreak maketitle tableofcontents hline toprule midrule bottomrule setlength".split())
#: Depths of LaTeX's sections.
DEPTHS = {"part": -1, "chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
#: Units and their prefixes.
UNITS = {"kilo": "k", "mega": "M", "milli": "m", "micro": "µ", "centi": "c", "newton": "N", "metre": "m", "meter": "m", "pascal": "Pa", "second": "s", "gram": "g", "celsius": "°C", "degreeCelsius": "°C", "watt": "W", "hertz": "Hz", "per": "/", "percent": "%"}
#: Environments of lists, tables and quotations.
LISTS = {"itemize": "- ", "enumerate": "1. ", "description": "- "}
GRIDS = frozenset("tabular tabular* array longtable tabularx tabulary".split())
QUOTES = frozenset("quote quotation verse".split())

LINE, PARAGRAPH, AROUND_LIST = 1, 2, 3  # breaks among the parts of a text; the last is a line's within a list


class Piece:
    """A list item, table cell or row on its way to its list or table."""

    __slots__ = ("kind", "parts", "span")

    def __init__(self, kind: str, parts: list, span: int = 1) -> None:
        self.kind, self.parts, self.span = kind, parts, span


class Prefix:
    """What the lines of the parts that follow begin with; None ends the latest."""

    __slots__ = ("text",)

    def __init__(self, text: str | None) -> None:
        self.text = text


def marked(mark: str, parts: list, prefix: str) -> list:
    """Parts under a mark: their first text stands beside it, their other lines begin with the prefix."""
    return [mark, Prefix(prefix), parts, Prefix(None)]


def flat(parts: list, whole: bool = False) -> Iterator:
    """Texts, breaks and prefixes of nested parts, in order; with ``whole`` pieces stay pieces."""
    stack = [iter(parts)]
    while stack:
        for p in stack[-1]:
            if isinstance(p, Piece) and not whole:
                p = [LINE, marked("- ", p.parts, "  "), LINE] if p.kind == "item" else [p.parts, " "]
            if isinstance(p, list):
                stack.append(iter(p))
                break
            yield p
        else:
            stack.pop()


BLANKS = " \t\r\n"


def assemble(parts: list) -> str:
    """The text of parts; a break makes sure that as many line breaks stand there, and stands for the blanks beside it."""
    out: list[str] = []
    prefixes = [""]
    blanks, wait, beside = "", 0, False

    def write(text: str) -> None:
        if prefixes[-1] and "\n" in text:
            text = re.sub(r"\n(?=(\n)?)", lambda m: "\n" + (prefixes[-1].rstrip() if m.group(1) else prefixes[-1]), text)
        out.append(text)

    for p in flat(parts):
        if isinstance(p, int):
            if not beside:
                wait = max(wait, p if p != AROUND_LIST else LINE if len(prefixes) > 1 else PARAGRAPH)
        elif isinstance(p, Prefix):
            if p.text is None:
                prefixes.pop()
                beside = False
            else:
                prefixes.append(prefixes[-1] + p.text)
                beside = True
        else:
            body = p.lstrip(BLANKS)
            lead = p[: len(p) - len(body)]
            if not body:
                blanks += "" if beside else lead
                continue
            if beside:
                gap = blanks
            elif wait:
                n = (blanks + lead).count("\n")
                gap = ("\n" * max(wait, n) if out else "") + (lead.rpartition("\n")[2] if "\n" in lead else "")
            else:
                gap = blanks + lead
            core = body.rstrip(BLANKS)
            write(gap)
            write(core)
            blanks, wait, beside = body[len(core) :], 0, False
    return "".join(out) + blanks


def one_line(parts: list) -> str:
    return " ".join(assemble(parts).split())


def item_of(p) -> Piece | None:
    """The list item that a part is."""
    while isinstance(p, list) and len(p) == 1:
        p = p[0]
    return p if isinstance(p, Piece) and p.kind == "item" else None


def list_parts(parts: list, mark: str) -> list:
    """A list of its items; other text between them stays beside them."""
    out, n = [AROUND_LIST], 0
    for p in parts:
        if item := item_of(p):
            n += 1
            sign = f"{n}. " if mark == "1. " else mark
            out += [marked(sign, item.parts, " " * len(sign)), LINE]
        elif not isinstance(p, str) or p.strip():
            out += [p, LINE]
    return [*out, AROUND_LIST]


def pipe_row(cells: list[str]) -> str:
    return "| " + " | ".join(" ".join(c.split()).replace("|", "\\|") for c in cells) + " |"


def pipe_table(rows: list[list[str]]) -> list:
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return []
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return [PARAGRAPH, "\n".join([pipe_row(rows[0]), pipe_row(["---"] * width), *map(pipe_row, rows[1:])]), PARAGRAPH]


def split_parts(parts: list, at: str) -> list[list]:
    """Parts cut at every match in their texts; converted containers hold no separators."""
    out: list[list] = [[]]
    for p in parts:
        if isinstance(p, str):
            first, *more = re.split(at, p)
            out[-1].append(first)
            out += [[x] for x in more]
        else:
            out[-1].append(p)
    return out


def content(n: Node, page: Page, a: int, b: int) -> list:
    """Parts of ``[a, b)`` of a container: its own text and its converted children."""
    out, at = [], a
    for c in n.children:
        if c.start >= b or c.start < a:
            continue
        out += [page.text[at : c.start], c.parts]
        at = c.end
    out.append(page.text[at:b])
    return out


def attribute(n: Node, name: str) -> str:
    m = re.search(rf"""(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+))""", n.attr, re.I)
    return html.unescape(next((g for g in m.groups() if g is not None), "")) if m else ""


def linked(parts: list, target: str) -> list:
    """A Markdown link where the target is an address and there is a text to show."""
    label = one_line(parts)
    if not label or not re.match(r"(?:https?|ftp)://|/|\.{1,2}/|\w[\w./-]*\.\w+$", target):
        return parts
    return ["[" + label + "](" + target.replace(" ", "%20").replace(")", "%29") + ")"]


def element(n: Node, page: Page, inner: list) -> list:
    """An HTML element; in a row of a Markdown table everything stays in its line."""
    name = n.name.lstrip("/")
    if n.name[0] == "/":
        return []
    start = page.line_start(n.start)
    if page.text[start : n.start].lstrip(" \t>").startswith("|") and (name in BLOCKS or name in ("br", "hr")):
        return [" ", one_line(inner), " "] if inner else [" "]
    if name == "br":
        return [LINE]
    if name == "hr":
        return [PARAGRAPH, "---", PARAGRAPH]
    if name == "img":
        alt, source = attribute(n, "alt"), attribute(n, "src")
        return [f"![{alt}]({source})"] if alt or source else []
    if n.a >= n.b and not n.close:
        return [LINE, "- "] if name == "li" else [LINE] if name in BLOCKS else []
    if re.fullmatch(r"h[1-6]", name):
        text = one_line(inner)
        return [PARAGRAPH, "#" * int(name[1]) + " " + text, PARAGRAPH] if text else []
    if name in ("ul", "ol", "menu", "dir"):
        return list_parts(inner, "1. " if name == "ol" else "- ")
    if name == "li":
        return [Piece("item", inner)]
    if name in ("td", "th"):
        span = attribute(n, "colspan")
        return [Piece("cell", inner, max(1, int(span)) if span.isdecimal() and len(span) < 4 else 1)]
    if name == "tr":
        return [Piece("row", inner)]
    if name == "caption":
        return [PARAGRAPH, one_line(inner), PARAGRAPH]
    if name in ("pre", "syntaxhighlight"):
        body = assemble(inner).strip("\n")
        fence = "`" * max(3, 1 + max((len(x) for x in re.findall(r"`+", body)), default=0))
        return [PARAGRAPH, f"{fence}{attribute(n, 'lang')}\n{body}\n{fence}", PARAGRAPH] if body.strip() else []
    if name in ("code", "tt", "kbd", "samp") and not any(x.startswith("html:pre") for x in n.path[:-1]):
        body = assemble(inner)
        return ["`", body, "`"] if body.strip() and "`" not in body and "\n" not in body else [inner]
    if name == "math":
        body = assemble(inner).strip()
        return ["$" + body + "$"] if body else []
    if name == "blockquote":
        return [PARAGRAPH, marked("> ", inner, "> "), PARAGRAPH] if one_line(inner) else []
    if name in ("sup", "sub"):
        return ["^" if name == "sup" else "_", inner]
    if name == "a":
        return linked(inner, attribute(n, "href"))
    if name == "ref":
        return [" (", one_line(inner), ")"] if one_line(inner) else []
    if name == "dd":
        return [LINE, ": ", one_line(inner), LINE]
    if name in BLOCKS:
        return [PARAGRAPH, inner, PARAGRAPH]
    return [inner]


def table_rows(parts: list) -> tuple[list, list[list[str]]]:
    """Rows of the cells in the parts of a table, and what stands beside them."""
    beside, rows, loose = [], [], []
    for p in flat(parts, whole=True):
        if isinstance(p, Piece) and p.kind == "row":
            cells = [c for c in flat(p.parts, whole=True) if isinstance(c, Piece) and c.kind == "cell"]
            rows.append([x for c in cells for x in (one_line(c.parts), *[""] * (c.span - 1))])
        elif isinstance(p, Piece) and p.kind == "cell":
            loose.append(one_line(p.parts))
        elif not isinstance(p, str) or p.strip():
            beside.append(p)
    return beside, rows + ([loose] if loose else [])


def wiki_rows(n: Node, page: Page) -> list[list[str]]:
    """Cells of a wiki table: its own text decides where cells begin."""
    rows: list[list[list]] = [[]]
    attrs = True  # the rest of the opening line
    for p in content(n, page, n.a, n.b):
        if not isinstance(p, str):
            if rows[-1] and not attrs:
                rows[-1][-1].append(p)
            continue
        for i, line in enumerate(p.split("\n")):
            if i:
                attrs = False
                bare = line.strip().lstrip("> ")
                if bare.startswith("|-"):
                    rows.append([])
                    attrs = True
                    continue
                if bare.startswith("|+"):
                    attrs = True
                    continue
                if bare[:1] in ("|", "!"):
                    line = bare[1:]
                    rows[-1].append([])
                elif rows[-1]:
                    rows[-1][-1].append(" ")
            if attrs or not rows[-1]:
                continue
            first, *more = re.split(r"\|\||!!", line)
            rows[-1][-1].append(first)
            rows[-1] += [[x] for x in more]
    out = []
    for row in rows:
        cells = []
        for cell in row:
            if cell and isinstance(cell[0], str) and re.match(r"[^|\[\]]*=[^|\[\]]*\|(?!\|)", cell[0]):
                cell[0] = cell[0].split("|", 1)[1]
            cells.append(one_line(cell))
        out.append(cells)
    return out


def environment(n: Node, page: Page, inner: list) -> list:
    base = n.name.rstrip("*")
    if n.name in GRIDS or base in GRIDS:
        at = n.a
        for _, end in arguments(page, at):
            at = end
        cells = [split_parts(r, r"(?<!\\)&") for r in split_parts(content(n, page, at, n.b), r"\\\\(?:\[[^\[\]]*\])?")]
        return pipe_table([[one_line(c).replace("\\&", "&") for c in r] for r in cells])
    if base in LISTS:
        items: list = []
        for c in inner:
            if item := item_of(c):
                items.append(Piece("item", list(item.parts)))
            elif items:
                items[-1].parts.append(c)
        for item in items:
            while item.parts and isinstance(item.parts[-1], str) and not item.parts[-1].strip():
                item.parts.pop()
            if item.parts and isinstance(item.parts[-1], str):
                item.parts[-1] = item.parts[-1].rstrip()
        return list_parts(items, LISTS[base])
    if base in QUOTES:
        return [PARAGRAPH, marked("> ", inner, "> "), PARAGRAPH] if one_line(inner) else []
    at = n.a
    for _, end in arguments(page, at):
        at = end
    return [PARAGRAPH, content(n, page, at, n.b) if at > n.a else inner, PARAGRAPH]


def command(n: Node, page: Page, top: int) -> list:
    args = [content(n, page, a + 1, b - 1) for a, b in n.args if page.text[a] == "{"]
    options = [content(n, page, a + 1, b - 1) for a, b in n.args if page.text[a] == "["]
    base, last = n.name.rstrip("*"), args[-1] if args else []
    if base in SILENT:
        return [" "] if base == "hspace" else []
    if base in DEPTHS:
        title = one_line(last)
        return [PARAGRAPH, "#" * min(6, DEPTHS[base] - top + 1) + " " + title, PARAGRAPH] if title else []
    if base == "item":
        return [Piece("item", [*options, ": "] if options else [])]
    if base in ("SI", "qty", "si", "unit"):
        unit = "".join(UNITS.get(u, u) for u in re.findall(r"\\([A-Za-z]+)", page.text[n.args[-1][0] : n.args[-1][1]])) if n.args else ""
        return [" ".join([*(one_line(a) for a in args[:-1]), unit])]
    if base in ("footnote", "thanks"):
        return [" (", one_line(last), ")"]
    if base in ("texttt", "verb") and one_line(last) and "`" not in one_line(last):
        return ["`" + one_line(last) + "`"]
    if base == "href" and len(args) > 1:
        return linked(args[1], one_line(args[0]))
    if base == "includegraphics":
        return [f"![]({one_line(last)})"]
    if base in ("newline", "linebreak"):
        return [LINE]
    if base == "caption":
        return [LINE, last, LINE]
    return [x for i, a in enumerate(args) for x in ([" ", a] if i else [a])]


def converted(n: Node, page: Page, top: int) -> list:
    """A container of a winning path as parts of clean text."""
    if n.kind in ("comment", "raw", "sign", "switch"):
        return []
    if n.kind == "entity":
        return [html.unescape(page.text[n.start : n.end])]
    if n.kind == "code":
        body = page.text[n.a : n.b].strip("\n")
        return [PARAGRAPH, f"```\n{body}\n```", PARAGRAPH] if body.strip() else []
    inner = content(n, page, n.a, n.b)
    if n.kind == "tag":
        return element(n, page, inner)
    if n.kind == "table":
        beside, rows = table_rows(inner)
        return [beside, pipe_table(rows)]
    if n.kind == "wtable":
        return pipe_table(wiki_rows(n, page))
    if n.kind == "template":
        _, *params = split_parts(inner, r"\|")
        named = [(p[0].split("=", 1), p[1:]) for p in params if isinstance(p[0], str) and "=" in p[0]]
        plain = [p for p in params if not (isinstance(p[0], str) and "=" in p[0])]
        if plain:
            return [" ".join(assemble(p).strip() for p in plain)]
        return [PARAGRAPH, "\n".join(f"- {k.strip()}: {one_line([v, rest])}" for (k, v), rest in named), PARAGRAPH] if named else []
    if n.kind == "wlink":
        return split_parts(inner, r"\|")[-1]
    if n.kind == "elink":
        target = page.text[n.start + 1 : n.end - 1].split(None, 1)[0]
        return linked(inner, target) if n.a > n.start + 1 else [target]
    if n.kind == "quotes":
        return [inner]
    if n.kind == "whead":
        return ["#" * int(n.name) + " " + one_line(inner)]
    if n.kind == "env":
        return environment(n, page, inner)
    return command(n, page, top)


def extract(text: str, keep: Callable[[str], object], with_text: bool = True) -> tuple[str | None, list[int]]:
    """Clean text and the numbers of the lines that held markup, by what ``keep`` tells of each path.

    ``keep`` gives ``"text"`` or True for a winning path, ``"drop"`` or False for
    one whose content isn't text, ``"plain"`` for what is no markup.
    """
    page, root, nodes = tree(text)
    plans = [keep("/".join(n.path)) for n in nodes]
    spans = [(page.line_of(a), page.line_of(b)) for n, how in zip(nodes, plans, strict=True) if how != "plain" and n.sure > 0 for a, b in extents(n)]
    skip = [page.line_of(m.start()) for m in PAGE.finditer(text)] if spans and "<!-- PDF page" in text else []
    lines = [i for a, b in without(merged(spans), skip) for i in range(a, b + 1)]
    if not with_text:
        return None, lines
    top = min((DEPTHS[n.name.rstrip("*")] for n in nodes if n.kind == "command" and n.name.rstrip("*") in DEPTHS), default=1)
    for n, how in zip(reversed(nodes), reversed(plans), strict=True):
        if how == "plain":
            n.parts = [text[n.start : n.a], content(n, page, n.a, n.b), text[n.b : n.end]]
        else:
            n.parts = converted(n, page, top) if how in ("text", True) else []
    return assemble(content(root, page, 0, len(text))) if nodes else text, lines


# --- Spark --------------------------------------------------------------------------------------------------------------------------


def hosts(documents: DataFrame, reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(document_id, host)`` of the documents with a manifest row, each once."""
    at = manifest.where("sha256 is not null").groupBy(F.lower("sha256").alias("hash")).agg(F.min(F.lower(F.regexp_extract("source_url", r"^[A-Za-z]+://([^/?#]+)", 1))).alias("host"))
    of = reports.select("document_id", F.lower("source_sha256").alias("hash")).distinct()
    return of.join(at, "hash").groupBy("document_id").agg(F.min("host").alias("host"))


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def containers(documents: DataFrame, reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(document_id, host, path, n, sure, score, spans)``: what each page's containers of one path say, and their lines.

    The only pass over the texts; what comes out is small, is written once and
    serves the votes and the extraction by their winners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, path, *s) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text for path, s in summary(text).items()]
            spans = [[{"a": x, "b": y} for x, y in r[5]] for r in rows]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), pa.array(spans, SPANS)], names=["document_id", "path", "n", "sure", "score", "spans"])

    found = documents.select("document_id", "markdown").mapInArrow(run, "document_id string, path string, n bigint, sure double, score double, spans array<struct<a:int,b:int>>")
    of = hosts(documents, reports, manifest)
    return cut_lineage(found.join(of, "document_id", "left").withColumn("host", F.coalesce("host", F.lit(""))))


def votes(pages: DataFrame) -> DataFrame:
    """``(host, path, n, sure, score)`` over all containers of a host."""
    return pages.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("n", "sure", "score")))


def winning_paths(counted: DataFrame) -> DataFrame:
    """``(host, path, won, kept)``: the vote of the host, or of all hosts where the host has few."""
    everywhere = counted.groupBy("path").agg(*((F.sum(c) / F.sum("n")).alias(f"all_{c}") for c in ("sure", "score")))
    mean = lambda c: F.round(F.when(F.col("n") >= MIN_VOTES, F.col(c) / F.col("n")).otherwise(F.col(f"all_{c}")), 9)
    won = mean("sure") >= SURE
    return counted.join(everywhere, "path").select("host", "path", won.alias("won"), (won & (mean("score") >= KEEP)).alias("kept"))


def markup_lines(pages: DataFrame) -> DataFrame:
    """``(document_id, line_no)`` of the containers of winning paths."""
    winners = winning_paths(votes(pages)).where("won").select("host", "path")
    spans = pages.join(winners, ["host", "path"]).select("document_id", F.explode("spans").alias("s"))
    return spans.select("document_id", F.explode(F.sequence("s.a", "s.b")).alias("line_no")).distinct()


def extracted(documents: DataFrame, reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(document_id, text, lines)`` of every document, by the winning paths of its host."""
    pages = containers(documents, reports, manifest)
    lost = winning_paths(votes(pages)).where("not kept").select("host", "path", "won")
    # of a document's own paths those that lost: few, and by document
    own = pages.join(lost, ["host", "path"]).groupBy("document_id").agg(F.collect_list(F.struct("path", "won")).alias("lost"))
    rows = documents.select("document_id", "markdown").join(own, "document_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, gone = (c.to_pylist() for c in b.columns)
            done = []
            for text, paths in zip(texts, gone, strict=True):
                how = {p["path"]: "drop" if p["won"] else "plain" for p in paths or ()}
                done.append((None, []) if text is None else extract(text, lambda p, h=how: h.get(p, "text")))
            arrays = [pa.array(ids, pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["document_id", "text", "lines"])

    return rows.mapInArrow(run, "document_id string, text string, lines array<int>")
