import pytest

from strataquill.llm import markup as M


def lines(text):
    return M.extract(text, lambda p: True)[1]


PLAIN = [
    "plain < 5 and > 3", "R&D and Q&A", "C:\\jobs\\run\\out", "name\\_x\\*", "`<b>` and ``a ` <i>``", "$\\frac{a}{b}$ costs", "\\(E = k\\)", "<https://a.example/x>", "[[1, 0], [0, 2]]", "a == b;",
    "[text](https://a.example)", "| a | b |", "> quote", "* item", "**bold** _it_", "AT&T; x", "5'' and 6''", "<!-- PDF page 3 -->", "~~struck~~", "# ATX #", "costs $5 and $6",
    "```\n<b>x</b>\n{{t}}\n```", "~~~~tex\n\\emph{x}\n~~~\n~~~~", "$$\n\\int x\n$$", "\\[\n\\tau\n\\]", "\\begin{equation}\n\\tau\n\\end{equation}", "```\n<b>open",
]
MARKED = [
    ("a <b>x</b>", [0]), ("x<br>", [0]), ("<HR NOSHADE>", [0]), ("a\n<span\n style=\"c\">x</span>\nb", [1, 2]), ("<!--\nold\n-->\nx", [0, 1, 2]), ("&nbsp;x", [0]), ("&#956; &#x2013;", [0]),
    ("<table class='t'>\n<tr><td>a\n</td></tr>\n</table>\nx", [0, 1, 2, 3]), ("<script>\nvar a;\n</script>", [0, 1, 2]), ("{{Infobox\n| a = b\n}}\nx", [0, 1, 2]), ("[[page|text]] x", [0]), ("== Head ==", [0]),
    ("{| class=\"w\"\n|-\n| a || b\n|}", [0, 1, 2, 3]), ("'''b''' x", [0]), ("x --~~~~", [0]), ("__TOC__", [0]), ("[https://a.example lab] x", [0]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", [0, 1, 2]),
    ("a \\emph{b} c", [0]), ("x.\\footnote{a\nb}", [0, 1]), ("Fig.~\\ref{f}", [0]), ("\\newpage", [0]), ("| a<br>b |", [0]), ("> {{quote|x}}", [0]), ("x\r\n<i>y</i>\r\n", [1]), ("<!-- open", [0]),
]


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert lines(text) == []
    assert M.extract(text, lambda p: True)[0] == text


@pytest.mark.parametrize(("text", "expected"), MARKED)
def test_markup(text, expected):
    assert lines(text) == expected


def test_long_groups_are_whole():
    box = "{{Infobox\n" + "".join(f"| k{i} = value {i}\n" for i in range(2_000)) + "}}"
    assert len(box) > 20_000 and lines(box + "\nplain") == list(range(2_002))
    note = "\\footnote{" + "word word\n" * 3_000 + "}"
    assert lines(note + "\nplain") == list(range(3_001))
    assert "}" not in M.extract(box + note, lambda p: True)[0]


def test_unclosed_groups_end_at_their_line():
    assert lines("{{a\n" * 3 + "x") == [0, 1, 2] and lines("\\emph{a\nb") == [0] and lines("\\item[a\nb]") == [0]
    assert lines("{{a {{b}}\nx\n{{{c}}}\ny") == [0, 2]
    assert list(M.constructs("{{a\n" * 40_000))[-1][0] == 4 * 39_999


def test_running_text_of_long_runs():
    assert M.running_text("{{T|" + "x" * 300_000 + "}}", 0, 300_006, "template") > 0.9


def test_page_markers_inside_are_no_cases():
    assert lines("{{T\n<!-- PDF page 2 -->\n}}") == [0, 2]


def test_clean_text():
    text = "== A ==\n<ul>\n<li>x</li>\n</ul>\n{| c\n! a !! b\n|-\n| 1 || 2\n|}\n\\section{S}\n\\SI{5}{\\kilo\\newton} &lt;b&gt;\n<script>\nv\n</script>\n`<b>`"
    got = M.extract(text, lambda p: True)[0]
    for part in ("## A", "- x", "| a | b |\n| --- | --- |\n| 1 | 2 |", "# S", "5 kN <b>", "`<b>`"):
        assert part in got
    assert "<li>" not in got and "<script>" not in got


def test_consensus_drops_losing_paths(spark):
    nav = "[[File:Map_1.png|thumb|x]] text"
    docs = [(f"d{i}", f"{nav}\n{{{{nowrap|5 kN}}}} held", 1) for i in range(6)] + [("n", None, 1), ("e", "", 1)]
    documents = spark.createDataFrame(docs, "document_id string, markdown string, host int")
    reports = spark.createDataFrame([(f"d{i}", f"H{i}") for i in range(6)], "document_id string, source_sha256 string")
    manifest = spark.createDataFrame([(f"h{i}", "https://a.example/x") for i in range(6)], "sha256 string, source_url string")
    kept = {(r["host"], r["path"]): r["kept"] for r in M.winning_paths(M.votes(M.containers(documents, reports, manifest))).collect()}
    assert kept[("a.example", "wiki:template:nowrap")] is True
    rows = {r["document_id"]: r for r in M.extracted(documents, reports, manifest).collect()}
    assert "5 kN held" in rows["d0"]["text"] and rows["d0"]["lines"] == [0, 1]
    assert rows["n"]["text"] is None and rows["e"]["text"] == "" and rows["e"]["lines"] == []
    assert M.extracted(documents.where("false"), reports, manifest).count() == 0


def test_structure_is_kept():
    html = "<ul><li>a<ul><li>b</li></ul></li></ul><ol><li>one</li><li>two</li></ol><pre><code>x = 1</code></pre><p>t1</p><p>t2</p>"
    assert M.extract(html, lambda p: True)[0] == "- a\n  - b\n\n1. one\n2. two\n\n```\nx = 1\n```\n\nt1\n\nt2"
    tex = "\\begin{itemize}\n\\item a\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\item c $x_1$\n\\end{itemize}\n\\chapter{C}\n\\section{S}"
    assert M.extract(tex, lambda p: True)[0] == "- a\n  - b\n- c $x_1$\n\n# C\n\n## S"
    assert M.extract("\\section{S}", lambda p: True)[0] == "# S"
    assert M.extract("\\begin{verbatim}\n\\emph{x}\n\\end{verbatim}", lambda p: True)[0] == "```\n\\emph{x}\n```"
    assert M.extract("<blockquote>q1\nq2</blockquote>", lambda p: True)[0] == "> q1\n> q2"
    assert M.extract('<a href="https://a.example/x">lab</a> <img alt="pic" src="x.png">', lambda p: True)[0] == "[lab](https://a.example/x) ![pic](x.png)"
    assert M.extract("| a<br>b |", lambda p: True)[0].count("\n") == 0
    assert M.extract("<table><tr><th>a <b>x</b></th><td>b</td></tr><tr><td colspan=2>c</td></tr></table>", lambda p: True)[0] == "| a x | b |\n| --- | --- |\n| c |  |"
    assert M.extract("a <math>x^2</math> b", lambda p: True)[0] == "a $x^2$ b"


def test_a_lost_path_changes_lines_and_text():
    text = "keep <b>x</b>\n{{box|y}}\n<nav><a href='/a'>m</a></nav>"
    everything = M.extract(text, lambda p: "text")
    assert everything[1] == [0, 1, 2]
    plain = M.extract(text, lambda p: "plain" if p == "wiki:template:box" else "text")
    assert plain[1] == [0, 2] and "{{box|y}}" in plain[0]
    dropped = M.extract(text, lambda p: "drop" if p == "html:nav" else "text")
    assert dropped[1] == [0, 1, 2] and "m" not in dropped[0].split("y")[1]


def test_paths_are_chains_without_loops():
    paths = M.summary("<ul class='menu2'><li><ul class=menu3><li><b>x</b></li></ul></li></ul>")
    assert set(paths) == {"html:ul.menu", "html:ul.menu/html:li", "html:ul.menu/html:li/html:b"}
    assert paths["html:ul.menu/html:li"][0] == 2


def test_hosts_vote_on_what_is_markup(spark):
    # the same unknown tag is an element at one host and a placeholder at the other
    docs = [(f"a{i}", "x <dial>7</dial>\n<dial> y") for i in range(6)] + [(f"b{i}", "turn to <dial> and stop") for i in range(6)]
    documents = spark.createDataFrame(docs, "document_id string, markdown string")
    reports = spark.createDataFrame([(d, d) for d, _ in docs], "document_id string, source_sha256 string")
    manifest = spark.createDataFrame([(d, f"https://{d[0]}.example/x") for d, _ in docs], "sha256 string, source_url string")
    pages = M.containers(documents, reports, manifest)
    won = {r["host"]: r["won"] for r in M.winning_paths(M.votes(pages)).collect()}
    assert won == {"a.example": False, "b.example": False}
    lines = {(r["document_id"], r["line_no"]) for r in M.markup_lines(pages).collect()}
    texts = {r["document_id"]: r["text"] for r in M.extracted(documents, reports, manifest).collect()}
    assert not any(d.startswith("b") for d, _ in lines) and texts["b0"] == docs[6][1]
    assert (("a0", 0) in lines) == won["a.example"] == (texts["a0"] != docs[0][1])
    closed = spark.createDataFrame([(d, "x <dial>7</dial>" if d[0] == "a" else t) for d, t in docs], "document_id string, markdown string")
    pages = M.containers(closed, reports, manifest)
    assert {(r["document_id"], r["line_no"]) for r in M.markup_lines(pages).collect()} == {(f"a{i}", 0) for i in range(6)}


@pytest.mark.parametrize("text", ["<ul><li>" * 20_000, "<b>" * 50_000, "{{a\n" * 50_000, "\\emph{" * 50_000, "<table><tr><td>" * 10_000, "\\begin{x}\n" * 20_000, "`` ` " * 50_000, "{{a|" * 20_000 + "}}" * 20_000, "\\begin{itemize}\\item a " * 2_000 + "\\end{itemize}" * 2_000])
def test_unclosed_and_deep_marks_are_linear(text):
    import time

    began = time.perf_counter()
    M.summary(text)
    M.extract(text, lambda p: True)
    assert time.perf_counter() - began < 15


def test_ten_megabyte_template():
    box = "{{Infobox\n" + "| k = value\n" * 800_000 + "}}"
    assert M.summary(box)["wiki:template:infobox"][3] == [(0, 800_001)]
