import pytest

from strataquill.functions import markdown_blocks as M
from strataquill.functions import packing as P
from strataquill.operators import chunking, hierarchy, markdown


def kinds(text):
    return [(b.kind, b.start, b.end) for b in M.blocks(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []),
        ("# A\n\ntext\nmore", [("heading", 0, 1), ("paragraph", 2, 4)]),
        ("Title\n===\nSub\n---", [("heading", 0, 2), ("heading", 2, 4)]),
        ("```\n# no\n```\n# yes", [("fence", 0, 3), ("heading", 3, 4)]),
        ("~~~~\n```\n# no\n~~~\n~~~~\nx", [("fence", 0, 5), ("paragraph", 5, 6)]),
        ("```\n# open", [("fence", 0, 2)]),
        ("<div>\n# no\n</div>\n\n# yes", [("html", 0, 3), ("heading", 4, 5)]),
        ("<!-- a\n\n# no -->\nx", [("html", 0, 3), ("paragraph", 3, 4)]),
        ("- a\n  # in\n- b\n\n# out", [("list", 0, 3), ("heading", 4, 5)]),
        ("> # quoted\nlazy\n\nx", [("quote", 0, 2), ("paragraph", 3, 4)]),
        ("| a | b |\n| - | - |\n| 1 | 2 |\n\nx", [("table", 0, 3), ("paragraph", 4, 5)]),
        ("a | b\nno table", [("paragraph", 0, 2)]),
        ("    # code\n\n#nohead", [("code", 0, 1), ("paragraph", 2, 3)]),
        ("<!-- PDF page 2 -->\nx", [("marker", 0, 1), ("paragraph", 1, 2)]),
        ("***\n# A #\r\n", [("rule", 0, 1), ("heading", 1, 2)]),
    ],
)
def test_blocks(text, expected):
    assert kinds(text) == expected


def test_terminal_sections():
    text = "lead\n# A\npreface\n## B\nb\n### C\n# D\n"
    got = [(s.level, s.heading, s.start, s.end) for s in M.terminal_sections(text)]
    assert got == [(None, None, 0, 1), (1, "A", 2, 3), (2, "B", 4, 5), (3, "C", 6, 6), (1, "D", 7, 8)]
    assert M.terminal_sections("plain")[0].unheaded


def test_page_range():
    marks = [(0, 1), (5, 2), (9, 3)]
    assert M.page_range(marks, 0, 5) == (1, 1)
    assert M.page_range(marks, 3, 6) == (1, 2)
    assert M.page_range(marks, 5, 20) == (2, 3)
    assert M.page_range([], 0, 1) == (None, None)
    assert M.page_range([(4, 7)], 1, 3) == (7, 7)


def test_packing_keeps_blocks_whole_and_overlaps():
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 30, "| x | y |\n| - | - |\n" + "| 1 | 2 |\n" * 12, "d" * 200])
    lines = text.split("\n")
    units = P.pack(lines, [b for b in M.blocks(text)], 70, 31)
    assert [u.kind for u in units] == ["packed", "packed", "table", "window", "window", "window", "window", "window"]
    assert units[1].text == "b" * 30 + "\n\n" + "c" * 30
    assert all(len(u.text) <= 70 for u in units if u.kind != "table")
    assert "".join(u.text[31:] if i else u.text for i, u in enumerate(x for x in units if x.kind == "window"))[:200].startswith("d")


def test_leaves(spark):
    rows = spark.createDataFrame([("x", "# A\n\n" + "word " * 400, 1), ("e", "", 1), ("n", None, 1)], "document_id string, markdown string, content int")
    found = markdown.leaves(rows, 256, 32)
    assert markdown.leaf_faults(found, 256).count() == 0
    assert {r[0] for r in found.select("document_id").distinct().collect()} == {"x"}
    with pytest.raises(ValueError):
        markdown.leaves(rows, 10, 10)


def test_recursive_split():
    assert chunking.recursive_split("aa bb cc", 5, 0) == ["aa bb", "cc"]
    assert chunking.recursive_split("x" * 12, 5, 0) == ["xxxxx", "xxxxx", "xx"]
    assert chunking.recursive_split("", 5, 0) == []


def test_heading_parents_equal_a_stack(spark):
    import random

    rng = random.Random(1)
    rows = [("d" + str(i % 3), f"s{i:03}", rng.randint(1, 6), f"h{i}", i, i + 1) for i in range(150)]
    df = spark.createDataFrame(rows, "document_id string, section_id string, level int, heading string, start int, end int")
    got = {r["section_id"]: r["parent_id"] for r in hierarchy.heading_parents(df).collect()}
    for doc in ("d0", "d1", "d2"):
        stack = []
        for _, s, level, *_ in (r for r in rows if r[0] == doc):
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[s] == (stack[-1][0] if stack else None)
            stack.append((s, level))


def test_position_stacks_differ_from_levels(spark):
    df = spark.createDataFrame([("d", "a", 1, "A", 0, 1), ("d", "b", 3, "B", 1, 2), ("d", "c", 3, "C", 2, 3)], "document_id string, section_id string, level int, heading string, start int, end int")
    got = {r[0]: r[1] for r in hierarchy.position_stacks(df).collect()}
    assert got == {"a": ["A"], "b": ["A", "B"], "c": ["A", "B", "C"]}


def test_leaves_by_tokens(spark):
    import os

    from strataquill.functions import tokens

    if not os.path.exists(tokens.DEFAULT_VOCABULARY):
        pytest.skip("no vocabulary")
    count = tokens.counter(tokens.vocabulary_text())
    text = "# A\n\n" + "\n\n".join(f"The pump number {i} was measured twice and held." for i in range(40)) + "\n\n" + "检验完成 ok " * 300 + "\n\n## B\n\nend"
    docs = spark.createDataFrame([("d", text), ("n", None), ("e", "")], "document_id string, markdown string")
    rows = markdown.leaves(docs, 64, 16, tokens.DEFAULT_VOCABULARY).orderBy("chunk_index").collect()
    assert {r["document_id"] for r in rows} == {"d"} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(count(r["content"]) <= 64 for r in rows if r["unit"] == "packed")
    windows = [r["content"] for r in rows if r["unit"] == "window"]
    long = "检验完成 ok " * 300
    spans = count.offsets(long)
    assert windows == [w for w in (long[spans[i][0] : spans[min(i + 64, len(spans)) - 1][1]] for i in range(0, len(spans) - 16, 48)) if w.strip()]
    assert count("") == 0 and count("<|endoftext|>") > 1
    got = {r[0]: r[1] for r in chunking.token_counts(docs, "document_id", "markdown", tokens.DEFAULT_VOCABULARY).collect()}
    assert got == {"d": count(text), "n": 0, "e": 0}
