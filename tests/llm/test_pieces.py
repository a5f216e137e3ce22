import random

import pytest

from strataquill.llm import pieces as P


def own_text(markdown, first, last):
    return "\n".join(x for x in markdown.split("\n")[first:last] if not P.MARKER.fullmatch(x))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["milling", "gauge.", "Füge", "检验。", "x" * 40, "ok!", "and", "the", "é́"]
    docs, secs = [("empty", ""), ("null", None), ("run", "y" * 7_001)], [("e", "empty", 0, 5), ("n", "null", 0, 2), ("r", "run", 0, None), ("r", "run", 0, None), ("neg", "run", -1, 1), ("void", "run", None, 1)]
    for d in range(6):
        lines = []
        for _ in range(rng.randrange(200, 1500)):
            kind = rng.random()
            lines.append("" if kind < 0.3 else f"<!-- PDF page {rng.randrange(9)} -->" + rng.choice(["", "\r"]) if kind < 0.4 else " ".join(rng.choices(words, k=rng.randrange(1, 40))))
        docs.append((f"d{d}", "\n".join(lines)))
        at = 0
        while at < len(lines):
            end = at + rng.randrange(1, 400)
            secs.append((f"s{d}_{at}", f"d{d}", at, rng.choice([end, end + 300, None, 10**6])))
            at = end
    return docs, secs


@pytest.mark.parametrize("size", [P.RANGE, 12_000, 30_000])
def test_pieces_make_up_the_sections(spark, corpus, size):
    docs, secs = corpus
    documents = spark.createDataFrame(docs, "document_id string, markdown string")
    sections = spark.createDataFrame([(s, d, None, a, z, 1) for s, d, a, z in secs], "section_id string, document_id string, heading string, source_start int, source_end int, part int")
    starts = {d: sorted({a for _, e, a, _ in secs if e == d and a is not None and a >= 0}) for d, _ in docs}
    texts = dict(docs)
    expected = {}
    for s, d, a, z in set(secs):
        if a is None or a < 0 or texts[d] is None:
            continue
        ends = [x for x in (next((y for y in starts[d] if y > a), None), z) if x is not None]
        expected[s] = own_text(texts[d], a, min(ends) if ends else None)
    lengths = {r["section_id"]: r["n_chars"] for r in P.section_lengths(documents, sections, size).collect()}
    assert lengths == {s: len(t) for s, t in expected.items() if s in lengths}
    assert {s for s, t in expected.items() if len(t) > 3000} == {s for s, n in lengths.items() if n > 3000}
    got = {}
    for r in P.pieces(documents, sections, size=size).orderBy("section_id", "piece_no").collect():
        got.setdefault(r["section_id"], []).append(r)
    assert got.keys() == {s for s, t in expected.items() if len(t) > 3000}
    for s, rows in got.items():
        assert [r["piece_no"] for r in rows] == list(range(len(rows)))
        assert "".join(r["content"][r["overlap"] :] for r in rows) == expected[s]
        assert all(len(r["content"]) <= 3000 and r["overlap"] <= 200 for r in rows)
        for a, b in zip(rows, rows[1:]):
            assert a["content"].endswith(b["content"][: b["overlap"]]) and b["overlap"] > 0
            assert s == "r" or a["content"][-1].isspace() or a["content"][-1] in "。.!"


def test_empty_tables(spark):
    documents = spark.createDataFrame([], "document_id string, markdown string")
    sections = spark.createDataFrame([], "section_id string, document_id string, heading string, source_start int, source_end int")
    assert P.pieces(documents, sections).count() == 0


def pieces_of(spark, text, size, limit=3_000, overlap=200, source=None):
    documents = source or spark.createDataFrame([("d", text)], "document_id string, markdown string")
    sections = spark.createDataFrame([("s", "d", "h", 0, None, 1)], "section_id string, document_id string, heading string, source_start int, source_end int, part int")
    return [tuple(r) for r in P.pieces(documents, sections, limit, overlap, size).orderBy("piece_no").collect()]


def long_text(seed, n):
    rng = random.Random(seed)
    words = ["milling", "gauge.", "Füge", "检验。", "x" * 40, "ok!", "and", "é́" * 5, "𝒳"]
    out = []
    while sum(map(len, out)) < n:
        kind = rng.random()
        out.append("" if kind < 0.1 else f"<!-- PDF page {rng.randrange(9)} -->" if kind < 0.2 else "y" * rng.randrange(1, 9_000) if kind < 0.22 else " ".join(rng.choices(words, k=rng.randrange(1, 200))))
    return "\n".join(out)


def test_pieces_do_not_depend_on_ranges(spark):
    text = long_text(3, 60_000)
    whole = pieces_of(spark, text, 1 << 20)
    assert [r[1] for r in whole] == list(range(len(whole))) and len(whole) > 20
    assert "".join(r[7][r[6] :] for r in whole) == own_text(text, 0, None)
    assert pieces_of(spark, text, 12_000) == whole == pieces_of(spark, text, 17_001)


def test_byte_ranges_of_files_give_the_same_pieces(spark, tmp_path):
    text = long_text(4, 40_000)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "document.md").write_bytes(text.encode())
    whole = pieces_of(spark, text, 1 << 20)
    for size in (12_000, 20_011):
        found = P.Files(P.Files.found(spark, str(tmp_path)), size)
        assert pieces_of(spark, None, size, source=found) == whole


def test_many_small_ranges(spark):
    text = long_text(5, 120_000)
    whole = pieces_of(spark, text, 1 << 20, 30, 7)
    assert all(len(r[7]) <= 30 for r in whole)
    assert pieces_of(spark, text, 120, 30, 7) == whole


def test_runs_without_boundaries_and_marks(spark):
    for text in ("z" * 50_000, "e\u0301" * 20_000, "z" * 2_900 + "。" + "z" * 9_000, "\u0301" * 9_000):
        rows = pieces_of(spark, text, 12_000, overlap=201)
        assert "".join(r[7][r[6] :] for r in rows) == text and all(len(r[7]) <= 3_000 for r in rows)
        if text[0] == "e":
            assert all(r[7][0] == "e" and r[7][r[6]] == "e" for r in rows)
        if "。" in text:
            assert rows[0][7].endswith("。")


def test_byte_ranges_put_code_points_together():
    raw = "aé漢𝒳\u0301".encode() * 50 + b"\xff\xc3"
    for size in (1, 2, 3, 5, 7, 64, len(raw), 1_000):
        own = []
        for no in range(P.range_count(len(raw), size)):
            lead, n, first, last, part = P.byte_range(lambda at, k: raw[at : at + k], len(raw), no, size, 3, 3)
            own.append(part[lead : lead + n])
            assert first == (no == 0) and last == (no == len(raw) // size)
        assert "".join(own) == raw.decode("utf-8", "replace")


def test_two_headings_and_spans_of_one_section(spark):
    documents = spark.createDataFrame([("d", "x " * 2_000 + "\n" + "y " * 100)], "document_id string, markdown string")
    rows = [("s", "d", "b", 0, 1), ("s", "d", "a", 0, 1), ("s", "d", "b", 0, 2)]
    sections = spark.createDataFrame(rows, "section_id string, document_id string, heading string, source_start int, source_end int")
    got = P.section_lengths(documents, sections).collect()
    assert [(r["section_id"], r["n_chars"]) for r in got] == [("s", 4_201)]
    assert {r["piece_no"] for r in P.pieces(documents, sections).collect()} == {0, 1}
