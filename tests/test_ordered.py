import random

from pyspark.sql import functions as F

from strataquill.operators import answers, graph, hierarchy, markdown, recovery
from strataquill.operators.ordered import carried
from strataquill.sources import sqlite


def test_carried_against_loops(spark):
    rng = random.Random(2)
    rows = [(g, p, rng.choice([None, None, f"v{g}{p}"]), 7) for g in "abc" for p in rng.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "g string, p int, v string, bucket int")
    for inclusive in (True, False):
        for backwards in (True, False):
            got = {(r["g"], r["p"]): r["x"] for r in carried(df, ["g"], ["p"], F.floor(F.col("p") / 7), {"x": F.col("v")}, inclusive, backwards).collect()}
            expected = {}
            for g, p, _, _ in rows:
                reach = [(q, v) for h, q, v, _ in rows if h == g and v is not None and (q == p and inclusive or (q > p if backwards else q < p))]
                expected[g, p] = (min(reach) if backwards else max(reach))[1] if reach else None
            assert got == expected
    assert carried(df.where("false"), ["g"], ["p"], F.floor(F.col("p") / 7), {"x": F.col("v")}, True).count() == 0


def heads(spark, monkeypatch, n=300, lines=20_000):
    """Headings over many buckets of lines."""
    rng = random.Random(4)
    starts = sorted(rng.sample(range(lines), n))
    rows = [("d", f"s{i:04}", "heading", rng.randrange(1, 7), f"h{i}", a, a + 5) for i, a in enumerate(starts)]
    schema = "document_id string, section_id string, kind string, heading_level int, heading string, source_start int, source_end int"
    return rows, spark.createDataFrame(rows, schema)


def test_hierarchy_over_buckets(spark, monkeypatch):
    rows, df = heads(spark, monkeypatch)
    h = hierarchy.heading_rows(df)
    parents, ends, stacks, stack = {}, {}, {}, []
    for i, (_, s, _, level, text, _, _) in enumerate(rows):
        parents[s] = next((r[1] for r in reversed(rows[:i]) if r[3] < level), None)
        ends[s] = next((r[5] for r in rows[i + 1 :] if r[3] <= level), 20_000)
        stack = [*stack[: level - 1], text]
        stacks[s] = stack
    assert {r["section_id"]: r["parent_id"] for r in hierarchy.heading_parents(h).collect()} == parents
    n = spark.createDataFrame([("d", 20_000)], "document_id string, n_lines int")
    assert {r["section_id"]: r["section_end"] for r in hierarchy.section_ends(h, n).collect()} == ends
    assert {r["section_id"]: r["stack"] for r in hierarchy.position_stacks(h).collect()} == stacks
    near = {}
    for r in recovery.neighbours(df).collect():
        near.setdefault(r["section_id"], set()).add(r["neighbour_id"])
    assert near == {r[1]: {x[1] for x in (*rows[max(0, i - 1) : i], *rows[i + 1 : i + 2])} for i, r in enumerate(rows)}


def test_pages_over_buckets(spark):
    lines = [f"<!-- PDF page {i // 3_000} -->" if i and i % 3_000 == 0 else "x" for i in range(10_001)]
    df = spark.createDataFrame([("d", "\n".join(lines)), ("e", "x\ny"), ("n", None)], "document_id string, markdown string")
    got = {(r["document_id"], r["line_no"]): (r["active"], r["page"]) for r in markdown.line_pages(df).collect()}
    assert all(got["d", i] == ((i // 3_000, i // 3_000) if i >= 3_000 else (None, 1)) for i in range(10_001))
    assert got["e", 0] == (None, None) and len(got) == 10_003


def test_evidence_takes_the_largest_form_that_fits(spark):
    text = "Pumps are old. The valve leaked here. It was cold. Nobody saw it. The end came. All left."
    hits = spark.createDataFrame([("q", 1, 10, text, "valve leaked"), ("q", 2, 11, "x" * 500, "valve"), ("q", 3, 12, "Valve. Fine", "valve"), ("q", 4, 13, None, "valve")], "query_id string, rank int, doc_id bigint, text string, asked string")
    formed = answers.ladder(hits, "asked", "text", 1)
    forms = ["whole", "window", "sentence"]
    at = lambda budget: [(r["evidence_id"], r["doc_id"], r["granularity"], r["content"]) for r in answers.evidence(formed, "query_id", forms, budget).orderBy("evidence_id").collect()]
    assert at(10_000) == [("E1", 10, "whole", text), ("E2", 11, "whole", "x" * 500), ("E3", 12, "whole", "Valve. Fine")]
    assert at(60) == [("E1", 10, "window", "Pumps are old The valve leaked here It was cold"), ("E2", 12, "whole", "Valve. Fine")]
    assert at(25) == [("E1", 10, "sentence", "The valve leaked here"), ]
    assert at(3) == []


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/x.sqlite"
    rows = spark.range(2_500).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n'"), "id")).alias("name"))
    sqlite.write_table(rows, path, 'a"b', "id INTEGER PRIMARY KEY, name TEXT DEFAULT 'x'")
    got = sqlite.scan(spark, path, 'a"b', "id bigint, name string", 300)
    assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0
    assert [tuple(r)[1:] for r in sqlite.columns(spark, path).collect()] == [("id", "INTEGER", True, None, True), ("name", "TEXT", True, "'x'", False)]
    sqlite.write_table(rows.where("false"), path, "none", "id INTEGER, name TEXT")
    assert sqlite.scan(spark, path, "none", "id bigint, name string").count() == 0


def test_components_of_many_groups(spark):
    rng = random.Random(6)
    pairs = [(g, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for g in range(20) for _ in range(40)] + [(None, "x", "y"), (3, None, "n1")]
    up = {}

    def top(v):
        while up.get(v, v) != v:
            v = up[v]
        return v

    for g, a, b in pairs:
        if g is not None and a is not None:
            x, y = top((g, a)), top((g, b))
            up[max(x, y)] = min(x, y)
    got = {(r["g"], r["node"]): r["component"] for r in graph.components(spark.createDataFrame(pairs, "g int, a string, b string"), ["g"], "a", "b").collect()}
    assert got == {(g, n): top((g, n))[1] for g, a, b in pairs if g is not None and a is not None for n in (a, b)}
