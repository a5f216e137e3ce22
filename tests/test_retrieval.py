import math

import pytest
from pyspark.sql import functions as F

from strataquill.functions.search import holding
from strataquill.operators import answers, evaluation, fusion, graph, lexical, models, quality, relational, vectors


def test_topk_ties_nulls_and_blocks(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("x"))
    queries = df.where("vec_id in (1, 3)")
    expected = [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (1, 3, 0.0, 3), (3, 3, 1.0, 1), (3, 1, 0.0, 2), (3, 2, 0.0, 3)]
    got = lambda: sorted((tuple(r) for r in vectors.exact_topk(queries, df, 3).collect()), key=lambda r: (r[0], r[3]))
    assert got() == expected
    monkeypatch.setattr(vectors, "QUERY_BYTES", 17)
    assert got() == expected
    assert vectors.exact_topk(queries.where("false"), df, 3).count() == 0
    assert vectors.exact_topk(queries, df.where("false"), 3).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a c"), (3, "a"), (4, None), (5, "")], "doc_id bigint, text string")
    queries = spark.createDataFrame([("q", "b b zz"), ("e", ""), ("n", None)], "query_id string, text string")
    words = lexical.words(F.col("text"))
    rows = lexical.search(docs, "doc_id", words, queries, "query_id", words, 5).collect()
    idf = math.log(5 - 1 + 0.5) - math.log(1 + 0.5)
    expected = 2 * idf * 2 * 2.5 / (2 + 1.5 * (1 - 0.75 + 0.75 * 4 / (7 / 5)))
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in rows] == [("q", 1, 1)] and rows[0]["score"] == pytest.approx(expected, abs=1e-6)


def test_fusion_counts_a_source_once(spark):
    rows = [("q", "x", "a", 1), ("q", "x", "a", 3), ("q", "x", "b", 2), ("q", "y", "a", 2)]
    df = spark.createDataFrame(rows, "query string, item string, source string, rank int")
    got = {r["item"]: r["score"] for r in fusion.rrf(df, "query", "item", 60, 5).collect()}
    assert got == {"x": round(1 / 61 + 1 / 62, 6), "y": round(1 / 62, 6)}


def test_interleave(spark):
    one = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, k string, rank int")
    two = spark.createDataFrame([("q", "c", 1), ("q", "a", 2), ("q", "d", 3)], "q string, k string, rank int")
    assert [r["k"] for r in relational.interleave(one, two, "q", "k", 4).orderBy("position").collect()] == ["a", "c", "b", "d"]


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [("g", f"n{i:03}", f"n{i + 1:03}") for i in range(90)] + [("g", "hub", f"leaf{i}") for i in range(50)] + [("h", "n001", "n000")]
    df = spark.createDataFrame(pairs, "g string, a string, b string")
    got = {(r["g"], r["node"]): r["component"] for r in graph.components(df, ["g"], "a", "b").collect()}
    assert {v for (g, n), v in got.items() if g == "g" and n.startswith("n")} == {"n000"}
    assert {v for (g, n), v in got.items() if n.startswith("leaf")} == {"hub"} and got[("h", "n001")] == "n000"


def test_paths_use_an_edge_once(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "a", "S")], "src string, dst string, rel string")
    found = graph.paths(edges, spark.createDataFrame([("a",)], "node_id string"), 3)
    got = sorted("".join(r["nodes"]) for r in found.collect())
    assert got == ["ab", "abc", "ac", "acb"]


def test_context_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, "a" * 5), ("q", 2, "b" * 9), ("q", 3, "c")], "query_id string, rank int, text string")
    row = answers.context(df, "query_id", "text", 10).first()
    assert row["context"] == "aaaaa" and row["blocks"] == 1


def test_generation_is_tried_again(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) % 2:
            raise RuntimeError
        return prompt.upper()

    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, p string").coalesce(1)
    assert {r["k"]: r["answer"] for r in answers.generate(df, "k", "p", flaky).collect()} == {1: "X", 2: None}
    assert answers.unfenced("```sql\nSELECT 1;\n```") == "SELECT 1"


def test_coverage_counts_overlaps_once(spark):
    df = spark.createDataFrame([("s", 0, 10, -5, 4), ("s", 0, 10, 2, 6), ("s", 0, 10, 6, 7), ("s", 0, 10, 20, 30)], "k string, a int, b int, x int, y int")
    row = evaluation.coverage(df, ["k", "a", "b"], 0.7).first()
    assert row["coverage"] == 0.7 and row["hit"]


def test_needles(spark):
    df = spark.createDataFrame([(1, "abc abc"), (2, None), (3, "zab")], "doc_id bigint, text string")
    got = {tuple(r) for r in holding(df, "doc_id", "text", [("q1", "ab"), ("q2", "abc"), ("q3", "ab")]).collect()}
    assert got == {("q1", 1), ("q2", 1), ("q3", 1), ("q1", 3), ("q3", 3)}
    assert holding(df, "doc_id", "text", []).count() == 0


def test_text_sanity(spark):
    rows = [("ok", "A plain sentence, 5 words."), ("ctl", "bad \x01 x"), ("few", "....,,,,----====++++ab"), ("one", "a b c d e f g h i j k"), ("nul", None)]
    df = spark.createDataFrame(rows, "k string, t string").select("k", quality.sanity(F.col("t")).alias("r"))
    assert {r["k"]: r["r"] for r in df.collect()} == {"ok": [], "ctl": ["control"], "few": ["few letters"], "one": ["single letters"], "nul": []}


def test_grid_faults(spark):
    grid = spark.createDataFrame([("t", 1, 0, 1, 0, 2), ("t", 2, 0, 1, 1, 2), ("t", 3, 1, 2, 0, 3)], "table_id string, cell int, r0 int, r1 int, c0 int, c1 int")
    size = spark.createDataFrame([("t", 2, 2), ("u", 1, 1)], "table_id string, n_rows int, n_cols int")
    got = {(r["table_id"], r["fault"], r["row"], r["col"]) for r in quality.grid_faults(grid, size).collect()}
    assert got == {("t", "outside", 1, 0), ("t", "overlap", 0, 1), ("u", "hole", 0, 0)}


def test_stages(spark):
    df = spark.createDataFrame([("d", "<!-- PDF page 1 -->\n# T\n\nx\n<!-- PDF page 2 -->\n"), ("n", None)], "k string, t string")
    assert [(r["label"], r["start"]) for r in models.run_stage(df, "k", "t", "pages").collect()] == [("page", 1), ("page", 2)]
    assert [r["end"] for r in models.run_stage(spark.createDataFrame([("d", "One two. Three.")], "k string, t string"), "k", "t", "speech").collect()] == [800, 1200]


def test_global_rank(spark):
    df = spark.range(0, 5_000, 1, 7).withColumn("x", F.col("id") % 10)
    got = [(r["x"], r["id"]) for r in relational.global_rank(df, F.desc("x"), F.col("id")).orderBy("rank").collect()]
    assert got == sorted(((i % 10, i) for i in range(5_000)), key=lambda v: (-v[0], v[1]))
    assert relational.global_rank(df, F.col("id")).agg(F.max("rank")).first()[0] == 5_000
    assert relational.global_rank(df.where("false"), F.col("id")).count() == 0


def test_gold_is_the_whole_passage(spark):
    """Only the documents that hold all of it, however it is wrapped."""
    from strataquill.operators import evaluation

    passage = "The log of Keslunto names valve E8048 as the cause, since it leaked."
    asked = spark.createDataFrame([("q", passage), ("blank", " \n")], "query_id string, text string")
    texts = [passage, "x " + passage.replace("log of", "log\r\n  of").replace("names ", "names\u00a0") + " y", passage[:60] + " was worn.", "", None]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(tuple(r) for r in evaluation.containing_whole(asked, documents).collect()) == [("q", 0), ("q", 1)]


def test_coverage_follows_the_ranking(spark):
    gold = spark.createDataFrame([("q", "d", 10, 110), ("r", "d", 0, 50)], "query_id string, source_document string, a bigint, b bigint")
    ranked = [("q", "d", 1, 0, 60), ("q", "d", 2, 50, 95), ("q", "e", 3, 0, 500), ("q", "d", 6, 0, 500), ("r", "e", 1, 0, 50)]
    rankings = spark.createDataFrame(ranked, "query_id string, source_document string, rank bigint, x int, y int")
    got = {r["query_id"]: (r["coverage"], r["hit"]) for r in evaluation.coverage_hits(rankings, gold).collect()}
    assert got == {"q": (0.85, True), "r": (0.0, False)}


def test_section_spans(spark):
    from strataquill.operators import markdown

    text = "lead\n# A\nx\n## B\nyé\n# C\nz"
    rows = markdown.section_spans(spark.createDataFrame([("d", text)], "document_id string, markdown string")).orderBy("x").collect()
    assert [text[r["x"] : r["y"]] for r in rows] == [r["content"] for r in rows] == ["lead\n", "# A\nx\n", "## B\nyé\n", "# C\nz"]
    assert [text[r["x"] : r["whole"]] for r in rows] == ["lead\n", "# A\nx\n## B\nyé\n", "## B\nyé\n", "# C\nz"]


def test_hash_copies_tell_late_differences(spark):
    texts = ["a" * 250, "a" * 250 + "x", "a" * 150 + "y", None, "a" * 250]
    rows = relational.hash_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text").collect()
    got = sorted((r["form"], r["doc_id"], r["copies"]) for r in rows)
    assert got == [("100", 0, 4), ("200", 0, 3), ("200", 2, 1), ("full", 0, 2), ("full", 1, 1), ("full", 2, 1)]
