import io
import zipfile

import pytest

from strataquill.operators import relational
from strataquill.sources import documents as D
from strataquill.sources import files as F
from strataquill.sources import sinks


def test_html():
    text = "<title>t</title><div hidden>no<div>no</div>no</div><h2>A &amp; B</h2><p>one<p>two<script>x</script><ul><li>l1<ul><li>l2</ul></ul><table><tr><th rowspan=2>h<td>a<tr><td>b</table>"
    assert D.html_blocks(text) == [("paragraph", 0, "t"), ("heading", 2, "A & B"), ("paragraph", 0, "one"), ("paragraph", 0, "two"), ("list_item", 1, "l1"), ("list_item", 2, "l2")]
    assert [c[1:] for c in D.html_cells(text)] == [(0, 2, 0, 1, True, "h"), (0, 1, 1, 2, False, "a"), (1, 2, 1, 2, False, "b")]
    assert D.html_blocks("") == []


def test_other_texts():
    assert D.webvtt_blocks("WEBVTT\n\n00:01.000 --> 00:02.000\nhi <b>x</b>\n") == [("cue", 1000, "hi x")]
    assert D.email_blocks("Subject: S\n\none\n\ntwo\n") == [("heading", 1, "S"), ("paragraph", 0, "one"), ("paragraph", 0, "two")]
    assert D.asciidoc_blocks("= T\n\npara\nmore\n\n* a\n** b") == [("heading", 1, "T"), ("paragraph", 0, "para more"), ("list_item", 1, "a"), ("list_item", 2, "b")]
    assert D.xml_blocks("<article><front><article-title>T</article-title></front><sec><title>S</title><p>x</p></sec></article>") == [("heading", 1, "T"), ("heading", 2, "S"), ("paragraph", 0, "x")]
    assert D.xml_blocks("<broken") == []


def test_office():
    def packed(**parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, x in parts.items():
                z.writestr(n, x)
        return b.getvalue()

    docx = packed(**{"word/document.xml": '<w:document xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>te</w:t><w:t>xt</w:t></w:r></w:p></w:document>'})
    assert D.office_blocks(docx) == [("heading", 2, "Head"), ("paragraph", 0, "text")]
    xlsx = packed(**{"xl/sharedStrings.xml": "<sst><si><t>a</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><c t="s"><v>0</v></c><c><v>5</v></c></s>'})
    assert D.office_blocks(xlsx) == [("cell", 0, "a"), ("cell", 0, "5")]
    assert D.office_blocks(b"no zip") == []


@pytest.mark.parametrize(("path", "head", "kind"), [("a.md", b"# x", "markdown"), ("a", b"%PDF-1.7", "pdf"), ("a.docx", b"PK\x03\x04", "docx"), ("a", b"PK\x03\x04", "zip"), ("a", b"<!DOCTYPE html>", "html"), ("x", b"WEBVTT\n", "webvtt"), (None, None, "empty"), ("a", b"{}", "json"), ("a", b"\x89PNG", "image")])
def test_formats(path, head, kind):
    assert F.format_of(path, head) == kind


def test_manifest_with_mark_and_bad_hash(spark, tmp_path):
    good = "a" * 63 + "B"
    head = "id,category,title,organization,source_url,local_path,pages,bytes,sha256,loaded_at\n"
    p = tmp_path / "m.csv"
    p.write_text("﻿" + head + f'1,c,"t, ""q""",o,,p,1,2,{good},\n', encoding="utf-8")
    row = F.manifest_csv(spark, str(p)).first()
    assert row["sha256"] == good.lower() and row["title"] == 't, "q"'
    p.write_text(head + "1,c,t,o,,p,1,2,xyz,\n", encoding="utf-8")
    with pytest.raises(Exception, match="bad hash"):
        F.manifest_csv(spark, str(p)).collect()


def test_corpus_must_be_utf8(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "document.md").write_bytes("ä".encode())
    assert [tuple(r)[:2] for r in F.canonical_corpus(spark, str(tmp_path)).collect()] == [("one", "ä")]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "document.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):  # noqa: B017
        F.canonical_corpus(spark, str(tmp_path)).collect()


def test_publish_keeps_the_last_good_run(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    sinks.publish(spark.range(3), root)
    with pytest.raises(ValueError):
        sinks.publish(spark.range(0), root)
    assert sinks.published(spark, root).count() == 3
    sinks.publish(spark.range(5), root)
    assert sinks.published(spark, root).count() == 5


def test_guarded_select(spark):
    spark.range(500).createOrReplaceTempView("numbers_500")
    assert relational.guarded_select(spark, "SELECT * FROM numbers_500").count() == 100
    assert relational.guarded_select(spark, "SELECT * FROM numbers_500 LIMIT 200").count() == 200
    assert relational.guarded_select(spark, "SELECT * FROM (SELECT * FROM numbers_500 LIMIT 300)").count() == 100
    for bad in ("DROP VIEW numbers_500", "INSERT INTO numbers_500 VALUES (1)", "CREATE TABLE x (a INT)"):
        with pytest.raises(Exception):  # noqa: B017
            relational.guarded_select(spark, bad)
    assert spark.table("numbers_500").count() == 500


def test_only_reading_statements_run(spark):
    spark.range(500).createOrReplaceTempView("numbers_500")
    run = relational.guarded_select
    assert run(spark, "WITH x AS (SELECT * FROM numbers_500) SELECT * FROM x LIMIT 300").count() == 300
    assert run(spark, "WITH x AS (SELECT * FROM numbers_500 LIMIT 300) SELECT * FROM x").count() == 100
    for good in ("SELECT id, count(*) OVER (PARTITION BY id) FROM numbers_500", "SELECT id FROM numbers_500 UNION SELECT 1 ORDER BY 1", "VALUES (1), (2)", "SELECT a.id FROM numbers_500 a JOIN numbers_500 b ON a.id = b.id GROUP BY 1 HAVING count(*) > 0", "SELECT id FROM numbers_500 WHERE id IN (SELECT max(id) FROM numbers_500)", "SELECT explode(array(1, 2))"):
        run(spark, good).count()
    for bad in (
        "TRUNCATE TABLE numbers_500", "ALTER TABLE numbers_500 RENAME TO n", "ALTER TABLE numbers_500 ADD COLUMNS (x INT)", "CACHE TABLE numbers_500", "LOAD DATA INPATH '/tmp/x' INTO TABLE numbers_500",
        "MSCK REPAIR TABLE numbers_500", "WITH x AS (SELECT 1) INSERT INTO numbers_500 SELECT * FROM x", "SET spark.sql.shuffle.partitions=1", "USE other", "REFRESH TABLE numbers_500", "ADD JAR '/tmp/x.jar'",
        "DESCRIBE numbers_500", "EXPLAIN SELECT 1", "SELECT reflect('java.lang.System', 'exit', 1)", "CALL x()", "DELETE FROM numbers_500", "UPDATE numbers_500 SET id = 1",
    ):
        with pytest.raises(Exception):  # noqa: B017
            run(spark, bad)


def test_registry_is_a_gate(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    side = [("a", "AA"), ("a", "AA"), ("b", "bb")]
    rows = [("aa", "T", "u", None), ("AA", "T", "u", None), ("BB", "S", None, "p")]
    frames = lambda s, r: (docs, spark.createDataFrame(s, "document_id string, source_sha256 string"), spark.createDataFrame(r, "sha256 string, title string, source_url string, local_path string"))
    assert {r["document_id"]: r["source"] for r in relational.strict_registry(*frames(side, rows)).collect()} == {"a": "u", "b": "p"}
    for s, r, fault in (
        (side, [*rows, ("bb", "other", None, "p")], "duplicate manifest hash"), ([*side, ("b", "aa")], rows, "duplicate sidecar"), (side, rows[:2], "no manifest row"),
        (side, [*rows[:2], ("bb", " ", None, "p")], "no title"), (side, [*rows[:2], ("bb", "S", "", None)], "no source"),
    ):
        with pytest.raises(ValueError, match=fault):
            relational.strict_registry(*frames(s, r))


def test_separators():
    assert [F.sniffed(x) for x in ("a;b\n1;2,5\n", "a,b\n", "", "x", "a\tb\n1\t2", "t: x|y\nu: z|w")] == [";", ",", ",", ",", "\t", "|"]


def test_regions_with_merged_cells(spark):
    from strataquill.operators import graph

    cells = spark.createDataFrame([("s", 0, 0, 2, 2), ("s", 2, 1, 1, 1), ("s", 2, 3, 1, 1), ("s", 9, 9, 1, 1), ("s", 9, 9, None, None)], "sheet string, row int, col int, height int, width int")
    got = sorted(tuple(r)[1:] for r in graph.flood_regions(cells, "sheet").collect())
    assert got == [(0, 0, 2, 1, 5), (2, 3, 2, 3, 1), (9, 9, 9, 9, 1)]
    assert sorted(tuple(r)[1:] for r in graph.flood_regions(cells, "sheet", 1).collect()) == [(0, 0, 2, 3, 6), (9, 9, 9, 9, 1)]


def test_append_reads_only_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.append_new(spark.range(0, 100), path, "id")
    sinks.append_new(spark.range(50, 150), path, "id")
    assert sinks.stored(spark, path).count() == 150 and sinks.stored(spark, path).columns == ["id"]
