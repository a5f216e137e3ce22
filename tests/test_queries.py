"""Queries against their SQL on the smallest test tables; skipped where the tables aren't there."""

import datetime
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = "str04 str05 str09 hie01 hie04 hie06 chk05 chk12 chk13 joi01 joi04 joi09 joi12 joi13 agg05 agg08 win05 srt02 set02 set08 vec02 vec04 lex02 fus04 rrk02 gra08 gra09 gra15 qlt03 tbl05 gen01 gen03 eva01 eva03 src04 src19 snk01 snk09".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        if isinstance(v, (list, tuple)):
            return tuple(one(x) for x in v)
        if isinstance(v, (datetime.datetime, datetime.date)):
            return v.isoformat()
        return v if v is None else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert canonical(got) == canonical([tuple(r[i] for i in order) for r in result.fetchall()])


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_parsed_headings_are_the_given_ones(spark):
    from strataquill.operators import hierarchy, markdown

    docs = spark.read.parquet(f"{FOLDER}/document_md.parquet")
    given = hierarchy.heading_rows(spark.read.parquet(f"{FOLDER}/section_nodes.parquet")).select("document_id", "level", "start").join(docs.select("document_id"), "document_id", "left_semi")
    parsed = markdown.headings(docs).select("document_id", "level", "start_line")
    assert parsed.exceptAll(given).count() == 0 and given.exceptAll(parsed).count() == 0


def test_approximate_search_recall(spark):
    exact = {(r[0], r[1]) for r in entry.queries()["vec02"](spark, FOLDER).where("rank <= 10").collect()}
    for name in ("vec05", "vec06"):
        found = {(r["query_id"], r["vec_id"]) for r in entry.queries()[name](spark, FOLDER).collect()}
        assert len(found & exact) >= 0.9 * len(exact)
