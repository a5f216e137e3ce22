from strataquill.llm import repeats as R

LEGAL, SHARE = "All rights reserved by the makers", "SHARE this page with all your friends"


def frames(spark, docs, manifest=None):
    documents = spark.createDataFrame([(d, t, None, 1) for d, t in docs], "document_id string, markdown string, loaded_at timestamp, organization int")
    reports = spark.createDataFrame([(d, h, "x") for d, h in [(d, f"H{d}".upper()) for d, _ in docs] for _ in (0, 1)], "document_id string, source_sha256 string, category string")
    rows = manifest or [(f"h{d}", " ACME ", "Mill") for d, _ in docs]
    return documents, reports, spark.createDataFrame([(*r, "k") for r in rows], "sha256 string, organization string, category string, key string")


def found(spark, docs, manifest=None, **more):
    lines = R.publisher_lines(*frames(spark, docs, manifest))
    return sorted(tuple(r) for r in R.repeated_lines(lines, R.repeated_keys(lines, **more)).collect())


def test_counts_documents_not_lines(spark):
    docs = [("1", f"one alone\n{LEGAL}"), ("2", f"{LEGAL}!!\n\ntext"), ("3", f"**{LEGAL.upper()}** 5"), ("4", f"{SHARE}\n{SHARE}\n{SHARE}"), ("5", ""), ("6", None), ("7", "too short\ntoo short")]
    assert found(spark, docs) == [("1", 1), ("2", 0), ("3", 0)]


def test_share_of_the_publisher(spark):
    docs = [(str(i), LEGAL if i < 3 else f"own text number {'x' * i} of this document") for i in range(13)]
    assert found(spark, docs) == []
    assert [d for d, _ in found(spark, docs[:12])] == ["0", "1", "2"]


def test_copies_count_but_can_be_told_apart(spark):
    docs = [(str(i), f"the very same article\n{LEGAL}") for i in range(4)]
    assert len(found(spark, docs)) == 8
    assert found(spark, docs, min_clusters=2) == []


def test_publishers_with_nulls_neither_count_nor_hold(spark):
    docs = [(str(i), LEGAL) for i in range(5)]
    manifest = [("h0", "Acme", "mill"), ("h1", "acme ", "MILL"), ("h2", "ACME", None), ("h3", None, "mill")]
    assert found(spark, docs, manifest) == []
    manifest[2] = ("H2", "\tacme", "mill")
    assert found(spark, docs, manifest) == [("0", 0), ("1", 0), ("2", 0)]


def test_clean_text(spark):
    docs = [(str(i), f"own {i}\n{LEGAL}\r\nend") for i in range(3)] + [("n", None)]
    documents, *rest = frames(spark, docs)
    lines = R.publisher_lines(documents, *rest)
    text = {r[0]: r[1] for r in R.without_lines(documents, R.repeated_lines(lines, R.repeated_keys(lines))).collect()}
    assert text == {"0": "own 0\nend", "1": "own 1\nend", "2": "own 2\nend", "n": None}


def test_empty(spark):
    docs = [("1", LEGAL)]
    documents, reports, manifest = frames(spark, docs)
    lines = R.publisher_lines(documents.where("false"), reports, manifest)
    assert R.repeated_lines(lines, R.repeated_keys(lines)).count() == 0


def test_republished_articles_are_no_boilerplate(spark):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, 1 + n)
    article = "the article that is published again and again"
    docs = [(f"a{i}", article, day(i)) for i in range(6)] + [(f"b{i}", f"{LEGAL}\nown text of number {'x' * i} only", day(i)) for i in range(4)] + [(f"c{i}", f"{SHARE}\nanother text of number {'y' * i}", day(0)) for i in range(4)]
    documents = spark.createDataFrame(docs, "document_id string, markdown string, loaded_at timestamp")
    _, reports, manifest = frames(spark, [d[:2] for d in docs])
    lines = R.publisher_lines(documents, reports, manifest)
    by_documents = {d for d, _ in map(tuple, R.repeated_lines(lines, R.repeated_keys(lines)).collect())}
    assert by_documents == {*(f"a{i}" for i in range(6)), *(f"b{i}" for i in range(4)), *(f"c{i}" for i in range(4))}
    got = sorted(tuple(r) for r in R.repeated_lines(lines, R.boilerplate_keys(lines)).collect())
    # neither the article (one text) nor the lines of one day
    assert got == [(f"b{i}", 0) for i in range(4)]
