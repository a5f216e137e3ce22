import pytest

from strataquill.llm import lookalikes as L


@pytest.fixture(scope="module")
def table(spark):
    return L.shape_table(L.icu_skeletons(spark))


SAME = [
    ("Ｗｅｌｄ　５", "Weld 5"), ("é", "é"), ("ﬁx", "fix"), ("Ⅱ", "II"), ("㎜", "mm"), ("cаre", "care"), ("Ιnіtіаl", "Initial"), ("a​b­c﻿", "abc"),
    ("a b c", "a b c"), ("加⼯", "加工"), ("µ‐level", "μ-level"), ("5 Ω", "5 Ω"), ("Å", "Å"), ("ΤΕΣΤ"[:2], "TE"), ("m²", "m²"), ("㎡", "m²"), ("“x”", '"x"'),
]
DIFFERENT = [("Weld", "weld"), ("é", "e"), ("x³", "x3"), ("H₂O", "H2O"), ("½", "1/2"), ("I", "l"), ("1", "l"), ("0", "O"), ("m", "rn"), ("a.", "a"), ("①", "1"), ("a b", "a  b"), ("|", "l"), ("'", "`"), ("ä", "a")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(table, a, b):
    assert L.look_key(a, table) == L.look_key(b, table)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(table, a, b):
    assert L.look_key(a, table) != L.look_key(b, table)


def test_ascii_stays(table):
    for c in range(0x20, 0x7F):
        assert L.look_key(chr(c), table) == chr(c)


def test_script_of_a_token(table):
    letters = L.spellings(table)
    assert L.consistent_form(L.look_key("Жаbа", table), letters).startswith("Ж")
    assert L.consistent_form(L.look_key("care", table), letters) == "care"
    a, b = L.look_key("ЖОРА", table), L.look_key("ЖOPA", table)
    assert a == b and L.consistent_form(a, letters) == L.consistent_form(b, letters) == "ЖОРА"
    assert L.token_state("cаre", table) == "mixed" and L.token_state("ＡＢ", table) == "form" and L.token_state("сор", table) == "whole" and L.token_state("plain", table) == "plain"


def test_pairs(spark):
    cells = spark.createDataFrame([("c1", "d", "Wеld", 1), ("c1", "d", "Wеld", 2), ("c2", "d", "Weld", 1), ("c3", "d", None, 1), ("c4", "d", "", 1), ("c5", "e", "Wеld", 1), ("c6", "d", "Weld", 1)], "source_ref string, document_id string, text string, heading int")
    nodes = spark.createDataFrame([("s1", "d", "Weld", "x"), ("s1", "d", "Weld", "x"), ("s2", "d", "Ｗeld", "x"), ("s3", "d", None, "x"), ("s4", "d", "weld", "x")], "section_id string, document_id string, heading string, text string")
    got = sorted(tuple(r) for r in L.same_look_pairs(cells, nodes).collect())
    assert got == [("c1", "s1"), ("c1", "s2"), ("c2", "s2"), ("c6", "s2")]
    assert L.same_look_pairs(cells.where("false"), nodes).count() == 0


def test_all_scripts(table):
    where = L.homes(table)
    assert L.token_state("ગಕ", table, where) == "mixed"  # Gujarati and Kannada
    assert L.token_state("ગક", table, where) != "mixed" and L.token_state("漢字かな", table, where) != "mixed"
    assert {"Gujarati", "Kannada", "Khmer", "Tibetan", "Yi", "Nko"} <= L.SCRIPT_PATTERNS.keys()
    assert L.token_state("сор", table, where) == "whole" and L.token_state("слово", table, where) != "whole"
    # looks of two scripts besides Latin: Greek and Coptic or Cyrillic gamma and the like
    shared = [k for k, v in where.items() if not k.isascii() and len(v) > 1]
    assert shared and all(L.other_scripts([k, k], where) == where[k] for k in shared) and not L.other_scripts(["\U000e0001"], where)


def test_plain_texts_stay_out_of_python(spark):
    df = spark.createDataFrame([("a b~",), ("é",), (None,), ("",), ("a\tb",), ("Ｗ",)], "t string")
    got = [tuple(r["f"]) for r in df.withColumn("f", L.Lookalikes(spark).form(L.F.col("t"))).collect()]
    assert got == [("a b~", "plain"), ("é", "plain"), (None, None), ("", "plain"), ("a b", "plain"), ("W", "form")]
