import os

import pytest

from strataquill.llm import sentences as S

@pytest.fixture(scope="module")
def weights():
    """Trained as in production, on the texts of the smallest test table."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    return S.train([*S.SEEDS, *(t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t)])


CASES = [
    ("The pump was cold. The crew left.", ["The pump was cold.", "The crew left."]),
    ("Dr. Miller came at 4 p.m. The crew left.", ["Dr. Miller came at 4 p.m.", "The crew left."]),
    ("Approx. 3.5 kN, i.e. less.", ["Approx. 3.5 kN, i.e. less."]),
    ("Am 3. Mai kam er. Die Welle steht.", ["Am 3. Mai kam er.", "Die Welle steht."]),
    ("He said: “Stop. Wait.” in red ink. The end.", ["He said: “Stop. Wait.” in red ink.", "The end."]),
    ("It ran. (The seal was new.) It broke.", ["It ran.", "(The seal was new.)", "It broke."]),
    ("供应商说：“停机。等待。”然后离开。检验完成！", ["供应商说：“停机。等待。”然后离开。", "检验完成！"]),
    ("A title\n\ntext goes\non here; still: one\n \nnext", ["A title", "text goes\non here; still: one", "next"]),
    ("before\n- one. two. three\n2) four. Five\nafter", ["before", "- one. two. three", "2) four. Five", "after"]),
    ("  CRLF one.\r\n\r\nTwo.\r\n", ["CRLF one.", "Two."]),
    ("ตรวจเพลา ใช้สกรู M4 กับเพลา ค่า 5.1 มม. และ ดี", ["ตรวจเพลา", "ใช้สกรู M4 กับเพลา", "ค่า 5.1 มม. และ", "ดี"]),
    ("यह ठीक है। सब ठीक।", ["यह ठीक है।", "सब ठीक।"]),
    ("", []), (" \n\t\n", []), ("x", ["x"]), ("an “open quote. Then more. And more", ["an “open quote.", "Then more.", "And more"]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_split(weights, text, expected):
    assert [text[a:b] for a, b in S.split(text, weights)] == expected


def test_spans_cover_all_but_white_space(weights):
    text = "\n".join(t for t, _ in CASES) + "!!! ... ?\n" + "y" * 5000
    spans = S.split(text, weights)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left = list(text)
    for a, b in spans:
        left[a:b] = " " * (b - a)
    assert not "".join(left).strip()


def test_held_out_paragraph_ends(weights):
    """Reliable labels of texts that weren't trained on."""
    held = ["The seal was warm. The team left.\n\nProf. Kim came at 6 p.m. The gauge was new.\n\nNo. 7 held.", "Die Welle wiegt ca. 9 kg. Die Pumpe steht.\n\nSchluss."]
    rows = [r for t in held for r in S.reliable(t, weights.usage)]
    right = sum((weights.weights[f].sum() > 0) == bool(y) for f, y in rows)
    assert rows and right >= 0.9 * len(rows)


def test_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, start_pos string")
    got = S.sentences(df)
    assert got.columns == ["doc_id", "start_pos", "end_pos"] and {r[0] for r in got.collect()} == {1}
    assert S.sentences(df.where("false")).count() == 0


OTHER_SCRIPTS = [
    "Սա նախադասություն է։ Սա մյուսն է։", "ይህ ዓረፍተ ነገር ነው። ይህ ሌላ ነው።", "នេះជាប្រយោគ។ នេះជាប្រយោគមួយទៀត។", "ဒါက ဝါကျ ဖြစ်တယ်။ နောက်တစ်ခု ရှိတယ်။",
    "འདི་ཚིག་གྲུབ་ཡིན། འདི་གཞན་ཞིག་ཡིན།", "Πού είναι η αντλία\u037e Είναι εδώ.", "یہ ایک جملہ ہے۔ یہ دوسرا ہے۔",
]


@pytest.mark.parametrize("text", OTHER_SCRIPTS)
def test_marks_of_other_scripts(weights, text):
    assert len(S.split(text, weights)) == 2


def test_abbreviations_are_learned_from_the_corpus():
    """Words that no list names, from how they stand in the texts."""
    names = ["Brown", "Hall", "Grey", "Stone", "Holm", "Kern", "Rowe", "Shaw"]
    texts = [f"We met Gov. {n} and Hrsg. {n} there. The pump was sound. It ran well." for n in names] + ["The team left the hall.\n\nIt ran well.\n\nThe pump was sound."] * 3
    assert not {"gov", "hrsg"} & S.ABBREVIATIONS
    model = S.train([*S.SEEDS, *texts])
    assert {"gov", "hrsg"} <= model.usage.before and not {"well", "sound", "there"} & model.usage.before
    text = "Then Gov. Miller came with Hrsg. Lind. The valve held."
    assert [text[a:b] for a, b in S.split(text, model)] == ["Then Gov. Miller came with Hrsg. Lind.", "The valve held."]


def test_brackets_are_linear(weights):
    import time

    began = time.perf_counter()
    for text in ("(" * 100_000, "“" * 100_000 + " a. B", "( a. " * 50_000, "(a) " * 50_000, "\" a. " * 50_000, "." * 200_000, ". " * 100_000):
        S.split(text, weights)
    assert time.perf_counter() - began < 20


def test_quotations_as_before():
    text = 'a (b (c) d) “e «f» g” „k“ "h" («i») 「j'
    assert [text[a:b] for a, b in S.protected(text, 0, len(text))] == ["(b (c) d)", "“e «f» g”", "„k“", '"h"', "(«i»)"]
