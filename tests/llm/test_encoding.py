import os

import pytest

from strataquill.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.DEFAULT_VOCABULARY), reason="no vocabulary")
TEXTS = ["Hello  world's end\n\n x", "", None, "x" * 5_000, "日本語のテキスト" * 30, "<|endoftext|> 'll \x1c\x85 ", "é́ \U0001f469‍\U0001f527 1234567", "a" * 3 + "b" * 17 + "\t\t \r\n", "ภาษาไทย हिन्दी العربية", "aaaaaaab" * 50]


def test_equals_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS * 2)], "doc_id bigint, text string, ids int")
    got = {r[0]: r[1] for r in E.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS * 2)}
    back = {r[0]: r[1] for r in E.decode(E.encode(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS * 2)}


def test_empty(spark):
    assert E.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_blocks_do_not_change_ids(monkeypatch):
    table = E.merge_table(E.DEFAULT_VOCABULARY)
    whole = E.WordEncoder(*table).encode(TEXTS)
    monkeypatch.setattr(E, "BLOCK_WORDS", 2)
    monkeypatch.setattr(E, "BLOCK_BYTES", 10)
    monkeypatch.setattr(E, "KEPT_WORDS", 3)
    small = E.WordEncoder(*table)
    assert [small.encode([x])[0] for x in TEXTS] == whole


def test_decoding(spark):
    df = spark.createDataFrame([(1, [39, 72]), (2, None), (3, []), (4, [0])], "doc_id bigint, ids array<int>")
    assert {r[0]: len(r[1]) for r in E.decode(df).collect()} == {1: 2, 2: 0, 3: 0, 4: 1}
    with pytest.raises(Exception, match="lacks"):
        E.decode(spark.createDataFrame([(1, [10**6])], "doc_id bigint, ids array<int>")).collect()


def test_other_vocabularies_are_refused(tmp_path):
    import json

    file = json.loads(open(E.DEFAULT_VOCABULARY, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": file["model"] | {"end_of_word_suffix": "</w>"}}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(file | change), encoding="utf-8")
        with pytest.raises(ValueError):
            E.merge_table(str(path))
