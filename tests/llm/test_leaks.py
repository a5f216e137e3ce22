import random

from strataquill.llm import leaks as L

EN = "the log of the tall crew names valve seven as the cause since its violet seat had lost many grams of lead"
ZH = "试验台第二工位的磨砂试样取自炉号在千牛下保持分钟直到透镜在槽旁张开夹头才松脱记录完"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item string")
    e = spark.createDataFrame([(g, t, 1) for g, t in items], "gold_group_id string, evidence_text string, doc_id int")
    return sorted(tuple(r) for r in L.leaked(d, e).collect())


def test_windows_and_forms(spark):
    w = EN.split()
    docs = [
        EN, " ".join(w[3:15]), " ".join(w[3:14]), "x " + ",\n".join(w[5:18]).upper() + " y", None, "", " ".join(w[:11]) + " other " + " ".join(w[12:]),
        "Ｔ" + EN[1:], EN.replace("valve", "va­l​ve"), "前" + ZH[5:29] + "后", ZH[5:28] + "后", ZH[:12] + "，\n" + ZH[12:30], EN + " " + EN + " " + ZH,
    ]
    got = run(spark, docs, [("e", EN), ("e", EN), ("z", ZH), ("n", None), ("s", "too short to be found"), ("b", "")])
    assert got == [(0, "e"), (1, "e"), (3, "e"), (7, "e"), (8, "e"), (9, "z"), (11, "z"), (12, "e"), (12, "z")]


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    items = [(f"g{i}", " ".join(rng.choices(words, k=rng.randrange(10, 40)))) for i in range(12)]
    docs = []
    for _ in range(60):
        parts = rng.choices(words, k=rng.randrange(0, 60))
        if rng.random() < 0.6:
            src = rng.choice(items)[1].split()
            a = rng.randrange(len(src))
            parts += src[a : a + rng.randrange(8, 20)] + rng.choices(words, k=3)
        docs.append(" ".join(parts))
    expected = set()
    for i, d in enumerate(docs):
        w = d.split()
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        expected |= {(i, g) for g, t in items if any(tuple(t.split()[k : k + 12]) in have for k in range(len(t.split()) - 11))}
    assert expected and run(spark, docs, items) == sorted(expected)


def test_empty_tables(spark):
    assert run(spark, [EN], [("n", None)]) == []
    d = spark.createDataFrame([], "doc_id bigint, text string")
    e = spark.createDataFrame([("g", EN)], "gold_group_id string, evidence_text string")
    assert L.leaked(d, e).count() == 0


def test_runs_longer_than_a_block(spark):
    """Each window of a long item is found wherever it stands, also across blocks and in a text that repeats it."""
    words = [f"v{i}" for i in range(900)]
    item = " ".join(words)
    docs = [" ".join(words[a : a + 12]) for a in range(0, 880, 37)] + [" ".join(words * 3), " ".join(words[:600] + ["gap"] + words[600:]), " ".join(x for a in range(0, 880, 11) for x in words[a : a + 11] + ["gap"])]
    got = run(spark, docs, [("g", item)])
    assert [i for i, _ in got] == list(range(len(docs) - 1))
