import random

from strataquill.operators import tree_links as T

SCHEMA = "section_id string, parent_section_id string, depth int, path string"


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in pairs], SCHEMA)


def brute(pairs):
    norm = lambda x: (x or "").strip().lower()
    parent, label = {}, {}
    for a, b in pairs:
        if norm(a):
            label[norm(a)] = min(a, label.get(norm(a), a))
            parent[norm(a)] = min((x for x in (norm(b), parent.get(norm(a))) if x), default=None)
    out = {}
    for k in parent:
        seen, x, chain = {k}, k, [k]
        while True:
            p = parent[x]
            if p is None or p not in parent:
                out[label[k]] = (label[x], len(chain) - 1, [label[c] for c in reversed(chain)])
                break
            if p in seen:
                out[label[k]] = ("", -1, None)
                break
            seen.add(p)
            chain.append(p)
            x = p
    return out


PAIRS = [
    ("a", None), ("b", "a"), ("c", " B "), ("d", "C"), ("e", "nowhere"), ("f", ""), ("g", "g"), ("h", "i"), ("i", "h"), ("j", "h"), ("k", "j"),
    ("b", "a"), (None, "a"), ("  ", "a"), ("L", "d"), ("m", "l"),
]


def test_against_following_the_links(spark):
    rng = random.Random(3)
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(70)]
    star = [(f"s{i}", "a") for i in range(200)]
    wild = [(f"w{i}", f"w{rng.randrange(120)}") for i in range(100)]
    pairs = PAIRS + chain + star + wild
    expected = brute(pairs)
    got = {r[0]: (r[1], r[2]) for r in T.roots_and_depths(frame(spark, pairs)).collect()}
    assert got == {k: v[:2] for k, v in expected.items()}
    paths = {r[0]: r[3] for r in T.full_paths(frame(spark, pairs)).collect()}
    assert paths == {k: v[2] for k, v in expected.items()}


def test_descendants_and_cycles(spark):
    df = frame(spark, PAIRS)
    pairs = {tuple(r) for r in T.descendants(df).collect()}
    assert ("a", "m", 5) in pairs and ("c", "d", 1) in pairs and not any(p[0] == "m" for p in pairs)
    found = {r[0]: (r[1], r[2]) for r in T.circular_links(df).collect()}
    assert found == {"g": ("g", True), "h": ("h", True), "i": ("h", True), "j": ("h", False), "k": ("h", False)}


def test_empty(spark):
    df = frame(spark, [])
    assert T.roots_and_depths(df).count() == 0 and T.full_paths(df).count() == 0 and T.circular_links(df).count() == 0
