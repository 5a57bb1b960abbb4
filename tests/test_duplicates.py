"""Duplicates, similarity and groups against brute force; nulls, ties, empty tables and clashing columns."""

import random
import re
import string

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import dedup, graph


def _tokens(t):
    return [w for w in re.split(r"\s+", (t or "").translate(str.maketrans("", "", string.punctuation))) if w]


def _shingles(t, k=3):
    w = _tokens(t)
    return frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset()


def _jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0


def _bucket(sh):
    import hashlib

    return int(hashlib.md5(min(sh).encode()).hexdigest(), 16) % 1000 if sh else 0


def _texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    base = [" ".join(rng.choices(words, k=rng.choice([2, 8, 14]))) for _ in range(25)]
    out = []
    for _ in range(140):
        w = rng.choice(base).split()
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return [*out, None, "", "  ", "a, b", base[0] + "!"]


def test_near_dedup_equals_greedy_pass(spark):
    texts = _texts()
    want, kept = {}, {}
    for i, t in enumerate(texts):
        sh = _shingles(t)
        hit = next(((j, _jaccard(o, sh)) for j, o in kept.get(_bucket(sh), []) if _jaccard(o, sh) >= 0.6), None)
        want[f"r{i}"] = (f"r{hit[0]}", round(hit[1], 4)) if hit else (None, None)
        if not hit:
            kept.setdefault(_bucket(sh), []).append((i, sh))
    df = spark.createDataFrame([(f"r{i}", i, t, "x", 1) for i, t in enumerate(texts)], "id string, ord long, t string, sh string, c int")
    got = {r.id: (r.anchor_id, r.similarity) for r in dedup.near_dedup(df, text.tokens("t"), 0.6).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_similar_pairs_miss_none(spark):
    texts = _texts()
    df = spark.createDataFrame([(f"r{i}", i, t) for i, t in enumerate(texts)], "id string, ord long, t string")
    pairs, members = dedup.near_pairs(df, text.tokens("t"), 0.5, digest="md5")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(_shingles(t), i)
    want = {(f"r{a}", f"r{b}") for x, a in first.items() for y, b in first.items() if a < b and x and y and _bucket(x) == _bucket(y) and _jaccard(x, y) >= 0.5}
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == want and want
    assert {(r.id, r.anchor_id) for r in members.collect()} == {(f"r{i}", f"r{first[_shingles(t)]}") for i, t in enumerate(texts)}


def test_exact_dedup_keeps_the_first(spark):
    rows = [("b", 2, "X"), ("a", 1, " x "), ("c", 3, None), ("d", 4, None), ("e", 5, "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, ord long, t string, anchor string")
    got = {r.id: r.anchor_id for r in dedup.exact_dedup(df, text.normalize("t")).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": "c", "e": None}
    assert dedup.exact_dedup(df.limit(0), text.normalize("t")).collect() == []
    null = {r.id: r.anchor_id for r in dedup.exact_dedup(df, F.col("t")).collect()}
    assert null["d"] == "c" and null["b"] is None


def test_examples_of_each_reason(spark):
    df = spark.createDataFrame([(f"r{i}", i, "a" if i % 2 else "b", "x", "p" * 200) for i in range(30)], "id string, ord long, reason string, anchor_id string, prompt string")
    rows = dedup.duplicate_examples(df, 3).collect()
    assert sorted(r.id for r in rows) == sorted(["r0", "r2", "r4", "r1", "r3", "r5"]) and {len(r.prompt_snippet) for r in rows} == {80}


def test_components(spark):
    ids = spark.createDataFrame([(i,) for i in ["a", "b", "c", "d", "e", None]], "id string")
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("b", "c"), ("d", "d"), (None, "e")], "a string, b string")
    assert {tuple(r) for r in graph.components(ids, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")}


def test_components_of_a_hub_joined_apart(spark, monkeypatch):
    from corpusmill import session

    joined = session.join_hot
    monkeypatch.setattr(graph, "join_hot", lambda *a, **k: joined(*a, **k, few=3))
    edges = spark.createDataFrame([("h", f"x{i:02d}") for i in range(40)] + [("x39", "z"), ("p", "q")], "a string, b string")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b"))
    got = {r.id: r.group_id for r in graph.components(ids, edges).collect()}
    assert got["z"] == "h" and got["q"] == "p" and sum(v == "h" for v in got.values()) == 42


def test_join_hot_equals_join(spark):
    from corpusmill.session import join_hot

    big = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 30 + ["b"] * 3 + ["c", None])], "k string, i int")
    small = spark.createDataFrame([("a", 30, "A"), ("b", 3, "B"), ("d", 0, "D")], "k string, n long, v string")
    want = sorted(map(tuple, big.join(small.drop("n"), "k").select("k", "i", "v").collect()))
    for few in (1, 5, 100):
        assert sorted(map(tuple, join_hot(big, small, "k", "n", few=few).collect())) == want
