"""Problems 1, 2 and 4 against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pytest

from corpusmill.llm import components, ledger, raking


def _groups(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pair in pairs:
        ids = [t for t in ((p or "").strip() for p in pair) if t not in ("", "unknown")]
        for t in ids:
            root.setdefault(t, t)
        if len(ids) == 2:
            a, b = sorted(map(find, ids))
            root[b] = a
    return {(t, find(t)) for t in root}


def _check_groups(spark, pairs):
    df = spark.createDataFrame([(*p, "x", 1) for p in pairs], "duplicate_id string, anchor_id string, record_id string, v int")
    assert {tuple(r) for r in components.components(df).select("record_id", "group_id").collect()} == _groups(pairs)


def test_groups_equal_union_find(spark):
    pairs = [("b", "a"), ("a", "b"), ("c", " b "), ("d", None), ("e", "e"), ("unknown", "f"), ("", "g"), ("h", "i"), ("i", "j"), ("j", "h"), ("k", "unknown"), ("l", "k"), (None, None)]
    _check_groups(spark, pairs)
    _check_groups(spark, [("a", "b")])


def test_chains_circles_trees_and_cores(spark):
    rng = random.Random(7)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    circle = [(f"o{i:02d}", f"o{(i + 1) % 20:02d}") for i in range(20)]
    tree = [(f"t{i:03d}", f"t{rng.randrange(i):03d}") for i in range(1, 60)]
    core = [(f"k{a}", f"k{b}") for a in range(6) for b in range(a)]
    hub = [("hub", f"l{i:03d}") for i in range(80)]
    _check_groups(spark, [*chain, *circle, *tree, *core, *hub, ("k0", "c030"), ("l001", "t005")])


def test_no_groups_in_an_empty_table(spark):
    assert components.components(spark.createDataFrame([], "duplicate_id string, anchor_id string")).collect() == []


def test_p1_found(spark, small):
    import __spark_entry__

    pairs = [tuple(r) for r in spark.read.parquet(f"{small}/dup_pairs.parquet").select("duplicate_id", "anchor_id").collect()]
    want = {(g, t) for t, g in _groups(pairs) if t != g}
    assert want and {tuple(r) for r in __spark_entry__.queries()["p1_found"](spark, small).select("group_id", "record_id").collect()} == want


def _left(counts, margins, least, q):
    """The gain of the best move of one draw, over all pairs of cells."""
    best = 0.0
    up, down = [], []
    for (which, want), low in zip(margins, least):
        low, have = np.minimum(np.ceil(low), np.bincount(which, counts, len(low))), np.bincount(which, q, len(want)).astype(float)
        gap = lambda x: np.abs(x - want) + 1e6 * np.maximum(0, low - x)  # noqa: E731, B023
        up.append(gap(have) - gap(have + 1))
        down.append(gap(have) - gap(have - 1))
    of = np.flatnonzero(q > 0)
    for i in np.flatnonzero(q < counts):
        best = max(best, sum((w[i] != w[of]) * (u[w[i]] + d[w[of]]) for (w, _), u, d in zip(margins, up, down)).max(initial=0))
    return best


@pytest.mark.parametrize("seed", [1, 3, 6])
def test_no_improving_move_is_left_beyond_512_cells(seed):
    r, k = np.random.default_rng(seed), 14
    counts = np.where(r.random(k**3) < 0.6, r.integers(1, 4, k**3), 0)
    cells = np.array(np.unravel_index(np.arange(k**3), (k, k, k)))[:, counts > 0]
    counts = counts[counts > 0]
    size = int(counts.sum() // 3)
    margins, least = [], []
    for d in range(3):
        want = r.dirichlet(np.ones(k) * 0.4) * size
        margins.append((cells[d], want))
        least.append(np.where(r.random(k) < 0.4, want * 1.2 + 3, 0).astype(int))
    for drawn in (None, counts // 4):
        q = raking.quotas(counts, margins, least, size, drawn)
        assert q.sum() == size and (q >= 0).all() and (q <= counts).all()
        assert _left(counts, margins, least, q) <= 1e-6


def _pool(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id string, category string, payload_type string, difficulty string, dim_value string")


def _targets(spark, rows, size):
    return spark.createDataFrame([(*r, size) for r in rows], "dim_name string, dim_value string, target_share double, min_rows long, sample_size long")


def test_sample_meets_its_targets(spark):
    rows = [(f"r{i}", ("A ", "b", None)[i % 3], "t", "easy") for i in range(300)] + [("r0", "a", "t", "easy"), (None, "a", "t", "easy")]
    sample, report = raking.sample_to_targets(_pool(spark, rows), _targets(spark, [("category", "a", 0.7, 0), ("category", "B", 0.3, 5), ("category", "unknown", 0.0, 4), ("category", "zz", 0.0, 2)], 60))
    got = sample.collect()
    counts = {v: sum(r.category == v for r in got) for v in ("a", "b", "unknown")}
    assert len(got) == len({r.id for r in got}) == 60 and counts["unknown"] >= 4 and counts["b"] >= 5 and counts["a"] >= 38
    told = {r.dim_value: (r.need, r.available, r.drawn, r.unmet) for r in report.collect()}
    assert told["zz"] == (2, 0, 0, True) and told["a"] == (42, 100, counts["a"], False) and told["B"][3] is False


def test_an_id_is_available_under_each_of_its_values(spark):
    rows = [("1", "a", "t", "easy"), ("1", "b", "t", "easy")]
    report = raking.sample_to_targets(_pool(spark, rows), _targets(spark, [("category", "b", 0.0, 1), ("category", None, 0.0, 1)], 1))[1]
    assert {(r.dim_value, r.available, r.unmet) for r in report.collect()} == {("b", 1, False), (None, 0, True)}


def test_empty_pool_and_empty_targets(spark):
    sample, report = raking.sample_to_targets(_pool(spark, []), _targets(spark, [("category", "a", 1.0, 0)], 5))
    assert sample.collect() == [] and [(r.need, r.drawn, r.unmet) for r in report.collect()] == [(5, 0, True)]
    sample, report = raking.sample_to_targets(_pool(spark, [("1", "a", "t", "easy")]), _targets(spark, [], 5))
    assert sample.collect() == [] and report.collect() == []


def test_the_draw_takes_the_smallest_keys(spark):
    keyed = spark.createDataFrame([(float(i % 50), f"r{i:03d}") for i in range(200)], "sample_key double, id string")
    order = sorted((float(i % 50), f"r{i:03d}") for i in range(200))
    for n in (1, 7, 100, 200):
        assert raking._smallest(keyed, n, few=3, parts=4) == order[n - 1]


def test_found_rows_come_after_a_materialised_draw(spark, small, monkeypatch):
    import __spark_entry__

    drawn, cut = [], raking.cut

    def watched(df):
        out = cut(df)
        if "sample_key" in out.columns and "_u" not in out.columns:
            drawn.append(out.count())
        return out

    monkeypatch.setattr(raking, "cut", watched)
    __spark_entry__.queries()["p2_found"](spark, small)
    assert drawn == [spark.read.parquet(f"{small}/target_mix.parquet").first().sample_size]


def test_formatting_only(spark):
    rows = [
        ("b", 1, "Season: May\nBudget: low\nGo to Vinlo.", "s", "checklist"), ("a", 1, "budget: LOW | season: may\ngo, to vinlo", "S.", "Check list"),
        ("c", 2, "Season: May\nBudget: low\nGo to Vinla.", "s", "checklist"), ("d", 3, None, None, None), ("e", None, "", " ", ""), (None, 4, "x", "x", "x"),
        ("f", 5, "Season: May\nBudget: low", "s", "k"), ("g", 6, "Budget low | Season: may", "s", "k"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, ord long, prompt string, summary string, payload_type string, key string")
    labels = ledger.learn_labels(df)
    assert labels == ("budget", "season")
    book = ledger.Ledger(spark)
    first, rest = df.where("id < 'c'"), df.where("id >= 'c'")
    for batch, name in ((first, "one"), (first, "one"), (rest, "two"), (rest, "two"), (first, "three")):  # a batch counts once
        book.apply(ledger.keyed(batch, labels), name)
    got = {(r.keep_id, r.copies, r.first_id) for r in book.read().collect()}
    assert {("a", 4, "a"), ("c", 1, "c"), ("d", 2, "d")} <= got
    assert book.manifest()["batches"] == ["one", "two", "three"]
    assert ledger.Ledger(spark).read().collect() == []


def test_all_parts_labelled(spark):
    rows = [("a", 1, "Season: May\nBudget: low", "s", "k"), ("b", 2, "Budget: LOW | Season: may", "s", "k"), ("c", 3, "Season: May\nBudget: low\nGo.", "s", "k")]
    df = spark.createDataFrame(rows, "id string, ord long, prompt string, summary string, payload_type string")
    keys = {r.id: r.key for r in ledger.keyed(df, ("season", "budget")).collect()}
    assert keys["a"] == keys["b"] != keys["c"]


def test_a_job_that_dies_leaves_the_ledger(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1, "x", "s", "k")], "id string, ord long, prompt string, summary string, payload_type string")
    book = ledger.Ledger(spark)
    book.apply(ledger.keyed(df, ()), "one")
    before = book.manifest()
    monkeypatch.setattr(book, "_publish", lambda m: (_ for _ in ()).throw(RuntimeError("dies")))
    with pytest.raises(RuntimeError):
        book.apply(ledger.keyed(df, ()), "two")
    monkeypatch.undo()
    assert book.manifest() == before and [r.copies for r in book.read().collect()] == [1]
    book.apply(ledger.keyed(df, ()), "two")
    assert [r.copies for r in book.read().collect()] == [2]
