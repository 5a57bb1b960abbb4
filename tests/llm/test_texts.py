"""Problems 5 to 10 against brute force and on held-out cases; nulls, empty and long texts, empty tables, extra columns."""

import random

import numpy as np
import pytest

from corpusmill.llm import bpe, defects, garbled, leaks, overlap, truncation


def test_queries_are_registered():
    import __spark_entry__

    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= set(__spark_entry__.queries())


# Problem 5


def test_tails():
    open_ = lambda t: truncation.tail_of(t)["json"]
    assert open_('{"a": [1, {"b": "x') == 2 and open_('Here:\n```json\n{"a": 1,\n```') == 2
    assert open_('{"a": 1,}') == 1 and open_('{"a": "say "hi" now"}') == 1 and open_("plain {name} text") != 2 and open_("") == 0
    for text, closed, noted in (("Go on.", True, False), ("go on…", False, True), ("go o [cut]", False, True), ("Done.\n```", True, False), ("x 🙂", True, False), ("see (this)", True, False), ("wait,", False, False), ("```json\n```", True, False)):
        t = truncation.tail_of(text)
        assert (t["closed"], t["noted"]) == (closed, noted), text


def test_cut_off_texts_are_found(spark):
    rng = random.Random(2)
    nouns = ["harbour", "library", "terrace", "gardens", "bakery"]
    whole = lambda: f"The old {rng.choice(nouns)} opens after the {rng.choice(nouns)} closes. Visitors walk from the {rng.choice(nouns)} to the {rng.choice(nouns)} at noon."
    rows = [(f"w{i}", whole(), "m") for i in range(80)]
    rows += [("c1", "The old harbour opens after the libr", "m"), ("c2", whole() + " Visitors walk from the", "m"), ("c3", whole()[:-4] + "…", "m"), ("s1", "Yes.", "m"), ("s2", None, "m"), ("s3", " ", None), ("s4", '{"a": 1', None), ("s5", "- bread\n- milk", "m")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, output_text string, source string, token int")
    got = {r.id for r in truncation.truncated(df).where("cut").collect()}
    assert got == {"c1", "c2", "c3", "s4"}
    assert truncation.truncated(df.limit(0)).collect() == []


def test_source_limits_are_evidence(spark):
    rows = [(f"w{i}", "Pack the red coat", "m") for i in range(6)] + [(f"v{i}", "Pack the red coats", "n") for i in range(3)]
    df = spark.createDataFrame(rows, "id string, output_text string, source string")
    assert {r.id for r in truncation.truncated(df).where("cut").collect()} >= {f"w{i}" for i in range(6)}


# Problem 7


def test_said():
    assert defects.said('{"a": "x y", "payload_type": "k", "b": ["z", {"c": "cut o') .split() == ["x", "y", "z", "cut", "o"]
    for empty in ("", "null", "{}", "```json\n```", '{"a": "", "payload_type": "checklist", "b": []}'):
        assert not any(c.isalnum() for c in defects.said(empty)), empty


def test_classifier_on_held_out_examples(spark, small):
    pairs = [(r.prompt or "", r.output_text) for r in spark.read.parquet("/root/testdata/sf0.01/drafts_v1.parquet").where("length(output_text) > 300").select("prompt", "output_text").orderBy("id").limit(300).collect()]
    docs = [(r.text, r.lang.lower()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 20").select("text", "lang").orderBy("doc_id").collect()]
    counts = {l: sum(x == l for _, x in docs) for _, l in docs}
    model = defects.fit_languages([d for d in docs if counts[d[1]] >= 20 and d[1] != "und"])
    examples = defects.make_examples(pairs, model, seed=1)
    ends = np.array([[t["json"] == 2, t["noted"] and not t["closed"], False, t["json"] == 2 or not t["closed"]] for t in (truncation.tail_of(e[1]) for e in examples)], dtype=float)
    defects.fit(model, examples, ends)
    fresh = defects.make_examples(pairs[::-1], model, seed=2)
    scores, _ = model.partial([e[0] for e in fresh], [e[1] for e in fresh])
    for label in ("empty", "refusal", "copy", "language"):
        c = defects.LABELS.index(label)
        truth = np.array([e[2] == c for e in fresh])
        said = scores[:, c] > model.threshold[c]
        assert (said & truth).sum() / truth.sum() > 0.9, label


def test_defects_of_an_empty_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], "id string, prompt string, response string")
    pairs = defects.pairs_of(("t", df, "prompt", F.col("response"), F.lit("s")))
    assert defects.defects(pairs, spark.createDataFrame([], "text string, lang string")).collect() == []


# Problem 8


def test_stream_equals_plain_merging():
    import regex

    t = bpe.transducer(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for text in ("", None, "Hello  world\n\n x", "<|endoftext|> naïve 🧳 切符は87日前", "a" * 90 + " " * 70 + "0123456789" * 9, "\x00​�"):
        want = [t.rank[x] for m in regex.finditer(bpe.PATTERN, text or "") for x in t._merge(m[0].encode())]
        assert t.encode(text) == want and "".join(t.decode(want)) == (text or "")


# Problem 9


def test_windows_equal_brute_force():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    items = tuple((f"i{k}", " ".join(rng.choices(vocabulary, k=40))) for k in range(8))
    texts = []
    for _ in range(60):
        ws = rng.choices(vocabulary, k=50)
        src = leaks.words(items[rng.randrange(8)][1])
        at, n = rng.randrange(28), rng.choice([11, 12, 13])
        ws[20:20] = src[at : at + n]
        texts.append(ws)
    want = set()
    for k, ws in enumerate(texts):
        for i in range(len(ws) - 11):
            want |= {(k, item) for item, t in items if f" {' '.join(ws[i : i + 12])} " in f" {' '.join(leaks.words(t))} "}
    for radius in (0, 3, 7):
        found = leaks._search(texts, leaks.Index(items, 12, radius))
        assert want and {k for k, s in found.items() if s == 1} == want


def test_every_fingerprint_within_the_radius_is_met():
    rng = np.random.default_rng(4)
    items = tuple((f"i{k}", " ".join(f"x{k}y{j}" for j in range(14))) for k in range(40))
    index = leaks.Index(items, 12, 3)
    base = index.marks[rng.integers(0, len(index.marks), 300)]
    flips = np.zeros(300, dtype=np.uint64)
    for n in range(300):
        for b in rng.choice(64, n % 6, replace=False):
            flips[n] |= np.uint64(1) << np.uint64(b)
    marks = base ^ flips
    want = {(i, j) for i, m in enumerate(marks) for j, x in enumerate(index.marks) if bin(int(m) ^ int(x)).count("1") <= 3}
    assert want and set(map(tuple, index.near(marks).tolist())) == want


def test_similarity_weighs_shingles():
    index = leaks.Index((("a", " ".join(f"w{i}" for i in range(30))),), 12, 3)
    a = index.windows[0]
    assert index.similarity(a, a) == 1 and 0 < index.similarity(a, (*a[:11], "other")) < 1 and index.similarity(a, tuple("abcdefghijkl")) == 0


def test_windows_across_blocks(monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 16)
    item = " ".join(f"x{i}" for i in range(14))
    index = leaks.Index((("a", item),), 12, 3)
    for shift in range(40):
        ws = ["z"] * shift + leaks.words(item) + ["y"] * 9
        assert leaks._search([["x0"], ws], index).get((1, "a")) == 1


def test_items_in_blocks_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS", 1)
    item = " ".join(f"x{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"A b {item.upper()}! c", "n"), (2, None, "n"), (3, "", "n"), (4, f"<b>{item.replace(' ', '</b> <b>')}</b>", "n"), (4, item, "n")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([("a", item), ("b", item + " more"), ("c", "short"), ("d", None)], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items).where("similarity = 1").collect()} == {(d, i) for d in (1, 4) for i in "ab"}
    assert leaks.leaked(docs.limit(0), items).collect() == [] and leaks.leaked(docs, items.limit(0)).collect() == []


def test_markup_case_and_space_do_not_matter():
    assert leaks.readings("One <b>TWO</b>\\nthree")[-1] == ["one", "two", "three"]
    assert leaks.readings(None) == [] and leaks.words("") == []


# Problem 6


def test_prompts_apart():
    labels = ("destination", "season")
    a = "Destination: Vinlo\nSeason: May\nOne two three four five six seven eight"
    apart = lambda b: overlap.apart(a, b, labels=labels)
    assert apart("Season: May | Destination: Vinlo\nOne two, THREE four five six seven eight") == 0
    assert apart("Season: May | Destination: Vinlo\nOne twoo three four six seven eight nine") == 3
    assert apart("Season: May\nDestination: Vinlo\nuno due tre quattro cinque six seven eight") == 5
    assert overlap.distance("step free access".split(), "stepfree access".split(), 4) == 0
    assert overlap.overlap_of(a, a, labels) == 1 and overlap.overlap_of(a, "x y z", labels) == 0 and overlap.overlap_of("", a, labels) == 0


def test_edited_prompts_share_a_rare_mark():
    rng = random.Random(2)
    for _ in range(200):
        a = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(3, 60))]
        b = list(a)
        for _ in range(4):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [f"n{rng.randrange(9)}"] * rng.randrange(2)
        ta, tb = overlap._tokens([], a, 4), overlap._tokens([], b, 4)
        first = lambda t: {x for k in (0, 1, 2) for x in sorted(y for y in t if y[0] == k)[: 9 if k == 0 else 5]}
        if b:
            assert first(ta) & first(tb)


def test_crossing_pairs_equal_brute_force(spark, small):
    data = spark.read.parquet(f"{small}/dataset_v1.parquet")
    lines, manifest = spark.read.parquet(f"{small}/split_rows.parquet"), spark.read.parquet(f"{small}/splits_manifest.parquet")
    from corpusmill.llm.ledger import learn_labels
    from corpusmill.operators import split

    labels = learn_labels(data)
    prompts = {r.id: r.prompt for r in data.collect()}
    members = [tuple(r) for r in split.membership(lines, manifest).collect()]
    want = set()
    for v, s, i in members:
        for w, t, j in members:
            if v == w and s != "train" and t == "train" and prompts.get(i) and prompts.get(j) and any(c.isalnum() for c in prompts[i]) and any(c.isalnum() for c in prompts[j]) and overlap.apart(prompts[i], prompts[j], labels=labels) <= 4:
                want.add(tuple(sorted((i, j))))
    got = overlap.crossing(data, lines, manifest)
    assert {(r.id_a, r.id_b) for r in got.collect()} == want and want
    assert overlap.crossing(data.limit(0), lines, manifest).collect() == [] and overlap.crossing(data, lines.limit(0), manifest).collect() == []


# Problem 10


@pytest.fixture(scope="module")
def model(spark, small):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").collect()]
    words: dict[str, int] = {}
    for t in texts:
        for w in garbled._CHUNK.findall(t):
            if len(w) <= 60:
                words[w] = words.get(w, 0) + 1
    return garbled.fit(words)


def test_garbled_texts_are_restored(model):
    fr, ru, ja = "La météo change près du théâtre, à côté de l'hôtel rénové", "Перед поездкой проверьте правила въезда, музей закрыт по средам", "地元の人は親切で、道を丁寧に教えてくれます"
    for text in (fr, ru, ja, "“£12 or €15 – your choice” naïve café", "NÃO É «bom» CAFÉ»", None, "", "plain", "É assim"):
        assert garbled.restore(text, model) is None, text
    for enc in ("latin-1", "cp1252", "mac_roman", "cp437", "cp850"):
        assert garbled.restore(garbled.garble(fr, ("utf-8", enc)), model)[1] == fr, enc
    assert garbled.restore(garbled.garble(fr, ("utf-8", "cp1252", "utf-8", "cp1252")), model)[1] == fr
    assert garbled.restore(ru.encode("koi8_r").decode("cp1251"), model)[1] == ru
    assert garbled.restore(ja.encode("euc_jp").decode("latin-1"), model) is not None
    assert garbled.restore("pr�fen", model) == ("lost", None)
    in_place = "La météo change près du thÃ©Ã¢tre"
    assert garbled.restore(in_place, model)[1] == "La météo change près du théâtre"


def test_chains_invert():
    for chain in garbled.CHAINS:
        for text in ("théâtre", "въезда", "café"):
            g = garbled.garble(text, chain)
            if g is not None and "�" not in g and g != text:
                assert garbled.invert(g, chain) in (text, None)


def test_garbled_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "plain", "x")], "doc_id long, text string, chain string")
    assert garbled.garbled(df).collect() == [] and garbled.garbled(df.limit(0)).collect() == []
