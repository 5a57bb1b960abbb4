"""Quality, balance, splits, joins, JSON contracts, evaluation, sources, export, boundary: rules on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill import boundary
from corpusmill.functions import jsonx, schema, text
from corpusmill.operators import balance, evaluation, joins, plan, quality, report, sft, split, stats
from corpusmill.sources import jsonl

GOOD = {
    "summary": "s", "assumptions": ["a"], "uncertainty_notes": "", "next_steps": [], "verification_steps": ["v"], "payload_type": "checklist",
    "payload": {"title": "t", "groups": [{"name": "g", "items": [{"text": "x", "priority": "must"}]}]},
}


def test_contract_rules():
    assert jsonx.contract(GOOD) == (None, None, None)
    assert jsonx.contract([GOOD])[0] == "ENVELOPE_SCHEMA_FAILED"
    assert jsonx.contract(GOOD | {"more": 1}) == ("ENVELOPE_SCHEMA_FAILED", "$", "no field more")
    assert jsonx.contract({k: v for k, v in GOOD.items() if k != "payload"})[2] == "field payload"
    assert jsonx.contract(GOOD | {"payload": {"title": "t", "groups": []}})[1] == "$.groups"
    day = {"day": 1.0, "summary": "", "items": [{"time_block": "", "activity": "", "transport": {"mode": "walk"}}]}
    trip = lambda d: jsonx.contract(GOOD | {"payload_type": "itinerary", "payload": {"title": "t", "trip_days": [d]}})[0]
    assert trip(day) is None and trip(day | {"day": True}) and trip(day | {"day": 0}) and trip(day | {"day": 1.5}) and trip(day | {"items": []})
    assert schema.problem(schema.PAYLOADS["decision_tree"], {"title": "t", "nodes": [{"id": "q", "options": ["a", {"choice": "b", "outcome": None}]}]}) is None


def test_lenient_extraction():
    j = json.dumps(GOOD)
    assert jsonx.lenient(f"Sure:\n```json\n[1]\n```\n```json\n{j}\n```") == GOOD
    assert jsonx.lenient(f"text {j} more") == GOOD and jsonx.lenient("[1, 2] only") == [1, 2]
    assert jsonx.lenient("{broken") is jsonx.MISSING and jsonx.lenient(None) is jsonx.MISSING
    assert jsonx.lenient('{"a": "}"} x') is jsonx.MISSING and jsonx.lenient('{"a": "}"} x', heed_strings=True) == {"a": "}"}
    assert jsonx.greedy('x {"a": 1} y') == {"a": 1} and jsonx.first_object('x {"a": {}} {') == '{"a": {}}'
    assert jsonx.strict("null") is None and jsonx.strict("{} x") is jsonx.MISSING
    assert jsonx.missing_fields({"a": {"b": 0}, "c": " ", "d": [], "e": False}, ("a.b", "a.x", "c", "d", "e", "f")) == ["a.x", "c", "d", "f"]


def test_contract_of_rows(spark):
    rows = [("a", json.dumps(GOOD)), ("b", f"see {json.dumps(GOOD)}"), ("c", "nothing"), ("d", None), ("e", json.dumps(GOOD | {"summary": ""})), ("f", "")]
    got = jsonx.contract_flags(jsonx.parsed(spark.createDataFrame(rows, "id string, t string"), "t", ["id"]))
    assert {r.id: (r.strict_json_ok, r.lenient_json_ok, r.envelope_ok, r.payload_ok, r.error_code) for r in got.collect()} == {
        "a": (True, True, True, True, None), "b": (False, True, True, True, None), "c": (False, False, False, False, "JSON_LENIENT_PARSE_FAILED"), "d": (False, False, False, False, "JSON_LENIENT_PARSE_FAILED"),
        "e": (True, True, False, False, "ENVELOPE_SCHEMA_FAILED"), "f": (False, False, False, False, "JSON_LENIENT_PARSE_FAILED"),
    }
    strict = spark.createDataFrame([('{"a":1}',), ('{"a":1} x',), ("",), ("null",), ('"s"',)], "t string").select("t", jsonx.is_strict(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in strict.collect()} == {'{"a":1}': True, '{"a":1} x': False, "": False, "null": True, '"s"': True}


def test_filters_and_tags(spark):
    rows = [
        ("short", {"summary": "a b"}), ("long", {"summary": "w " * 80}), ("vague", {"summary": "it depends, usually it may vary " + "w " * 60}),
        ("sure", {"summary": "the visa is always granted " + "w " * 60}), ("safe", {"summary": "the visa is always granted " + "w " * 60, "verification_steps": ["check online"]}), ("none", None),
    ]
    df = spark.createDataFrame([(i, None if r is None else json.dumps(r), "x") for i, r in rows], "id string, response string, reason string").drop("reason")
    got = {r.id: r.reason for r in quality.filter_chain(df).collect()}
    assert got == {"short": "too_short", "long": None, "vague": "vague_low_specificity", "sure": "overconfident_time_sensitive", "safe": None, "none": "too_short"}
    tagged = df.withColumn("v", text.as_json("response")).select("id", quality.failure_tags(F.col("v")).alias("t"), quality.stricter_reason(F.col("v"), ("missing_verification_steps",)).alias("r"))
    tags = {r.id: (r.t, r.r) for r in tagged.collect()}
    assert tags["sure"] == (["missing_verification_steps", "missing_next_steps", "overconfident_no_verification"], "verification_steps_empty")
    assert tags["safe"] == (["missing_next_steps", "generic_verification_only"], "verification_steps_generic_only") and tags["none"] == ([], "response_invalid")


def test_gates(spark):
    rows = [("ok", "plain text", True, False, False), ("hot", "the visa", True, False, True), ("sure", "the visa, always", True, True, True), ("asks", "the visa: always check", True, True, True), ("bad", "x", None, True, True)]
    df = spark.createDataFrame(rows, "id string, t string, ok boolean, steps boolean, notes boolean")
    got = quality.with_gates(df, F.col("t"), F.col("ok"), F.col("ok"), F.col("steps"), F.col("notes"))
    assert {r.id: (r.p, r.c) for r in got.select("id", quality.overall(F.col("gates")).alias("p"), quality.failed_codes(F.col("gates")).alias("c")).collect()} == {
        "ok": (True, []), "hot": (False, ["missing_verification_requirements"]), "sure": (False, ["overconfident_time_sensitive"]), "asks": (True, []),
        "bad": (False, ["envelope_invalid", "skipped_contract_failed", "skipped_contract_failed"]),
    }


def test_downsample_keeps_the_least_hashes(spark):
    import hashlib

    df = spark.createDataFrame([(f"r{i}", i, "a" if i < 700 else "b", None, "k") for i in range(710)], "id string, ord long, category string, difficulty string, payload_type string")
    caps = balance.target_caps(balance.bucket_stats(df), 0.1, 3.0)
    assert {(r.category, r.n, r.cap) for r in caps.collect()} == {("a", 700, 70), ("b", 10, 70)}
    got = {r.id for r in balance.downsample(df, caps).where("reason is null").collect()}
    h = lambda i: hashlib.md5(f"42|r{i}".encode()).hexdigest()
    assert got == {f"r{i}" for i in sorted(range(700), key=h)[:70]} | {f"r{i}" for i in range(700, 710)}
    assert balance.target_caps(balance.bucket_stats(df.limit(0))).collect() == []
    drawn = balance.oversample(df.where("ord < 10"), 1.5).collect()
    assert len(drawn) == 5 and len({r.id for r in drawn}) == 5 and {r.source_id for r in drawn} <= {f"r{i}" for i in range(10)}


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(f"r{i}", "a" if i < 50 else "b" if i < 53 else None) for i in range(54)], "id string, s string")
    got = [r.s for r in balance.round_robin(df, ["s"], 8).collect()]
    assert sorted(got[:3], key=str) == ["None" if s is None else s for s in []] or {got[0], got[1], got[2]} == {"a", "b", None}
    assert got.count("b") == 3 and got.count(None) == 1 and len(got) == 8


def test_split_assignment(spark):
    assert split.assign_sizes([("a", 5), ("b", 3), ("c", 1), ("d", 1)]) == {"a": "train", "b": "val", "c": "test", "d": "train"}
    rng = random.Random(5)
    groups = spark.createDataFrame([(f"r{i}", f"g{rng.randrange(60)}") for i in range(600)], "id string, group_id string")
    for head in (1000, 5):
        rows = split.assign(groups, head=head).collect()
        assert len(rows) == 600 and all(len({r.split for r in rows if r.group_id == g}) <= 1 for g in {r.group_id for r in rows})
        assert 0.6 < sum(r.split == "train" for r in rows) / 600 < 0.95
    one = split.group_stats(groups).first()
    assert one.num_groups == 60 and one.min_size <= one.median_size <= one.max_size
    rows = spark.createDataFrame([("a", "g", "f", "train"), ("b", "g", None, "val"), ("c", "h", "f", "train")], "id string, group_id string, fingerprint string, split string")
    assert tuple(split.validate(rows).first()) == (1, 0, False)


def test_three_way_join(spark):
    plans = spark.createDataFrame([("a", "p"), ("b", "p")], "id string, prompt string")
    drafts = spark.createDataFrame([("a", "d", 1), ("a", "e", 2), ("c", "d", 1), (None, "x", 9)], "id string, output_text string, at int")
    critiques = spark.createDataFrame([("a", "Reject"), ("d", "ok")], "draft_id string, verdict string")
    got = joins.reject_by_verdict(joins.join_inputs(plans, joins.last_of(drafts, "id", "at"), critiques), F.col("critique.verdict"))
    assert {r.id: (r.reason, r.missing_components, r.draft and r.draft.output_text) for r in got.collect()} == {
        "a": ("critique_reject", [], "e"), "b": ("missing_inputs", ["draft"], None), "c": ("missing_inputs", ["plan"], "d"), "d": ("missing_inputs", ["plan", "draft"], None),
    }
    todo = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, ord int")
    rejects = spark.createDataFrame([("b", "missing_inputs"), ("c", None)], "id string, reason string")
    assert [r.id for r in joins.resume(todo, plans.where("id = 'a'"), rejects).collect()] == ["b"]
    assert joins.resume(todo, plans.where("id = 'a'"), limit=1, limit_first=True).collect() == [] and joins.resume(todo, plans.where("id = 'a'"), limit=1).first().id == "b"


def test_evaluation(spark):
    rows = [("a", "safety", True, None, False, 1.0), ("b", "safety", False, None, True, 6.0), ("c", "x", True, False, True, 2.0), ("d", None, None, True, None, None), ("e", "x", True, True, True, 3.0)]
    df = spark.createDataFrame(rows, "id string, suite string, strict_json_ok boolean, required_fields_ok boolean, has_verification_marker boolean, latency_s double")
    got = {r.id: r.score for r in evaluation.curated(df, 3, manual=("e",)).collect()}
    assert got == {"e": 0, "b": 4, "c": 2}
    full = df.withColumns({c: F.lit(None).cast("boolean") for c in ("lenient_json_ok", "envelope_ok", "payload_ok", "overall_ok", "has_assumptions_marker", "has_clarifying_questions")}).withColumn("tokens_per_s", F.lit(0.0))
    total = evaluation.rollup(full).where("is_total = 1").first()
    assert total.n == 5 and total.strict_json_parse_rate == 0.6 and total.p50_latency_s == 2.5 and total.avg_tokens_per_s is None and total.n_with_required_fields == 3
    lost = evaluation.losses(spark.createDataFrame([("r", [3.0, 1.0, 2.0]), ("s", [])], "run string, losses array<double>"))
    assert {tuple(r) for r in lost.collect()} == {("r", 1.0, 2.0), ("s", None, None)}


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1, "x", "easy", "k", ["n", "s"]), ("b", 2, None, None, None, None), ("c", 3, "x", "hard", "k", [])], "id string, ord long, category string, difficulty string, payload_type string, region_tags array<string>")
    dist = stats.distributions(df)
    assert {(r.dim_name, r.value, r.n) for r in dist.where("dim_name in ('category', 'region_tag')").collect()} == {("category", "x", 2), ("category", "unknown", 1), ("region_tag", "n", 1), ("region_tag", "s", 1)}
    cover = {r.dim_name: (r.num_values, r.min_value, r.max_value) for r in stats.coverage(dist).collect()}
    assert cover["category"] == (2, "unknown", "x") and cover["region_tag"] == (2, "n", "n")
    assert stats.distributions(df.limit(0)).collect() == []


def test_jsonl_policies(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "prompt": "p"}\n\n{"id": "b"}\nnot json\n[1]\n{"id": "c", "prompt": null} x\n', encoding="utf-8")
    good, bad = jsonl.scan(spark, str(tmp_path / "*.jsonl"), "id string, prompt string", bad="skip", required=("id", "prompt"), numbered=True)
    assert [(r.id, r.line_no) for r in good.collect()] == [("a", 0)] and sorted(r.reason for r in bad.collect()) == ["lacks prompt", "not a JSON object", "not a JSON object", "not a JSON object"]
    with pytest.raises(Exception, match="bad line"):
        jsonl.scan(spark, str(tmp_path / "a.jsonl"), "id string")[0].collect()
    assert jsonl.scan(spark, str(tmp_path / "none.jsonl"), "id string", missing="empty")[0].collect() == []
    assert [r.id for r in jsonl.ids(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()] == ["a", "b"]
    (tmp_path / "a.jsonl").write_text('{"id": "a", "prompt": "p"}\n', encoding="utf-8")
    assert [(r.id, r.suite) for r in jsonl.suites(spark, str(tmp_path)).collect()] == [("a", "a")]
    jsonl.write(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":"é","b":null}'


def test_export(spark):
    rows = [("a", "p", json.dumps(GOOD), "checklist"), ("b", None, "not json", None), ("c", "p", json.dumps({"payload_type": "itinerary", "payload": {"title": "t", "trip_days": [{"day": 1, "summary": "", "items": [{"activity": "x", "time_buffer": "noon"}]}]}}), None), ("d", "p", None, "procedure")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "id string, prompt string, response string, payload_type string, category string, difficulty string, region_tags array<string>")
    got = {r.id: r for r in sft.chat_rows(df, "train").collect()}
    assert set(got) == {"a", "c"} and json.loads(got["c"].target)["payload"]["trip_days"][0]["items"][0] == {"activity": "x", "time_block": "noon"}
    assert got["a"].target == json.dumps(GOOD, sort_keys=True, separators=(",", ":")).replace('"uncertainty_notes":""', '"uncertainty_notes":"Verify details with official sources."')
    assert sft.normalize_envelope([{"next_steps": " x ", "payload": [1], "payload_type": "Budget_Checklist"}]) == {"next_steps": ["x"], "assumptions": [], "verification_steps": [], "payload": {"items": [1]}, "payload_type": "checklist"}


def test_prompt_plan_is_stable_and_counted(spark):
    from corpusmill.plans.core_queries import SPEC

    rows = plan.prompt_plan(spark, SPEC).collect()
    assert len(rows) == len({r.id for r in rows}) == 2000 and {r.id for r in rows} == {r.id for r in plan.prompt_plan(spark, SPEC).repartition(7).collect()}
    assert 0.33 < sum(r.payload_type == "itinerary" for r in rows) / 2000 < 0.47 and all("{" not in r.prompt for r in rows)


def test_boundary(spark):
    class Flaky:
        def __init__(self):
            self.calls = []

        def generate(self, request, model):
            self.calls.append((model, request.structured))
            if model == "a":
                raise boundary.of_status(429)
            if request.structured:
                raise boundary.of_status(400)
            return boundary.Answer("x", model)

    client = Flaky()
    got = boundary.Router(client, ["a", "b"], retries=1, sleep=lambda s: None).generate(boundary.Request("p"))
    assert got.attempted == ("a", "b") and client.calls == [("a", True), ("a", True), ("b", True), ("b", False)]
    assert boundary.Router(client, ["a", "c:free"], allow_paid=False).models == ["c:free"]
    slept = []
    limit = boundary.RateLimit(60, clock=lambda: 0.0, sleep=slept.append)
    for _ in range(3):
        limit.wait()
    assert slept == [1.0, 2.0] and 0.1 <= boundary.backoff(9, rng=random.Random(1)) <= 37.5
    df = spark.createDataFrame([("a", "hello"), ("b", None)], "id string, prompt string")
    out = boundary.generated(df, "prompt", ["id"], lambda: boundary.Router(boundary.Stub(lambda r: r.prompt.upper()), ["stub"])).collect()
    assert {(r.id, r.output_text, r.error) for r in out} == {("a", "HELLO", None), ("b", "", None)}
    assert boundary.cut_at_stops("a END b", ("END", "x")) == "a "


def test_reports(spark):
    assert report.table([{"a": "x|y", "b": None}], ["a", "b"]).splitlines()[-1] == "| x\\|y | — |"
    assert report.redacted({"api_key": "s", "n": {"token": "t", "x": 1}}) == {"api_key": "***", "n": {"token": "***", "x": 1}}
    assert report.changed({"a": {"x": 1}, "b": 1}, {"a": {"x": 2}, "b": 2}, "a") == ["b"]
    with pytest.raises(ValueError):
        report.collected(spark.range(5), 3)


def test_queries_and_sql_are_in_step():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 60
