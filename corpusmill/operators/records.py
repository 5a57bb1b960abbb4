"""Records of a run, built from parsed rows: drafts, accepted and rejected samples, error envelopes, dry-run answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed, text

GUIDANCE = {
    "JSON_STRICT_PARSE_FAILED": "Return one JSON value and nothing else.", "JSON_LENIENT_PARSE_FAILED": "Return a JSON object.",
    "ENVELOPE_SCHEMA_FAILED": "Give every field of the envelope in its type.", "PAYLOAD_SCHEMA_FAILED": "Give the payload the fields of its type.",
}


def guidance(code: Column) -> Column:
    """What to do about an error code."""
    out = None
    for c, words in GUIDANCE.items():
        out = F.when(code == c, F.lit(words)) if out is None else out.when(code == c, F.lit(words))
    return out


def draft_records(parsed: DataFrame) -> DataFrame:
    """id, output_text and contract of parsed and flagged rows (jsonx.contract_flags)."""
    error = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.col("failed_at"), F.col("rule").alias("message")))
    return parsed.select("id", "output_text", F.struct("overall_ok", "payload_type", error.alias("error")).alias("contract"))


def rejected(rows: DataFrame, raw: str = "output_text", longest: int = 20_000, issues: int = 3) -> DataFrame:
    """id, reason_codes, critique_summary (the first issues only) and the raw text up to its longest."""
    summary = F.struct(F.col("verdict"), F.slice("issues", 1, issues).alias("top_issues"))
    return rows.select("id", "reason_codes", summary.alias("critique_summary"), F.substring(raw, 1, longest).alias("raw_text"))


def error_envelope(code: Column, failed_at: Column, raw: Column, excerpt: int = 500) -> Column:
    """An answer in place of one that can't be shown: the code, where it failed, what to do, and how the text begins."""
    return F.struct(code.alias("error_code"), failed_at.alias("failed_at"), F.array_compact(F.array(guidance(code))).alias("guidance"), text.shorten(F.coalesce(raw, F.lit("")), excerpt).alias("excerpt"))


def without_excerpt(rows: DataFrame, column: str = "excerpt") -> DataFrame:
    """The rows with the excerpt's length in place of it."""
    return rows.withColumn(f"{column}_length", F.length(column)).drop(column)


def parsed_but_invalid(rows: DataFrame) -> DataFrame:
    """Rows that parse and break their schema, for debugging."""
    return rows.where("parse_success and not coalesce(schema_valid, false)")


def pass_rates(rows: DataFrame) -> DataFrame:
    """One row: attempted and the rates of each step of the contract."""
    rate = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0)).alias(f"{c}_rate")
    return rows.agg(F.count("*").alias("attempted"), *(rate(c) for c in ("strict_json_ok", "lenient_json_ok", "envelope_ok", "payload_ok", "overall_ok")))


def critique_stats(critiques: DataFrame) -> DataFrame:
    """kind, value, n: verdicts, types of issues and risk levels (columns verdict, issues.type, risk_level)."""
    each = F.concat(F.array(F.struct(F.lit("verdict").alias("kind"), F.col("verdict").alias("value")), F.struct(F.lit("risk").alias("kind"), F.col("risk_level").alias("value"))), F.transform(F.coalesce("issues.type", F.array().cast("array<string>")), lambda t: F.struct(F.lit("issue").alias("kind"), t.alias("value"))))
    return critiques.select(F.explode(each).alias("x")).groupBy("x.kind", F.coalesce("x.value", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def mock_payload(kind: str) -> dict:
    """The smallest payload of a type that keeps its contract."""
    return {
        "itinerary": {"title": "Stub", "trip_days": [{"day": 1, "summary": "Stub", "items": [{"time_block": "morning", "activity": "Stub"}]}]}, "checklist": {"title": "Stub", "groups": [{"name": "Stub", "items": [{"text": "Stub"}]}]},
        "decision_tree": {"title": "Stub", "nodes": [{"id": "q1"}]}, "procedure": {"title": "Stub", "steps": [{"step": 1, "instruction": "Stub"}]},
    }[kind]


def stub_envelope(kind: str, summary: str = "Stub") -> str:
    """An answer that keeps its contract, as JSON."""
    values = {"summary": summary, "assumptions": ["Stub"], "uncertainty_notes": "Stub", "next_steps": ["Stub"], "verification_steps": ["Stub"], "payload_type": kind, "payload": mock_payload(kind)}
    return json.dumps({k: values[k] for k in fixed.ENVELOPE_KEYS})


def dry_run(rows: DataFrame) -> DataFrame:
    """The rows with output_text: the first by ord gets an answer that keeps its contract, the others one that doesn't."""
    first = rows.agg(F.min("ord").alias("o")).first().o
    answer = None
    for kind in fixed.PAYLOAD_TYPES:
        here = F.col("payload_type") == kind
        answer = F.when(here, F.lit(stub_envelope(kind))) if answer is None else answer.when(here, F.lit(stub_envelope(kind)))
    return rows.withColumn("output_text", F.when(F.col("ord") == F.lit(first), answer.otherwise(F.lit(stub_envelope("checklist")))).otherwise(F.lit('{"summary": "Stub"}')))


def approx_tokens(t: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4))
