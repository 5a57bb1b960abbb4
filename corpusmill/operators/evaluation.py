"""Evaluation: rates and percentiles by suite, comparison of runs, failure categories, curated failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0))


RATES = {
    "strict_json_parse_rate": "strict_json_ok", "lenient_json_parse_rate": "lenient_json_ok", "assumptions_marker_rate": "has_assumptions_marker", "verification_marker_rate": "has_verification_marker",
    "clarifying_questions_rate": "has_clarifying_questions", "envelope_pass_rate": "envelope_ok", "payload_pass_rate": "payload_ok", "overall_contract_pass_rate": "overall_ok",
}


def rollup(rows: DataFrame) -> DataFrame:
    """suite (null: all), n, the rates (a missing flag counts as false), required_fields_rate over rows that have the flag,
    and latency and throughput over positive values. Suites and the total come from one pass (grouping sets)."""
    rows = rows.withColumn("_l", F.when(F.col("latency_s") > 0, F.col("latency_s"))).withColumn("_t", F.when(F.col("tokens_per_s") > 0, F.col("tokens_per_s")))
    return (
        rows.rollup("suite")
        .agg(
            F.count("*").alias("n"), *(_rate(c).alias(name) for name, c in RATES.items()),
            F.avg(F.col("required_fields_ok").cast("int")).alias("required_fields_rate"), F.count("required_fields_ok").alias("n_with_required_fields"),
            F.avg("_l").alias("avg_latency_s"), F.percentile("_l", F.lit(0.5)).alias("p50_latency_s"), F.percentile("_l", F.lit(0.9)).alias("p90_latency_s"),
            F.avg("_t").alias("avg_tokens_per_s"), F.percentile("_t", F.lit(0.5)).alias("p50_tokens_per_s"), F.grouping("suite").alias("is_total"),
        )
    )


def latency_stats(rows: DataFrame, col: str = "latency_ms") -> DataFrame:
    """One row: count, mean, median, 90th percentile, least and largest; zero counts, null doesn't."""
    return rows.agg(F.count(col).alias("n"), F.avg(col).alias("avg"), F.percentile(col, F.lit(0.5)).alias("p50"), F.percentile(col, F.lit(0.9)).alias("p90"), F.min(col).alias("least"), F.max(col).alias("largest"))


def throughput(text: Column, latency_s: Column, tokens: Column | None = None) -> Column:
    """Tokens a second: the given tokens, else a quarter of the characters, one at least; 0 where the latency is 0."""
    n = F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    n = n if tokens is None else F.coalesce(tokens, n)
    return F.when(latency_s > 0, n / latency_s).otherwise(F.lit(0.0))


def run_metrics(rows: DataFrame, run: str = "model") -> DataFrame:
    """Of each run: n, parse_success_rate, schema_valid_rate, required_field_presence_rate (over parsed rows, 0 without
    any), uncertainty_marker_presence_rate, avg_latency_ms."""
    return rows.groupBy(run).agg(
        F.count("*").alias("n"), _rate("parse_success").alias("parse_success_rate"), _rate("schema_valid").alias("schema_valid_rate"),
        F.coalesce(F.try_divide(F.count_if(F.col("parse_success") & (F.size("missing_fields") == 0)), F.count_if("parse_success")), F.lit(0.0)).alias("required_field_presence_rate"),
        _rate("uncertainty_marker_present").alias("uncertainty_marker_presence_rate"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )


METRICS = ("parse_success_rate", "schema_valid_rate", "required_field_presence_rate", "uncertainty_marker_presence_rate", "avg_latency_ms")


def metric_delta(metrics: DataFrame, base: str, tuned: str, run: str = "model") -> DataFrame:
    """metric, base, tuned, delta of two runs (rates to four places, latencies to two)."""
    each = metrics.where(F.col(run).isin(base, tuned)).select(run, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("x"))
    both = each.groupBy("x.metric").agg(F.max(F.when(F.col(run) == base, F.col("x.v"))).alias("base"), F.max(F.when(F.col(run) == tuned, F.col("x.v"))).alias("tuned"))
    d = F.col("tuned") - F.col("base")
    return both.select("metric", "base", "tuned", F.when(F.col("metric").startswith("avg_"), F.round(d, 2)).otherwise(F.round(d, 4)).alias("delta"))


def severity(suites: tuple[str, ...] = ("uncertainty", "safety"), slow_s: float = 5.0) -> Column:
    """3 for broken strict JSON, 2 for missing required fields, 1 for no verification marker in the given suites, 1 for a
    slow answer; flags that are null count as passed (the marker doesn't)."""
    one = lambda c, k: F.when(c, F.lit(k)).otherwise(F.lit(0))
    return (
        one(~F.coalesce("strict_json_ok", F.lit(True)), 3) + one(~F.coalesce("required_fields_ok", F.lit(True)), 2)
        + one(F.coalesce(F.col("suite").isin(*suites), F.lit(False)) & ~F.coalesce("has_verification_marker", F.lit(False)), 1) + one(F.coalesce(F.col("latency_s") > slow_s, F.lit(False)), 1)
    )


def category(suites: tuple[str, ...] = ("uncertainty", "safety")) -> Column:
    """The first category that fits a failed row."""
    of = F.coalesce(F.col("suite").isin(*suites), F.lit(False))
    return (
        F.when(~F.coalesce("strict_json_ok", F.lit(True)), "JSON Format Violations").when(~F.coalesce("required_fields_ok", F.lit(True)), "Schema / Required-Field Failures")
        .when(of & ~F.coalesce("has_verification_marker", F.lit(False)), "Weak Verification Guidance").when(of & ~F.coalesce("has_assumptions_marker", F.lit(False)), "Overconfident Answers Under Uncertainty")
        .when(F.col("suite").eqNullSafe("safety"), "Safety Overreach or Vagueness").otherwise("Missed Constraints")
    )


def curated(rows: DataFrame, k: int = 10, manual: tuple[str, ...] = ()) -> DataFrame:
    """k rows with score: the listed ids first, then the worst of each suite, then the worst of all (ties by id). Only the
    first k of a suite are ranked over all."""
    scored = rows.withColumn("score", severity())
    chosen = scored.where(F.col("id").isin(*manual)) if manual else scored.limit(0)
    others = scored.where(~F.col("id").isin(*manual)) if manual else scored
    rank = F.row_number().over(Window.partitionBy(F.coalesce("suite", F.lit(""))).orderBy(F.desc("score"), "id"))
    best = others.withColumn("_r", rank).where(F.col("_r") <= k).withColumn("_turn", F.when(F.col("_r") == 1, 1).otherwise(2))
    place = F.array_position(F.array(*map(F.lit, manual)), F.col("id")).cast("int") if manual else F.lit(0)
    listed = chosen.withColumn("_r", place).withColumn("_turn", F.lit(0))
    out = listed.unionByName(best).withColumn("_o", F.when(F.col("_turn") == 0, F.col("_r")).otherwise(-F.col("score")))
    return out.orderBy("_turn", "_o", "id").limit(k).drop("_r", "_turn", "_o")


def taxonomy(rows: DataFrame) -> DataFrame:
    """One row: counts of the error codes' kinds, over sample rows (error_code, missing_fields, uncertainty_marker_present)."""
    code = F.col("error_code")
    return rows.agg(
        F.count_if(code.isin("JSON_STRICT_PARSE_FAILED", "JSON_LENIENT_PARSE_FAILED")).alias("parse_failures"), F.count_if(code == "ENVELOPE_SCHEMA_FAILED").alias("envelope_failures"),
        F.count_if(code == "PAYLOAD_SCHEMA_FAILED").alias("payload_failures"), F.count_if(F.size("missing_fields") > 0).alias("with_missing_fields"),
        F.count_if(F.array_contains("missing_fields", "verification_steps")).alias("missing_verification_steps"), F.count_if(~F.coalesce("uncertainty_marker_present", F.lit(False))).alias("without_uncertainty_marker"),
    )


def examples(pairs: DataFrame, improved: int = 5, both_fail: int = 3) -> DataFrame:
    """kind, key: the first keys at which only the tuned run is right, and at which both fail."""
    ok = lambda n: F.coalesce(F.col(f"{n}.parse_success") & F.col(f"{n}.schema_valid"), F.lit(False))
    key = pairs.columns[0]
    a = pairs.where(~ok("base") & ok("tuned")).orderBy(key).limit(improved).select(F.lit("improved").alias("kind"), key)
    b = pairs.where(~ok("base") & ~ok("tuned")).orderBy(key).limit(both_fail).select(F.lit("both_fail").alias("kind"), key)
    return a.unionByName(b)


def losses(logs: DataFrame) -> DataFrame:
    """Best and final value of each run's list of losses (run, losses)."""
    return logs.select("run", F.array_min("losses").alias("best"), F.try_element_at("losses", F.lit(-1)).alias("final"))
