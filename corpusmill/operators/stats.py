"""Distributions, shares, coverage, drift, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distributions(records: DataFrame, fallback: str | None = None) -> DataFrame:
    """dim_name, value, n, first_ord of category, difficulty, payload type and each region tag; null is "unknown".

    fallback: the JSON column whose payload_type stands in for a null one. One pass and one shuffle for all dimensions."""
    kind = F.col("payload_type") if fallback is None else F.coalesce("payload_type", F.get_json_object(fallback, "$.payload_type"))
    dims = {"category": F.col("category"), "difficulty": F.col("difficulty"), "payload_type": kind}
    each = F.array(*(F.struct(F.lit(d).alias("dim_name"), F.coalesce(c, F.lit("unknown")).alias("value")) for d, c in dims.items()))
    tags = F.transform(F.coalesce("region_tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("region_tag").alias("dim_name"), F.coalesce(t, F.lit("unknown")).alias("value")))
    return records.select("ord", F.explode(F.concat(each, tags)).alias("x")).groupBy("x.dim_name", "x.value").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def percentages(dist: DataFrame, total: int) -> DataFrame:
    """dim_name, value, n, pct of all records (tags too are divided by the records)."""
    return dist.select("dim_name", "value", "n", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.lit(total)), F.lit(0.0)), 2).alias("pct"))


def coverage(dist: DataFrame) -> DataFrame:
    """dim_name, distinct values, least and largest count and the values that have them (ties: the first seen)."""
    return dist.groupBy("dim_name").agg(
        F.count("*").alias("num_values"), F.min("n").alias("min_count"), F.max("n").alias("max_count"),
        F.min_by("value", F.struct("n", "first_ord", "value")).alias("min_value"), F.min_by("value", F.struct(-F.col("n"), F.col("first_ord"), F.col("value"))).alias("max_value"),
    )


def drift(dist: DataFrame, spec: DataFrame, dim: str = "category") -> DataFrame:
    """value, intended, observed, delta of every value of the specification (value, intended)."""
    seen = dist.where(F.col("dim_name") == dim).select("value", F.col("n").alias("observed"))
    return spec.join(seen, "value", "left").select("value", "intended", F.coalesce("observed", F.lit(0)).alias("observed"), (F.coalesce("observed", F.lit(0)) - F.col("intended")).alias("delta"))


def reasons(tagged: DataFrame) -> DataFrame:
    """reason, n, rate of all records; accepted ones are "accepted"."""
    got = tagged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    total = got.agg(F.sum("n").alias("t")).first().t or 0
    return got.select("reason", "n", F.round(F.coalesce(F.try_divide("n", F.lit(total)), F.lit(0.0)), 4).alias("rate"))


def top(dist: DataFrame, dim: str, k: int = 10) -> DataFrame:
    """The k most frequent values of a dimension with their share of all mentions."""
    one = dist.where(F.col("dim_name") == dim)
    total = one.agg(F.sum("n").alias("t")).first().t or 0
    return one.orderBy(F.desc("n"), "value").limit(k).select("value", "n", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.lit(total)), F.lit(0.0)), 2).alias("pct_of_mentions"))


def top_codes(rows: DataFrame, code: str, k: int = 10) -> DataFrame:
    """The k most frequent codes."""
    return rows.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(k)


def counts_by(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows of each combination of the columns' values."""
    return rows.groupBy(*cols).agg(F.count("*").alias("n"))


def top_removed(balance: DataFrame, k: int = 10) -> DataFrame:
    """The buckets that lost most."""
    return balance.where("removed > 0").orderBy(F.desc("removed"), "category", "difficulty", "payload_type").limit(k)


def capped_ids(rows: DataFrame, k: int) -> DataFrame:
    """The first ids by ord."""
    return rows.orderBy("ord").limit(k).select("id")


def run_counters(rows: DataFrame) -> DataFrame:
    """One row: attempted, accepted, rejected, and how many rejects each of the stages has."""
    return rows.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.count_if(F.col("reason") == "missing_inputs").alias("missing_inputs"), F.count_if(F.col("reason") == "critique_reject").alias("critique_rejects"),
    )
