"""Joins of the inputs of a run, lookups, and what is skipped on resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import join_hot


def last_of(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row a key, the last by order; null keys are dropped. Whole rows are taken by an aggregate that combines before
    the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def join_inputs(plans: DataFrame, drafts: DataFrame, critiques: DataFrame, draft_id: str = "draft_id") -> DataFrame:
    """id, plan, draft, critique (structs, null where missing), reason and missing_components: full outer join of tables
    that have one row a key each. Without a plan or a draft the row is rejected as missing_inputs; critiques are optional,
    and a critique of nothing is a reject too."""
    whole = lambda df, key, name: df.select(F.col(key).alias("id"), F.struct(*df.columns).alias(name))
    out = whole(plans, "id", "plan").join(whole(drafts, "id", "draft"), "id", "full").join(whole(critiques, draft_id, "critique"), "id", "full")
    missing = F.array_compact(F.array(F.when(F.col("plan").isNull(), F.lit("plan")), F.when(F.col("draft").isNull(), F.lit("draft"))))
    return out.withColumn("missing_components", missing).withColumn("reason", F.when(F.size("missing_components") > 0, F.lit("missing_inputs")))


def reject_by_verdict(rows: DataFrame, verdict: Column) -> DataFrame:
    """The rows with reason critique_reject where the verdict is "reject" and there is no reason yet."""
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.lower(verdict) == "reject", F.lit("critique_reject"))))


def resume(rows: DataFrame, done: DataFrame, rejected: DataFrame | None = None, limit: int | None = None, limit_first: bool = False) -> DataFrame:
    """Rows not done yet: neither accepted nor rejected, but for rejects with missing inputs, which are tried again.

    limit: the first rows by ord, counted before what is done is skipped (limit_first) or after."""
    seen = done.select("id")
    if rejected is not None:
        seen = seen.unionByName(rejected.where(~F.col("reason").eqNullSafe("missing_inputs")).select("id"))
    first = rows.orderBy("ord").limit(limit) if limit is not None and limit_first else rows
    left = first.join(seen.distinct(), "id", "left_anti")
    return left.orderBy("ord").limit(limit) if limit is not None and not limit_first else left


def lookup(rows: DataFrame, *indexes: tuple[str, DataFrame]) -> DataFrame:
    """The rows with the row of the same id from each index, as structs under their names (null where there is none)."""
    for name, df in indexes:
        rows = rows.join(df.select("id", F.struct(*df.columns).alias(name)), "id", "left")
    return rows


def cached(rows: DataFrame, cache: DataFrame, key: str = "recipe_id") -> tuple[DataFrame, DataFrame]:
    """(rows with their cached response, rows without): left join with the cache, one row a key."""
    both = rows.join(cache.select(F.col(key), F.col("response")), key, "left")
    return both.where("response is not null"), both.where("response is null").drop("response")


def paired(base: DataFrame, tuned: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Rows of both runs with the same key: key, base, tuned."""
    s = lambda df, n: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(n))
    return s(base, "base").join(s(tuned, "tuned"), key)


def in_list_order(rows: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of the given ids with pos, their place in the list."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return rows.join(F.broadcast(listed), "id")


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that one lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def labelled(rows: DataFrame, labels: DataFrame, key: str, weight: str) -> DataFrame:
    """Join with one row a key of labels, whose weight counts the rows; hot keys apart."""
    return join_hot(rows, labels, key, weight)
