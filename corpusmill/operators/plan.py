"""Generators: weighted draws, trip contexts, prompt plans, hard prompts. Every draw is a hash of seed, dimension and row
number, so any part of a plan can be made anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text


def uniform(seed: int, name: str, row: Column | str = "i") -> Column:
    """A uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(row) if isinstance(row, str) else row), F.lit(2**52)).cast("double") / F.lit(float(2**52))


def weighted(seed: int, name: str, weights: dict[str, float], row: Column | str = "i") -> Column:
    """A key drawn in proportion to its weight (weights needn't sum to 1)."""
    total, upto = sum(weights.values()), 0.0
    u, out = uniform(seed, name, row), None
    keys = list(weights)
    for k in keys[:-1]:
        upto += weights[k] / total
        out = F.when(u < upto, F.lit(k)) if out is None else out.when(u < upto, F.lit(k))
    return F.lit(keys[-1]) if out is None else out.otherwise(F.lit(keys[-1]))


def pick(seed: int, name: str, options: list[str], row: Column | str = "i") -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(uniform(seed, name, row) * len(options)) + 1).cast("int"))


def context(seed: int, constrained: Column, options: dict[str, tuple[float, list[str]]], default: str) -> Column:
    """The drawn constraints joined by commas: each name has a probability and its values; the default if there is none."""
    parts = [F.when(constrained & (uniform(seed, f"{n}?") < p), pick(seed, n, values)) for n, (p, values) in options.items()]
    return F.when(F.size(F.array_compact(F.array(*parts))) > 0, F.concat_ws(", ", *parts)).otherwise(F.lit(default))


def prompt_plan(spark: SparkSession, spec: dict) -> DataFrame:
    """id, payload_type, category, difficulty, region_tags, template_name, prompt, location, seed of spec["total_examples"]
    plans.

    spec: seed, total_examples, payload_types, categories, difficulties, regions (weights), locations (region -> list of
    (country, cities)), user_profiles, contexts, constraint_rate, templates (payload type -> text with {names}). The id
    counts the plans of a type; the counts of row ranges are summed first, so no task numbers a whole type."""
    seed, n = spec["seed"], spec["total_examples"]
    rows = spark.range(n).withColumnRenamed("id", "i")
    for c, w in (("payload_type", "payload_types"), ("category", "categories"), ("difficulty", "difficulties"), ("region", "regions")):
        rows = rows.withColumn(c, weighted(seed, c, spec[w]))
    places = [(region, [(country, city) for country, cities in where for city in cities]) for region, where in spec["locations"].items()]
    city = country = None
    for region, options in places:
        # A country is drawn first, then a city of it.
        countries = list(dict.fromkeys(c for c, _ in options))
        drawn = pick(seed, "country", countries)
        of = None
        for c in countries:
            one = pick(seed, "city", [t for k, t in options if k == c])
            of = F.when(drawn == c, one) if of is None else of.when(drawn == c, one)
        here = F.col("region") == region
        country = F.when(here, drawn) if country is None else country.when(here, drawn)
        city = F.when(here, of) if city is None else city.when(here, of)
    trip = context(seed, uniform(seed, "constrained") < spec.get("constraint_rate", 0.5), spec.get("contexts", {}), spec.get("default_context", "Planning a trip with flexible dates and budget"))
    rows = rows.withColumns({"country": country, "city": city, "user_profile": pick(seed, "profile", spec["user_profiles"]), "trip_context": trip})
    prompt = None
    for kind, template in spec["templates"].items():
        filled = text.from_template(template, {k: F.col(k) for k in ("user_profile", "trip_context", "country", "city", "category", "difficulty")})
        prompt = F.when(F.col("payload_type") == kind, filled) if prompt is None else prompt.when(F.col("payload_type") == kind, filled)
    part = F.floor(F.col("i") / 10_000)
    counts = rows.groupBy("payload_type", part.alias("p")).agg(F.count("*").alias("k"))
    starts = counts.withColumn("s", F.sum("k").over(Window.partitionBy("payload_type").orderBy("p")) - F.col("k")).select("payload_type", "p", "s")
    number = F.col("s") + F.row_number().over(Window.partitionBy("payload_type", "p").orderBy("i"))
    out = rows.withColumn("prompt", prompt).withColumn("p", part).join(starts, ["payload_type", "p"]).withColumn("no", number)
    return out.select(
        F.concat_ws("_", F.lit("v1"), "payload_type", "category", F.lpad(F.col("no").cast("string"), 4, "0")).alias("id"), "payload_type", "category", "difficulty", F.array("region").alias("region_tags"),
        F.concat("payload_type", F.lit("_draft.txt")).alias("template_name"), "prompt", F.struct("country", "city", "region").alias("location"), F.lit(seed).alias("seed"),
    )


def hard_prompts(spark: SparkSession, pool: list[tuple[str, str, str, str, str]], count: int, seed: int = 42) -> DataFrame:
    """count draws from the pool of (failure mode, payload type, category, difficulty, prompt), each with an id."""
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pool)], "k int, target_failure_mode string, payload_type string, category string, difficulty string, prompt string")
    rows = spark.range(count).withColumnRenamed("id", "i").withColumn("k", F.floor(uniform(seed, "pool") * len(pool)).cast("int"))
    return rows.join(F.broadcast(table), "k").select(F.concat(F.lit("v2_hard_"), "target_failure_mode", F.lit("_"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("id"), "prompt", "payload_type", "category", "difficulty", "target_failure_mode")


def plan_stats(plan: DataFrame) -> DataFrame:
    """dim_name, value, n over type, category, difficulty and first region."""
    each = F.array(*(F.struct(F.lit(d).alias("dim_name"), c.alias("value")) for d, c in (("payload_type", F.col("payload_type")), ("category", F.col("category")), ("difficulty", F.col("difficulty")), ("region", F.try_element_at("region_tags", F.lit(1))))))
    return plan.select(F.explode(each).alias("x")).groupBy("x.dim_name", "x.value").agg(F.count("*").alias("n"))
