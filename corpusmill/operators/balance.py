"""Balancing, sampling, shuffling. All orders are by a hash of seed and id: results don't depend on partitions.

Cuts to n rows a group are made by the rank of the hash within the group; where a group can hold most rows, the hash is
first cut by its buckets, so that only one bucket a group is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut


def bucket_key() -> Column:
    """category, difficulty and payload type, with defaults."""
    return F.struct(F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"), F.coalesce("payload_type", F.lit("unknown")).alias("payload_type"))


KEYS = ("category", "difficulty", "payload_type")


def with_bucket(records: DataFrame) -> DataFrame:
    b = bucket_key()
    return records.withColumns({f"b_{k}": b[k] for k in KEYS})


def bucket_stats(records: DataFrame) -> DataFrame:
    """category, difficulty, payload_type, n."""
    b = bucket_key()
    return records.groupBy(*(b[k].alias(k) for k in KEYS)).agg(F.count("*").alias("n"))


def target_caps(stats: DataFrame, factor: float = 2.0, hard: float = 3.0) -> DataFrame:
    """The buckets with cap: the upper median of all counts times a factor, cut to a whole number, at least 1. Buckets of
    difficulty "hard" have a factor of their own. There are as many buckets as combinations of labels."""
    middle = stats.agg(F.element_at(F.array_sort(F.collect_list("n")), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("m")).first().m if not stats.isEmpty() else None
    factor_of = F.when(F.col("difficulty") == "hard", F.lit(hard)).otherwise(F.lit(factor))
    return stats.withColumn("median", F.lit(middle).cast("long")).withColumn("cap", F.greatest(F.lit(1), F.floor(F.col("median") * factor_of)).cast("long"))


def hashed(seed: int, *cols: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols)))


def first_of_each(records: DataFrame, keys: list[str], wanted: DataFrame, order: Column, tie: str = "id") -> DataFrame:
    """Of each group the rows of least order: as many as wanted (keys, take) says, all where it has no row for the group.

    order: a hexadecimal hash. Its leading digits are counted first; whole buckets below the cut are taken, and only the
    bucket that holds it is ranked. The result has _taken, true for the rows within the cut."""
    b = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    rows = records.withColumn("_o", order).withColumn("_b", b)
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_k")).join(F.broadcast(wanted), keys)
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_b"))
    cut = counts.withColumn("_u", upto).where("_u - _k < take").groupBy(*keys).agg(F.max("_b").alias("_last"), F.max_by(F.col("take") - F.col("_u") + F.col("_k"), "_b").alias("_rest"))
    marked = rows.join(F.broadcast(cut), keys, "left")
    inside = F.col("_last").isNull() | (F.col("_b") < F.col("_last"))
    edge = marked.where(F.col("_b") == F.col("_last"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", tie))
    decided = marked.where(F.col("_last").isNull() | (F.col("_b") != F.col("_last"))).withColumn("_taken", inside)
    ranked = edge.withColumn("_taken", rank <= F.col("_rest"))
    return decided.unionByName(ranked).drop("_o", "_b", "_last", "_rest")


def downsample(records: DataFrame, caps: DataFrame, seed: int = 42) -> DataFrame:
    """The records with reason balanced_downsample where their bucket has more rows than its cap and their hash is beyond
    it; buckets within their cap keep all."""
    over = caps.where("n > cap").select(*(F.col(k).alias(f"b_{k}") for k in KEYS), F.col("cap").alias("take"))
    got = first_of_each(with_bucket(records), [f"b_{k}" for k in KEYS], over, hashed(seed, "id"))
    return got.withColumn("reason", F.when(~F.col("_taken"), F.lit("balanced_downsample"))).drop("_taken", *(f"b_{k}" for k in KEYS))


def balance_stats(records: DataFrame, balanced: DataFrame, caps: DataFrame) -> DataFrame:
    """Buckets with rows before and after, removed and cap."""
    after = bucket_stats(balanced.where("reason is null")).withColumnRenamed("n", "post")
    return caps.select(*KEYS, F.col("n").alias("pre"), "cap", "median").join(after, list(KEYS), "left").select(*KEYS, "pre", F.coalesce("post", F.lit(0)).alias("post"), (F.col("pre") - F.coalesce("post", F.lit(0))).alias("removed"), "cap", "median")


def sample(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n records of least hash, without replacement; all if there are no more."""
    return records.withColumn("_o", hashed(seed, "id")).orderBy("_o", "id").limit(n).drop("_o")


def shuffled(records: DataFrame, seed: int = 42) -> DataFrame:
    """All records in the order of the hash."""
    return records.orderBy(hashed(seed, "id"), "id")


def round_robin(records: DataFrame, strata: list[str], n: int, seed: int = 42) -> DataFrame:
    """n records, one of each stratum a round, strata in the order of a hash; all if there are no more. At most n rows of
    a stratum are ranked (a window group limit cuts them before the shuffle)."""
    null_safe = [F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata]
    rank = F.row_number().over(Window.partitionBy(*null_safe).orderBy(hashed(seed, "id"), "id"))
    ranked = records.withColumn("_round", rank).where(F.col("_round") <= n)
    return ranked.orderBy("_round", hashed(seed, *null_safe), *null_safe).limit(n).drop("_round")


def pool_or_both(first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """The first pool if it has n rows, else both."""
    return first if first.limit(n).count() >= n else first.unionByName(second, allowMissingColumns=True)


def oversample(records: DataFrame, factor: float, seed: int = 42) -> DataFrame:
    """floor((factor - 1) x rows) draws with replacement: the drawn records with a new id and source_id. The records are
    numbered by ranges of a hash, without gathering them."""
    records = cut(records)
    numbered = _numbered(records, seed)
    n = records.count()
    more = int((factor - 1) * n)
    if more <= 0 or not n:
        return records.limit(0).withColumn("source_id", F.col("id"))
    draws = records.sparkSession.range(more).select(F.col("id").alias("_i"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("_n"))
    drawn = numbered.join(draws, "_n")
    return drawn.withColumn("source_id", F.col("id")).withColumn("id", F.concat(F.lit("v2_oversample_"), F.col("id"), F.lit("_"), F.col("_i").cast("string"))).drop("_n", "_i")


def _numbered(records: DataFrame, seed: int) -> DataFrame:
    """_n: 0, 1, … in the order of the hash, by counts of the hash's leading digits."""
    rows = records.withColumn("_o", hashed(seed, "id")).withColumn("_b", F.substring("_o", 1, 3))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_k"))  # at most 4,096 rows
    starts = counts.withColumn("_s", F.sum("_k").over(Window.orderBy("_b")) - F.col("_k")).drop("_k")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_o", "id"))
    return rows.join(F.broadcast(starts), "_b").withColumn("_n", F.col("_s") + rank - 1).drop("_o", "_b", "_s")


def oversample_matches(records: DataFrame, tags: Column, modes: tuple[str, ...], factor: float, seed: int = 42) -> DataFrame:
    """Draws from the records tagged with one of the modes."""
    return oversample(records.where(F.arrays_overlap(tags, F.array(*map(F.lit, modes)))), factor, seed)


def upto(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The records in the order of the hash, n at most."""
    return sample(records, n, seed)

