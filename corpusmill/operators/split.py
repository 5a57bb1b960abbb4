"""Splits that keep linked records together: assignment of groups, validation, statistics, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.balance import hashed
from corpusmill.session import join_hot

SPLITS = ("train", "val", "test")


def assign_sizes(sizes: list[tuple[str, int]], fractions: tuple[float, ...] = (0.8, 0.1, 0.1)) -> dict[str, str]:
    """group -> split, groups in the given order: each goes whole to the split that lacks the largest share of its target
    (ties: the first one)."""
    total = sum(n for _, n in sizes)
    target = [int(total * f) for f in fractions]
    now = [0] * len(target)
    out = {}
    for g, n in sizes:
        lack = [(t - c) / t if t else 0.0 for t, c in zip(target, now)]
        k = max(range(len(lack)), key=lambda i: (lack[i], -i))
        out[g] = SPLITS[k]
        now[k] += n
    return out


def assign(groups: DataFrame, fractions: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 42, head: int = 100_000) -> DataFrame:
    """id, group_id, split of every record of groups (id, group_id).

    The greedy assignment is sequential in the order of a hash of the groups; the driver runs it over the largest groups,
    ``head`` at most (all of one size or none of it), which decide the shares. The others, each small beside a share, go by
    a hash of the group, in proportion to what each split lacks then."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    least, held = 0, 0
    for r in sizes.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():  # one row a distinct size
        held += r.k
        if held > head:
            least = r.n + 1
            break
    top = sizes.where(F.col("n") >= least).withColumn("o", hashed(seed, "group_id")).collect()  # at most head rows
    total = groups.count()
    order = [(r.group_id, r.n) for r in sorted(top, key=lambda r: (r.o, r.group_id))]
    spark = groups.sparkSession
    kind = groups.schema["group_id"].dataType.simpleString()
    if sum(n for _, n in order) == total:
        placed = spark.createDataFrame(list(assign_sizes(order, fractions).items()), f"group_id {kind}, split string")
    else:
        done = assign_sizes(order, fractions)
        held = {s: sum(n for g, n in order if done[g] == s) for s in SPLITS}
        rest = [max(0, int(total * f) - held[s]) for s, f in zip(SPLITS, fractions)]
        share = [sum(rest[: k + 1]) / max(sum(rest), 1) for k in range(len(rest))]
        u = F.conv(F.substring(hashed(seed, "group_id"), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
        large = spark.createDataFrame(list(done.items()), f"group_id {kind}, split string")
        small = sizes.join(F.broadcast(large), "group_id", "left_anti").select("group_id", F.when(u < share[0], SPLITS[0]).when(u < share[1], SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
        placed = large.unionByName(small)
    return join_hot(groups.select("id", "group_id"), sizes.join(placed, "group_id"), "group_id", "n")


def group_stats(groups: DataFrame) -> DataFrame:
    """One row: groups, least, upper median and largest size, groups of one. The median is read from the counts of each
    size, which are far fewer than the groups."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("k"))
    rows = sizes.orderBy("size").collect()  # one row a distinct size
    n = sum(r.k for r in rows)
    seen, median = 0, None
    for r in rows:
        seen += r.k
        if median is None and seen > n // 2:
            median = r.size
    out = (n, min((r.size for r in rows), default=None), median, max((r.size for r in rows), default=None), sum(r.k for r in rows if r.size == 1))
    return groups.sparkSession.createDataFrame([out], "num_groups long, min_size long, median_size long, max_size long, singletons long")


def validate(rows: DataFrame) -> DataFrame:
    """One row: groups and fingerprints that stand in more than one split (columns group_id, fingerprint, split)."""
    spanning = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("k")).first().k
    g, f = spanning("group_id"), spanning("fingerprint")
    return rows.sparkSession.createDataFrame([(g, f, g + f == 0)], "groups_spanning_splits long, fingerprints_spanning_splits long, leakage_free boolean")


def distributions(rows: DataFrame) -> DataFrame:
    """split, dim_name, value, n of category, difficulty, payload type and region tags."""
    dims = {"category": "unknown", "difficulty": "medium", "payload_type": "unknown"}
    each = F.array(*(F.struct(F.lit(d).alias("dim_name"), F.coalesce(d, F.lit(v)).alias("value")) for d, v in dims.items()))
    tags = F.transform(F.coalesce("region_tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("region_tag").alias("dim_name"), t.alias("value")))
    return rows.select("split", F.explode(F.concat(each, tags)).alias("x")).groupBy("split", "x.dim_name", "x.value").agg(F.count("*").alias("n"))


HELD_OUT = ("id", "prompt", "payload_type", "category", "difficulty", "region_tags")


def held_out(rows: DataFrame, split: str = "test") -> DataFrame:
    """The prompts of a split, without their answers."""
    return rows.where(F.col("split") == split).select(*HELD_OUT)


def written_splits(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines a split, each in the order of ord."""
    rows.repartitionByRange("split", "ord").sortWithinPartitions("split", "ord").write.mode("overwrite").partitionBy("split").json(path)


def membership(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """split_version, split, id of split lines (split_path, record_id): the paths of the manifest, in any spelling of the
    same path, once each."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"[\\/]+", "/"), r"/(\./)+", "/"), r"^(\./)+", "")
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), clean(F.col(f"outputs.{s}_path")).alias("path")) for s in SPLITS)))
    paths = manifest.select("split_version", sides.alias("s")).select("split_version", "s.*")
    return lines.select(clean(F.col("split_path")).alias("path"), F.col("record_id").alias("id")).join(paths, "path").select("split_version", "split", "id").distinct()


def in_one_split(spark: SparkSession, members: DataFrame) -> DataFrame:
    """split_version, id of records that stand in more than one split of a version."""
    return members.groupBy("split_version", "id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("split_version", "id")
