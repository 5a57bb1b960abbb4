"""Exact and near duplicates. Records: id, ord (position, unique), and the columns the keys are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed, text
from corpusmill.operators import graph
from corpusmill.session import cut, drop, join_hot


def exact_dedup(records: DataFrame, key: Column) -> DataFrame:
    """The records with anchor_id (id of the first record of the same key, null for that record itself) and reason
    (exact_duplicate, or null for kept ones). The first by ord is found by an aggregate, so a key with a third of all
    rows is combined before the shuffle; null keys are one key."""
    keyed = records.withColumn("_key", F.coalesce(key, F.lit("\0null")))
    first = keyed.groupBy("_key").agg(F.min(F.struct("ord", "id")).alias("_first"), F.count("*").alias("_n"))
    out = join_hot(keyed, first, "_key", "_n")
    dup = F.col("ord") != F.col("_first.ord")
    return out.select(*records.columns, F.when(dup, F.col("_first.id")).alias("anchor_id"), F.when(dup, F.lit("exact_duplicate")).alias("reason"))


def shingled(records: DataFrame, words: Column, k: int = fixed.SHINGLE_SIZE, modulo: int = fixed.BUCKET_MODULO, digest: str = "md5") -> DataFrame:
    """id, ord, sh (distinct shingles), bucket."""
    # In steps, so that each is evaluated once a row, not once a shingle.
    out = records.select("id", "ord", words.alias("_w")).select("id", "ord", text.shingles(F.col("_w"), k).alias("sh"))
    return out.withColumn("bucket", text.bucket_id(F.col("sh"), modulo, digest))


def _classes(sh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes of equal shingle sets: c (least ord), bucket, sh; members: id, ord, c)."""
    keyed = cut(sh.withColumn("h", F.sha2(F.array_join(F.sort_array("sh"), "\n"), 256)))
    rep = keyed.groupBy("h").agg(F.min("ord").alias("c"), F.count("*").alias("n"), F.min_by("id", "ord").alias("c_id"))
    members = cut(join_hot(keyed.select("id", "ord", "h"), rep, "h", "n").select("id", "ord", "c", "c_id"))
    reps = cut(keyed.join(members.where("ord = c").select(F.col("id").alias("_i"), "c"), F.col("ord") == F.col("c"), "left_semi").select(F.col("ord").alias("c"), "id", "bucket", "sh"))
    return reps, members


def similar_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b (a before b), sim: every pair of rows (c, bucket, sh; distinct sets, not empty) of one bucket whose Jaccard
    similarity reaches the threshold.

    Prefix filter: with the shingles of each row in one order for all, rarest first, two similar sets share one of the
    first n - ceil(threshold x n) + 1. So only rows that share a rare shingle meet, never all of a bucket, and none is
    missed.
    """
    rows = reps.where(F.size("sh") > 0)
    seen = rows.select(F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("f"))
    marked = join_hot(rows.select("c", "bucket", F.size("sh").alias("n"), F.explode("sh").alias("s")), seen.select("s", "f", F.col("f").alias("w")), "s", "w")
    ordered = marked.groupBy("c", "bucket", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("m"))
    prefix = F.slice("m", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int"))
    keys = cut(ordered.select("c", "bucket", "n", F.explode(prefix).alias("m")).where("m.f > 1").select("c", "bucket", "n", F.col("m.s").alias("s")))
    one = lambda p: keys.select("bucket", "s", F.col("c").alias(p), F.col("n").alias(f"n_{p}"))
    met = one("a").join(one("b"), ["bucket", "s"]).where("a < b").where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9).select("a", "b").distinct()
    sets = lambda p: rows.select(F.col("c").alias(p), F.col("sh").alias(f"sh_{p}"))
    return met.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", text.jaccard(F.col("sh_a"), F.col("sh_b")).alias("sim")).where(F.col("sim") >= threshold - 1e-12)


def near_pairs(records: DataFrame, words: Column, threshold: float = 0.75, k: int = fixed.SHINGLE_SIZE, modulo: int = fixed.BUCKET_MODULO, digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives: id_a, id_b, similarity), (members: id, anchor_id of its representative).

    Rows of equal shingle sets are one class, whose first row represents it; classes aren't expanded into pairs. Rows
    without shingles are one class that is similar to no other."""
    reps, members = _classes(shingled(records, words, k, modulo, digest))
    pairs = similar_pairs(reps, threshold)
    ids = lambda p: reps.select(F.col("c").alias(p), F.col("id").alias(f"id_{p}"))
    return pairs.join(ids("a"), "a").join(ids("b"), "b").select("id_a", "id_b", F.round("sim", 4).alias("similarity")), members.select("id", F.col("c_id").alias("anchor_id"))


def near_dedup(records: DataFrame, words: Column, threshold: float = 0.88, k: int = fixed.SHINGLE_SIZE, modulo: int = fixed.BUCKET_MODULO) -> DataFrame:
    """id, anchor_id, similarity, reason: each record with the first kept earlier record of its bucket that is similar
    (null for kept ones).

    A record is kept if no kept earlier record is similar. That is settled in rounds over the similar pairs, not by
    folding over a bucket: a row all of whose earlier neighbours are dropped is kept, a row with a kept earlier
    neighbour is dropped; each round settles at least the least open row of every component, and most others.
    """
    reps, members = _classes(shingled(records, words, k, modulo, "md5"))
    pairs = cut(similar_pairs(reps, threshold))
    open_ = cut(pairs.select("a", "b"))
    kept_b = None  # rows that have earlier neighbours and are kept
    dropped = None
    while not open_.isEmpty():
        # Rows without an open earlier neighbour are settled as kept; their later neighbours are dropped.
        waiting = open_.select(F.col("b").alias("a")).distinct()
        free = open_.select("a").distinct().join(waiting, "a", "left_anti")
        gone = cut(open_.join(free, "a", "left_semi").select("b").distinct())
        dropped = gone if dropped is None else cut(dropped.unionAll(gone))
        # Pairs with a dropped row say nothing any more: it can't drop others.
        left = cut(open_.join(gone, "b", "left_anti").join(gone.toDF("a"), "a", "left_anti"))
        drop(open_)
        open_ = left
    if dropped is None:
        dropped = pairs.select("b").limit(0)
    alive = pairs.join(dropped.toDF("a"), "a", "left_anti").join(dropped, "b", "left_semi")
    anchors = alive.groupBy("b").agg(F.min(F.struct("a", "sim")).alias("x")).select(F.col("b").alias("c"), F.col("x.a").alias("a"), F.col("x.sim").alias("sim"))
    names = reps.select(F.col("c").alias("a"), F.col("id").alias("anchor"))
    by_class = anchors.join(names, "a").select("c", "anchor", "sim")
    hits = members.groupBy("c").agg(F.count("*").alias("n")).join(by_class, "c", "left")
    out = join_hot(members, hits, "c", "n")
    copy = F.col("ord") != F.col("c")
    anchor = F.coalesce("anchor", F.when(copy, F.col("c_id")))
    sim = F.when(F.col("anchor").isNotNull(), F.round("sim", 4)).when(copy, F.lit(1.0))
    return out.select("id", anchor.alias("anchor_id"), sim.alias("similarity"), F.when(anchor.isNotNull(), F.lit("near_duplicate")).alias("reason"))


def duplicate_examples(rejects: DataFrame, per_reason: int = 5, snippet: int = 80) -> DataFrame:
    """The first rejects (by ord) of each reason: reason, id, anchor_id, prompt_snippet. Spark limits the rows of each
    reason before the shuffle (a window group limit), so a reason with most rows isn't gathered."""
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("ord"))
    return rejects.where("reason is not null").withColumn("_r", rank).where(F.col("_r") <= per_reason).select("reason", "id", "anchor_id", F.substring("prompt", 1, snippet).alias("prompt_snippet"))


def leakage_groups(records: DataFrame, key: Column, words: Column, threshold: float = 0.75, k: int = fixed.SHINGLE_SIZE, modulo: int = fixed.BUCKET_MODULO) -> DataFrame:
    """id, group_id (the least id): records of one key, or of similar shingles in one bucket, directly or through others."""
    keyed = records.select("id", F.coalesce(key, F.lit("\0null")).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("id").alias("a"), F.count("*").alias("_n"))
    stars = join_hot(keyed, first, "_key", "_n").select("a", F.col("id").alias("b"))
    pairs, members = near_pairs(records, words, threshold, k, modulo)
    # Rows without shingles are similar to each other only as rows of one class: those of the class are linked too.
    edges = stars.unionAll(pairs.select(F.col("id_a"), F.col("id_b"))).unionAll(members.select("anchor_id", "id"))
    return graph.components(records.select("id"), cut(edges.where("a <> b").distinct()))
