"""Problem 1: consolidate pairwise matches into groups.

Method: repeatedly strip the vertices of degree one and compress the chains of degree-two vertices (list ranking by
pointer doubling), until no vertex of degree one or two is left; solve the reduced core with alternating large-star and
small-star rounds; then restore the labels of the removed vertices from the last removal back to the first.

Every step keeps fixed-size aggregates per vertex (degree, least and greatest neighbour), which are combined before the
shuffle. Where a column that may be hot is joined (a hub's pairs, its leaves, the members of a giant group), the few keys
that hold more than a small share of the rows are joined by broadcast (session.join_hot), so no task gathers a hub.
Lineage is cut by tables staged in the shared folder; those no later step reads are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.graph import star_contraction
from corpusmill.session import cut, drop, join_hot

#: Ids that name no record.
NO_RECORD = ("unknown",)


def clean_id(c: Column, no_record: tuple[str, ...] = NO_RECORD) -> Column:
    """The id without surrounding (Unicode) white space; null where it names no record."""
    t = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when((t != "") & ~t.isin(*no_record), t)


def _both(edges: DataFrame) -> DataFrame:
    """v, w: each edge in both directions."""
    return edges.select(F.col("lo").alias("v"), F.col("hi").alias("w")).unionAll(edges.select(F.col("hi").alias("v"), F.col("lo").alias("w")))


def _degrees(edges: DataFrame) -> DataFrame:
    """v, n, a, b: degree, least and greatest neighbour."""
    return _both(edges).groupBy("v").agg(F.count("*").alias("n"), F.min("w").alias("a"), F.max("w").alias("b"))


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")]


def strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed: v, parent), (edges left). Of an isolated edge the greater end is the leaf."""
    leaves = _degrees(edges).where("n = 1").select(F.col("v"), *_ordered(F.col("v"), F.col("a")))
    per_edge = leaves.groupBy("lo", "hi").agg(F.max("v").alias("v"))
    removed = cut(per_edge.select("v", F.when(F.col("v") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("parent"), "lo", "hi"))
    return removed, cut(edges.join(removed.select("lo", "hi"), ["lo", "hi"], "left_anti"))


def compress_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed: v, parent), (edges left). A chain of degree-two vertices becomes one edge between its ends; a chain
    that closes on itself becomes its least vertex. The ends are found for both directions by pointer doubling, in
    a number of rounds logarithmic in the longest chain. A vertex has one arc a direction, so no key here is hot."""
    two = cut(_degrees(edges).where("n = 2").select("v", "a", "b"))
    one_way = lambda p, y: two.select(F.col(p).alias("p"), F.col("v").alias("x"), F.col("v").alias("q"), F.col(y).alias("y"), F.col("v").alias("m"), F.lit(False).alias("done"))
    arcs = one_way("a", "b").unionAll(one_way("b", "a"))
    while True:
        ended, live = arcs.where("done"), arcs.where("not done")
        ahead = arcs.select(F.col("p").alias("q"), F.col("x").alias("y"), F.col("q").alias("q2"), F.col("y").alias("y2"), F.col("m").alias("m2"), F.col("done").alias("done2"))
        stepped = live.join(ahead, ["q", "y"], "left").select(
            "p", "x", F.coalesce("q2", "q").alias("q"), F.coalesce("y2", "y").alias("y"), F.least("m", "m2").alias("m"), F.coalesce("done2", F.lit(True)).alias("done"),
            (F.coalesce(F.col("done2"), F.lit(True)) | (F.coalesce(F.col("m2"), F.col("m")) < F.col("m"))).alias("moved"),
        )
        before, arcs = arcs, cut(ended.withColumn("moved", F.lit(False)).unionByName(stepped))
        drop(before)
        open_, moved = arcs.agg(F.count_if(~F.col("done")), F.count_if("moved")).first()
        if not open_ or not moved:  # what is still open runs in circles, and has seen its whole circle
            break
        arcs_at, arcs = arcs._staged_at, arcs.drop("moved")
        arcs._staged_at = arcs_at
    ends = arcs.groupBy("x").agg(F.min("y").alias("e"), F.max("y").alias("f"), F.min("m").alias("m"), F.bool_and("done").alias("done"))
    parents = cut(ends.select(F.col("x").alias("v"), F.when(F.col("done"), F.col("e")).otherwise(F.col("m")).alias("parent"), "e", "f", "done"))
    touched = two.select(*_ordered(F.col("v"), F.col("a"))).unionAll(two.select(*_ordered(F.col("v"), F.col("b"))))
    bridges = parents.where("done and e < f").select(F.col("e").alias("lo"), F.col("f").alias("hi")).distinct()
    left = cut(edges.join(touched, ["lo", "hi"], "left_anti").unionByName(bridges).distinct())
    drop(arcs, two)
    return parents.where("v <> parent").select("v", "parent"), left


def components(pairs: DataFrame, left: str = "duplicate_id", right: str = "anchor_id") -> DataFrame:
    """record_id, group_id: every record named in either column, with the least id (byte order) of all records linked
    with it directly or through others.

    Ids are taken without surrounding white space; null, blank and "unknown" are no records and link nothing, but the
    record on the other side of such a pair is kept, alone in its group unless another pair links it. Repeated,
    reversed and self pairs change nothing. An empty table gives an empty table; other columns are ignored.
    """
    links = pairs.select(clean_id(pairs[left]).alias("l"), clean_id(pairs[right]).alias("r"))
    names = links.select(F.col("l").alias("id")).unionAll(links.select(F.col("r").alias("id"))).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    # Sorted ranges numbered in order: comparing numbers is comparing ids by bytes, and each join moves 8 bytes a side.
    names = cut(names.orderBy("id").select("id", F.monotonically_increasing_id().alias("v"), "n"))
    ends = links.where("l <> r").select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    numbered = lambda df, side, to: join_hot(df, names.toDF(side, to, "n"), side, "n")
    edges = cut(numbered(numbered(ends, "l", "lo").select("lo", "r"), "r", "hi").select("lo", "hi"))
    count, removals = edges.count(), []
    while count:
        removed, left_ = strip_leaves(edges)
        removals.append(removed)
        drop(edges)
        removed, edges = compress_chains(left_)
        removals.append(removed)
        drop(left_)
        now = edges.count()
        if now == count:  # no vertex of degree one or two is left
            break
        count = now
    labels = cut(star_contraction(edges)) if count else None
    for removed in reversed(removals):
        if labels is None:
            found = removed.select("v", F.col("parent").alias("label"))
        else:
            # A hub is the parent of all its leaves: its rows are counted, so that it can be joined apart.
            held = removed.groupBy("parent").agg(F.count("*").alias("n"))
            up = held.join(labels.select(F.col("v").alias("parent"), "label"), "parent", "left")
            found = labels.unionByName(join_hot(removed.select("v", "parent"), up, "parent", "n").select("v", F.coalesce("label", "parent").alias("label")))
        old, labels = labels, cut(found)
        drop(old, removed)
    if labels is None:
        return names.select(F.col("id").alias("record_id"), F.col("id").alias("group_id"))
    # The label is some member; a group is named by its least member.
    member = cut(names.drop("n").join(labels, "v", "left").select("id", F.coalesce("label", "v").alias("label")))
    first = member.groupBy("label").agg(F.min("id").alias("group_id"), F.count("*").alias("n"))
    return join_hot(member, first, "label", "n").select(F.col("id").alias("record_id"), "group_id")
