"""Problem 2: a sample that matches target proportions over several category margins.

Method: rake cell weights by iterative proportional fitting; draw the rows of smallest weighted exponential key
-ln(u) / weight over the whole pool; then repair the drawn counts of the cells until every minimum that can be met is met
and no move of one draw brings the margins closer; report the residual gaps.

The pool is aggregated to cells (one per combination of target values; values without a target share one cell value), so
the raking works on at most prod(targets + 1) rows whatever the size of the pool. No cut needs a sort of the pool: keys are
counted in buckets, whole buckets are taken, and only the bucket that holds the cut is divided further, so a cell with a
third of all rows is never gathered in one task. A repaired cell gives its rows of smallest key.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, drop

#: Value of a null label, by dimension; any other dimension has "unknown".
DEFAULTS = {"difficulty": "medium"}
OTHER = "\0other"


def label(c: Column, dim: str) -> Column:
    """Lower case, without outer white space; null gives the dimension's default. A blank label stays blank."""
    return F.coalesce(F.regexp_replace(F.lower(c.cast("string")), r"(?U)^\s+|\s+$", ""), F.lit(DEFAULTS.get(dim, "unknown")))


def rake(counts: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], size: float, tol: float = 1e-9) -> np.ndarray:
    """Expected draws of each cell: start at the pool's own proportions and scale to each margin in turn, never above
    what a cell holds, until nothing changes or (where the margins contradict each other) the changes stop shrinking.
    margins: for each dimension the value number of each cell and the wanted draws of each value."""
    have = counts.astype(float)
    w = have * (size / max(have.sum(), 1))
    least, since = np.inf, 0
    while since < 100:
        old = w.copy()
        for which, want in margins:
            now = np.bincount(which, w, len(want))
            w = np.minimum(w * np.where(now > 0, want / np.where(now > 0, now, 1), 0)[which], have)
        change = np.abs(w - old).max(initial=0)
        if change < tol:
            break
        least, since = (change, 0) if change < 0.999 * least else (least, since + 1)
    # Margins that can't be met leave draws over: give them to the cells with room, in proportion to it.
    while True:  # each turn fills a cell or ends
        short = size - w.sum()
        room = have - w
        if short <= 1e-6 or room.sum() <= 1e-6:
            break
        weight = np.where(room > 1e-9, np.maximum(w, 1e-9), 0)
        w = np.minimum(w + short * weight / weight.sum(), have)
    return w


def best_move(whiches: list[np.ndarray], up: list[np.ndarray], down: list[np.ndarray], to: np.ndarray, of: np.ndarray) -> tuple[float, int, int]:
    """(gain, receiving cell, giving cell) of the best move among all pairs of cells of the masks ``to`` and ``of``.

    Only the dimensions in which the two cells differ count. The gap is convex, so what a shared dimension would add
    (up + down of one value) is never above zero: for each set of dimensions taken as shared, the best receiver and giver
    of each combination of values there give a bound from below on that pair's gain, met where exactly these are shared.
    """
    best = (0.0, -1, -1)
    into, out = np.flatnonzero(to), np.flatnonzero(of)
    if not len(into) or not len(out):
        return best
    for shared in product((False, True), repeat=len(whiches)):
        if all(shared):
            continue
        group = np.zeros(len(to), dtype=np.int64)
        for which, s in zip(whiches, shared):
            if s:
                group = np.unique(group * (which.max() + 1) + which, return_inverse=True)[1]
        gain = sum(u for u, s in zip(up, shared) if not s)
        loss = sum(d for d, s in zip(down, shared) if not s)
        first, second = np.full(group.max() + 1, -np.inf), np.full(group.max() + 1, -np.inf)
        np.maximum.at(first, group[into], gain[into])
        np.maximum.at(second, group[out], loss[out])
        g = int((first + second).argmax())
        if first[g] + second[g] > best[0]:
            i = into[(group[into] == g) & (gain[into] == first[g])][0]
            j = out[(group[out] == g) & (loss[out] == second[g])][0]
            best = (float(first[g] + second[g]), int(i), int(j))
    return best


def quotas(counts: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], least: list[np.ndarray], size: int, drawn: np.ndarray | None = None) -> np.ndarray:
    """Whole draws of each cell: the drawn ones (without them, the raked ones rounded by largest remainder), moved between
    cells until every minimum that the pool can meet is met and no move of one draw brings the margins closer."""
    size = int(min(size, counts.sum()))
    if drawn is not None:
        q = drawn.astype(int).copy()
    else:
        w = rake(counts, margins, size)
        q = np.minimum(np.floor(w + 1e-9).astype(int), counts)
        for i in np.argsort(-(w - q), kind="stable"):
            if q.sum() >= size:
                break
            q[i] += q[i] < counts[i]
    for i in np.argsort(-(counts - q), kind="stable"):
        if q.sum() >= size:
            break
        q[i] += min(size - q.sum(), counts[i] - q[i])

    floor = [np.minimum(np.ceil(m), np.bincount(which, counts, len(m))) for (which, _), m in zip(margins, least)]
    now = [np.bincount(which, q, len(want)).astype(float) for which, want in margins]
    step = max(1, size // 64)
    while step:
        up, down = [], []
        for (which, want), have, low in zip(margins, now, floor):
            # Differences before weights: a large penalty must not round away a small gap.
            less = lambda x: np.abs(have - want) - np.abs(x - want) + 1e6 * (np.maximum(0, low - have) - np.maximum(0, low - x))  # noqa: E731, B023
            up.append(less(have + step)[which])
            down.append(less(have - step)[which])
        move, i, j = best_move([which for which, _ in margins], up, down, q + step <= counts, q >= step)
        # The move's own gain, without the dimensions its cells share: rounding must not keep the search going.
        if move <= 1e-9 or sum((which[i] != which[j]) * (u[i] + d[j]) for (which, _), u, d in zip(margins, up, down)) <= 1e-9:
            step //= 4 if step > 3 else 2
            continue
        q[i] += step
        q[j] -= step
        now = [np.bincount(which, q, len(want)).astype(float) for which, want in margins]
    return q


def _smallest(keyed: DataFrame, n: int, few: int = 50_000, parts: int = 4096) -> tuple[float, str] | None:
    """(key, id) of the n-th smallest key: buckets of the key are counted and the one that holds it is divided again until
    it is small enough to sort. At most ``parts`` counts reach the driver a turn."""
    low, high = keyed.agg(F.min("sample_key"), F.max("sample_key")).first()
    if low is None or n <= 0:
        return None
    while True:
        inside = keyed.where(F.col("sample_key").between(low, high))
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("sample_key") - low) / width), F.lit(parts - 1)).cast("int")
        counts = dict(inside.groupBy(at.alias("b")).count().collect())
        before = 0
        for b in sorted(counts):
            if before + counts[b] >= n:
                break
            before += counts[b]
        n -= before
        # Buckets as computed above: their rows are found by the same expression, not by rounded bounds.
        keyed, k = inside.where(at == b), counts[b]
        low, high = keyed.agg(F.min("sample_key"), F.max("sample_key")).first()
        if k <= few or low == high:
            break
    last = keyed.orderBy("sample_key", "id").limit(n).agg(F.max(F.struct("sample_key", "id")).alias("x")).first().x
    return last.sample_key, last.id


def sample_to_targets(pool: DataFrame, targets: DataFrame, id_col: str = "id", dims: tuple[str, ...] = ("category", "payload_type", "difficulty"), seed: int = 42, buckets: int = 4096, max_targets: int = 10_000, max_cells: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(sample: id and the normalised labels), (report: one row per target).

    targets: dim_name, dim_value, target_share, min_rows, sample_size; a configuration table of at most ``max_targets``
    rows and ``max_cells`` combinations of values (both checked: what the driver holds and broadcasts is no larger).
    An id is drawn once, with its least labels where repeats differ, but is available under each value it has; null ids
    are no prompts. need = the larger of min_rows and sample_size x target_share rounded half up; available = distinct ids
    with the value; unmet = the drawn sample stays below need although all of the value's ids could have been drawn, that
    is, need is above available. Ties in the keys are broken by id. Null values of targets stand for the label a null has.
    An empty pool or an empty target table gives an empty sample and a report over what there is.
    """
    spark = pool.sparkSession
    wanted = targets.where(F.col("dim_name").isin(*dims)).select("dim_name", "dim_value", "target_share", "min_rows", "sample_size").limit(max_targets + 1).collect()
    if len(wanted) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    norm = lambda t: DEFAULTS.get(t.dim_name, "unknown") if t.dim_value is None else t.dim_value.strip().lower()
    values = {d: sorted({norm(t) for t in wanted if t.dim_name == d}) for d in dims}
    if math.prod(len(v) + 1 for v in values.values()) > max_cells:
        raise ValueError(f"more than {max_cells} cells of target values: target fewer dimensions at once")
    size = max((t.sample_size or 0 for t in wanted), default=0)

    labelled = cut(pool.where(pool[id_col].isNotNull()).select(pool[id_col].alias("id"), *(label(pool[d], d).alias(d) for d in dims)).distinct())
    each = labelled.groupBy("id").agg(F.min(F.struct(*dims)).alias("l")).select("id", "l.*")
    each = each.select("id", *dims, *(F.when(F.col(d).isin(*values[d]), F.col(d)).otherwise(F.lit(OTHER)).alias(f"_{d}") for d in dims))
    each = each.withColumn("_u", F.xxhash64(F.lit(seed), "id").cast("double") / F.lit(2.0**64) + F.lit(0.5))
    each = cut(each.withColumn("_u", F.least(F.greatest("_u", F.lit(2.0**-64)), F.lit(1 - 2.0**-53))))
    cell = [f"_{d}" for d in dims]
    found = each.groupBy(*cell).count().collect()  # at most max_cells rows
    found.sort(key=lambda r: tuple(r[c] for c in cell))
    counts = np.array([r["count"] for r in found], dtype=int)
    margins, least = [], []
    for d in dims:
        number = {v: i for i, v in enumerate([*values[d], OTHER])}
        which = np.array([number[r[f"_{d}"]] for r in found], dtype=int)
        want, low = np.zeros(len(number)), np.zeros(len(number))
        for t in wanted:
            if t.dim_name == d:
                want[number[norm(t)]] += size * (t.target_share or 0)
                low[number[norm(t)]] = max(low[number[norm(t)]], t.min_rows or 0)
        if values[d]:
            margins.append((which, want))
            least.append(low)

    # The draw: the smallest exponential keys of the whole pool, each row weighing its cell's raked draws per row.
    schema = ", ".join(f"{c} string" for c in cell) + ", _w double"
    raked = rake(counts, margins, min(size, counts.sum())) if len(counts) and margins else np.zeros(len(counts))
    weights = spark.createDataFrame([(*(r[c] for c in cell), float(max(w / n, 1e-12))) for r, w, n in zip(found, raked, counts)], schema)
    keyed = cut(each.join(F.broadcast(weights), cell).withColumn("sample_key", -F.log("_u") / F.col("_w")).drop("_w"))
    drop(each)
    drawn = np.zeros(len(counts), dtype=int)
    if margins and (last := _smallest(keyed.select("sample_key", "id"), int(min(size, counts.sum())))):
        first = keyed.where(F.struct("sample_key", "id") <= F.struct(F.lit(last[0]), F.lit(last[1])))
        taken = {tuple(r[c] for c in cell): r["count"] for r in first.groupBy(*cell).count().collect()}
        drawn = np.array([taken.get(tuple(r[c] for c in cell), 0) for r in found], dtype=int)
    q = quotas(counts, margins, least, size, drawn) if len(counts) and margins else drawn

    # The repaired counts: in each cell the rows of smallest key, that is of largest u.
    schema = ", ".join(f"{c} string" for c in cell) + ", _quota long"
    plan = spark.createDataFrame([(*(r[c] for c in cell), int(k)) for r, k in zip(found, q)], schema)
    keyed_b = keyed.withColumn("_b", F.least(F.floor((1 - F.col("_u")) * buckets), F.lit(buckets - 1)).cast("int"))
    by_bucket = keyed_b.groupBy(*cell, "_b").agg(F.count("*").alias("_k")).join(F.broadcast(plan.where("_quota > 0")), cell)
    upto = F.sum("_k").over(Window.partitionBy(*cell).orderBy("_b"))
    marks = by_bucket.withColumn("_upto", upto).where("_upto - _k < _quota").withColumn("_take", F.least(F.col("_k"), F.col("_quota") - F.col("_upto") + F.col("_k")))
    near = keyed_b.join(marks.select(*cell, "_b", "_k", "_take"), [*cell, "_b"])
    whole = near.where("_take = _k").select("id", *dims, "sample_key")
    rank = F.row_number().over(Window.partitionBy(*cell, "_b").orderBy("sample_key", "id"))
    part = near.where("_take < _k").withColumn("_rank", rank).where("_rank <= _take").select("id", *dims, "sample_key")
    # Drawn once, here: the report counts these very rows, also where only its other columns are asked for.
    sample = cut(whole.unionByName(part))
    drop(keyed)

    stacked = lambda df: df.select("id", F.explode(F.array(*(F.struct(F.lit(d).alias("dim_name"), F.col(d).alias("v")) for d in dims))).alias("x")).select("id", "x.*").distinct().groupBy("dim_name", "v").count()
    goals = spark.createDataFrame([(t.dim_name, t.dim_value, norm(t), t.target_share, t.min_rows, t.sample_size) for t in wanted], "dim_name string, dim_value string, v string, target_share double, min_rows long, sample_size long")
    goals = goals.withColumn("need", F.greatest(F.coalesce("min_rows", F.lit(0)), F.floor(F.coalesce("sample_size", F.lit(0)) * F.coalesce("target_share", F.lit(0.0)) + 0.5 + 1e-9)))
    report = (
        goals.join(stacked(labelled).withColumnRenamed("count", "available"), ["dim_name", "v"], "left")
        .join(stacked(sample).withColumnRenamed("count", "drawn"), ["dim_name", "v"], "left")
        .select("dim_name", "dim_value", "target_share", "min_rows", "need", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("drawn", F.lit(0)).alias("drawn"))
    )
    report = report.withColumn("gap", F.col("drawn") - F.col("need"))
    return sample, report.withColumn("unmet", (F.col("gap") < 0) & (F.col("need") > F.col("available")))
