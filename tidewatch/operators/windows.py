"""Equal-count windows and the analytic functions over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range of a global order (a range is sorted in one task), and the most ranges.
RANGE_ROWS, MOST_RANGES = 200_000, 65_536


def range_bounds(df: DataFrame, key: Column, rows: int | None = None) -> DataFrame:
    """One row: coarse (every step-th bound) and fine, the sorted distinct bounds that cut key into even ranges.

    The number of ranges follows the number of rows, up to MOST_RANGES numbers in one row, so it may be broadcast.
    """
    n = df.count() if rows is None else rows
    ranges = max(8, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    cut = [i / ranges for i in range(1, ranges)]
    fine = F.array_distinct(F.coalesce(F.percentile_approx(key, cut, max(10_000, 4 * ranges)), F.expr("cast(array() AS array<double>)")))
    out = df.agg(fine.alias("_fine")).withColumn("_step", F.greatest(F.ceil(F.sqrt(F.size("_fine"))), F.lit(1)).cast("int"))
    return out.withColumn("_coarse", F.expr("filter(_fine, (x, i) -> (i + 1) % _step = 0)"))


def range_of(key: Column) -> Column:
    """Number of bounds below key: first among the coarse ones, then among the fine ones of that stretch."""
    block = F.size(F.filter("_coarse", lambda x: x < key))
    inside = F.filter(F.slice("_fine", block * F.col("_step") + 1, F.col("_step")), lambda x: x < key)
    return F.when(key.isNull(), -1).otherwise(block * F.col("_step") + F.size(inside))


def global_position(df: DataFrame, order: str, tie: str, total: bool = False) -> DataFrame:
    """Adds pos, the row's place in the order of (order, tie), and with total _rows, without a one-partition sort.

    Quantiles of the order key cut the rows into ranges; a row's place is the rows of earlier ranges plus its place in
    its own range. Equal keys share a range: a key that holds most rows is sorted in one task, by spilling.
    """
    key = F.col(order).cast("timestamp").cast("double") if dict(df.dtypes)[order].startswith("timestamp") else F.col(order).cast("double")
    keyed = df.withColumn("_k", key)
    cut_rows = keyed.crossJoin(F.broadcast(range_bounds(keyed, F.col("_k")))).withColumn("_range", range_of(F.col("_k"))).drop("_k", "_fine", "_step", "_coarse")
    sizes = cut_rows.groupBy("_range").count()
    along = W.orderBy("_range")
    before = sizes.select("_range", (F.sum("count").over(along) - F.col("count")).alias("_before"), F.sum("count").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_rows"))
    placed = cut_rows.withColumn("_own", F.row_number().over(W.partitionBy("_range").orderBy(order, tie)))
    # One row for each range, so at most MOST_RANGES rows.
    out = placed.join(F.broadcast(before), "_range")
    return out.withColumn("pos", F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before", *([] if total else ["_rows"]))


def assign_windows(df: DataFrame, order: str, tie: str, per_window: int) -> DataFrame:
    """Adds window and pos (place in the window); the rows of an incomplete last window are dropped."""
    if per_window < 1:
        raise ValueError("per_window must be at least 1")
    placed = global_position(df, order, tie, total=True)
    placed = placed.where(F.col("pos") < F.col("_rows") - F.col("_rows") % per_window).drop("_rows")
    out = placed.withColumn("window", F.floor(F.col("pos") / per_window).cast("long"))
    return out.withColumn("pos", (F.col("pos") % per_window).cast("long"))


#: Values that selection fetches for one rank once no more are left between its pivots.
BRACKET = 10_000


def order_statistics(df: DataFrame, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The value of each (column, rank from 0) by distributed selection; nulls are left out.

    Each round sketches two pivots around every rank among the rows between its last pivots, and counts the rows beside
    and at them: one aggregation each for all ranks. A few ten thousandths of the rows are left per round, and only when
    BRACKET or fewer are, they are fetched.
    """
    out: dict[tuple[str, int], float] = {}
    sizes = df.agg(F.count(F.lit(1)), *(F.count(c) for c in dict.fromkeys(c for c, _ in wanted))).first()
    size_of = dict(zip(dict.fromkeys(c for c, _ in wanted), sizes[1:], strict=True))
    #: (value below, value above, rows up to the first, rows between both)
    left: dict[tuple[str, int], tuple[float, float, int, int]] = {(c, r): (-math.inf, math.inf, 0, size_of[c]) for c, r in wanted if 0 <= r < size_of[c]}
    x = lambda c: F.col(c).cast("double")
    between = lambda c, lo, hi: F.when((x(c) > lo) & (x(c) < hi), x(c))
    while left:
        small = [key for key, v in left.items() if v[3] <= BRACKET]
        if small:
            row = df.agg(*(F.array_sort(F.collect_list(between(c, *left[c, r][:2]))).alias(f"v{k}") for k, (c, r) in enumerate(small))).first()
            for k, (c, r) in enumerate(small):
                out[c, r] = row[k][r - left.pop((c, r))[2]]
            continue
        keys = list(left)
        aggs = []
        for k, (c, r) in enumerate(keys):
            lo, hi, below, held = left[c, r]
            share = (r - below + 0.5) / held
            aggs.append(F.percentile_approx(between(c, lo, hi), [max(0.0, share - 2e-4), min(1.0, share + 2e-4)], 10_000).alias(f"p{k}"))
        pivots = [tuple(p) for p in df.agg(*aggs).first()]
        aggs = []
        for (c, _), (p, q) in zip(keys, pivots, strict=True):
            aggs += [F.sum(F.when(cond, 1).otherwise(0)) for cond in (x(c) < p, x(c) <= p, x(c) < q, x(c) <= q)]
        counts = df.agg(*(a.alias(f"n{k}") for k, a in enumerate(aggs))).first()
        for k, ((c, r), (p, q)) in enumerate(zip(keys, pivots, strict=True)):
            lo, hi, below, held = left[c, r]
            under_p, to_p, under_q, to_q = counts[4 * k : 4 * k + 4]
            if under_p <= r < to_p or under_q <= r < to_q:
                out[c, r] = p if r < to_p else q
                del left[c, r]
            elif r < under_p:
                left[c, r] = (lo, p, below, under_p - below)
            elif r < under_q:
                left[c, r] = (p, q, to_p, under_q - to_p)
            else:
                left[c, r] = (q, hi, to_q, below + held - to_q)
    return out


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of columns, linear between neighbouring order statistics; None for a column without values."""
    sizes = df.agg(*(F.count(c) for c in wanted)).first()
    at = {(c, q): (n - 1) * q for c, n in zip(wanted, sizes, strict=True) for q in wanted[c] if n}
    ranks = sorted({(c, r) for (c, _), h in at.items() for r in (math.floor(h), math.ceil(h))})
    value = order_statistics(df, ranks) if ranks else {}

    def of(c: str, h: float) -> float:
        a, b = value[c, math.floor(h)], value[c, math.ceil(h)]
        return a + (h - math.floor(h)) * (b - a)

    return {c: [of(c, at[c, q]) if (c, q) in at else None for q in qs] for c, qs in wanted.items()}


def composite_order(df: DataFrame, bucket: str, order: str, tie: str, ranks: dict[str, int]) -> DataFrame:
    """combined_order = rank of the bucket + (place in the bucket - 1) / rows of the bucket; unknown buckets raise."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col(bucket))
    known = F.when(F.col(bucket).isin(*ranks), rank).otherwise(F.raise_error(F.concat(F.lit("unknown bucket "), F.col(bucket))))
    # Ranges of the order key part every bucket, so a bucket of any size is sorted in many tasks; counts carry over.
    kind = dict(df.dtypes)[order]
    key = (F.col(order).cast("timestamp") if kind.startswith(("timestamp", "date")) else F.col(order)).cast("double")
    keyed = df.withColumn("_k", key)
    cut_rows = keyed.crossJoin(F.broadcast(range_bounds(keyed, F.col("_k")))).withColumn("_range", range_of(F.col("_k"))).drop("_k", "_fine", "_step", "_coarse")
    sizes = cut_rows.groupBy(bucket, "_range").count()
    along = W.partitionBy(bucket).orderBy("_range")
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = sizes.select(F.col(bucket).alias("_b"), F.col("_range").alias("_r"), (F.sum("count").over(along) - F.col("count")).alias("_before"), F.sum("count").over(whole).alias("_rows"))
    placed = cut_rows.withColumn("_own", F.row_number().over(W.partitionBy(bucket, "_range").orderBy(order, tie)) - 1)
    out = placed.join(before, (F.col(bucket).eqNullSafe(F.col("_b"))) & (F.col("_range") == F.col("_r")))
    return out.withColumn("combined_order", known + (F.col("_before") + F.col("_own")) / F.col("_rows")).drop("_range", "_own", "_before", "_rows", "_b", "_r")


def standardize(x: Column, baseline: Column, direction: Column, over: W, full: bool = True) -> Column:
    """direction * (x - baseline mean) / max(baseline sd, 1e-6); missing is 0: no evidence."""
    base = F.when(baseline, x)
    mean, sd = F.avg(base).over(over), F.stddev_samp(base).over(over)
    z = direction * (x - mean) / F.greatest(sd, F.lit(1e-6))
    return F.coalesce(z if full else F.when(~baseline, z), F.lit(0.0))


def lagged(z: Column, lag: int, by: list[str], order: str = "window") -> Column:
    """The value known at a window whose labels arrive `lag` windows late. Apply before the baseline is dropped."""
    return F.lag(z, lag).over(W.partitionBy(*by).orderBy(order)) if lag else z


def episode_start(event: Column, j: int, by: list[str], order: str) -> Column:
    """An event with none in the j windows before; suppressed events suppress too."""
    before = F.max(event.cast("int")).over(W.partitionBy(*by).orderBy(order).rowsBetween(-j, -1)) if j > 0 else F.lit(0)
    return event & (F.coalesce(before, F.lit(0)) == 0)


def any_within(event: Column, h: int, by: list[str], order: str) -> Column:
    """Whether an event falls in the h windows from here."""
    return F.max(event.cast("int")).over(W.partitionBy(*by).orderBy(order).rowsBetween(0, h - 1)) == 1


def runs(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Runs of equal values: by, run, value, first, last, n."""
    w = W.partitionBy(*by).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    tagged = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1)
    return tagged.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def trailing(df: DataFrame, span: int, window: str = "window") -> DataFrame:
    """Each row once for every one of the span windows that its own is pooled into (trailing frames of whole windows)."""
    last = df.agg(F.max(window).alias("_last"))
    out = df.withColumn("_to", F.explode(F.sequence(F.col(window), F.col(window) + span - 1))).crossJoin(F.broadcast(last))
    return out.where((F.col("_to") <= F.col("_last")) & (F.col("_to") >= span - 1)).drop(window, "_last").withColumnRenamed("_to", window)
