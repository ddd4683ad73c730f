"""Resampling plans, bootstrap inference, multiplicity, audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.rng import uniform, uniform_array
from tidewatch.operators.windows import quantiles


def block_plan(spark: SparkSession, streams: int, n_out: int, n_real: int, block: int, salt: int = 1) -> DataFrame:
    """stream, out_window, src_window: blocks of contiguous windows with uniform starts, cut at n_out.

    The plan has a row for each window of each stream; case rows are reached by a join on src_window, or better, window
    sums are, so cases are not multiplied.
    """
    if not 1 <= block <= n_real or n_out < 1:
        raise ValueError("block must be between 1 and the real windows, n_out at least 1")
    per = -(-n_out // block)
    rows = spark.range(streams * n_out).select((F.col("id") / n_out).cast("long").alias("stream"), (F.col("id") % n_out).alias("out_window"))
    draw = F.col("stream") * per + F.floor(F.col("out_window") / block)
    start = F.floor(uniform(draw, salt) * (n_real - block + 1)).cast("long")
    return rows.withColumn("src_window", start + F.col("out_window") % block)


def resampled(table: DataFrame, plan: DataFrame, window: str = "window") -> DataFrame:
    """Rows of a window table as the plan's streams see them; window becomes out_window."""
    return plan.join(table.withColumnRenamed(window, "src_window"), "src_window").drop("src_window").withColumnRenamed("out_window", window)


#: Draws of one seed have numbers of their own; so do the replicates of one cell.
DRAWS, CELL = 100_000, 1 << 20


def resample(numbered: DataFrame, by: list[str], columns: list[str], seed: int, n_boot: int, offset: Column | None = None) -> DataFrame:
    """by, _draw and columns of n replicates drawn with replacement from the n of each group, for every draw.

    numbered has _i (0 to n - 1) and _n. Which replicate a place of a draw gets is a function of place and draw, so draws
    are joins and aggregations, recomputed tasks agree and any SQL engine can repeat them.
    """
    place = F.col("_i").cast("long") + (offset if offset is not None else F.lit(0))
    drawn = numbered.select(*by, "_n", place.alias("_place"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))).alias("_draw"))
    drawn = drawn.select(*by, "_draw", F.floor(uniform(F.col("_place"), F.col("_draw") + seed * DRAWS) * F.col("_n")).cast("int").alias("_i"))
    return drawn.join(numbered.select(*by, "_i", *columns), [*by, "_i"])


#: Values of a group that a task holds, draws that it sums, and picks made at once.
BLOCK, STRETCH, PICKS = 1 << 18, 100, 1 << 17


def picked_sums(held: np.ndarray, start: int, n: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """Sums over the n picks of each draw of the rows of held, which are values of the places from start on."""
    size, out = held.shape[1], np.zeros((len(held), len(draws)))
    held = np.append(held, np.zeros((len(held), 1)), axis=1)
    step = max(1, PICKS // n)
    for lo in range(0, len(draws), step):
        salt = draws[lo : lo + step, None] + seed * DRAWS
        for first in range(0, n, PICKS):
            pick = (uniform_array(np.arange(first, min(n, first + PICKS))[None], salt) * n).astype(np.int64) - start
            if size < n:
                pick[(pick < 0) | (pick >= size)] = size
            for values, total in zip(held, out, strict=True):
                total[lo : lo + step] += values[pick].sum(axis=1)
    return out


def draw_sums(numbered: DataFrame, by: list[str], columns: list[str], seed: int, n_boot: int, block: int = BLOCK) -> DataFrame:
    """by, _n, _draw and of each column its sum and number of values over the replicates of a draw, as resample() draws
    them; draw -1 is the replicates themselves.

    A group's values go packed, a block of places to a row, to a task for each stretch of draws. What a draw picks is a
    function of place and draw, so the task makes the picks itself and sums those in its block: no pick is listed, joined
    or sent. Every block of a group makes the picks anew, which is dearer than sending them only beyond about a hundred.
    """
    packed = numbered.groupBy(*by, "_n", F.floor(F.col("_i") / block).alias("_block")).agg(F.collect_list(F.struct("_i", *(F.col(c).cast("double").alias(c) for c in columns))).alias("_values"))
    dealt = packed.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(STRETCH))))
    # A stated number of partitions: rows are few and small for the work they stand for.
    dealt = dealt.repartition(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_block", "_first")
    names = [name for c in columns for name in (c, f"{c}_n")]
    schema = T.StructType([*(dealt.schema[c] for c in (*by, "_n")), T.StructField("_draw", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n, start, first = row.column("_n")[0].as_py(), row.column("_block")[0].as_py() * block, row.column("_first")[0].as_py()
                place, *values = row.column("_values")[0].values.flatten()
                at, held = place.to_numpy() - start, np.zeros((len(names), len(place)))
                for c, v in enumerate(values):
                    held[2 * c, at] = v.fill_null(0.0).to_numpy()
                    held[2 * c + 1, at] = v.is_valid().to_numpy(zero_copy_only=False)
                draws = np.arange(first, min(n_boot, first + STRETCH))
                sums = picked_sums(held, start, n, draws, seed)
                if first == 0:
                    draws, sums = np.append(draws, -1), np.append(sums, held.sum(axis=1, keepdims=True), axis=1)
                same = pa.array(np.zeros(len(draws), np.int64))
                yield pa.RecordBatch.from_arrays([*(row.column(c).take(same) for c in (*by, "_n")), pa.array(draws), *map(pa.array, sums)], names=[*by, "_n", "_draw", *names])

    return dealt.mapInArrow(run, schema).groupBy(*by, "_n", "_draw").agg(*(F.sum(c).alias(c) for c in names))


def bootstrap(pairs: DataFrame, by: list[str], seed: int = 1, n_boot: int = 2000, order: list[str] | None = None) -> DataFrame:
    """Per comparison (columns reference and candidate, paired): mean reduction with interval and two-sided p, and the
    reduction relative to the reference's mean with its interval. All come from the same draws.

    order: columns that tell a comparison's replicates apart. They are numbered in that order, a bounded number each.
    """
    w = W.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(*(order or ["reference", "candidate"]))) - 1
    gain = F.col("reference").cast("double") - F.col("candidate")
    own = pairs.select(*by, F.col("reference").cast("double").alias("_ref"), gain.alias("_gain"), rank.alias("_i"), F.count("*").over(w).alias("_n"))
    mean = lambda c: F.try_divide(c, f"{c}_n")
    draws = draw_sums(own, by, ["_ref", "_gain"], seed, n_boot).select(*by, "_n", "_draw", mean("_gain").alias("_m"), F.try_divide(mean("_gain"), mean("_ref")).alias("_rho"))
    point = lambda c: F.max(F.when(F.col("_draw") < 0, c))
    drawn = lambda c: F.when(F.col("_draw") >= 0, c)
    end = lambda c, q: F.percentile(drawn(F.col(c)), q)
    out = draws.groupBy(*by).agg(
        F.coalesce(F.max("_n"), F.lit(0)).alias("n"), point(F.col("_m")).alias("reduction"), end("_m", 0.025).alias("lo"), end("_m", 0.975).alias("hi"),
        F.avg(drawn((F.col("_m") <= 0).cast("double"))).alias("_s"), point(F.col("_rho")).alias("rho"), end("_rho", 0.025).alias("rho_lo"), end("_rho", 0.975).alias("rho_hi"),
    )
    p = F.least(F.lit(1.0), 2 * F.least(F.col("_s"), 1 - F.col("_s")))
    return out.select(*by, "n", "reduction", "lo", "hi", p.alias("p"), "rho", "rho_lo", "rho_hi")


def paired_with(values: DataFrame, arm: str, key: list[str], value: str, reference: str) -> DataFrame:
    """arm, key, reference, candidate for all arms but the reference: a frame for each replicate, no self-join."""
    of = F.max(F.when(F.col(arm) == reference, F.col(value))).over(W.partitionBy(*key))
    return values.select(arm, *key, of.alias("reference"), F.col(value).alias("candidate")).where((F.col(arm) != reference) & F.col("reference").isNotNull())


def reductions(values: DataFrame, arm: str, key: list[str], value: str, reference: str) -> DataFrame:
    """Per arm: replicates, difference of the mean delays, and that relative to the reference's mean delay."""
    n = paired_with(values, arm, key, value, reference).groupBy(arm).agg(F.count("*").alias("n"), F.avg("reference").alias("_r"), F.avg("candidate").alias("_c"))
    return n.select(arm, "n", (F.col("_r") - F.col("_c")).alias("reduction"), F.try_divide(F.col("_r") - F.col("_c"), F.col("_r")).alias("rho"))


def arm_reductions(values: DataFrame, arm: str, key: list[str], value: str, reference: str, seed: int = 1) -> DataFrame:
    """Per arm: bootstrap() of its delays against the reference's, paired by key."""
    return bootstrap(paired_with(values, arm, key, value, reference).select(arm, *key, "reference", "candidate"), [arm], seed, order=key)


def pooled_bootstrap(values: DataFrame, margin: float, seed: int = 1, n_boot: int = 2000, by: list[str] | None = None, order: str = "value") -> DataFrame:
    """Per by, over scenario, cell, value: mean of scenario means of cell means, interval, share of draws <= margin.

    A cell's replicates, a bounded number, are numbered by `order` and drawn within their cell; cells draw apart.
    """
    by = by or []
    group = [*by, "scenario", "cell"]
    cell = lambda c: F.col(c).cast("string").alias(c)
    own = values.select(*by, cell("scenario"), cell("cell"), F.col("value").cast("double").alias("value"), F.col(order).alias("_o")).where("value IS NOT NULL")
    w = W.partitionBy(*group)
    own = own.select(*group, "value", (F.row_number().over(w.orderBy("_o")) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    # One row a cell of a stated design.
    cells = own.select("scenario", "cell").distinct().withColumn("_cell", F.row_number().over(W.orderBy("scenario", "cell")))
    numbered = own.join(F.broadcast(cells), ["scenario", "cell"])
    draws = resample(numbered.select(*group, "_cell", "value", "_i", "_n"), [*group, "_cell"], ["value"], seed, n_boot, F.col("_cell") * CELL)
    means = lambda df, more: df.groupBy(*group, *more).agg(F.avg("value").alias("m")).groupBy(*by, "scenario", *more).agg(F.avg("m").alias("m")).groupBy(*by, *more).agg(F.avg("m").alias("m"))
    ends = means(draws, ["_draw"]).groupBy(*by).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.avg((F.col("m") <= margin).cast("double")).alias("p"))
    point = means(own, []).withColumnRenamed("m", "estimate")
    return point.join(ends, by) if by else point.crossJoin(F.broadcast(ends))


def pooled_mean(values: DataFrame, value: str = "value") -> DataFrame:
    """Mean over scenarios of the mean over cells of cell means."""
    cells = values.groupBy("scenario", "cell").agg(F.avg(value).alias("m"))
    return cells.groupBy("scenario").agg(F.avg("m").alias("m")).agg(F.avg("m").alias("pooled"))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Adds adjusted and reject. Missing p-values are left out of the family and stay missing."""
    by = by or []
    key = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    valid = F.when(ok, F.col(p))
    m = F.sum(ok.cast("int")).over(key)
    rank = F.row_number().over(key.orderBy(valid.asc_nulls_last(), "test"))
    out = tests.withColumn("_v", valid).withColumn("_m", m).withColumn("_r", rank)
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col("_v"))
    top = F.max(step).over((W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("adjusted", F.when(F.col("_v").isNotNull(), top))
    return out.withColumn("reject", F.coalesce(F.col("adjusted") <= alpha, F.lit(False))).drop("_v", "_m", "_r")


def pass_share(df: DataFrame, lower: str, margin: float) -> DataFrame:
    """Share of lower bounds at or over a margin; missing ones are ignored."""
    return df.agg(F.avg(F.when(F.col(lower).isNotNull() & ~F.isnan(lower), (F.col(lower) >= margin).cast("double"))).alias("share"))


def chunked_se(df: DataFrame, value: str, order: Column, chunks: int = 10) -> DataFrame:
    """Mean and standard error from the means of contiguous chunks; order is a number in [0, 1)."""
    part = df.groupBy(F.floor(order * chunks).alias("chunk")).agg(F.avg(value).alias("m"))
    return part.agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / chunks**0.5).alias("se"))


# --- audits ----------------------------------------------------------------------------------------------------------


def audit_weights(df: DataFrame, fraction: float, salt: int, stratified: bool) -> DataFrame:
    """Adds weight: 1 / inclusion probability for sampled cases, else 0. Strata are thirds of the confidence."""
    mult = F.lit(1.0)
    if stratified:
        lo, hi = quantiles(df, {"confidence": [1 / 3, 2 / 3]})["confidence"]
        mult = F.when(F.col("confidence") < lo, 3.0).when(F.col("confidence") < hi, 1.0).otherwise(0.5)
    df = df.withColumn("_m", mult)
    total = df.agg(F.sum("_m").alias("_sum"), F.count("*").alias("_n"))
    pi = F.least(F.lit(1.0), fraction * F.col("_n") * F.col("_m") / F.col("_sum"))
    out = df.crossJoin(F.broadcast(total)).withColumn("_pi", pi)
    return out.withColumn("weight", F.when(uniform(F.col("case_id"), salt) < F.col("_pi"), 1 / F.col("_pi")).otherwise(0.0)).drop("_m", "_sum", "_n", "_pi")


def ehor(df: DataFrame, discovery: float = 0.5) -> DataFrame:
    """Truth, Horvitz-Thompson estimate with its standard error, and the naive figure, as one row.

    Needs required (R), intercepted (I), reviewed, and weight.
    """
    return ehor_by(df, [], discovery)


def ehor_by(df: DataFrame, by: list[str], discovery: float = 0.5) -> DataFrame:
    """The same for each group. The squared gaps of the standard error are sums too, so one aggregation does it all:
    a case with weight w adds w(w - 1)(i - e)^2, which is e^2 for a missed and (1 - e)^2 for an intercepted one."""
    c, one = F.col, lambda x: F.sum(x.cast("int"))
    hit, miss = c("intercepted") & c("required"), ~c("intercepted") & c("required")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    weight = lambda x: F.sum(F.when(x, c("weight")).otherwise(0.0))
    spread = lambda x: F.sum(F.when(x & (c("weight") > 0), c("weight") * (c("weight") - 1)).otherwise(0.0))
    out = df.groupBy(*by).agg(
        ratio(one(hit), one(c("required"))).alias("ehor"),
        ratio(one(c("required") & c("reviewed")), one(c("required"))).alias("coverage"),
        ratio(one(hit), one(c("required") & c("reviewed"))).alias("detection"),
        ratio(weight(hit), weight(c("required"))).alias("ehor_ht"),
        ratio(one(hit).cast("double"), one(hit) + discovery * one(miss)).alias("naive"),
        spread(hit).alias("_hit"), spread(miss).alias("_miss"), weight(c("required")).alias("_n"),
    )
    e = c("ehor_ht")
    se = F.try_divide(F.sqrt(c("_hit") * (1 - e) * (1 - e) + c("_miss") * e * e), c("_n"))
    return out.withColumn("se", se).drop("_hit", "_miss", "_n")


def estimate_summary(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Mean truth; bias, root mean square error and coverage of ehor_ht; bias and error of the naive figure."""
    gap, far = F.col("ehor_ht") - F.col("ehor"), F.col("naive") - F.col("ehor")
    inside = F.coalesce(F.abs(gap) <= 1.96 * F.col("se"), F.lit(False)).cast("double")
    return estimates.groupBy(*by).agg(
        F.count("*").alias("replicates"), F.avg("ehor").alias("truth"), F.avg(gap).alias("bias"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(inside).alias("coverage"),
        F.avg(far).alias("naive_bias"), F.sqrt(F.avg(far * far)).alias("naive_rmse"),
    )
