"""Per-window indicators: performance, calibration, input drift, oversight and workflow."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S

#: Direction (+1: an increase is bad), and the indicators that wait for labels.
DIRECTION = {
    "P1": -1, "P2": -1, "P3": -1, "P4": -1, "P5": 1, "P6": 1, "U1": 1, "U2": 1, "U3": 1, "U4": 1, "U5": 1, "C2": 1, "C3": -1,
    "H1": -1, "H2": -1, "H2u": 1, "H3": -1, "H4": 1, "H5": -1, "H6": 1, "H7": -1,
    "O1": -1, "O2": 1, "O3": 1, "O3a": -1, "O4": 1, "O5": 1, "O6": 1, "U1r": 1, "U2r": 1, "U3r": 1,
}
LAGGED = ("P1", "P2", "P3", "P4", "P5", "P6", "U1", "U2", "U3", "U4", "H3", "H4", "H5", "O5", "O6", "U1r", "U2r", "U3r")
MODEL = ("P1", "P2", "P3", "P4", "P5", "P6", "U1", "U2", "U3", "U4", "U5", "C2", "C3")
COMPONENT = {n: "O" if n[0] == "O" else n[0] for n in DIRECTION}
HIGH_CONFIDENCE, BINS = 0.9, 15
#: Stretches of the score axis whose cumulative counts are taken on their own.
KS_STRETCHES = 4096


def ratio(num: Column, den: Column) -> Column:
    """Null without a denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_columns() -> list[Column]:
    """The indicators that are sums over one window's own cases."""
    y, d, e, g, p = (F.col(c) for c in ("y", "decision", "error", "g", "p"))
    high = (F.col("confidence") >= HIGH_CONFIDENCE).cast("int")
    return [
        ratio(F.sum(y * d), F.sum(y)).alias("P1"),
        ratio(F.sum((1 - y) * (1 - d)), F.sum(1 - y)).alias("P2"),
        ratio(F.sum(y * d), F.sum(d)).alias("P3"),
        (1000 * F.avg(F.col("w") * e)).alias("P5"),
        F.abs(ratio(F.sum(e * g), F.sum(g)) - ratio(F.sum(e * (1 - g)), F.sum(1 - g))).alias("P6"),
        F.avg((p - y) * (p - y)).alias("U2"),
        ratio(F.sum(e * high), F.sum(high)).alias("U4"),
        (1 - F.avg(F.col("out_of_scope").cast("double"))).alias("C3"),
    ]


def model_ratios(df: DataFrame, by: list[str]) -> DataFrame:
    """The ratio indicators of each window: one hash aggregation."""
    return df.groupBy(*by).agg(*ratio_columns())


def window_table(df: DataFrame, by: list[str], features: tuple[str, ...] = (), extra: list[Column] | None = None) -> DataFrame:
    """All indicators that need a window's own cases only, its size (_n) and feature sums (_f1 ..): one exchange.

    Midranks and calibration bins are taken in the frames of the window's cases, so a single aggregation ends it.
    """
    w = W.partitionBy(*by)
    rank = F.rank().over(w.orderBy("p")) + (F.count("*").over(W.partitionBy(*by, "p")) - 1) / 2
    b = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1))
    y = F.col("y")
    n1, n0 = F.sum(y), F.sum(1 - y)
    gaps = [F.abs(F.coalesce(F.sum(F.when(F.col("_b") == k, y - F.col("p"))), F.lit(0.0))) for k in range(BINS)]
    return df.withColumns({"_r": rank, "_b": b}).groupBy(*by).agg(
        *ratio_columns(), ratio(F.sum(F.col("_r") * y) - n1 * (n1 + 1) / 2, n1 * n0).alias("P4"),
        (reduce(lambda a, c: a + c, gaps) / F.count("*")).alias("U1"), F.count("*").alias("_n"), *(F.sum(f).alias(f"_{f}") for f in features), *(extra or []),
    )


def auroc(df: DataFrame, by: list[str], y: str = "y", score: str = "p", name: str = "P4") -> DataFrame:
    """Mann and Whitney's statistic from midranks; null if a class is empty."""
    w = W.partitionBy(*by)
    rank = F.rank().over(w.orderBy(score)) + (F.count("*").over(w.partitionBy(*by, score)) - 1) / 2
    ranked = df.select(*by, y, rank.alias("_r"))
    n1, n0 = F.sum(y), F.sum(1 - F.col(y))
    return ranked.groupBy(*by).agg(ratio(F.sum(F.col("_r") * F.col(y)) - n1 * (n1 + 1) / 2, n1 * n0).alias(name))


def auroc_of_large(df: DataFrame, by: list[str], y: str = "y", score: str = "p", name: str = "P4") -> DataFrame:
    """The same for groups of any size: pairs are counted by distinct score, in stretches of the score with carried counts,
    so no task sorts a group. Scores lie in 0 to 1."""
    stretch = F.floor(S.clip(F.col(score), 0.0, 1.0) * KS_STRETCHES).cast("int")
    pos, neg = F.sum(F.col(y)).alias("_pos"), F.sum(1 - F.col(y)).alias("_neg")
    values = df.groupBy(*by, score).agg(pos, neg).withColumn("_k", stretch)
    along = W.partitionBy(*by).orderBy("_k")
    sums = values.groupBy(*by, "_k").agg(F.sum("_neg").alias("_s"))
    carried = sums.select(*by, "_k", (F.sum("_s").over(along) - F.col("_s")).alias("_before"))
    own = F.coalesce(F.sum("_neg").over(W.partitionBy(*by, "_k").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pairs = values.withColumn("_own", own).join(carried, [*by, "_k"])
    wins = F.sum(F.col("_pos") * (F.col("_before") + F.col("_own") + F.col("_neg") / 2))
    return pairs.groupBy(*by).agg(ratio(wins, F.sum("_pos") * F.sum("_neg")).alias(name))


def ece(df: DataFrame, by: list[str], name: str = "U1", bins: int = BINS) -> DataFrame:
    """Expected calibration error: bins first, then windows."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    parts = df.groupBy(*by, b.alias("_b")).agg(F.sum(F.col("y") - F.col("p")).alias("_d"), F.count("*").alias("_n"))
    return parts.groupBy(*by).agg((F.sum(F.abs("_d")) / F.sum("_n")).alias(name))


def baseline_cdf(df: DataFrame, baseline: Column, stream: list[str]) -> DataFrame:
    """stream, p, _f: the share of the stream's baseline scores up to each score that occurs in it.

    The running sum is taken in stretches of the score, 1/KS_STRETCHES wide, each on its own; the stretches' totals, at
    most KS_STRETCHES rows a stream, carry over.
    """
    stretch = F.floor(S.clip(F.col("p"), 0.0, 1.0) * KS_STRETCHES).cast("int")
    in_base = F.sum(F.when(baseline, 1).otherwise(0))
    values = df.groupBy(*stream, "p").agg(in_base.alias("_n")).withColumn("_k", stretch)
    along = W.partitionBy(*stream).orderBy("_k")
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = values.groupBy(*stream, "_k").agg(F.sum("_n").alias("_s"))
    carried = sums.select(*stream, "_k", (F.sum("_s").over(along) - F.col("_s")).alias("_before"), F.sum("_s").over(whole).alias("_total"))
    own = F.sum("_n").over(W.partitionBy(*stream, "_k").orderBy("p"))
    return values.join(carried, [*stream, "_k"]).select(*stream, "p", ((F.col("_before") + own) / F.col("_total")).alias("_f"))


def ks_to_baseline(df: DataFrame, by: list[str], baseline: Column, stream: list[str], name: str = "U5") -> DataFrame:
    """Largest distance between a window's scores and the pooled baseline scores of its stream.

    Scores meet the baseline's distribution by a join on the value, so no window is compared with every baseline row.
    """
    own = W.partitionBy(*by)
    i, m = F.row_number().over(own.orderBy("p")), F.count("*").over(own)
    far = df.join(baseline_cdf(df, baseline, stream), [*stream, "p"]).select(*by, F.greatest(F.abs(i / m - F.col("_f")), F.abs((i - 1) / m - F.col("_f"))).alias("_d"))
    return far.groupBy(*by).agg(F.max("_d").alias(name))


def mean_shift(df: DataFrame, by: list[str], features: tuple[str, ...], baseline: Column, stream: list[str], name: str = "C2") -> DataFrame:
    """Cases in the window times the squared distance of its feature means from the baseline's."""
    sums = df.groupBy(*by).agg(F.count("*").alias("_n"), *(F.sum(f).alias(f"_{f}") for f in features))
    return shift_of_sums(sums, features, baseline, stream, name).select(*by, name)


def shift_of_sums(sums: DataFrame, features: tuple[str, ...], baseline: Column, stream: list[str], name: str = "C2") -> DataFrame:
    """The same from a window table with _n and the features' sums; a stream's baseline sums are one row."""
    base = sums.where(baseline).groupBy(*stream).agg(F.sum("_n").alias("_bn"), *(F.sum(f"_{f}").alias(f"_b{f}") for f in features))
    both = sums.join(base, stream) if stream else sums.crossJoin(F.broadcast(base))
    gap = [F.col(f"_{f}") / F.col("_n") - F.col(f"_b{f}") / F.col("_bn") for f in features]
    return both.withColumn(name, F.col("_n") * reduce(lambda a, b: a + b, (g * g for g in gap))).drop("_bn", *(f"_b{f}" for f in features))


def newton_slope(y: np.ndarray, p: np.ndarray, iterations: int = 30) -> tuple[float, float]:
    """Intercept and slope of a logistic recalibration; always all iterations."""
    q = np.clip(p, S.EPS, 1 - S.EPS)
    z = np.log(q / (1 - q))
    b = np.array([0.0, 1.0])
    for _ in range(iterations):
        mu = 1 / (1 + np.exp(-np.clip(b[0] + b[1] * z, -700, 700)))
        w = mu * (1 - mu) + S.EPS
        grad = np.array([(y - mu).sum(), (z * (y - mu)).sum()])
        h00, h01, h11 = w.sum(), (w * z).sum(), (w * z * z).sum()
        det = h00 * h11 - h01 * h01
        det = det if abs(det) >= 1e-12 else 1e-12
        b = b + np.array([h11 * grad[0] - h01 * grad[1], h00 * grad[1] - h01 * grad[0]]) / det
    return float(b[0]), float(b[1])


def slope_deviation(df: DataFrame, by: list[str], name: str = "U3", iterations: int = 30) -> DataFrame:
    """|calibration slope - 1| of each group by Newton's method, as a fold over the steps and, in each, over the group's
    scores: a window has a fixed number of cases, so its list is bounded."""
    q = S.clip(F.col("p"), S.EPS, 1 - S.EPS)
    listed = df.groupBy(*by).agg(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.log(q / (1 - q)).alias("z"))).alias("_l"))
    sums = ("g0", "g1", "h00", "h01", "h11")
    none = F.struct(*(F.lit(0.0).alias(c) for c in sums))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - a value that is used more than once

    def add(b, a, x):
        mu = 1 / (1 + F.exp(-S.clip(b["b0"] + b["b1"] * x["z"], -700.0, 700.0)))
        terms = lambda m: (x["y"] - m["mu"], x["z"] * (x["y"] - m["mu"]), m["w"], m["w"] * x["z"], m["w"] * x["z"] * x["z"])
        weighed = once(mu, lambda m: F.struct(m.alias("mu"), (m * (1 - m) + S.EPS).alias("w")))
        return once(weighed, lambda m: F.struct(*((a[c] + t).alias(c) for c, t in zip(sums, terms(m), strict=True))))

    def newton(b, _):
        def move(s):
            det = s["h00"] * s["h11"] - s["h01"] * s["h01"]
            det = F.when(F.abs(det) >= 1e-12, det).otherwise(1e-12)
            return F.struct(
                (b["b0"] + (s["h11"] * s["g0"] - s["h01"] * s["g1"]) / det).alias("b0"), (b["b1"] + (s["h00"] * s["g1"] - s["h01"] * s["g0"]) / det).alias("b1")
            )

        return once(F.aggregate("_l", none, lambda a, x: add(b, a, x)), move)

    start = F.struct(F.lit(0.0).alias("b0"), F.lit(1.0).alias("b1"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, newton)
    return listed.select(*by, F.abs(solved["b1"] - 1).alias(name))


def model_indicators(df: DataFrame, n_baseline: int, features: tuple[str, ...], slope: bool = True, stream: tuple[str, ...] = ()) -> DataFrame:
    """Wide table of all model indicators, a row per window: one pass by window, and the join by value that U5 needs."""
    by, base = [*stream, "window"], F.col("window") < n_baseline
    out = shift_of_sums(window_table(df, by, features), features, base, list(stream))
    out = out.join(ks_to_baseline(df, by, base, list(stream)), by)
    out = out.join(slope_deviation(df, by), by) if slope else out
    return out.select(*by, *(c for c in MODEL if c in out.columns))


def long_form(wide: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    return wide.unpivot(by, names, "indicator", "x")


def direction_of(indicator: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in DIRECTION.items() for x in (k, v))), indicator)


def oversight(df: DataFrame, by: list[str]) -> DataFrame:
    """H1 to H6 from booleans examined, recognized, wrong, error, required, in_time, audited and the latency."""
    n = lambda *c: F.sum(reduce(lambda a, b: a & b, (F.col(x) for x in c)).cast("int"))
    over = F.sum((F.col("recognized") | F.col("wrong")).cast("int"))
    return df.groupBy(*by).agg(
        ratio(n("examined"), F.count("*")).alias("H1"),
        ratio(over, n("examined")).alias("H2"),
        ratio(n("recognized"), over).alias("H3"),
        (1 - ratio(n("recognized"), n("examined", "is_error"))).alias("H4"),
        ratio(n("audited", "required", "in_time", "recognized"), n("audited", "required")).alias("H5"),
        F.percentile(F.when(F.col("examined"), F.col("latency")), 0.5).alias("H6"),
    )


def workflow(df: DataFrame, by: list[str]) -> DataFrame:
    """H7 and O1 to O6 from initiated, required, delivered, late, completed, alerts, actioned, tat, downstream, sentinel."""
    n = lambda c: F.sum(c.cast("int"))
    c = F.col
    return df.groupBy(*by).agg(
        ratio(n(c("delivered")), n(c("required"))).alias("H7"),
        ratio(n(c("completed")), n(c("initiated"))).alias("O1"),
        ratio(n(c("required") & (~c("delivered") | c("late"))), n(c("required"))).alias("O2"),
        ratio(F.sum("alerts"), F.count("*")).alias("O3"),
        ratio(F.sum("actioned"), F.sum("alerts")).alias("O3a"),
        F.percentile("tat", 0.95).alias("O4"),
        ratio(n(c("downstream")), F.count("*")).alias("O5"),
        ratio(n(c("sentinel")), F.count("*")).alias("O6"),
    )
