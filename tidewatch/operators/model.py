"""Model fitting, models as rows, and solving for levels of a change."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators.layers import rescore
from tidewatch.operators.windows import quantiles


def _fit(df: DataFrame, features: list[str], label: str, reg: float) -> tuple[list[float], float]:
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(F.col(label).cast("double").alias("_y"), *features))
    m = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg, standardization=False, maxIter=100, tol=1e-9).fit(data)
    return [float(v) for v in m.coefficients], float(m.intercept)


def threshold_for(scored: DataFrame, label: str, sensitivity: float, p: str = "p") -> float:
    """Score that keeps a share of the positives: the exact linear quantile."""
    return quantiles(scored.where(F.col(label) == 1).select(p), {p: [1 - sensitivity]})[p][0]


def fit_plain(df: DataFrame, features: list[str], label: str = "y", sensitivity: float = 0.75) -> dict:
    """Unpenalized logistic model with a threshold for the sensitivity."""
    w, b = _fit(df, features, label, 0.0)
    wide = {f: (-1e300, 1e300) for f in features}
    model = {"features": features, "weights": dict(zip(features, w, strict=True)), "intercept": b, "bounds": wide, "means": dict.fromkeys(features, 0.0), "sds": dict.fromkeys(features, 1.0), "threshold": 0.5}
    return model | {"threshold": threshold_for(rescore(df, model), label, sensitivity)}


#: Fixed value: bounds of a probability in the log loss.
TINY = 1e-15


def _blocks(batches: Iterator[pd.DataFrame], features: list[str], label: str, coef: np.ndarray, folds: int, held: bool) -> Iterator[pd.DataFrame]:
    """Sums over a partition for every model: gradient and Hessian over the rows it learns from, or loss over those it does not.

    coef has a row for each penalty of each fold, and last for each penalty of all rows.
    """
    models, width = coef.shape
    fold_of = np.repeat(np.arange(folds + 1), models // (folds + 1))
    grad, hess, loss, rows = np.zeros((models, width)), np.zeros((models, width, width)), np.zeros(models), np.zeros(models)
    for pdf in batches:
        x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])
        y, fold = pdf[label].to_numpy(float)[:, None], pdf["_fold"].to_numpy()[:, None]
        p = 1 / (1 + np.exp(-np.clip(x @ coef.T, -700, 700)))
        if held:
            out = (fold == fold_of).astype(float)
            q = np.clip(p, TINY, 1 - TINY)
            loss += (out * -(y * np.log(q) + (1 - y) * np.log(1 - q))).sum(0)
            rows += out.sum(0)
            continue
        own = (fold != fold_of).astype(float)
        grad += ((y - p) * own).T @ x
        weight = p * (1 - p) * own
        for m in range(models):
            hess[m] += (x * weight[:, m : m + 1]).T @ x
    sums = np.concatenate([loss[:, None], rows[:, None]] if held else [grad, hess.reshape(models, -1)], 1)
    yield pd.DataFrame({"m": range(models), "sums": list(sums)})


def _summed(std: DataFrame, features: list[str], label: str, coef: np.ndarray, folds: int, held: bool) -> np.ndarray:
    """The sums of _blocks over all rows, a row for each model: one job. A partition sends one row for each model."""
    part = std.select(*features, label, "_fold").mapInPandas(lambda it: _blocks(it, features, label, coef, folds, held), "m int, sums array<double>")
    total = part.groupBy("m").applyInPandas(lambda pdf: pd.DataFrame({"m": [pdf["m"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_list()), 0)]}), "m int, sums array<double>")
    got = {r["m"]: r["sums"] for r in total.collect()}
    return np.array([got[m] for m in range(len(coef))])


def penalized_fits(std: DataFrame, features: list[str], label: str, grid: list[float], folds: int, tol: float = 1e-9, most: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Logistic models (intercept first) by Newton's method, for every penalty C of the grid, left out each fold and on all rows;
    and the mean log loss of the left-out rows by fold and penalty. All models move in the same passes, so the number of
    jobs is that of the slowest model's steps. Minimized: half the squared weights + C * the summed loss.
    """
    width, models = len(features) + 1, (folds + 1) * len(grid)
    coef, c = np.zeros((models, width)), np.tile(grid, folds + 1)
    ridge = np.diag([0.0] + [1.0] * (width - 1))
    for _ in range(most):
        sums = _summed(std, features, label, coef, folds, False)
        grad, hess = sums[:, :width], sums[:, width:].reshape(models, width, width)
        step = np.stack([np.linalg.lstsq(hess[m] + ridge / c[m], grad[m] - ridge @ coef[m] / c[m], rcond=None)[0] for m in range(models)])
        coef = coef + step
        if np.abs(step).max() < tol:
            break
    loss = _summed(std, features, label, coef, folds, True)[: folds * len(grid)]
    mean = np.divide(loss[:, 0], loss[:, 1], out=np.full(len(loss), np.nan), where=loss[:, 1] > 0)
    return coef.reshape(folds + 1, len(grid), width), mean.reshape(folds, len(grid))


def fit_real(df: DataFrame, features: list[str], label: str = "label", sensitivity: float = 0.75, folds: int = 5, grid: list[float] | None = None) -> dict:
    """Winsorize at 0.1 and 99.9 %, impute means, standardize (population sd), choose the penalty by fold log loss.

    A row's fold is a hash of its features and label, so recomputed rows stay in their folds.
    """
    plain = df.select(*(S.nan_to_null(F.col(f).cast("double")).alias(f) for f in features))
    bounds = {f: tuple(q) for f, q in quantiles(plain, {f: [0.001, 0.999] for f in features}).items()}
    cut = df.withColumns({f: S.clip(S.nan_to_null(F.col(f).cast("double")), *bounds[f]) for f in features})
    m = cut.agg(*(F.avg(f).alias(f) for f in features)).first()
    means = {f: float(m[f]) for f in features}
    full = cut.withColumns({f: F.coalesce(f, F.lit(means[f])) for f in features})
    s = full.agg(*(F.stddev_pop(f).alias(f) for f in features)).first()
    sds = {f: float(s[f]) or 1.0 for f in features}
    std = full.select(*((((F.col(f) - means[f]) / sds[f]).alias(f)) for f in features), F.col(label).cast("double").alias(label))
    std = std.withColumn("_fold", F.pmod(F.xxhash64(*features, label), F.lit(folds)).cast("int")).persist()
    grid = grid or [10 ** (-4 + 5 * k / 9) for k in range(10)]
    try:
        coef, loss = penalized_fits(std, features, label, grid, folds)
    finally:
        std.unpersist()
    best = int(np.argmin(np.nanmean(loss, 0)))
    b, *w = map(float, coef[-1, best])
    model = {"features": features, "weights": dict(zip(features, w, strict=True)), "intercept": b, "bounds": bounds, "means": means, "sds": sds, "threshold": 0.5, "C": grid[best]}
    return model | {"threshold": threshold_for(rescore(df, model), label, sensitivity)}


def versions(spark: SparkSession, models: dict[str, dict]) -> DataFrame:
    """Models as rows: version, intercept, threshold and, one for each feature in order, arrays of bounds, means, sds, weights."""
    rows = []
    for name, m in models.items():
        f = m["features"]
        rows.append((name, float(m["intercept"]), float(m["threshold"]), *([float(v) for v in x] for x in ([m["bounds"][c][0] for c in f], [m["bounds"][c][1] for c in f], [m["means"][c] for c in f], [m["sds"][c] for c in f], [m["weights"][c] for c in f]))))
    return spark.createDataFrame(rows, "version string, intercept double, threshold double, low array<double>, high array<double>, mean array<double>, sd array<double>, weight array<double>")


def score_versions(df: DataFrame, table: DataFrame, features: list[str], share: str = "share") -> DataFrame:
    """Adds p and decision to rows under the models that `table` names for them.

    table: version, version_to and share by the columns it has in common with df (window, say), with the arrays of both
    joined in by mix_versions(). One join by these keys; the score is a sum over the features of the row.
    """
    keys = [c for c in table.columns if c in df.columns]
    both = df.join(table, keys)
    terms = F.lit(0.0)
    for k, f in enumerate(features):
        x = F.coalesce(S.clip(S.nan_to_null(F.col(f).cast("double")), F.col("low")[k], F.col("high")[k]), F.col("mean")[k])
        terms = terms + F.col("weight")[k] * ((x - F.col("mean")[k]) / F.col("sd")[k])
    out = both.withColumn("p", S.sigmoid(F.col("intercept") + terms))
    out = out.withColumn("decision", (F.col("p") >= F.col("threshold")).cast("int"))
    return out.drop("intercept", "threshold", "low", "high", "mean", "sd", "weight", share, "version", "version_to")


def mix_versions(schedule: DataFrame, table: DataFrame, share: str = "share") -> DataFrame:
    """schedule (keys, version, version_to, share) with the coefficients of that mix: weights and intercept move from one
    version to the other by the share; bounds, means, sds and threshold are the first's."""
    to = table.select(F.col("version").alias("version_to"), F.col("intercept").alias("_i"), F.col("weight").alias("_w"))
    out = schedule.join(F.broadcast(table), "version").join(F.broadcast(to), "version_to")
    mixed = F.zip_with("weight", "_w", lambda a, b: (1 - F.col(share)) * a + F.col(share) * b)
    return out.withColumns({"weight": mixed, "intercept": (1 - F.col(share)) * F.col("intercept") + F.col(share) * F.col("_i")}).drop("_i", "_w")


def with_regression(model: dict, fraction: float, seed: int = 0) -> dict:
    """A copy whose weights are turned by a fraction towards a random direction at right angles, of equal norm."""
    if fraction <= 0:
        return dict(model)
    w = np.array([model["weights"][f] for f in model["features"]])
    r = np.random.default_rng(seed).normal(size=len(w))
    r -= (r @ w) / (w @ w) * w
    new = (1 - fraction) * w + fraction * np.linalg.norm(w) * r / np.linalg.norm(r)
    return model | {"weights": dict(zip(model["features"], map(float, new), strict=True))}


def solve_level(ratio_at: Callable[[list[float]], list[float]], target: float, lo: float, hi: float, tol: float = 1e-3, points: int = 9) -> dict:
    """Level whose harm ratio meets a target: a grid in one job, then the first bracket is halved.

    ratio_at takes a list of levels, so a grid is one job. Unattainable targets give the level of the best ratio.
    """
    grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
    got = ratio_at(grid)
    rising = all(b - a >= -0.02 for a, b in zip(got, got[1:], strict=False))
    at = next((k for k in range(points - 1) if (got[k] - target) * (got[k + 1] - target) <= 0), None)
    if at is None:
        best = max(range(points), key=lambda k: got[k]) if target > max(got) else min(range(points), key=lambda k: abs(got[k] - target))
        return {"level": grid[best], "ratio": got[best], "attained": False, "monotone": rising}
    a, b, fa = grid[at], grid[at + 1], got[at] - target
    while abs(b - a) > tol:
        mid = (a + b) / 2
        fm = ratio_at([mid])[0] - target
        if fa * fm <= 0:
            b = mid
        else:
            a, fa = mid, fm
    return {"level": (a + b) / 2, "ratio": ratio_at([(a + b) / 2])[0], "attained": True, "monotone": rising}


def ratios_for(population: DataFrame, harm: Callable[[DataFrame], DataFrame], change: Callable) -> Callable[[list[float]], list[float]]:
    """Harm at each level over harm unchanged, all levels in one job (a small cross with the stated levels)."""

    def at(levels: list[float]) -> list[float]:
        spark = population.sparkSession
        rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(levels)], "_k int, _level double")
        changed = change(population.crossJoin(F.broadcast(rows)), F.col("_level"))
        base = harm(population).agg(F.avg("harm")).first()[0]
        by = {r["_k"]: r["h"] for r in harm(changed).groupBy("_k").agg(F.avg("harm").alias("h")).collect()}
        return [by[k] / base for k in range(len(levels))]

    return at


def intercept_for(p: DataFrame, want: float, z: str = "z", tol: float = 1e-6) -> float:
    """Intercept that makes the mean of sigmoid(intercept + z) equal to want, by bisection on a persisted pool."""
    lo, hi = -20.0, 20.0
    while hi - lo > tol:
        mid = (lo + hi) / 2
        if p.agg(F.avg(S.sigmoid(F.col(z) + mid))).first()[0] < want:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


#: Stretches of the score axis in which pairs of held-out rows are counted on their own.
GAIN_STRETCHES = 64


def auroc_gain(base: DataFrame, full: DataFrame, n_boot: int = 500, seed: int = 1) -> DataFrame:
    """base, full: stream, t, y, p of held-out streams. Gain in AUROC with an interval from whole streams resampled.

    Under a draw a row weighs as often as its stream was drawn. Pairs of a positive above a negative are counted within
    stretches of the score, each in a group of its own for all draws at once, and across stretches from their sums.
    """
    ids = [r[0] for r in base.select("stream").distinct().orderBy("stream").collect()]
    n = len(ids)

    def times() -> np.ndarray:
        """Draws by streams; row 0 is the sample itself."""
        rng = np.random.default_rng(seed)
        out = np.ones((n_boot + 1, n))
        for k in range(1, n_boot + 1):
            out[k] = np.bincount(rng.integers(0, n, n), minlength=n)
        return out

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = times()
        own = pdf.sort_values("p")
        col = np.searchsorted(ids, own["stream"].to_numpy())
        y, p = own["y"].to_numpy(), own["p"].to_numpy()
        tie = np.flatnonzero(np.append(True, np.diff(p) != 0))
        rows = []
        for k in range(n_boot + 1):
            w = weight[k, col]
            pos, neg = np.add.reduceat(w * y, tie), np.add.reduceat(w * (1 - y), tie)
            below = np.cumsum(neg) - neg
            rows.append((k, pos.sum(), neg.sum(), float((pos * (below + neg / 2)).sum())))
        return pd.DataFrame(rows, columns=["draw", "pos", "neg", "inside"]).assign(score=pdf["score"].iloc[0], stretch=pdf["stretch"].iloc[0])

    both = base.select("stream", "y", "p", F.lit(0).alias("score")).union(full.select("stream", "y", "p", F.lit(1).alias("score")))
    both = both.withColumn("stretch", F.floor(S.clip(F.col("p"), 0.0, 1.0) * GAIN_STRETCHES).cast("int"))
    parts = both.groupBy("score", "stretch").applyInPandas(count, "draw int, pos double, neg double, inside double, score int, stretch int")
    w = W.partitionBy("score", "draw").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    pairs = parts.withColumn("_under", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    areas = pairs.groupBy("draw", "score").agg(F.try_divide(F.sum(F.col("inside") + F.col("pos") * F.col("_under")), F.sum("pos") * F.sum("neg")).alias("area"))
    gains = areas.groupBy("draw").agg(F.max(F.when(F.col("score") == 0, F.col("area"))).alias("auroc_base"), F.max(F.when(F.col("score") == 1, F.col("area"))).alias("auroc_full"))
    gains = gains.withColumn("gain", F.col("auroc_full") - F.col("auroc_base"))
    drawn, point = F.when(F.col("draw") > 0, F.col("gain")), lambda c: F.max(F.when(F.col("draw") == 0, F.col(c)))
    return gains.agg(
        point("auroc_base").alias("auroc_base"), point("auroc_full").alias("auroc_full"), point("gain").alias("gain"),
        F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"), F.avg((drawn <= 0).cast("double")).alias("p"),
    )


def union_cases(*parts: DataFrame) -> DataFrame:
    """Cases of several frames; where one lacks the scope flag its cases are in scope."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumn("out_of_scope", F.coalesce("out_of_scope", F.lit(0))) if "out_of_scope" in out.columns else out


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))
