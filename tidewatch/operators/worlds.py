"""Synthetic worlds and the changes that are made to them.

A case's draws are functions of its id, so the cases of a world are one projection of any table of ids. Changes whose
level is a relative loss of sensitivity need the slope of the outcome link that gives it; it is solved on the driver over
a fixed pool of cases, whose size does not depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.functions.rng import normal, uniform
from tidewatch.operators.cases import HARM

#: Fixed values of the baseline world: feature weights, separation of the classes, prevalence, subgroup.
WEIGHTS = (0.50, 0.40, 0.35, 0.30, 0.25, 0.20)
SEPARATION, PREVALENCE, SUBGROUP, SUBGROUP_SCALE = 1.19, 0.15, 0.10, 0.85
#: Fixed values of the changes: prevalence at most, shift of the compound change, loss outside the indication.
MOST_PREVALENT, COMPOUND_SHIFT, OUTSIDE_LOSS = 0.95, 0.5, 0.4
THRESHOLD = 0.15
POOL, POOL_SALT = 100_000, 5000
X = tuple(f"x{k + 1}" for k in range(len(WEIGHTS)))
LOG_ODDS = math.log(PREVALENCE / (1 - PREVALENCE))


def direction(g: int = 0) -> list[float]:
    """Difference of the class means by feature."""
    norm = math.sqrt(sum(w * w for w in WEIGHTS))
    return [SEPARATION * w / norm * (SUBGROUP_SCALE if g else 1.0) for w in WEIGHTS]


#: Mean of the first feature over the baseline world, which imputation puts in.
TRAIN_MEAN = (PREVALENCE - 0.5) * direction()[0] * (1 - SUBGROUP + SUBGROUP * SUBGROUP_SCALE)


def drawn(ids: DataFrame, prevalence: float | Column = PREVALENCE, salt: int = 1) -> DataFrame:
    """Cases of the baseline world for the ids: y, then g, then features around plus or minus half the direction."""
    i = F.col("case_id")
    df = ids.withColumns({"y": (uniform(i, salt) < prevalence).cast("int"), "g": (uniform(i, salt + 1) < SUBGROUP).cast("int")})
    side = F.when(F.col("y") == 1, 0.5).otherwise(-0.5)
    a, b = direction(0), direction(1)
    df = df.withColumns({x: side * F.when(F.col("g") == 1, b[k]).otherwise(a[k]) + normal(i, salt + 100 + k) for k, x in enumerate(X)})
    return with_severity(df, salt).withColumn("out_of_scope", F.lit(0))


def with_severity(df: DataFrame, salt: int = 1) -> DataFrame:
    return df.withColumn("severity", S.severity(uniform(F.col("case_id"), salt + 2), F.col("y"), HARM.positive, HARM.negative))


def link(scale_by_group: bool = True) -> Column:
    """The linear part of the true log-odds."""
    z = S.linear_score([F.col(x) for x in X], direction(0))
    return z * F.when(F.col("g") == 1, SUBGROUP_SCALE).otherwise(1.0) if scale_by_group else z


def x_first(df: DataFrame, slope: Column | float = 1.0, intercept: Column | float = LOG_ODDS, salt: int = 1) -> DataFrame:
    """Outcomes drawn anew from the features: sigmoid(intercept + slope * link), and severities by the new outcome."""
    y = uniform(F.col("case_id"), salt + 3) < S.sigmoid(intercept + slope * link())
    return with_severity(df.withColumn("y", y.cast("int")), salt)


def shifted(df: DataFrame, amount: Column | float) -> DataFrame:
    """Features moved along the direction, in units of one."""
    norm = math.sqrt(sum(d * d for d in direction()))
    return df.withColumns({x: F.col(x) + amount * (d / norm) for x, d in zip(X, direction(), strict=True)})


def scored(df: DataFrame, inputs: dict[str, Column] | None = None, weights: list[Column] | None = None) -> DataFrame:
    """p, reported_p, decision and error of the deployed score; inputs and weights may differ from the case's own."""
    own = inputs or {}
    terms = [own.get(x, F.col(x)) * w for x, w in zip(X, weights or [F.lit(d) for d in direction()], strict=True)]
    p = S.sigmoid(sum(terms, F.lit(LOG_ODDS)))
    df = df.withColumn("p", p).withColumn("reported_p", F.col("p")).withColumn("decision", S.decide(F.col("p"), THRESHOLD))
    return df.withColumn("error", S.error(F.col("y"), F.col("decision")))


# --- the fixed pool and what is solved on it -------------------------------------------------------------------------


@dataclass(frozen=True)
class Pool:
    """Link values, subgroup and alarms of the pool's cases."""

    z: np.ndarray
    g: np.ndarray
    flagged: np.ndarray

    def of(self, group: int | None) -> tuple[np.ndarray, np.ndarray]:
        own = slice(None) if group is None else self.g == group
        return self.z[own], self.flagged[own]

    def intercept(self, slope: float, group: int | None = None) -> float:
        """Intercept that keeps the mean outcome at the prevalence, by Newton's method (the mean rises with it)."""
        z, a = self.of(group)[0], LOG_ODDS
        for _ in range(50):
            mu = 1 / (1 + np.exp(-(a + slope * z)))
            step = (mu.mean() - PREVALENCE) / (mu * (1 - mu)).mean()
            a -= max(-2.0, min(2.0, step))
            if abs(step) < 1e-12:
                break
        return float(a)

    def sensitivity(self, slope: float, group: int | None = None) -> float:
        """Expected share of the outcomes that are flagged."""
        z, flagged = self.of(group)
        return float(np.average(flagged, weights=1 / (1 + np.exp(-(self.intercept(slope, group) + slope * z)))))

    def slope(self, loss: float, group: int | None = None) -> float:
        """Slope that leaves 1 - loss of the sensitivity at the prevalence. Two means of the outcome's probability are
        given, over all cases and over the flagged ones; Newton's method moves slope and intercept until both hold.
        Without a slope the flagged get their plain share, so ValueError for a loss that would need less."""
        if loss <= 0:
            return 1.0
        z, flagged = self.of(group)
        sides, by = np.stack([np.ones_like(z), flagged]) / len(z), np.stack([z, np.ones_like(z)])
        at = np.array([1.0, self.intercept(1.0, group)])
        want = sides @ (1 / (1 + np.exp(-(at @ by)))) * [1, 1 - loss]
        if want[1] <= PREVALENCE * flagged.mean():
            raise ValueError(f"sensitivity can't fall by {loss:.3f}: chance alone flags a share of {flagged.mean():.3f}")
        for _ in range(200):
            mu = 1 / (1 + np.exp(-(at @ by)))
            gap = sides @ mu - want
            if np.abs(gap).max() < 1e-14:
                break
            step = np.linalg.solve((sides * (mu * (1 - mu))) @ by.T, gap)
            at = at - step * min(1.0, 0.25 / np.abs(step).max())
        return float(at[0])


_POOL: list[Pool] = []


def pool(spark: SparkSession) -> Pool:
    """The pool of POOL cases; drawn once, as it is the same in every session."""
    if not _POOL:
        df = scored(drawn(spark.range(POOL).withColumnRenamed("id", "case_id"), salt=POOL_SALT))
        got = df.select(link().alias("z"), "g", "decision").orderBy("case_id").toPandas()
        _POOL.append(Pool(got["z"].to_numpy(), got["g"].to_numpy(), got["decision"].to_numpy(float)))
    return _POOL[0]


def drift(df: DataFrame, progress: Column, level: float, steps: tuple[float, ...], group: int | None = None) -> tuple[Column, Column]:
    """Slope and intercept of the outcome link by progress, of which `steps` are all values but 0."""
    known = pool(df.sparkSession)
    slope, at = F.lit(1.0), F.lit(LOG_ODDS)
    for v in steps:
        s = known.slope(level * v, group)
        near = F.abs(progress - v) < 1e-9
        slope, at = F.when(near, s).otherwise(slope), F.when(near, known.intercept(s, group)).otherwise(at)
    return slope, at


# --- changes ---------------------------------------------------------------------------------------------------------

#: (ids, progress, level, all values of progress but 0) to scored cases.
Change = Callable[[DataFrame, Column, float, tuple[float, ...]], DataFrame]
_REGISTRY: dict[str, Change] = {}


def register(name: str) -> Callable[[Change], Change]:
    def put(f: Change) -> Change:
        if name in _REGISTRY:
            raise ValueError(f"{name} is registered already")
        _REGISTRY[name] = f
        return f

    return put


def change(name: str) -> Change:
    if name not in _REGISTRY:
        raise KeyError(name)
    return _REGISTRY[name]


def registered() -> list[str]:
    return sorted(_REGISTRY)


@register("none")
def _none(ids, progress, level, steps):
    return scored(drawn(ids))


@register("covariate_mean_shift")
def _shift(ids, progress, level, steps):
    """Features move along the direction; outcomes follow the true posterior, so only P(x) changes."""
    return scored(x_first(shifted(drawn(ids), S.ramp_amount(level, progress))))


@register("class_prior_shift")
def _prior(ids, progress, level, steps):
    """Prevalence is multiplied, the features given the outcome stay."""
    return scored(drawn(ids, F.least(F.lit(MOST_PREVALENT), PREVALENCE * S.ramp_ratio(level, progress))))


@register("slope_and_intercept_drift")
def _slope(ids, progress, level, steps, mode="output_transform"):
    """The level is the calibration slope. output_transform: the reported score's log-odds are divided by it, decisions
    stay; outcome_link: the outcome follows the score with that slope, at the same prevalence."""
    slope = S.ramp_ratio(level, progress)
    if mode == "output_transform":
        return scored(drawn(ids)).withColumn("reported_p", S.sigmoid(S.logit(F.col("p")) / slope))
    if mode != "outcome_link":
        raise ValueError(f"unknown mode {mode!r}")
    known, at = pool(ids.sparkSession), F.lit(LOG_ODDS)
    for v in steps:
        at = F.when(F.abs(progress - v) < 1e-9, known.intercept(1 + v * (level - 1))).otherwise(at)
    return scored(x_first(drawn(ids), slope, at))


@register("shrink_scores_to_base_rate_recalibrated")
def _shrink(ids, progress, level, steps):
    """Scores shrink to the prevalence, and outcomes and severities are drawn from the shrunk scores."""
    share = S.ramp_amount(level, progress)
    out = scored(drawn(ids))
    out = out.withColumn("reported_p", (1 - share) * F.col("p") + share * PREVALENCE)
    out = out.withColumn("y", (uniform(F.col("case_id"), 302) < F.col("reported_p")).cast("int"))
    out = with_severity(out).withColumn("decision", S.decide(F.col("reported_p"), THRESHOLD))
    return out.withColumn("error", S.error(F.col("y"), F.col("decision")))


@register("mcar_missingness")
def _mcar(ids, progress, level, steps):
    """The first input is missing at random and gets the training mean; the case itself stays."""
    gone = uniform(F.col("case_id"), 303) < S.ramp_amount(level, progress)
    return scored(drawn(ids), {"x1": F.when(gone, TRAIN_MEAN).otherwise(F.col("x1"))})


@register("variable_rescale")
def _rescale(ids, progress, level, steps):
    return scored(drawn(ids), {"x1": F.col("x1") * S.ramp_ratio(level, progress)})


@register("outcome_model_change")
def _concept(ids, progress, level, steps):
    """The outcome depends less on the features; the level is the relative loss of sensitivity, prevalence held."""
    return scored(x_first(drawn(ids), *drift(ids, progress, level, steps)))


@register("subgroup_outcome_model_change")
def _concept_sub(ids, progress, level, steps):
    slope, at = drift(ids, progress, level, steps, 1)
    sub = F.col("g") == 1
    return scored(x_first(drawn(ids), F.when(sub, slope).otherwise(1.0), F.when(sub, at).otherwise(LOG_ODDS)))


@register("version_swap_with_regression")
def _version(ids, progress, level, steps):
    """A share of the weights is replaced by a direction at right angles to them, of equal length."""
    d = direction()
    other = [(-1) ** k * d[k ^ 1] for k in range(len(d))]
    share = S.ramp_amount(level, progress)
    return scored(drawn(ids), weights=[(1 - share) * a + share * b for a, b in zip(d, other, strict=True)])


@register("covariate_and_concept_drift")
def _both(ids, progress, level, steps):
    return scored(x_first(shifted(drawn(ids), progress * COMPOUND_SHIFT), *drift(ids, progress, level, steps)))


@register("out_of_scope_use_share")
def _scope(ids, progress, level, steps):
    """A share of cases is of the compound change's world, flagged; the others are of the baseline world."""
    outside = uniform(F.col("case_id"), 306) < F.least(F.lit(1.0), S.ramp_amount(level, progress))
    base = drawn(ids).withColumn("out_of_scope", outside.cast("int"))
    own = F.col("out_of_scope") == 1
    slope = pool(ids.sparkSession).slope(OUTSIDE_LOSS)
    moved = x_first(shifted(base, F.when(own, COMPOUND_SHIFT).otherwise(0.0)).withColumn("_y", F.col("y")), slope, pool(ids.sparkSession).intercept(slope))
    kept = with_severity(moved.withColumn("y", F.when(own, F.col("y")).otherwise(F.col("_y"))).drop("_y"))
    return scored(kept)


def world_summary(cases: DataFrame, by: list[str]) -> DataFrame:
    """Prevalence, mean reported score, sensitivity, error rate, severity and scope share of groups of cases."""
    y, d = F.col("y"), F.col("decision")
    return cases.groupBy(*by).agg(
        F.avg(y.cast("double")).alias("prevalence"), F.avg("reported_p").alias("mean_p"), F.try_divide(F.sum(y * d).cast("double"), F.sum(y).cast("double")).alias("sensitivity"),
        F.avg(F.col("error").cast("double")).alias("error_rate"), F.avg(F.col("severity").cast("double")).alias("mean_severity"), F.avg(F.col("out_of_scope").cast("double")).alias("scope_share"),
    )
