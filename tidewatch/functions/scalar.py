"""Column expressions for scores, harm, review, schedules and budgets. All of them stay in generated code."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(c.isNotNull(), F.least(F.greatest(c, as_col(lo)), as_col(hi)))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def logit(p: Column) -> Column:
    q = clip(p, EPS, 1 - EPS)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def linear_score(features: list[Column], weights: list[float], intercept: float = 0.0) -> Column:
    return sum((c * float(w) for c, w in zip(features, weights, strict=True)), F.lit(float(intercept)))


def decide(p: Column, threshold: float | Column) -> Column:
    """1 where the score is at or above the threshold."""
    return (p >= threshold).cast("int")


def error(y: Column, decision: Column) -> Column:
    return (y != decision).cast("int")


def confidence(p: Column, decision: Column) -> Column:
    return F.when(decision == 1, p).otherwise(1 - p)


def severity(u: Column, y: Column, positive: tuple[float, ...], negative: tuple[float, ...]) -> Column:
    """Class 1 to 3 by the cumulated probabilities of the outcome's row."""

    def pick(p: tuple[float, ...]) -> Column:
        return F.when(u <= p[0], 1).when(u <= p[0] + p[1], 2).otherwise(3)

    return F.when(y == 1, pick(positive)).otherwise(pick(negative))


def harm_weight(sev: Column, y: Column, decision: Column, weights: tuple[float, ...], fn_factor: float) -> Column:
    base = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), sev)
    return base * F.when((y == 1) & (decision == 0), fn_factor).otherwise(1.0)


def recognition(decision: Column, p: Column, sev: Column, b0: float, b_conf: float, b_sev: float, bias: float | Column = 0.0) -> Column:
    """Probability that a reviewer recognises an error."""
    return (1 - bias) * sigmoid(b0 + b_conf * (1 - confidence(p, decision)) + b_sev * (sev - 1))


def in_time(deadline: float, median: float, sigma: float) -> float:
    """Share of lognormal latencies within a deadline."""
    if math.isinf(deadline):
        return 1.0
    return 0.5 * (1 + math.erf(math.log(deadline / median) / sigma / math.sqrt(2)))


def ramp_ratio(level: float | Column, progress: Column) -> Column:
    return 1 + progress * (level - 1)


def ramp_amount(level: float | Column, progress: Column) -> Column:
    return progress * level


def progress(shape: str, t: Column, s0: int | Column, ramp: int) -> Column:
    """Share of a change that is in place at monitored window t."""
    steps = clip((t - s0 + 1) / F.lit(float(ramp)), 0.0, 1.0)
    if shape == "abrupt":
        return (t >= s0).cast("double")
    if shape == "gradual":
        return steps
    if shape == "incremental":
        return F.ceil(3 * steps - 1e-9) / F.lit(3.0)
    raise ValueError(f"unknown shape {shape!r}")


def window_progress(shape: str, window: Column, n_baseline: int, s0: int, ramp: int) -> Column:
    """Progress by window number; 0 in the baseline."""
    if s0 < 0:
        raise ValueError("s0 must not be negative")
    return F.when(window < n_baseline, 0.0).otherwise(progress(shape, window - n_baseline, s0, ramp))


def reviewer_schedule(kind: str, level: float, p: Column, base: dict[str, float]) -> dict[str, Column]:
    """Reviewer parameters by window: one of them moves with progress, the others stay at their baseline."""
    out = {k: F.lit(float(base[k])) + p * 0 for k in ("bias", "coverage", "latency", "false_reject")}
    if kind == "bias":
        out["bias"] = base["bias"] + level * p
    elif kind == "coverage":
        out["coverage"] = base["coverage"] + (level - base["coverage"]) * p
    elif kind == "latency":
        out["latency"] = base["latency"] * ramp_ratio(level, p)
    elif kind == "false_reject":
        out["false_reject"] = base["false_reject"] + level * p
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return out


def workflow_schedule(kind: str, level: float, p: Column, base: dict[str, float]) -> dict[str, Column]:
    out = {"p_deliver": F.lit(base["p_deliver"]) + p * 0, "tat": F.lit(1.0) + p * 0, "dup": F.lit(1.0) + p * 0, "verify": F.lit(base["verify"]) + p * 0}
    if kind == "delivery":
        out["p_deliver"] = base["p_deliver"] * (1 - level * p)
    elif kind in ("tat", "dup"):
        out[kind] = ramp_ratio(level, p)
    elif kind == "verify":
        out["verify"] = F.greatest(F.lit(0.0), base["verify"] - level * p)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return out


def joint_schedule(kind: str, level: float, p: Column, reviewer: dict[str, float], workflow: dict[str, float]) -> dict[str, Column]:
    """Both layers: the named one moves, latency carries into turnaround and duplication into bias."""
    try:
        r = reviewer_schedule(kind, level, p, reviewer)
        w = workflow_schedule("tat", 1.0, p, workflow)
    except ValueError:
        r = reviewer_schedule("bias", 0.0, p, reviewer)
        w = workflow_schedule(kind, level, p, workflow)
    w["tat"] = w["tat"] * r["latency"] / reviewer["latency"]
    r["bias"] = r["bias"] + workflow.get("fatigue_bias", 0.0) * (1 - 1 / w["dup"])
    return r | w


def parse_level(text: Column) -> Column:
    """First number in a text; per cent become shares."""
    number = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    value = F.when(number != "", number.cast("double"))
    return F.when(F.contains(text, F.lit("pct")), value / 100).otherwise(value)


def format_level(old: str, value: float) -> str:
    """The old text with its first number replaced, at 3 significant digits."""
    import re

    return re.sub(r"-?\d+(?:\.\d+)?", f"{value:.3g}", old, count=1)


def window_days(cases_per_window: float, patients_per_week: float) -> float:
    if cases_per_window <= 0 or patients_per_week <= 0:
        raise ValueError("cases and patients must be positive")
    return cases_per_window / patients_per_week * 7


def false_alarm_budget(reviews_per_year: float, days: float, tools: float) -> float:
    """False alarms per 1,000 windows that a committee's reviews allow one of its tools."""
    if min(reviews_per_year, days, tools) <= 0:
        raise ValueError("all must be positive")
    return reviews_per_year / tools / (365.25 / days) * 1000


def implied_margin(excess: Column, base: Column, delta: float) -> Column:
    """Windows of delay that cost a share delta of baseline harm; infinite without excess."""
    return F.when(excess > 0, delta * base / excess).otherwise(F.lit(float("inf")))


def se_from_interval(lo: Column, hi: Column) -> Column:
    return (hi - lo) / (2 * NormalDist().inv_cdf(0.975))


def min_detectable(se: Column, alpha: float, power: float) -> Column:
    return (NormalDist().inv_cdf(1 - alpha) + NormalDist().inv_cdf(power)) * se


def chance_detection(budget_per_1000: float, horizon: float | Column) -> Column:
    """Chance of an alarm within a horizon at a false-alarm budget."""
    h = horizon if isinstance(horizon, Column) else F.lit(float(horizon))
    return 1 - F.exp(-budget_per_1000 * h / 1000)


def normalized(text: Column, keep: str = "a-z0-9 ") -> Column:
    """Lower case, only the characters in keep, single spaces."""
    plain = F.regexp_replace(F.lower(text), f"[^{keep}]", " " if " " in keep else "")
    return F.trim(F.regexp_replace(plain, " +", " "))


def markdown_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\s+", " "))


#: Fixed value: cells below this size are not shown.
LEAST_CELL = 10


def suppress_small(counts: list[str], least: int = LEAST_CELL) -> list[Column]:
    """Counts below the least become null; all of a row do if its first count, the cell's size, is below it."""
    size = F.col(counts[0])
    return [F.when((size >= least) & (F.col(c) >= least), F.col(c)).alias(c) for c in counts]
