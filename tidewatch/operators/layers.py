"""Review and workflow layers drawn over a case stream, and changes of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.functions.rng import normal, poisson, poisson_most, uniform
from tidewatch.operators.cases import HARM, REVIEWER, WORKFLOW, Harm, Reviewer, Workflow


def review(df: DataFrame, r: Reviewer = REVIEWER, h: Harm = HARM, salt: int = 30, audit: float = 0.2, ident: str = "case_id") -> DataFrame:
    """Adds examined, recognized, wrong, is_error, required, in_time, audited, latency, reviewed and intercepted."""
    i = F.col(ident)
    seen = S.recognition(F.col("decision"), F.col("p"), F.col("severity"), r.beta0, r.beta_confidence, r.beta_severity, r.bias)
    out = df.withColumns(
        {
            "examined": uniform(i, salt) < r.coverage,
            "is_error": F.col("error") == 1,
            "latency": r.latency * F.exp(r.latency_sigma * normal(i, salt + 1)),
            "audited": uniform(i, salt + 2) < audit,
        }
    )
    out = out.withColumns(
        {
            "recognized": F.col("examined") & F.col("is_error") & (uniform(i, salt + 3) < seen),
            "wrong": F.col("examined") & ~F.col("is_error") & (uniform(i, salt + 4) < r.false_reject),
            "required": F.col("is_error") & (F.col("severity") >= h.cutoff),
            "in_time": F.lit(True) if math.isinf(r.deadline) else F.col("latency") <= r.deadline,
        }
    )
    return out.withColumns({"reviewed": F.col("examined"), "intercepted": F.col("recognized") & F.col("in_time")})


def workflow(df: DataFrame, f: Workflow = WORKFLOW, dup: float = 1.0, salt: int = 50, ident: str = "case_id") -> DataFrame:
    """Adds initiated, required, delivered, late, completed, alerts, actioned, tat, downstream and sentinel. Needs review()."""
    i = F.col(ident)
    fires = F.col("decision") == 1
    needs = fires & (F.col("y") == 1)
    out = df.withColumns(
        {
            "initiated": fires,
            "required": needs,
            "delivered": needs & (uniform(i, salt) < f.p_deliver),
            "tat": f.tat_median * F.exp(f.tat_sigma * normal(i, salt + 1)),
            "alerts": F.when(fires, 1 + (poisson(uniform(i, salt + 2), F.lit(dup - 1.0), dup - 1) if dup > 1 else F.lit(0))).otherwise(0),
        }
    )
    rate = f.action_base / (1 + f.fatigue * (dup - 1))
    out = out.withColumns(
        {
            "late": F.col("delivered") & (F.col("tat") > f.tat_limit),
            "completed": fires & (uniform(i, salt + 3) < F.when(needs & ~F.col("delivered"), f.completion * f.abandon).otherwise(f.completion)),
            # each message on its own: one uniform for each possible message
            "actioned": sum(((F.col("alerts") > k) & (uniform(i, salt + 10 + k) < rate)).cast("int") for k in range(1 + poisson_most(dup - 1) if dup > 1 else 1)),
            "downstream": F.col("is_error") & ~F.col("intercepted") & (uniform(i, salt + 4) >= f.verify),
        }
    )
    return out.withColumn("sentinel", F.col("downstream") & (F.col("severity") >= f.sentinel))


# --- failures of reviewers and workflow inside streams ------------------------------------------------------------------


def failing(rows: DataFrame, progress: Column, r: Reviewer = REVIEWER, f: Workflow = WORKFLOW) -> DataFrame:
    """Adds every reviewer and workflow parameter of a row whose columns kind and level name the failure.

    Kinds: bias, coverage, latency, false_reject of reviewers; delivery, tat, dup, verify of the workflow. A slower review
    lengthens the turnaround, and duplicated alerts make reviewers accept more (by fatigue_bias).
    """
    level = F.col("level")
    moved = lambda kind, at, base: F.when(F.col("kind") == kind, at).otherwise(F.lit(float(base)))
    ramp = 1 + progress * (level - 1)
    out = rows.withColumns(
        {
            "coverage": moved("coverage", r.coverage + (level - r.coverage) * progress, r.coverage),
            "false_reject": moved("false_reject", r.false_reject + level * progress, r.false_reject),
            "latency": moved("latency", r.latency * ramp, r.latency),
            "p_deliver": moved("delivery", f.p_deliver * (1 - level * progress), f.p_deliver),
            "dup": moved("dup", ramp, 1.0),
            "verify": moved("verify", F.greatest(F.lit(0.0), f.verify - level * progress), f.verify),
            "bias": moved("bias", r.bias + level * progress, r.bias),
        }
    )
    return out.withColumns(
        {"tat_mult": moved("tat", ramp, 1.0) * F.col("latency") / r.latency, "bias": F.col("bias") + f.fatigue_bias * (1 - 1 / F.col("dup"))}
    )


def workflow_under(df: DataFrame, ident: Column, most_dup: float, f: Workflow = WORKFLOW, h: Harm = HARM, salt: int = 470) -> DataFrame:
    """workflow() under each row's own parameters: columns p_deliver, tat_mult, dup and verify. Needs review_under().

    An alert on a severe case requires escalation. most_dup is the greatest duplication in the table.
    """
    c, most = F.col, most_dup - 1
    fires = c("decision") == 1
    out = df.withColumns(
        {
            "initiated": fires,
            "required": fires & (c("severity") >= h.cutoff),
            "tat": f.tat_median * c("tat_mult") * F.exp(f.tat_sigma * normal(ident, salt + 1)),
            "alerts": F.when(fires, 1 + poisson(uniform(ident, salt + 2), c("dup") - 1, most)).otherwise(0),
            "_rate": f.action_base / (1 + f.fatigue * (c("dup") - 1)),
        }
    )
    out = out.withColumn("delivered", c("required") & (uniform(ident, salt) < c("p_deliver")))
    done = F.when(c("required") & ~c("delivered"), f.completion * f.abandon).otherwise(f.completion)
    return out.withColumns(
        {
            "late": c("delivered") & (c("tat") > f.tat_limit),
            "completed": fires & (uniform(ident, salt + 3) < done),
            # Each message on its own: one uniform for each.
            "actioned": F.when(fires, F.size(F.filter(F.sequence(F.lit(0), c("alerts") - 1), lambda k: uniform(ident, salt + 10 + k.cast("long")) < c("_rate")))).otherwise(0),
            "downstream": c("is_error") & ~c("intercepted") & (uniform(ident, salt + 4) >= c("verify")),
        }
    ).withColumn("sentinel", c("downstream") & (c("severity") >= f.sentinel)).drop("_rate")


# --- mixtures of reviewer failures -----------------------------------------------------------------------------------


def failed(kind: str, level: float, base: dict[str, float]) -> float:
    """The reviewer parameter `kind` under a failure in full effect."""
    return {"bias": base["bias"] + level, "coverage": level, "false_reject": base["false_reject"] + level, "latency": base["latency"] * level}[kind]


def mixture_schedule(spark: SparkSession, n: int, n_out: int, n_baseline: int, kinds: dict[str, tuple[float, ...]], low: int, high: int, r: Reviewer = REVIEWER, salt: int = 400) -> DataFrame:
    """stream, window and reviewer parameters: one or two failures of different kinds, of a drawn level, from a drawn
    monitored window in low..high on. Draws are functions of the stream."""
    s, names = F.col("stream"), list(kinds)
    base = {"bias": r.bias, "coverage": r.coverage, "false_reject": r.false_reject, "latency": r.latency}
    pick = lambda k, m: F.floor(uniform(s, salt + k) * m).cast("int")
    rows = spark.range(n * n_out).select((F.col("id") / n_out).cast("long").alias("stream"), (F.col("id") % n_out).alias("window"))
    rows = rows.withColumns({"_k1": pick(0, len(names)), "_two": uniform(s, salt + 2) < 0.5, "_s1": low + pick(5, high - low + 1), "_s2": low + pick(7, high - low + 1)})
    rows = rows.withColumn("_k2", (F.col("_k1") + 1 + pick(1, len(names) - 1)) % len(names))
    out = {}
    for k, (name, levels) in enumerate(kinds.items()):
        value = F.lit(float(base[name]))
        for kind, draw, start, on in (("_k1", 4, "_s1", F.lit(True)), ("_k2", 6, "_s2", F.col("_two"))):
            at = F.element_at(F.array(*(F.lit(float(failed(name, v, base))) for v in levels)), pick(draw, len(levels)) + 1)
            value = F.when(on & (F.col(kind) == k) & (F.col("window") >= n_baseline + F.col(start)), at).otherwise(value)
        out[name] = value
    return rows.withColumns(out).drop("_k1", "_k2", "_two", "_s1", "_s2")


def mixture_labels(windows: DataFrame, population: DataFrame, r: Reviewer = REVIEWER, h: Harm = HARM) -> DataFrame:
    """Adds ratio (expected harm under a window's reviewer over that under the baseline's) and y (ratio from 1 + kappa on).

    population is harm.with_weighted_errors of a fixed population: one row, so every window's ratio is a formula.
    """
    on_time = S.in_time(r.deadline, r.latency, r.latency_sigma)
    left = lambda coverage, bias: F.col("all") - coverage * on_time * (1 - bias) * F.col("seen")
    both = windows.crossJoin(F.broadcast(population))
    out = both.withColumn("ratio", F.try_divide(left(F.col("coverage"), F.col("bias")), left(F.lit(r.coverage), F.lit(r.bias))))
    return out.withColumn("y", (F.col("ratio") >= 1 + h.kappa).cast("int")).drop("all", "seen")


def review_under(df: DataFrame, ident: Column, r: Reviewer = REVIEWER, h: Harm = HARM, salt: int = 430, audit: float = 0.2) -> DataFrame:
    """review() under each row's own parameters: columns bias, coverage, false_reject and latency."""
    c = F.col
    seen = S.recognition(c("decision"), c("p"), c("severity"), r.beta0, r.beta_confidence, r.beta_severity, c("bias"))
    out = df.withColumns({"examined": uniform(ident, salt) < c("coverage"), "is_error": c("error") == 1, "latency": c("latency") * F.exp(r.latency_sigma * normal(ident, salt + 1)), "audited": uniform(ident, salt + 2) < audit})
    out = out.withColumns(
        {
            "recognized": c("examined") & c("is_error") & (uniform(ident, salt + 3) < seen),
            "wrong": c("examined") & ~c("is_error") & (uniform(ident, salt + 4) < c("false_reject")),
            "required": c("is_error") & (c("severity") >= h.cutoff),
            "in_time": F.lit(True) if math.isinf(r.deadline) else c("latency") <= r.deadline,
        }
    )
    return out.withColumns({"reviewed": c("examined"), "intercepted": c("recognized") & c("in_time")})


def synthetic_cohort(ids: DataFrame, features: list[str], prevalence: float = 0.2, subgroup_share: float = 0.5, salt: int = 500) -> DataFrame:
    """order_key, label, subgroup and features around plus or minus 0.3 to 0.6 by the label, for each order_key."""
    i = F.col("order_key")
    df = ids.select("order_key", (uniform(i, salt) < prevalence).cast("int").alias("label"), (uniform(i, salt + 1) < subgroup_share).cast("int").alias("subgroup"))
    step = 0.3 / max(1, len(features) - 1)
    side = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    return df.withColumns({f: side * (0.3 + k * step) + normal(i, salt + 2 + k) for k, f in enumerate(features)})


# --- the deployed model on a cohort ----------------------------------------------------------------------------------


def rescore(df: DataFrame, model: dict, suffix: str = "") -> DataFrame:
    """Winsorize, impute, standardize, score: one projection. model has bounds, means, sds, weights, intercept, threshold.

    The feature columns that come back are winsorized and imputed, in their own units.
    """
    clean = {
        f: F.coalesce(S.clip(S.nan_to_null(F.col(f).cast("double")), *model["bounds"][f]), F.lit(float(model["means"][f])))
        for f in model["features"]
    }
    out = df.withColumns(clean)
    terms = [(F.col(f) - model["means"][f]) / model["sds"][f] for f in model["features"]]
    z = S.linear_score(terms, [model["weights"][f] for f in model["features"]], model["intercept"])
    out = out.withColumn("p" + suffix, S.sigmoid(z))
    return out.withColumn("decision" + suffix, S.decide(F.col("p" + suffix), model["threshold"]))


def rescale(df: DataFrame, column: str, level: float, progress: Column) -> DataFrame:
    return df.withColumn(column, F.col(column) * S.ramp_ratio(level, progress))


def missing(df: DataFrame, columns: list[str], level: float, progress: Column, means: dict[str, float], salt: int, ident: str = "case_id") -> DataFrame:
    """One mask for all columns of a row; a masked value becomes the imputation mean."""
    gone = uniform(F.col(ident), salt) < S.ramp_amount(level, progress)
    return df.withColumns({c: F.when(gone, F.lit(float(means[c]))).otherwise(F.col(c)) for c in columns})


def scope_creep(df: DataFrame, pool: DataFrame, columns: list[str], level: float, progress: Column, salt: int, ident: str = "case_id") -> DataFrame:
    """In each window, a share of rows (half-even rounding) gets the pool's columns; rows are picked without, pool rows
    with replacement. The pool has a column `slot` from 0 and is joined by it."""
    n_pool = pool.agg(F.count("*").alias("_pool"))
    w = W.partitionBy("window")
    rank = F.row_number().over(w.orderBy(uniform(F.col(ident), salt), ident))
    k = F.bround(S.ramp_amount(level, progress) * F.count("*").over(w))
    out = df.withColumn("_in", rank <= k).crossJoin(F.broadcast(n_pool))
    out = out.withColumn("slot", F.when(F.col("_in"), F.floor(uniform(F.col(ident), salt + 1) * F.col("_pool")).cast("long")))
    other = pool.select("slot", *(F.col(c).alias(f"_{c}") for c in columns))
    out = out.join(other, "slot", "left")
    out = out.withColumns({c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns})
    return out.withColumn("out_of_scope", F.col("_in").cast("int")).drop("_in", "_pool", "slot", *(f"_{c}" for c in columns))
