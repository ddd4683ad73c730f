"""The case stream: scored cases with outcomes, drawn deterministically from the events table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.functions.rng import uniform, uniform_sql
from tidewatch.operators.windows import assign_windows


@dataclass(frozen=True)
class Harm:
    """Harm weights by severity class, factor of a missed case, severity shares, onset rule."""

    weights: tuple[float, float, float] = (1.0, 7.1, 100.0)
    fn_factor: float = 2.4
    positive: tuple[float, float, float] = (0.50, 0.35, 0.15)
    negative: tuple[float, float, float] = (0.85, 0.12, 0.03)
    kappa: float = 0.25
    min_subgroup_share: float = 0.05
    cutoff: int = 2


@dataclass(frozen=True)
class Reviewer:
    coverage: float = 1.0
    beta0: float = 1.0
    beta_confidence: float = 2.0
    beta_severity: float = 0.5
    bias: float = 0.0
    false_reject: float = 0.02
    latency: float = 1.0
    latency_sigma: float = 0.6
    deadline: float = float("inf")


@dataclass(frozen=True)
class Workflow:
    p_deliver: float = 0.98
    tat_median: float = 1.0
    tat_sigma: float = 0.5
    tat_limit: float = 4.0
    time_critical_share: float = 0.2
    completion: float = 0.98
    abandon: float = 0.5
    verify: float = 0.5
    sentinel: int = 3
    action_base: float = 0.7
    fatigue: float = 0.15
    fatigue_bias: float = 0.0


HARM, REVIEWER, WORKFLOW = Harm(), Reviewer(), Workflow()
#: Geometry of the stream: cases in a window, windows of the baseline.
PER_WINDOW, BASELINE = 100, 5
THRESHOLD = 0.5
FEATURES = ("x1", "x2", "x3")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case. Scores are rational in the event's value, so no comparison hangs on the last bit."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("case_id"), F.col("ts").cast("timestamp").alias("order_key"), "user_id", F.abs("value").alias("v")
    )
    i = F.col("case_id")
    e = e.withColumns({"p": F.col("v") / (F.col("v") + 10.0), "g": (F.col("user_id") % 10 == 0).cast("int")})
    e = e.withColumns(
        {
            "y": (uniform(i, 2) < 0.05 + 0.8 * F.col("p")).cast("int"),
            "decision": S.decide(F.col("p"), THRESHOLD),
            **{f: uniform(i, 10 + k) - 0.5 + 0.1 * F.col("p") for k, f in enumerate(FEATURES)},
            "out_of_scope": (uniform(i, 20) < 0.02).cast("int"),
        }
    )
    return e.withColumn("severity", S.severity(uniform(i, 3), F.col("y"), HARM.positive, HARM.negative)).drop("v")


def windowed_cases(spark: SparkSession, sf_dir: str, per_window: int = PER_WINDOW) -> DataFrame:
    df = assign_windows(cases(spark, sf_dir), "order_key", "case_id", per_window)
    err = S.error(F.col("y"), F.col("decision"))
    return df.withColumns(
        {
            "error": err,
            "w": S.harm_weight(F.col("severity"), F.col("y"), F.col("decision"), HARM.weights, HARM.fn_factor),
            "confidence": S.confidence(F.col("p"), F.col("decision")),
        }
    )


def _severity_sql(u: str) -> str:
    a, b = HARM.positive, HARM.negative
    return (
        f"CASE WHEN y = 1 THEN CASE WHEN {u} <= {a[0]} THEN 1 WHEN {u} <= {a[0] + a[1]} THEN 2 ELSE 3 END "
        f"ELSE CASE WHEN {u} <= {b[0]} THEN 1 WHEN {u} <= {b[0] + b[1]} THEN 2 ELSE 3 END END"
    )


_x = ", ".join(f"{uniform_sql('event_id', 10 + k)} - 0.5 + 0.1 * p AS {f}" for k, f in enumerate(FEATURES))
#: The windowed case stream for the oracle: common table expressions up to `c`.
CASES_SQL = f"""
e0 AS (SELECT event_id, ts AS order_key, user_id, abs(value) / (abs(value) + 10.0) AS p FROM events),
e1 AS (SELECT event_id, event_id AS case_id, order_key, user_id, p, CAST(user_id % 10 = 0 AS INT) AS g,
  CAST({uniform_sql("event_id", 2)} < 0.05 + 0.8 * p AS INT) AS y, CAST(p >= {THRESHOLD} AS INT) AS decision, {_x},
  CAST({uniform_sql("event_id", 20)} < 0.02 AS INT) AS out_of_scope FROM e0),
e2 AS (SELECT *, {_severity_sql(uniform_sql("event_id", 3))} AS severity,
  row_number() OVER (ORDER BY order_key, case_id) - 1 AS n0 FROM e1),
e3 AS (SELECT *, n0 // {PER_WINDOW} AS window_no, n0 % {PER_WINDOW} AS pos, count(*) OVER (PARTITION BY n0 // {PER_WINDOW}) AS in_window,
  CAST(y <> decision AS INT) AS error,
  (CASE severity WHEN 1 THEN {HARM.weights[0]} WHEN 2 THEN {HARM.weights[1]} ELSE {HARM.weights[2]} END)
    * (CASE WHEN y = 1 AND decision = 0 THEN {HARM.fn_factor} ELSE 1.0 END) AS w,
  CASE WHEN decision = 1 THEN p ELSE 1 - p END AS confidence FROM e2),
c AS (SELECT * FROM e3 WHERE in_window = {PER_WINDOW})"""
