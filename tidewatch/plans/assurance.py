"""Queries over the case stream: indicators, scores, alarms, harm, reviews, audits, resampling. Each with its SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.functions.rng import normal_sql, uniform, uniform_sql
from tidewatch.operators import calibration, detectors, harm, inference, layers, streams, worlds
from tidewatch.operators import indicators as I
from tidewatch.operators import windows as wn
from tidewatch.operators.cases import BASELINE, CASES_SQL, FEATURES, HARM, REVIEWER, cases, windowed_cases

H, LAG, J = 3.0, 2, 2
RATIOS = ("P1", "P2", "P3", "P5", "P6", "U2", "U4", "C3")
#: Thresholds of the event queries; calibrated ones come from the calibration query.
ARM_H = {"conventional": 3.0, "harm": 3.0, "calibration": 3.5, "input": 4.0, "union": 5.5, "split": {"P": 5.5, "U": 6.0, "C": 5.0}}


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def ratio_sql(source: str = "c", keys: str = "window_no AS win", more: str = "") -> str:
    """Common table expression `ind`: the ratio indicators of groups of cases."""
    high = f"confidence >= {I.HIGH_CONFIDENCE}"
    return f"""
ind AS (SELECT {keys},
  sum(y * decision)::DOUBLE / nullif(sum(y), 0) AS P1,
  sum((1 - y) * (1 - decision))::DOUBLE / nullif(sum(1 - y), 0) AS P2,
  sum(y * decision)::DOUBLE / nullif(sum(decision), 0) AS P3,
  1000 * avg(w * error) AS P5,
  abs(sum(error * g)::DOUBLE / nullif(sum(g), 0) - sum(error * (1 - g))::DOUBLE / nullif(sum(1 - g), 0)) AS P6,
  avg((p - y) * (p - y)) AS U2,
  sum(CASE WHEN {high} THEN error END)::DOUBLE / nullif(count(CASE WHEN {high} THEN 1 END), 0) AS U4,
  1 - avg(out_of_scope) AS C3{more} FROM {source} GROUP BY {", ".join(str(k + 1) for k in range(keys.count(",") + 1))})"""


RATIO_SQL = ratio_sql()
_dir = "CASE indicator " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.DIRECTION.items()) + " END"
_late = "indicator IN (" + ", ".join(f"'{k}'" for k in I.LAGGED) + ")"


def _scores_sql(names: tuple[str, ...], lag: int = LAG, stream: str = "", baseline: int = BASELINE, of: str = "ind", to: str = "z") -> str:
    """Common table expression `to`: standardized and lagged scores of a wide table; stream: leading key columns, with a comma."""
    return f"""
{to}_f AS (SELECT {stream} win, indicator, x FROM {of} UNPIVOT INCLUDE NULLS (x FOR indicator IN ({", ".join(names)}))),
{to}_z AS (SELECT *, coalesce({_dir} * (x - avg(CASE WHEN win < {baseline} THEN x END) OVER (PARTITION BY {stream} indicator))
  / greatest(stddev_samp(CASE WHEN win < {baseline} THEN x END) OVER (PARTITION BY {stream} indicator), 1e-6), 0) AS z0 FROM {to}_f),
{to}_l AS (SELECT *, CASE WHEN {_late} THEN lag(z0, {lag}) OVER (PARTITION BY {stream} indicator ORDER BY win) ELSE z0 END AS z1 FROM {to}_z),
{to} AS (SELECT {stream} indicator, win - {baseline} AS t, coalesce(z1, 0) AS z FROM {to}_l WHERE win >= {baseline})"""


FOLD_SQL = f"""
f AS (SELECT {{key}}, t, z, h, greatest(0, z - {detectors.K_REF}) AS s FROM zh WHERE t = 0
  UNION ALL SELECT {{qkey}}, zh.t, zh.z, zh.h, greatest(0, CASE WHEN f.s > f.h THEN 0 ELSE f.s END + zh.z - {detectors.K_REF}) FROM f JOIN zh ON {{on}} AND zh.t = f.t + 1)"""


def _long(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = RATIOS) -> DataFrame:
    wide = I.model_ratios(windowed_cases(spark, sf_dir), ["window"])
    return I.long_form(wide, list(names), ["window"])


def case_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_cases(spark, sf_dir).select("case_id", F.col("window").alias("win"), "pos", "y", "decision", "severity", "g", "p", "w")
    return _r(df, "p", "w")


CASE_WINDOWS = f"WITH {CASES_SQL} SELECT case_id, window_no AS win, pos, y, decision, severity, g, round(p, 6) AS p, round(w, 6) AS w FROM c"


def window_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(I.model_ratios(windowed_cases(spark, sf_dir), ["window"]).withColumnRenamed("window", "win"), *RATIOS)


WINDOW_RATIOS = f"WITH {CASES_SQL}, {RATIO_SQL} SELECT win, {', '.join(f'round({c}, 6) AS {c}' for c in RATIOS)} FROM ind"


def window_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(I.auroc(windowed_cases(spark, sf_dir), ["window"]).withColumnRenamed("window", "win"), "P4")


WINDOW_AUROC = f"""WITH {CASES_SQL}, r AS (SELECT window_no AS win, y, rank() OVER (PARTITION BY window_no ORDER BY p)
  + (count(*) OVER (PARTITION BY window_no, p) - 1) / 2.0 AS k FROM c)
SELECT win, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6) AS P4 FROM r GROUP BY 1"""


def window_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(I.ece(windowed_cases(spark, sf_dir), ["window"]).withColumnRenamed("window", "win"), "U1")


WINDOW_ECE = f"""WITH {CASES_SQL}, b AS (SELECT window_no AS win, least(floor(p * {I.BINS}), {I.BINS - 1}) AS b, sum(y - p) AS d, count(*) AS n FROM c GROUP BY 1, 2)
SELECT win, round(sum(abs(d)) / sum(n), 6) AS U1 FROM b GROUP BY 1"""


def window_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_cases(spark, sf_dir)
    return _r(I.ks_to_baseline(df, ["window"], F.col("window") < BASELINE, []).withColumnRenamed("window", "win"), "U5")


WINDOW_KS = f"""WITH {CASES_SQL}, b AS (SELECT p, count(*) AS n FROM c WHERE window_no < {BASELINE} GROUP BY 1),
v AS (SELECT DISTINCT p FROM c), q AS (SELECT v.p, sum(coalesce(n, 0)) OVER (ORDER BY v.p) * 1.0 / sum(coalesce(n, 0)) OVER () AS f FROM v LEFT JOIN b USING (p)),
r AS (SELECT window_no AS win, f, row_number() OVER (PARTITION BY window_no ORDER BY c.p) AS i, count(*) OVER (PARTITION BY window_no) AS m FROM c JOIN q USING (p))
SELECT win, round(max(greatest(abs(i * 1.0 / m - f), abs((i - 1) * 1.0 / m - f))), 6) AS U5 FROM r GROUP BY 1"""


def window_mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_cases(spark, sf_dir)
    return _r(I.mean_shift(df, ["window"], FEATURES, F.col("window") < BASELINE, []).withColumnRenamed("window", "win"), "C2")


_m = ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
WINDOW_MEAN_SHIFT = f"""WITH {CASES_SQL}, m AS (SELECT window_no AS win, count(*) AS n, {_m} FROM c GROUP BY 1), b AS (SELECT {_m} FROM c WHERE window_no < {BASELINE})
SELECT win, round(n * ({" + ".join(f"(m.{f} - b.{f}) * (m.{f} - b.{f})" for f in FEATURES)}), 6) AS C2 FROM m, b"""


def window_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(I.slope_deviation(windowed_cases(spark, sf_dir), ["window"]).withColumnRenamed("window", "win"), "U3")


_q = f"least(greatest(p, {S.EPS!r}), {1 - S.EPS!r})"
WINDOW_SLOPE = f"""WITH RECURSIVE {CASES_SQL}, l AS (SELECT window_no AS win, list({{'y': y::DOUBLE, 'z': ln({_q} / (1 - {_q}))}}) AS l FROM c GROUP BY 1),
s AS (SELECT win, 0 AS step, 0.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, l FROM l UNION ALL
  SELECT win, step + 1, b0 + (h11 * g0 - h01 * g1) / det, b1 + (h00 * g1 - h01 * g0) / det, l FROM (SELECT *, CASE WHEN abs(h00 * h11 - h01 * h01) >= 1e-12 THEN h00 * h11 - h01 * h01 ELSE 1e-12 END AS det FROM
  (SELECT win, step, b0, b1, l, list_sum(list_transform(m, lambda x: x.y - x.mu)) AS g0, list_sum(list_transform(m, lambda x: x.z * (x.y - x.mu))) AS g1, list_sum(list_transform(m, lambda x: x.w)) AS h00,
    list_sum(list_transform(m, lambda x: x.w * x.z)) AS h01, list_sum(list_transform(m, lambda x: x.w * x.z * x.z)) AS h11 FROM
  (SELECT *, list_transform(m0, lambda x: {{'y': x.y, 'z': x.z, 'mu': x.mu, 'w': x.mu * (1 - x.mu) + {S.EPS!r}}}) AS m FROM
  (SELECT *, list_transform(l, lambda x: {{'y': x.y, 'z': x.z, 'mu': 1 / (1 + exp(-least(greatest(b0 + b1 * x.z, -700), 700)))}}) AS m0 FROM s WHERE step < 30)))))
SELECT win, round(abs(b1 - 1), 6) AS U3 FROM s WHERE step = 30"""


def rolling_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = wn.trailing(windowed_cases(spark, sf_dir), 4)
    brier = pooled.groupBy("window").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("U2r"))
    return _r(I.ece(pooled, ["window"], "U1r").join(brier, "window").withColumnRenamed("window", "win"), "U1r", "U2r")


ROLLING = f"""WITH {CASES_SQL}, k AS (SELECT DISTINCT window_no AS win FROM c WHERE window_no >= 3),
q AS (SELECT win, y, p FROM k JOIN c ON c.window_no BETWEEN win - 3 AND win),
b AS (SELECT win, least(floor(p * {I.BINS}), {I.BINS - 1}) AS b, sum(y - p) AS d, count(*) AS n, sum((p - y) * (p - y)) AS q FROM q GROUP BY 1, 2)
SELECT win, round(sum(abs(d)) / sum(n), 6) AS U1r, round(sum(q) / sum(n), 6) AS U2r FROM b GROUP BY 1"""


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity, specificity, PPV, NPV, AUROC, ECE and Brier of the whole stream, by subgroup."""
    df = cases(spark, sf_dir)
    y, d = F.col("y"), F.col("decision")
    a = df.groupBy("g").agg(
        I.ratio(F.sum(y * d), F.sum(y)).alias("se"), I.ratio(F.sum((1 - y) * (1 - d)), F.sum(1 - y)).alias("sp"),
        I.ratio(F.sum(y * d), F.sum(d)).alias("ppv"), I.ratio(F.sum((1 - y) * (1 - d)), F.sum(1 - d)).alias("npv"),
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
    )
    return _r(a.join(I.auroc_of_large(df, ["g"], name="auroc"), "g").join(I.ece(df, ["g"], "ece"), "g"), "se", "sp", "ppv", "npv", "brier", "auroc", "ece")


OVERALL = f"""WITH {CASES_SQL}, a AS (SELECT g, sum(y * decision)::DOUBLE / nullif(sum(y), 0) AS se, sum((1 - y) * (1 - decision))::DOUBLE / nullif(sum(1 - y), 0) AS sp,
  sum(y * decision)::DOUBLE / nullif(sum(decision), 0) AS ppv, sum((1 - y) * (1 - decision))::DOUBLE / nullif(sum(1 - decision), 0) AS npv, avg((p - y) * (p - y)) AS brier FROM e3 GROUP BY 1),
k AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS k FROM e3),
u AS (SELECT g, (sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auroc FROM k GROUP BY 1),
b AS (SELECT g, least(floor(p * {I.BINS}), {I.BINS - 1}) AS b, sum(y - p) AS d, count(*) AS n FROM e3 GROUP BY 1, 2), e AS (SELECT g, sum(abs(d)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT g, {", ".join(f"round({c}, 6) AS {c}" for c in ("se", "sp", "ppv", "npv", "brier", "auroc", "ece"))} FROM a JOIN u USING (g) JOIN e USING (g)"""


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(detectors.scores(_long(spark, sf_dir), BASELINE, LAG), "z")


SCORES = f"WITH {CASES_SQL}, {RATIO_SQL}, {_scores_sql(RATIOS)} SELECT indicator, t, round(z, 6) AS z FROM z"


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cases to windows, indicators, scores, lag, CUSUM and alert episodes."""
    z = detectors.scores(_long(spark, sf_dir), BASELINE, LAG)
    a = detectors.cusum(z, H, ["indicator"])
    out = a.withColumn("episode_start", wn.episode_start(F.col("alarm"), J, ["indicator"], "t"))
    return _r(out, "z", "s")


def _episode_sql(event: str, by: str) -> str:
    return f"{event} AND coalesce(max(CASE WHEN {event} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY t ROWS BETWEEN {J} PRECEDING AND 1 PRECEDING), 0) = 0"


_fold = FOLD_SQL.format(key="indicator", qkey="zh.indicator", on="zh.indicator = f.indicator")
ALERTS = f"""WITH RECURSIVE {CASES_SQL}, {RATIO_SQL}, {_scores_sql(RATIOS)}, zh AS (SELECT *, {H} AS h FROM z), {_fold}
SELECT indicator, t, round(z, 6) AS z, round(s, 6) AS s, s > h AS alarm, {_episode_sql("(s > h)", "indicator")} AS episode_start FROM f"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = detectors.scores(_long(spark, sf_dir), BASELINE, LAG)
    return detectors.arm_events(z, detectors.arm_table(spark, ARM_H), [])


_arms = "arms(arm, indicator, h) AS (VALUES " + ", ".join(
    [f"('{a}', '{i}', {ARM_H[a]})" for a, names in detectors.FLAT_ARMS.items() for i in names]
    + [f"('{a}', '{i}', {ARM_H[a][c]})" for a, parts in detectors.SPLIT_ARMS.items() for c, names in parts.items() for i in names]
) + ")"
_arm_fold = FOLD_SQL.format(key="arm, indicator", qkey="zh.arm, zh.indicator", on="zh.arm = f.arm AND zh.indicator = f.indicator")
EVENTS_SQL = f"""{CASES_SQL}, {RATIO_SQL}, {_scores_sql(RATIOS)}, {_arms}, zh AS (SELECT arm, z.indicator, t, z, h FROM z JOIN arms USING (indicator)), {_arm_fold},
ev AS (SELECT arm, t, bool_or(s > h) AS event FROM f GROUP BY 1, 2)"""


def arm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


ARM_EVENTS = f"WITH RECURSIVE {EVENTS_SQL} SELECT arm, t, event FROM ev"


def alert_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(detectors.alert_rate(_events(spark, sf_dir), J, [], ["arm"]), "rate", "se")


ALERT_RATES = f"""WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT arm, {_episode_sql("event", "arm")} AS st FROM ev)
SELECT arm, round(1000.0 * sum(st::INT) / count(*), 6) AS rate, round(1000 * sqrt(greatest(sum(st::INT), 1)) / count(*), 6) AS se FROM s GROUP BY 1"""


def horizon_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all stretches of 8 windows that hold an event."""
    e = _events(spark, sf_dir).withColumn("near", wn.any_within(F.col("event"), 8, ["arm"], "t"))
    return _r(e.groupBy("arm").agg(F.avg(F.col("near").cast("double")).alias("share")), "share")


HORIZON = f"""WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT arm, max(event::INT) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS a FROM ev)
SELECT arm, round(avg(a), 6) AS share FROM s GROUP BY 1"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window taken as the start of a change in turn, its onset one window later."""
    return detectors.classify_all_starts(_events(spark, sf_dir), ["arm"], 1, 20, J)


CLASSIFIED = f"""WITH RECURSIVE {EVENTS_SQL}, st AS (SELECT *, {_episode_sql("event", "arm")} AS st FROM ev),
k AS (SELECT arm, t AS s, t + 1 AS t0, coalesce(sum(st::INT) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS false_alarms,
  min(CASE WHEN event THEN t END) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS first,
  coalesce(bool_or(event) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN {J} PRECEDING AND 1 PRECEDING), false) AS carry_in FROM st)
SELECT arm, s, false_alarms::BIGINT AS false_alarms, (first IS NULL OR first >= t0 + 20) AS censored, CASE WHEN first IS NULL OR first >= t0 + 20 THEN 20 ELSE greatest(0, first - t0) END::BIGINT AS tafd,
  coalesce(first < t0, false) AS anticipatory, CASE WHEN first < t0 THEN t0 - first ELSE 0 END::BIGINT AS lead_time, carry_in FROM k"""

#: Geometry of null streams and replicates: streams, windows, baseline windows, windows of a block.
NULL = {"streams": 300, "n_out": 64, "n_baseline": 16, "block": 8}


def null_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all indicators in resampled null streams."""
    df = windowed_cases(spark, sf_dir)
    return streams.null_scores(df, FEATURES, NULL["streams"], NULL["n_out"], NULL["n_baseline"], NULL["block"], LAG)


def calibrated_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.calibrate_arms(null_scores(spark, sf_dir), 30.0, J)


_p = uniform_sql("draw", 1)


def block_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled window sums: 20 streams of 30 windows from the real windows."""
    sums = windowed_cases(spark, sf_dir).groupBy("window").agg(F.sum("error").alias("errors"), F.sum("y").alias("positives"))
    n_real = sums.count()
    plan = inference.block_plan(spark, 20, 30, n_real, 3)
    return inference.resampled(sums, plan).withColumnRenamed("window", "win")


BLOCK_PLAN = f"""WITH {CASES_SQL}, s AS (SELECT window_no AS src, sum(error) AS errors, sum(y) AS positives FROM c GROUP BY 1), n AS (SELECT count(*) AS k FROM s),
g AS (SELECT id // 30 AS stream, id % 30 AS win, (id // 30) * 10 + (id % 30) // 3 AS draw FROM range(600) t(id)),
q AS (SELECT stream, win, CAST(floor({_p} * (k - 2)) AS BIGINT) + win % 3 AS src FROM g, n)
SELECT stream, win, errors::BIGINT AS errors, positives::BIGINT AS positives FROM q JOIN s USING (src)"""

# --- harm --------------------------------------------------------------------------------------------------------------

_seen = f"1 / (1 + exp(-({REVIEWER.beta0} + {REVIEWER.beta_confidence} * (1 - confidence) + {REVIEWER.beta_severity} * (severity - 1))))"
HARM_SQL = f"{CASES_SQL}, hm AS (SELECT *, 1000.0 * w * error * (1 - {REVIEWER.coverage} * {_seen}) AS harm FROM c)"


def harm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = harm.onset_table(windowed_cases(spark, sf_dir), BASELINE)
    return _r(t.select(F.col("window").alias("win"), "rhe", "rhe_sub", "share", "ratio", "over"), "rhe", "rhe_sub", "share", "ratio")


_onset = f"""{HARM_SQL}, b AS (SELECT avg(harm) AS base, avg(CASE WHEN g = 1 THEN harm END) AS base_sub FROM hm WHERE window_no < {BASELINE}),
o AS (SELECT window_no AS win, avg(harm) AS rhe, avg(CASE WHEN g = 1 THEN harm END) AS rhe_sub, avg(g) AS share FROM hm GROUP BY 1),
q AS (SELECT *, greatest(rhe / nullif(base, 0), CASE WHEN share >= {HARM.min_subgroup_share} THEN rhe_sub / nullif(base_sub, 0) END) AS ratio FROM o, b),
ot AS (SELECT *, coalesce(ratio >= {1 + HARM.kappa} OR (base = 0 AND rhe > 0), false) AS over FROM q)"""
HARM_WINDOWS = f"WITH {_onset} SELECT win, round(rhe, 6) AS rhe, round(rhe_sub, 6) AS rhe_sub, round(share, 6) AS share, round(ratio, 6) AS ratio, over FROM ot"


def onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harm.onset_index(harm.onset_table(windowed_cases(spark, sf_dir), BASELINE), BASELINE)


ONSET = f"WITH {_onset} SELECT min(CASE WHEN over THEN win - {BASELINE} END) AS onset FROM ot WHERE win >= {BASELINE}"


def rolling_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = harm.rolling_onset(windowed_cases(spark, sf_dir), 5)
    return _r(t.withColumnRenamed("window", "win"), "rhe", "base", "ratio")


ROLLING_ONSET = f"""WITH {HARM_SQL}, o AS (SELECT window_no AS win, avg(harm) AS rhe, sum(harm) AS h, count(*) AS n FROM hm GROUP BY 1),
b AS (SELECT win, rhe, sum(h) OVER q / nullif(sum(n) OVER q, 0) AS base FROM o WINDOW q AS (ORDER BY win ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT win, round(rhe, 6) AS rhe, round(base, 6) AS base, round(rhe / nullif(base, 0), 6) AS ratio, coalesce(rhe / nullif(base, 0) >= {1 + HARM.kappa}, false) AS over FROM b"""


def onset_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled and subgroup harm as two series, standardized and run through the CUSUM; the first episode is the onset."""
    t = harm.onset_table(windowed_cases(spark, sf_dir), BASELINE)
    sub = F.when(F.col("share") >= HARM.min_subgroup_share, F.col("rhe_sub"))
    wide = t.select("window", F.col("rhe").alias("P5"), sub.alias("P6"))
    z = detectors.scores(I.long_form(wide, ["P5", "P6"], ["window"]), BASELINE, 0)
    return _r(detectors.cusum(z, H, ["indicator"]), "z", "s")


ONSET_CUSUM = f"""WITH RECURSIVE {_onset}, ind AS (SELECT win, rhe AS P5, CASE WHEN share >= {HARM.min_subgroup_share} THEN rhe_sub END AS P6 FROM ot),
{_scores_sql(("P5", "P6"), 0)}, zh AS (SELECT *, {H} AS h FROM z), {_fold} SELECT indicator, t, round(z, 6) AS z, round(s, 6) AS s, s > h AS alarm FROM f"""


def workflow_harm(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = spark.createDataFrame([(0, 0.98, 0.5, 0.0028), (1, 0.7, 0.5, 0.0028), (2, 0.98, 0.2, 0.1), (3, 1.0, 1.0, 0.0)], "param_id int, p_deliver double, verify double, late double")
    return _r(harm.workflow_harm(windowed_cases(spark, sf_dir), params), "rhe")


WORKFLOW_HARM = f"""WITH {HARM_SQL}, s AS (SELECT avg(harm) AS a, 1000 * avg(CASE WHEN decision = 1 AND y = 1 AND severity >= {HARM.cutoff} THEN w ELSE 0 END) AS m,
  1000 * avg(CASE WHEN decision = 1 AND y = 1 THEN w ELSE 0 END) AS d FROM hm), pr(param_id, p_deliver, verify, late) AS (VALUES (0, 0.98, 0.5, 0.0028), (1, 0.7, 0.5, 0.0028), (2, 0.98, 0.2, 0.1), (3, 1.0, 1.0, 0.0))
SELECT param_id, round(a * (1 - verify) + m * (1 - p_deliver) + d * 0.2 * late, 6) AS rhe FROM s, pr"""

# --- review, workflow, audits --------------------------------------------------------------------------------------------


def _u(salt: int) -> str:
    return uniform_sql("case_id", salt)


REVIEW_SQL = f"""{CASES_SQL}, r1 AS (SELECT *, {_u(30)} < {REVIEWER.coverage} AS examined, error = 1 AS is_error, exp({REVIEWER.latency_sigma} * {normal_sql("case_id", 31)}) AS latency, {_u(32)} < 0.2 AS audited FROM c),
r2 AS (SELECT *, examined AND is_error AND {_u(33)} < {_seen} AS recognized, examined AND NOT is_error AND {_u(34)} < {REVIEWER.false_reject} AS wrong, is_error AND severity >= {HARM.cutoff} AS required, true AS in_time FROM r1),
rv AS (SELECT *, examined AS reviewed, recognized AND in_time AS intercepted FROM r2)"""


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("window", "win")


def oversight(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("H1", "H2", "H3", "H4", "H5", "H6")
    return _r(_named(I.oversight(layers.review(windowed_cases(spark, sf_dir)), ["window"])), *cols)


_n = lambda e: f"sum(({e})::INT)::DOUBLE"
OVERSIGHT = f"""WITH {REVIEW_SQL} SELECT window_no AS win, round({_n("examined")} / count(*), 6) AS H1, round({_n("recognized OR wrong")} / nullif({_n("examined")}, 0), 6) AS H2,
  round({_n("recognized")} / nullif({_n("recognized OR wrong")}, 0), 6) AS H3, round(1 - {_n("recognized")} / nullif({_n("examined AND is_error")}, 0), 6) AS H4,
  round({_n("audited AND required AND in_time AND recognized")} / nullif({_n("audited AND required")}, 0), 6) AS H5, round(quantile_cont(CASE WHEN examined THEN latency END, 0.5), 6) AS H6 FROM rv GROUP BY 1"""


def workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers.workflow(layers.review(windowed_cases(spark, sf_dir)))
    return _r(_named(I.workflow(df, ["window"])), "H7", "O1", "O2", "O3", "O3a", "O4", "O5", "O6")


WORKFLOW_SQL = f"""{REVIEW_SQL}, w1 AS (SELECT window_no, case_id, is_error, intercepted, severity, decision = 1 AS initiated, decision = 1 AND y = 1 AS required, (decision = 1 AND y = 1 AND {_u(50)} < 0.98) AS delivered,
  exp(0.5 * {normal_sql("case_id", 51)}) AS tat, CASE WHEN decision = 1 THEN 1 ELSE 0 END AS alerts FROM rv),
wf AS (SELECT *, delivered AND tat > 4.0 AS late, initiated AND {_u(53)} < CASE WHEN required AND NOT delivered THEN 0.98 * 0.5 ELSE 0.98 END AS completed,
  CASE WHEN alerts > 0 AND {_u(60)} < 0.7 THEN 1 ELSE 0 END AS actioned, is_error AND NOT intercepted AND {_u(54)} >= 0.5 AS downstream FROM w1)"""
WORKFLOW = f"""WITH {WORKFLOW_SQL} SELECT window_no AS win, round({_n("delivered")} / nullif({_n("required")}, 0), 6) AS H7, round({_n("completed")} / nullif({_n("initiated")}, 0), 6) AS O1,
  round({_n("required AND (NOT delivered OR late)")} / nullif({_n("required")}, 0), 6) AS O2, round(sum(alerts)::DOUBLE / count(*), 6) AS O3, round(sum(actioned)::DOUBLE / nullif(sum(alerts), 0), 6) AS O3a,
  round(quantile_cont(tat, 0.95), 6) AS O4, round({_n("downstream")} / count(*), 6) AS O5, round({_n("downstream AND severity >= 3")} / count(*), 6) AS O6 FROM wf GROUP BY 1"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers.review(windowed_cases(spark, sf_dir))
    out = inference.ehor(inference.audit_weights(df, 0.2, 70, False))
    return _r(out, *out.columns)


AUDIT = f"""WITH {REVIEW_SQL}, a AS (SELECT *, CASE WHEN {_u(70)} < 0.2 THEN 1 / 0.2 ELSE 0 END AS weight FROM rv),
t AS (SELECT coalesce({_n("intercepted AND required")} / nullif({_n("required")}, 0), 0) AS ehor, coalesce({_n("reviewed AND required")} / nullif({_n("required")}, 0), 0) AS coverage,
  coalesce({_n("intercepted AND required")} / nullif({_n("reviewed AND required")}, 0), 0) AS detection, coalesce(sum(CASE WHEN intercepted AND required THEN weight ELSE 0 END) / nullif(sum(CASE WHEN required THEN weight ELSE 0 END), 0), 0) AS ehor_ht,
  coalesce({_n("intercepted AND required")} / nullif({_n("intercepted AND required")} + 0.5 * {_n("required AND NOT intercepted")}, 0), 0) AS naive FROM a),
s AS (SELECT sqrt(sum(CASE WHEN weight > 0 AND required THEN weight * (weight - 1) * pow(intercepted::INT - ehor_ht, 2) ELSE 0 END)) / nullif(sum(CASE WHEN required THEN weight ELSE 0 END), 0) AS se FROM a, t)
SELECT {", ".join(f"round({c}, 6) AS {c}" for c in ("ehor", "coverage", "detection", "ehor_ht", "naive", "se"))} FROM t, s"""


def audit_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers.review(windowed_cases(spark, sf_dir))
    return _r(inference.audit_weights(df, 0.1, 71, True).groupBy("window").agg(F.sum("weight").alias("weight")).withColumnRenamed("window", "win"), "weight")


AUDIT_STRATIFIED = f"""WITH {CASES_SQL}, q AS (SELECT quantile_cont(confidence, 1.0 / 3) AS a, quantile_cont(confidence, 2.0 / 3) AS b FROM c),
m AS (SELECT window_no, case_id, CASE WHEN confidence < a THEN 3.0 WHEN confidence < b THEN 1.0 ELSE 0.5 END::DOUBLE AS m FROM c, q), s AS (SELECT sum(m) AS sm, count(*) AS n FROM m),
p AS (SELECT window_no, case_id, least(1.0, 0.1 * n * m / sm) AS pi FROM m, s)
SELECT window_no AS win, round(sum(CASE WHEN {_u(71)} < pi THEN 1 / pi ELSE 0 END), 6) AS weight FROM p GROUP BY 1"""

# --- perturbations and schedules ---------------------------------------------------------------------------------------------


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of three shapes and what reviewer and workflow schedules make of it, by window."""
    w = windowed_cases(spark, sf_dir).select("window").distinct()
    shapes = {s: S.window_progress(s, F.col("window"), BASELINE, 2, 6) for s in ("abrupt", "gradual", "incremental")}
    out = w.withColumns(shapes)
    base_r = {"bias": 0.0, "coverage": 1.0, "latency": 1.0, "false_reject": 0.02}
    base_w = {"p_deliver": 0.98, "verify": 0.5}
    g = F.col("gradual")
    out = out.withColumns(
        {
            "coverage": S.reviewer_schedule("coverage", 0.6, g, base_r)["coverage"],
            "latency": S.reviewer_schedule("latency", 3.0, g, base_r)["latency"],
            "delivery": S.workflow_schedule("delivery", 0.4, g, base_w)["p_deliver"],
            "verify": S.workflow_schedule("verify", 0.8, g, base_w)["verify"],
            "joint_bias": S.joint_schedule("dup", 3.0, g, base_r, base_w | {"fatigue_bias": 0.1})["bias"],
        }
    )
    cols = ("abrupt", "gradual", "incremental", "coverage", "latency", "delivery", "verify", "joint_bias")
    return _r(out.withColumnRenamed("window", "win"), *cols)


_g = f"CASE WHEN win < {BASELINE} THEN 0.0 ELSE least(1.0, greatest(0.0, (win - {BASELINE} - 2 + 1) / 6.0)) END"
SCHEDULES = f"""WITH {CASES_SQL}, k AS (SELECT DISTINCT window_no AS win FROM c), q AS (SELECT win, {_g} AS gradual, CASE WHEN win < {BASELINE} THEN 0.0 WHEN win - {BASELINE} >= 2 THEN 1.0 ELSE 0.0 END AS abrupt FROM k)
SELECT win, round(abrupt, 6)::DOUBLE AS abrupt, round(gradual, 6)::DOUBLE AS gradual, round(ceil(3 * gradual - 1e-9) / 3.0, 6)::DOUBLE + 0.0 AS incremental, round(1.0 - 0.4 * gradual, 6)::DOUBLE AS coverage, round(1 + 2 * gradual, 6)::DOUBLE AS latency,
  round(0.98 * (1 - 0.4 * gradual), 6)::DOUBLE AS delivery, round(greatest(0.0, 0.5 - 0.8 * gradual), 6)::DOUBLE AS verify, round(0.1 * (1 - 1 / (1 + 2 * gradual)), 6)::DOUBLE AS joint_bias FROM q"""

MODEL = {
    "features": list(FEATURES), "bounds": dict.fromkeys(FEATURES, (-0.45, 0.55)), "means": dict.fromkeys(FEATURES, 0.05),
    "sds": dict.fromkeys(FEATURES, 0.29), "weights": {"x1": 0.8, "x2": 0.5, "x3": -0.3}, "intercept": -0.2, "threshold": 0.5,
}


def _model_sql(source: str, name: str) -> str:
    c = ", ".join(f"coalesce(least(greatest({f}, -0.45), 0.55), 0.05) AS {f}" for f in FEATURES)
    z = "-0.2 + " + " + ".join(f"{w} * (({f} - 0.05) / 0.29)" for f, w in MODEL["weights"].items())
    return f"{name}0 AS (SELECT * EXCLUDE ({', '.join(FEATURES)}, p), {c} FROM {source}), {name} AS (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM {name}0)"


def _perturbed_rates(df: DataFrame) -> DataFrame:
    out = layers.rescore(df.drop("p", "decision"), MODEL)
    agg = out.groupBy("window").agg(F.avg("p").alias("mean_p"), F.avg("x1").alias("mean_x1"), F.avg(F.col("y").cast("double")).alias("rate"))
    return _r(_named(agg), "mean_p", "mean_x1", "rate")


_rates = "SELECT window_no AS win, round(avg(p), 6) AS mean_p, round(avg(x1), 6) AS mean_x1, round(avg(y), 6) AS rate FROM m GROUP BY 1"
_prog = re.sub(r"\bwin\b", "window_no", _g)


def perturb_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_cases(spark, sf_dir)
    return _perturbed_rates(layers.rescale(df, "x1", 2.5, S.window_progress("gradual", F.col("window"), BASELINE, 2, 6)))


PERTURB_RESCALE = f"WITH {CASES_SQL}, a AS (SELECT * REPLACE (x1 * (1 + ({_prog}) * 1.5) AS x1) FROM c), {_model_sql('a', 'm')} {_rates}"


def perturb_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_cases(spark, sf_dir)
    return _perturbed_rates(layers.missing(df, ["x1", "x2"], 0.7, S.window_progress("gradual", F.col("window"), BASELINE, 2, 6), MODEL["means"], 80))


PERTURB_MISSING = f"""WITH {CASES_SQL}, a AS (SELECT * REPLACE (CASE WHEN {_u(80)} < 0.7 * ({_prog}) THEN 0.05 ELSE x1 END AS x1, CASE WHEN {_u(80)} < 0.7 * ({_prog}) THEN 0.05 ELSE x2 END AS x2) FROM c), {_model_sql("a", "m")} {_rates}"""


def perturb_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_cases(spark, sf_dir).drop("out_of_scope")
    pool = df.where(F.col("window") < BASELINE).where("g = 1")
    pool = pool.withColumn("slot", F.row_number().over(wn.W.partitionBy("g").orderBy("case_id")).cast("long") - 1)
    out = layers.scope_creep(df, pool, ["y", *FEATURES], 0.3, S.window_progress("abrupt", F.col("window"), BASELINE, 2, 6), 90)
    return _perturbed_rates(out)


PERTURB_SCOPE = f"""WITH {CASES_SQL}, pool AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS slot, y AS py, {", ".join(f"{f} AS p{f}" for f in FEATURES)} FROM c WHERE window_no < {BASELINE} AND g = 1), pn AS (SELECT count(*) AS np FROM pool),
k AS (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY {_u(90)}, case_id) AS rk, CASE WHEN window_no - {BASELINE} >= 2 THEN 0.3 ELSE 0.0 END AS share FROM c),
j AS (SELECT *, rk <= round_even(share * in_window, 0) AS inn, CAST(floor({_u(91)} * np) AS BIGINT) AS sl FROM k, pn),
a AS (SELECT j.* REPLACE (CASE WHEN inn THEN py ELSE y END AS y, {", ".join(f"CASE WHEN inn THEN p{f} ELSE {f} END AS {f}" for f in FEATURES)}) FROM j LEFT JOIN pool ON inn AND pool.slot = j.sl), {_model_sql("a", "m")} {_rates}"""


#: Level of each change in the query below.
LEVELS = {
    "none": 1.0, "covariate_mean_shift": 0.8, "class_prior_shift": 1.95, "slope_and_intercept_drift": 0.5, "shrink_scores_to_base_rate_recalibrated": 0.4,
    "mcar_missingness": 0.5, "variable_rescale": 3.51, "outcome_model_change": 0.136, "subgroup_outcome_model_change": 0.15, "version_swap_with_regression": 0.653,
    "covariate_and_concept_drift": 0.1, "out_of_scope_use_share": 0.3,
}
#: Slope and intercept of the outcome link that the pool gives for a loss (and subgroup); tests solve them anew.
SOLVED = {
    "outcome_model_change": ((0.888842046726495, -1.7009515430719904), (0.7868586932308972, -1.6730363162994755), (0.6920003066770732, -1.652624290285847)),
    "subgroup_outcome_model_change": ((0.8741053999401629, -1.7052328335884797), (0.7573014437220991, -1.6816114320900712), (0.6473766355775297, -1.6657310444691464)),
    "covariate_and_concept_drift": ((0.9172755717299879, -1.709734414013624), (0.8398450859822333, -1.6868162747995765), (0.76680449815467, -1.668251219262971)),
    "out_of_scope_use_share": ((0.2133012250997126, -1.657995403654752),),
}
_summary = ("prevalence", "mean_p", "sensitivity", "error_rate", "mean_severity", "scope_share")


def _world_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("case_id"))


def synthetic_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered change at three stages of an incremental ramp, over a synthetic case for each event."""
    ids = _world_ids(spark, sf_dir)
    progress = (F.col("case_id") % 3 + 1) / 3.0
    parts = [
        worlds.world_summary(worlds.change(name)(ids, progress, LEVELS[name], (1 / 3, 2 / 3, 1.0)), [F.lit(name).alias("change"), (F.col("case_id") % 3).alias("stage")])
        for name in worlds.registered()
    ]
    return _r(reduce(DataFrame.unionByName, parts), *_summary)


def _world_sql() -> str:
    u, d = lambda k: uniform_sql("case_id", k), worlds.direction()
    pr, odds, norm = "((case_id % 3 + 1) / 3.0)", worlds.LOG_ODDS, sum(v * v for v in worlds.direction()) ** 0.5
    sub = f"CASE WHEN g = 1 THEN {worlds.SUBGROUP_SCALE} ELSE 1.0 END"
    sev = lambda y: _severity(y, u(3))
    lin = lambda xs: " + ".join(f"{w} * ({x})" for w, x in zip(d, xs, strict=True))
    own = list(worlds.X)
    sig = lambda z: f"(1 / (1 + exp(-({z}))))"
    out = ["i AS (SELECT event_id AS case_id FROM events)"]
    parts = []

    def solved(name: str, k: int) -> str:
        rows = SOLVED[name]
        return "CASE case_id % 3 " + " ".join(f"WHEN {n} THEN {r[k]!r}" for n, r in enumerate(rows)) + " END"

    for name in worlds.registered():
        level = LEVELS[name]
        amount, ratio = f"({level} * {pr})", f"(1 + {pr} * ({level} - 1))"
        prior = f"least({worlds.MOST_PREVALENT}, {worlds.PREVALENCE} * {ratio})" if name == "class_prior_shift" else f"{worlds.PREVALENCE}"
        flag = f"({u(306)} < least(1.0, {amount}))::INT" if name == "out_of_scope_use_share" else "0"
        move = {"covariate_mean_shift": amount, "covariate_and_concept_drift": f"({worlds.COMPOUND_SHIFT} * {pr})", "out_of_scope_use_share": f"({worlds.COMPOUND_SHIFT} * out_of_scope)"}.get(name, "0.0")
        link_ = f"({lin(own)}) * {sub}"
        y = "y"
        if name == "covariate_mean_shift":
            y = f"({u(4)} < {sig(f'{odds} + {link_}')})::INT"
        elif name in ("outcome_model_change", "covariate_and_concept_drift"):
            y = f"({u(4)} < {sig(f'{solved(name, 1)} + {solved(name, 0)} * ({link_})')})::INT"
        elif name == "subgroup_outcome_model_change":
            y = f"({u(4)} < {sig(f'CASE WHEN g = 1 THEN {solved(name, 1)} ELSE {odds} END + CASE WHEN g = 1 THEN {solved(name, 0)} ELSE 1.0 END * ({link_})')})::INT"
        elif name == "out_of_scope_use_share":
            y = f"CASE WHEN out_of_scope = 1 THEN ({u(4)} < {sig(f'{SOLVED[name][0][1]!r} + {SOLVED[name][0][0]!r} * ({link_})')})::INT ELSE y END"
        inputs, weights = list(own), [str(v) for v in d]
        if name == "mcar_missingness":
            inputs[0] = f"CASE WHEN {u(303)} < {amount} THEN {worlds.TRAIN_MEAN!r} ELSE x1 END"
        if name == "variable_rescale":
            inputs[0] = f"x1 * {ratio}"
        if name == "version_swap_with_regression":
            weights = [f"((1 - {amount}) * {a} + {amount} * {(-1) ** k * d[k ^ 1]})" for k, a in enumerate(d)]
        score = sig(f"{odds} + " + " + ".join(f"{w} * ({x})" for w, x in zip(weights, inputs, strict=True)))
        shown, last = "p", "y2"
        if name == "slope_and_intercept_drift":
            q = "least(greatest(p, 1e-9), 1 - 1e-9)"
            shown = sig(f"ln({q} / (1 - {q})) / {ratio}")
        if name == "shrink_scores_to_base_rate_recalibrated":
            shown, last = f"((1 - {amount}) * p + {amount} * {worlds.PREVALENCE})", f"({u(302)} < rp)::INT"
        k = f"w{len(parts)}"
        side = "CASE WHEN y = 1 THEN 0.5 ELSE -0.5 END"
        xs = ", ".join(f"{side} * CASE WHEN g = 1 THEN {b} ELSE {a} END + {normal_sql('case_id', 101 + n)} + {move} * {a / norm!r} AS {x}" for n, (x, a, b) in enumerate(zip(own, d, worlds.direction(1), strict=True)))
        by_shown = name == "shrink_scores_to_base_rate_recalibrated"
        out += [
            f"{k}a AS (SELECT case_id, ({u(1)} < {prior})::INT AS y, ({u(2)} < {worlds.SUBGROUP})::INT AS g, {flag} AS out_of_scope FROM i)",
            f"{k}b AS (SELECT *, {xs} FROM {k}a)",
            f"{k}c AS (SELECT *, {y} AS y2, {score} AS p FROM {k}b)",
            f"{k}d AS (SELECT *, {shown} AS rp FROM {k}c)",
            f"{k}e AS (SELECT case_id % 3 AS stage, out_of_scope, rp, {last} AS y3, ({'rp' if by_shown else 'p'} >= {worlds.THRESHOLD})::INT AS d, {sev(last)} AS sev FROM {k}d)",
        ]
        parts.append(
            f"SELECT '{name}' AS change, stage, round(avg(y3), 6) AS prevalence, round(avg(rp), 6) AS mean_p, round(sum(y3 * d)::DOUBLE / nullif(sum(y3), 0), 6) AS sensitivity, "
            f"round(avg((y3 <> d)::INT), 6) AS error_rate, round(avg(sev), 6) AS mean_severity, round(avg(out_of_scope), 6) AS scope_share FROM {k}e GROUP BY 2"
        )
    return "WITH " + ",\n".join(out) + "\n" + "\nUNION ALL ".join(parts)


def _severity(y: str, u: str) -> str:
    row = lambda p: f"CASE WHEN {u} <= {p[0]} THEN 1 WHEN {u} <= {p[0] + p[1]} THEN 2 ELSE 3 END"
    return f"CASE WHEN ({y}) = 1 THEN {row(HARM.positive)} ELSE {row(HARM.negative)} END"


SYNTHETIC_WORLD = _world_sql()


def bootstrap_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduction of delay of every system against the conventional one, with interval, p and Holm's adjustment."""
    d = classified(spark, sf_dir).select("arm", "s", "tafd")
    out = inference.holm(inference.arm_reductions(d, "arm", ["s"], "tafd", "conventional").withColumnRenamed("arm", "test"))
    return _r(out, "reduction", "lo", "hi", "p", "rho", "rho_lo", "rho_hi", "adjusted")


_pick = uniform_sql("i", f"(draw + {inference.DRAWS})")
BOOTSTRAP_ARMS = CLASSIFIED.rsplit("SELECT arm, s,", 1)[0] + f""",
dl AS (SELECT arm, s, CASE WHEN first IS NULL OR first >= t0 + 20 THEN 20 ELSE greatest(0, first - t0) END AS tafd FROM k),
pr AS (SELECT a.arm, b.tafd::DOUBLE AS ref, (b.tafd - a.tafd)::DOUBLE AS gain, row_number() OVER (PARTITION BY a.arm ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY a.arm) AS n FROM dl a JOIN dl b USING (s) WHERE b.arm = 'conventional' AND a.arm <> 'conventional'),
dr AS (SELECT arm, draw, CAST(floor({_pick} * n) AS BIGINT) AS i FROM pr, (SELECT unnest(range(2000)) AS draw)),
bo AS (SELECT arm, draw, avg(gain) AS m, avg(ref) AS r FROM dr JOIN pr USING (arm, i) GROUP BY 1, 2),
en AS (SELECT arm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg((m <= 0)::INT) AS sh, quantile_cont(m / nullif(r, 0), 0.025) AS rho_lo, quantile_cont(m / nullif(r, 0), 0.975) AS rho_hi FROM bo GROUP BY 1),
po AS (SELECT arm, count(*) AS n, avg(gain) AS reduction, avg(ref) AS r FROM pr GROUP BY 1),
al AS (SELECT arm AS test, n, reduction, lo, hi, least(1.0, 2 * least(sh, 1 - sh)) AS p, reduction / nullif(r, 0) AS rho, rho_lo, rho_hi FROM po JOIN en USING (arm)),
rk AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rk, count(*) OVER () AS mm FROM al), ad AS (SELECT *, max(least(1.0, (mm - rk + 1) * p)) OVER (ORDER BY rk) AS adjusted FROM rk)
SELECT test, n, {", ".join(f"round({c}, 6) AS {c}" for c in ("reduction", "lo", "hi", "p", "rho", "rho_lo", "rho_hi", "adjusted"))}, adjusted <= 0.05 AS reject FROM ad"""


def holm_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's adjustment over p-like numbers, a family for each subgroup."""
    t = windowed_cases(spark, sf_dir).groupBy("window", "g").agg(F.avg("p").alias("q")).select("g", F.col("window").alias("test"), (F.round("q", 9) / 50).alias("p"))
    return _r(inference.holm(t, by=["g"]), "p", "adjusted")


HOLM = f"""WITH {CASES_SQL}, t AS (SELECT g, window_no AS test, round(avg(p), 9) / 50 AS p FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, test) AS k, count(*) OVER (PARTITION BY g) AS m FROM t),
a AS (SELECT *, max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY g ORDER BY k) AS adj FROM r)
SELECT g, test, round(p, 6) AS p, round(adj, 6) AS adjusted, adj <= 0.05 AS reject FROM a"""


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_cases(spark, sf_dir).select(F.col("severity").alias("scenario"), (F.col("window") % 3).alias("cell"), F.col("p").alias("value"))
    return _r(inference.pooled_mean(df), "pooled")


POOLED = f"WITH {CASES_SQL}, a AS (SELECT severity, window_no % 3 AS cell, avg(p) AS m FROM c GROUP BY 1, 2), b AS (SELECT severity, avg(m) AS m FROM a GROUP BY 1) SELECT round(avg(m), 6) AS pooled FROM b"


def progress_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed_cases(spark, sf_dir).select("window").distinct()
    w = w.withColumn("v", S.window_progress("incremental", F.col("window"), BASELINE, 2, 6)).withColumn("one", F.lit(0))
    return _r(wn.runs(w, "v", ["one"], "window").drop("one"), "v")


PROGRESS_RUNS = f"""WITH {CASES_SQL}, k AS (SELECT DISTINCT window_no AS win FROM c), q AS (SELECT win, round(ceil(3 * ({_g}) - 1e-9) / 3.0, 6)::DOUBLE + 0.0 AS v FROM k),
n AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (ORDER BY win) OR row_number() OVER (ORDER BY win) = 1 THEN 1 ELSE 0 END AS b FROM q), r AS (SELECT *, sum(b) OVER (ORDER BY win) - 1 AS run FROM n)
SELECT run::BIGINT AS run, any_value(v) AS v, min(win) AS first, max(win) AS last, count(*) AS n FROM r GROUP BY 1"""


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess harm between a fixed onset and each system's detection."""
    ex = harm.onset_table(windowed_cases(spark, sf_dir), BASELINE).where(F.col("window") >= BASELINE)
    ex = ex.select((F.col("window") - BASELINE).alias("t"), F.greatest(F.lit(0.0), F.col("rhe") - F.col("base")).alias("excess"))
    d = classified(spark, sf_dir).select("arm", "s", (F.col("s") + 1).alias("t0"), "tafd")
    return _r(detectors.exposure(ex, d, ["arm", "s"]), "exposure")


EXPOSURE = CLASSIFIED.rsplit("SELECT arm, s,", 1)[0] + f""",
d AS (SELECT arm, s, t0, CASE WHEN first IS NULL OR first >= t0 + 20 THEN 20 ELSE greatest(0, first - t0) END AS tafd FROM k),
hm AS (SELECT *, 1000.0 * w * error * (1 - {REVIEWER.coverage} * {_seen}) AS harm FROM c), bb AS (SELECT avg(harm) AS base FROM hm WHERE window_no < {BASELINE}),
x AS (SELECT window_no - {BASELINE} AS t, greatest(0, avg(harm) - any_value(base)) AS excess FROM hm, bb WHERE window_no >= {BASELINE} GROUP BY 1)
SELECT arm, s, round(coalesce(sum(excess), 0), 6) AS exposure FROM d LEFT JOIN x ON x.t >= d.t0 AND x.t < d.t0 + d.tafd GROUP BY 1, 2"""


def chunked_harm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = harm.with_harm(windowed_cases(spark, sf_dir))
    return _r(inference.chunked_se(df, "harm", uniform(F.col("case_id"), 77)), "mean", "se")


CHUNKED = f"WITH {HARM_SQL}, a AS (SELECT floor({_u(77)} * 10) AS k, avg(harm) AS m FROM hm GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(10), 6) AS se FROM a"

QUERIES = {
    "case_windows": case_windows, "window_ratios": window_ratios, "window_auroc": window_auroc, "window_ece": window_ece, "window_ks": window_ks,
    "window_mean_shift": window_mean_shift, "window_slope": window_slope, "rolling_calibration": rolling_calibration, "overall_metrics": overall_metrics,
    "scores": scores_long, "alert_table": alert_table, "arm_events": arm_events, "alert_rates": alert_rates, "horizon_alerts": horizon_alerts,
    "classified": classified, "calibrated_arms": calibrated_arms, "block_plan": block_plan, "harm_windows": harm_windows, "onset": onset,
    "rolling_onset": rolling_onset, "onset_cusum": onset_cusum, "workflow_harm": workflow_harm, "oversight": oversight, "workflow": workflow,
    "audit": audit, "audit_stratified": audit_stratified, "schedules": schedules, "perturb_rescale": perturb_rescale, "perturb_missing": perturb_missing,
    "perturb_scope": perturb_scope, "synthetic_world": synthetic_world, "bootstrap_arms": bootstrap_arms, "holm_tests": holm_tests, "pooled_mean": pooled,
    "progress_runs": progress_runs, "exposure": exposure, "chunked_harm": chunked_harm,
}
ORACLE = {
    "case_windows": CASE_WINDOWS, "window_ratios": WINDOW_RATIOS, "window_auroc": WINDOW_AUROC, "window_ece": WINDOW_ECE, "window_ks": WINDOW_KS,
    "window_mean_shift": WINDOW_MEAN_SHIFT, "window_slope": WINDOW_SLOPE, "rolling_calibration": ROLLING, "overall_metrics": OVERALL, "scores": SCORES, "alert_table": ALERTS,
    "arm_events": ARM_EVENTS, "alert_rates": ALERT_RATES, "horizon_alerts": HORIZON, "classified": CLASSIFIED, "block_plan": BLOCK_PLAN,
    "harm_windows": HARM_WINDOWS, "onset": ONSET, "rolling_onset": ROLLING_ONSET, "onset_cusum": ONSET_CUSUM, "workflow_harm": WORKFLOW_HARM,
    "oversight": OVERSIGHT, "workflow": WORKFLOW, "audit": AUDIT, "audit_stratified": AUDIT_STRATIFIED, "schedules": SCHEDULES,
    "perturb_rescale": PERTURB_RESCALE, "perturb_missing": PERTURB_MISSING, "perturb_scope": PERTURB_SCOPE, "synthetic_world": SYNTHETIC_WORLD, "bootstrap_arms": BOOTSTRAP_ARMS, "holm_tests": HOLM, "pooled_mean": POOLED,
    "progress_runs": PROGRESS_RUNS, "exposure": EXPOSURE, "chunked_harm": CHUNKED,
}
