"""Studies over resampled streams: replicates of a change, audit designs, mixtures of failures, catalog cells. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.functions.rng import normal, normal_sql, uniform, uniform_sql
from tidewatch.operators import catalog, detectors, harm, inference, layers, model, streams
from tidewatch.operators import indicators as I
from tidewatch.operators.cases import BASELINE, CASES_SQL, HARM, REVIEWER, windowed_cases
from tidewatch.plans import assurance as A

#: Geometry of the replicates: streams, windows, baseline windows, windows of a block, horizon, threshold of the onset rule.
REPLICATES = {"streams": 150, "n_out": 48, "n_baseline": 16, "block": 4, "horizon": 16, "onset_h": 4.0}
SALT = 9


def _rescaled(df: DataFrame, progress) -> DataFrame:
    """The first feature in another unit, scored by the deployed model."""
    out = layers.rescore(layers.rescale(df.drop("p", "decision"), "x1", 6.0, progress), A.MODEL)
    out = out.withColumn("error", S.error(F.col("y"), F.col("decision")))
    return out.withColumns({"w": S.harm_weight(F.col("severity"), F.col("y"), F.col("decision"), HARM.weights, HARM.fn_factor), "confidence": S.confidence(F.col("p"), F.col("decision"))})


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay of every system in every replicate of a change of unit, from resampling to classification."""
    r = REPLICATES
    df = windowed_cases(spark, sf_dir)
    n_real = df.agg(F.max("window")).first()[0] + 1
    plan = inference.block_plan(spark, r["streams"], r["n_out"], n_real, min(r["block"], n_real), SALT)
    out = streams.replicate_delays(
        df, plan, _rescaled, detectors.arm_table(spark, A.ARM_H), list(A.RATIOS),
        n_out=r["n_out"], n_baseline=r["n_baseline"], horizon=r["horizon"], lag=A.LAG, j=A.J, onset_h=r["onset_h"],
    )
    return out.select("stream", "arm", "s0", "t0", "false_alarms", "censored", "tafd", "anticipatory", "lead_time", "carry_in")


def _replicates_sql() -> str:
    r = REPLICATES
    per, monitored = -(-r["n_out"] // r["block"]), r["n_out"] - r["n_baseline"]
    n = r["streams"] * r["n_out"]
    moved = f"(CASE WHEN win - {r['n_baseline']} >= s0 THEN 6.0 ELSE 1.0 END)"
    feats = A.FEATURES
    seen = A._seen
    out = f"""WITH RECURSIVE {CASES_SQL}, nr AS (SELECT max(window_no) + 1 AS k FROM c), bl AS (SELECT k, least({r["block"]}, k) AS b FROM nr),
g0 AS (SELECT id // {r["n_out"]} AS stream, id % {r["n_out"]} AS win, k, b FROM range({n}) t(id), bl),
g1 AS (SELECT *, stream * CAST(ceil({r["n_out"]} * 1.0 / b) AS BIGINT) + win // b AS draw FROM g0),
plan AS (SELECT stream, win, CAST(floor({uniform_sql("draw", SALT)} * (k - b + 1)) AS BIGINT) + win % b AS src, CAST(floor({uniform_sql("stream", SALT)} * {monitored}) AS BIGINT) AS s0 FROM g1),
sc AS (SELECT stream, win, s0, c.* EXCLUDE (p, decision, error, w, confidence, x1), x1 * {moved} AS x1 FROM plan JOIN c ON window_no = src),
{A._model_sql("sc", "m").replace(f"EXCLUDE ({', '.join(feats)}, p)", f"EXCLUDE ({', '.join(feats)})")},
d0 AS (SELECT *, CAST(p >= {A.MODEL["threshold"]} AS INT) AS decision FROM m),
d1 AS (SELECT *, CAST(y <> decision AS INT) AS error, CASE WHEN decision = 1 THEN p ELSE 1 - p END AS confidence,
  (CASE severity WHEN 1 THEN {HARM.weights[0]} WHEN 2 THEN {HARM.weights[1]} ELSE {HARM.weights[2]} END) * (CASE WHEN y = 1 AND decision = 0 THEN {HARM.fn_factor} ELSE 1.0 END) AS w FROM d0),
d2 AS (SELECT *, 1000.0 * w * error * (1 - {REVIEWER.coverage} * {seen}) AS harm FROM d1),
{A.ratio_sql("d2", "stream, win, s0", ", avg(harm) AS rhe, avg(CASE WHEN g = 1 THEN harm END) AS sub, avg(g) AS share")},
ons AS (SELECT stream, win, rhe AS P5, CASE WHEN share >= {HARM.min_subgroup_share} THEN sub END AS P6 FROM ind),
{A._scores_sql(("P5", "P6"), 0, "stream,", r["n_baseline"], "ons", "oz")},
of AS (SELECT stream, indicator, t, z, greatest(0, z - {detectors.K_REF}) AS s FROM oz WHERE t = 0
  UNION ALL SELECT oz.stream, oz.indicator, oz.t, oz.z, greatest(0, CASE WHEN of.s > {r["onset_h"]} THEN 0 ELSE of.s END + oz.z - {detectors.K_REF}) FROM of JOIN oz ON oz.stream = of.stream AND oz.indicator = of.indicator AND oz.t = of.t + 1),
oe AS (SELECT stream, t, bool_or(s > {r["onset_h"]}) AS event FROM of GROUP BY 1, 2),
os AS (SELECT stream, t, {A._episode_sql("event", "stream")} AS st FROM oe),
t0 AS (SELECT stream, min(t) AS t0 FROM os WHERE st GROUP BY 1 HAVING min(t) + {r["horizon"]} <= {monitored}),
{A._scores_sql(A.RATIOS, A.LAG, "stream,", r["n_baseline"])}, {A._arms},
zh AS (SELECT stream, arm, z.indicator, t, z, h FROM z JOIN arms USING (indicator)),
{A.FOLD_SQL.format(key="stream, arm, indicator", qkey="zh.stream, zh.arm, zh.indicator", on="zh.stream = f.stream AND zh.arm = f.arm AND zh.indicator = f.indicator")},
ev AS (SELECT stream, arm, t, bool_or(s > h) AS event FROM f GROUP BY 1, 2, 3),
st AS (SELECT *, {A._episode_sql("event", "stream, arm")} AS st FROM ev),
ss AS (SELECT stream, max(s0) AS s0, any_value(t0) AS t0 FROM ind JOIN t0 USING (stream) GROUP BY 1),
k AS (SELECT stream, arm, s0, t0, sum((st AND t < s0)::INT) AS fa, min(CASE WHEN event AND t >= s0 THEN t END) AS first, coalesce(bool_or(event AND t < s0 AND t >= s0 - {A.J}), false) AS carry_in FROM st JOIN ss USING (stream) GROUP BY 1, 2, 3, 4)
SELECT stream, arm, s0, t0, fa::BIGINT AS false_alarms, (first IS NULL OR first >= t0 + {r["horizon"]}) AS censored, CASE WHEN first IS NULL OR first >= t0 + {r["horizon"]} THEN {r["horizon"]} ELSE greatest(0, first - t0) END::BIGINT AS tafd,
  coalesce(first < t0, false) AS anticipatory, CASE WHEN first < t0 THEN t0 - first ELSE 0 END::BIGINT AS lead_time, carry_in FROM k"""
    assert per > 0
    return out


def arm_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean delay saved by every system against the conventional one, in windows and relative to its mean delay."""
    d = replicates(spark, sf_dir)
    return A._r(inference.reductions(d, "arm", ["stream"], "tafd", "conventional"), "reduction", "rho")


def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate values kept under a text key, read back as paired differences by scenario and cell."""
    d = A.classified(spark, sf_dir)
    key = F.concat_ws("|", F.concat(F.lit("S"), F.col("s") % 3), F.when(F.col("s") % 2 == 0, "high").otherwise("low"), F.lit("abrupt"), F.lit(str(A.LAG)), "arm")
    store = d.groupBy(key.alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "tafd"))), lambda x: x["tafd"].cast("double")).alias("values"))
    out = catalog.paired_differences(store, ["S0", "S1"], A.LAG, "conventional", "union")
    return out.select("scenario", "cell", "replicate", F.round("value", 6).alias("value"))


def audit_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias, root mean square error and coverage of the audit estimate, and the naive figure's, over replicates of 500
    cases, for two sampling fractions."""
    df = layers.review(windowed_cases(spark, sf_dir)).withColumn("rep", F.floor(F.col("window") / 5))
    parts = [inference.ehor_by(inference.audit_weights(df, f, 70 + k, False), ["rep"], 0.3).withColumn("fraction", F.lit(f)) for k, f in enumerate((0.05, 0.2))]
    out = inference.estimate_summary(parts[0].unionByName(parts[1]), ["fraction"])
    return A._r(out, *(c for c in out.columns if c != "fraction"))


AUDIT_STUDY = f"""WITH {A.REVIEW_SQL}, fr(fraction, k) AS (VALUES (0.05, 70), (0.2, 71)),
a AS (SELECT fraction, window_no // 5 AS rep, rv.*, CASE WHEN CASE k WHEN 70 THEN {uniform_sql("case_id", 70)} ELSE {uniform_sql("case_id", 71)} END < fraction THEN 1 / fraction ELSE 0 END::DOUBLE AS weight FROM rv, fr),
t AS (SELECT fraction, rep, coalesce(sum((intercepted AND required)::INT)::DOUBLE / nullif(sum(required::INT), 0), 0) AS truth,
  coalesce(sum(CASE WHEN intercepted AND required THEN weight ELSE 0 END) / nullif(sum(CASE WHEN required THEN weight ELSE 0 END), 0), 0) AS ht, sum(CASE WHEN required THEN weight ELSE 0 END) AS n,
  coalesce(sum((intercepted AND required)::INT)::DOUBLE / nullif(sum((intercepted AND required)::INT) + 0.3 * sum((required AND NOT intercepted)::INT), 0), 0) AS naive FROM a GROUP BY 1, 2),
s AS (SELECT fraction, rep, sqrt(sum(CASE WHEN weight > 0 AND required THEN weight * (weight - 1) * pow(intercepted::INT - ht, 2) ELSE 0 END)) / nullif(any_value(n), 0) AS se FROM a JOIN t USING (fraction, rep) GROUP BY 1, 2)
SELECT fraction::DOUBLE AS fraction, count(*) AS replicates, round(avg(truth), 6) AS truth, round(avg(ht - truth), 6) AS bias, round(sqrt(avg((ht - truth) * (ht - truth))), 6) AS rmse, round(avg(coalesce(abs(ht - truth) <= 1.96 * se, false)::INT), 6) AS coverage,
  round(avg(naive - truth), 6) AS naive_bias, round(sqrt(avg((naive - truth) * (naive - truth))), 6) AS naive_rmse FROM t JOIN s USING (fraction, rep) GROUP BY 1"""


# --- mixtures of reviewer failures ---------------------------------------------------------------------------------------

#: Kinds of failure and their levels; streams and their windows.
KINDS = {"bias": (0.10, 0.25, 0.40), "coverage": (0.9, 0.7, 0.4), "false_reject": (0.05, 0.1, 0.2), "latency": (1.5, 2.0, 3.0)}
MIXED = {"streams": 60, "n_out": 40, "n_baseline": 12, "low": 2, "high": 16}


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MIXED
    windows = layers.mixture_schedule(spark, m["streams"], m["n_out"], m["n_baseline"], KINDS, m["low"], m["high"])
    return layers.mixture_labels(windows, harm.with_weighted_errors(windowed_cases(spark, sf_dir)))


def mixture_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer parameters of every window of streams with one or two failures, harm ratio and label."""
    return A._r(_mixture(spark, sf_dir).withColumnRenamed("window", "win"), "bias", "coverage", "false_reject", "latency", "ratio")


def _mixture_sql() -> str:
    m, kinds = MIXED, list(KINDS)
    u = lambda k: uniform_sql("stream", k)
    first, step = f"CAST(floor({u(400)} * {len(kinds)}) AS INT)", f"CAST(floor({u(401)} * {len(kinds) - 1}) AS INT)"
    start = lambda k: f"{m['low']} + CAST(floor({u(k)} * {m['high'] - m['low'] + 1}) AS INT)"
    base = {"bias": REVIEWER.bias, "coverage": REVIEWER.coverage, "false_reject": REVIEWER.false_reject, "latency": REVIEWER.latency}
    cols = []
    for k, (name, levels) in enumerate(KINDS.items()):
        expr = f"{float(base[name])}"
        for kind, draw, at, on in (("k1", 404, "s1", "true"), ("k2", 406, "s2", "two")):
            pick = "CASE CAST(floor(" + u(draw) + f" * {len(levels)}) AS INT) " + " ".join(f"WHEN {n} THEN {layers.failed(name, v, base)}" for n, v in enumerate(levels)) + " END"
            expr = f"CASE WHEN {on} AND {kind} = {k} AND win >= {m['n_baseline']} + {at} THEN {pick} ELSE {expr} END"
        cols.append(f"({expr})::DOUBLE AS {name}")
    seen = f"(1 / (1 + exp(-({REVIEWER.beta0} + {REVIEWER.beta_confidence} * (1 - confidence) + {REVIEWER.beta_severity} * (severity - 1)))))"
    return f"""WITH {CASES_SQL}, pop AS (SELECT avg(w * error) AS a, avg(w * error * {seen}) AS b FROM c),
st AS (SELECT id AS stream FROM range({m["streams"]}) t(id)),
dr AS (SELECT stream, {first} AS k1, ({first} + 1 + {step}) % {len(kinds)} AS k2, {u(402)} < 0.5 AS two, {start(405)} AS s1, {start(407)} AS s2 FROM st),
wi AS (SELECT stream, win, {", ".join(cols)} FROM dr, (SELECT id AS win FROM range({m["n_out"]}) t(id))),
ra AS (SELECT *, (a - coverage * (1 - bias) * b) / (a - {REVIEWER.coverage} * (1 - {REVIEWER.bias}) * b) AS ratio FROM wi, pop)
SELECT stream, win, round(bias, 6) AS bias, round(coverage, 6) AS coverage, round(false_reject, 6) AS false_reject, round(latency, 6) AS latency, round(ratio, 6) AS ratio, (ratio >= {1 + HARM.kappa})::INT AS y FROM ra"""


def mixture_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC for harmful windows from outcome-free oversight scores alone and with the outcome-based ones, on held-out
    streams. Streams are review draws over resampled windows under the schedule's parameters."""
    m = MIXED
    df = windowed_cases(spark, sf_dir)
    n_real = df.agg(F.max("window")).first()[0] + 1
    plan = inference.block_plan(spark, m["streams"], m["n_out"], n_real, min(4, n_real), 3)
    both = inference.resampled(df, plan).join(_mixture(spark, sf_dir), ["stream", "window"])
    reviewed = layers.review_under(both, ident=F.col("case_id") * 4096 + F.col("stream"))
    wide = I.oversight(reviewed, ["stream", "window"])
    names = ["H1", "H2", "H3", "H4", "H5", "H6"]
    z = detectors.scores(I.long_form(wide, names, ["stream", "window"]), m["n_baseline"], A.LAG, ["stream"])
    table = z.groupBy("stream", "t").agg(*(F.max(F.when(F.col("indicator") == n, F.col("z"))).alias(n) for n in names))
    labels = _mixture(spark, sf_dir).select("stream", (F.col("window") - m["n_baseline"]).alias("t"), "y").where("t >= 0")
    table = table.join(labels, ["stream", "t"]).persist()
    try:
        fit, held = table.where("stream % 2 = 0"), table.where("stream % 2 = 1")
        scored = [layers.rescore(held, model.fit_plain(fit, cols, "y")).select("stream", "t", "y", "p") for cols in (["H1", "H2"], names)]
        out = model.auroc_gain(*scored).collect()
    finally:
        table.unpersist()
    return A._r(spark.createDataFrame(out, "auroc_base double, auroc_full double, gain double, lo double, hi double, p double"), "auroc_base", "auroc_full", "gain", "lo", "hi", "p")


# --- fitted models and versions ------------------------------------------------------------------------------------------


def fitted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted on the first fifth of the windows (penalty by fold loss, threshold by sensitivity) on all later ones."""
    df = windowed_cases(spark, sf_dir)
    last = df.agg(F.max("window")).first()[0]
    fitted = model.fit_real(df.where(F.col("window") <= last // 5), list(A.FEATURES), "y")
    scored = layers.rescore(df.where(F.col("window") > last // 5).drop("p", "decision"), fitted)
    y, d = F.col("y"), F.col("decision")
    out = scored.groupBy("window").agg(F.avg("p").alias("mean_p"), F.avg(y.cast("double")).alias("rate"), I.ratio(F.sum(y * d), F.sum(y)).alias("sensitivity"))
    return A._r(out.join(I.auroc(scored, ["window"], name="auroc"), "window").withColumnRenamed("window", "win"), "mean_p", "rate", "sensitivity", "auroc")


#: Two versions of the deployed model; the second's weights are turned by half towards a direction at right angles.
VERSIONS = {"v1": A.MODEL, "v2": A.MODEL | {"weights": {"x1": 0.15, "x2": 0.75, "x3": 0.45}, "intercept": -0.1}}
REGRESSION = {"s0": 2, "ramp": 6}


def version_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case stream under a rollout of a worse version: coefficients by window, mixed by progress, joined to the cases."""
    df = windowed_cases(spark, sf_dir)
    progress = S.window_progress("gradual", F.col("window"), BASELINE, REGRESSION["s0"], REGRESSION["ramp"])
    schedule = df.select("window").distinct().withColumns({"version": F.lit("v1"), "version_to": F.lit("v2"), "share": progress})
    mixed = model.mix_versions(schedule, model.versions(spark, VERSIONS))
    scored = model.score_versions(df.drop("p", "decision"), mixed, list(A.FEATURES))
    y, d = F.col("y"), F.col("decision")
    out = scored.groupBy("window").agg(F.avg("p").alias("mean_p"), I.ratio(F.sum(y * d), F.sum(y)).alias("sensitivity"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"))
    return A._r(out.withColumnRenamed("window", "win"), "mean_p", "sensitivity", "brier")


def _versions_sql() -> str:
    mix = lambda a, b: f"((1 - pr) * {a} + pr * {b})"
    a, b = VERSIONS["v1"], VERSIONS["v2"]
    clean = lambda f: f"((least(greatest({f}, {a['bounds'][f][0]}), {a['bounds'][f][1]}) - {a['means'][f]}) / {a['sds'][f]})"
    z = " + ".join([mix(a["intercept"], b["intercept"]), *(f"{mix(a['weights'][f], b['weights'][f])} * {clean(f)}" for f in A.FEATURES)])
    return f"""WITH {CASES_SQL}, q AS (SELECT * EXCLUDE (p, decision), {A._prog} AS pr FROM c), m AS (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM q), d AS (SELECT *, (p >= {a["threshold"]})::INT AS decision FROM m)
SELECT window_no AS win, round(avg(p), 6) AS mean_p, round(sum(y * decision)::DOUBLE / nullif(sum(y), 0), 6) AS sensitivity, round(avg((p - y) * (p - y)), 6) AS brier FROM d GROUP BY 1"""


# --- cohorts and catalogs ------------------------------------------------------------------------------------------------


def synthetic_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort with the schema of a feature table, a row for each customer."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("order_key"))
    out = layers.synthetic_cohort(ids, ["f0", "f1", "f2"])
    return A._r(out, "f0", "f1", "f2")


_mu = (0.3, 0.45, 0.6)
SYNTHETIC_COHORT = f"""WITH a AS (SELECT c_custkey AS order_key, ({uniform_sql("c_custkey", 500)} < 0.2)::INT AS label, ({uniform_sql("c_custkey", 501)} < 0.5)::INT AS subgroup FROM customer)
SELECT order_key, label, subgroup, {", ".join(f"round((CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END) * {v} + {normal_sql('order_key', 502 + k)}, 6) AS f{k}" for k, v in enumerate(_mu))} FROM a"""

#: Scenarios of a small catalog: id, type, family, purpose, whether delays are primary, shapes.
CATALOG = [
    ("S0", "none", "control", "control", False, ["abrupt"]), ("S1", "class_prior_shift", "data", "fair_test", True, ["abrupt", "gradual"]),
    ("S2", "variable_rescale", "data", "blind_spot", True, ["abrupt", "gradual"]), ("S3", "out_of_scope_use_share", "use", "fair_test", True, ["gradual", "incremental"]),
    ("S4", "covariate_mean_shift", "data", "harmless_drift", False, ["abrupt"]), ("S5", "unheard_of", "data", "fair_test", True, ["abrupt"]),
    ("S6", "outcome_model_change", "model", "fair_test", False, ["abrupt"]),
]


def catalog_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the catalog that are studied: for delays, and for alert rates under harmless drift."""
    rows = spark.createDataFrame(CATALOG, "id string, type string, family string, purpose string, primary boolean, shapes array<string>")
    from tidewatch.operators import worlds

    return catalog.cells(rows, worlds.registered())


CATALOG_CELLS = """SELECT * FROM (VALUES ('tafd', 'S1', 'medium', 'abrupt'), ('tafd', 'S1', 'high', 'abrupt'), ('tafd', 'S1', 'high', 'gradual'), ('tafd', 'S2', 'medium', 'abrupt'), ('tafd', 'S2', 'high', 'abrupt'),
('tafd', 'S3', 'medium', 'gradual'), ('tafd', 'S3', 'high', 'gradual'), ('alert', 'S4', 'high', 'abrupt')) t(kind, id, level, shape)"""


def harm_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harm under each of nine levels of a change of unit over harm unchanged: the grid that levels are solved on."""
    df = windowed_cases(spark, sf_dir).where(F.col("window") < BASELINE)
    pop = layers.rescore(df.drop("p", "decision"), A.MODEL)
    levels = [1 + k * 0.5 for k in range(9)]

    def change(cases: DataFrame, level) -> DataFrame:
        return layers.rescore(cases.drop("p", "decision").withColumn("x1", F.col("x1") * level), A.MODEL)

    def harmed(cases: DataFrame) -> DataFrame:
        out = cases.withColumn("error", S.error(F.col("y"), F.col("decision")))
        return harm.with_harm(out.withColumn("w", S.harm_weight(F.col("severity"), F.col("y"), F.col("decision"), HARM.weights, HARM.fn_factor)))

    got = model.ratios_for(pop, harmed, change)(levels)
    return A._r(spark.createDataFrame(list(zip(levels, got, strict=True)), "level double, ratio double"), "ratio")


def _levels_sql() -> str:
    h = f"1000.0 * w2 * e2 * (1 - {REVIEWER.coverage} * (1 / (1 + exp(-({REVIEWER.beta0} + {REVIEWER.beta_confidence} * (1 - CASE WHEN d2 = 1 THEN p ELSE 1 - p END) + {REVIEWER.beta_severity} * (severity - 1))))))"
    w = f"(CASE severity WHEN 1 THEN {HARM.weights[0]} WHEN 2 THEN {HARM.weights[1]} ELSE {HARM.weights[2]} END) * (CASE WHEN y = 1 AND d2 = 0 THEN {HARM.fn_factor} ELSE 1.0 END)"
    return f"""WITH {CASES_SQL}, lv AS (SELECT 1 + id * 0.5 AS level FROM range(9) t(id)), cl AS (SELECT * REPLACE (coalesce(least(greatest(x1, -0.45), 0.55), 0.05) AS x1) FROM c WHERE window_no < {BASELINE}),
a AS (SELECT level, cl.* REPLACE (x1 * level AS x1) FROM cl, lv), {A._model_sql("a", "m")},
d AS (SELECT *, CAST(p >= {A.MODEL["threshold"]} AS INT) AS d2 FROM m), e AS (SELECT *, CAST(y <> d2 AS INT) AS e2, {w} AS w2 FROM d), hh AS (SELECT level, avg({h}) AS h FROM e GROUP BY 1)
SELECT level::DOUBLE AS level, round(h / (SELECT h FROM hh WHERE level = 1), 6) AS ratio FROM hh"""


QUERIES = {
    "replicates": replicates, "arm_reductions": arm_reductions, "paired_differences": paired_differences, "audit_study": audit_study,
    "fitted_model": fitted_model, "version_regression": version_regression, "mixture_windows": mixture_windows, "mixture_gain": mixture_gain, "synthetic_cohort": synthetic_cohort, "catalog_cells": catalog_cells, "harm_levels": harm_levels,
}
_REPLICATES = _replicates_sql()
ORACLE = {
    "replicates": _REPLICATES,
    "arm_reductions": _REPLICATES.rsplit("SELECT stream, arm,", 1)[0] + f""", dl AS (SELECT stream, arm, CASE WHEN first IS NULL OR first >= t0 + {REPLICATES["horizon"]} THEN {REPLICATES["horizon"]} ELSE greatest(0, first - t0) END AS tafd FROM k),
pr AS (SELECT a.arm, a.tafd AS c, b.tafd AS r FROM dl a JOIN dl b ON a.stream = b.stream AND b.arm = 'conventional' WHERE a.arm <> 'conventional')
SELECT arm, count(*) AS n, round(avg(r) - avg(c), 6) AS reduction, round((avg(r) - avg(c)) / nullif(avg(r), 0), 6) AS rho FROM pr GROUP BY 1""",
    "paired_differences": A.CLASSIFIED.rsplit("SELECT arm, s,", 1)[0] + """, dl AS (SELECT arm, s, 'S' || (s % 3) AS scenario, CASE WHEN s % 2 = 0 THEN 'high' ELSE 'low' END || '|abrupt' AS cell,
  row_number() OVER (PARTITION BY arm, s % 3, s % 2 ORDER BY s) - 1 AS replicate, CASE WHEN first IS NULL OR first >= t0 + 20 THEN 20 ELSE greatest(0, first - t0) END AS tafd FROM k)
SELECT a.scenario, a.cell, a.replicate::INT AS replicate, (a.tafd - b.tafd)::DOUBLE AS value FROM dl a JOIN dl b USING (scenario, cell, replicate) WHERE a.arm = 'conventional' AND b.arm = 'union' AND a.scenario IN ('S0', 'S1')""",
    "audit_study": AUDIT_STUDY, "version_regression": _versions_sql(), "mixture_windows": _mixture_sql(), "synthetic_cohort": SYNTHETIC_COHORT, "catalog_cells": CATALOG_CELLS, "harm_levels": _levels_sql(),
}
