"""Every query with SQL against DuckDB on the smallest tables, and the fixed vectors of the operators."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewatch.functions import scalar as S
from tidewatch.functions.rng import uniform
from tidewatch.operators import calibration, catalog, detectors, features, inference, layers, model, worlds
from tidewatch.operators import indicators as I
from tidewatch.operators import windows as wn
from tidewatch.operators.cases import FEATURES, windowed_cases
from tidewatch.operators.streams import NAMES
from tidewatch.plans import assurance, registry
from tidewatch.sources import readers
from tidewatch.streaming.cusum import streaming_cusum

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


# --- fixed vectors ---------------------------------------------------------------------------------------------------------


def series(spark, values, name="P5"):
    return spark.createDataFrame([(name, t, float(v)) for t, v in enumerate(values)], "indicator string, t long, z double")


def test_cusum_vector(spark):
    out = detectors.cusum(series(spark, [2.0] * 16), 5.0, ["indicator"]).where("alarm").orderBy("t")
    assert [r.t for r in out.collect()] == [3, 7, 11, 15]
    assert np.flatnonzero(detectors.cusum_array(np.full((16, 1), 2.0), 5.0)[:, 0]).tolist() == [3, 7, 11, 15]


@pytest.mark.parametrize("j,want", [(2, [1, 6]), (1, [1, 6, 8])])
def test_episode_vector(spark, j, want):
    df = spark.createDataFrame([(0, t, t in (1, 2, 6, 8)) for t in range(10)], "k int, t int, e boolean")
    out = df.withColumn("s", wn.episode_start(F.col("e"), j, ["k"], "t")).where("s").orderBy("t")
    assert [r.t for r in out.collect()] == want
    assert np.flatnonzero(detectors.starts(np.isin(np.arange(10), (1, 2, 6, 8)), j)).tolist() == want


@pytest.mark.parametrize("lag,want", [(2, range(2, 8)), (0, range(4, 10))])
def test_label_lag_reaches_into_the_baseline(spark, lag, want):
    df = spark.createDataFrame([(0, t, float(t)) for t in range(10)], "k int, window int, z double")
    out = df.withColumn("z", wn.lagged(F.col("z"), lag, ["k"])).where("window >= 4").orderBy("window")
    assert [int(r.z) for r in out.collect()] == list(want)


def test_standardize_missing_is_no_evidence(spark):
    rows = [(0, w, 5.0 + (-1) ** w) for w in range(20)] + [(0, 20 + w, 9.0) for w in range(6)] + [(0, 26, None)]
    df = spark.createDataFrame(rows, "k int, window int, x double")
    out = df.withColumn("z", wn.standardize(F.col("x"), F.col("window") < 20, F.lit(1), wn.W.partitionBy("k"))).orderBy("window").collect()
    assert all(r.z > 3 for r in out[20:26]) and out[26].z == 0.0


@pytest.mark.parametrize(
    "events,tafd,censored,false_alarms,carry",
    [([], 20, True, 0, False), ([15], 3, False, 0, False), ([11], 0, False, 0, False), ([39], 20, True, 0, False), ([3, 9, 20], 8, False, 2, True)],
)
def test_classification_vectors(spark, events, tafd, censored, false_alarms, carry):
    df = spark.createDataFrame([(0, t, t in events, 10, 12) for t in range(40)], "rep int, t int, event boolean, s0 int, t0 int")
    r = detectors.classify(df, ["rep"], "s0", "t0", 20, 2).first()
    assert (r.tafd, r.censored, r.false_alarms, r.carry_in) == (tafd, censored, false_alarms, carry)


def test_progress_vectors(spark):
    df = spark.range(10).withColumn("t", F.col("id").cast("int"))
    take = lambda shape, s0, ramp: [r[0] for r in df.select(S.progress(shape, F.col("t"), s0, ramp)).collect()]
    assert take("abrupt", 3, 1)[:8] == [0, 0, 0, 1, 1, 1, 1, 1]
    assert take("gradual", 2, 4)[2] == 0.25 and take("gradual", 2, 4)[5] == 1.0
    assert {round(v, 6) for v in take("incremental", 2, 6)} == {0.0, 0.333333, 0.666667, 1.0}
    with pytest.raises(ValueError):
        S.progress("odd", F.col("t"), 0, 1)


def test_suppression_vectors(spark):
    df = spark.createDataFrame([(0, 5000, 900), (1, 9, 2), (2, 12, 4), (3, 0, 0), (4, 10, 10), (5, 9, 500)], "k int, n int, c int")
    out = [(r.n, r.c) for r in features.suppressed(df, ["n", "c"]).orderBy("k").collect()]
    assert out == [(5000, 900), (None, None), (12, None), (None, None), (10, 10), (None, None)]


def test_holm_vectors(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", float("nan"))], "test string, p double")
    out = {r.test: (r.adjusted, r.reject) for r in inference.holm(df).collect()}
    assert {k: round(v[0], 6) for k, v in out.items() if v[0] is not None} == {"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06}
    assert [k for k, v in out.items() if v[1]] == ["d", "a"] or {k for k, v in out.items() if v[1]} == {"a", "d"}


def test_pooled_vector(spark):
    df = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 3.0), ("B", 0, 4.0)], "scenario string, cell int, value double")
    assert inference.pooled_mean(df).first()[0] == 3.0
    assert inference.pooled_bootstrap(df, 2.5).first().p == 0.0 and inference.pooled_bootstrap(df, 3.5).first().p == 1.0


def test_levels_and_budget(spark):
    df = spark.createDataFrame([(t,) for t in ("0.25 SD", "1.5x", "slope 0.9", "5 pct")], "t string")
    assert [r[0] for r in df.select(S.parse_level(F.col("t"))).collect()] == [0.25, 1.5, 0.9, 0.05]
    assert S.format_level("1.5x", 2.3456) == "2.35x"
    with pytest.raises(ValueError):
        S.window_days(0, 1)


def test_windows_drop_the_remainder_and_keep_ties_in_order(spark):
    df = spark.createDataFrame([(i, i // 40) for i in range(133)], "id int, k int")
    out = wn.assign_windows(df, "k", "id", 50).orderBy("id").collect()
    assert len(out) == 100 and [r.window * 50 + r.pos for r in out] == list(range(100))


def least_by_hand(cube, names, target, j):
    """Least threshold that meets the target, by trying one threshold after the other."""
    for h in np.geomspace(0.2, 20, 4000):
        event = detectors.cusum_array(cube[..., names], h).any(-1)
        if 1000 * detectors.starts(event, j).mean() <= target:
            return h


def test_calibration_meets_the_target(spark):
    rng = np.random.default_rng(2)
    cube = rng.normal(size=(60, 40, 12))
    rows = [(s, t, n, float(cube[s, t, k])) for s in range(60) for t in range(40) for k, n in enumerate(NAMES)]
    z = spark.createDataFrame(rows, "stream long, t long, indicator string, z double")
    got = {(r.arm, r.component): r.h for r in calibration.calibrate_arms(z, 20.0, 2).collect()}
    for arm in ("harm", "input", "union"):
        want = least_by_hand(cube, [NAMES.index(n) for n in detectors.FLAT_ARMS[arm]], 20.0, 2)
        assert got[arm, "all"] == pytest.approx(want, rel=2e-3)
    parts = detectors.SPLIT_ARMS["split"]
    event = np.any([detectors.cusum_array(cube[..., [NAMES.index(n) for n in names]], got["split", c]).any(-1) for c, names in parts.items()], axis=0)
    assert 17 < 1000 * detectors.starts(event, 2).mean() <= 20


def rate_by_hand(cube, h, j):
    """Starts in all streams, window by window; h: a threshold for each indicator."""
    n = 0
    for z in cube:
        s, last = [0.0] * z.shape[1], None
        for t, row in enumerate(z):
            event = False
            for k, v in enumerate(row):
                s[k] = max(0.0, s[k] + v - 0.5)
                if s[k] > h[k]:
                    s[k], event = 0.0, True
            if event:
                n += last is None or t - last > j
                last = t
    return n


def test_calibrated_thresholds_are_exact(spark):
    """Every threshold against counting at each value that a CUSUM takes: the least from which on the budget is kept."""
    rng = np.random.default_rng(8)
    cube = np.round(rng.normal(size=(9, 25, 12)), 2)
    rows = [(s, t, n, float(cube[s, t, k])) for s in range(9) for t in range(25) for k, n in enumerate(NAMES)]
    z = spark.createDataFrame(rows, "stream long, t long, indicator string, z double").repartition(3)
    target, j = 60.0, 2
    budget = target * 9 * 25 / 1000
    got = {(r.arm, r.component): r for r in calibration.calibrate_arms(z, target, j).collect()}
    col = lambda names: [NAMES.index(n) for n in names]

    def least(names, allowed):
        own = cube[..., col(names)]
        tried = sorted({0.2, *(float(v) for s in own for one in s.T for v in calibration.levels(one))})
        over = [k for k, h in enumerate(tried) if rate_by_hand(own, [h] * len(names), j) > allowed]
        return tried[over[-1] + 1] if over else 0.2

    for arm in ("conventional", "harm", "input"):
        assert (got[arm, "all"].h, got[arm, "all"].met) == (least(detectors.FLAT_ARMS[arm], budget), True)
    parts, best = detectors.SPLIT_ARMS["split"], None
    for allowed in [0.3 * budget / 3, *(n for n in range(1, 200) if 0.3 * budget / 3 <= n <= budget)]:
        h = {c: least(names, allowed) for c, names in parts.items()}
        names = [n for ns in parts.values() for n in ns]
        if best and rate_by_hand(cube[..., col(names)], [h[c] for c, ns in parts.items() for _ in ns], j) > budget:
            break
        best = h
    assert {c: got["split", c].h for c in parts} == best


def test_cusum_over_batches(spark):
    """Series cut by batches carry on, and thresholds may differ by row."""
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", t, float(v), 1.5 + k % 3) for k in range(7) for t, v in enumerate(rng.normal(0.5, 1, 40 + 7 * k))]
    df = spark.createDataFrame(rows, "indicator string, t long, z double, h double")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "11")
    try:
        got = {(r.indicator, r.t): (r.s, r.alarm) for r in detectors.cusum(df, F.col("h"), ["indicator"]).collect()}
        alone = [r.s for r in detectors.cusum(df.where("indicator = 's0'"), F.col("h"), []).orderBy("t").collect()]
    finally:
        spark.conf.set(setting, old)
    s, name = 0.0, None
    for k, t, v, h in rows:
        s = max(0.0, (s if k == name else 0.0) + v - 0.5)
        assert got[k, t] == (pytest.approx(s, abs=1e-12), s > h)
        name, s = k, 0.0 if s > h else s
    assert alone == [got["s0", t][0] for t in range(40)]


def test_a_level_equal_to_its_threshold_is_no_alarm(spark):
    """0.8 - 0.5 is a last bit over 0.3; such a bit must not decide."""
    got = detectors.cusum(series(spark, [0.8, 0.5, 0.6]), 0.3, ["indicator"]).orderBy("t").collect()
    assert [r.alarm for r in got] == [False, False, True]
    assert [r.s for r in got] == pytest.approx([0.3, 0.3, 0.4])


def test_halves_of_texts_and_sources_without_text_as_in_sql(spark, tmp_path):
    """7.5 letters are 8: the half of the first text is then not in the second one."""
    docs = [(1, "The it of ensh."), (2, "the it was"), (3, None), (4, "abc"), (5, "ab")]
    pd.DataFrame(docs, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([("item", "x"), ("item-3", "x"), ("item-4", "z")], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = registry.QUERIES["quote_check"](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLE["quote_check"]).df()
    assert ("quote not found", "1") in cells(got)
    assert cells(got) == cells(want)


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(wn, "BRACKET", 50)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=30_000), np.round(rng.exponential(size=30_000), 1)
    df = spark.createDataFrame([(float(x), float(y) if k % 7 else None, None) for k, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, c double")
    got = wn.quantiles(df, {"a": [0.0, 0.001, 1 / 3, 0.75, 1.0], "b": [0.1, 0.5, 0.999], "c": [0.5]})
    keep = b[np.arange(30_000) % 7 != 0]
    assert np.allclose(got["a"], np.quantile(a, [0.0, 0.001, 1 / 3, 0.75, 1.0])) and np.allclose(got["b"], np.quantile(keep, [0.1, 0.5, 0.999])) and got["c"] == [None]


def test_position_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(wn, "RANGE_ROWS", 40)
    df = spark.range(3000).selectExpr("id", "id * 7919 % 1013 AS k")
    out = wn.global_position(df, "k", "id").orderBy("k", "id").collect()
    assert [r.pos for r in out] == list(range(3000))


def test_uniforms_of_two_salts_are_independent(spark):
    u = spark.range(4000).select(uniform(F.col("id"), 3).alias("a"), uniform(F.col("id"), 4).alias("b")).toPandas()
    assert abs(np.corrcoef(u.a, u.b)[0, 1]) < 0.05 and abs(u.a.mean() - 0.5) < 0.02


def test_newton_recovers_the_slope():
    rng = np.random.default_rng(0)
    z = rng.normal(size=20_000)
    p = 1 / (1 + np.exp(-z))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-0.6 * z))).astype(float)
    assert abs(I.newton_slope(y, p)[1] - 0.6) < 0.05


def test_slope_in_the_engine_equals_newton(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.random() < 0.4), float(p)) for k in range(4) for p in np.clip(rng.beta(2, 3, 120), 0, 1)] + [(9, 1, 0.3), (9, 1, 0.8)]
    got = {r.k: r.U3 for r in I.slope_deviation(spark.createDataFrame(rows, "k int, y int, p double"), ["k"]).collect()}
    for k in range(4):
        y, p = (np.array([r[c] for r in rows if r[0] == k], float) for c in (1, 2))
        assert got[k] == pytest.approx(abs(I.newton_slope(y, p)[1] - 1), abs=1e-9)
    assert set(got) == {0, 1, 2, 3, 9}


def test_area_of_large_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), int(y), float(p)) for g, y, p in zip(rng.integers(0, 3, 900), rng.integers(0, 2, 900), np.round(rng.random(900), 2), strict=True)] + [(7, 1, 0.5)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    want = {r.g: r.P4 for r in I.auroc(df, ["g"]).collect()}
    assert {r.g: r.P4 for r in I.auroc_of_large(df, ["g"]).collect()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_place_in_a_bucket_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(wn, "RANGE_ROWS", 50)
    df = spark.range(2000).selectExpr("id", "id * 7919 % 1013 AS k", "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS bucket")
    out = wn.composite_order(df, "bucket", "k", "id", {"a": 0, "b": 1}).orderBy("bucket", "k", "id").collect()
    n = {"a": 1800, "b": 200}
    assert [r.combined_order for r in out] == [pytest.approx(("ab".index(b)) + k / n[b]) for b in "ab" for k in range(n[b])]


def test_rollup_vector(spark):
    ts = "timestamp '2020-01-01 {}:00:00'"
    r = spark.sql(f"SELECT 1 AS stay, {ts.format('01')} AS time, 1 AS item, 80.0D AS value UNION ALL SELECT 1, {ts.format('02')}, 1, 90.0D UNION ALL SELECT 1, {ts.format('05')}, 1, 1.0D")
    c = spark.sql(f"SELECT 1 AS stay, {ts.format('00')} AS start, {ts.format('05')} AS stop UNION ALL SELECT 2, {ts.format('00')}, {ts.format('05')}")
    inside = features.readings_in_window(features.map_items(r, {"hr": (1,)}), c, "stay", "time", "start", "stop")
    out = features.feature_table(c, [(features.rollup(inside, "stay", "time", ["hr"]), "stay")], ["stay"]).orderBy("stay").collect()
    assert tuple(out[0])[1:] == (85.0, 80.0, 90.0, 90.0, 2.0) and out[1].hr_mean is None


def test_changes_do_nothing_at_level_zero_or_one(spark):
    ids = spark.range(2000).withColumnRenamed("id", "case_id")
    base = worlds.scored(worlds.drawn(ids)).agg(F.sum("p"), F.sum("y"), F.sum("error")).first()
    for name, level in (("variable_rescale", 1.0), ("class_prior_shift", 1.0), ("mcar_missingness", 0.0), ("version_swap_with_regression", 0.0), ("out_of_scope_use_share", 0.0), ("slope_and_intercept_drift", 1.0)):
        out = worlds.change(name)(ids, F.lit(1.0), level, (1.0,)).agg(F.sum("p"), F.sum("y"), F.sum("error")).first()
        assert np.allclose([float(v) for v in out], [float(v) for v in base]), name
    with pytest.raises(KeyError):
        worlds.change("unknown")
    with pytest.raises(ValueError):
        worlds.register("none")(lambda *a: a)


def test_solved_slopes_lose_what_they_should(spark):
    pool = worlds.pool(spark)
    for name, group in (("outcome_model_change", None), ("subgroup_outcome_model_change", 1), ("covariate_and_concept_drift", None)):
        for k, known in enumerate(assurance.SOLVED[name]):
            slope = pool.slope(assurance.LEVELS[name] * (k + 1) / 3, group)
            assert (slope, pool.intercept(slope, group)) == pytest.approx(known, abs=1e-7)
    s = pool.slope(0.136)
    assert pool.sensitivity(s) == pytest.approx(pool.sensitivity(1.0) * (1 - 0.136), abs=1e-6)
    ids = spark.range(60_000).withColumnRenamed("id", "case_id")
    rows = {n: worlds.world_summary(worlds.change(n)(ids, F.lit(1.0), v, (1.0,)), [F.lit(0).alias("k")]).first() for n, v in (("none", 0.0), ("outcome_model_change", 0.136), ("covariate_mean_shift", 0.8), ("class_prior_shift", 2.0))}
    assert rows["outcome_model_change"].prevalence == pytest.approx(0.15, abs=0.006)
    assert rows["outcome_model_change"].sensitivity == pytest.approx(rows["none"].sensitivity * (1 - 0.136), abs=0.02)
    assert rows["class_prior_shift"].sensitivity == pytest.approx(rows["none"].sensitivity, abs=0.02)
    assert rows["covariate_mean_shift"].prevalence > 0.2
    with pytest.raises(ValueError):
        pool.slope(0.9)


def test_outcome_link_keeps_the_prevalence(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "case_id")
    out = worlds._slope(ids, F.lit(1.0), 0.6, (1.0,), mode="outcome_link").agg(F.avg("y")).first()[0]
    assert out == pytest.approx(0.15, abs=0.006)
    with pytest.raises(ValueError):
        worlds._slope(ids, F.lit(1.0), 0.6, (1.0,), mode="other")


def area_by_hand(y, p):
    r = pd.Series(p).rank().to_numpy()
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_gain_matches_whole_table(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p0, p1 = np.round(rng.random(400), 2), np.clip(np.round(0.3 * y + 0.7 * rng.random(400), 2), 0, 1)
    rows = [(k // 20, k % 20, int(y[k]), float(p0[k]), float(p1[k])) for k in range(400)]
    df = spark.createDataFrame(rows, "stream long, t long, y int, p double, q double")
    got = model.auroc_gain(df.select("stream", "t", "y", "p"), df.select("stream", "t", "y", F.col("q").alias("p")), 40, 7).first()
    draws = np.random.default_rng(7)
    gains = []
    for _ in range(40):
        at = np.concatenate([np.arange(20) + 20 * s for s in draws.integers(0, 20, 20)])
        gains.append(area_by_hand(y[at], p1[at]) - area_by_hand(y[at], p0[at]))
    assert (got.auroc_base, got.auroc_full) == pytest.approx((area_by_hand(y, p0), area_by_hand(y, p1)))
    assert (got.lo, got.hi) == pytest.approx(tuple(np.quantile(gains, [0.025, 0.975])))


def test_model_indicators_match_their_parts(spark):
    df = windowed_cases(spark, SF)
    wide = {r.window: r for r in I.model_indicators(df, 5, FEATURES).collect()}
    for name, part in (("P4", I.auroc(df, ["window"])), ("U1", I.ece(df, ["window"])), ("P5", I.model_ratios(df, ["window"]))):
        assert {k: pytest.approx(r[name]) for k, r in wide.items()} == {r.window: r[name] for r in part.collect()}


@pytest.mark.parametrize("block", [inference.BLOCK, 7])
def test_bootstrap_sums_draws_without_listing_picks(spark, block):
    """Draws by hand for groups of two sizes, one without a name and one with gaps; every source row is read once."""
    rnd = np.random.default_rng(4)
    held = {"a": [(float(x), float(y)) for x, y in rnd.integers(0, 9, (40, 2))], None: [(float(k), 1.5) for k in range(23)]}
    held["b"] = [(r, None if k % 3 == 0 else c) for k, (r, c) in enumerate(held["a"])]
    rows = [(arm, k, r, c) for arm, pairs in held.items() for k, (r, c) in enumerate(pairs)]
    pairs = spark.createDataFrame(rows, "arm string, k int, reference double, candidate double")
    w = W.partitionBy("arm")
    numbered = pairs.select("arm", "reference", "candidate", (F.row_number().over(w.orderBy("k")) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    got = {(r.arm, r._draw): r for r in inference.draw_sums(numbered, ["arm"], ["reference", "candidate"], 3, 130, block).collect()}
    assert len(got) == 3 * 131
    at = spark.range(40).crossJoin(spark.range(130).withColumnRenamed("id", "d")).select("id", "d", uniform(F.col("id"), F.col("d") + 3 * inference.DRAWS).alias("u")).collect()
    u = {(r.id, r.d): r.u for r in at}
    for arm, values in held.items():
        n = len(values)
        for d in range(-1, 130):
            drawn = values if d < 0 else [values[int(u[i, d] * n)] for i in range(n)]
            some = [c for _, c in drawn if c is not None]
            assert (got[arm, d].reference, got[arm, d].reference_n, got[arm, d].candidate, got[arm, d].candidate_n) == (sum(r for r, _ in drawn), n, sum(some), len(some))
    out = inference.bootstrap(pairs, ["arm"], order=["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial")[0].count("Scan ExistingRDD") == 1 and "Join" not in plan
    by = {r.arm: r for r in out.collect()}
    assert {arm: r.n for arm, r in by.items()} == {"a": 40, None: 23, "b": 40}
    assert by[None].reduction == 9.5 and by[None].lo < 9.5 < by[None].hi and inference.bootstrap(pairs.limit(0), []).first().n == 0


def test_pooled_bootstrap_covers_the_mean(spark):
    rows = [("A", "a", 1.0 + k % 3) for k in range(60)] + [("A", "b", 3.0 + k % 3) for k in range(60)] + [("B", "a", 4.0 + k % 3) for k in range(60)]
    r = inference.pooled_bootstrap(spark.createDataFrame(rows, "scenario string, cell string, value double"), 2.5).first()
    assert r.estimate == pytest.approx(4.0) and r.lo < 4.0 < r.hi and r.hi - r.lo < 0.5 and r.p == 0.0


def test_cells_and_scenario_rules(spark):
    rows = [("a", ["P1"], ["P2"], ["RH1"], "fair_test", True), ("b", ["P1"], ["P1", "ZZ"], ["RH1"], "fair_test", True), ("c", [], [], [], "control", True)]
    sc = spark.createDataFrame(rows, "id string, responsive array<string>, held_stable array<string>, hypotheses array<string>, purpose string, primary boolean")
    known = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "indicator string")
    got = sorted((r["where"], r.message) for r in catalog.validate_scenarios(sc, known, ["RH1", "RH2"], 2, {"RH1": 3}).collect())
    assert got == [
        ("P3", "not covered"), ("RH1", "fewer than 3 fair tests"), ("RH2", "fewer than 2 scenarios"), ("b", "responsive and held stable overlap"),
        ("b", "unknown indicator"), ("c", "primary delay without harm"),
    ]


def test_model_fit_and_levels(spark):
    w = worlds.scored(worlds.drawn(spark.range(6000).withColumnRenamed("id", "case_id"))).withColumn("label", F.col("y"))
    m = model.fit_real(w, ["x1", "x2", "x3"], grid=[1.0])
    again = model.with_regression(m, 0.5)
    norm = lambda k: sum(v * v for v in k["weights"].values())
    assert all(v > 0 for v in m["weights"].values()) and norm(again) < norm(m)
    scored = layers.rescore(w, m).where("label = 1").agg(F.avg("decision")).first()[0]
    assert abs(scored - 0.75) < 0.01
    assert model.solve_level(lambda xs: [1 + x for x in xs], 1.5, 0.0, 2.0)["level"] == pytest.approx(0.5, abs=2e-3)
    assert not model.solve_level(lambda xs: [1 + x for x in xs], 9.0, 0.0, 2.0)["attained"]


def penalized_by_hand(x, y, c):
    """Newton's method for one model, in one place."""
    b, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge / c, x.T @ (y - p) - ridge @ b / c)
    return b


def test_penalty_search_equals_a_direct_solver(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.column_stack([np.ones(600), rng.normal(size=(600, 3))])
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [-0.5, 1.0, -0.7, 0.2])))).astype(float)
    fold = rng.integers(0, 4, 600)
    df = spark.createDataFrame([(*map(float, r[1:]), float(v), int(k)) for r, v, k in zip(x, y, fold, strict=True)], "a double, b double, c double, y double, _fold int").repartition(3)
    jobs, own = [], model._summed
    monkeypatch.setattr(model, "_summed", lambda *a: (jobs.append(1), own(*a))[1])
    coef, loss = model.penalized_fits(df, ["a", "b", "c"], "y", [0.01, 1.0, 50.0], 4)
    assert len(jobs) < 15  # for 15 models
    for g, c in enumerate([0.01, 1.0, 50.0]):
        assert np.allclose(coef[-1, g], penalized_by_hand(x, y, c), atol=1e-6)
        for k in range(4):
            b = penalized_by_hand(x[fold != k], y[fold != k], c)
            p = 1 / (1 + np.exp(-x[fold == k] @ b))
            assert np.allclose(coef[k, g], b, atol=1e-6)
            assert loss[k, g] == pytest.approx(-np.mean(y[fold == k] * np.log(p) + (1 - y[fold == k]) * np.log(1 - p)), abs=1e-6)


def test_streaming_cusum_equals_batch(spark, tmp_path):
    z = [0.2, 1.9, 2.5, 0.1, 3.0, 2.0, 2.0, -1.0, 4.0]
    series(spark, z[:4]).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    series(spark, z).where("t >= 4").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema("indicator string, t long, z double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = streaming_cusum(stream, 3.0).writeStream.format("memory").queryName("cusum_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.t, r.alarm) for r in spark.sql("SELECT * FROM cusum_out").collect()}
    want = {(r.t, r.alarm) for r in detectors.cusum(series(spark, z), 3.0, ["indicator"]).collect()}
    assert {t for t, _ in got} == set(range(9)) and got == want


def test_catalog_rules(spark):
    needed = spark.createDataFrame([("a",), ("b",)], "observable string")
    mapped = spark.createDataFrame([("b", "o1", "available"), ("c", "o9", "odd")], "observable string, output string, status string")
    outputs = spark.createDataFrame([("o1",)], "output string")
    got = {(r["where"], r.message) for r in catalog.validate_mapping(needed, mapped, outputs, ["available"]).collect()}
    assert got == {("a", "unmapped"), ("c", "unused"), ("c", "unknown output"), ("c", "bad status")}
    rec = spark.createDataFrame([("P1", "x", "low", {"yellow": "a"}), ("P1", " ", "none", None)], "id string, name string, grade string, governance_action map<string,string>")
    got = sorted((r["where"], r.message) for r in catalog.validate_records(rec, ["name"], {"grade": ["low"]}, ["yellow"], 3).collect())
    assert got == [("P1", "actions must be yellow"), ("P1", "duplicate id"), ("P1", "grade not in vocabulary"), ("P1", "missing name"), ("all", "expected 3 records, found 2")]


def test_citation_match(spark):
    assert catalog.title_similarity("A Study of Drift", "a study of drift.") == 1.0
    rows = [("r", "s1", "On drift", "On drift", 2020, 2021, "Roe", ["Roe"]), ("r", "s2", "On drift", "Of boats", 2020, 2020, "Roe", ["Roe"])]
    pairs = spark.createDataFrame(rows, "id string, source string, title_a string, title_b string, year_a int, year_b int, family string, authors array<string>")
    out = catalog.verdicts(catalog.matches(pairs).withColumn("doi", F.lit("10.1/x"))).first()
    assert (out.verdict, out.sources, out.doi) == ("WARNING", ["s1"], "10.1/x")


@pytest.mark.parametrize("least", [0.6, 0.9, 0.95])
def test_similar_titles_equal_all_pairs(spark, least):
    rnd = np.random.default_rng(5)
    words = "monitoring of deployed clinical risk models under drift a study on calibration alarms and harm é aaaa".split()
    titles: list[str | None] = [" ".join(rnd.choice(words, rnd.integers(1, 14))) for _ in range(40)]
    for t in list(titles):
        at = int(rnd.integers(0, len(t) + 1))
        titles += [t[:at] + "x" + t[at:], t[: len(t) // 2], t + " " + t, t[:at] + t[at + 3 :], t.upper()]
    titles += ["a", "b", "ab", "", None, "aaaaaaaaaa", "aaaaaaaaaab", titles[0]]
    rows = list(enumerate(titles))
    a, b = rows[::2], rows[1::2] + rows[:3]
    frames = [spark.createDataFrame(r + r[:2], "id int, title string") for r in (a, b)]
    got = {(r.id_a, r.id_b): r.ratio for r in catalog.similar_titles(*frames, least).collect()}
    want = {(i, j): catalog.title_similarity(x, y) for i, x in a for j, y in b if catalog.title_similarity(x, y) >= least}
    assert got == pytest.approx(want) and len(want) > 50
    assert catalog.similar_titles(frames[0].limit(0), frames[1], least).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/sub/a.csv").write_text('x,y\n1,"two\nlines"\n3,4\n')
    (tmp_path / "t/empty.csv").write_text("")
    (tmp_path / "t/dir.csv").mkdir()
    got = {r.path: (r.columns, r.rows) for r in readers.csv_tree(spark, str(tmp_path / "t"), True).collect()}
    assert got == {"sub/a.csv": (["x", "y"], 2), "empty.csv": ([], 0)}
    (tmp_path / "r.yaml").write_text("- {id: a, n: 1}\n- {id: b, n: 2}\n")
    assert [r._source for r in readers.read_yaml(spark, [str(tmp_path / "r.yaml")], "id string, n int").collect()] == ["r.yaml"] * 2
    row = "| SC02 | low | abrupt | 150 | a | b | c | d | 3.6 [3.2, 3.9] | -0.8 [-1.0, -0.7] | k | l |"
    lines = spark.createDataFrame([(0, "### Label lag 2"), (1, row), (2, "text")], "n int, value string")
    r = readers.pilot_rows(lines).first()
    assert (r.lag, r.scenario, r["first"], r.second_hi) == (2, "SC02", 3.6, -0.7)
    with pytest.raises(ValueError):
        readers.run_aggregate(spark, "DROP TABLE x", ["n"])
    assert readers.setting("TIDEWATCH_NONE", None, "d") == "d"


def test_files_go_by_their_whole_path(spark, tmp_path):
    for path, text in {"a/x.md": "one", "b/x.md": "two", "b/y z.md": "three", "c.md": ""}.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_text(text)
    files = spark.createDataFrame([("g", "b/y z.md"), ("g", "a/x.md"), ("h", "b/x.md"), ("h", "none.md")], "group string, path string")
    got = {r.group: r.text for r in readers.corpus(spark, files, str(tmp_path / "t")).collect()}
    assert got == {"g": "one\nthree", "h": "two"}
    assert {r.path: r.length for r in readers.file_tree(spark, str(tmp_path / "t"), "*.md").collect()} == {"a/x.md": 3, "b/x.md": 3, "b/y z.md": 5}
    assert list(readers.listed(spark, str(tmp_path / "t"), (".md",))) == ["a/x.md", "b/x.md", "b/y z.md", "c.md"]


def test_tables_of_many_cells_are_read_whole(spark):
    line = "| **Use** | " + " | ".join(f"c{k}" for k in range(90)) + " |"
    row = readers.matrix_rows(spark.createDataFrame([(1, line), (2, "| plain | c |")], "n int, value string")).collect()
    assert [(r.construct, r.cells) for r in row] == [("Use", [f"c{k}" for k in range(90)])]


def test_jdbc_reads_are_shared_out_and_pushed_down(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    rows = [(k, 7 if k % 2 else 8, float(k)) for k in range(1, 401)] + [(50, 7, -1.0)]
    source = spark.createDataFrame(rows, "STAY int, ITEMID int, VALUE double")
    source.coalesce(1).write.format("jdbc").options(url=url + ";create=true", dbtable="READINGS", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    cohort = spark.createDataFrame([(k,) for k in range(41, 201, 4)] * 2, "STAY int")
    read = lambda c, **o: readers.read_jdbc(spark, url, "SELECT * FROM READINGS", "STAY", c, [7], "ITEMID", driver="org.apache.derby.jdbc.EmbeddedDriver", **o)
    want = sorted((k, v) for k, i, v in rows if i == 7 and 41 <= k <= 200 and (k - 41) % 4 == 0)
    for parts in (1, 4):
        df = read(cohort, partitions=parts)
        assert sorted((r.STAY, r.VALUE) for r in df.collect()) == want
    plain = df._jdf.queryExecution().executedPlan().toString()
    assert "BETWEEN 41 AND 197" in plain and "IN (7)" in plain and "numPartitions=4" in plain
    assert read(cohort.where("false"), partitions=4).count() == 0


def test_stores_records_and_environment(spark, tmp_path):
    df = spark.createDataFrame([("S1", 1, 2.0), ("S2", 1, 3.0)], "scenario string, replicate int, tafd double")
    readers.write_replicates(df, str(tmp_path / "store"))
    assert readers.read_replicates(spark, str(tmp_path / "store")).count() == 2
    assert [r.tafd for r in readers.read_replicates(spark, str(tmp_path / "store"), ["S2"]).collect()] == [3.0]
    tags = spark.createDataFrame([("a", ["predictive"]), ("b", []), ("c", None)], "id string, types array<string>")
    assert [r.id for r in readers.tagged(tags, "types", "predictive").collect()] == ["a"]
    assert set(readers.environment()) == {"python", "platform", "pyspark", "numpy", "pandas", "pyarrow"}


def test_a_number_is_replaced_in_place():
    text = "# head\n- {id: S1, levels: {low: 0.25 SD, high: 1.5x}}  # keep\n- {id: S10, levels: {low: 0.3 SD}}\n"
    assert readers.with_number(text, "S1", "low", 0.41234) == text.replace("0.25 SD", "0.412 SD")
    for record, field in (("S2", "low"), ("S1", "medium")):
        with pytest.raises(ValueError):
            readers.with_number(text, record, field, 1.0)
