"""Resampled streams: their indicators and scores, and replicates of a change from resampling to classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.rng import uniform
from tidewatch.operators import detectors, harm, inference
from tidewatch.operators import indicators as I
from tidewatch.operators import windows as wn
from tidewatch.operators.cases import HARM

#: Indicators of the monitoring systems.
NAMES = tuple(dict.fromkeys(n for names in detectors.FLAT_ARMS.values() for n in names))


def resampled_indicators(df: DataFrame, plan: DataFrame, n_baseline: int, features: tuple[str, ...]) -> DataFrame:
    """Wide indicators of every stream and window of a plan, from the windowed cases it resamples.

    What a window's own cases give is taken once for each real window and resampled; only U5, which compares a window with
    its stream's baseline scores, needs the streams' scores.
    """
    base = F.col("window") < n_baseline
    wide = inference.resampled(I.window_table(df, ["window"], features), plan)
    wide = I.shift_of_sums(wide, features, base, ["stream"])
    scores = inference.resampled(df.select("window", "p"), plan)
    return wide.join(I.ks_to_baseline(scores, ["stream", "window"], base, ["stream"]), ["stream", "window"])


def null_scores(df: DataFrame, features: tuple[str, ...], streams: int, n_out: int, n_baseline: int, block: int, lag: int, salt: int = 1) -> DataFrame:
    """stream, indicator, t, z of null streams: blocks of real windows, with nothing changed."""
    n_real = df.agg(F.max("window")).first()[0] + 1
    plan = inference.block_plan(df.sparkSession, streams, n_out, n_real, min(block, n_real), salt)
    wide = resampled_indicators(df, plan, n_baseline, features)
    return detectors.scores(I.long_form(wide, list(NAMES), ["stream", "window"]), n_baseline, lag, ["stream"])


def onset_scores(harmed: DataFrame, n_baseline: int, stream: list[str]) -> DataFrame:
    """stream, indicator (P5 pooled, P6 subgroup), t, z: harm by window standardized on the stream's baseline."""
    by = harm.harm_by(harmed, [*stream, "window"])
    sub = F.when(F.col("share") >= HARM.min_subgroup_share, F.col("rhe_sub"))
    wide = by.select(*stream, "window", F.col("rhe").alias("P5"), sub.alias("P6"))
    return detectors.scores(I.long_form(wide, ["P5", "P6"], [*stream, "window"]), n_baseline, 0, stream)


def onsets(z: DataFrame, threshold: float, j: int, stream: list[str]) -> DataFrame:
    """stream, t0: the first episode in which either harm series alarms; streams without one are left out."""
    events = detectors.system_events(detectors.cusum(z, threshold, [*stream, "indicator"]), stream)
    start = wn.episode_start(F.col("event"), j, stream, "t")
    return events.withColumn("_start", start).where("_start").groupBy(*stream).agg(F.min("t").alias("t0"))


def replicate_delays(
    df: DataFrame, plan: DataFrame, change: Callable[[DataFrame, Column], DataFrame], arms: DataFrame, names: list[str], *,
    n_out: int, n_baseline: int, horizon: int, lag: int, j: int, onset_h: float, salt: int = 9,
) -> DataFrame:
    """stream, arm, s0, t0, delay and its class of every replicate: one frame keyed by stream from the plan to the end.

    change(cases, progress) returns scored cases with error, w and confidence; a change is abrupt from a window s0 that
    is drawn for each stream. Replicates without an onset, or with one closer than the horizon to their end, are dropped.
    """
    monitored = n_out - n_baseline
    cases = inference.resampled(df, plan).withColumn("s0", F.floor(uniform(F.col("stream"), salt) * monitored).cast("long"))
    progress = (F.col("window") - n_baseline >= F.col("s0")).cast("double")
    made = change(cases, progress)
    harmed = harm.with_harm(made)
    by = ["stream", "window"]
    wide = harmed.groupBy(*by, "s0").agg(
        *I.ratio_columns(), F.avg("harm").alias("_rhe"), F.avg(F.when(F.col("g") == 1, F.col("harm"))).alias("_sub"), F.avg(F.col("g").cast("double")).alias("_share")
    )
    onset = wide.select(*by, F.col("_rhe").alias("P5"), F.when(F.col("_share") >= HARM.min_subgroup_share, F.col("_sub")).alias("P6"))
    t0 = onsets(detectors.scores(I.long_form(onset, ["P5", "P6"], by), n_baseline, 0, ["stream"]), onset_h, j, ["stream"]).where(F.col("t0") + horizon <= monitored)
    z = detectors.scores(I.long_form(wide, names, by), n_baseline, lag, ["stream"])
    starts = wide.groupBy("stream").agg(F.max("s0").alias("s0")).join(t0, "stream")
    events = detectors.arm_events(z, arms, ["stream"]).join(starts, "stream")
    out = detectors.classify(events, ["stream", "arm"], "s0", "t0", horizon, j)
    return out.join(starts, "stream")
