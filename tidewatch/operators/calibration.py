"""Thresholds for a false-alarm budget, read off the steps of the rate itself.

With a threshold h an alarm is s > h, so a series' alarms change only where h passes a value that s can take after a reset
at any window. Those values are finitely many. A task finds for each series of its streams where the alarms change, counts
a system's episode starts from each such threshold on, and sends on where the count changes: (h, change). Summed over the streams these are the exact steps of
the rate as a function of h; their running sum is taken in stretches of h, each on its own. The threshold wanted is the
least from which on the rate stays within the budget (far below it alarms run into one another, and one episode has one
start, so the rate falls again). Only the tops, where the rate is over all that comes at higher thresholds, come to the
driver, up to the first over the budget: as many as the budget has starts.

A split system gives its components equal shares of the starts that a multiplier allows. Its candidates are the tops of
the components, which are all points where its thresholds change; one more pass counts the union's starts at each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.detectors import FLAT_ARMS, K_REF, SPLIT_ARMS, cusum_array, null_streams, starts

#: The least and greatest threshold and multiplier of the budget.
LOW_H, HIGH_H, LOW_M, HIGH_M = 0.2, 200.0, 0.3, 3.0
#: Stretches of the logarithm of h whose running sums are taken on their own.
STRETCHES = 4096


def levels(z: np.ndarray, k_ref: float = K_REF) -> np.ndarray:
    """All values over LOW_H that s can take in a series, reset before any window."""
    s, out = np.zeros(len(z)), [np.empty(0)]
    for t in range(len(z)):
        s[: t + 1] = np.maximum(0.0, s[: t + 1] + z[t] - k_ref)
        out.append(s[: t + 1].copy())
    v = np.unique(np.concatenate(out))
    return v[v > LOW_H]


def alarm_steps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds from LOW_H on at which a series' alarms change, and the alarms from each on (rows) by window."""
    h = np.concatenate([[LOW_H], levels(z)])
    alarms = cusum_array(np.repeat(z[:, None], len(h), 1), h).T
    new = np.append(True, (alarms[1:] != alarms[:-1]).any(1))
    return h[new], alarms[new]


def starts_at(series: list[tuple[np.ndarray, np.ndarray]], h: np.ndarray, j: int) -> np.ndarray:
    """Episode starts of series with known alarms under each row of thresholds (one for all, or one for each)."""
    event = None
    for k, (own, alarms) in enumerate(series):
        at = alarms[np.searchsorted(own, h[:, k if h.shape[1] > 1 else 0], side="right") - 1]
        event = at if event is None else event | at
    return starts(event, j).sum(1)


def _cubes(pdf: pd.DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    for names, cube in zip(pdf["names"], pdf["cube"], strict=True):
        yield list(names), np.stack([np.asarray(r, float) for r in cube])


def rate_changes(streams: DataFrame, systems: dict[str, tuple[str, ...]], j: int) -> DataFrame:
    """system, h, change: by how much the starts of all streams change at each threshold; at LOW_H, how many they are."""

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {"system": [], "h": [], "change": []}
            for names, cube in _cubes(pdf):
                series = {i: alarm_steps(cube[:, k]) for k, i in enumerate(names)}
                for system, members in systems.items():
                    own = [series[i] for i in members if i in series]
                    h = np.unique(np.concatenate([x for x, _ in own]))
                    change = np.diff(starts_at(own, h[:, None], j), prepend=0)
                    at = np.flatnonzero((change != 0) | (h == LOW_H))
                    out["system"] += [system] * len(at)
                    out["h"].append(h[at])
                    out["change"].append(change[at])
            if out["h"]:
                yield pd.DataFrame({"system": out["system"], "h": np.concatenate(out["h"]), "change": np.concatenate(out["change"])})

    return streams.mapInPandas(steps, "system string, h double, change long").groupBy("system", "h").agg(F.sum("change").alias("change"))


def rate_steps(changes: DataFrame) -> DataFrame:
    """system, h, starts, till, later: starts in all streams from threshold h up to till; later: the most at any from till on.

    changes is read more than once, so it should be persisted.
    """
    place = F.log(F.col("h") / LOW_H) / float(np.log(HIGH_H / LOW_H)) * STRETCHES
    each = changes.withColumn("stretch", F.least(F.floor(place), F.lit(STRETCHES)).cast("int"))
    along = W.partitionBy("system").orderBy("stretch")
    sums = each.groupBy("system", "stretch").agg(F.sum("change").alias("change"))
    carried = sums.select("system", "stretch", (F.sum("change").over(along) - F.col("change")).alias("carried"))
    inside = W.partitionBy("system", "stretch").orderBy("h")
    run = each.join(carried, ["system", "stretch"]).select("system", "stretch", "h", (F.col("carried") + F.sum("change").over(inside)).alias("starts"))
    ends = run.groupBy("system", "stretch").agg(F.max("starts").alias("most"), F.min("h").alias("first"))
    back = W.partitionBy("system").orderBy(F.col("stretch").desc()).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("system", "stretch", F.max("most").over(back).alias("most"), F.min("first").over(back).alias("first"))
    own = W.partitionBy("system", "stretch").orderBy(F.col("h").desc())
    later = F.greatest("most", F.max("starts").over(own.rowsBetween(W.unboundedPreceding, -1)))
    till = F.coalesce(F.lag("h").over(own), "first")
    return run.join(ends, ["system", "stretch"]).select("system", "h", "starts", till.alias("till"), later.alias("later"))


def union_starts(streams: DataFrame, trials: list[dict[str, float]], j: int) -> list[int]:
    """Starts of each trial (indicator to threshold) over all streams, in one pass that returns counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(trials), np.int64)
        for pdf in batches:
            for names, cube in _cubes(pdf):
                own = [i for i in names if i in trials[0]]
                n += starts_at([alarm_steps(cube[:, names.index(i)]) for i in own], np.array([[t[i] for i in own] for t in trials]), j)
        yield pd.DataFrame({"k": np.arange(len(trials)), "n": n})

    got = {r["k"]: r["n"] for r in streams.mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return [got.get(k, 0) for k in range(len(trials))]


def calibrate_arms(z: DataFrame, target: float, j: int) -> DataFrame:
    """arm, component, h, met: the least thresholds that keep each system to `target` starts per 1,000 windows.

    z: stream, t, indicator, z of null streams of a stated number and length; they stay where they are.
    """
    streams, changes = null_streams(z).persist(), []
    have = {r[0] for r in streams.select(F.explode("names")).distinct().collect()}
    own = lambda names: tuple(n for n in names if n in have)
    parts = {(arm, c): own(n) for arm, by in SPLIT_ARMS.items() for c, n in by.items()}
    systems = {arm: own(n) for arm, n in FLAT_ARMS.items()} | {f"{arm}|{c}": n for (arm, c), n in parts.items()}
    systems = {s: n for s, n in systems.items() if n}
    try:
        windows = streams.agg(F.sum(F.size("cube"))).first()[0] or 0
        budget = target * windows / 1000
        share = {s: HIGH_M * budget / len(SPLIT_ARMS[s.split("|")[0]]) if "|" in s else budget for s in systems}
        changes.append(rate_changes(streams, systems, j).persist())
        steps = rate_steps(changes[0])
        most = F.element_at(F.create_map(*(F.lit(x) for s, n in share.items() for x in (s, float(n)))), F.col("system"))
        later = F.coalesce("later", F.lit(-1))
        kept = steps.where((F.col("starts") > later) & (later <= most)).collect()
        tops = {s: sorted((r["starts"], r["till"]) for r in kept if r["system"] == s) for s in systems}
        # Above the greatest threshold that breaks a limit, the next step begins; if none does, all meet it.
        least = lambda s, allowed: next((HIGH_H if till is None else till for n, till in tops.get(s, []) if n > allowed), LOW_H)
        rows = [(arm, "all", float(least(arm, budget))) for arm in FLAT_ARMS]
        for arm, by in SPLIT_ARMS.items():
            low, high = LOW_M * budget / len(by), HIGH_M * budget / len(by)
            allowed = sorted({low, *(float(n) for c in by for n, _ in tops.get(f"{arm}|{c}", []) if low <= n <= high)})
            sets = [{c: float(least(f"{arm}|{c}", a)) for c in by} for a in allowed]
            union = union_starts(streams, [{i: h[c] for c in by for i in parts[arm, c]} for h in sets], j)
            over = next((k for k, n in enumerate(union) if k and n > budget), len(sets))
            rows += [(arm, c, h) for c, h in sets[over - 1].items()]
    finally:
        for held in (streams, *changes):
            held.unpersist()
    return z.sparkSession.createDataFrame([(*r, r[2] < HIGH_H) for r in rows], "arm string, component string, h double, met boolean")
