"""Feature tables from long readings, outcome labels and suppressed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scalar import suppress_small

STATS = ("mean", "min", "max", "last", "count")


def readings_in_window(readings: DataFrame, cohort: DataFrame, key: str, time: str, start: str, stop: str, closed: bool = False) -> DataFrame:
    """Readings of cohort members in [start, stop), or [start, stop] if closed; null keys and values are dropped."""
    inside = F.col(time) <= F.col(stop) if closed else F.col(time) < F.col(stop)
    both = readings.na.drop(subset=[key, "value"]).join(cohort.select(key, start, stop), key)
    return both.where((F.col(time) >= F.col(start)) & inside).drop(start, stop)


def map_items(readings: DataFrame, items: dict[str, tuple], item: str = "item") -> DataFrame:
    """Adds feature by item; where an item is listed twice the later feature wins; unlisted items are dropped."""
    flat = {i: name for name, ids in items.items() for i in ids}
    lookup = F.create_map(*(F.lit(x) for kv in flat.items() for x in kv))
    return readings.where(F.col(item).isin(*flat)).withColumn("feature", F.element_at(lookup, F.col(item)))


def rollup(readings: DataFrame, key: str, time: str, features: list[str]) -> DataFrame:
    """Wide table: five statistics of each feature. Partial aggregation by (key, feature), then by key; no pivot sort.

    `last` is the value at the latest time, the greatest of them at a tie.
    """
    long = readings.groupBy(key, "feature").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", F.struct(time, "value")).alias("last"), F.count("value").alias("count"),
    )
    pick = lambda f, s: F.max(F.when(F.col("feature") == f, F.col(s))).cast("double").alias(f"{f}_{s}")
    return long.groupBy(key).agg(*(pick(f, s) for f in features for s in STATS))


def feature_table(cohort: DataFrame, parts: list[tuple[DataFrame, str]], keep: list[str]) -> DataFrame:
    """Cohort left-joined with feature tables by their keys; members without readings keep a row of nulls."""
    out = cohort
    for part, key in parts:
        out = out.join(part, key, "left")
    have = [c for p, k in parts for c in p.columns if c != k]
    return out.select(*keep, *have)


def label_flag(stays: DataFrame, flag: str) -> DataFrame:
    """label 1 where the flag holds, 0 where it doesn't; stays without the flag are dropped."""
    return stays.where(F.col(flag).isNotNull()).withColumn("label", F.col(flag).cast("boolean").cast("int"))


def survived(died: Column) -> Column:
    """Whether a stay ended alive; an unknown end doesn't count."""
    return F.coalesce(~died.cast("boolean"), F.lit(False))


def label_return(stays: DataFrame, subject: str, admit: str, discharge: str, tie: str, days: int) -> DataFrame:
    """Adds next_admit and label: 1 if the subject's next stay starts within days of this discharge; none is 0."""
    w = W.partitionBy(subject).orderBy(admit, tie)
    out = stays.withColumn("next_admit", F.lead(admit).over(w))
    within = F.col("next_admit") <= F.col(discharge) + F.make_interval(days=F.lit(days))
    return out.withColumn("label", F.coalesce(within, F.lit(False)).cast("int"))


def label_exists(stays: DataFrame, positives: DataFrame, key: str) -> DataFrame:
    """label 1 where a positive row has the key. Positives are made distinct before the join."""
    hit = positives.select(key).distinct().withColumn("_hit", F.lit(1))
    return stays.join(hit, key, "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def suppressed(df: DataFrame, counts: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in counts]
    return df.select(*rest, *suppress_small(counts))


def size_bins(n: Column, edges: list[int], names: list[str]) -> Column:
    out = F.when(n < edges[0], names[0])
    for e, name in zip(edges[1:], names[1:], strict=False):
        out = out.when(n < e, name)
    return out.otherwise(names[-1])
