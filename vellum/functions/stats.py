"""Statistics as column expressions and aggregates; empty input gives 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The smallest gap and the smallest confidence that count.
LEAST_GAP, LEAST_CONFIDENCE = 1e-9, 1e-12


def median(c: Column) -> Column:
    return F.coalesce(F.median(c), F.lit(0.0))


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def geo_mean(c: Column) -> Column:
    return F.coalesce(F.exp(F.avg(F.ln(F.greatest(c, F.lit(LEAST_CONFIDENCE))))), F.lit(0.0))


def quantile(c: Column, q: float) -> Column:
    """Linear interpolation between order statistics, exact."""
    return F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0))


def nearest_rank(c: Column, p: float) -> Column:
    """Aggregate: the element at floor(p n) of the sorted values."""
    own = F.array_sort(F.collect_list(c))
    return F.get(own, F.least(F.size(own) - 1, F.floor(F.lit(p) * F.size(own)).cast("int")))


def sigma(v: Column, k: float) -> Column:
    return 1 / (1 + F.exp(-k * v))


def map_margin(m: Column) -> Column:
    """A margin from 1 up to a confidence from 0 to 1; no rival at all (null) gives 1."""
    return F.when(m.isNull(), 1.0).otherwise(1 - 1 / F.pow(F.greatest(F.lit(1.0), m), F.lit(2.0)))


def pair_confidence(plausibility: Column, assigned: Column, interpreted: Column) -> Column:
    c = F.cbrt(F.greatest(F.lit(0.0), plausibility) * F.greatest(F.lit(0.0), assigned) * F.greatest(F.lit(0.0), interpreted))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), c))


def gap_clusters(df: DataFrame, keys: list[str], value: str, gap: Column) -> DataFrame:
    """(keys, cluster int from 0, center, n): runs of sorted values in which no step exceeds gap, with their means."""
    w = Window.partitionBy(*keys).orderBy(value)
    step = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    islands = df.withColumn("__step", step).withColumn("cluster", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "cluster").agg(F.avg(value).alias("center"), F.count(F.lit(1)).alias("n"))


def mode_rounded(df: DataFrame, keys: list[str], value: str, bin_size: float) -> DataFrame:
    """(keys, mode): the most frequent multiple of bin_size, the smaller of equals."""
    bins = df.groupBy(*keys, (F.floor(F.col(value) / bin_size + 0.5) * bin_size).alias("bin")).count()
    return bins.groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col("count"), F.col("bin"))).alias("mode"))


def nearest_index(centers: Column, v: Column) -> Column:
    """The index of the first center nearest to v, -1 without centers."""
    gaps = F.transform(centers, lambda c: F.abs(c - v))
    return F.coalesce(F.array_position(gaps, F.array_min(gaps)).cast("int") - 1, F.lit(-1))


def row_pitch(df: DataFrame, keys: list[str], center: str) -> DataFrame:
    """(keys, pitch): the median distance of neighbouring row centers."""
    w = Window.partitionBy(*keys).orderBy(center)
    return df.withColumn("__d", F.col(center) - F.lag(center).over(w)).groupBy(*keys).agg(median(F.col("__d")).alias("pitch"))


def jump_split(df: DataFrame, keys: list[str], gap: str, at: str, least_margin: float = 1.3) -> DataFrame:
    """(keys, margin, small_max, big_min): where sorted gaps jump most.

    The split holds if the jump is at least least_margin and neither side spreads by more; keys without such a split are absent.
    """
    g = F.greatest(F.col(gap), F.lit(LEAST_GAP))
    w = Window.partitionBy(*keys).orderBy("__g", at)
    steps = df.withColumn("__g", g).withColumn("__k", F.row_number().over(w)).withColumn("__up", F.lead("__g").over(w) / F.col("__g"))
    cut = steps.groupBy(*keys).agg(F.max_by("__k", F.struct("__up", -F.col("__k"))).alias("__cut"), F.max("__up").alias("margin"))
    low = F.col("__k") <= F.col("__cut")
    sides = steps.drop("__up").join(cut, keys).groupBy(*keys, "margin").agg(
        F.min(F.when(low, F.col("__g"))).alias("__a"), F.max(F.when(low, F.col("__g"))).alias("small_max"),
        F.min(F.when(~low, F.col("__g"))).alias("big_min"), F.max(F.when(~low, F.col("__g"))).alias("__z"),
    )
    held = (F.col("margin") >= least_margin) & (F.col("small_max") / F.col("__a") <= F.col("margin")) & (F.col("__z") / F.col("big_min") <= F.col("margin"))
    return sides.where(held).select(*keys, "margin", "small_max", "big_min")
