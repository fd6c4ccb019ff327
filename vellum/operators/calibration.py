"""Calibration analytics over rows (score double, good boolean, ord): good says whether what was scored is right.

Windows over all rows would put them into one task, so ranks and running sums are taken over distinct scores, which are counted first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The gate's limits.
LEAST_ERRORS, LEAST_AUROC, LEAST_CI, MOST_ECE, LEAST_TRANSFER = 100, 0.65, 0.5, 0.05, 0.5


def tallied(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, n, good, n_before, good_before): counts of each distinct score and of all lower ones."""
    keys = keys or []
    counts = rows.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    w = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "score", "n", "good", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"), F.coalesce(F.sum("good").over(w), F.lit(0)).alias("good_before"))


def auroc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, auroc): the chance that a right row outscores a wrong one, ties counting half; 0.5 where one kind is missing."""
    t = tallied(rows, keys)
    bad = F.col("n") - F.col("good")
    bad_before = F.col("n_before") - F.col("good_before")
    own = t.groupBy(*(keys or [])).agg(F.sum(F.col("good") * (bad_before + bad / 2)).alias("u"), F.sum("good").alias("g"), F.sum(bad).alias("b"))
    return own.select(*(keys or []), F.when((F.col("g") > 0) & (F.col("b") > 0), F.col("u") / (F.col("g") * F.col("b"))).otherwise(0.5).alias("auroc"))


def auprc(rows: DataFrame) -> DataFrame:
    """(auprc): average precision of finding wrong rows from the lowest score up, equal scores in their order; 1 without wrong rows.

    A tie's rows are ranked inside their score, and what stands before it comes from the tally.
    """
    w = Window.partitionBy("score").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("score", "ord", (~F.col("good")).cast("long").alias("bad")).withColumn("k", F.count(F.lit(1)).over(w)).withColumn("b", F.sum("bad").over(w))
    joined = inside.join(tallied(rows).select("score", "n_before", (F.col("n_before") - F.col("good_before")).alias("bad_before")), "score")
    precision = (F.col("bad_before") + F.col("b")) / (F.col("n_before") + F.col("k"))
    return joined.where("bad = 1").agg(F.coalesce(F.avg(precision), F.lit(1.0)).alias("auprc"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, mean_good) of equal-width bins, empty ones with zeros."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))).cast("int")
    own = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("good").cast("double")).alias("mean_good"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("mean_good", F.lit(0.0)).alias("mean_good"))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(ece): the mean distance between confidence and accuracy over bins, weighted by rows."""
    r = reliability(rows, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_good"))) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.pow(F.col("score") - F.col("good").cast("double"), F.lit(2.0))), F.lit(0.0)).alias("brier"))


def review_budget(rows: DataFrame, steps: int = 20) -> DataFrame:
    """(step, budget, caught): the share of wrong rows among the lowest-scored share of rows, for 0 to `steps` equal steps."""
    w = Window.partitionBy("score").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("score", "ord", (~F.col("good")).cast("long").alias("bad")).withColumn("k", F.count(F.lit(1)).over(w)).withColumn("b", F.sum("bad").over(w))
    joined = inside.join(tallied(rows).select("score", "n_before", (F.col("n_before") - F.col("good_before")).alias("bad_before")), "score")
    ranked = joined.select((F.col("n_before") + F.col("k")).alias("place"), (F.col("bad_before") + F.col("b")).alias("found"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((~F.col("good")).cast("long")), F.lit(0)).alias("bad"))
    # one row for each step
    grid = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"), (F.col("id") / steps).alias("budget")).crossJoin(F.broadcast(total))
    grid = grid.withColumn("place", F.floor(F.col("budget") * F.col("rows") + 0.5).cast("long"))
    return grid.join(ranked, "place", "left").select("step", "budget", F.when((F.col("bad") > 0) & (F.col("place") > 0), F.col("found") / F.col("bad")).otherwise(0.0).alias("caught"))


def budget_area(points: DataFrame) -> DataFrame:
    """(auc): the area under the curve of review_budget by trapezoids; points are few."""
    w = Window.orderBy("step")
    strip = (F.col("budget") - F.lag("budget").over(w)) * (F.col("caught") + F.lag("caught").over(w)) / 2
    return points.select(strip.alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("auc"))


def fit_isotonic(rows: DataFrame) -> DataFrame:
    """(x, y): breakpoints of the isotonic map, ascending.

    Neighbouring blocks merge where they fall. Equal scores merge first in any case, so the fold runs over distinct scores in their
    order, in one task of one small row each.
    """
    merged = rows.groupBy("score").agg(F.sum(F.col("good").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: list[list[float]] = []
        for batch in batches:
            for x, y, w in zip(batch["score"], batch["y"], batch["w"], strict=True):
                blocks.append([x, x, y, w])
                while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] > blocks[-1][2] / blocks[-1][3] + 1e-12:
                    _, high, y2, w2 = blocks.pop()
                    blocks[-1][1:] = [high, blocks[-1][2] + y2, blocks[-1][3] + w2]
        points: list[tuple[float, float]] = []
        for low, high, y, w in blocks:
            for x in (low, high):
                if not points or points[-1] != (x, y / w):
                    points.append((x, y / w))
        yield pd.DataFrame(points, columns=["x", "y"])

    return merged.coalesce(1).sortWithinPartitions("score").mapInPandas(fold, "x double, y double")


def apply_isotonic(score: Column, points: Column) -> Column:
    """The map at a score: linear between breakpoints struct(x, y), constant outside, the score itself without any."""
    below = F.filter(points, lambda p: p["x"] <= score)
    above = F.filter(points, lambda p: p["x"] > score)
    a, b = F.element_at(below, -1), F.get(above, F.lit(0))
    between = a["y"] + (b["y"] - a["y"]) * (score - a["x"]) / (b["x"] - a["x"])
    y = F.when(F.size(points) == 0, score).when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(between)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def gate(m: DataFrame) -> DataFrame:
    """m(n_errors, auroc, ci_low, ece_raw, ece_cal, transfer) with reasons array and ship boolean."""
    reasons = F.array_compact(F.array(
        F.when(F.col("n_errors") < LEAST_ERRORS, "few errors"), F.when(F.col("auroc") < LEAST_AUROC, "low auroc"), F.when(F.col("ci_low") <= LEAST_CI, "low interval"),
        F.when(F.col("ece_cal") > MOST_ECE, "high error of calibration"), F.when(F.col("ece_cal") > F.col("ece_raw") + 1e-9, "calibration does not help"), F.when(F.col("transfer") < LEAST_TRANSFER, "transfer collapsed"),
    ))
    return m.withColumn("reasons", reasons).withColumn("ship", F.size("reasons") == 0)


def bootstrap_mean(groups: DataFrame, draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(lo, hi): percentile interval of sum(value) / sum(weight) over replicates.

    groups(grp, value, weight) are resampled by draws(replicate, grp), one row for each draw; replicates are few and groups meet draws on
    an equality join.
    """
    stats = draws.join(groups, "grp").groupBy("replicate").agg((F.sum("value") / F.sum("weight")).alias("stat"))
    own = F.array_sort(F.collect_list("stat"))
    n = F.size(own)
    low = F.greatest(F.lit(0), F.floor(F.lit(alpha / 2) * n).cast("int"))
    high = F.least(n - 1, F.ceil(F.lit(1 - alpha / 2) * n).cast("int") - 1)
    return stats.agg(F.get(own, low).alias("lo"), F.get(own, high).alias("hi"))


#: The artifact's schema and signal, the splits, and what labels don't count.
ARTIFACT, SIGNAL, SPLITS = "uncertainty-calib/1", "ppocrCharConf", ("fit", "held-out", "transfer")


def visible(ch: Column) -> Column:
    """Whether a character is neither white space nor a control character."""
    return (ch != "") & ~ch.rlike(r"^[\s\p{Z}\p{C}]$")


def is_digit(ch: Column) -> Column:
    return ch.rlike("^[0-9]$")


def slices(labels: DataFrame) -> DataFrame:
    """(domain, split, n, errors, digits, digit_errors) over the visible characters of labels(domain, split, ch, conf, correct)."""
    wrong, digit = ~F.col("correct"), is_digit(F.col("ch"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"), F.count_if(digit).alias("digits"), F.count_if(digit & wrong).alias("digit_errors")]
    return labels.where(visible(F.col("ch"))).groupBy("domain", "split").agg(*sums)


def fit_maps(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The isotonic maps of all visible characters of the fit split, and of its digits alone; either may be empty."""
    own = labels.where(visible(F.col("ch")) & (F.col("split") == "fit")).select(F.col("conf").alias("score"), F.col("correct").alias("good"), "ch")
    return fit_isotonic(own), fit_isotonic(own.where(is_digit(F.col("ch"))))


def artifact(overall: DataFrame, digit: DataFrame, fitted_on: list[str]) -> str:
    """The artifact's JSON from two maps (x, y), which have at most two points for each distinct score; without points it is the identity."""
    points = [[{"x": r.x, "y": r.y} for r in df.orderBy("x", "y").collect()] for df in (overall, digit)]
    signal = {"aggregation": "min", "isotonic": points[0], **({"isotonicDigit": points[1]} if points[1] else {})}
    return json.dumps({"schema": ARTIFACT, "fittedOn": fitted_on, "signals": {SIGNAL: signal} if points[0] else {}})


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Writes a small report or artifact as one text file in a folder, in place of what is there."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_artifact(spark: SparkSession, path: str) -> tuple[str, list[tuple[float, float]], list[tuple[float, float]]]:
    """(mode, map, digits' map) of an artifact; on any failure, and without points, the mode is identity and both are empty."""
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        signal = found["signals"][SIGNAL]
        maps = [[(float(p["x"]), float(p["y"])) for p in signal.get(k) or []] for k in ("isotonic", "isotonicDigit")]
    except Exception:  # noqa: BLE001 - a map that can't be read must never stop reading pages
        return "identity", [], []
    return ("isotonic", maps[0], maps[1] or maps[0]) if maps[0] else ("identity", [], [])


def calibrated(conf: Column, ch: Column, overall: list[tuple[float, float]], digit: list[tuple[float, float]]) -> Column:
    """A character's calibrated confidence; without a map, the confidence itself."""
    as_points = lambda own: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in own])
    return F.when(is_digit(ch), apply_isotonic(conf, as_points(digit))).otherwise(apply_isotonic(conf, as_points(overall))) if overall else conf


def deployed(before: str | None, candidate: str, fitted: bool, held: bool, ships: bool) -> str | None:
    """The artifact to deploy: the candidate if it ships, the identity if it was evaluated and doesn't, else what was deployed before."""
    if not (fitted and held):
        return before
    return candidate if ships else json.dumps({"schema": ARTIFACT, "signals": {}})


def reliability_report(bins: DataFrame, title: str) -> str:
    """A Markdown table of reliability bins with a bar for the accuracy of each."""
    rows = bins.orderBy("bin").collect()
    lines = [f"| {r.bin} | {r.n} | {r.mean_score:.3f} | {r.mean_good:.3f} | {'#' * round(20 * r.mean_good)} |" for r in rows]
    return "\n".join([f"# {title}", "", "| bin | n | confidence | accuracy | |", "| --- | --- | --- | --- | --- |", *lines, ""])
