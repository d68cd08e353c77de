"""Classification metrics over (keys.., y, p), for all keys at once.

Rank metrics work on counts of equal probabilities, which partial aggregation gives, and on sums of these counts by
ranges of probabilities (``ranks.running``), so a run of any number of distinct probabilities is dealt over tasks, and a tie of any size costs the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.functions.scalars import clamp, sigmoid
from fenmark.operators.ranks import running, same
from fenmark.sources.scratch import written

CUTOFFS = 99


def _ties(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., p, tp, fp): how many of either class have a probability."""
    return df.groupBy(*keys, "p").agg(F.sum("y").cast("long").alias("tp"), F.sum(1 - F.col("y")).cast("long").alias("fp"))


def roc_auc(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., roc_auc): trapezoids over groups of equal probabilities; 0.5 if a class is missing."""
    t = running(_ties(df, keys), keys, "p", {"_tp0": "tp"}, descending=True)
    area = F.sum(F.col("fp") * (F.col("_tp0") + F.col("tp") / 2))
    p, n = F.sum("tp"), F.sum("fp")
    return t.groupBy(*keys).agg(F.when((p > 0) & (n > 0), area / (p * n)).otherwise(F.lit(0.5)).alias("roc_auc"))


#: Numbers whose reciprocals are added one by one; beyond, differences of harmonic numbers are taken from their expansion.
FEW = 32


def harmonic_between(low: Column, n: Column) -> Column:
    """1 / (low + 1) + ... + 1 / (low + n), in a time that doesn't grow with n."""
    start = F.greatest(F.lit(FEW), low)  # from here on by the expansion
    some = F.least(n, F.greatest(start - low, F.lit(0)))
    added = F.aggregate(F.when(some > 0, F.sequence(F.lit(1).cast("long"), F.greatest(some, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, k: s + 1 / (low + k))
    x, m = start.cast("double"), (low + n - start).cast("double")
    y = x + m
    power = lambda k: 1 / F.pow(x, F.lit(float(k))) - 1 / F.pow(y, F.lit(float(k)))
    rest = F.log1p(m / x) - m / (2 * x * y) + power(2) / 12 - power(4) / 120 + power(6) / 252
    return added + F.when(m > 0, rest).otherwise(F.lit(0.0))


def pr_auc(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., pr_auc): trapezoids from recall 0 and precision 1; of equal probabilities negatives come first; 0 without positives.

    Within a group of m positives after a true and f false ones the k-th adds half the sum of the precisions
    before and after it, per positive of all.  The precisions after them, 1 - f / (a + f + k), add up to m less f times a difference of harmonic numbers.
    """
    t = running(_ties(df, keys), keys, "p", {"_a": "tp", "_b": "fp"}, descending=True).withColumn("_f", F.col("_b") + F.col("fp"))
    a, f, m = F.col("_a"), F.col("_f"), F.col("tp")
    precision = lambda k: F.when(a + k + f > 0, (a + k) / (a + k + f)).otherwise(F.lit(1.0))
    steps = m - f * harmonic_between(a + f, m) + (precision(F.lit(0)) - precision(m)) / 2
    return t.withColumn("_area", F.when(m > 0, steps).otherwise(F.lit(0.0))).groupBy(*keys).agg(F.when(F.sum("tp") > 0, F.sum("_area") / F.sum("tp")).otherwise(F.lit(0.0)).alias("pr_auc"))


def _share(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion(df: DataFrame, keys: Sequence[str], cutoff: float | Column = 0.5) -> DataFrame:
    """(keys.., tp, tn, fp, fn) at p >= cutoff."""
    at = F.col("p") >= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff))
    y = F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*keys).agg(n(at & y).alias("tp"), n(~at & ~y).alias("tn"), n(at & ~y).alias("fp"), n(~at & y).alias("fn"))


def rates() -> dict[str, Column]:
    """Rates of (tp, tn, fp, fn), 0 where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall, specificity, precision = _share(tp, tp + fn), _share(tn, tn + fp), _share(tp, tp + fp)
    return {"sensitivity": recall, "specificity": specificity, "precision": precision, "balanced_accuracy": (recall + specificity) / 2, "f1_score": _share(2 * precision * recall, precision + recall), "f2_score": _share(5 * precision * recall, 4 * precision + recall)}


def point_metrics(df: DataFrame, keys: Sequence[str], cutoff: float = 0.5) -> DataFrame:
    c = confusion(df, keys, cutoff)
    return c.select(*keys, "tp", "tn", "fp", "fn", *(e.alias(n) for n, e in rates().items()))


def brier(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2.0))), F.lit(1.0)).alias("brier_score"))


#: Least width of a bin of scores is 1 / BINS; terms of the series in a bin, and how far slope times half a bin may go for its rest to be below rounding.
BINS, TERMS, FAR = 64, 12, 0.15
#: Bins that a key may have; keys of more (scores of a very wide range) and lines that get too steep are fitted by a job a step.
CELLS = 1 << 14


def _sigmoid_series() -> np.ndarray:
    """Row k: coefficients, in powers of s = sigmoid(z), of its k-th derivative over k!."""
    out, now = np.zeros((TERMS, TERMS + 2)), np.polynomial.Polynomial([0.0, 1.0])
    for k in range(TERMS):
        out[k, : len(now.coef)] = now.coef / math.factorial(k)
        now = now.deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0])
    return out


_SERIES = _sigmoid_series()


def _line(middle: np.ndarray, moments: np.ndarray, s0: float, s1: float, n: float, steps: int, rate: float, start: tuple[float, float]) -> tuple[float, float] | None:
    """The line after all steps of descent, from moments (bin, power of the distance from the bin's middle) of weights; None if it gets too steep for the series."""
    slope, intercept = start
    far = middle[:, None] * moments[:, :-1] + moments[:, 1:]
    for _ in range(steps):
        if abs(slope) / (2 * BINS) > FAR:
            return None
        s = 1 / (1 + np.exp(-np.clip(slope * middle + intercept, -700, 700)))
        terms = np.vander(s, TERMS + 2, increasing=True) @ _SERIES.T * slope ** np.arange(TERMS)
        a, b = (terms * far).sum() - s1, (terms * moments[:, :-1]).sum() - s0
        slope, intercept = slope - rate * a / n, intercept - rate * b / n
    return float(slope), float(intercept)


def _descend(df: DataFrame, keys: Sequence[str], x: Column, steps: int, rate: float, start: tuple[float, float]) -> DataFrame:
    """(keys.., n, slope, intercept): gradient descent of mean log loss for sigmoid(slope * x + intercept) over all rows.

    Rows are read once: scores are cut to bins of 1 / BINS, and each bin keeps the sums of its scores' distances from its middle to the powers 0 .. TERMS.  Within
    a bin the sigmoid is its series at the middle, whose rest is below rounding, so a step needs no row.
    """
    keys = list(keys)
    own = df.withColumn("_x", x).withColumn("_y", F.col("y").cast("double")).withColumn("_bin", F.floor(F.col("_x") * BINS)).withColumn("_d", F.col("_x") - (F.col("_bin") + 0.5) / BINS)
    power = lambda k: F.lit(1.0) if k == 0 else reduce(lambda p, q: p * q, [F.col("_d")] * k)
    bins = written(own.groupBy(*keys, "_bin").agg(F.array(*(F.sum(power(k)) for k in range(TERMS + 1))).alias("m"), F.sum("_y").alias("s0"), F.sum(F.col("_y") * F.col("_x")).alias("s1")), "bins")
    kinds = dict(df.dtypes)
    sizes = bins.groupBy(*keys).agg(F.count("*").alias("_many"), F.sum(F.col("m")[0]).alias("n"))
    few = same(bins, sizes, keys).where(F.col("_many") <= CELLS)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_bin")
        n = float(g["n"].iloc[0])
        line = _line((g["_bin"].to_numpy(float) + 0.5) / BINS, np.vstack(g["m"].to_numpy()).astype(float), g["s0"].sum(), g["s1"].sum(), n, steps, rate, start)
        return pd.DataFrame([(*(g[k].iloc[0] for k in keys), n, *(line or (None, None)), line is not None)], columns=[*keys, "n", "slope", "intercept", "done"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "") + "n double, slope double, intercept double, done boolean"
    lines = written(few.groupBy(*keys).applyInPandas(fit, schema), "lines")
    found = lines.where("done").drop("done")
    wide = sizes.where(F.col("_many") > CELLS).select(*keys, "n").unionByName(lines.where("not done").select(*keys, "n")).collect()  # a row a key with a very wide range or a very steep line
    if not wide:
        return found
    cells = written(own.groupBy(*keys, "_x").agg(F.count("*").cast("double").alias("w"), F.sum("_y").alias("s")), "cells")
    return found.unionByName(_descend_in_steps(cells, keys, wide, found.schema, steps, rate, start))


def _descend_in_steps(cells: DataFrame, keys: list[str], wide: list, schema, steps: int, rate: float, start: tuple[float, float]) -> DataFrame:
    """The lines of the keys of wide: every step is one aggregate over their cells, joined with the few lines so far."""
    spark = cells.sparkSession
    lines = [(*(r[k] for k in keys), r.n, *start) for r in wide]
    for _ in range(steps):
        now = F.broadcast(spark.createDataFrame(lines, schema))
        e = F.col("w") * sigmoid(F.col("slope") * F.col("_x") + F.col("intercept")) - F.col("s")
        sums = same(cells, now, keys).groupBy(*keys, "n", "slope", "intercept").agg(F.sum(e * F.col("_x")).alias("a"), F.sum(e).alias("b")).collect()
        lines = [(*(r[k] for k in keys), r.n, r.slope - rate * r.a / r.n, r.intercept - rate * r.b / r.n) for r in sums]
    return spark.createDataFrame(lines, schema)


def calibration(df: DataFrame, keys: Sequence[str], steps: int = 1000, rate: float = 0.05) -> DataFrame:
    """(keys.., calibration_slope, calibration_intercept): fixed steps from (1, 0); (1, 0) for fewer than four rows."""
    q = clamp(F.col("p"), 1e-6, 1 - 1e-6)
    out = _descend(df, keys, F.ln(q / (1 - q)), steps, rate, (1.0, 0.0))
    few = F.col("n") < 4
    return out.select(*keys, F.when(few, F.lit(1.0)).otherwise(F.col("slope")).alias("calibration_slope"), F.when(few, F.lit(0.0)).otherwise(F.col("intercept")).alias("calibration_intercept"))


def platt(df: DataFrame, keys: Sequence[str], steps: int = 500, rate: float = 0.01) -> DataFrame:
    """(keys.., platt_slope, platt_intercept) over the raw score p."""
    return _descend(df, keys, F.col("p"), steps, rate, (1.0, 0.0)).select(*keys, F.col("slope").alias("platt_slope"), F.col("intercept").alias("platt_intercept"))


def hosmer_lemeshow(df: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """(keys.., hl_statistic): equal-count bins by p (the last takes the rest), ties by y.

    Bins are cut from the counts of (p, y), so no task sorts predictions: a count that
    spans a cut is shared out.
    """
    ties = running(_ties(df, keys).withColumn("c", F.col("tp") + F.col("fp")), keys, "p", {"_start": "c"})
    each = F.explode(F.array(F.struct(F.lit(0).alias("y"), F.col("fp").alias("c"), (F.col("_start") + F.col("fp")).alias("_end")), F.struct(F.lit(1).alias("y"), F.col("tp").alias("c"), (F.col("_start") + F.col("c")).alias("_end"))))
    cells = ties.select(*keys, "p", each.alias("x")).select(*keys, "p", "x.*").where("c > 0")
    placed = same(cells, cells.groupBy(*keys).agg(F.sum("c").alias("_n")), list(keys))
    size = F.greatest(F.floor(F.col("_n") / bins), F.lit(1))
    low = F.col("_end") - F.col("c")
    first, last = F.least(F.lit(bins - 1), F.floor(low / size)), F.least(F.lit(bins - 1), F.floor((F.col("_end") - 1) / size))
    cut = placed.withColumn("bin", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    until = F.when(F.col("bin") == bins - 1, F.col("_n")).otherwise((F.col("bin") + 1) * size)
    n = F.least(F.col("_end"), until) - F.greatest(low, F.col("bin") * size)
    each = cut.withColumn("n", n).where("n > 0").groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("o"), F.sum(F.col("n") * F.col("p")).alias("e"))
    mean = F.col("e") / F.col("n")
    return each.groupBy(*keys).agg(F.sum(F.when((mean > 0) & (mean < 1), F.pow(F.col("o") - F.col("e"), F.lit(2.0)) / (F.col("e") * (1 - mean))).otherwise(F.lit(0.0))).alias("hl_statistic"))


def threshold_sweep(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """threshold_sensitivity: counts and rates at the cutoffs 0.01 to 0.99.

    A prediction is counted once, at the highest cutoff that it reaches; counts are then summed from above.
    """
    k = F.floor(F.col("p") * 100)
    k = k + F.when(F.col("p") >= (k + 1) / 100, 1).when(F.col("p") < k / 100, -1).otherwise(0)
    hist = df.groupBy(*keys, F.least(F.lit(CUTOFFS), F.greatest(F.lit(0), k)).cast("int").alias("_k")).agg(F.sum("y").cast("long").alias("p1"), F.sum(1 - F.col("y")).cast("long").alias("p0"))
    all_ = hist.groupBy(*keys).agg(F.sum("p1").alias("pos"), F.sum("p0").alias("neg"), F.collect_list(F.struct("_k", "p1", "p0")).alias("_h"))  # a hundred cells at most
    grid = all_.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(CUTOFFS))))
    above = lambda f: F.aggregate(F.filter("_h", lambda x: x["_k"] >= F.col("_c")), F.lit(0).cast("long"), lambda s, x: s + x[f])
    counted = grid.select(*keys, (F.col("_c") / 100).alias("probability_cutoff"), above("p1").alias("tp"), above("p0").alias("fp"), "pos", "neg").withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp"))
    r = rates()
    return counted.select(*keys, "probability_cutoff", *(r[n].alias(n) for n in ("sensitivity", "specificity", "precision", "f1_score", "f2_score")), F.col("fn").alias("false_negatives_count"), F.col("fp").alias("false_positives_count"))


def operational_thresholds(sweep: DataFrame, keys: Sequence[str], least_sensitivity: float = 0.9) -> DataFrame:
    """Per key the cutoffs of three rules; of equally good cutoffs the greatest."""
    best = lambda m: F.max(F.struct(m.alias("m"), "probability_cutoff", "sensitivity", "specificity", "precision", "f2_score"))
    enough = F.when(F.col("sensitivity") >= least_sensitivity, F.struct(F.col("specificity").alias("m"), "probability_cutoff", "sensitivity", "specificity", "precision", "f2_score"))
    g = sweep.groupBy(*keys).agg(best(F.col("f2_score")).alias("f2"), F.max(enough).alias("enough"), best(F.col("sensitivity")).alias("most"), best(F.col("sensitivity") + F.col("specificity") - 1).alias("youden"))
    rules = F.array(
        F.struct(F.lit("max_F2").alias("threshold_rule"), F.col("f2").alias("x")),
        F.struct(F.when(F.col("enough").isNotNull(), F.lit("sens_ge_0.90")).otherwise(F.lit("best_sensitivity_available")).alias("threshold_rule"), F.coalesce("enough", "most").alias("x")),
        F.struct(F.lit("youden_index").alias("threshold_rule"), F.col("youden").alias("x")),
    )
    return g.select(*keys, F.explode(rules).alias("r")).select(*keys, "r.threshold_rule", *(F.col(f"r.x.{c}").alias(c) for c in ("probability_cutoff", "sensitivity", "specificity", "precision", "f2_score")))


def all_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """fold_metrics: the ten metrics and the test counts, one row a key."""
    keys = list(keys)
    points = point_metrics(df, keys).withColumn("n_test_pos", F.col("tp") + F.col("fn")).withColumn("n_test_neg", F.col("tn") + F.col("fp"))
    parts = [roc_auc(df, keys), pr_auc(df, keys), brier(df, keys), calibration(df, keys)]
    joined = reduce(lambda a, b: a.join(b, keys), parts, points)
    return joined.select(*keys, "roc_auc", "pr_auc", F.col("sensitivity").alias("recall"), "specificity", "precision", "balanced_accuracy", "f1_score", "f2_score", "brier_score", "calibration_slope", "calibration_intercept", "n_test_pos", "n_test_neg")
