"""Fold-local imputation, scaling and class weights: all folds of all tasks in one pass, in long form.

Frames are long: (keys.., sample_id, feature, value, is_train).  Statistics come from training rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.functions.scalars import finite
from fenmark.operators.ranks import quantiles

MIN_SD = 1e-8


def medians(long: DataFrame, keys: Sequence[str] = ("fold_index",)) -> DataFrame:
    """(keys.., feature, median): of finite training values, 0 if there is none."""
    groups = [*keys, "feature"]
    found = quantiles(long.where("is_train = 1").withColumn("value", finite(F.col("value"))), groups, "value", {"median": 0.5})
    return long.select(*groups).distinct().join(found, groups, "left").withColumn("median", F.coalesce("median", F.lit(0.0)))


def imputed(long: DataFrame, keys: Sequence[str] = ("fold_index",)) -> DataFrame:
    return long.join(medians(long, keys), [*keys, "feature"]).withColumn("value", F.coalesce(finite(F.col("value")), F.col("median"))).drop("median")


def scaling(filled: DataFrame, keys: Sequence[str] = ("fold_index",)) -> DataFrame:
    """(keys.., feature, mean, sd) of training rows; sd with n - 1, at least MIN_SD."""
    v = F.when(F.col("is_train") == 1, F.col("value"))
    return filled.groupBy(*keys, "feature").agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.greatest(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.lit(MIN_SD)).alias("sd"))


def scaled(filled: DataFrame, keys: Sequence[str] = ("fold_index",)) -> DataFrame:
    return filled.join(scaling(filled, keys), [*keys, "feature"]).withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def class_weights(rows: DataFrame, keys: Sequence[str] = ("fold_index",)) -> DataFrame:
    """(keys.., class_weight_pos): n_neg / n_pos of training rows, 1 at least and if a class is missing."""
    y = F.when(F.col("is_train") == 1, F.col("true_label"))
    p, n = F.sum(y), F.sum(1 - y)
    return rows.groupBy(*keys).agg(F.when((p > 0) & (n > 0), F.greatest(n / p, F.lit(1.0))).otherwise(F.lit(1.0)).alias("class_weight_pos"))
