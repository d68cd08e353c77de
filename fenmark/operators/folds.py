"""Fold assignment: seeded and stratified, repeated, by spatial group; and its validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenmark.operators.ranks import hash_position

REPEAT_STEP = 1_000_003


def seed_of(base: int, repeat: Column) -> Column:
    return F.lit(base).cast("long") + repeat.cast("long") * REPEAT_STEP


def repeated_stratified(labelled: DataFrame, k: int = 5, repeats: int = 5, seed: int = 20260531, groups: Sequence[str] = ()) -> DataFrame:
    """labelled (groups.., sample_id, true_label) with repeat_index, fold_index (that of its test fold) and random_seed.

    Within a repeat and class, samples are in the order of md5(seed:sample_id) and dealt round robin: folds are
    balanced within one sample, whatever the partitioning.
    """
    each = labelled.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("random_seed", seed_of(seed, F.col("repeat_index")))
    key = F.md5(F.concat_ws(":", F.col("random_seed").cast("string"), F.col("sample_id").cast("string")))
    placed = hash_position(each, [*groups, "repeat_index", "true_label"], key, "sample_id")
    return placed.withColumn("fold_index", (F.col("position") % k).cast("int")).drop("position")


def stratified(labelled: DataFrame, k: int = 5, seed: int = 20260531, groups: Sequence[str] = ()) -> DataFrame:
    return repeated_stratified(labelled, k, 1, seed, groups)


def spatial_groups(labelled: DataFrame, clusters: DataFrame, k: int = 3, groups: Sequence[str] = ()) -> DataFrame:
    """labelled with repeat_index 0 and fold_index: whole clusters, in order of their ids, dealt round robin.

    Samples without a cluster are in cluster 0.  clusters is (sample_id, spatial_cluster_id).
    """
    placed = labelled.join(clusters.select("sample_id", "spatial_cluster_id"), "sample_id", "left").withColumn("spatial_cluster_id", F.coalesce("spatial_cluster_id", F.lit(0)))
    present = placed.select(*groups, "spatial_cluster_id").distinct()
    w = Window.partitionBy(*groups).orderBy("spatial_cluster_id")  # over clusters, of which there are few
    dealt = present.withColumn("fold_index", ((F.row_number().over(w) - 1) % k).cast("int"))
    return placed.join(dealt, [*groups, "spatial_cluster_id"]).withColumn("repeat_index", F.lit(0))


def assignments(test_folds: DataFrame, k: int) -> DataFrame:
    """fold_assignments: every sample in every fold, as test or train."""
    return test_folds.withColumnRenamed("fold_index", "_own").withColumn("fold_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("split_role", F.when(F.col("fold_index") == F.col("_own"), "test").otherwise("train")).drop("_own")


def validation(test_folds: DataFrame, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Per repeat and fold: counts by role and class, and whether both classes are in either role."""
    own = test_folds.groupBy(*groups, "repeat_index", "fold_index").agg(F.count("*").alias("n_test"), F.sum("true_label").cast("long").alias("n_test_pos"))
    keys = [*groups, "repeat_index"]
    all_ = own.groupBy(*keys).agg(F.sum("n_test").alias("_n"), F.sum("n_test_pos").alias("_p"), F.count("*").alias("n_folds"))
    j = own.join(all_, keys)
    train, train_pos = F.col("_n") - F.col("n_test"), F.col("_p") - F.col("n_test_pos")
    both = (F.col("n_test_pos") > 0) & (F.col("n_test_pos") < F.col("n_test")) & (train_pos > 0) & (train_pos < train) & (F.col("n_folds") == k)
    return j.select(*keys, "fold_index", "n_test", "n_test_pos", train.alias("n_train"), train_pos.alias("n_train_pos"), both.cast("int").alias("is_valid"))


def require_valid(validated: DataFrame) -> None:
    bad = validated.where("is_valid = 0").limit(5).collect()
    if bad:
        raise ValueError(f"folds without both classes in train and test, or of another number than asked for: {bad}")
