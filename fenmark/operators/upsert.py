"""Upserts as aggregates: which row of a key stays, by max_by/min_by with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _one(df, keys, order, F.max_by)


def first_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _one(df, keys, order, F.min_by)


def replace_groups(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the groups that new has, and new: delete-then-insert."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], weak: Column) -> DataFrame:
    """old and new, one row a key: a row of new takes the place of what was there, but a weak one only comes where there was none.

    Where a key repeats within old or within new, the row that is not weak counts, and of several the greatest by the other columns in
    their order (nulls least).  Null keys are equal to each other.  An empty old gives new so reduced, and the other way round.
    """
    rest = [c for c in old.columns if c not in keys]
    ranked = lambda df, side: df.withColumn("_rank", F.struct(F.coalesce(~weak, F.lit(True)).alias("strong"), F.lit(side).alias("side"), *rest))
    both = ranked(old, 0).unionByName(ranked(new.select(*old.columns), 1))
    # One aggregate: the greatest strong row of new, else the greatest row of old, else the greatest weak row of new.
    tier = F.when((F.col("_rank.side") == 1) & F.col("_rank.strong"), 2).when(F.col("_rank.side") == 0, 1).otherwise(0)
    best = both.groupBy(*keys).agg(F.max(F.struct(tier.alias("tier"), F.col("_rank"))).alias("_best"))
    return best.select(*keys, *(F.col("_best._rank")[c].alias(c) for c in rest)).select(*old.columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old, and the rows of new whose keys old lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))
