"""Positions within groups without a task that sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenmark.sources.scratch import discard, written

#: Hexadecimal digits of a hash that make a bucket: 4096 buckets a group.
BUCKET_DIGITS = 3
#: Ranges that a number's rows are cut to.
BUCKETS = 512
#: Rows of a group that one task may sort; groups of more are cut at quantiles.
SMALL = 1 << 16
#: Cuts of a block that is looked through at once.
STRIDE = 16


def hash_position(df: DataFrame, groups: Sequence[str], hash_hex: Column, tie: str, name: str = "position") -> DataFrame:
    """0-based positions within groups by (hash, tie), hash being uniform lower-case hexadecimal text.

    Rows are numbered within buckets of leading digits; a bucket's offset is a running count over its group's
    few bucket totals.  So a group's rows are dealt over thousands of tasks, however large it is.
    """
    keyed = df.withColumn("_hash", hash_hex).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    totals = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_hash", tie)) - 1
    return keyed.withColumn("_inside", inside).join(offsets, [*groups, "_bucket"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_hash", "_bucket", "_inside", "_before")


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """df with ``_bucket``: ranges of about equally many rows, cut at approximate quantiles, so that outliers don't gather the others in one."""
    numbers = df.withColumn("_by", F.col(by).cast("double"))
    cuts = sorted(set(numbers.approxQuantile("_by", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    splits = [float("-inf"), *(c for c in cuts if abs(c) != float("inf")), float("inf")]
    if len(splits) < 3:
        return numbers.drop("_by").withColumn("_bucket", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="_by", outputCol="_bucket", handleInvalid="keep").transform(numbers).drop("_by")


def number_position(df: DataFrame, by: str, name: str = "position", buckets: int = BUCKETS) -> DataFrame:
    """0-based positions of rows in the order of a distinct number such as a row's index.

    As hash_position, with buckets cut at quantiles of the number.
    """
    keyed = _bucketed(df, by, buckets)
    totals = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the few buckets
    offsets = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(by)) - 1
    return keyed.withColumn("_inside", inside).join(offsets, "_bucket").withColumn(name, F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before")


def average_ranks(df: DataFrame, column: str, name: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """(column, name): each distinct number's average 1-based rank.

    Distinct values are counted, cut at their quantiles, and numbered within these ranges; no task sorts the whole column.
    """
    counts = _bucketed(df.groupBy(column).agg(F.count("*").alias("_c")), column, buckets)
    first = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the few buckets
    offsets = counts.groupBy("_bucket").agg(F.sum("_c").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy("_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_inside", inside).join(offsets, "_bucket").select(column, (F.col("_before") + F.col("_inside") + (F.col("_c") + 1) / 2).alias(name))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the columns of right that aren't keys, joined by keys, null ones too."""
    own = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & left[k].eqNullSafe(own[f"_k{i}"])
    return left.join(own, match, how).drop(*(f"_k{i}" for i in range(len(keys))))


def _blocks(descending: bool) -> dict[str, Column]:
    """``_cuts`` in the order of rows, and ``_ends``, each STRIDE-th of them: a row looks at these and at one block, not at all cuts."""
    ordered = F.reverse("_cuts") if descending else F.col("_cuts")
    return {"_cuts": ordered, "_ends": F.filter(ordered, lambda c, i: (i + 1) % STRIDE == 0)}


def running(df: DataFrame, keys: Sequence[str], by: str, totals: dict[str, str], descending: bool = False, buckets: int = 256) -> DataFrame:
    """df with, for each name of totals, the sum of its column over the rows of the same keys that come before in the order of by.

    by is a number that isn't null, and distinct within keys.  Keys of more than SMALL rows are cut at approximate quantiles of by: rows are summed up
    within a range, and what comes before a range is a running sum over its key's few ranges.  So the rows of a key, however many, are many tasks' work.
    """
    keys, small = list(keys), SMALL
    # Only keys of more than SMALL rows have cuts: few enough to be broadcast, so that no key's rows are gathered to meet them.
    cuts = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.when(F.count("*") > small, F.percentile_approx(by, F.array(*(F.lit(k / buckets) for k in range(1, buckets))), 10_000)).alias("_cuts")).where(F.col("_n") > small).drop("_n")
    before = lambda c: c > F.col(by) if descending else c < F.col(by)
    placed = same(df, F.broadcast(cuts.withColumns(_blocks(descending))), keys, "left").withColumn("_full", STRIDE * F.size(F.filter("_ends", before)))
    inside = F.size(F.filter(F.slice("_cuts", F.col("_full") + 1, F.lit(STRIDE)), before))
    placed = placed.withColumn("_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.col("_full") + inside)).drop("_cuts", "_ends", "_full")
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a key's few ranges
    sums = placed.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()))
    offsets = sums.select(*keys, "_range", *(F.coalesce(F.sum(f"_sum_{n}").over(w), F.lit(0)).alias(f"_off_{n}") for n in totals))
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(by) if descending else F.asc(by)).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()})
    out = same(summed, offsets, [*keys, "_range"])
    return out.select(*df.columns, *((F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in totals))


def value_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(k, v, rank): the average 1-based rank of each distinct number v of the k-th column, as a double; no column may hold nulls.

    The values of all columns are counted by one aggregate, and summed up by ranges (``running``).
    """
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))
    counts = written(df.select(F.explode(cells).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c")), "counts")
    ranks = written(running(counts, ["k"], "v", {"before": "c"}).select("k", "v", (F.col("before") + (F.col("c") + 1) / 2).alias("rank")), "ranks")
    discard(counts)
    return ranks


def quantiles(df: DataFrame, groups: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """(groups.., names): exact quantiles with linear interpolation, of values that aren't null.

    Values are counted, and counts summed up by ranges (``running``), so no task sorts a large group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    placed = same(running(counts, groups, "_v", {"_start": "_c"}), sizes, list(groups))
    here = lambda i: F.max(F.when((F.col("_start") + F.col("_c") > i) & (F.col("_start") <= i), F.col("_v")))
    parts = []
    for name, q in at.items():
        h = (F.col("_n") - 1) * q
        parts += [here(F.floor(h)).alias(f"_lo_{name}"), here(F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_w_{name}")]
    g = placed.groupBy(*groups).agg(*parts)
    return g.select(*groups, *((F.col(f"_lo_{n}") * (1 - F.col(f"_w_{n}")) + F.col(f"_hi_{n}") * F.col(f"_w_{n}")).alias(n) for n in at))


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, ties: bool = False) -> DataFrame:
    """The first k rows of each group; with ties, all rows ranked up to k.  (Spark prunes groups before the shuffle.)"""
    w = Window.partitionBy(*groups).orderBy(*order)
    rank = F.rank().over(w) if ties else F.row_number().over(w)
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
