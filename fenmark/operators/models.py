"""Fitting, tuning, scoring and attribution of all tasks (run, repeat, fold) at once.

*Fitting.*  Tasks of at most ``BLOCK_CELLS`` training numbers are one block, and run their learner's steps (``learn``) where that block is.  The rows of all others are dealt to the workers and stay there while one job
takes all steps of descents and boosting (``together``).  Forests, whose sums are large and whose steps few, take one aggregate a level: pieces of rows give their part of the sums, Spark adds them up by task, learner and key, and a group
of one learner's sums makes its next state, which is as large as a model and not as the data.  Where no job can keep rows in their workers (executors that come and go), all learners take such an aggregate a step.
Tasks of equal rows, which differ by their algorithm alone, share them.

*Models are a relation*: a row for each task, setting and held-out inner fold, with its imputation and scaling, its weights or its trees (arrays of nodes, numbered as in
a heap).  Rows meet their task's models in chunks, in Arrow tables; probabilities, inner scores for tuning and importances are DataFrame expressions over what comes of it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fenmark.functions.scalars import clamp, finite, sigmoid
from fenmark.operators import learn, metrics, preprocess, together
from fenmark.operators.ranks import hash_position
from fenmark.sources.scratch import discard, written

SEED_STEP = 31337
INNER_FOLDS = 3
#: Numbers of a block: 64 MB of features.
BLOCK_CELLS = 1 << 23
#: Numbers of a chunk of rows that is scored at once: 8 MB of features.
CHUNK_CELLS = 1 << 20
#: Numbers of a piece of rows that takes a step of all learners at once: 32 MB of features.
LEVEL_CELLS = 1 << 22
NODE = "struct<feature:int,threshold:double,value:double,n:double,n_pos:double>"
MODEL = f"task int, setting int, held int, med array<double>, mean array<double>, sd array<double>, weights array<double>, bias double, base double, rate double, trees array<array<{NODE}>>"
DUMMIES = ("DummyMajority", "DummyStratified")


# Tasks


def class_weight(p: int, n: int) -> float:
    """The weight of each of p positives beside n negatives."""
    return max(n / p, 1.0) if p and n else 1.0


def prepared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's features imputed by medians (0 without any) and scaled, and the medians, means and deviations."""
    x = np.where(np.isfinite(x), x, np.nan)
    known = ~np.isnan(x)
    med = np.array([np.median(x[known[:, j], j]) if known[:, j].any() else 0.0 for j in range(x.shape[1])])
    x = np.where(known, x, med)
    summed = lambda x: np.array([learn.sum_parts(x[:, j])[0] for j in range(x.shape[1])])
    mean = summed(x) / len(x)
    sd = np.maximum(np.sqrt(summed((x - mean) ** 2) / max(len(x) - 1, 1)), preprocess.MIN_SD)
    return (x - mean) / sd, med, mean, sd


class Tasks:
    """Tasks numbered, and their rows: (task, sample_id, y, is_train, h, x)."""

    def __init__(self, tasks: DataFrame, keys: Sequence[str], seed: int) -> None:
        own, self.keys, self.seed = tasks.where(~F.col("algorithm").isin(*DUMMIES)), list(keys), seed
        train = F.col("is_train") == 1
        heads = own.groupBy(*keys).agg(F.first("feature_names").alias("names"), F.count_if(train).alias("n"), F.count_if(train & (F.col("true_label") == 1)).alias("n_pos"), F.max(F.size("features")).alias("d"), F.count("*").alias("rows"))
        self.heads = sorted(heads.collect(), key=lambda r: repr([r[k] for k in keys]))  # a row a task
        spark = tasks.sparkSession
        kinds = dict(tasks.dtypes)
        schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", task int, names array<string>"
        self.table = spark.createDataFrame([(*(r[k] for k in keys), i, list(r.names)) for i, r in enumerate(self.heads)], schema)
        numbered = own.join(F.broadcast(self.table.select(*keys, "task")), list(keys))
        self.rows = written(numbered.select("task", "sample_id", F.col("true_label").cast("int").alias("y"), "is_train", F.xxhash64("sample_id").alias("h"), F.col("features").alias("x")), "rows")

    def own_seed(self, i: int) -> int:
        r = self.heads[i].asDict()
        return (self.seed + int(r.get("repeat_index", 0)) * SEED_STEP + int(r.get("fold_index", 0))) % (1 << 63)

    def column(self, i: int) -> int | None:
        names = list(self.heads[i].names)
        return names.index("EC") if "EC" in names else None

    def train(self, inner_folds: int | None) -> DataFrame:
        """Training rows with their inner fold (-1 without): within a task and class dealt round robin in the order of md5(seed:sample_id)."""
        rows = self.rows.where("is_train = 1")
        if inner_folds is None:
            return rows.withColumn("inner", F.lit(-1))
        seeds = F.element_at(F.array(*(F.lit(self.own_seed(i)) for i in range(len(self.heads)))), F.col("task") + 1) if self.heads else F.lit(0)
        placed = hash_position(rows, ["task", "y"], F.md5(F.concat_ws(":", seeds.cast("string"), F.col("sample_id").cast("string"))), "sample_id")
        return placed.withColumn("inner", (F.col("position") % inner_folds).cast("int")).drop("position")


# Fitting


def fit(train: DataFrame, tasks: Tasks, wanted: dict[int, learn.Wanted], block_cells: int | None = None) -> DataFrame:
    """The models (MODEL) that are wanted of tasks, from training rows (task, sample_id, y, h, inner, x)."""
    block_cells = block_cells or BLOCK_CELLS
    own = train.where(F.col("task").isin(*wanted)) if wanted else train.limit(0)
    wide = [i for i in wanted if tasks.heads[i].n * tasks.heads[i].d > block_cells]
    narrow = {i: w for i, w in wanted.items() if i not in set(wide)}
    parts = max((len(w.held) for w in narrow.values()), default=1)  # models that leave out different inner folds are fitted apart, each over a copy of the block

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_id", kind="stable")
        w, y = narrow[int(rows["task"].iloc[0])], rows["y"].to_numpy(float)
        w = replace(w, held=w.held[(part := int(rows["part"].iloc[0])) : part + 1])
        x, med, mean, sd = prepared(np.vstack(rows["x"].to_numpy()).astype(float))
        block = learn.Block(x, y, rows["inner"].to_numpy(), rows["h"].to_numpy().view(np.uint64))
        cuts = [learn.Cuts.of(x[:, j]) for j in range(x.shape[1])] if w.algorithm in learn.TREES else None
        out = []
        for names, learner in w.learners(x.shape[1], class_weight(int((y == 1).sum()), int((y == 0).sum())), cuts):
            learn.run(learner, block)
            out += learn.model_rows(names, learner)
        return pd.DataFrame(out, columns=None if out else ["setting", "held", "weights", "bias", "base", "rate", "trees"]).assign(task=rows["task"].iloc[0], med=[med.tolist()] * len(out), mean=[mean.tolist()] * len(out), sd=[sd.tolist()] * len(out))[[c.split()[0] for c in MODEL.split(", ")]]

    dealt = own.where(F.col("task").isin(*narrow)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = dealt.groupBy("task", "part").applyInPandas(local, MODEL) if narrow else train.sparkSession.createDataFrame([], MODEL)
    if wide:
        found = found.unionByName(_fit_in_steps(own.where(F.col("task").isin(*wide)), tasks, {i: wanted[i] for i in wide}))
    return found


def _statistics(train: DataFrame) -> tuple[dict[int, dict[str, np.ndarray]], dict[tuple[int, int], learn.Cuts]]:
    """Each task's medians, means and deviations, and the cuts of its scaled features, by aggregates over (task, feature).  What reaches the driver is as large as the models."""
    long = train.select("task", F.posexplode("x").alias("feature", "value"), F.lit(1).alias("is_train"))
    filled = written(preprocess.imputed(long, ["task"]), "filled")
    stats = preprocess.medians(long, ["task"]).join(preprocess.scaling(filled, ["task"]), ["task", "feature"])
    found: dict[int, dict[str, np.ndarray]] = {}
    rows = stats.orderBy("task", "feature").collect()
    for r in rows:
        found.setdefault(r.task, {"med": [], "mean": [], "sd": []})
        for c in ("med", "mean", "sd"):
            found[r.task][c].append(r["median" if c == "med" else c])
    found = {k: {c: np.array(v) for c, v in s.items()} for k, s in found.items()}
    steps = F.array(*(F.lit(k / (2 * learn.BINS)) for k in range(2 * learn.BINS + 1)))
    few = filled.groupBy("task", "feature").agg(F.percentile_approx("value", steps, 10_000).alias("at"), F.approx_count_distinct("value", 0.02).alias("n"))
    exact = filled.join(few.where(F.col("n") <= 2 * learn.BINS).select("task", "feature"), ["task", "feature"]).groupBy("task", "feature").agg(F.collect_set("value").alias("values"))  # few distinct values
    cuts = {}
    for r in few.join(exact, ["task", "feature"], "left").select("task", "feature", F.coalesce("values", "at").alias("values")).collect():
        cuts[r.task, r.feature] = learn.Cuts.of((np.array(r["values"]) - found[r.task]["mean"][r.feature]) / found[r.task]["sd"][r.feature])
    discard(filled)
    return found, cuts


def _alike(train: DataFrame) -> dict[int, int]:
    """Each task's first one of equal rows, by two sums of hashes of 64 bits."""
    sums = [F.sum(F.xxhash64(F.lit(k), "sample_id", "y", "inner", "x").cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    first: dict[tuple, int] = {}
    return {r.task: first.setdefault((r.n, r.h0, r.h1), r.task) for r in train.groupBy("task").agg(F.count("*").alias("n"), *sums).orderBy("task").collect()}  # a row a task


def _fit_in_steps(train: DataFrame, tasks: Tasks, wanted: dict[int, learn.Wanted]) -> DataFrame:
    """Learners of tasks that are more than a block: forests a job a level, the others in one job if rows can stay in their workers, else a job a step for all of them together."""
    spark = train.sparkSession
    first = _alike(train)
    d = {k: tasks.heads[k].d for k in set(first.values())}
    rows = written(train.where(F.col("task").isin(*d)).select("task", "y", "inner", "h", "x"), "train")
    positive = {i: class_weight(tasks.heads[i].n_pos, tasks.heads[i].n - tasks.heads[i].n_pos) for i in wanted}
    learners, names = {}, {}
    for i, w in wanted.items():
        for j, (own, learner) in enumerate(w.learners(d[first[i]], positive[i], [None] * d[first[i]])):  # cuts are not known yet
            learners[i, j], names[i, j] = learner, own
    if workers := together.workers(spark, sum(tasks.heads[k].n * n for k, n in d.items())):
        stats, cuts, done = together.fit(rows, workers, first, d, learners)
        learners |= done
    else:
        stats, cuts = _statistics(rows)
    together.with_cuts(learners, cuts, first)
    while going := {k: v for k, v in learners.items() if not v.done}:
        now = spark.sparkContext.broadcast((pickle.dumps(going), stats, first))
        summed = rows.where(F.col("task").isin(*{first[i] for i, _ in going})).mapInArrow(_parts(now), "task int, learner int, key long, a double, b double").groupBy("task", "learner", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        for r in summed.groupBy("task", "learner").applyInPandas(_advance(now), "task int, learner int, state binary").collect():  # states, as large as models
            learners[r.task, r.learner] = pickle.loads(r.state)
        for k in going:  # a learner without any row in a step
            if learners[k] is going[k]:
                learners[k].advance(np.zeros(0, np.int64), np.zeros((0, 2)))
        now.destroy()
    discard(rows)
    out = [{"task": i, **row, **{c: v.tolist() for c, v in stats[first[i]].items()}} for (i, j), learner in learners.items() for row in learn.model_rows(names[i, j], learner)]
    return spark.createDataFrame(out, MODEL)


def _parts(now):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, stats, first = now.value
        states, sums = pickle.loads(states), {}
        for k, x, *more in together.pieces(batches, LEVEL_CELLS):
            s = stats[k]
            block = learn.Block((np.where(np.isnan(x), s["med"], x) - s["mean"]) / s["sd"], *more)
            for own, learner in states.items():
                if first[own[0]] == k:
                    sums[own] = together.total([*([sums[own]] if own in sums else []), learner.sums(block)])
        for (i, j), (keys, numbers) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(np.full(len(keys), j, np.int32)), pa.array(keys.astype(np.int64)), pa.array(numbers[:, 0].astype(float)), pa.array(numbers[:, 1].astype(float))], ["task", "learner", "key", "a", "b"])

    return run


def _advance(now):
    def run(sums: pd.DataFrame) -> pd.DataFrame:
        sums = sums.sort_values("key")
        i, j = int(sums["task"].iloc[0]), int(sums["learner"].iloc[0])
        learner = pickle.loads(now.value[0])[i, j]
        learner.advance(sums["key"].to_numpy(), sums[["a", "b"]].to_numpy())
        return pd.DataFrame({"task": [i], "learner": [j], "state": [pickle.dumps(learner)]})

    return run


# Scoring


def _scaled(x: Column, med: Column, mean: Column, sd: Column) -> Column:
    filled = F.zip_with(x, med, lambda v, m: F.coalesce(finite(v), m))
    return F.zip_with(F.zip_with(filled, mean, lambda v, m: v - m), sd, lambda v, s: v / s)


def _by_trees(trees: pa.ListArray, x: np.ndarray, attributed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the trees' values for scaled features, and of what each feature adds on the way: how far a child's value is from the mean of both children by count."""
    nodes, of_tree = trees.flatten(), trees.offsets.to_numpy()
    heaps = [nodes.field(c).to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "value", "n")]
    total, by = np.zeros(len(x)), np.zeros(x.shape if attributed else (0, 0))
    for a, b in zip(of_tree[:-1] - of_tree[0], of_tree[1:] - of_tree[0], strict=True):
        feature, threshold, value, n = (h[a:b] for h in heaps)
        pair = np.arange(1, len(value) - 1, 2)[:, None] + np.arange(2)
        with np.errstate(all="ignore"):
            change = np.append(0.0, value[pair] - ((n[pair] * value[pair]).sum(1) / n[pair].sum(1))[:, None])
        at = np.zeros(len(x), np.int64)
        while len(own := np.flatnonzero(feature[at] >= 0)):
            here = at[own]
            f = feature[here]
            at[own] = here = 2 * here + 1 + (x[own, f] > threshold[here])
            if attributed:
                by[own, f] += change[here]
        total += value[at]
    return total, by


def _rows_by_models(attributed: bool | None, schema: pa.Schema):
    """A chunk of a task's rows and the task's models to a row for each pair: their sum s, and (unless attributed is None) scaled features and attributions."""

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        parts, n = [], len(rows)
        raw = np.array(rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else None
        for i in range(len(found) if n else 0):
            m = {c: found.column(c)[i] for c in found.column_names}
            fitted, s, x, by = m["mean"].is_valid, np.zeros(n), None, None
            if fitted:
                med, mean, sd = (np.array(m[c].as_py(), float) for c in ("med", "mean", "sd"))
                x = (np.where(np.isfinite(raw), raw, med) - mean) / sd
                by = np.zeros(x.shape)
            if m["trees"].is_valid:
                s, ways = _by_trees(m["trees"].values, x, bool(attributed))
                by = ways * (m["rate"].as_py() if m["rate"].is_valid else 1 / len(m["trees"].values)) if attributed else by
            elif m["weights"].is_valid:
                w = np.array(m["weights"].as_py(), float)
                for j in range(len(w)):  # in the features' order, so that a row's sum doesn't hang on the rows beside it
                    s += x[:, j] * w[j]
                s += m["bias"].as_py() if m["bias"].is_valid else np.nan  # a descent that ran off has none, and gives no probability
                if attributed:
                    share = np.abs(w).sum()
                    by = (np.arange(len(w)) == m["ec"].as_py() if m["ec"].is_valid else np.abs(w) / share if share > 0 else 0 * w) * (x - np.array(m["middle"].as_py()))
            made = {c: rows.column(c) for c in ("task", "sample_id", "y")}
            made |= {c: pa.array([m[c].as_py()] * n) for c in ("setting", "held", "base", "rate")}
            made |= {"weighted": pa.array([m["weights"].is_valid] * n), "size": pa.array([len(m["trees"].values) if m["trees"].is_valid else None] * n), "s": pa.array(s, from_pandas=True)}
            if attributed is not None:
                made |= {"x": lists(x) if fitted else pa.nulls(n, pa.list_(pa.float64())), "attributions": lists(by) if fitted and attributed else pa.nulls(n, pa.list_(pa.float64()))}
            parts.append(pa.table({f.name: made[f.name].cast(f.type) for f in schema}))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def scored(rows: DataFrame, found: DataFrame, tasks: Tasks, on: Sequence[str] = ("task",), attributed: bool | None = None) -> DataFrame:
    """Rows (task, sample_id, y, h, x) by the models of the same task (and what else is in on): task, sample_id, y, setting, held, base and p; unless attributed is None, also x scaled and attributions.

    Attributions are path contributions of trees, else importance (or the own column) times the distance from the middle, which found then holds beside the own column (``middle``, ``ec``).
    A task's rows are dealt to chunks of about ``CHUNK_CELLS`` numbers, and its models go to each of them: neither is repeated for each row.
    """
    kinds = dict(rows.dtypes)
    more = "" if attributed is None else ", x array<double>, attributions array<double>"
    ddl = f"task int, sample_id {kinds['sample_id']}, y int, setting int, held int, base double, rate double, weighted boolean, size int, s double{more}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    chunks = F.element_at(F.array(*(F.lit(max(1, -(-h.rows * max(h.d, 1) // CHUNK_CELLS))) for h in tasks.heads)), F.col("task") + 1) if tasks.heads else F.lit(1)
    dealt = rows.withColumn("chunk", F.pmod("h", chunks).cast("int"))
    models = found.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keys = [*on, "chunk"]
    out = dealt.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInArrow(_rows_by_models(attributed, schema), ddl)
    forest = clamp(F.col("s") / F.col("size"), 1e-10, 1 - 1e-10)
    boosted = clamp(sigmoid(F.col("base") + F.col("rate") * F.col("s")), 1e-10, 1 - 1e-10)
    p = F.when(F.col("size").isNull(), F.when(F.col("weighted"), sigmoid(F.col("s"))).otherwise(F.lit(0.5))).when(F.col("rate").isNull(), forest).otherwise(boosted)
    return out.withColumn("p", p).drop("s", "size", "rate", "weighted")


def _with_middles(found: DataFrame, test: DataFrame, ecs: dict[int, int]) -> DataFrame:
    """Models with the mean of their task's scaled test rows (linear ones) and the own column of those that have one."""
    linear = F.broadcast(found.where("weights is not null").select("task", "med", "mean", "sd"))  # a row a task
    x = test.join(linear, "task").select("task", F.posexplode(_scaled(F.col("x"), F.col("med"), F.col("mean"), F.col("sd"))).alias("k", "v"))
    middle = x.groupBy("task", "k").agg(F.avg("v").alias("v")).groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("middle"))
    ec = F.element_at(F.create_map(*(F.lit(v) for pair in ecs.items() for v in pair)), F.col("task")) if ecs else F.lit(None).cast("int")
    return found.join(F.broadcast(middle), "task", "left").withColumn("ec", ec)


def importances(found: DataFrame) -> DataFrame:
    """(task, setting, held, feature, importance): a linear model's shares of absolute weights, trees' mean shares of the gain in Gini impurity by counts; features without any are left out."""
    keys = ["task", "setting", "held"]
    linear = found.where(F.col("weights").isNotNull()).select(*keys, F.posexplode(F.transform("weights", F.abs)).alias("feature", "importance"))
    total = linear.groupBy(*keys).agg(F.sum("importance").alias("total"))
    linear = linear.join(total, keys).select(*keys, "feature", (F.col("importance") / F.col("total")).alias("importance")).where("importance > 0")
    nodes = found.where(F.col("trees").isNotNull()).select(*keys, F.size("trees").alias("size"), F.posexplode("trees").alias("tree", "nodes"))
    nodes = nodes.select(*keys, "size", "tree", "nodes", F.posexplode("nodes").alias("at", "node")).where("node.feature >= 0")
    child = lambda k: F.element_at("nodes", 2 * (F.col("at") + 1) + k)
    impurity = lambda c: F.coalesce(c["n"] * 2 * F.try_divide(c["n_pos"], c["n"]) * (1 - F.try_divide(c["n_pos"], c["n"])), F.lit(0.0))
    gains = nodes.select(*keys, "size", "tree", F.col("node.feature").alias("feature"), (impurity(F.col("node")) - impurity(child(0)) - impurity(child(1))).alias("gain"))
    each = gains.groupBy(*keys, "size", "tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = each.groupBy(*keys, "tree").agg(F.sum("gain").alias("whole")).where("whole > 0")
    shares = each.join(whole, [*keys, "tree"]).groupBy(*keys, "feature").agg(F.sum(F.col("gain") / F.col("whole") / F.col("size")).alias("importance"))
    return linear.unionByName(shares)


def _attributed(test: DataFrame, ec: Column) -> DataFrame:
    """Scored test rows with attributions (an array as long as x): path contributions of trees, else importance times the distance from the test rows' mean."""
    middle = test.where("trees is null").select("task", F.posexplode("x").alias("k", "v")).groupBy("task", "k").agg(F.avg("v").alias("v"))
    middle = middle.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("middle"))  # an array a task
    share = F.aggregate(F.transform("weights", F.abs), F.lit(0.0), lambda s, v: s + v)
    weight = F.when(ec.isNotNull(), F.transform("x", lambda v, k: (k == ec).cast("double"))).otherwise(F.transform("weights", lambda w: F.when(share > 0, F.abs(w) / share).otherwise(F.lit(0.0))))
    linear = F.zip_with(weight, F.zip_with("x", "middle", lambda v, m: v - m), lambda w, v: w * v)
    zero = F.transform("x", lambda v: F.lit(0.0))
    leaves = F.transform("trees", lambda tree: _leaf(tree, F.col("x")))
    steps = test.where("trees is not null").withColumn("_leaves", leaves).select("task", "sample_id", F.explode(F.flatten(F.zip_with("trees", "_leaves", _steps))).alias("s"))
    by_feature = steps.groupBy("task", "sample_id", "s.feature").agg(F.sum("s.by").alias("by")).groupBy("task", "sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "by"))).alias("by"))  # a map of features a row
    factor = F.when(F.col("rate").isNull(), 1 / F.size("trees")).otherwise(F.col("rate"))
    by_trees = F.transform("x", lambda v, k: factor * F.coalesce(F.element_at("by", k), F.lit(0.0)))
    out = test.join(middle, "task", "left").join(by_feature, ["task", "sample_id"], "left").withColumn("by", F.coalesce("by", F.create_map().cast("map<int,double>")))
    return out.withColumn("attributions", F.when(F.col("trees").isNotNull(), by_trees).when(F.col("weights").isNull(), zero).otherwise(linear)).drop("by", "middle")


# All together


def _setting(x) -> str:
    return "" if x is None else "_".join(f"{v:g}" for v in (x if isinstance(x, tuple) else (x,)))


def tuned_settings(train: DataFrame, tasks: Tasks, tunable: Sequence[int], inner_folds: int) -> dict[int, int]:
    """The setting of the best mean inner area of each task, the first of equally good ones; scaling and weight are the outer fold's.

    All settings and inner folds of all tasks are fitted together, and scored by one plan.
    """
    wanted = {i: learn.Wanted(tasks.heads[i].algorithm, tasks.own_seed(i), learn.GRIDS[tasks.heads[i].algorithm], tuple(range(inner_folds))) for i in tunable}
    found = written(fit(train, tasks, wanted), "inner")
    tests = train.where(F.col("task").isin(*tunable)).withColumnRenamed("inner", "held")
    areas = metrics.pr_auc(scored(tests, found, tasks, ("task", "held")).select("task", "setting", "held", "y", "p"), ["task", "setting", "held"])
    means = areas.groupBy("task", "setting").agg((F.sum("pr_auc") / inner_folds).alias("score"))
    # Equal but for rounding counts as equal, so the first setting is the same whatever the order of sums.
    best = {r.task: r.setting for r in means.groupBy("task").agg(F.max_by("setting", F.struct(F.round("score", 12), -F.col("setting"))).alias("setting")).collect()}  # a row a task
    discard(found)
    return best


def _fitted(tasks: DataFrame, keys: Sequence[str], seed: int, tuned: bool, inner_folds: int) -> tuple[Tasks, DataFrame]:
    """Numbered tasks, and their models with hyperparameters and is_default."""
    own = Tasks(tasks, keys, seed)
    tunable = [i for i, h in enumerate(own.heads) if tuned and h.algorithm in learn.GRIDS and h.n >= 2 * inner_folds]
    train = written(own.train(inner_folds), "train") if tunable else own.train(None)
    best = tuned_settings(train, own, tunable, inner_folds) if tunable else {}
    chosen = {i: (learn.GRIDS[h.algorithm][best[i]] if i in best else learn.DEFAULTS.get(h.algorithm)) for i, h in enumerate(own.heads)}
    wanted = {i: learn.Wanted(h.algorithm, own.own_seed(i), (chosen[i],), column=own.column(i) if h.algorithm == "EcOnlyLogistic" else None) for i, h in enumerate(own.heads) if h.n and not (h.algorithm == "EcOnlyLogistic" and own.column(i) is None)}
    told = [(i, _setting(chosen[i]) if i in best or (tuned and h.algorithm in learn.GRIDS) else "", bool(tuned and h.algorithm in learn.GRIDS and i not in best)) for i, h in enumerate(own.heads)]
    found = written(fit(train, own, wanted), "models")
    return own, found.join(F.broadcast(tasks.sparkSession.createDataFrame(told, "task int, hyperparameters string, is_default boolean")), "task", "right")


def fitted(tasks: DataFrame, keys: Sequence[str], seed: int = 20260531, tuned: bool = False, inner_folds: int = INNER_FOLDS, attributed: bool = True) -> DataFrame:
    """All that one fit of each task gives, a row a test row: keys.., sample_id, true_label, predicted_probability, predicted_label, hyperparameters, is_default (too few rows to tune), base_value, feature_names, feature_values (scaled) and attributions.

    tasks: keys.. (with algorithm, repeat_index and fold_index), sample_id (once a task), true_label, is_train, feature_names and features (arrays).
    """
    keys = list(keys)
    own, found = _fitted(tasks, keys, seed, tuned, inner_folds)
    dummy = dummies(tasks.where(F.col("algorithm").isin(*DUMMIES)), keys)
    constant = tasks.where(F.col("algorithm").isin(*DUMMIES) & (F.col("is_train") != 1)).join(dummy, keys).withColumn("p", F.when(F.col("algorithm") == "DummyMajority", F.col("p_majority")).otherwise(F.coalesce("p_stratified", F.lit(0.0))))
    none = F.array().cast("array<double>")
    constant = constant.select(*keys, "sample_id", F.col("true_label").cast("int").alias("true_label"), "p", F.lit("").alias("hyperparameters"), F.lit(False).alias("is_default"), F.lit(None).cast("double").alias("base_value"), F.array().cast("array<string>").alias("feature_names"), none.alias("feature_values"), none.alias("attributions"))
    test = own.rows.where("is_train <> 1")
    ecs = {i: own.column(i) for i, h in enumerate(own.heads) if h.algorithm == "EcOnlyLogistic" and own.column(i) is not None}
    told = F.broadcast(found.select("task", "hyperparameters", "is_default"))
    test = scored(test, _with_middles(found, test, ecs) if attributed else found, own, attributed=attributed).join(told, "task")
    names = F.broadcast(own.table)
    made = test.join(names, "task").select(*keys, "sample_id", F.col("y").alias("true_label"), "p", "hyperparameters", "is_default", F.coalesce("base", F.lit(0.0)).alias("base_value"), F.col("names").alias("feature_names"), F.col("x").alias("feature_values"), F.col("attributions") if attributed else none.alias("attributions"))
    out = made.unionByName(constant).withColumn("predicted_probability", F.col("p")).withColumn("predicted_label", (F.col("p") >= 0.5).cast("int"))
    return out.select(*keys, "sample_id", "true_label", "predicted_probability", "predicted_label", "hyperparameters", "is_default", "base_value", "feature_names", "feature_values", "attributions")


def predictions(tasks: DataFrame, keys: Sequence[str], seed: int = 20260531, tuned: bool = False) -> DataFrame:
    """Test rows of each task: keys.., sample_id, true_label, predicted_probability, predicted_label, hyperparameters."""
    return fitted(tasks, keys, seed, tuned, attributed=False).select(*keys, "sample_id", "true_label", "predicted_probability", "predicted_label", "hyperparameters")


def attributions(tasks: DataFrame, keys: Sequence[str], seed: int = 20260531, tuned: bool = False) -> DataFrame:
    """shap_values: keys.., sample_id, feature_name, feature_value (scaled), attribution, base_value of each test row."""
    each = fitted(tasks, keys, seed, tuned).withColumn("a", F.explode(F.arrays_zip("feature_names", "feature_values", "attributions")))
    return each.select(*keys, "sample_id", F.col("a.feature_names").alias("feature_name"), F.col("a.feature_values").alias("feature_value"), F.col("a.attributions").alias("attribution"), "base_value")


def feature_importances(tasks: DataFrame, keys: Sequence[str], seed: int = 20260531, tuned: bool = False, inner_folds: int = INNER_FOLDS) -> DataFrame:
    """(keys.., feature_name, importance) of each task's model; features that it doesn't use are left out."""
    own, found = _fitted(tasks, keys, seed, tuned, inner_folds)
    return importances(found).join(F.broadcast(own.table), "task").select(*keys, F.element_at("names", F.col("feature") + 1).alias("feature_name"), "importance")


def dummies(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both dummies' probabilities by one aggregate: keys.., p_majority, p_stratified."""
    y = F.when(F.col("is_train") == 1, F.col("true_label"))
    return tasks.groupBy(*keys).agg(F.when(F.sum(1 - y) >= F.sum(y), F.lit(0.0)).otherwise(F.lit(1.0)).alias("p_majority"), F.avg(y).alias("p_stratified"))
