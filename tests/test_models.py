"""Block learners and scoring plans against plain models: one at a time, exact trees, loops."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenmark.operators import learn, models, together

import plain_models as plain

SCHEMA = "sample_id string, true_label int, fold_index int, is_train int, features array<double>, feature_names array<string>, repeat_index int, algorithm string"
KEYS = ["algorithm", "repeat_index", "fold_index"]
NAMES = ["EC", "b", "c", "d", "e"]


def data(seed=4, n=90, d=5, digits=1):
    """Few distinct values a feature, with gaps, so that many rows tie."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), digits)
    y = (x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + rng.normal(0, 0.4, n) > 0.3).astype(int)
    x[rng.random((n, d)) < 0.05] = np.nan
    return x, y


def frame(spark, x, y, *algorithms, folds=(0, 1)):
    rows = [(f"s{i:03d}", int(y[i]), k, int(i % 3 != k), [float(v) for v in x[i]], NAMES[: x.shape[1]], 0, a) for i in range(len(y)) for k in folds for a in algorithms]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def blocks(x, y, fold, hashes):
    train = np.arange(len(y)) % 3 != fold
    own, med, mean, sd = models.prepared(x[train])
    test = (np.where(np.isfinite(x[~train]), x[~train], med) - mean) / sd
    return learn.Block(own, y[train].astype(float), np.full(train.sum(), -1), hashes[train]), test, np.flatnonzero(~train)


@pytest.fixture(scope="module")
def hashes(spark):
    rows = spark.range(90).select(F.xxhash64(F.format_string("s%03d", "id")).alias("h")).collect()
    return np.array([r.h for r in rows], np.int64).view(np.uint64)


def plain_forest(block, test, setting, seed, positive):
    """Exact trees on the rows that the bootstrap counts repeat."""
    values, steps = [], []
    for t in range(setting[0]):
        count = np.searchsorted(learn._POISSON, learn.uniform(block.h, seed * 1_000_003 + t), "right")
        rows = np.repeat(np.arange(len(block.y)), count)
        tree = plain.classification_tree(block.x[rows], block.y[rows], np.where(block.y[rows] == 1, positive, 1.0), setting[1], learn.feature_subset(seed, t, block.x.shape[1]))
        values.append(tree.predict(test))
        steps.append(tree.contributions(test))
    return np.clip(np.mean(values, axis=0), 1e-10, 1 - 1e-10), np.mean(steps, axis=0)


def plain_boosting(block, test, setting, seed, positive):
    w, base = np.where(block.y == 1, positive, 1.0), plain.log_odds(float(np.clip(block.y.mean(), 1e-6, 1 - 1e-6)))
    f, g, steps = np.full(len(block.y), base), np.full(len(test), base), np.zeros(test.shape)
    for t in range(setting[0]):
        tree = plain.regression_tree(block.x, w * (block.y - plain.sigmoid(f)), 3, learn.feature_subset(seed, t, block.x.shape[1]))
        f, g, steps = f + setting[1] * tree.predict(block.x), g + setting[1] * tree.predict(test), steps + setting[1] * tree.contributions(test)
    return np.clip(plain.sigmoid(g), 1e-10, 1 - 1e-10), steps


def plain_logistic(block, test, setting, seed, positive, columns=slice(None)):
    m = plain.Logistic.fit(block.x[:, columns], block.y, positive, setting)
    share = np.abs(m.weights) / np.abs(m.weights).sum()
    return m.predict(test[:, columns]), share * (test[:, columns] - test[:, columns].mean(0))


WEIGH = models.class_weight
PLAIN = {"LogisticRegression": plain_logistic, "RandomForest": plain_forest, "GradientBoostedTrees": plain_boosting}
SEED = 20260531
#: A weight of positives by which sums are exact in any order, so that equal gains are equal in the plain trees, too.
WEIGHT = 2.0


@pytest.fixture(autouse=True)
def _weight(monkeypatch):
    monkeypatch.setattr(models, "class_weight", lambda p, n: WEIGHT)


def test_class_weights():
    assert (WEIGH(3, 9), WEIGH(9, 3), WEIGH(0, 5), WEIGH(5, 0)) == (3.0, 1.0, 1.0, 1.0)




@pytest.mark.parametrize("name", PLAIN)
@pytest.mark.parametrize("stepwise", [False, True])
def test_models_equal_plain_fits(spark, monkeypatch, hashes, name, stepwise):
    x, y = data()
    monkeypatch.setattr(learn, "STEPS", 1000 if not stepwise else 12)
    monkeypatch.setattr(plain, "STEPS", 1000 if not stepwise else 12)
    for key, small in {"RandomForest": (12, 3), "GradientBoostedTrees": (4, 0.2)}.items():
        monkeypatch.setitem(learn.DEFAULTS, key, small)
    monkeypatch.setattr(learn.Descent.__init__, "__defaults__", (None, learn.STEPS))
    if stepwise:  # every task is more than a block: one job a step
        monkeypatch.setattr(models, "BLOCK_CELLS", 20)
    got = models.fitted(frame(spark, x, y, name), KEYS).collect()
    for fold in (0, 1):
        block, test, rows = blocks(x, y, fold, hashes)
        p, a = PLAIN[name](block, test, learn.DEFAULTS[name], SEED + fold, WEIGHT)
        own = {r.sample_id: r for r in got if r.fold_index == fold}
        assert len(own) == len(rows)
        for k, i in enumerate(rows):
            r = own[f"s{i:03d}"]
            assert r.predicted_probability == pytest.approx(p[k], abs=1e-9) and r.true_label == y[i]
            assert list(r.attributions) == pytest.approx(a[k].tolist(), abs=1e-9)
            assert list(r.feature_values) == pytest.approx(test[k].tolist(), abs=1e-9)


def test_one_column_models(spark, hashes):
    x, y = data()
    rows = models.fitted(frame(spark, x, y, "EcOnlyLogistic"), KEYS).collect()
    block, test, at = blocks(x, y, 0, hashes)
    p, _ = plain_logistic(block, test, 1.0, 0, WEIGHT, [0])
    own = {r.sample_id: r for r in rows if r.fold_index == 0}
    assert [own[f"s{i:03d}"].predicted_probability for i in at] == pytest.approx(p.tolist(), abs=1e-9)
    assert all(r.base_value == 0.0 and r.attributions[1:] == [0.0] * 4 for r in own.values())
    other = frame(spark, x, y, "EcOnlyLogistic").withColumn("feature_names", F.transform("feature_names", lambda n: F.concat(F.lit("x"), n)))
    assert {r.predicted_probability for r in models.predictions(other, KEYS).collect()} == {0.5}


def test_steps_over_blocks_equal_one_block(monkeypatch):
    x, y = data(7, 120)
    x = models.prepared(x)[0]
    h, inner = np.arange(120, dtype=np.uint64) * np.uint64(77_777_777_777), np.arange(120) % 3
    cuts = [learn.Cuts.of(x[:, j]) for j in range(5)]
    parts = [slice(0, 50), slice(50, 55), slice(55, 120)]
    for make in (lambda: learn.Descent(5, 2.0, [0.1, 1.0, 1.0], [-1, 0, 2], steps=50), lambda: learn.Forest(cuts, (9, 4), 3, 2.0, 1), lambda: learn.Boosting(cuts, (7, 0.1), 3, 2.0, -1)):
        whole, cut = make(), make()
        learn.run(whole, learn.Block(x, y.astype(float), inner, h))
        each = [learn.Block(x[s], y[s].astype(float), inner[s], h[s]) for s in parts]
        while not cut.done:
            sums = [cut.sums(b) for b in each]
            keys, at = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
            total = np.zeros((len(keys), 2))
            np.add.at(total, at, np.concatenate([v for _, v in sums]))
            cut.advance(keys, total)
        a, b = learn.model_rows([(0, -1)] if not isinstance(whole, learn.Descent) else [(0, -1), (1, 0), (2, 2)], whole), learn.model_rows([(0, -1)] if not isinstance(cut, learn.Descent) else [(0, -1), (1, 0), (2, 2)], cut)
        for r, s in zip(a, b, strict=True):
            if r["trees"] is None:
                assert r["weights"] == pytest.approx(s["weights"]) and r["base"] == pytest.approx(s["base"])
            else:
                nodes = lambda m: [(n["feature"], n["threshold"], n["n"]) for tree in m["trees"] for n in tree]
                assert nodes(r) == nodes(s)


def test_tuning_takes_the_best_mean_inner_area(spark, monkeypatch, hashes):
    x, y = data(5)
    monkeypatch.setitem(learn.GRIDS, "RandomForest", ((3, 1), (10, 3)))
    monkeypatch.setitem(learn.GRIDS, "LogisticRegression", (0.001, 1.0))
    tasks = frame(spark, x, y, "LogisticRegression", "RandomForest", folds=(0,))
    own = models.Tasks(tasks, KEYS, SEED)
    train = own.train(3).cache()
    rows = sorted(train.where("task = 0").collect(), key=lambda r: r.sample_id)
    inner = np.array([r.inner for r in rows])
    assert np.ptp(np.bincount(inner)) <= 2
    block, _, _ = blocks(x, y, 0, hashes)
    want, positive = {}, WEIGHT
    cuts = [learn.Cuts.of(block.x[:, j]) for j in range(5)]
    for i, name in enumerate(["LogisticRegression", "RandomForest"]):
        areas = []
        for setting in learn.GRIDS[name]:
            each = []
            for k in range(3):
                a, b = inner != k, inner == k
                if name == "LogisticRegression":
                    p = plain.Logistic.fit(block.x[a], block.y[a], positive, setting).predict(block.x[b])
                else:
                    forest = learn.Forest(cuts, setting, SEED, positive, k)
                    learn.run(forest, learn.Block(block.x, block.y, inner, block.h))
                    bins = learn.Block(block.x[b], block.y[b], inner[b], block.h[b]).bins(cuts)
                    p = np.mean([forest.value[t, forest.places(t, bins)] for t in range(setting[0])], axis=0)
                each.append(plain.average_area(block.y[b], p))
            areas.append(np.mean(each))
        want[i] = int(np.argmax(np.round(areas, 12)))
    assert [h.algorithm for h in own.heads] == ["LogisticRegression", "RandomForest"]
    assert models.tuned_settings(train, own, [0, 1], 3) == want
    told = {(r.algorithm, r.hyperparameters) for r in models.predictions(tasks, KEYS, tuned=True).collect()}
    assert told == {("LogisticRegression", f"{(0.001, 1.0)[want[0]]:g}"), ("RandomForest", ("3_1", "10_3")[want[1]])}


def test_importances_are_shares_of_gain_and_weight(spark, hashes):
    x, y = data()
    got = models.feature_importances(frame(spark, x, y, "LogisticRegression", "RandomForest", folds=(0,)), KEYS).collect()
    for name in ("LogisticRegression", "RandomForest"):
        own = {r.feature_name: r.importance for r in got if r.algorithm == name}
        assert sum(own.values()) == pytest.approx(1.0, abs=0.05) and max(own, key=own.get) in NAMES
    block, _, _ = blocks(x, y, 0, hashes)
    positive = WEIGHT
    size, depth = learn.DEFAULTS["RandomForest"]
    want = np.zeros(5)
    for t in range(size):
        rows = np.repeat(np.arange(len(block.y)), np.searchsorted(learn._POISSON, learn.uniform(block.h, SEED * 1_000_003 + t), "right"))
        tree = plain.classification_tree(block.x[rows], block.y[rows], np.where(block.y[rows] == 1, positive, 1.0), depth, learn.feature_subset(SEED, t, 5))
        want += tree.importances(5) / size
    assert {n: own.get(n, 0.0) for n in NAMES} == pytest.approx(dict(zip(NAMES, want.tolist(), strict=True)), abs=1e-9)


def test_many_distinct_values_are_binned_at_quantiles():
    rng = np.random.default_rng(1)
    c = learn.Cuts.of(rng.normal(size=5000))
    assert len(c.edges) == learn.BINS - 1 and not len(c.single)
    share = np.bincount(np.searchsorted(c.edges, rng.normal(size=50_000)), minlength=learn.BINS) / 50_000
    assert share.max() < 3 / learn.BINS
    x = rng.normal(size=(400, 3))
    y = (x[:, 1] > 0.25).astype(float)
    forest = learn.Forest([learn.Cuts.of(x[:, j]) for j in range(3)], (30, 3), 1, 1.0, -1)
    learn.run(forest, learn.Block(x, y, np.full(400, -1), np.arange(400, dtype=np.uint64)))
    p = np.mean([forest.value[t, forest.places(t, learn.Block(x, y, y, y).bins(forest.cuts))] for t in range(30)], axis=0)
    assert plain.average_area(y, p) > 0.97


@pytest.mark.parametrize("name", ["RandomForest", "GradientBoostedTrees", "LogisticRegression"])
def test_rows_are_scored_in_chunks_and_carry_no_model(spark, monkeypatch, name):
    x, y = data()
    for key, small in {"RandomForest": (5, 3), "GradientBoostedTrees": (4, 0.2)}.items():
        monkeypatch.setitem(learn.DEFAULTS, key, small)
    tasks = frame(spark, x, y, name, folds=(0,))
    want = {(r.sample_id, r.feature_name): r.attribution for r in models.attributions(tasks, KEYS).collect()}
    monkeypatch.setattr(models, "CHUNK_CELLS", 50)  # 90 rows of 5: 9 chunks
    got = models.attributions(tasks, KEYS)
    assert {(r.sample_id, r.feature_name): r.attribution for r in got.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 30 * 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "transform(trees" not in plan  # trees weren't walked by an expression for each row


def test_tuning_fits_inner_folds_apart(spark):
    x, y = data()
    own = models.Tasks(frame(spark, x, y, "LogisticRegression", folds=(0,)), KEYS, SEED)
    found = models.fit(own.train(3), own, {0: learn.Wanted("LogisticRegression", SEED, (0.1, 1.0), (0, 1, 2))})
    assert sorted((r.setting, r.held) for r in found.collect()) == [(s, k) for s in (0, 1) for k in (0, 1, 2)]
    node = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapGroupsInPandas" in line)
    assert "part" in node  # a group held all inner folds of a task


def test_rows_stay_in_their_workers_for_all_steps(spark, monkeypatch):
    """Tasks of several blocks: a few jobs, not one a step; the same models as by a job a step."""
    x, y = data(6)
    own = models.Tasks(frame(spark, x, y, "LogisticRegression", "GradientBoostedTrees", "RandomForest", folds=(0,)), KEYS, SEED)
    train = own.train(None).cache()
    settings = {"LogisticRegression": 1.0, "GradientBoostedTrees": (6, 0.2), "RandomForest": (4, 2)}
    monkeypatch.setattr(learn.Descent.__init__, "__defaults__", (None, 25))
    wanted = {i: learn.Wanted(h.algorithm, SEED, (settings[h.algorithm],)) for i, h in enumerate(own.heads)}
    assert len(set(models._alike(train).values())) == 1

    def fitted(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = models.fit(train, own, wanted, 20).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return sorted(rows, key=lambda r: r.task), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    got, jobs = fitted("together")
    assert jobs < 25  # a descent of 25 steps, and six trees of three levels
    monkeypatch.setattr(together, "workers", lambda *_: 0)
    want, _ = fitted("steps")
    for r, s in zip(got, want, strict=True):
        assert r.weights == (s.weights and pytest.approx(s.weights, abs=1e-12)) and r.mean == pytest.approx(s.mean, abs=1e-12)
        nodes = lambda m: [(n.feature, round(n.threshold, 9), n.n) for tree in m.trees or [] for n in tree]
        assert nodes(r) == nodes(s)


def test_statistics_of_parts_are_those_of_the_whole():
    """Medians, scaling and cuts of rows dealt to workers, one of them without any: exact, and the same bits however they are dealt."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1501, 4)) * [1, 1e-8, 1e6, 0] + [0, 1e4, -5, 7]
    x[:, 2] = np.round(x[:, 2], -5)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 1][:1400] = np.nan
    held = []
    for part in (x[:10], x[:0], x[10:900], x[900:]):
        held.append(together.Held(4))
        held[-1].add(part, np.zeros(len(part)), np.zeros(len(part), np.int32), np.zeros(len(part), np.uint64))
        held[-1].close()
    meet, box, out = threading.Barrier(len(held), timeout=60), [None] * len(held), [None] * len(held)

    def work(k):
        def told(own):
            box[k] = own
            meet.wait()
            found = list(box)
            meet.wait()
            return found

        out[k] = together.statistics({0: held[k]}, told, {0})

    threads = [threading.Thread(target=work, args=(k,)) for k in range(len(held))]
    [t.start() for t in threads], [t.join() for t in threads]
    scaled, med, mean, sd = models.prepared(x)
    for stats, cuts in out:
        assert (stats[0]["med"] == med).all() and (stats[0]["mean"] == mean).all() and (stats[0]["sd"] == sd).all()
        for j in range(4):
            filled = np.sort(np.where(np.isnan(x[:, j]), med[j], x[:, j]))
            few = np.unique(filled)
            at = filled if len(few) > 2 * learn.BINS else few
            at = at[np.maximum(np.ceil(np.arange(257) * len(at) / 256).astype(int) - 1, 0)] if len(few) > 2 * learn.BINS else few
            assert (cuts[0, j].edges == learn.Cuts.of((at - mean[j]) / sd[j]).edges).all()
    assert len(out[0][1][0, 0].edges) == learn.BINS - 1 and len(out[0][1][0, 3].edges) == 0


def test_a_descent_that_runs_off_gives_no_probability_and_is_not_chosen(spark, monkeypatch):
    """A strong penalty on few rows: steps grow beyond all bounds."""
    x, y = data(8, 18)
    monkeypatch.setitem(learn.GRIDS, "LogisticRegression", (0.0001, 1.0))
    tasks = frame(spark, x, y, "LogisticRegression", folds=(0,))
    own = models.Tasks(tasks, KEYS, SEED)
    train = own.train(3).cache()
    found = models.fit(train, own, {0: learn.Wanted("LogisticRegression", SEED, (0.0001, 1.0), (0, 1, 2))}).cache()
    assert {r.setting: r.n for r in found.where("bias is not null").groupBy("setting").agg(F.count("*").alias("n")).collect()} == {1: 3}
    got = models.scored(train.withColumnRenamed("inner", "held"), found, own, ("task", "held")).groupBy("setting").agg(F.count("*").alias("n"), F.count("p").alias("known")).collect()
    assert {(r.setting, r.n, r.known) for r in got} == {(0, 12, 0), (1, 12, 12)}
    assert models.tuned_settings(train, own, [0], 3) == {0: 1}
