"""Golden cases and invariants of the relational operators."""

import gzip
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fenmark import config as C
from fenmark.functions import scalars as S
from fenmark.operators import folds, ingest, leakage, metrics, models, preprocess, ranks, spatial, upsert
from fenmark.plans import reports
from fenmark.sources import readers

import plain_models

Y, P = [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.4, 0.1]


@pytest.mark.parametrize(
    ("raw", "limit", "want"),
    [
        ("", None, (None, 0, 0, None)), (None, 1.0, (None, 0, 0, None)), (" 7 ", None, (7.0, 0, 0, None)), ("BDL", None, (None, 1, 0, "bdl_stored_as_missing_no_limit")),
        ("bdl", 0.23, (0.16263455967290594, 1, 0, "substituted_as_limit_div_sqrt2")), ("-", None, (None, 1, 0, "bdl_stored_as_missing_no_limit")), ("bdl", -1.0, (None, 1, 0, "bdl_stored_as_missing_no_limit")),
        ("< 0.5", 9.0, (0.35355339059327373, 1, 0, "substituted_as_reported_limit_div_sqrt2")), ("<abc", 9.0, (None, 1, 1, "failed_bdl_limit_parse")), ("1,000", None, (None, 0, 1, None)), ("1d", None, (None, 0, 1, None)),
        ("1e3", None, (1000.0, 0, 0, None)), (".5", None, (0.5, 0, 0, None)), ("-inf", None, (-math.inf, 0, 0, None)),
    ],
)
def test_censored_numbers(spark, raw, limit, want):
    df = spark.createDataFrame([(raw, limit)], "raw string, lim double")
    assert tuple(df.select(S.parse_censored(F.col("raw"), F.col("lim")).alias("p")).first().p) == want


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert get(S.haversine_km(lit(7.9), lit(-1.0), lit(8.0), lit(-1.1))) == pytest.approx(15.649951730962968, abs=1e-9)
    assert get(S.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(111.19492664455873, abs=1e-9)
    made = S.derived({"Na": lit(120.0), "Ca": lit(40.0), "Mg": lit(15.0), "Cl": lit(0.0), "HCO3": lit(1.0)})
    assert get(made["SAR"]) == pytest.approx(4.107252826682475) and get(made["Na_Cl_ratio"]) is None
    assert get(S.run_id(lit("Na"), lit("Tier1 Field"), lit("RandomForest"), lit("Spatial_Group_CV"))) == "d5e2082899c8dfe71be06e2a20856361"
    assert [get(S.priority_class(lit(p))) for p in (0.75, 0.5, 0.25, 0.2)] == ["Very_High", "High", "Moderate", "Low"]
    assert [get(S.bin_right_closed(lit(p), 8)) for p in (0.0, 0.125, 0.126, 1.0)] == [1, 1, 2, 8]
    assert get(S.sigmoid(lit(31.0))) == 1 - 1e-15 and get(S.sigmoid(lit(-31.0))) == 1e-15 and get(S.logit(lit(0.5))) == 0
    assert get(S.title(lit("first\n\n  The title \nrest"))) == "The title" and get(S.title(lit("only"))) is None
    c = S.confusion_from_sensitivity(lit(1.0), lit(1.0), lit(2 / 3), lit(2 / 3))
    assert (get(c["tp"]), get(c["tn"])) == (2.0, 2.0)


def test_leakage_golden_table(spark):
    n = {(r.target_contaminant, r.variant, r.tier_name): r.n_features for r in leakage.counts(leakage.audit(leakage.candidates(spark), leakage.rules_frame(spark, C.STUDY_RULES))).collect()}
    for target, want in {"Na": (5, 11, 18), "Cl": (5, 11, 18), "TDS": (5, 12, 21), "B": (5, 12, 20), "F": (5, 12, 20), "NO3": (5, 12, 20)}.items():
        assert tuple(n[target, None, t] for t in C.TIERS) == want
    assert n["TDS", "TDS_EC_inclusive", "Tier2_Reduced"] == 12 and n["TDS", "TDS_EC_strict", "Tier2_Reduced"] == 11


def test_upserts(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, None)], "k int, at int, v string")
    assert sorted(tuple(r) for r in upsert.last_write_wins(df, ["k"], [F.col("at")]).collect()) == [(1, 3, "b"), (2, 1, None)]
    assert sorted(tuple(r) for r in upsert.first_write_wins(df, ["k"], [F.col("at")]).collect()) == [(1, 1, "a"), (2, 1, None)]
    new = spark.createDataFrame([(1, 9, "z"), (3, 9, "y")], "k int, at int, v string")
    assert sorted(r.k for r in upsert.replace_groups(df, new, ["k"]).collect()) == [1, 2, 3]
    assert sorted(r.v or "" for r in upsert.insert_missing(df, new, ["k"]).collect()) == ["", "a", "b", "c", "y"]


def test_clean_blank_cells_do_not_replace_values(spark):
    rows = [("s", 0, "Na", "5"), ("s", 1, "Na", ""), ("s", 2, "Cl", ""), ("s", 3, "Cl", None), ("t", 0, "Na", "bdl"), ("t", 1, "F", "<dl"), ("t", 2, "pH", "x")]
    m = {(r.sample_id, r.variable_name): r for r in ingest.clean(spark.createDataFrame(rows, "sample_id string, original_row_index long, variable_name string, raw_value_text string"), ingest.configured_limits(spark, {"F": 1.0})).collect()}
    assert m["s", "Na"].cleaned_value_real == 5 and m["s", "Cl"].cleaning_note == "empty_value" and m["s", "Cl"].missing_flag == 1 and m["s", "Cl"].unit is None
    assert m["t", "Na"].cleaned_value_real == pytest.approx(5 / math.sqrt(2)) and m["t", "Na"].cleaning_note == "bdl_substituted_using_min_detected_fallback"
    # A censored cell that starts with "<" gets the note of a reported limit, whatever limit it took.
    assert m["t", "F"].cleaned_value_real == pytest.approx(1 / math.sqrt(2)) and m["t", "F"].cleaning_note == "bdl_substituted_using_reported_detection_limit"
    assert m["t", "pH"].cleaning_note == "failed_numeric_parse" and m["t", "pH"].missing_flag == 1 and m["t", "pH"].unit == "dimensionless"


def frame(spark, y=Y, p=P, k="a"):
    return spark.createDataFrame([(k, int(a), float(b)) for a, b in zip(y, p, strict=True)], "k string, y int, p double")


def test_metrics_golden(spark):
    df = frame(spark)
    one = lambda d, c: d.first()[c]
    assert one(metrics.roc_auc(df, ["k"]), "roc_auc") == pytest.approx(0.7777777777777778)
    assert one(metrics.pr_auc(df, ["k"]), "pr_auc") == pytest.approx(0.711111111111111)
    assert one(metrics.brier(df, ["k"]), "brier_score") == pytest.approx(0.20333333333333337)
    assert tuple(metrics.confusion(df, ["k"]).first())[1:] == (2, 2, 1, 1)
    rules = {r.threshold_rule: r for r in metrics.operational_thresholds(metrics.threshold_sweep(df, ["k"]), ["k"]).collect()}
    assert rules["max_F2"].probability_cutoff == 0.4 and rules["max_F2"].f2_score == pytest.approx(0.8823529411764706)
    assert rules["sens_ge_0.90"].probability_cutoff == 0.4 and rules["sens_ge_0.90"].specificity == pytest.approx(1 / 3)
    assert rules["youden_index"].probability_cutoff == 0.9
    assert one(metrics.pr_auc(frame(spark, [1, 0, 1, 0, 0], [0.3] * 5), ["k"]), "pr_auc") == pytest.approx(0.225)
    assert one(metrics.roc_auc(frame(spark, [1, 1], [0.3, 0.2]), ["k"]), "roc_auc") == 0.5 and one(metrics.pr_auc(frame(spark, [0, 0], [0.3, 0.2]), ["k"]), "pr_auc") == 0
    assert tuple(metrics.calibration(frame(spark, [0, 1], [0.3, 0.2]), ["k"]).first())[1:] == (1.0, 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_rank_metrics_equal_plain_loops(spark, seed):
    rng = np.random.default_rng(seed)
    y, p = rng.integers(0, 2, 60), rng.integers(0, 8, 60) / 8
    df = frame(spark, y, p)
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert metrics.roc_auc(df, ["k"]).first().roc_auc == pytest.approx(wins)
    assert metrics.pr_auc(df, ["k"]).first().pr_auc == pytest.approx(plain_models.average_area(y, p))
    sweep = {round(r.probability_cutoff, 2): r for r in metrics.threshold_sweep(df, ["k"]).collect()}
    for c in range(1, 100):
        assert sweep[c / 100].false_positives_count == ((p >= c / 100) & (y == 0)).sum() and sweep[c / 100].false_negatives_count == ((p < c / 100) & (y == 1)).sum()
    slope, intercept = 1.0, 0.0
    q = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.log(q / (1 - q))
    for _ in range(1000):
        e = plain_models.sigmoid(slope * x + intercept) - y
        slope, intercept = slope - 0.05 * (e * x).mean(), intercept - 0.05 * e.mean()
    got = metrics.calibration(df, ["k"]).first()
    assert (got.calibration_slope, got.calibration_intercept) == (pytest.approx(slope, abs=1e-8), pytest.approx(intercept, abs=1e-8))


@pytest.mark.parametrize("small", [3, 1 << 16])
def test_metrics_and_quantiles_of_cut_groups_equal_plain_ones(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small)  # 3: every group is cut at quantiles
    rng = np.random.default_rng(9)
    groups = {"skewed": np.exp(rng.normal(0, 3, 400)), "ties": rng.integers(0, 5, 300) / 7, "constant": np.full(50, 2.5), None: rng.random(200), "one": np.array([4.0])}
    rows = [(g, float(v), int(rng.random() < 0.4)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame([*rows, ("nulls", None, 0)], "g string, v double, y int")
    got = {r.g: (r.low, r.mid, r.high) for r in ranks.quantiles(df, ["g"], "v", {"low": 0.025, "mid": 0.5, "high": 0.9}).collect()}
    assert got == {g: pytest.approx(tuple(np.quantile(x, [0.025, 0.5, 0.9]))) for g, x in groups.items()}
    summed = ranks.running(df.where("v is not null").groupBy("g", "v").agg(F.sum("y").alias("n")), ["g"], "v", {"before": "n"}, descending=True).collect()
    for r in summed:
        assert r.before == sum(y for g, v, y in rows if g == r.g and v > r.v)
    scores = spark.createDataFrame([(g or "none", y, v) for g, v, y in rows], "k string, y int, p double")
    area = {r.k: r.pr_auc for r in metrics.pr_auc(scores, ["k"]).collect()}
    for k in ("skewed", "ties", "none"):
        own = [(y, v) for g, v, y in rows if (g or "none") == k]
        assert area[k] == pytest.approx(plain_models.average_area(np.array([y for y, _ in own]), np.array([v for _, v in own])))


def test_large_runs_and_ties_are_many_tasks_work(spark):
    run = spark.range(400_000).select(F.lit("r").alias("k"), (F.col("id") / 400_000).alias("p"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
    placed = ranks.running(run, ["k"], "p", {"before": "y"}, descending=True)
    assert placed.where("p = 0").first().before == run.where("p > 0").agg(F.sum("y")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small ranges aren't put together
    try:
        tasks = placed.select(F.spark_partition_id().alias("task"), "p").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 200_000


def test_lines_of_many_scores_are_fitted_in_steps_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.random() < p), p) for k, n in (("a", 90), (None, 40), ("b", 3)) for p in rng.random(n).round(3).tolist()]
    df = spark.createDataFrame(rows, "k string, y int, p double")
    whole = {r.k: tuple(r)[1:] for r in metrics.calibration(df, ["k"], 25).collect()}
    monkeypatch.setattr(metrics, "CELLS", 10)
    cut = {r.k: tuple(r)[1:] for r in metrics.calibration(df, ["k"], 25).collect()}
    assert set(cut) == {"a", "b", None} and cut == {k: pytest.approx(v, abs=1e-12) for k, v in whole.items()} and whole["b"] == (1.0, 0.0) != whole["a"]


def test_harmonic_differences(spark):
    exact = lambda low, n: math.fsum(1 / (low + k) for k in range(1, n + 1))
    cases = [(0, 1), (0, 40), (5, 10), (31, 1), (31, 2), (32, 100_000), (10**9, 3), (10**6, 10**5), (0, 0), (7, 500)]
    df = spark.createDataFrame(cases, "low long, n long")
    for r in df.withColumn("h", metrics.harmonic_between(F.col("low"), F.col("n"))).collect():
        assert r.h == pytest.approx(exact(r.low, r.n), rel=1e-12, abs=1e-15)
    big = spark.createDataFrame([(0, 10**12)], "low long, n long").select(metrics.harmonic_between(F.col("low"), F.col("n"))).first()[0]
    assert big == pytest.approx(math.log(10**12) + 0.5772156649015329, rel=1e-12)


def test_folds_partition_and_balance(spark):
    df = spark.createDataFrame([(f"s{i}", int(i % 4 == 0)) for i in range(83)], "sample_id string, true_label int")
    f = folds.repeated_stratified(df, 5, 3, 7)
    again = folds.repeated_stratified(df.repartition(7), 5, 3, 7)
    cols = ["sample_id", "repeat_index", "fold_index"]
    assert sorted(f.select(cols).collect()) == sorted(again.select(cols).collect()) and f.count() == 249
    for r in f.groupBy("repeat_index", "true_label").agg(F.count_distinct("fold_index").alias("k")).collect():
        assert r.k == 5
    sizes = f.groupBy("repeat_index", "true_label", "fold_index").count().groupBy("repeat_index", "true_label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in sizes)
    assert folds.validation(f, 5).where("is_valid = 0").count() == 0
    folds.require_valid(folds.validation(f, 5))
    with pytest.raises(ValueError):
        folds.require_valid(folds.validation(folds.stratified(df.where("true_label = 0"), 5), 5))


def test_hash_positions_are_dense(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    out = ranks.hash_position(df, ["g"], F.md5(F.col("id").cast("string")), "id")
    for r in out.groupBy("g").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count_distinct("position").alias("n")).collect():
        assert (r.a, r.b, r.n) == (0, 2499, 2500)


def test_quantiles_and_ranks_are_exact(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=301), 1)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)] + [(0, None), (7, None)], "g int, x double")
    for r in ranks.quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.025, "c": 1.0}).collect():
        assert [r.a, r.b, r.c] == pytest.approx(np.percentile(v[r.g :: 2], [50, 2.5, 100]))
    got = {r.x: r["rank"] for r in ranks.average_ranks(df.where("x is not null"), "x").collect()}
    assert all(got[x] == pytest.approx((v < x).sum() + ((v == x).sum() + 1) / 2) for x in v)


def test_preprocessing_uses_training_rows_alone(spark):
    rows = [(0, "f", "a", 1.0, 1), (0, "f", "b", 3.0, 1), (0, "f", "c", 1000.0, 0), (0, "f", "d", None, 0), (0, "g", "a", None, 1), (0, "g", "b", float("nan"), 1), (0, "g", "c", 5.0, 0)]
    long = spark.createDataFrame(rows, "fold_index int, feature string, sample_id string, value double, is_train int")
    filled = {(r.feature, r.sample_id): r.value for r in preprocess.imputed(long).collect()}
    assert filled["f", "d"] == 2.0 and filled["g", "a"] == 0.0
    scaled = {(r.feature, r.sample_id): r.value for r in preprocess.scaled(preprocess.imputed(long)).collect()}
    assert scaled["f", "a"] == pytest.approx(-1 / math.sqrt(2)) and scaled["f", "c"] == pytest.approx(998 / math.sqrt(2))


@pytest.mark.parametrize("pieces", [4096, 40])
def test_diameters_equal_all_pairs(spark, monkeypatch, pieces):
    monkeypatch.setattr(spatial, "PIECE", pieces)  # 40: many pieces, two rounds
    rng = np.random.default_rng(2)
    circle = np.linspace(0, 2 * np.pi, 60)
    groups = [
        rng.normal([5, -3], [2, 4], (900, 2)), rng.uniform([60, 170], [75, 190], (500, 2)), np.column_stack([10 + 5 * np.cos(circle), 5 * np.sin(circle)]), np.array([[1.0, 2.0]] * 5), np.array([[0.0, 179.9], [0.1, -179.9]]),
        np.column_stack([np.full(50, 20.0), np.linspace(0, 3, 50)]), rng.uniform([-80, -170], [80, 170], (300, 2)), rng.normal([89, 0], [0.5, 90], (200, 2)).clip(-90, 90), np.repeat(rng.normal([40, 10], 1, (30, 2)), 7, axis=0),
    ]
    rows = [(g, float(a), float(o)) for g, x in enumerate(groups) for a, o in x]
    df = spark.createDataFrame(rows, "spatial_cluster_id int, lat double, lon double").repartition(3)
    got = {r.spatial_cluster_id: r.max_km for r in spatial.diameters(df).collect()}
    for g, x in enumerate(groups):
        a, o = np.radians(x[:, 0]), np.radians(x[:, 1])
        h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a)[:, None] * np.cos(a) * np.sin((o[:, None] - o) / 2) ** 2
        assert got[g] == pytest.approx(float((S.EARTH_KM * 2 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))).max()), abs=1e-6), g
    # Corners are far fewer than points, and grow slower: those of a normal cloud with the root of the logarithm.
    few = spatial.hulls(df.where("spatial_cluster_id = 0"), 1).count()
    assert 3 <= few <= 40


def test_kmeans_and_diameters(spark):
    rng = np.random.default_rng(3)
    pts = [(f"p{i}", float(5 * (i % 3) + rng.normal(0, 0.3)), float(10 * (i % 3) + rng.normal(0, 0.3)), i) for i in range(90)]
    df = spark.createDataFrame(pts, "sample_id string, lat double, lon double, original_row_index long")
    assigned, centroids, inertia = spatial.kmeans(df, 3)
    found = {r.sample_id: r.spatial_cluster_id for r in assigned.collect()}
    assert len(centroids) == 3 and inertia > 0
    lat, lon = np.radians([p[1] for p in pts]), np.radians([p[2] for p in pts])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    km = 6371 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    for r in spatial.metadata(assigned).collect():
        own = [i for i in range(90) if found[f"p{i}"] == r.spatial_cluster_id]
        assert r.n_samples == len(own) and r.max_intra_cluster_distance_km == pytest.approx(km[np.ix_(own, own)].max())
    assert spatial.choose_k(df, 5, 20) in (2, 3, 4) and spatial.choose_k(df.limit(3), 5) == 2


def test_kmeans_equals_plain_rounds(spark):
    rng = np.random.default_rng(9)
    at = rng.uniform(-40, 40, (300, 2))
    df = spark.createDataFrame([(f"p{i}", float(a), float(b), i) for i, (a, b) in enumerate(at)], "sample_id string, lat double, lon double, original_row_index long").repartition(5)

    def far(p, c):
        a, b = np.radians(p[:, None, :]), np.radians(c[None])
        h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
        return 6371 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    inertia = {}
    for k in (2, 3, 5):
        c, old = at[[(i * (300 // k)) % 300 for i in range(k)]], np.zeros(300, int)
        for _ in range(200):
            own = far(at, c).argmin(1)
            if (own == old).all():
                break
            old, c = own, np.array([at[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        inertia[k] = (far(at, c).min(1) ** 2).sum()
        assigned, found, spread = spatial.kmeans(df, k)
        assert {r.sample_id: r.spatial_cluster_id for r in assigned.collect()} == {f"p{i}": int(x) for i, x in enumerate(far(at, c).argmin(1))}
        assert np.allclose(found, c) and spread == pytest.approx(inertia[k])
    assert spatial._kmeans(df, [2, 3, 5], 200)[1] == pytest.approx(inertia)


def test_plain_models_learn_and_are_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    for name in C.ALGORITHMS:
        a, b = (plain_models.fit(name, x, y, 1.0, 5, ec=0) for _ in range(2))
        p = a.predict(x)
        assert (p == b.predict(x)).all() and ((p >= 0) & (p <= 1)).all()
        if not name.startswith("Dummy"):
            assert plain_models.average_area(y, p) > 0.75
            assert plain_models.attributions(a, x).shape == x.shape
    assert plain_models.tune("LogisticRegression", x, y, 1.0, 5) in plain_models.LOGISTIC_GRID
    assert plain_models.tune("RandomForest", x[:5], y[:5], 1.0, 5) == plain_models.DEFAULTS["RandomForest"]


def test_tree_splits_at_the_best_midpoint():
    x = np.array([[1.0], [2.0], [3.0], [10.0], [11.0], [12.0]])
    t = plain_models.classification_tree(x, np.array([0, 0, 0, 1, 1, 1.0]), np.ones(6), 1, np.array([0]))
    assert t.threshold[0] == 6.5 and t.predict(np.array([[6.5], [6.6]])).tolist() == [0.0, 1.0]
    assert t.contributions(np.array([[0.0], [20.0]])).ravel().tolist() == [-0.5, 0.5]


def test_predictions_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i:02d}", int(i % 3 == 0), k, int(i % 2 != k), [float(v) for v in rng.normal(size=3)], ["EC", "b", "c"], 0, a) for i in range(30) for k in (0, 1) for a in ("RandomForest", "GradientBoostedTrees")]
    df = spark.createDataFrame(rows, "sample_id string, true_label int, fold_index int, is_train int, features array<double>, feature_names array<string>, repeat_index int, algorithm string")
    keys = ["algorithm", "repeat_index", "fold_index"]
    a, b = (sorted(map(tuple, models.predictions(d, keys).collect())) for d in (df, df.repartition(9)))
    assert a == b and len(a) == 60


def test_feature_queries_bind_whole_vectors(spark):
    from fenmark.plans import bindings as B

    sf = "/root/testdata/sf0.001"
    whole = {str(r.vec_id): [float(v) for v in r.embedding] for r in B.table(spark, sf, "embeddings").collect()}
    tasks = B.tasks(spark, sf, "RandomForest").collect()
    assert {r.sample_id: r.features for r in tasks} == whole and {len(r.features) for r in tasks} == {len(r.feature_names) for r in tasks} == {64}
    assert B.long_rows(spark, sf).select("feature").distinct().count() == 64


def test_nearest_centroids_are_those_of_the_least_haversine():
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(-80, 80, 3000), rng.uniform(-179, 179, 3000)
    centroids = [*zip(lat[:6].tolist(), lon[:6].tolist(), strict=True), (float(lat[0]), float(lon[0])), (float(lat[1]) + 1e-9, float(lon[1]))]
    a, o = np.radians(lat), np.radians(lon)
    km = np.stack([np.sin((np.radians(x) - a) / 2) ** 2 + np.cos(a) * np.cos(np.radians(x)) * np.sin((np.radians(y) - o) / 2) ** 2 for x, y in centroids])
    assert (spatial.nearest_of(lat, lon, centroids) == km.argmin(0)).all()


def test_choose_k_query_tries_all_clusters_until_they_converge(spark, monkeypatch):
    from fenmark.plans import queries

    tried = []
    monkeypatch.setattr(spatial, "_kmeans", lambda points, ks, max_iter: tried.extend((k, max_iter) for k in ks) or ({}, {k: 10.0 - k for k in ks}))
    assert queries.QUERIES["choose_k"](spark, "/root/testdata/sf0.001").first().k == 8
    assert tried == [(k, 100) for k in range(2, 9)]


def test_bootstrap_draws_and_calibration(spark):
    from fenmark.operators import resample
    from fenmark.plans import queries

    assert queries.DRAWS == resample.DRAWS == 2000
    rng = np.random.default_rng(6)
    rows = [(f"s{i:02d}", r, int(i % 3 == 0), float(rng.integers(0, 9) / 8)) for i in range(12) for r in (0, 1)]
    drawn = resample.bootstrap(spark.createDataFrame(rows, "sample_id string, repeat_index int, y int, p double"), 40).cache()
    own = {}
    for r in drawn.collect():
        own.setdefault(r.draw, []).append((r.y, r.p))
    own = {d: np.array(v) for d, v in own.items() if len({y for y, _ in v}) == 2}
    got = {r.draw: (r.calibration_slope, r.calibration_intercept) for r in resample.calibration_lines(drawn).collect()}
    assert set(got) == set(own) and len(own) > 20
    assert {len(v) for v in own.values()} == {12}
    for d, v in own.items():
        y, q = v[:, 0], np.clip(v[:, 1], 1e-6, 1 - 1e-6)
        x = np.log(q / (1 - q))
        e = 1 / (1 + np.exp(-(got[d][0] * x + got[d][1]))) - y
        assert abs((e * x).sum() + got[d][0] / 1e6) < 1e-6 and abs(e.sum()) < 1e-6  # the loss is convex: here it is least
    ends = {r.metric: (r.median, r.lower_ci, r.upper_ci) for r in resample.calibration_intervals(drawn).collect()}
    for k, m in enumerate(("calibration_slope", "calibration_intercept")):
        assert ends[m] == pytest.approx(np.percentile([v[k] for v in got.values()], [50, 2.5, 97.5]))


def test_calibration_reads_many_distinct_scores_once(spark, monkeypatch):
    monkeypatch.setattr(metrics, "_descend_in_steps", lambda *a: pytest.fail("a job a step"))
    rng = np.random.default_rng(9)
    p = rng.random(20_000)
    y = (rng.random(20_000) < p**2).astype(int)
    got = metrics.calibration(spark.createDataFrame(pd.DataFrame({"k": "a", "y": y, "p": p})), ["k"], steps=300).first()
    x, slope, intercept = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))), 1.0, 0.0
    for _ in range(300):
        e = 1 / (1 + np.exp(-(slope * x + intercept))) - y
        slope, intercept = slope - 0.05 * (e * x).mean(), intercept - 0.05 * e.mean()
    assert got.calibration_slope == pytest.approx(slope, abs=1e-11) and got.calibration_intercept == pytest.approx(intercept, abs=1e-11)


def test_counts_of_draws_are_those_of_drawn_wells(spark, monkeypatch):
    from fenmark.operators import resample

    for low, high in ((0, 10), (97, 100), (1234567, 1234600)):
        want = [int(hashlib.md5(f"well:1999:{k}".encode()).hexdigest()[:8], 16) for k in range(low, high)]
        assert resample.md5_heads("well:1999:", low, high).tolist() == want
    rng = np.random.default_rng(3)
    rows = [(t, i, r, int(i % 3 == 0), float(rng.integers(0, 9) / 8)) for t, n in (("a", 130), ("b", 11), (None, 5)) for i in range(n) for r in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "target string, sample_id long, repeat_index int, y int, p double")
    for piece, pieces in ((4096, 1024), (8, 2)):  # one block, and several
        monkeypatch.setattr(resample, "PIECE", piece)
        monkeypatch.setattr(resample, "PIECES", pieces)
        got = {tuple(r) for r in resample.draw_counts(df, 40, ["target"]).collect()}
        assert got == {tuple(r) for r in resample.metrics._ties(resample.bootstrap(df, 40, ["target"]), ["target", "draw"]).collect()}


def test_selections_are_drawn_by_themselves(spark):
    from fenmark.operators import resample

    rng = np.random.default_rng(8)
    rows = [(t, f"s{i:02d}", 0, int(rng.random() < 0.4), float(rng.random())) for t, n in (("a", 30), ("b", 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "target string, sample_id string, repeat_index int, y int, p double")
    drawn = resample.bootstrap(df, 200, ["target"])
    sizes = {(r.target, r["count"]) for r in drawn.groupBy("target", "draw").count().collect()}
    assert sizes == {("a", 30), ("b", 11)}
    # Each well is as likely as another: chi-square of 30 counts of 200 each, 29 degrees of freedom.
    counts = np.array([r["count"] for r in drawn.where("target = 'a'").groupBy("sample_id").count().collect()])
    assert len(counts) == 30 and ((counts - 200) ** 2 / 200).sum() < 58
    both = {(r.target, r.metric): (r.median, r.lower_ci, r.upper_ci) for r in resample.intervals(drawn, keys=["target"]).collect()}
    alone = {r.metric: (r.median, r.lower_ci, r.upper_ci) for r in resample.intervals(resample.bootstrap(df.where("target = 'b'").drop("target"), 200)).collect()}
    assert len(both) == 10 and {m: both["b", m] for m in alone} == {m: pytest.approx(v) for m, v in alone.items()}


def test_one_fit_gives_all_of_a_task(spark):
    from fenmark.operators import models
    from fenmark.plans import bindings

    keys = ["algorithm", "repeat_index", "fold_index"]
    tasks = bindings.tasks(spark, "/root/testdata/sf0.001", "LogisticRegression", "DummyMajority").where("fold_index = 0").cache()
    got = models.fitted(tasks, keys, tuned=True, inner_folds=2).cache()
    own = lambda df: sorted((r.algorithm, r.sample_id, r.predicted_probability, r.hyperparameters) for r in df.collect())
    assert own(models.fitted(tasks, keys)) == own(models.predictions(tasks, keys))
    assert got.where("is_default").count() == 0 and got.where("algorithm = 'DummyMajority' and size(attributions) > 0").count() == 0
    assert models.fitted(tasks, keys, tuned=True, inner_folds=500).where("is_default").select("algorithm").distinct().collect()[0][0] == "LogisticRegression"
    a = {(r.sample_id, r.feature_name): r.attribution for r in models.attributions(tasks.where("algorithm <> 'DummyMajority'"), keys).collect()}
    each = models.fitted(tasks, keys).where("algorithm <> 'DummyMajority'").collect()
    assert a == {(r.sample_id, n): x for r in each for n, x in zip(r.feature_names, r.attributions, strict=True)}


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_spearman_equals_ranked_correlations(spark, monkeypatch, most):
    monkeypatch.setattr(reports, "RANKS_BROADCAST", most)
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    wide = pd.DataFrame({"many": x, "few": np.round(x + rng.normal(size=400)), "same": 3.0, "tied": rng.integers(0, 3, 400).astype(float)})
    wide.loc[::50, "few"] = None
    got = {(r.a, r.b): r.rho for r in reports.spearman(spark.createDataFrame(wide).repartition(5), list(wide.columns)).collect()}
    want = wide.dropna().rank().corr()
    assert len(got) == 10
    for (a, b), rho in got.items():
        assert (rho is None or np.isnan(rho)) if "same" in (a, b) else rho == pytest.approx(want.loc[a, b])
    assert reports.spearman(spark.createDataFrame(wide).limit(0), ["many", "few"]).count() == 3


def test_hashes_of_compressed_files_are_those_of_their_bytes(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"some,cells\n" * 1000))
    (tmp_path / "b.gz").write_bytes(b"not compressed, whatever its name says")
    got = {r.file_path.rsplit("/", 1)[1]: r.sha256_hash for r in readers.file_hashes(spark, f"file://{tmp_path}").collect()}
    assert got == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir()}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_gather_no_key_to_meet_its_cuts(spark, monkeypatch, descending):
    monkeypatch.setattr(ranks, "SMALL", 50)
    monkeypatch.setattr(ranks, "STRIDE", 4)
    rng = np.random.default_rng(9)
    key = [None if k == 2 else int(k) for k in np.repeat([0, 1, 2], [700, 30, 90])]
    by = np.concatenate([rng.permutation(n) for n in (700, 30, 90)]).astype(float)
    df = spark.createDataFrame([(k, float(v), int(v) % 5 + 1) for k, v in zip(key, by, strict=True)], "k int, v double, c long")
    got = ranks.running(df, ["k"], "v", {"before": "c"}, descending, buckets=30)
    for k in (0, 1, None):
        own = sorted(((r.v, r.c, r.before) for r in got.collect() if r.k == k), reverse=descending)
        assert len(own) == key.count(k) and [b for *_, b in own] == [sum(c for _, c, _ in own[:i]) for i in range(len(own))]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan  # the cuts of large keys go to the rows


def test_attributions_are_sorted_in_ranges_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(reports, "ORDER_ROWS", 100)
    shap = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 4).alias("run_id"), F.concat(F.lit("s"), F.col("id") % 50).alias("sample_id"), F.lit(0).alias("repeat_index"), F.lit(0).alias("fold_index"), F.concat(F.lit("f"), F.col("id")).alias("feature_name"), F.col("id").cast("double").alias("shap_value"), F.lit(1.0).alias("feature_cleaned_value"))
    runs = spark.createDataFrame([(f"r{k}", f"T{k % 2}", "Tier1_Field", "RandomForest", "Stratified_Nested_CV") for k in range(4)], list(reports.RUN))
    out = reports.attributions_long({"shap_values": shap, "model_runs": runs})
    got = [(r.target_contaminant, r.algorithm, r.sample_id, r.feature_name, r.run_id) for r in out.collect()]
    assert len(got) == 1000 and got == sorted(got)
    assert out.rdd.getNumPartitions() == 10  # a task sorts about ORDER_ROWS, 1 task before
