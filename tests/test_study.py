"""A study from CSV to exports through the command line, streaming ingest, readers and the store."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenmark import config as C
from fenmark.operators import ingest
from fenmark.plans import cli, reports
from fenmark.sources import readers
from fenmark.sources.store import TABLES, Store
from fenmark.streaming.ingest import clean_into

CONFIG = """
project: {name: study, version: "1"}
paths: {}
cv: {outer_folds: 3, spatial_outer_folds: 2, inner_folds: 2, repeats: 2, random_seed: 7, minimum_positive_cases_for_ml: 5}
spatial: {latitude_column: Dy, longitude_column: Dx, clustering_method: kmeans, number_of_spatial_clusters: 4, max_clusters: 6}
models: {run_majority_dummy: true, run_stratified_dummy: true, run_ec_only_logistic: true, run_regularized_logistic: true, run_random_forest: false, run_gradient_boosted_tree: false}
outputs: {}
"""
THRESHOLDS = """
targets:
  Na: {column: Na, unit: mg/L, threshold_value: 150.0, threshold_source: "guide, 75 %", exceedance_direction: greater_than, notes: ""}
  Cl: {column: Cl, unit: mg/L, threshold_value: 10000, threshold_source: g, exceedance_direction: greater_than, notes: ""}
bdl_substitution: {method: limit_div_sqrt2, use_min_detected_fallback: true, detection_limits: {F: {value: null, unit: mg/L, source: x}, Cl: {value: 0.5, unit: mg/L, source: x}}}
"""
RULES = """
global_forbidden_patterns: ["_label"]
targets:
  Na: {forbidden_exact: [Na], forbidden_contains: ["Na_", "_Na", SAR]}
  TDS: {forbidden_exact: [TDS], forbidden_contains: [], special_models: {TDS_EC_strict: {forbidden_exact: [EC]}}}
"""


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    d = tmp_path_factory.mktemp("study")
    rng = np.random.default_rng(1)
    names = ["SampleID", "Location", "Dx", "Dy", "pH", "Temp.", "EC", "Na", "Cl", "TDS", "K", "Mg", "Ca", "HCO3", "SO4", "CO3", "B", "F", "NO3"]
    lines = [",".join(names)]
    for i in range(48):
        salt = rng.gamma(2, 80)
        cells = [f"W{i:02d}", f'"Town, {i % 4}"', -1 + 0.2 * (i % 4) + rng.normal(0, 0.01), 7 + 0.3 * (i % 4) + rng.normal(0, 0.01), 7 + rng.normal(0, 0.3), 28, 5 * salt, salt, "bdl" if i % 7 == 0 else salt * 1.2, 4 * salt, 3, 10, 20, 200, "" if i == 5 else 12, "ND", 0.1, "<0.5" if i % 5 == 0 else 0.8, "junk" if i == 9 else 4]
        lines.append(",".join(f" {c:.4f} " if isinstance(c, float) else str(c) for c in cells))
    lines.append(lines[3].replace("W02", "W01"))  # W01 again: the last row wins
    for name, text in {"data.csv": "\n".join(lines) + "\n", "config.yaml": CONFIG, "thresholds.yaml": THRESHOLDS, "rules.yaml": RULES, "outline.txt": "heading\n\nA title\nbody\n"}.items():
        (d / name).write_text(text)
    return d


@pytest.fixture(scope="module")
def ran(spark, study):
    s = str(study)
    for args in (
        ["validate-inputs", "--csv", f"{s}/data.csv", "--config", f"{s}/config.yaml", "--thresholds", f"{s}/thresholds.yaml", "--rules", f"{s}/rules.yaml"],
        ["init-db", "--store", f"{s}/store"],
        ["ingest-inputs", "--store", f"{s}/store", "--csv", f"{s}/data.csv", "--config", f"{s}/config.yaml", "--thresholds", f"{s}/thresholds.yaml", "--outline", f"{s}/outline.txt"],
        ["audit-leakage", "--store", f"{s}/store", "--rules", f"{s}/rules.yaml"],
        ["run-pipeline", "--store", f"{s}/store", "--out", f"{s}/reports"],
        ["export-r", "--store", f"{s}/store", "--out", f"{s}/r"],
        ["export-gis", "--store", f"{s}/store", "--out", f"{s}/gis"],
    ):
        assert cli.main(args, spark) == 0
    return Store(spark, f"{s}/store")


def test_ingest_tables(ran):
    assert ran.read("raw_samples").count() == 48 and ran.read("manuscript_outline").first().title_detected == "A title"
    a = ran.read("data_audit").first()
    assert (a.n_samples, a.duplicate_sample_count, a.missing_coordinate_count, a.failed_numeric_parse_count) == (48, 1, 0, 1)
    m = {(r.sample_id, r.variable_name): r for r in ran.read("cleaned_measurements").collect()}
    assert m["W05", "SO4"].cleaning_note == "empty_value" and m["W00", "Cl"].cleaned_value_real == pytest.approx(0.5 / 2**0.5) and m["W00", "Cl"].cleaning_note == "bdl_substituted_using_configured_detection_limit"
    assert m["W01", "Na"].raw_value_text == m["W02", "Na"].raw_value_text and ("W01", "SAR") in m and ("W00", "Location") not in m
    e = {r.target_contaminant: r for r in ran.read("target_eligibility").collect()}
    assert e["Na"].ml_status == "modelled" and e["Cl"].ml_status == "descriptive_only" and e["Na"].n_samples == 48
    assert ran.read("sample_spatial_assignment").count() == 48 and ran.read("spatial_cluster_metadata").count() == 4
    assert ran.read("column_dictionary").where("is_coordinate = 1").count() == 2


def test_models_and_priority(ran, study):
    runs = ran.read("model_runs")
    assert runs.select("predictor_tier").distinct().count() == 3 and {r.cv_mode for r in runs.select("cv_mode").distinct().collect()} == set(C.CV_MODES)
    excluded = ran.read("leakage_rules_applied").where("target_contaminant = 'Na' and action = 'excluded'").select("feature_name")
    used = ran.read("shap_values").join(excluded, "feature_name")
    assert used.count() == 0
    per = ran.read("well_predictions").where("cv_mode = 'Stratified_Nested_CV'").groupBy("run_id", "repeat_index").agg(F.count_distinct("sample_id").alias("n"), F.count("*").alias("c")).collect()
    assert per and all(r.n == r.c == 48 for r in per)
    m = ran.read("fold_metrics")
    timed = m.join(runs.select("run_id", "algorithm"), "run_id").groupBy("algorithm").agg(F.count("shap_computation_time_ms").alias("n"), F.count("*").alias("all")).collect()
    assert all(r.n == (0 if r.algorithm.startswith("Dummy") else r.all) for r in timed)
    again = reports.run_metrics({"well_predictions": ran.read("well_predictions")})
    assert m.count() == again.count() and m.agg(F.sum("roc_auc")).first()[0] == pytest.approx(again.agg(F.sum("roc_auc")).first()[0])
    tuned = {(r.algorithm, r.hyperparameter_name) for r in ran.read("model_hyperparameters").join(runs, "run_id").select("algorithm", "hyperparameter_name").distinct().collect()}
    assert tuned == {("LogisticRegression", "C")}
    one = runs.first()
    hashes = {r.file_role: r.sha256_hash for r in ran.read("input_files").collect()}
    assert set(hashes) == set(C.FILE_ROLES) and (one.input_data_hash, one.leakage_rules_hash, one.config_hash) == (hashes["raw_groundwater_csv"], hashes["leakage_rules_yaml"], hashes["runtime_config_yaml"])
    assert {r.tier_name for r in ran.read("leakage_rules_applied").where("target_contaminant = 'TDS'").select("tier_name").distinct().collect()} == {*C.TIERS, "Tier2_Reduced_TDS_EC_strict"}
    best = reports.best_run({n: ran.read(n) for n in TABLES}).collect()
    assert len(best) == 1 and best[0].mean_pr_auc > 0.9
    p = ran.read("screening_priority")
    assert p.count() == 48 and p.where("predicted_probability_lower_ci > predicted_probability_upper_ci").count() == 0
    manifest = json.loads((study / "reports" / "run_manifest.json").read_text())
    assert manifest["counts"]["screening_priority"] == 48 and manifest["total_run_groups"] == 6 and manifest["targets"] == list(C.TARGETS) and {"pipeline_completed_at", "elapsed_ms", "tiers", "cv_modes"} <= set(manifest)


def test_exports_are_quoted_and_complete(spark, ran, study):
    t = readers.read_export(spark, f"{study}/r/target_prevalence_summary", ["prevalence"])
    assert {r.threshold_source for r in t.collect()} == {"guide, 75 %", "g"} and dict(t.dtypes)["prevalence"] == "double"
    for name in reports.R_EXPORTS:
        assert spark.read.option("header", True).csv(f"{study}/r/{name}").count() > 0, name
    points = spark.read.option("header", True).csv(f"{study}/gis/well_screening_priority_points")
    assert points.count() == 48 and points.where("location like 'Town, %'").count() == 48
    manifest = ran.read("gis_exports_manifest").collect()
    assert len(manifest) == 3 and all(len(r.sha256_hash) == 64 for r in manifest)


def test_all_reports_run(ran):
    t = {n: ran.read(n) for n in TABLES}
    for f in (reports.heat_map, reports.spatial_penalty, reports.worst_penalty, reports.curves_long, reports.best_confusion, reports.tier_retention, reports.best_per_mode, reports.leakage_matrix, reports.performance_rounded, reports.operational_rounded, reports.retained_features, reports.hyperparameters, reports.cluster_members, reports.reliability_of_best, reports.features_of_best, reports.priority_map, reports.labelled_wells):
        assert f(t).count() > 0, f.__name__
    assert reports.dataset_summary(t, ingest.summary(t["cleaned_measurements"])).count() > 10


def test_csv_refuses_ragged_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a , b\n1, 2 \n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(tmp_path / "x.csv")).collect()
    (tmp_path / "y.csv").write_text("a , b\n 1, 2 \n")
    assert readers.read_csv(spark, str(tmp_path / "y.csv")).first().asDict() == {"a": "1", "b": "2"}


def test_files_beyond_a_binary_cell_are_hashed(spark, tmp_path):
    import hashlib

    (tmp_path / "a file.txt").write_bytes(b"abc")
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate((1 << 31) + 12_345)
    want, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(1 << 11):
        want.update(zeros)
    want.update(bytes(12_345))
    got = {r.file_path.rsplit("/", 1)[1]: (r.sha256_hash, r.file_size_bytes) for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert got["big.bin"] == (want.hexdigest(), (1 << 31) + 12_345) and [v for k, v in got.items() if k != "big.bin"] == [(hashlib.sha256(b"abc").hexdigest(), 3)]
    assert readers.file_hashes(spark, str(tmp_path), "*.txt").count() == 1


def test_rows_without_ids_are_numbered(spark):
    rows = ingest.with_index(spark.createDataFrame([("x",), ("y",)], "Na string").coalesce(1))
    assert sorted(r.SampleID for r in rows.collect()) == ["ROW_0001", "ROW_0002"]


def test_config_is_checked(tmp_path):
    (tmp_path / "c.yaml").write_text(CONFIG.replace("kmeans", "dbscan"))
    with pytest.raises(ValueError):
        C.read_run_config(tmp_path / "c.yaml")
    (tmp_path / "t.yaml").write_text(THRESHOLDS)
    assert C.read_thresholds(tmp_path / "t.yaml").censoring.detection_limits == {"Cl": 0.5}


def test_streaming_ingest_upserts(spark, tmp_path):
    schema = "sample_id string, original_row_index long, variable_name string, raw_value_text string"
    store = Store(spark, f"{tmp_path}/store")
    store.create_all()
    limits = ingest.configured_limits(spark, {"Na": 1.0})
    # Blanks never take the place of a value, late rows of a smaller index do; a blank of a cell that is new is kept.
    for rows in ([("a", 7, "Na", "5"), ("b", 1, "Na", "bdl")], [("a", 2, "Na", "6"), ("c", 4, "Na", "")], [("a", 9, "Na", " "), ("b", 8, "Na", "")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        clean_into(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, limits, f"{tmp_path}/cp").awaitTermination()
    got = {r.sample_id: r.cleaned_value_real for r in store.read("cleaned_measurements").collect()}
    assert got == {"a": 6.0, "b": pytest.approx(1 / 2**0.5), "c": None}
