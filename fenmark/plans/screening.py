"""The screening study end to end: ingest, leakage audit, fitting and scoring, thresholds, priority, exports.

All targets, tiers, modes, algorithms, repeats and folds of a run are one task table; statistics over it are joins and
aggregates, and models are fitted by blocks of rows (``operators.models``).
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark import config as C
from fenmark.functions import scalars as S
from fenmark.operators import folds, ingest, leakage, metrics, models, ranks, spatial
from fenmark.plans import reports
from fenmark.sources import readers, sinks
from fenmark.sources.scratch import discard, written
from fenmark.sources.store import TABLES, Store

SCHEMA_VERSION = "1"
LOG = logging.getLogger(__name__)


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def register(store: Store, files: dict[str, str]) -> None:
    """Keeps path, hash and size of files by role."""
    at, hashed = now(), None
    for role, path in files.items():
        h = readers.file_hashes(store.spark, path).select(F.lit(role).alias("file_role"), "file_path", "sha256_hash", "file_size_bytes", F.lit(at).alias("imported_at"))
        hashed = h if hashed is None else hashed.unionByName(h)
    if hashed is not None:
        store.replace("input_files", hashed, ["file_role"])


def registered(store: Store, role: str) -> str:
    """The path of a role's file."""
    found = store.read("input_files").where(F.col("file_role") == role).first()
    if found is None:
        raise FileNotFoundError(f"no {role} is registered in the store")
    return found.file_path


def ingest_study(store: Store, csv: str, run: C.RunConfig, thresholds: C.ThresholdsConfig, outline: str | None = None, files: dict[str, str] | None = None) -> None:
    """Fills the input, target, feature and spatial tables from a study's CSV; all of them become one version of the store."""
    with store.transaction():
        _ingest(store, csv, run, thresholds, outline, files)


def _ingest(store: Store, csv: str, run: C.RunConfig, thresholds: C.ThresholdsConfig, outline: str | None, files: dict[str, str] | None) -> None:
    spark, at = store.spark, now()
    store.create_all()
    store.append("project_manifest", spark.createDataFrame([(run.name, run.version, at, run.version, SCHEMA_VERSION, None)], TABLES["project_manifest"]))
    register(store, {"raw_groundwater_csv": csv, **({"manuscript_outline": outline} if outline else {}), **(files or {})})
    if outline:
        text = readers.read_text(spark, outline)
        store.append("manuscript_outline", text.select(S.title(F.col("full_text")).alias("title_detected"), "full_text", F.lit(at).alias("imported_at"), F.sha2("full_text", 256).alias("sha256_hash")))

    rows = ingest.with_index(readers.read_csv(spark, csv))
    source = store.read("input_files").where("file_role = 'raw_groundwater_csv'").select(F.col("sha256_hash").alias("input_file_hash"))
    store.replace("raw_samples", ingest.raw_samples(rows).withColumn("imported_at", F.lit(at)).join(F.broadcast(source)), ["sample_id"])
    long = ingest.to_long(rows)
    c = thresholds.censoring
    cleaned = store.merge_cells(ingest.clean(long, ingest.configured_limits(spark, c.detection_limits), c.method, c.use_min_detected_fallback))
    columns = [x for x in rows.columns if x != "original_row_index"]
    store.insert_missing("column_dictionary", ingest.column_dictionary(spark, columns), ["column_name"])
    a = ingest.audit(long, cleaned, run.spatial.latitude_column, run.spatial.longitude_column)
    store.append("data_audit", a.select(F.lit(at).alias("audit_timestamp"), "n_samples", F.lit(len(columns)).alias("n_columns"), "missing_coordinate_count", "duplicate_sample_count", F.col("n_bdl").alias("bdl_value_count"), F.col("n_parse_errors").alias("failed_numeric_parse_count"), "audit_status"))

    targets = ingest.thresholds_frame(spark, thresholds.targets)
    store.replace("target_definitions", targets.withColumnRenamed("unit", "threshold_unit"), ["target_contaminant"])
    samples = store.read("raw_samples").select("sample_id")
    labelled = store.replace("target_labels", ingest.labels(samples, cleaned, targets), ["target_contaminant", "sample_id"])
    store.replace("target_eligibility", ingest.eligibility(labelled, run.cv.minimum_positive_cases_for_ml), ["target_contaminant"])

    tiers = spark.createDataFrame([(t, f"{len(f)} candidate features", None) for t, f in C.TIERS.items()], TABLES["predictor_tiers"])
    store.insert_missing("predictor_tiers", tiers, ["tier_name"])
    kind = F.when(F.col("feature_name").isin(*C.DERIVED), "derived").otherwise("measured")
    store.insert_missing("candidate_features", leakage.candidates(spark).withColumn("feature_type", kind).withColumn("enabled", F.lit(1)).withColumn("source_variable", F.when(F.col("feature_type") == "measured", F.col("feature_name"))), ["feature_name", "tier_name"])
    store.merge_cells(ingest.derived_rows(cleaned))
    cluster(store, run.spatial)


def cluster(store: Store, known: C.SpatialConfig) -> None:
    order = store.read("raw_samples").select("sample_id", F.col("original_row_index").alias("_row"))
    points = ingest.coordinates(store.read("cleaned_measurements"), known.latitude_column, known.longitude_column).join(order, "sample_id")
    dense = ranks.number_position(points, "_row", "original_row_index").select("sample_id", "lat", "lon", "original_row_index").cache()
    k = known.number_of_spatial_clusters or spatial.choose_k(dense, known.max_clusters)
    assigned, _, _ = spatial.kmeans(dense, k)
    m = spatial.metadata(assigned)
    store.overwrite("spatial_cluster_metadata", m.select("spatial_cluster_id", F.col("centroid_lat").alias("centroid_latitude"), F.col("centroid_lon").alias("centroid_longitude"), F.col("n_samples").alias("number_of_wells"), "max_intra_cluster_distance_km"))
    store.overwrite("sample_spatial_assignment", assigned.select("sample_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "spatial_cluster_id"))
    dense.unpersist()


def audit_leakage(store: Store, rules: C.LeakageRules) -> DataFrame:
    """Applies the rules to all targets and tiers, and a target's variants to the middle tier (stored under the names of both)."""
    rows = leakage.stored(leakage.audit(leakage.candidates(store.spark), leakage.rules_frame(store.spark, rules)))
    return store.replace("leakage_rules_applied", rows, ["target_contaminant", "tier_name", "feature_name"])


def task_table(store: Store, run: C.RunConfig, targets: Sequence[str], tiers: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """(target, tier, cv_mode, repeat, fold, sample, label, is_train, names, features): every fold of every group asked for."""
    eligible = store.read("target_eligibility").where((F.col("ml_status") == "modelled") & F.col("target_contaminant").isin(*targets)).select("target_contaminant")
    labelled = store.read("target_labels").where("label_status = 'labelled'").join(eligible, "target_contaminant", "left_semi").select("target_contaminant", "sample_id", "true_label")
    parts = []
    if "Stratified_Nested_CV" in modes:
        f = folds.repeated_stratified(labelled, run.cv.outer_folds, run.cv.repeats, run.cv.random_seed, ["target_contaminant"])
        parts.append(folds.assignments(f, run.cv.outer_folds).withColumn("cv_mode", F.lit("Stratified_Nested_CV")).withColumn("n_folds", F.lit(run.cv.outer_folds)))
    if "Spatial_Group_CV" in modes:
        f = folds.spatial_groups(labelled, store.read("sample_spatial_assignment"), run.cv.spatial_outer_folds, ["target_contaminant"]).drop("spatial_cluster_id").withColumn("random_seed", F.lit(run.cv.random_seed).cast("long"))
        parts.append(folds.assignments(f, run.cv.spatial_outer_folds).withColumn("cv_mode", F.lit("Spatial_Group_CV")).withColumn("n_folds", F.lit(run.cv.spatial_outer_folds)))
    split = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    # Groups with a fold that lacks a class in train or test fail as a whole: that is told, and they are left out.
    classes = split.groupBy("target_contaminant", "cv_mode", "repeat_index", "fold_index", "split_role").agg(F.countDistinct("true_label").alias("c"))
    whole = classes.groupBy("target_contaminant", "cv_mode").agg((F.min("c") == 2).alias("ok")).where("ok").select("target_contaminant", "cv_mode")
    for r in classes.groupBy("target_contaminant", "cv_mode").agg((F.min("c") == 2).alias("ok")).where("not ok").collect():  # targets times modes at most
        LOG.error("FAILED %s / %s: a fold lacks a class in train or test", r.target_contaminant, r.cv_mode)
    features = store.read("leakage_rules_applied").where((F.col("action") == "included") & F.col("tier_name").isin(*tiers)).groupBy("target_contaminant", "tier_name").agg(F.array_sort(F.collect_set("feature_name")).alias("feature_names"))
    names = [f for t in C.TIERS["Tier3_Full"] for f in (t,)]
    wide = ingest.feature_matrix(store.read("cleaned_measurements"), names)
    values = wide.select("sample_id", F.create_map(*(x for n in names for x in (F.lit(n), F.col(ingest.quoted(n))))).alias("m"))
    return split.join(whole, ["target_contaminant", "cv_mode"]).join(features, "target_contaminant").join(values, "sample_id").withColumn("is_train", (F.col("split_role") == "train").cast("int")).withColumn("features", F.transform("feature_names", lambda n: F.element_at(F.col("m"), n))).drop("m")


def run_models(store: Store, run: C.RunConfig, targets: Sequence[str] = C.TARGETS, tiers: Sequence[str] = (*C.TIERS, *C.VARIANT_TIERS), modes: Sequence[str] = C.CV_MODES, tuned: bool = True) -> dict[str, int]:
    """Fits, scores and ranks; fills the run tables, which become one version of the store.  Returns row counts."""
    for given, known in ((targets, C.TARGETS), (modes, C.CV_MODES), (tiers, (*C.TIERS, *C.VARIANT_TIERS))):
        if unknown := set(given) - set(known):
            raise ValueError(f"not known: {sorted(unknown)}")
    with store.transaction():
        return _run_models(store, run, targets, tiers, modes, tuned)


def _run_models(store: Store, run: C.RunConfig, targets: Sequence[str], tiers: Sequence[str], modes: Sequence[str], tuned: bool) -> dict[str, int]:
    began, at = time.time(), now()
    base = task_table(store, run, targets, tiers, modes)
    algorithms = F.array(*(F.lit(a) for a in run.algorithms()))
    tasks = base.withColumn("algorithm", F.explode(algorithms)).where((F.col("algorithm") != "EcOnlyLogistic") | F.array_contains("feature_names", "EC"))
    tasks = tasks.withColumn("run_id", S.run_id(F.col("target_contaminant"), F.col("tier_name"), F.col("algorithm"), F.col("cv_mode"))).withColumnRenamed("tier_name", "predictor_tier")
    keys = ["run_id", "target_contaminant", "predictor_tier", "algorithm", "cv_mode", "repeat_index", "fold_index"]
    clusters = store.read("sample_spatial_assignment").select("sample_id", "spatial_cluster_id")
    # Each task is tuned and fitted once; all that it gives is written, and read for each table.
    fits = written(models.fitted(tasks, keys, run.cv.random_seed, tuned, run.cv.inner_folds), "fits")
    store.replace("well_predictions", fits.join(clusters, "sample_id", "left").withColumnRenamed("predicted_label", "predicted_label_default_0_5"), ["run_id"])
    known = store.read("well_predictions")
    defs = store.read("target_definitions").select("target_contaminant", "threshold_value", "threshold_source")
    heads = tasks.groupBy("run_id", "target_contaminant", "predictor_tier", "algorithm", "cv_mode").agg(F.max(F.size("feature_names")).alias("n_features"), F.countDistinct("sample_id").alias("n_train_samples"), F.max("n_folds").alias("n_outer_folds"), (F.max("repeat_index") + 1).alias("n_repeats"))
    defaults = fits.where("is_default").select("run_id").distinct().withColumn("skip_reason", F.lit("too few rows for the inner folds: default setting in some folds"))
    hashes = {r.file_role: r.sha256_hash for r in store.read("input_files").select("file_role", "sha256_hash").collect()}  # one row a role
    roles = {"input_data_hash": "raw_groundwater_csv", "outline_hash": "manuscript_outline", "leakage_rules_hash": "leakage_rules_yaml", "config_hash": "runtime_config_yaml"}
    heads = heads.join(defaults, "run_id", "left").withColumns({c: F.lit(hashes.get(role, "")) for c, role in roles.items()}).withColumn("cpu_threads_used", F.lit(1))
    heads = heads.join(defs, "target_contaminant", "left").withColumn("timestamp", F.lit(at)).withColumn("random_seed", F.lit(run.cv.random_seed)).withColumn("run_status", F.lit("completed")).withColumn("total_execution_time_ms", F.lit(int(1000 * (time.time() - began))))
    store.replace("model_runs", heads, ["run_id"])
    store.replace("fold_assignments", base.select("cv_mode", "repeat_index", "fold_index", "sample_id", "split_role", "target_contaminant", "tier_name", "random_seed").distinct(), ["cv_mode", "target_contaminant", "tier_name"])
    own = store.read("model_runs").where(F.col("timestamp") == at).select("run_id")
    fresh = known.join(own, "run_id", "left_semi")
    scored = fresh.select("run_id", "cv_mode", "repeat_index", "fold_index", F.col("true_label").alias("y"), F.col("predicted_probability").alias("p"))
    store.replace("fold_metrics", metrics.all_metrics(scored, ["run_id", "cv_mode", "repeat_index", "fold_index"]).withColumnRenamed("recall", "recall_sensitivity"), ["run_id"])
    sweep = metrics.threshold_sweep(scored, ["run_id", "cv_mode"])
    store.replace("threshold_sensitivity", sweep, ["run_id"])
    stored = store.read("threshold_sensitivity").join(own, "run_id", "left_semi")
    chosen = metrics.operational_thresholds(stored, ["run_id", "cv_mode"]).join(stored.select("run_id", "cv_mode", "probability_cutoff", "false_negatives_count", "false_positives_count"), ["run_id", "cv_mode", "probability_cutoff"])
    store.replace("operational_thresholds", chosen.select("run_id", "cv_mode", F.col("threshold_rule").alias("threshold_selection_rule"), F.col("probability_cutoff").alias("optimized_probability_cutoff"), F.col("sensitivity").alias("resulting_sensitivity"), F.col("specificity").alias("resulting_specificity"), "false_negatives_count", "false_positives_count"), ["run_id"])
    began_attributions = time.time()
    each = fits.where(reports.not_dummy()).withColumn("x", F.explode(F.arrays_zip("feature_names", "feature_values", "attributions")))
    a = each.select(*keys, "sample_id", F.col("x.feature_names").alias("feature_name"), F.col("x.feature_values").alias("feature_value"), F.col("x.attributions").alias("attribution"), "base_value")
    store.replace("shap_values", a.select("run_id", "cv_mode", "repeat_index", "fold_index", "sample_id", "feature_name", F.col("attribution").alias("shap_value"), F.col("feature_value").alias("feature_raw_value"), F.col("feature_value").alias("feature_cleaned_value"), "base_value"), ["run_id"])
    # Attributions of all folds are one job: each fold is given its even share of the time.
    spent = 1000 * (time.time() - began_attributions)
    timed = store.read("fold_metrics").join(own, "run_id", "left_semi")
    dummy = store.read("model_runs").where(~reports.not_dummy()).select("run_id")
    share = F.lit(int(spent / max(1, timed.join(dummy, "run_id", "left_anti").count()))).cast("long")
    timed = timed.join(dummy.withColumn("_none", F.lit(True)), "run_id", "left").withColumn("shap_computation_time_ms", F.when(F.col("_none").isNull(), share)).drop("_none")
    store.replace("fold_metrics", timed, ["run_id"])
    tracked = store.read("shap_values").join(own, "run_id", "left_semi").groupBy("run_id", "cv_mode", "repeat_index", "fold_index", "feature_name").agg(F.avg(F.abs("shap_value")).alias("mean_absolute_shap")).withColumn("is_selected", F.lit(1))
    store.replace("fold_feature_tracking", tracked, ["run_id"])
    prevalence = tasks.where("is_train = 1").groupBy("run_id", "cv_mode", "repeat_index", "fold_index").agg(F.avg("true_label").alias("train_fold_prevalence"))
    bases = fits.where(reports.not_dummy()).groupBy("run_id", "cv_mode", "repeat_index", "fold_index").agg(F.first("base_value").alias("shap_base_value_logit"))
    store.replace("fold_base_values", prevalence.join(bases, ["run_id", "cv_mode", "repeat_index", "fold_index"], "left").withColumn("shap_base_value_prob", S.sigmoid(F.col("shap_base_value_logit"))), ["run_id"])
    name = F.element_at(F.create_map(*(F.lit(x) for kv in C.HYPERPARAMETERS.items() for x in kv)), F.col("algorithm"))
    settings = fits.where("hyperparameters <> ''").select("run_id", "cv_mode", "repeat_index", "fold_index", name.alias("hyperparameter_name"), F.col("hyperparameters").alias("hyperparameter_value")).distinct()
    store.replace("model_hyperparameters", settings, ["run_id"])
    tables = {n: store.read(n) for n in TABLES}
    store.replace("screening_priority", reports.screening_priority(tables), ["sample_id", "target_contaminant"])
    discard(fits)
    return {n: store.read(n).count() for n in ("model_runs", "well_predictions", "fold_metrics", "screening_priority")}


def export(store: Store, folder: str, kind: str = "r") -> dict[str, int]:
    """Writes the R or the GIS reports as CSV folders; the latter with a manifest of all exports so far."""
    tables = {n: store.read(n) for n in TABLES}
    known = reports.R_EXPORTS if kind == "r" else reports.GIS_EXPORTS
    counts = {}
    for name, report in known.items():
        counts[name] = sinks.counted_csv(report(tables), f"{folder}/{name}", single=name not in reports.LARGE_EXPORTS)
    if kind != "r":
        if not counts["well_screening_priority_points"]:
            LOG.warning("the screening priority table is empty: the points are, too")
        m = sinks.export_manifest(store.spark, [(f"{folder}/{n}", "csv", c) for n, c in counts.items()], now())
        sinks.write_csv(store.append("gis_exports_manifest", m), f"{folder}/gis_exports_manifest")
    return counts


def validate(spark: SparkSession, csv: str, required: Sequence[str], files: Sequence[str] = ()) -> DataFrame:
    """Fails on missing files; reports missing columns and cells that say bdl."""
    from pathlib import Path

    missing = [f for f in files if "://" not in f and not Path(f).exists()]
    if missing:
        raise FileNotFoundError(f"missing: {missing}")
    return ingest.validation(readers.read_csv(spark, csv), required)
