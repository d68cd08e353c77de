"""Reports: each a relational query over the store's tables, given as a mapping from name to DataFrame."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenmark import config as C
from fenmark.functions import scalars as S
from fenmark.operators import metrics
from fenmark.operators.ranks import top_k, value_ranks

Tables = Mapping[str, DataFrame]
RUN = ("run_id", "target_contaminant", "predictor_tier", "algorithm", "cv_mode")


def runs(t: Tables) -> DataFrame:
    return t["model_runs"].select(*RUN)


def with_run(t: Tables, table: str) -> DataFrame:
    """A table joined to its runs' attributes; the runs' side is one row a run, and goes to the rows, so that no run's rows are gathered."""
    own = t[table]
    return own.drop(*(c for c in RUN if c != "run_id" and c in own.columns)).join(F.broadcast(runs(t)), "run_id")


#: Rows that a task of a report sorts.
ORDER_ROWS = 1 << 19


def in_order(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df of about so many rows sorted as a whole, in ranges of about ORDER_ROWS: a task sorts as many however large df is, and however well its rows were packed for the shuffle."""
    return df.repartitionByRange(max(1, -(-rows // ORDER_ROWS)), *by).sortWithinPartitions(*by)


def not_dummy(c: str = "algorithm") -> Column:
    return ~F.ilike(F.col(c), F.lit("Dummy%"))


def prevalence(t: Tables) -> DataFrame:
    d = t["target_definitions"].select("target_contaminant", "threshold_value", "threshold_unit", "threshold_source")
    return t["target_eligibility"].join(d, "target_contaminant", "left").orderBy("target_contaminant")


def leakage_audit(t: Tables) -> DataFrame:
    return t["leakage_rules_applied"].select("target_contaminant", "tier_name", "feature_name", "action", "reason", "rule_source").orderBy("target_contaminant", "tier_name", "action", "feature_name")


def performance(t: Tables) -> DataFrame:
    """Means per run; NaN counts as missing."""
    m = with_run(t, "fold_metrics")
    mean = lambda c, name: F.avg(S.finite(F.col(c))).alias(name)
    return m.groupBy(*RUN).agg(
        mean("roc_auc", "mean_roc_auc"), mean("pr_auc", "mean_pr_auc"), mean("balanced_accuracy", "mean_bal_acc"), mean("recall_sensitivity", "mean_recall"), mean("specificity", "mean_spec"),
        mean("f1_score", "mean_f1"), mean("f2_score", "mean_f2"), mean("brier_score", "mean_brier"), F.count("*").alias("n_folds"), F.min("pr_auc").alias("min_pr_auc"), F.max("pr_auc").alias("max_pr_auc"),
    ).orderBy("target_contaminant", F.desc("mean_pr_auc"), "run_id")


def fold_metrics_long(t: Tables) -> DataFrame:
    cols = ["roc_auc", "pr_auc", "balanced_accuracy", "recall_sensitivity", "specificity", "f1_score", "f2_score", "brier_score", "calibration_slope", "calibration_intercept", "n_test_pos", "n_test_neg"]
    return with_run(t, "fold_metrics").select(*RUN, "repeat_index", "fold_index", *cols).orderBy("target_contaminant", "algorithm", "repeat_index", "fold_index", "run_id")


def out_of_fold(t: Tables) -> DataFrame:
    return in_order(t["well_predictions"], t["well_predictions"].count(), "target_contaminant", "algorithm", "sample_id", "repeat_index", "fold_index", "run_id")


def attributions_long(t: Tables) -> DataFrame:
    long = with_run(t, "shap_values").select("run_id", "sample_id", "target_contaminant", "predictor_tier", "algorithm", "cv_mode", "repeat_index", "fold_index", "feature_name", "shap_value", "feature_cleaned_value")
    return in_order(long, t["shap_values"].count(), "target_contaminant", "algorithm", "sample_id", "feature_name", "run_id")


def calibration_inputs(t: Tables) -> DataFrame:
    return with_run(t, "well_predictions").select("run_id", "target_contaminant", "algorithm", "cv_mode", "true_label", "predicted_probability").orderBy("target_contaminant", "algorithm", "predicted_probability", "run_id")


def operational(t: Tables) -> DataFrame:
    return with_run(t, "operational_thresholds").select(*RUN, "threshold_selection_rule", "optimized_probability_cutoff", "resulting_sensitivity", "resulting_specificity", "false_negatives_count", "false_positives_count").orderBy("target_contaminant", "threshold_selection_rule", "run_id")


def sensitivity(t: Tables) -> DataFrame:
    return with_run(t, "threshold_sensitivity").select("run_id", "target_contaminant", "algorithm", "cv_mode", "probability_cutoff", "sensitivity", "specificity", "precision", "f1_score", "f2_score", "false_negatives_count", "false_positives_count").orderBy("target_contaminant", "algorithm", "probability_cutoff", "run_id")


def _places(t: Tables) -> DataFrame:
    return t["sample_spatial_assignment"].select("sample_id", "latitude", "longitude", "spatial_cluster_id")


def priority_table(t: Tables) -> DataFrame:
    cols = ["sample_id", "target_contaminant", "predicted_probability_median", "predicted_probability_lower_ci", "predicted_probability_upper_ci", "screening_priority_class", "priority_reason", "best_validated_run_id", "latitude", "longitude"]
    return t["screening_priority"].join(_places(t), "sample_id", "left").select(*cols).orderBy("target_contaminant", F.desc("predicted_probability_median"), "sample_id")


def priority_points(t: Tables) -> DataFrame:
    """One row a sample: its targets' classes (ordered by target), greatest probability, overall class and location."""
    sp = t["screening_priority"]
    label = F.concat_ws(":", "target_contaminant", F.coalesce("screening_priority_class", F.lit("NA")))
    g = sp.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_contaminant", label.alias("x")))), lambda s: s["x"]), "|").alias("targets_classes"), F.max("predicted_probability_median").alias("max_probability"))
    place = t["raw_samples"].select("sample_id", F.get_json_object("raw_json", "$.Location").alias("location"))
    out = g.join(_places(t), "sample_id", "left").join(place, "sample_id", "left").withColumn("overall_priority", S.priority_class(F.col("max_probability")))
    return out.select("sample_id", "longitude", "latitude", "targets_classes", "max_probability", "overall_priority", "location").orderBy(F.desc("max_probability"), "sample_id")


def target_probabilities(t: Tables) -> DataFrame:
    return t["screening_priority"].join(_places(t), "sample_id", "left").select("sample_id", "target_contaminant", "predicted_probability_median", "screening_priority_class", "longitude", "latitude", "spatial_cluster_id").orderBy("target_contaminant", F.desc("predicted_probability_median"), "sample_id")


def cluster_metadata(t: Tables) -> DataFrame:
    return t["spatial_cluster_metadata"].orderBy("spatial_cluster_id")


def heat_map(t: Tables, targets: Sequence[str] | None = None) -> DataFrame:
    """Mean area per target, tier, algorithm and mode, without dummies."""
    m = with_run(t, "fold_metrics").where(not_dummy())
    m = m.where(F.col("target_contaminant").isin(*targets)) if targets else m
    return m.groupBy("target_contaminant", "predictor_tier", "algorithm", "cv_mode").agg(F.avg("pr_auc").alias("mean_pr_auc"))


def spatial_penalty(t: Tables) -> DataFrame:
    """Stratified less spatial mean area, with both standard errors."""
    m = with_run(t, "fold_metrics").where(not_dummy())
    wide = []
    for mode, name in (("Stratified_Nested_CV", "stratified"), ("Spatial_Group_CV", "spatial")):
        v = F.when(F.col("cv_mode") == mode, F.col("pr_auc"))
        wide += [F.avg(v).alias(f"mean_{name}"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"se_{name}")]
    g = m.groupBy("target_contaminant", "predictor_tier", "algorithm").agg(*wide)
    return g.withColumn("penalty", F.col("mean_stratified") - F.col("mean_spatial"))


def worst_penalty(t: Tables) -> DataFrame:
    p = spatial_penalty(t).where("penalty is not null")
    return top_k(p, ["target_contaminant"], [F.desc("penalty"), "predictor_tier", "algorithm"], 1).drop("rank")


def reliability(predictions: DataFrame, keys: Sequence[str], bins: int = 8, least: int = 3) -> DataFrame:
    """Per right-closed bin: mean probability, observed share, n and binomial error; bins of fewer than least rows are left out."""
    g = predictions.groupBy(*keys, S.bin_right_closed(F.col("p"), bins).alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("observed"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).withColumn("se", F.sqrt(F.col("observed") * (1 - F.col("observed")) / F.col("n")))


def top_features(values: DataFrame, keys: Sequence[str], k: int = 10, ties: bool = True) -> DataFrame:
    """The k features of greatest mean absolute attribution; with ties, all that are as good as the k-th."""
    g = values.groupBy(*keys, "feature_name").agg(F.avg(F.abs("shap_value")).alias("mean_abs"))
    return top_k(g, keys, [F.desc("mean_abs")] if ties else [F.desc("mean_abs"), F.col("feature_name")], k, ties)


#: A column's ranks are broadcast if it has at most this many distinct values (24 bytes each), else joined by value.
RANKS_BROADCAST = 1 << 21


def spearman(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) over rows that have all columns: the correlation of average ranks, values compared as doubles; null if a or b has one value only, or there are no rows.

    Columns of up to RANKS_BROADCAST distinct values have their ranks looked up in sorted arrays where the rows are, and each task sums up products; no row is shuffled for them.
    The rows are shuffled once for each column of more distinct values.
    """
    full = wide.dropna("any", subset=list(columns)).select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    ranks = value_ranks(full, full.columns)
    sizes = {r.k: r for r in ranks.groupBy("k").agg(F.count("*").alias("n"), F.max("rank").alias("top")).collect()}  # a row a column
    ranked, held = full, {}
    for k, r in sizes.items():
        own = ranks.where(F.col("k") == k)
        if r.n <= RANKS_BROADCAST:
            found = own.select("v", "rank").orderBy("v").toPandas()
            held[k] = found["v"].to_numpy(), found["rank"].to_numpy()
        else:
            own = own.select(F.col("v").alias(f"_v{k}"), F.col("rank").alias(f"_r{k}")).hint("merge")
            ranked = ranked.join(own, F.col(f"c{k}") == F.col(f"_v{k}")).withColumn(f"c{k}", F.col(f"_r{k}")).select(*full.columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    middle = [sizes[k].top / 2 if k in sizes else 0.0 for k in range(len(columns))]  # near enough to the mean for the sums to keep their digits
    known = wide.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
        for batch in batches:
            x = [v.to_numpy(zero_copy_only=False) for v in batch.columns]
            x = np.column_stack([(known.value[k][1][np.searchsorted(known.value[k][0], v)] if k in known.value else v) - middle[k] for k, v in enumerate(x)])
            n, sums, products = n + len(x), sums + x.sum(0), products + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()]), pa.array([[products[i, j] for i, j in pairs]])], ["n", "s", "p"])

    total = ranked.mapInArrow(run, "n long, s array<double>, p array<double>")
    total = total.agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(len(columns))), *(F.sum(F.col("p")[i]).alias(f"p{a}_{b}") for i, (a, b) in enumerate(pairs)))
    covariance = lambda a, b: F.try_divide(F.col(f"p{a}_{b}"), F.col("n")) - F.try_divide(F.col(f"s{a}"), F.col("n")) * F.try_divide(F.col(f"s{b}"), F.col("n"))
    rho = lambda a, b: F.try_divide(covariance(a, b), F.sqrt(covariance(a, a)) * F.sqrt(covariance(b, b))) if all(k in sizes and sizes[k].n > 1 for k in (a, b)) else F.lit(None).cast("double")
    rows = F.array(*(F.struct(F.lit(columns[a]).alias("a"), F.lit(columns[b]).alias("b"), rho(a, b).alias("rho")) for a, b in pairs))
    return total.select(F.explode(rows).alias("x")).select("x.*")


def curves_long(t: Tables) -> DataFrame:
    s = with_run(t, "threshold_sensitivity").select("target_contaminant", "algorithm", "cv_mode", "probability_cutoff", "sensitivity", "specificity", "f2_score")
    return s.unpivot(["target_contaminant", "algorithm", "cv_mode", "probability_cutoff"], ["sensitivity", "specificity", "f2_score"], "metric", "value")


def best_confusion(t: Tables) -> DataFrame:
    """The confusion matrix of each target's best rule-based cutoff (least false negatives, then positives), long."""
    o = with_run(t, "operational_thresholds").where(not_dummy())
    best = top_k(o, ["target_contaminant"], ["false_negatives_count", "false_positives_count", "run_id", "threshold_selection_rule"], 1)
    c = S.confusion_from_sensitivity(F.col("false_negatives_count"), F.col("false_positives_count"), F.col("resulting_sensitivity"), F.col("resulting_specificity"))
    wide = best.select("target_contaminant", "run_id", c["tp"].cast("long").alias("tp"), c["tn"].cast("long").alias("tn"), F.col("false_positives_count").alias("fp"), F.col("false_negatives_count").alias("fn"))
    return wide.unpivot(["target_contaminant", "run_id"], ["tp", "tn", "fp", "fn"], "cell", "n")


def tier_retention(t: Tables, full: str = "Tier3_Full") -> DataFrame:
    """Mean area by tier, and its share of the full tier's."""
    g = with_run(t, "fold_metrics").groupBy("target_contaminant", "algorithm", "predictor_tier").agg(F.avg("pr_auc").alias("mean_pr_auc"))
    top = F.max(F.when(F.col("predictor_tier") == full, F.col("mean_pr_auc"))).over(Window.partitionBy("target_contaminant", "algorithm"))
    return g.withColumn("percent_retained", F.when(top > 0, F.round(100 * F.col("mean_pr_auc") / top, 1)))


def best_per_mode(t: Tables) -> DataFrame:
    return top_k(performance(t).where(not_dummy()), ["target_contaminant", "cv_mode"], [F.desc("mean_pr_auc"), "run_id"], 1).drop("rank")


def best_run(t: Tables) -> DataFrame:
    """Per target the validated run: greatest mean area, then least Brier score, stratified before spatial."""
    p = performance(t).where(not_dummy())
    order = [F.desc("mean_pr_auc"), F.asc("mean_brier"), F.when(F.col("cv_mode") == "Stratified_Nested_CV", 0).otherwise(1), F.col("run_id")]
    return top_k(p, ["target_contaminant"], order, 1).drop("rank")


def screening_priority(t: Tables) -> DataFrame:
    """Per sample and target: median and interval of the best run's probabilities, class and reason."""
    best = best_run(t).select("run_id")
    q = F.percentile("predicted_probability", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    g = t["well_predictions"].join(best, "run_id", "left_semi").groupBy("sample_id", "target_contaminant", "run_id").agg(q.alias("q"))
    out = g.select("sample_id", "target_contaminant", F.col("run_id").alias("best_validated_run_id"), F.col("q")[0].alias("predicted_probability_median"), F.col("q")[1].alias("predicted_probability_lower_ci"), F.col("q")[2].alias("predicted_probability_upper_ci"))
    out = out.withColumn("screening_priority_class", S.priority_class(F.col("predicted_probability_median")))
    return out.withColumn("priority_reason", S.priority_reason(F.col("screening_priority_class")))


def labelled_wells(t: Tables, k: int = 8) -> DataFrame:
    """Each sample's greatest probability over targets, then the k samples with the greatest."""
    each = top_k(t["screening_priority"], ["sample_id"], [F.desc("predicted_probability_median"), "target_contaminant"], 1).drop("rank")
    return each.orderBy(F.desc("predicted_probability_median"), "sample_id").limit(k)


def dataset_summary(t: Tables, summary: DataFrame) -> DataFrame:
    d = t["column_dictionary"].select(F.col("column_name").alias("variable_name"), "scientific_role", "unit")
    o = t["target_definitions"].select(F.col("source_column").alias("variable_name"), "threshold_value")
    return summary.join(d, "variable_name", "left").join(o, "variable_name", "left").orderBy("scientific_role", "variable_name")


def leakage_matrix(t: Tables) -> DataFrame:
    g = t["leakage_rules_applied"].groupBy("target_contaminant", "tier_name").agg(F.countDistinct(F.when(F.col("action") == "included", F.col("feature_name"))).alias("n_included"), F.countDistinct(F.when(F.col("action") == "excluded", F.col("feature_name"))).alias("n_excluded"))
    names = t["leakage_rules_applied"].where("action = 'excluded'").groupBy("target_contaminant", "tier_name").agg(F.array_join(F.array_sort(F.collect_set("feature_name")), ", ").alias("excluded"))
    return g.join(names, ["target_contaminant", "tier_name"], "left").orderBy("target_contaminant", "tier_name")


def performance_rounded(t: Tables, digits: int = 3) -> DataFrame:
    p = performance(t)
    return p.select(*RUN, *(F.round(c, digits).alias(c) for c in p.columns if c.startswith("mean_")), "n_folds")


def operational_rounded(t: Tables, digits: int = 3) -> DataFrame:
    o = operational(t)
    return o.select("target_contaminant", "algorithm", "cv_mode", "threshold_selection_rule", *(F.round(c, digits).alias(c) for c in ("optimized_probability_cutoff", "resulting_sensitivity", "resulting_specificity")), "false_negatives_count", "false_positives_count")


def retained_features(t: Tables) -> DataFrame:
    return t["leakage_rules_applied"].where("action = 'included'").select("target_contaminant", "tier_name", "feature_name").distinct()


def hyperparameters(t: Tables) -> DataFrame:
    """The values chosen per run, with how often."""
    return with_run(t, "model_hyperparameters").groupBy("target_contaminant", "predictor_tier", "algorithm", "cv_mode", "hyperparameter_name", "hyperparameter_value").agg(F.count("*").alias("n_folds"))


def cluster_members(t: Tables) -> DataFrame:
    g = _places(t).groupBy("spatial_cluster_id").agg(F.array_join(F.array_sort(F.collect_list("sample_id")), "; ").alias("members"))
    return t["spatial_cluster_metadata"].join(g, "spatial_cluster_id", "left").orderBy("spatial_cluster_id")


def reliability_of_best(t: Tables, bins: int = 10) -> DataFrame:
    best = best_run(t).select("run_id", "target_contaminant")
    p = t["well_predictions"].join(best, ["run_id", "target_contaminant"]).select("target_contaminant", F.col("predicted_probability").alias("p"), F.col("true_label").alias("y"))
    return reliability(p, ["target_contaminant"], bins, 1)


def features_of_best(t: Tables, k: int = 6) -> DataFrame:
    best = best_run(t).select("run_id", "target_contaminant")
    return top_features(with_run(t, "shap_values").join(best, ["run_id", "target_contaminant"]), ["target_contaminant"], k, ties=False)


def priority_map(t: Tables) -> DataFrame:
    return t["screening_priority"].join(_places(t), "sample_id").select("sample_id", "target_contaminant", "screening_priority_class", "latitude", "longitude")


def run_metrics(t: Tables) -> DataFrame:
    """fold_metrics anew from the predictions: all runs and folds at once."""
    p = t["well_predictions"].select("run_id", "cv_mode", "repeat_index", "fold_index", F.col("true_label").alias("y"), F.col("predicted_probability").alias("p"))
    return metrics.all_metrics(p, ["run_id", "cv_mode", "repeat_index", "fold_index"]).withColumnRenamed("recall", "recall_sensitivity")


R_EXPORTS = {"target_prevalence_summary": prevalence, "leakage_audit_summary": leakage_audit, "model_performance_summary": performance, "fold_metrics_long": fold_metrics_long, "out_of_fold_predictions": out_of_fold, "shap_values_long": attributions_long, "calibration_inputs": calibration_inputs, "operational_thresholds": operational, "threshold_sensitivity": sensitivity, "screening_priority_table": priority_table}
GIS_EXPORTS = {"well_screening_priority_points": priority_points, "target_specific_screening_probabilities": target_probabilities, "spatial_cluster_metadata": cluster_metadata}
#: Exports that grow with predictions times features; the others are of a few rows a run, and go to one file.
LARGE_EXPORTS = ("out_of_fold_predictions", "shap_values_long", "calibration_inputs")


def performance_figure(t: Tables) -> DataFrame:
    """The performance summary as figures take it: whether a run is a baseline, and the orders of targets, tiers and modes; sorted by these."""
    tiers = (*C.TIERS, *C.VARIANT_TIERS)
    p = performance(t).withColumns({"model_class": S.model_class(F.col("algorithm")), "target_level": S.level(F.col("target_contaminant"), C.TARGETS), "tier_level": S.level(F.col("predictor_tier"), tiers), "cv_level": S.level(F.col("cv_mode"), C.CV_MODES)})
    return p.orderBy("target_level", "tier_level", "cv_level", "run_id")


def regression_lines(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys.., slope, intercept) of least squares; (1, 0) for fewer than two rows and for x that don't differ."""
    flat = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) < 2) | (F.abs(F.regr_sxx(y, x)) < 1e-10)
    return df.groupBy(*keys).agg(F.when(flat, F.lit(1.0)).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(flat, F.lit(0.0)).otherwise(F.regr_intercept(y, x)).alias("intercept"))


def outline_targets(texts: DataFrame, key: str, text: str, targets: Sequence[str] = C.TARGETS) -> DataFrame:
    """(key, target_contaminant): the targets whose names a text holds."""
    held = F.filter(F.array(*map(F.lit, targets)), lambda name: F.contains(F.col(text), name))
    return texts.select(key, F.explode(held).alias("target_contaminant"))
