"""The study's relations over generic tables: how the operators are applied to TPC-H-like data.

Each is given twice, as a DataFrame and as the SQL of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.functions.scalars import run_id as make_run_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Measurements: a user's events are a sample's cells, with the forms of text that laboratories write.
CELLS_SQL = """cells AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, event_id AS original_row_index, event_type AS variable_name,
    CASE event_id % 17 WHEN 0 THEN '' WHEN 1 THEN 'bdl' WHEN 2 THEN 'ND' WHEN 3 THEN '<' || printf('%.2f', value) WHEN 4 THEN '-'
      WHEN 5 THEN '<abc' WHEN 6 THEN '1,000' WHEN 7 THEN '  ' || printf('%.2f', value) || ' ' ELSE printf('%.2f', value) END AS raw_value_text FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.format_string("%.2f", F.col("value")), F.col("event_id") % 17
    raw = F.when(k == 0, "").when(k == 1, "bdl").when(k == 2, "ND").when(k == 3, F.concat(F.lit("<"), v)).when(k == 4, "-").when(k == 5, "<abc").when(k == 6, "1,000").when(k == 7, F.concat(F.lit("  "), v, F.lit(" "))).otherwise(v)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.col("event_id").alias("original_row_index"), F.col("event_type").alias("variable_name"), raw.alias("raw_value_text"))


LIMITS = {"click": 0.23, "view": 1.5}
LIMITS_SQL = "limits AS (SELECT * FROM (VALUES ('click', 0.23::DOUBLE), ('view', 1.5::DOUBLE)) AS v(variable_name, configured_limit))"
_FLOAT = r"'(?i)[+-]?(inf(inity)?|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)'"


def _parse(t: str) -> str:
    return f"CASE WHEN regexp_full_match({t}, {_FLOAT}) THEN TRY_CAST({t} AS DOUBLE) END"


CLEAN_SQL = f"""{CELLS_SQL}, {LIMITS_SQL},
    trimmed AS (SELECT *, trim(raw_value_text) AS t, lower(trim(raw_value_text)) AS low FROM cells),
    detected AS (SELECT variable_name, min(x) AS min_detected FROM (SELECT variable_name, {_parse('t')} AS x, t, low FROM trimmed)
                 WHERE x > 0 AND x < 'inf'::DOUBLE AND low NOT IN ('bdl', 'nd', 'n.d.', '<dl', 'bl', '-') AND t NOT LIKE '<%' GROUP BY 1),
    last AS (SELECT * FROM trimmed QUALIFY row_number() OVER (PARTITION BY sample_id, variable_name
             ORDER BY t <> '' DESC, CASE WHEN t = '' THEN -original_row_index ELSE original_row_index END DESC) = 1),
    formed AS (SELECT *, low IN ('bdl', 'nd', 'n.d.', '<dl', 'bl', '-') AS marker, t LIKE '<%' AS less, {_parse('trim(substr(t, 2))')} AS below, {_parse('t')} AS plain,
                      coalesce(configured_limit, min_detected) AS lim
               FROM last LEFT JOIN limits USING (variable_name) LEFT JOIN detected USING (variable_name)),
    parsed AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN marker THEN lim / sqrt(2) WHEN less THEN below / sqrt(2) ELSE plain END AS value,
                      CAST(t <> '' AND (marker OR less) AS INTEGER) AS bdl_flag,
                      CASE WHEN t = '' OR marker THEN 0 WHEN less THEN CAST(below IS NULL AS INTEGER) ELSE CAST(plain IS NULL AS INTEGER) END AS is_err,
                      CASE WHEN t = '' THEN NULL WHEN marker THEN CASE WHEN lim IS NOT NULL THEN 'substituted_as_limit_div_sqrt2' ELSE 'bdl_stored_as_missing_no_limit' END
                           WHEN less THEN CASE WHEN below IS NOT NULL THEN 'substituted_as_reported_limit_div_sqrt2' ELSE 'failed_bdl_limit_parse' END END AS rule
               FROM formed),
    cleaned AS (SELECT sample_id, variable_name, raw_value_text, CASE WHEN isnan(value) THEN NULL ELSE value END AS cleaned_value_real, CASE WHEN t <> '' THEN 'unknown' END AS unit, bdl_flag,
                       CASE WHEN t <> '' THEN coalesce(rule, '') END AS bdl_rule, CAST(is_err = 1 OR value IS NULL OR isnan(value) AS INTEGER) AS missing_flag,
                       CASE WHEN t = '' THEN 'empty_value' WHEN is_err = 1 THEN 'failed_numeric_parse' WHEN rule = 'bdl_stored_as_missing_no_limit' THEN 'bdl_stored_as_missing'
                            WHEN bdl_flag = 1 AND less THEN 'bdl_substituted_using_reported_detection_limit' WHEN bdl_flag = 1 AND configured_limit IS NULL THEN 'bdl_substituted_using_min_detected_fallback'
                            WHEN bdl_flag = 1 THEN 'bdl_substituted_using_configured_detection_limit' ELSE '' END AS cleaning_note
                FROM parsed)"""

# Thresholds on the events' types.
THRESHOLDS = (("click", 200.0, "greater_than"), ("view", 100.0, "less_than"), ("purchase", 300.0, "greater_than"), ("error", None, "greater_than"), ("refund", 10.0, "greater_than"))
THRESHOLDS_SQL = "thresholds AS (SELECT * FROM (VALUES ('click', 200.0::DOUBLE, 'greater_than'), ('view', 100.0, 'less_than'), ('purchase', 300.0, 'greater_than'), ('error', NULL, 'greater_than'), ('refund', 10.0, 'greater_than')) AS v(target_contaminant, threshold_value, exceedance_direction))"
LABELS_SQL = f"""{CLEAN_SQL}, {THRESHOLDS_SQL},
    labelled AS (SELECT target_contaminant, s.sample_id, c.cleaned_value_real AS measured_value, threshold_value,
        CASE WHEN threshold_value IS NULL OR c.cleaned_value_real IS NULL THEN NULL WHEN exceedance_direction = 'less_than' THEN CAST(c.cleaned_value_real < threshold_value AS INTEGER)
             ELSE CAST(c.cleaned_value_real > threshold_value AS INTEGER) END AS true_label,
        CASE WHEN threshold_value IS NULL THEN 'no_threshold' WHEN c.sample_id IS NULL THEN 'missing_column' WHEN c.cleaned_value_real IS NULL THEN 'missing_value' ELSE 'labelled' END AS label_status
      FROM (SELECT DISTINCT sample_id FROM cleaned) s CROSS JOIN thresholds LEFT JOIN cleaned c ON c.sample_id = s.sample_id AND c.variable_name = target_contaminant)"""
ELIGIBLE_SQL = f"""{LABELS_SQL},
    counted AS (SELECT target_contaminant, count(true_label) AS n_samples, CAST(coalesce(sum(true_label), 0) AS BIGINT) AS n_positive, max(threshold_value) AS threshold_value FROM labelled GROUP BY 1),
    eligible AS (SELECT *, n_samples - n_positive AS n_negative, CASE WHEN n_samples > 0 THEN n_positive / n_samples ELSE 0.0 END AS prevalence,
        CAST(n_positive >= 5 AND n_samples - n_positive >= 5 AS INTEGER) AS cv_feasible,
        CASE WHEN threshold_value IS NULL THEN 'no_threshold' WHEN n_positive < 3 THEN 'descriptive_only' WHEN n_positive < 5 OR n_samples - n_positive < 5 THEN 'exploratory_only' ELSE 'modelled' END AS ml_status FROM counted)"""

# Predictions of runs: line items are wells' predictions, tie-heavy.
PREDICTIONS_SQL = """named AS (SELECT *, 'T' || (l_suppkey % 3) AS target_contaminant, CASE l_partkey % 3 WHEN 0 THEN 'Tier1_Field' WHEN 1 THEN 'Tier2_Reduced' ELSE 'Tier3_Full' END AS predictor_tier,
      CASE l_orderkey % 3 WHEN 0 THEN 'RandomForest' WHEN 1 THEN 'LogisticRegression' ELSE 'DummyMajority' END AS algorithm,
      CASE l_linestatus WHEN 'O' THEN 'Stratified_Nested_CV' ELSE 'Spatial_Group_CV' END AS cv_mode FROM lineitem),
    predictions AS (SELECT substr(sha256(target_contaminant || '_' || predictor_tier || '_' || algorithm || '_' || cv_mode), 1, 32) AS run_id, 's' || (l_orderkey % 5000) AS sample_id,
      target_contaminant, predictor_tier, algorithm, cv_mode, CAST(l_linenumber % 2 AS INTEGER) AS repeat_index, CAST(l_linenumber % 3 AS INTEGER) AS fold_index,
      CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 10 AS p, l_tax, l_linenumber, l_orderkey FROM named)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    named = li.select(
        "*", F.concat(F.lit("T"), (F.col("l_suppkey") % 3).cast("string")).alias("target_contaminant"), pick("l_partkey", "Tier1_Field", "Tier2_Reduced", "Tier3_Full").alias("predictor_tier"),
        pick("l_orderkey", "RandomForest", "LogisticRegression", "DummyMajority").alias("algorithm"), F.when(F.col("l_linestatus") == "O", "Stratified_Nested_CV").otherwise("Spatial_Group_CV").alias("cv_mode"),
    )
    keys = ["target_contaminant", "predictor_tier", "algorithm", "cv_mode"]
    return named.select(
        make_run_id(*map(F.col, keys)).alias("run_id"), F.concat(F.lit("s"), (F.col("l_orderkey") % 5000).cast("string")).alias("sample_id"), *keys, (F.col("l_linenumber") % 2).cast("int").alias("repeat_index"),
        (F.col("l_linenumber") % 3).cast("int").alias("fold_index"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"), "l_tax", "l_linenumber", "l_orderkey",
    )


STORE_SQL = f"""{PREDICTIONS_SQL},
    model_runs AS (SELECT DISTINCT run_id, target_contaminant, predictor_tier, algorithm, cv_mode FROM predictions),
    fold_metrics AS (SELECT run_id, repeat_index, fold_index, avg(l_tax) * 10 AS roc_auc, avg(p) AS pr_auc, avg(p * l_tax) AS balanced_accuracy, avg(y) AS recall_sensitivity, avg(1 - y) AS specificity,
        avg(p * y) AS f1_score, avg(p * (1 - y)) AS f2_score, avg((y - p) * (y - p)) AS brier_score, sum(y) AS n_test_pos, sum(1 - y) AS n_test_neg FROM predictions GROUP BY ALL),
    shap_values AS (SELECT run_id, sample_id, repeat_index, fold_index, 'f' || l_linenumber AS feature_name, l_tax - 0.04 AS shap_value, l_tax AS feature_cleaned_value FROM predictions),
    places AS (SELECT 's' || c_custkey AS sample_id, c_acctbal / 200 AS latitude, CAST(c_custkey % 360 - 180 AS DOUBLE) AS longitude, CAST(c_nationkey AS INTEGER) AS spatial_cluster_id, c_name || ', ' || c_mktsegment AS location FROM customer)"""
PERFORMANCE_SQL = f"""{STORE_SQL},
    performance AS (SELECT run_id, target_contaminant, predictor_tier, algorithm, cv_mode, avg(roc_auc) AS mean_roc_auc, avg(pr_auc) AS mean_pr_auc, avg(balanced_accuracy) AS mean_bal_acc, avg(recall_sensitivity) AS mean_recall,
        avg(specificity) AS mean_spec, avg(f1_score) AS mean_f1, avg(f2_score) AS mean_f2, avg(brier_score) AS mean_brier, count(*) AS n_folds, min(pr_auc) AS min_pr_auc, max(pr_auc) AS max_pr_auc
      FROM fold_metrics JOIN model_runs USING (run_id) GROUP BY ALL),
    best AS (SELECT * FROM performance WHERE algorithm NOT ILIKE 'Dummy%' QUALIFY row_number() OVER (PARTITION BY target_contaminant ORDER BY mean_pr_auc DESC, mean_brier, cv_mode <> 'Stratified_Nested_CV', run_id) = 1)"""
_CLASS = "CASE WHEN {0} >= 0.75 THEN 'Very_High' WHEN {0} >= 0.5 THEN 'High' WHEN {0} >= 0.25 THEN 'Moderate' ELSE 'Low' END"
PRIORITY_SQL = f"""{PERFORMANCE_SQL},
    screening AS (SELECT sample_id, p.target_contaminant, p.run_id AS best_validated_run_id, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.025) AS lower, quantile_cont(p, 0.975) AS upper
      FROM predictions p JOIN best USING (run_id) GROUP BY ALL),
    classed AS (SELECT *, {_CLASS.format('median')} AS class FROM screening)"""


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The run tables that reports read."""
    p = predictions(spark, sf_dir)
    y, q = F.col("y"), F.col("p")
    metrics = p.groupBy("run_id", "repeat_index", "fold_index").agg(
        (F.avg("l_tax") * 10).alias("roc_auc"), F.avg("p").alias("pr_auc"), F.avg(q * F.col("l_tax")).alias("balanced_accuracy"), F.avg(y).alias("recall_sensitivity"), F.avg(1 - y).alias("specificity"), F.avg(q * y).alias("f1_score"),
        F.avg(q * (1 - y)).alias("f2_score"), F.avg((y - q) * (y - q)).alias("brier_score"), F.sum("y").alias("n_test_pos"), F.sum(1 - y).alias("n_test_neg"), F.lit(1.0).alias("calibration_slope"), F.lit(0.0).alias("calibration_intercept"),
    )
    c = table(spark, sf_dir, "customer")
    sample = F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sample_id")
    out = {
        "model_runs": p.select("run_id", "target_contaminant", "predictor_tier", "algorithm", "cv_mode").distinct(),
        "fold_metrics": metrics,
        "well_predictions": p.withColumnsRenamed({"y": "true_label", "p": "predicted_probability"}),
        "shap_values": p.select("run_id", "sample_id", "repeat_index", "fold_index", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature_name"), (F.col("l_tax") - 0.04).alias("shap_value"), F.col("l_tax").alias("feature_cleaned_value")),
        "sample_spatial_assignment": c.select(sample, (F.col("c_acctbal") / 200).alias("latitude"), (F.col("c_custkey") % 360 - 180).cast("double").alias("longitude"), F.col("c_nationkey").cast("int").alias("spatial_cluster_id")),
        "raw_samples": c.select(sample, F.to_json(F.struct(F.concat_ws(", ", "c_name", "c_mktsegment").alias("Location"))).alias("raw_json")),
    }
    return out


# Coordinates and a feature matrix: vectors.
FEATURES = 64
POINTS_SQL = "points AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, vec_id AS original_row_index, CAST(embedding[1] AS DOUBLE) * 20 AS lat, CAST(embedding[2] AS DOUBLE) * 40 AS lon, CAST(label AS INTEGER) AS spatial_cluster_id FROM embeddings)"
LONG_SQL = f"""long AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(label = 0 AS INTEGER) AS true_label, CAST(vec_id % 3 AS INTEGER) AS own, 'e' || f AS feature,
    CASE WHEN (vec_id + f) % 11 = 0 THEN NULL ELSE CAST(embedding[f] AS DOUBLE) END AS raw FROM embeddings, unnest(range(1, {FEATURES + 1})) AS t(f)),
    rows AS (SELECT fold_index, sample_id, feature, true_label, raw, CAST(own <> fold_index AS INTEGER) AS is_train FROM long, unnest([0, 1, 2]) AS u(fold_index))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("vec_id").alias("original_row_index"), (at(0) * 20).alias("lat"), (at(1) * 40).alias("lon"), F.col("label").cast("int").alias("spatial_cluster_id"))


def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    f = e.select("vec_id", "label", F.posexplode(F.slice("embedding", 1, FEATURES)).alias("k", "x"))
    value = F.when((F.col("vec_id") + F.col("k") + 1) % 11 != 0, F.col("x").cast("double"))
    rows = f.select(F.col("vec_id").cast("string").alias("sample_id"), (F.col("label") == 0).cast("int").alias("true_label"), (F.col("vec_id") % 3).cast("int").alias("own"), F.concat(F.lit("e"), (F.col("k") + 1).cast("string")).alias("feature"), value.alias("value"))
    return rows.withColumn("fold_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("is_train", (F.col("own") != F.col("fold_index")).cast("int")).drop("own")


def tasks(spark: SparkSession, sf_dir: str, *algorithms: str) -> DataFrame:
    """One row a sample, fold and algorithm, with its features as an array; the first feature is called EC."""
    e = table(spark, sf_dir, "embeddings")
    names = F.array(F.lit("EC"), *(F.lit(f"e{k}") for k in range(2, FEATURES + 1)))
    rows = e.select(F.col("vec_id").cast("string").alias("sample_id"), (F.col("label") == 0).cast("int").alias("true_label"), (F.col("vec_id") % 3).cast("int").alias("own"), F.slice("embedding", 1, FEATURES).cast("array<double>").alias("features"), names.alias("feature_names"), F.lit(0).alias("repeat_index"))
    each = rows.withColumn("fold_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("is_train", (F.col("own") != F.col("fold_index")).cast("int")).drop("own")
    return each.withColumn("algorithm", F.explode(F.array(*map(F.lit, algorithms))))


# Candidate features: the study's own names, whole or inside longer ones, for each kind of part; half of the parts spell them in capitals.
STUDY_FEATURES = ("pH", "EC", "Na", "Cl", "Na_Cl_ratio", "SAR", "NO3", "HCO3", "F_label", "TDS", "Mg_Ca_ratio", "exceedance")
FEATURE_TIERS = ("Tier1_Field", "Tier2_Reduced", "Tier3_Full")
CANDIDATES_SQL = f"""cand AS (SELECT DISTINCT {list(FEATURE_TIERS)}[CAST(p_size % 3 AS INTEGER) + 1] AS tier_name,
    CASE p_partkey % 4 WHEN 0 THEN n WHEN 1 THEN n || '_' || replace(p_name, ' ', '_') WHEN 2 THEN lower(p_type) || '_' || n ELSE upper(p_type || '_' || n) END AS feature_name
    FROM (SELECT *, {list(STUDY_FEATURES)}[CAST(p_partkey // 4 % {len(STUDY_FEATURES)} AS INTEGER) + 1] AS n FROM part))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tier_name, feature_name) of candidate features made of parts."""
    part = table(spark, sf_dir, "part")
    at = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    n, kind = at(STUDY_FEATURES, F.floor(F.col("p_partkey") / 4)), F.col("p_partkey") % 4
    name = F.when(kind == 0, n).when(kind == 1, F.concat_ws("_", n, F.replace("p_name", F.lit(" "), F.lit("_")))).when(kind == 2, F.concat_ws("_", F.lower("p_type"), n)).otherwise(F.upper(F.concat_ws("_", "p_type", n)))
    return part.select(at(FEATURE_TIERS, F.col("p_size")).alias("tier_name"), name.alias("feature_name")).distinct()
