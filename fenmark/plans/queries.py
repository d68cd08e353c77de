"""Registered queries: the operators on generic tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark import config as C
from fenmark.functions import scalars as S
from fenmark.operators import folds, ingest, leakage, metrics, models, preprocess, ranks, resample, spatial, upsert
from fenmark.plans import bindings as B
from fenmark.plans import reports
from fenmark.sources.scratch import new_folder
from fenmark.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(ingest.quoted(c)), digits).alias(c) if t == "double" else F.col(ingest.quoted(c)) for c, t in df.dtypes))


def limits(spark: SparkSession) -> DataFrame:
    return ingest.configured_limits(spark, B.LIMITS)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean(B.cells(spark, sf_dir), limits(spark))


def thresholds(spark: SparkSession) -> DataFrame:
    return ingest.thresholds_frame(spark, [C.Threshold(n, n, "", v, "", d) for n, v, d in B.THRESHOLDS])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cleaned(spark, sf_dir)
    return ingest.labels(m, m, thresholds(spark))


# Reshaping and cleaning


@query("SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_linenumber AS original_row_index, v AS variable_name, printf('%.2f', CASE v WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END) AS raw_value_text FROM lineitem, unnest(['l_quantity', 'l_discount', 'l_tax']) AS t(v)")
def eav_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").cast("string").alias("SampleID"), F.col("l_linenumber").alias("original_row_index"), *(F.format_string("%.2f", F.col(c)).alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    return ingest.to_long(rows)


@query(f"WITH {B.CLEAN_SQL} SELECT sample_id, " + ", ".join(f"round(max(CASE WHEN variable_name = '{v}' THEN cleaned_value_real END), 6) AS \"{v}\"" for v in ("click", "view", "purchase")) + " FROM cleaned WHERE variable_name IN ('click', 'view', 'purchase') GROUP BY 1")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.to_wide(cleaned(spark, sf_dir), ["click", "view", "purchase"]))


@query(f"WITH {B.CLEAN_SQL} SELECT sample_id, variable_name, raw_value_text, round(cleaned_value_real, 6) AS cleaned_value_real, unit, bdl_flag, bdl_rule, missing_flag, cleaning_note FROM cleaned")
def bdl_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaned(spark, sf_dir))


@query(f"WITH {B.CLEAN_SQL} SELECT * FROM detected")
def bdl_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.min_detected(B.cells(spark, sf_dir))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return upsert.last_write_wins(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return upsert.first_write_wins(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT s_suppkey AS c_custkey, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal FROM supplier WHERE s_acctbal > 5000")
def replace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = B.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = B.table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert.replace_groups(old, new, ["c_nationkey"])


@query(f"""WITH {B.CLEAN_SQL}, have AS (SELECT sample_id FROM cleaned WHERE variable_name IN ('click', 'view') AND cleaned_value_real IS NOT NULL GROUP BY 1 HAVING count(DISTINCT variable_name) = 2)
    SELECT (SELECT count(*) FROM cells) AS n_rows, (SELECT count(DISTINCT sample_id) FROM cells) AS n_samples, (SELECT count(*) - count(DISTINCT sample_id) FROM cells) AS duplicate_sample_count,
      count(DISTINCT variable_name) AS n_variables, CAST(sum(bdl_flag) AS BIGINT) AS n_bdl, CAST(sum(missing_flag) AS BIGINT) AS n_missing, CAST(sum(CAST(cleaning_note = 'failed_numeric_parse' AS INTEGER)) AS BIGINT) AS n_parse_errors,
      (SELECT count(DISTINCT sample_id) FROM cells WHERE sample_id NOT IN (SELECT sample_id FROM have)) AS missing_coordinate_count,
      CASE WHEN sum(CAST(cleaning_note = 'failed_numeric_parse' AS INTEGER)) > 5 THEN 'WARNING' ELSE 'OK' END AS audit_status FROM cleaned""")
def data_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.audit(B.cells(spark, sf_dir), cleaned(spark, sf_dir), "click", "view")


@query(f"WITH {B.CLEAN_SQL} SELECT DISTINCT sample_id FROM cleaned c WHERE NOT EXISTS (SELECT 1 FROM cleaned a WHERE a.sample_id = c.sample_id AND a.variable_name = 'click' AND a.cleaned_value_real IS NOT NULL) OR NOT EXISTS (SELECT 1 FROM cleaned a WHERE a.sample_id = c.sample_id AND a.variable_name = 'view' AND a.cleaned_value_real IS NOT NULL)")
def missing_coord_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cleaned(spark, sf_dir)
    return ingest.missing_coordinates(m, m, "click", "view")


@query(f"WITH {B.LABELS_SQL} SELECT target_contaminant, sample_id, round(measured_value, 6) AS measured_value, threshold_value, CAST(true_label AS DOUBLE) AS true_label, label_status FROM labelled")
def exceedance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labelled(spark, sf_dir).withColumn("true_label", F.col("true_label").cast("double")))


_NOTE = """CASE WHEN threshold_value IS NULL THEN 'Threshold not configured — cannot generate labels' WHEN n_positive < 3 THEN 'Only ' || n_positive || ' positive cases; insufficient for any ML'
      WHEN n_positive < 5 THEN n_positive || ' positive cases < minimum 5 for standard CV' WHEN n_negative < 5 THEN 'Class distribution too extreme for reliable CV (n_pos=' || n_positive || ', n_neg=' || n_negative || ')'
      ELSE n_positive || ' positive, ' || n_negative || ' negative — ML feasible' END AS eligibility_note"""
_ELIGIBLE = "target_contaminant, n_samples, n_positive, n_negative, round(prevalence, 6) AS prevalence, cv_feasible, ml_status, CASE WHEN ml_status = 'modelled' THEN 'Main text' ELSE 'Supplement' END AS reporting_level"


@query(f"WITH {B.ELIGIBLE_SQL} SELECT {_ELIGIBLE}, {_NOTE} FROM eligible")
def target_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.eligibility(labelled(spark, sf_dir)))


@query(f"WITH {B.ELIGIBLE_SQL} SELECT {_ELIGIBLE}, e.threshold_value FROM eligible e ORDER BY target_contaminant")
def prevalence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"target_eligibility": ingest.eligibility(labelled(spark, sf_dir)), "target_definitions": thresholds(spark).withColumnRenamed("unit", "threshold_unit")}
    return rounded(reports.prevalence(t).drop("eligibility_note", "threshold_unit", "threshold_source"))


@query(f"""WITH {B.LABELS_SQL} SELECT sample_id, target_contaminant, true_label FROM labelled WHERE label_status = 'labelled'
    AND target_contaminant IN (SELECT target_contaminant FROM labelled GROUP BY 1 HAVING max(threshold_value) IS NOT NULL AND sum(true_label) >= 5 AND count(true_label) - sum(true_label) >= 5)""")
def eligible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir)
    ok = ingest.eligibility(lab).where("ml_status = 'modelled'").select("target_contaminant")
    return lab.where("label_status = 'labelled'").join(ok, "target_contaminant", "left_semi").select("sample_id", "target_contaminant", "true_label")


@query(f"""WITH {B.CLEAN_SQL} SELECT variable_name, count(CASE WHEN bdl_flag = 0 THEN cleaned_value_real END) AS n_valid, CAST(sum(bdl_flag) AS BIGINT) AS n_bdl,
      CAST(sum(CASE WHEN bdl_flag = 0 AND cleaned_value_real IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, round(min(CASE WHEN bdl_flag = 0 THEN cleaned_value_real END), 3) AS min_value,
      round(max(CASE WHEN bdl_flag = 0 THEN cleaned_value_real END), 3) AS max_value, round(median(CASE WHEN bdl_flag = 0 THEN cleaned_value_real END), 3) AS median_value FROM cleaned GROUP BY 1""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(cleaned(spark, sf_dir))


_RATIO_VARIABLES = {"Na": "l_extendedprice", "Cl": "l_quantity", "Mg": "l_tax", "Ca": "l_discount", "HCO3": "l_suppkey"}


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END, 8) AS Na_Cl_ratio, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount END, 8) AS Mg_Ca_ratio,
      round(CASE WHEN l_quantity > 0 THEN l_suppkey / l_quantity END, 8) AS HCO3_Cl_ratio, round(CASE WHEN sqrt(0.5 * (l_discount / 20.04 + l_tax / 12.155)) > 0 THEN (l_extendedprice / 22.99) / sqrt(0.5 * (l_discount / 20.04 + l_tax / 12.155)) END, 4) AS SAR,
      round(CASE WHEN l_tax > 0 THEN l_discount / l_tax END, 8) AS Ca_Mg_ratio FROM lineitem""")
def derived_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.derived({k: F.col(c) for k, c in _RATIO_VARIABLES.items()})
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(e, 4 if n == "SAR" else 8).alias(n) for n, e in made.items()))


_ANALYTES = "cells AS (SELECT l_orderkey || '-' || l_linenumber AS sample_id, l_extendedprice AS \"Na\", l_quantity AS \"Cl\", l_tax AS \"Mg\", l_discount AS \"Ca\", CAST(l_suppkey AS DOUBLE) AS \"HCO3\" FROM lineitem), analytes AS (SELECT sample_id, max(\"Na\") AS \"Na\", max(\"Cl\") AS \"Cl\", max(\"Mg\") AS \"Mg\", max(\"Ca\") AS \"Ca\", max(\"HCO3\") AS \"HCO3\" FROM cells GROUP BY sample_id)"
_DERIVED = """derived AS (SELECT sample_id, "Na" / nullif("Cl", 0) AS "Na_Cl_ratio", "Mg" / nullif("Ca", 0) AS "Mg_Ca_ratio", "HCO3" / nullif("Cl", 0) AS "HCO3_Cl_ratio", ("Na" / 22.99) / nullif(sqrt(0.5 * ("Ca" / 20.04 + "Mg" / 12.155)), 0) AS "SAR", "Ca" / nullif("Mg", 0) AS "Ca_Mg_ratio" FROM analytes)"""


def _analytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements of the analytes that ratios are made of."""
    sample = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sample_id")
    wide = B.table(spark, sf_dir, "lineitem").select(sample, *(F.col(c).cast("double").alias(v) for v, c in _RATIO_VARIABLES.items()))
    return wide.unpivot("sample_id", list(_RATIO_VARIABLES), "variable_name", "cleaned_value_real")


@query(f"""WITH {_ANALYTES}, {_DERIVED}, u AS (SELECT sample_id, variable_name, v FROM derived UNPIVOT (v FOR variable_name IN ("Na_Cl_ratio", "Mg_Ca_ratio", "HCO3_Cl_ratio", "SAR", "Ca_Mg_ratio")))
    SELECT sample_id, variable_name, CASE variable_name WHEN 'Na_Cl_ratio' THEN 'Na/Cl' WHEN 'Mg_Ca_ratio' THEN 'Mg/Ca' WHEN 'HCO3_Cl_ratio' THEN 'HCO3/Cl' WHEN 'SAR' THEN 'Na/sqrt(0.5*(Ca+Mg))' ELSE 'Ca/Mg' END AS raw_value_text,
      round(v, 7) AS cleaned_value_real, CASE variable_name WHEN 'SAR' THEN '(meq/L)^0.5' ELSE 'mg/L ratio' END AS unit, 0 AS bdl_flag, 0 AS missing_flag, 'Derived ratio computed post-ingestion' AS cleaning_note FROM u WHERE v IS NOT NULL""")
def derived_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.derived_rows(_analytes(spark, sf_dir)), 7)


@query(f"""WITH {_ANALYTES}, {_DERIVED} SELECT sample_id, "Na", "Cl", round("SAR", 4) AS "SAR", round("Mg_Ca_ratio", 6) AS "Mg_Ca_ratio" FROM analytes JOIN derived USING (sample_id)""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.feature_matrix(_analytes(spark, sf_dir), ["Na", "Cl", "SAR", "Mg_Ca_ratio"]).withColumns({"SAR": F.round("SAR", 4), "Mg_Ca_ratio": F.round("Mg_Ca_ratio", 6)})


_COLUMNS = ("SampleID", "Location", "Dx", "EC", "Na", "TDS", "SO4", "pH")
_DICTIONARY = "dictionary AS (SELECT * FROM (VALUES ('SampleID', 'identifier', 'text'), ('Location', 'identifier', 'text'), ('Dx', 'coordinate', 'decimal_degrees_lon'), ('EC', 'field_parameter', 'µS/cm'), ('Na', 'target_contaminant', 'mg/L'), ('TDS', 'target_contaminant', 'mg/L'), ('SO4', 'laboratory_chemical', 'mg/L'), ('pH', 'field_parameter', 'dimensionless')) AS v(column_name, scientific_role, unit))"


_ROLE = "CASE WHEN column_name IN ('SampleID', 'Location') THEN 'identifier' WHEN column_name IN ('Dx', 'Dy') THEN 'coordinate' WHEN column_name IN ('pH', 'Temp.', 'EC') THEN 'field_parameter' WHEN column_name IN ('Na', 'Cl', 'TDS', 'B', 'F', 'NO3') THEN 'target_contaminant' ELSE 'laboratory_chemical' END"
_UNIT = "CASE column_name WHEN 'SampleID' THEN 'text' WHEN 'Location' THEN 'text' WHEN 'pH' THEN 'dimensionless' WHEN 'EC' THEN 'µS/cm' ELSE 'mg/L' END"


@query(f"""WITH {B.CANDIDATES_SQL}, named AS (SELECT DISTINCT feature_name AS column_name FROM cand UNION SELECT 'SampleID' UNION SELECT 'Location')
    SELECT column_name, 'numeric' AS inferred_type, {_ROLE} AS scientific_role, {_UNIT} AS unit, CAST({_ROLE} = 'coordinate' AS INTEGER) AS is_coordinate, CAST({_ROLE} = 'target_contaminant' AS INTEGER) AS is_target_candidate,
      CAST({_ROLE} = 'field_parameter' AS INTEGER) AS is_field_variable, CAST({_ROLE} = 'laboratory_chemical' AS INTEGER) AS is_lab_variable, 0 AS is_derived_variable FROM named""")
def column_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.candidates(spark, sf_dir).select(F.col("feature_name").alias("column_name")).unionByName(spark.createDataFrame([("SampleID",), ("Location",)], "column_name string")).distinct()
    return ingest.described(names)


@query(f"""WITH {_ANALYTES}, {_DICTIONARY}, u AS (SELECT sample_id, variable_name, v FROM cells UNPIVOT (v FOR variable_name IN ("Na", "Cl", "Mg", "Ca", "HCO3")))
    SELECT variable_name, count(v) AS n_valid, 0::BIGINT AS n_bdl, 0::BIGINT AS n_missing, round(min(v), 3) AS min_value, round(max(v), 3) AS max_value, round(median(v), 3) AS median_value, any_value(scientific_role) AS scientific_role, any_value(unit) AS unit,
      CASE variable_name WHEN 'Na' THEN 150.0::DOUBLE WHEN 'Cl' THEN 187.5 END AS threshold_value FROM u LEFT JOIN dictionary ON column_name = variable_name GROUP BY variable_name""")
def dataset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    defined = ingest.thresholds_frame(spark, C.STUDY_THRESHOLDS.targets)
    t = {"column_dictionary": ingest.column_dictionary(spark, _COLUMNS), "target_definitions": defined}
    return reports.dataset_summary(t, ingest.summary(_analytes(spark, sf_dir).withColumn("bdl_flag", F.lit(0))))


@query("""SELECT coalesce(c.column_name, r.column_name) AS column_name, CAST(c.column_name IS NOT NULL AS INTEGER) AS present, CAST(r.column_name IS NOT NULL AS INTEGER) AS is_required, coalesce(n, 0)::BIGINT AS n_bdl_cells
    FROM (SELECT 'SampleID' AS column_name, 0 AS n UNION ALL SELECT 'Na', count(*) FILTER (WHERE user_id % 5 = 0) FROM events UNION ALL SELECT 'Cl', 0) c FULL JOIN (VALUES ('SampleID'), ('Na'), ('Dx')) AS r(column_name) USING (column_name)""")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("SampleID"), F.when(F.col("user_id") % 5 == 0, " BDL ").otherwise("1").alias("Na"), F.lit("2").alias("Cl"))
    return ingest.validation(rows, ["SampleID", "Na", "Dx"])


@query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), n AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 3000 THEN s_acctbal END AS v FROM supplier UNION ALL SELECT s_suppkey + 100000000, CASE WHEN s_acctbal > 5000 THEN s_acctbal END FROM supplier)
    SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k""")
def merge_keeps_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a value never take the place of one that is there."""
    old = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = B.table(spark, sf_dir, "supplier")
    new = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 3000, F.col("s_acctbal")).alias("v")).unionByName(s.select((F.col("s_suppkey") + 100000000).alias("k"), F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")).alias("v")))
    return upsert.merge(old, new, ["k"], F.col("v").isNull())


def _stored(spark: SparkSession, old: DataFrame, write: Callable[[Store], DataFrame]) -> DataFrame:
    """What a store of one keyed table (k, g, v) reads after write, having held old."""
    store = Store(spark, new_folder(spark, "store"), tables={"t": "k long, g int, v double"}, keys={"t": ("k",)})
    store.append("t", old)
    return write(store)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("int").alias("g"), F.col("c_acctbal").alias("v"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.table(spark, sf_dir, "supplier")
    v = F.when(F.col("s_acctbal") > 3000, F.col("s_acctbal"))
    return s.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("int").alias("g"), v.alias("v")).unionByName(s.select((F.col("s_suppkey") + 100000000).alias("k"), F.col("s_nationkey").cast("int").alias("g"), v.alias("v")))


_HELD = "o AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal AS v FROM customer), n AS (SELECT s_suppkey + d AS k, s_nationkey AS g, CASE WHEN s_acctbal > 3000 THEN s_acctbal END AS v FROM supplier, (VALUES (0), (100000000)) AS t(d))"


@query(f"WITH {_HELD} SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.v IS NOT NULL OR o.k IS NULL THEN n.g ELSE o.g END AS g, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k")
def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As merge_keeps_values, through the buckets of a store."""
    return _stored(spark, _customers(spark, sf_dir), lambda s: s.merge("t", _suppliers(spark, sf_dir), ["k"], F.col("v").isNull()))


@query(f"WITH {_HELD} SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n")
def stored_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of new keys take the place of old ones, in a store whose files without such a row stay."""
    return _stored(spark, _customers(spark, sf_dir), lambda s: s.replace("t", _suppliers(spark, sf_dir), ["k"]))


@query(f"WITH {_HELD} SELECT * FROM o WHERE g NOT IN (SELECT g FROM n WHERE v > 5000) UNION ALL SELECT * FROM n WHERE v > 5000")
def stored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete-then-insert of whole groups, which lie in all buckets."""
    return _stored(spark, _customers(spark, sf_dir), lambda s: s.replace("t", _suppliers(spark, sf_dir).where("v > 5000"), ["g"]))


@query(f"WITH {_HELD} SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def stored_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only keys that are not stored yet come in."""
    return _stored(spark, _customers(spark, sf_dir), lambda s: s.insert_missing("t", _suppliers(spark, sf_dir), ["k"]))


@query("""SELECT o_orderkey, trim(x) AS raw, CASE WHEN regexp_full_match(trim(x), '(?i)[+-]?(inf(inity)?|nan|(\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?)') THEN TRY_CAST(trim(x) AS DOUBLE) END AS value
    FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1d' WHEN 1 THEN '1_0' WHEN 2 THEN '.5' WHEN 3 THEN '2.' WHEN 4 THEN '1e-3 ' ELSE '0x1p3' END AS x FROM orders)""")
def float_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    x = F.when(k == 0, "1d").when(k == 1, "1_0").when(k == 2, ".5").when(k == 3, "2.").when(k == 4, "1e-3 ").otherwise("0x1p3")
    return B.table(spark, sf_dir, "orders").select("o_orderkey", S.trimmed(x).alias("raw"), S.parse_float(S.trimmed(x)).alias("value"))


@query("SELECT doc_id, (SELECT trim(l) FROM (SELECT unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i) WHERE i > 0 AND trim(l) <> '' ORDER BY i LIMIT 1) AS title FROM documents")
def title_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", S.title(F.col("text")).alias("title"))


# Leakage


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.audit(B.candidates(spark, sf_dir), leakage.rules_frame(spark, C.STUDY_RULES))


def _leakage_sql() -> str:
    quote = lambda x: "NULL" if x is None else "'" + x + "'"
    arr = lambda xs: "[" + ", ".join(map(quote, xs)) + "]::VARCHAR[]"
    rules = []
    for name, r in C.STUDY_RULES.targets.items():
        for variant, (_, exact) in [(None, ((), ())), *r.variants.items()]:
            rules.append(f"({quote(name)}, {quote(variant)}::VARCHAR, {arr(r.forbidden_exact)}, {arr(r.forbidden_contains)}, {arr(exact)})")
    return f"""rules AS (SELECT * FROM (VALUES {', '.join(rules)}) AS v(target_contaminant, variant, ex, inside, vex)), {B.CANDIDATES_SQL},
    audited AS (SELECT target_contaminant, variant, tier_name, feature_name,
      CASE WHEN list_bool_or([contains(lower(feature_name), lower(p)) FOR p IN {arr(C.STUDY_RULES.global_forbidden_patterns)}]) THEN 'global_pattern' WHEN list_contains(ex, feature_name) THEN 'exact_name'
           WHEN list_bool_or([contains(lower(feature_name), lower(p)) FOR p IN inside]) THEN 'name_pattern' WHEN list_contains(vex, feature_name) THEN 'variant_exclusion' END AS reason FROM rules CROSS JOIN cand)"""


@query(f"WITH {_leakage_sql()} SELECT target_contaminant, variant, tier_name, feature_name, CASE WHEN reason IS NULL THEN 'included' ELSE 'excluded' END AS action, reason FROM audited")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


@query(f"WITH {_leakage_sql()} SELECT target_contaminant, variant, tier_name, count(DISTINCT feature_name) AS n_features FROM audited WHERE reason IS NULL GROUP BY ALL")
def leakage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.counts(_audited(spark, sf_dir))


@query(f"WITH {_leakage_sql()} SELECT target_contaminant, tier_name, count(DISTINCT CASE WHEN reason IS NULL THEN feature_name END) AS n_included, count(DISTINCT CASE WHEN reason IS NOT NULL THEN feature_name END) AS n_excluded, string_agg(CASE WHEN reason IS NOT NULL THEN feature_name END, ', ' ORDER BY feature_name) AS excluded FROM audited WHERE variant IS NULL GROUP BY ALL ORDER BY 1, 2")
def leakage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.leakage_matrix({"leakage_rules_applied": _audited(spark, sf_dir).where("variant is null")})


# Folds


_FOLDED = "SELECT vec_id AS sample_id, CAST(label = 0 AS INTEGER) AS true_label FROM embeddings"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") == 0).cast("int").alias("true_label"))


def _fold_sql(seed: str, k: int, by: str = "true_label") -> str:
    return f"CAST((row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST({seed} AS VARCHAR) || ':' || CAST(sample_id AS VARCHAR)), sample_id) - 1) % {k} AS INTEGER)"


@query(f"SELECT sample_id, true_label, {_fold_sql('20260531', 5)} AS fold_index FROM ({_FOLDED})")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified(_samples(spark, sf_dir)).select("sample_id", "true_label", "fold_index")


_REPEATED = f"SELECT sample_id, true_label, CAST(r AS INTEGER) AS repeat_index, 20260531 + r * 1000003 AS random_seed, {_fold_sql('20260531 + r * 1000003', 5, 'r, true_label')} AS fold_index FROM ({_FOLDED}), range(5) AS t(r)"


@query(_REPEATED)
def repeated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.repeated_stratified(_samples(spark, sf_dir)).select("sample_id", "true_label", "repeat_index", "random_seed", "fold_index")


@query("WITH s AS (SELECT vec_id AS sample_id, CAST(vec_id % 2 AS INTEGER) AS true_label, CASE WHEN vec_id % 13 = 0 THEN 0 ELSE CAST(label AS INTEGER) END AS spatial_cluster_id FROM embeddings), d AS (SELECT spatial_cluster_id, CAST((row_number() OVER (ORDER BY spatial_cluster_id) - 1) % 3 AS INTEGER) AS fold_index FROM (SELECT DISTINCT spatial_cluster_id FROM s)) SELECT sample_id, true_label, spatial_cluster_id, fold_index FROM s JOIN d USING (spatial_cluster_id)")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings")
    s = e.select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 2).cast("int").alias("true_label"))
    clusters = e.where("vec_id % 13 <> 0").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("int").alias("spatial_cluster_id"))
    return folds.spatial_groups(s, clusters).select("sample_id", "true_label", "spatial_cluster_id", "fold_index")


@query(f"""WITH f AS ({_REPEATED}), o AS (SELECT repeat_index, fold_index, count(*) AS n_test, CAST(sum(true_label) AS BIGINT) AS n_test_pos FROM f GROUP BY ALL),
    a AS (SELECT *, CAST(sum(n_test) OVER w AS BIGINT) - n_test AS n_train, CAST(sum(n_test_pos) OVER w AS BIGINT) - n_test_pos AS n_train_pos, count(*) OVER w AS k FROM o WINDOW w AS (PARTITION BY repeat_index))
    SELECT repeat_index, fold_index, n_test, n_test_pos, n_train, n_train_pos, CAST(n_test_pos > 0 AND n_test_pos < n_test AND n_train_pos > 0 AND n_train_pos < n_train AND k = 5 AS INTEGER) AS is_valid FROM a""")
def fold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.validation(folds.repeated_stratified(_samples(spark, sf_dir)), 5)


@query(f"SELECT sample_id, CAST(f AS INTEGER) AS fold_index, CASE WHEN own = f THEN 'test' ELSE 'train' END AS split_role FROM (SELECT sample_id, {_fold_sql('20260531', 5)} AS own FROM ({_FOLDED})), range(5) AS t(f)")
def fold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.assignments(folds.stratified(_samples(spark, sf_dir)), 5).select("sample_id", "fold_index", "split_role")


# Preprocessing


_FILLED = f"WITH {B.LONG_SQL}, med AS (SELECT fold_index, feature, coalesce(median(CASE WHEN is_train = 1 THEN raw END), 0) AS m FROM rows GROUP BY ALL), filled AS (SELECT fold_index, sample_id, feature, true_label, is_train, coalesce(raw, m) AS value FROM rows JOIN med USING (fold_index, feature))"


@query(f"{_FILLED} SELECT fold_index, sample_id, feature, round(value, 6) AS value FROM filled")
def fold_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.imputed(B.long_rows(spark, sf_dir)).select("fold_index", "sample_id", "feature", "value"))


@query(f"{_FILLED}, st AS (SELECT fold_index, feature, avg(CASE WHEN is_train = 1 THEN value END) AS mean, greatest(coalesce(stddev_samp(CASE WHEN is_train = 1 THEN value END), 0), 1e-8) AS sd FROM filled GROUP BY ALL) SELECT fold_index, sample_id, feature, round((value - mean) / sd, 6) AS value FROM filled JOIN st USING (fold_index, feature)")
def fold_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.scaled(preprocess.imputed(B.long_rows(spark, sf_dir))).select("fold_index", "sample_id", "feature", "value"))


@query(f"WITH {B.LONG_SQL} SELECT fold_index, round(CASE WHEN sum(CASE WHEN is_train = 1 THEN true_label END) > 0 AND sum(CASE WHEN is_train = 1 THEN 1 - true_label END) > 0 THEN greatest(sum(CASE WHEN is_train = 1 THEN 1 - true_label END) / sum(CASE WHEN is_train = 1 THEN true_label END), 1) ELSE 1 END, 6) AS class_weight_pos FROM rows WHERE feature = 'e1' GROUP BY 1")
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.class_weights(B.long_rows(spark, sf_dir).where("feature = 'e1'")))


@query(f"WITH {B.LONG_SQL} SELECT fold_index, CASE WHEN sum(CASE WHEN is_train = 1 THEN 1 - true_label END) >= sum(CASE WHEN is_train = 1 THEN true_label END) THEN 0.0::DOUBLE ELSE 1.0 END AS p_majority, round(avg(CASE WHEN is_train = 1 THEN true_label END), 6) AS p_stratified FROM rows WHERE feature = 'e1' GROUP BY 1")
def dummy_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.dummies(B.long_rows(spark, sf_dir).where("feature = 'e1'"), ["fold_index"]))


# Metrics


KEYS = ["run_id", "fold_index"]
_P = f"WITH {B.PREDICTIONS_SQL}"


@query(f"""{_P}, t AS (SELECT run_id, fold_index, p, sum(y) AS tp, sum(1 - y) AS fp FROM predictions GROUP BY ALL), c AS (SELECT *, coalesce(sum(tp) OVER (PARTITION BY run_id, fold_index ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
    SELECT run_id, fold_index, round(CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (before + tp / 2)) / (sum(tp) * sum(fp)) ELSE 0.5 END, 6) AS roc_auc FROM c GROUP BY ALL""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(B.predictions(spark, sf_dir), KEYS))


@query(f"""{_P}, o AS (SELECT run_id, fold_index, y, row_number() OVER w AS n, sum(y) OVER w AS tp, sum(y) OVER (PARTITION BY run_id, fold_index) AS pos FROM predictions WINDOW w AS (PARTITION BY run_id, fold_index ORDER BY p DESC, y, l_orderkey, l_linenumber, sample_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT run_id, fold_index, pos, y, tp / n AS prec, lag(tp / n, 1, 1.0) OVER (PARTITION BY run_id, fold_index ORDER BY n) AS before FROM o)
    SELECT run_id, fold_index, round(CASE WHEN max(pos) > 0 THEN sum(y * (prec + before) / 2) / max(pos) ELSE 0 END, 6) AS pr_auc FROM s GROUP BY ALL""")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pr_auc(B.predictions(spark, sf_dir), KEYS))


def _count(when: str) -> str:
    return f"count(*) FILTER (WHERE {when})"


_CONFUSION = f"{_P}, c AS (SELECT run_id, fold_index, {_count('p >= 0.5 AND y = 1')} AS tp, {_count('p < 0.5 AND y = 0')} AS tn, {_count('p >= 0.5 AND y = 0')} AS fp, {_count('p < 0.5 AND y = 1')} AS fn FROM predictions GROUP BY ALL)"
_RATES = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision"


@query(f"{_CONFUSION} SELECT * FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(B.predictions(spark, sf_dir), KEYS)


@query(f"""{_CONFUSION}, r AS (SELECT *, {_RATES} FROM c) SELECT run_id, fold_index, tp, tn, fp, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round((sensitivity + specificity) / 2, 6) AS balanced_accuracy,
    round(CASE WHEN precision + sensitivity > 0 THEN 2 * precision * sensitivity / (precision + sensitivity) ELSE 0 END, 6) AS f1_score, round(CASE WHEN 4 * precision + sensitivity > 0 THEN 5 * precision * sensitivity / (4 * precision + sensitivity) ELSE 0 END, 6) AS f2_score FROM r""")
def point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.point_metrics(B.predictions(spark, sf_dir), KEYS))


@query(f"{_P} SELECT run_id, fold_index, round(avg((y - p) * (y - p)), 6) AS brier_score FROM predictions GROUP BY ALL")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.brier(B.predictions(spark, sf_dir), KEYS))


_SIGMOID = "CASE WHEN {0} > 30 THEN 1 - 1e-15 WHEN {0} < -30 THEN 1e-15 ELSE 1 / (1 + exp(-({0}))) END"


def _descent(x: str, steps: int, rate: float) -> str:
    z = "slope * x + intercept"
    return f"""WITH RECURSIVE {B.PREDICTIONS_SQL}, cells AS (SELECT run_id, {x} AS x, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS s FROM predictions GROUP BY ALL), n AS (SELECT run_id, sum(w) AS n FROM cells GROUP BY 1),
    d AS (SELECT 0 AS step, run_id, 1.0::DOUBLE AS slope, 0.0::DOUBLE AS intercept FROM n
      UNION ALL SELECT any_value(step) + 1, d.run_id, any_value(slope) - {rate} * sum((w * {_SIGMOID.format(z)} - s) * x) / any_value(n), any_value(intercept) - {rate} * sum(w * {_SIGMOID.format(z)} - s) / any_value(n)
      FROM d JOIN cells USING (run_id) JOIN n USING (run_id) WHERE step < {steps} GROUP BY d.run_id)"""


@query(f"{_descent('ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))', 1000, 0.05)} SELECT run_id, round(slope, 5) AS calibration_slope, round(intercept, 5) AS calibration_intercept FROM d WHERE step = 1000")
def calibration_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration(B.predictions(spark, sf_dir), ["run_id"]), 5)


@query(f"{_descent('p', 500, 0.01)} SELECT run_id, round(slope, 5) AS platt_slope, round(intercept, 5) AS platt_intercept FROM d WHERE step = 500")
def platt_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.platt(B.predictions(spark, sf_dir), ["run_id"]), 5)


@query(f"""{_P}, o AS (SELECT run_id, y, p, row_number() OVER (PARTITION BY run_id ORDER BY p, y) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM predictions),
    b AS (SELECT run_id, least(9, i // greatest(1, n // 10)) AS bin, count(*) AS n, sum(y) AS o, sum(p) AS e FROM o GROUP BY ALL)
    SELECT run_id, round(sum(CASE WHEN e / n > 0 AND e / n < 1 THEN (o - e) * (o - e) / (e * (1 - e / n)) ELSE 0 END), 4) AS hl_statistic FROM b GROUP BY 1""")
def hosmer_lemeshow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.hosmer_lemeshow(B.predictions(spark, sf_dir), ["run_id"]), 4)


_SWEEP = f"""{_P}, g AS (SELECT run_id, p, sum(y) AS p1, sum(1 - y) AS p0 FROM predictions GROUP BY ALL),
    k AS (SELECT run_id, c / 100 AS probability_cutoff, CAST(coalesce(sum(p1) FILTER (WHERE p >= c / 100), 0) AS BIGINT) AS tp, CAST(coalesce(sum(p0) FILTER (WHERE p >= c / 100), 0) AS BIGINT) AS fp, CAST(coalesce(sum(p1) FILTER (WHERE p < c / 100), 0) AS BIGINT) AS fn,
      CAST(coalesce(sum(p0) FILTER (WHERE p < c / 100), 0) AS BIGINT) AS tn FROM g, range(1, 100) AS t(c) GROUP BY ALL), r AS (SELECT *, {_RATES} FROM k),
    sweep AS (SELECT run_id, probability_cutoff, sensitivity, specificity, precision, CASE WHEN precision + sensitivity > 0 THEN 2 * precision * sensitivity / (precision + sensitivity) ELSE 0 END AS f1_score,
      CASE WHEN 4 * precision + sensitivity > 0 THEN 5 * precision * sensitivity / (4 * precision + sensitivity) ELSE 0 END AS f2_score, fn AS false_negatives_count, fp AS false_positives_count FROM r)"""
_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("sensitivity", "specificity", "precision", "f1_score", "f2_score"))


@query(f"{_SWEEP} SELECT run_id, probability_cutoff, {_R6}, false_negatives_count, false_positives_count FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_sweep(B.predictions(spark, sf_dir), ["run_id"]))


def _rule(name: str, order: str, where: str = "true") -> str:
    return f"SELECT run_id, {name} AS threshold_rule, probability_cutoff, sensitivity, specificity, precision, f2_score FROM sweep WHERE {where} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {order} DESC, probability_cutoff DESC) = 1"


_ENOUGH = "run_id IN (SELECT run_id FROM sweep WHERE sensitivity >= 0.9)"


@query(f"""{_SWEEP}, chosen AS ({_rule("'max_F2'", 'f2_score')} UNION ALL {_rule("'sens_ge_0.90'", 'specificity', 'sensitivity >= 0.9')} UNION ALL {_rule("'best_sensitivity_available'", 'sensitivity', 'NOT ' + _ENOUGH)} UNION ALL {_rule("'youden_index'", '(sensitivity + specificity - 1)')})
    SELECT run_id, threshold_rule, probability_cutoff, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f2_score, 6) AS f2_score FROM chosen""")
def operational_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.operational_thresholds(metrics.threshold_sweep(B.predictions(spark, sf_dir), ["run_id"]), ["run_id"]))


def _reliability(bins: int) -> str:
    return f"""{_P} SELECT run_id, CAST(least({bins}, greatest(1, ceil(p * {bins}))) AS INTEGER) AS bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed, count(*) AS n, round(sqrt(avg(y) * (1 - avg(y)) / count(*)), 6) AS se FROM predictions GROUP BY ALL HAVING count(*) >= 3"""


@query(_reliability(8))
def reliability_bins_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.reliability(B.predictions(spark, sf_dir), ["run_id"], 8))


@query(_reliability(10))
def reliability_bins_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.reliability(B.predictions(spark, sf_dir), ["run_id"], 10))


# Reports


_MEANS = ("mean_roc_auc", "mean_pr_auc", "mean_bal_acc", "mean_recall", "mean_spec", "mean_f1", "mean_f2", "mean_brier", "min_pr_auc", "max_pr_auc")
_PERF = "run_id, target_contaminant, predictor_tier, algorithm, cv_mode, n_folds, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEANS)


@query(f"WITH {B.PERFORMANCE_SQL} SELECT {_PERF} FROM performance")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.performance(B.store(spark, sf_dir)))


@query(f"WITH {B.STORE_SQL} SELECT run_id, target_contaminant, predictor_tier, algorithm, cv_mode, repeat_index, fold_index, round(pr_auc, 6) AS pr_auc, round(brier_score, 6) AS brier_score, CAST(n_test_pos AS BIGINT) AS n_test_pos, CAST(n_test_neg AS BIGINT) AS n_test_neg FROM fold_metrics JOIN model_runs USING (run_id)")
def fold_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.fold_metrics_long(B.store(spark, sf_dir)).select(*reports.RUN, "repeat_index", "fold_index", "pr_auc", "brier_score", "n_test_pos", "n_test_neg"))


@query(f"WITH {B.STORE_SQL} SELECT p.run_id, r.target_contaminant, r.algorithm, r.cv_mode, y AS true_label, p AS predicted_probability FROM predictions p JOIN model_runs r USING (run_id)")
def calibration_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.calibration_inputs(B.store(spark, sf_dir))


_LEVEL = lambda c, names: f"nullif(list_position({list(names)}, {c}), 0)::INTEGER"


@query(f"WITH {B.PERFORMANCE_SQL} SELECT {_PERF}, CASE WHEN regexp_matches(algorithm, '^Dummy') THEN 'Baseline' ELSE 'Model' END AS model_class, {_LEVEL('target_contaminant', C.TARGETS)} AS target_level, {_LEVEL('predictor_tier', (*C.TIERS, *C.VARIANT_TIERS))} AS tier_level, {_LEVEL('cv_mode', C.CV_MODES)} AS cv_level FROM performance")
def performance_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.performance_figure(B.store(spark, sf_dir)))


@query("SELECT l_returnflag, l_linestatus, l_shipdate < TIMESTAMP '1992-01-03' AS early, round(CASE WHEN count(*) < 2 OR abs(regr_sxx(l_extendedprice, l_quantity)) < 1e-10 THEN 1 ELSE regr_slope(l_extendedprice, l_quantity) END, 4) AS slope, round(CASE WHEN count(*) < 2 OR abs(regr_sxx(l_extendedprice, l_quantity)) < 1e-10 THEN 0 ELSE regr_intercept(l_extendedprice, l_quantity) END, 3) AS intercept FROM lineitem GROUP BY ALL")
def regression_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem").withColumn("early", F.col("l_shipdate") < F.lit("1992-01-03").cast("timestamp"))
    return reports.regression_lines(li, ["l_returnflag", "l_linestatus", "early"], "l_quantity", "l_extendedprice").withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 3)})


@query(f"SELECT doc_id, t AS target_contaminant FROM documents, unnest({list(C.TARGETS)}) AS u(t) WHERE contains(text, t)")
def outline_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outline_targets(B.table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {B.PERFORMANCE_SQL} SELECT {_PERF} FROM best")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.best_run(B.store(spark, sf_dir)))


@query(f"WITH {B.PERFORMANCE_SQL} SELECT {_PERF} FROM performance WHERE algorithm NOT ILIKE 'Dummy%' QUALIFY row_number() OVER (PARTITION BY target_contaminant, cv_mode ORDER BY mean_pr_auc DESC, run_id) = 1")
def best_per_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.best_per_mode(B.store(spark, sf_dir)))


_SCREENING = "sample_id, target_contaminant, best_validated_run_id, round(median, 6) AS predicted_probability_median, round(lower, 6) AS predicted_probability_lower_ci, round(upper, 6) AS predicted_probability_upper_ci, class AS screening_priority_class"
_REASON = "CASE class WHEN 'Very_High' THEN 'Urgent confirmatory laboratory testing recommended' WHEN 'High' THEN 'Confirmatory testing recommended' WHEN 'Moderate' THEN 'Monitor or retest seasonally' ELSE 'Lower immediate priority; routine monitoring' END AS priority_reason"


@query(f"WITH {B.PRIORITY_SQL} SELECT {_SCREENING}, {_REASON} FROM classed")
def screening_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.screening_priority(B.store(spark, sf_dir)))


def _prioritised(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = B.store(spark, sf_dir)
    return t | {"screening_priority": reports.screening_priority(t)}


_PLACED = "predicted_probability_median, predicted_probability_lower_ci, predicted_probability_upper_ci, screening_priority_class, priority_reason, best_validated_run_id"


@query(f"WITH {B.PRIORITY_SQL}, s AS (SELECT {_SCREENING}, {_REASON} FROM classed) SELECT sample_id, target_contaminant, {_PLACED}, round(latitude, 6) AS latitude, longitude FROM s LEFT JOIN places USING (sample_id)")
def priority_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.priority_table(_prioritised(spark, sf_dir)))


@query(f"WITH {B.PRIORITY_SQL} SELECT sample_id, target_contaminant, class AS screening_priority_class, round(latitude, 6) AS latitude, longitude FROM classed JOIN places USING (sample_id)")
def priority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.priority_map(_prioritised(spark, sf_dir)))


@query(f"""WITH {B.PRIORITY_SQL}, g AS (SELECT sample_id, string_agg(target_contaminant || ':' || coalesce(class, 'NA'), '|' ORDER BY target_contaminant) AS targets_classes, max(median) AS max_probability FROM classed GROUP BY 1)
    SELECT g.sample_id, longitude, round(latitude, 6) AS latitude, targets_classes, round(max_probability, 6) AS max_probability, {B._CLASS.format('max_probability')} AS overall_priority, location FROM g LEFT JOIN places USING (sample_id)""")
def priority_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.priority_points(_prioritised(spark, sf_dir)))


@query(f"WITH {B.PRIORITY_SQL} SELECT sample_id, target_contaminant, round(median, 6) AS predicted_probability_median, class AS screening_priority_class, longitude, round(latitude, 6) AS latitude, CAST(spatial_cluster_id AS DOUBLE) AS spatial_cluster_id FROM classed LEFT JOIN places USING (sample_id)")
def target_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.target_probabilities(_prioritised(spark, sf_dir)).withColumn("spatial_cluster_id", F.col("spatial_cluster_id").cast("double")))


@query(f"WITH {B.PRIORITY_SQL}, e AS (SELECT * FROM classed QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY median DESC, target_contaminant) = 1) SELECT sample_id, target_contaminant, round(median, 6) AS predicted_probability_median FROM e ORDER BY median DESC, sample_id LIMIT 8")
def labelled_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.labelled_wells(_prioritised(spark, sf_dir)).select("sample_id", "target_contaminant", "predicted_probability_median"))


_PENALTY = f"""WITH {B.STORE_SQL}, m AS (SELECT * FROM fold_metrics JOIN model_runs USING (run_id) WHERE algorithm NOT ILIKE 'Dummy%'),
    g AS (SELECT target_contaminant, predictor_tier, algorithm, {', '.join(f"avg(pr_auc) FILTER (WHERE cv_mode = '{m}') AS mean_{n}, stddev_samp(pr_auc) FILTER (WHERE cv_mode = '{m}') / sqrt(count(pr_auc) FILTER (WHERE cv_mode = '{m}')) AS se_{n}" for m, n in (('Stratified_Nested_CV', 'stratified'), ('Spatial_Group_CV', 'spatial')))} FROM m GROUP BY ALL)"""
_PENALTY_COLUMNS = "target_contaminant, predictor_tier, algorithm, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_stratified", "se_stratified", "mean_spatial", "se_spatial")) + ", round(mean_stratified - mean_spatial, 6) AS penalty"


@query(f"{_PENALTY} SELECT {_PENALTY_COLUMNS} FROM g")
def spatial_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.spatial_penalty(B.store(spark, sf_dir)))


@query(f"{_PENALTY} SELECT {_PENALTY_COLUMNS} FROM g WHERE mean_stratified - mean_spatial IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target_contaminant ORDER BY mean_stratified - mean_spatial DESC, predictor_tier, algorithm) = 1")
def worst_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.worst_penalty(B.store(spark, sf_dir)))


@query(f"WITH {B.STORE_SQL} SELECT target_contaminant, predictor_tier, algorithm, cv_mode, round(avg(pr_auc), 6) AS mean_pr_auc FROM fold_metrics JOIN model_runs USING (run_id) WHERE algorithm NOT ILIKE 'Dummy%' GROUP BY ALL")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.heat_map(B.store(spark, sf_dir)))


@query(f"WITH {B.STORE_SQL}, g AS (SELECT target_contaminant, algorithm, predictor_tier, avg(pr_auc) AS m FROM fold_metrics JOIN model_runs USING (run_id) GROUP BY ALL) SELECT target_contaminant, algorithm, predictor_tier, round(m, 6) AS mean_pr_auc, round(100 * m / max(CASE WHEN predictor_tier = 'Tier3_Full' THEN m END) OVER (PARTITION BY target_contaminant, algorithm), 1) AS percent_retained FROM g")
def tier_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.tier_retention(B.store(spark, sf_dir)))


@query(f"WITH {B.STORE_SQL}, s AS (SELECT target_contaminant AS target, predictor_tier AS tier, algorithm, 3 + (repeat_index * 3 + fold_index) % 6 AS k, pr_auc AS score FROM fold_metrics JOIN model_runs USING (run_id)), w AS (SELECT target, tier, algorithm, " + ", ".join(f"avg(CASE WHEN k = {k} THEN score END) AS k{k}" for k in range(3, 9)) + " FROM s GROUP BY ALL) SELECT target, tier, algorithm, " + ", ".join(f"round(k{k}, 4) AS k{k}" for k in range(3, 9)) + ", round(greatest(k3, k4, k5, k6, k7, k8) - least(k3, k4, k5, k6, k7, k8), 4) AS score_range FROM w")
def k_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.with_run(B.store(spark, sf_dir), "fold_metrics")
    scores = m.select(F.col("target_contaminant").alias("target"), F.col("predictor_tier").alias("tier"), "algorithm", (3 + (F.col("repeat_index") * 3 + F.col("fold_index")) % 6).alias("k"), F.col("pr_auc").alias("score"))
    return resample.k_sensitivity(scores)


_MEAN_ABS = f"WITH {B.STORE_SQL}, g AS (SELECT run_id, feature_name, avg(abs(shap_value)) AS mean_abs FROM shap_values GROUP BY ALL)"


@query(f"{_MEAN_ABS} SELECT run_id, feature_name, round(mean_abs, 6) AS mean_abs, CAST(rank() OVER (PARTITION BY run_id ORDER BY mean_abs DESC) AS INTEGER) AS rank FROM g QUALIFY rank() OVER (PARTITION BY run_id ORDER BY mean_abs DESC) <= 3")
def topk_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.top_features(B.store(spark, sf_dir)["shap_values"], ["run_id"], 3))


@query(f"{_MEAN_ABS} SELECT run_id, feature_name, round(mean_abs, 6) AS mean_abs, CAST(row_number() OVER (PARTITION BY run_id ORDER BY mean_abs DESC, feature_name) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY mean_abs DESC, feature_name) <= 4")
def topk_no_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.top_features(B.store(spark, sf_dir)["shap_values"], ["run_id"], 4, ties=False))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranks.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).drop("rank")


@query(f"{_SWEEP}, j AS (SELECT * FROM sweep JOIN (SELECT DISTINCT run_id, target_contaminant, algorithm, cv_mode FROM predictions) USING (run_id)) SELECT run_id, probability_cutoff, m AS metric, round(CASE m WHEN 'sensitivity' THEN sensitivity WHEN 'specificity' THEN specificity ELSE f2_score END, 6) AS value FROM j, unnest(['sensitivity', 'specificity', 'f2_score']) AS t(m)")
def threshold_curves_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.threshold_sweep(B.predictions(spark, sf_dir), ["run_id"])
    return rounded(s.select("run_id", "probability_cutoff", "sensitivity", "specificity", "f2_score").unpivot(["run_id", "probability_cutoff"], ["sensitivity", "specificity", "f2_score"], "metric", "value"))


_RUN = "target_contaminant, predictor_tier, algorithm, cv_mode"


@query(f"WITH {B.STORE_SQL} SELECT run_id, sample_id, {_RUN}, repeat_index, fold_index, y AS true_label, p AS predicted_probability FROM predictions")
def out_of_fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.out_of_fold(B.store(spark, sf_dir)).drop("l_tax", "l_linenumber", "l_orderkey")


@query(f"WITH {B.STORE_SQL} SELECT run_id, sample_id, {_RUN}, repeat_index, fold_index, feature_name, round(shap_value, 6) AS shap_value, feature_cleaned_value FROM shap_values JOIN model_runs USING (run_id)")
def attributions_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.attributions_long(B.store(spark, sf_dir)))


_RULES = f"""chosen AS ({_rule("'max_F2'", 'f2_score')} UNION ALL {_rule("'sens_ge_0.90'", 'specificity', 'sensitivity >= 0.9')} UNION ALL {_rule("'best_sensitivity_available'", 'sensitivity', 'NOT ' + _ENOUGH)} UNION ALL {_rule("'youden_index'", '(sensitivity + specificity - 1)')}),
    own AS (SELECT DISTINCT run_id, {_RUN} FROM predictions),
    stored AS (SELECT own.*, threshold_rule AS threshold_selection_rule, c.probability_cutoff AS optimized_probability_cutoff, c.sensitivity AS resulting_sensitivity, c.specificity AS resulting_specificity, false_negatives_count, false_positives_count
      FROM chosen c JOIN sweep s USING (run_id, probability_cutoff) JOIN own USING (run_id))"""


def _with_thresholds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    keys = ["run_id", "cv_mode"]
    sweep = metrics.threshold_sweep(B.predictions(spark, sf_dir), keys)
    chosen = metrics.operational_thresholds(sweep, keys).join(sweep.select(*keys, "probability_cutoff", "false_negatives_count", "false_positives_count"), [*keys, "probability_cutoff"])
    names = {"threshold_rule": "threshold_selection_rule", "probability_cutoff": "optimized_probability_cutoff", "sensitivity": "resulting_sensitivity", "specificity": "resulting_specificity"}
    return B.store(spark, sf_dir) | {"threshold_sensitivity": sweep, "operational_thresholds": chosen.withColumnsRenamed(names)}


@query(f"{_SWEEP}, {_RULES} SELECT run_id, {_RUN}, threshold_selection_rule, optimized_probability_cutoff, round(resulting_sensitivity, 6) AS resulting_sensitivity, round(resulting_specificity, 6) AS resulting_specificity, false_negatives_count, false_positives_count FROM stored")
def operational_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.operational(_with_thresholds(spark, sf_dir)))


@query(f"{_SWEEP}, {_RULES} SELECT target_contaminant, algorithm, cv_mode, threshold_selection_rule, round(optimized_probability_cutoff, 3) AS optimized_probability_cutoff, round(resulting_sensitivity, 3) AS resulting_sensitivity, round(resulting_specificity, 3) AS resulting_specificity, false_negatives_count, false_positives_count FROM stored")
def operational_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.operational_rounded(_with_thresholds(spark, sf_dir))


@query(f"{_SWEEP} SELECT run_id, target_contaminant, algorithm, cv_mode, probability_cutoff, {_R6}, false_negatives_count, false_positives_count FROM sweep JOIN (SELECT DISTINCT run_id, {_RUN} FROM predictions) USING (run_id)")
def sensitivity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.sensitivity(_with_thresholds(spark, sf_dir)))


@query(f"{_SWEEP} SELECT target_contaminant, algorithm, cv_mode, probability_cutoff, m AS metric, round(CASE m WHEN 'sensitivity' THEN sensitivity WHEN 'specificity' THEN specificity ELSE f2_score END, 6) AS value FROM sweep JOIN (SELECT DISTINCT run_id, {_RUN} FROM predictions) USING (run_id), unnest(['sensitivity', 'specificity', 'f2_score']) AS t(m)")
def curves_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.curves_long(_with_thresholds(spark, sf_dir)))


@query(f"""{_SWEEP}, {_RULES}, b AS (SELECT * FROM stored WHERE algorithm NOT ILIKE 'Dummy%' QUALIFY row_number() OVER (PARTITION BY target_contaminant ORDER BY false_negatives_count, false_positives_count, run_id, threshold_selection_rule) = 1),
    w AS (SELECT target_contaminant, run_id, greatest(0, CAST(round(false_negatives_count / greatest(1 - resulting_sensitivity, 1e-6)) AS BIGINT) - false_negatives_count) AS tp,
      greatest(0, CAST(round(false_positives_count / greatest(1 - resulting_specificity, 1e-6)) AS BIGINT) - false_positives_count) AS tn, false_positives_count AS fp, false_negatives_count AS fn FROM b)
    SELECT target_contaminant, run_id, c AS cell, CAST(CASE c WHEN 'tp' THEN tp WHEN 'tn' THEN tn WHEN 'fp' THEN fp ELSE fn END AS BIGINT) AS n FROM w, unnest(['tp', 'tn', 'fp', 'fn']) AS t(c)""")
def best_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_confusion(_with_thresholds(spark, sf_dir))


@query(f"WITH {B.PERFORMANCE_SQL} SELECT run_id, {_RUN}, " + ", ".join(f"round({c}, 3) AS {c}" for c in _MEANS if c.startswith("mean_")) + ", n_folds FROM performance")
def performance_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.performance_rounded(B.store(spark, sf_dir))


@query(f"WITH {B.PERFORMANCE_SQL} SELECT target_contaminant, CAST(least(10, greatest(1, ceil(p * 10))) AS INTEGER) AS bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed, count(*) AS n, round(sqrt(avg(y) * (1 - avg(y)) / count(*)), 6) AS se FROM predictions SEMI JOIN best USING (run_id) GROUP BY ALL")
def reliability_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.reliability_of_best(B.store(spark, sf_dir)))


@query(f"WITH {B.PERFORMANCE_SQL}, g AS (SELECT target_contaminant, feature_name, avg(abs(shap_value)) AS mean_abs FROM shap_values JOIN best USING (run_id) GROUP BY ALL) SELECT target_contaminant, feature_name, round(mean_abs, 6) AS mean_abs, CAST(row_number() OVER w AS INTEGER) AS rank FROM g WINDOW w AS (PARTITION BY target_contaminant ORDER BY mean_abs DESC, feature_name) QUALIFY row_number() OVER w <= 6")
def features_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.features_of_best(B.store(spark, sf_dir)))


@query(f"WITH {B.STORE_SQL}, h AS (SELECT DISTINCT run_id, repeat_index, fold_index, 'C' AS hyperparameter_name, CASE WHEN pr_auc > 0.5 THEN '1' ELSE '0.1' END AS hyperparameter_value FROM fold_metrics) SELECT {_RUN}, hyperparameter_name, hyperparameter_value, count(*) AS n_folds FROM h JOIN model_runs USING (run_id) GROUP BY ALL")
def hyperparameters_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.store(spark, sf_dir)
    chosen = t["fold_metrics"].select("run_id", "repeat_index", "fold_index", F.lit("C").alias("hyperparameter_name"), F.when(F.col("pr_auc") > 0.5, "1").otherwise("0.1").alias("hyperparameter_value"))
    return reports.hyperparameters(t | {"model_hyperparameters": chosen})


@query(f"WITH {_leakage_sql()} SELECT target_contaminant, tier_name || coalesce('_' || variant, '') AS tier_name, feature_name, CASE WHEN reason IS NULL THEN 'included' ELSE 'excluded' END AS action, reason, 'leakage_rules' AS rule_source FROM audited WHERE variant IS NULL OR tier_name = 'Tier2_Reduced'")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.leakage_audit({"leakage_rules_applied": leakage.stored(_audited(spark, sf_dir))})


@query(f"WITH {_leakage_sql()} SELECT DISTINCT target_contaminant, tier_name || coalesce('_' || variant, '') AS tier_name, feature_name FROM audited WHERE reason IS NULL AND (variant IS NULL OR tier_name = 'Tier2_Reduced')")
def retained_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retained_features({"leakage_rules_applied": leakage.stored(_audited(spark, sf_dir))})


_SPEARMAN = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _SPEARMAN) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS rho FROM r" for i, a in enumerate(_SPEARMAN) for b in _SPEARMAN[i:]))
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.spearman(B.table(spark, sf_dir, "lineitem"), _SPEARMAN), 5)


@query("SELECT CAST(c_nationkey AS INTEGER) AS spatial_cluster_id, count(*) AS n, string_agg('s' || c_custkey, '; ' ORDER BY 's' || c_custkey) AS members FROM customer GROUP BY 1")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = B.store(spark, sf_dir)["sample_spatial_assignment"].withColumn("latitude", F.col("latitude"))
    sizes = places.groupBy("spatial_cluster_id").agg(F.count("*").alias("n"))
    return reports.cluster_members({"sample_spatial_assignment": places, "spatial_cluster_metadata": sizes})


@query(f"WITH {B.STORE_SQL} SELECT DISTINCT run_id, target_contaminant, predictor_tier, algorithm, cv_mode FROM model_runs")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.store(spark, sf_dir)["model_runs"]


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p >= 0.75 THEN 'Very_High' WHEN p >= 0.5 THEN 'High' WHEN p >= 0.25 THEN 'Moderate' ELSE 'Low' END AS class, round(ln(greatest(1e-12, least(1 - 1e-12, p)) / (1 - greatest(1e-12, least(1 - 1e-12, p)))), 5) AS logit_p, round(1 / (1 + exp(-(l_quantity - 25))), 6) AS sigmoid_q FROM (SELECT *, l_discount * 10 AS p FROM lineitem)")
def priority_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_discount") * 10)
    return li.select("l_orderkey", "l_linenumber", S.priority_class(F.col("p")).alias("class"), F.round(S.logit(F.col("p")), 5).alias("logit_p"), F.round(S.sigmoid(F.col("l_quantity") - 25), 6).alias("sigmoid_q"))


# Space


_HAVERSINE = "6371 * 2 * atan2(sqrt(h), sqrt(1 - h))"
_H = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"


@query(f"WITH {B.POINTS_SQL}, c AS (SELECT spatial_cluster_id, avg(lat) AS lat, avg(lon) AS lon FROM points GROUP BY 1) SELECT sample_id, round({_HAVERSINE}, 4) AS km FROM (SELECT a.sample_id, {_H} AS h FROM points a JOIN c b USING (spatial_cluster_id))")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.points(spark, sf_dir)
    c = p.groupBy("spatial_cluster_id").agg(F.avg("lat").alias("lat_b"), F.avg("lon").alias("lon_b"))
    return p.join(c, "spatial_cluster_id").select("sample_id", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")), 4).alias("km"))


@query(f"WITH {B.POINTS_SQL}, d AS (SELECT spatial_cluster_id, max({_HAVERSINE}) AS km FROM (SELECT a.spatial_cluster_id, {_H} AS h FROM points a JOIN points b USING (spatial_cluster_id)) GROUP BY 1) SELECT spatial_cluster_id, count(*) AS n_samples, round(avg(lat), 6) AS centroid_lat, round(avg(lon), 6) AS centroid_lon, round(any_value(km), 4) AS max_intra_cluster_distance_km FROM points JOIN d USING (spatial_cluster_id) GROUP BY 1")
def cluster_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spatial.metadata(B.points(spark, sf_dir))
    return m.select("spatial_cluster_id", "n_samples", F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon"), F.round("max_intra_cluster_distance_km", 4).alias("max_intra_cluster_distance_km"))


@query()
def kmeans_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.kmeans(B.points(spark, sf_dir).drop("spatial_cluster_id"), 4)[0]


@query()
def choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(spatial.choose_k(B.points(spark, sf_dir)),)], "k int")


# Models


MODEL_KEYS = ["algorithm", "repeat_index", "fold_index"]


# All columns of the vectors, scaled by fold, with a constant at the end; a step of the descent is one aggregate over (fold, column).
_D = B.FEATURES
_LR = f"""long AS (SELECT CAST(f AS INTEGER) AS fold_index, CAST(vec_id AS VARCHAR) AS sample_id, CAST(label = 0 AS INTEGER) AS y, vec_id % 3 <> f AS train, j, CAST(embedding[j] AS DOUBLE) AS raw FROM embeddings, range(3) AS t(f), range(1, {_D + 1}) AS u(j)),
    st AS (SELECT fold_index, j, avg(raw) FILTER (WHERE train) AS mean, greatest(stddev_samp(raw) FILTER (WHERE train), 1e-8) AS sd FROM long GROUP BY ALL),
    wt AS (SELECT fold_index, count(*)::DOUBLE AS n, greatest(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 1) AS pos FROM long WHERE train AND j = 1 GROUP BY 1),
    z AS (SELECT fold_index, sample_id, any_value(y) AS y, any_value(train) AS train, list_append(list((raw - mean) / sd ORDER BY j), 1.0) AS x FROM long JOIN st USING (fold_index, j) GROUP BY fold_index, sample_id),
    zw AS (SELECT z.*, n, CASE WHEN y = 1 THEN pos ELSE 1 END AS w, sum(CASE WHEN y = 1 THEN pos ELSE 1 END) FILTER (WHERE train) OVER (PARTITION BY fold_index) AS total FROM z JOIN wt USING (fold_index)),
    d AS (SELECT 0 AS step, fold_index, [0.0::DOUBLE FOR j IN range({_D + 1})] AS beta FROM wt
      UNION ALL SELECT step + 1, fold_index, list(b ORDER BY j) FROM (
        SELECT any_value(step) AS step, fold_index, j, any_value(beta[j]) - 0.05 * (sum(e * x[j]) / any_value(total) + CASE WHEN j <= {_D} THEN any_value(beta[j]) / any_value(n) ELSE 0 END) AS b
        FROM (SELECT step, d.fold_index, beta, x, total, n, w * ({_SIGMOID.format('list_dot_product(x, beta)')} - y) AS e FROM d JOIN zw ON zw.fold_index = d.fold_index AND zw.train WHERE step < 1000), range(1, {_D + 2}) AS t(j) GROUP BY fold_index, j)
      GROUP BY step, fold_index),
    fitted AS (SELECT zw.fold_index, sample_id, y, {_SIGMOID.format('list_dot_product(x, beta)')} AS p FROM zw JOIN d USING (fold_index) WHERE step = 1000 AND NOT train)"""


@query(f"WITH RECURSIVE {_LR} SELECT 'LogisticRegression' AS algorithm, 0 AS repeat_index, fold_index, sample_id, y AS true_label, round(p, 5) AS predicted_probability, CAST(p >= 0.5 AS INTEGER) AS predicted_label, '' AS hyperparameters FROM fitted")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.predictions(B.tasks(spark, sf_dir, "LogisticRegression"), MODEL_KEYS), 5)


_EC = """x AS (SELECT CAST(f AS INTEGER) AS fold_index, CAST(vec_id AS VARCHAR) AS sample_id, CAST(label = 0 AS INTEGER) AS y, vec_id % 3 <> f AS train, CAST(embedding[1] AS DOUBLE) AS raw FROM embeddings, range(3) AS t(f)),
    st AS (SELECT fold_index, avg(raw) FILTER (WHERE train) AS mean, greatest(stddev_samp(raw) FILTER (WHERE train), 1e-8) AS sd, count(*) FILTER (WHERE train) AS n, greatest(count(*) FILTER (WHERE train AND y = 0) / count(*) FILTER (WHERE train AND y = 1), 1) AS pos FROM x GROUP BY 1),
    z AS (SELECT x.*, (raw - mean) / sd AS v, CASE WHEN y = 1 THEN pos ELSE 1 END AS w, n FROM x JOIN st USING (fold_index)), tot AS (SELECT fold_index, sum(w) AS total FROM z WHERE train GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_EC}, d AS (SELECT 0 AS step, fold_index, 0.0::DOUBLE AS slope, 0.0::DOUBLE AS intercept FROM st
      UNION ALL SELECT any_value(step) + 1, d.fold_index, any_value(slope) - 0.05 * (sum(w * ({_SIGMOID.format('slope * v + intercept')} - y) * v) / any_value(total) + any_value(slope) / any_value(z.n)), any_value(intercept) - 0.05 * sum(w * ({_SIGMOID.format('slope * v + intercept')} - y)) / any_value(total)
      FROM d JOIN z ON z.fold_index = d.fold_index AND z.train JOIN tot ON tot.fold_index = d.fold_index WHERE step < 1000 GROUP BY d.fold_index)
    SELECT z.fold_index, sample_id, y AS true_label, round({_SIGMOID.format('slope * v + intercept')}, 5) AS predicted_probability FROM z JOIN d USING (fold_index) WHERE step = 1000 AND NOT train""")
def ec_only_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = models.predictions(B.tasks(spark, sf_dir, "EcOnlyLogistic"), MODEL_KEYS)
    return p.select("fold_index", "sample_id", "true_label", F.round("predicted_probability", 5).alias("predicted_probability"))


@query()
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.predictions(B.tasks(spark, sf_dir, "RandomForest"), MODEL_KEYS)


@query()
def gradient_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.predictions(B.tasks(spark, sf_dir, "GradientBoostedTrees"), MODEL_KEYS)


@query()
def tuned_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.predictions(B.tasks(spark, sf_dir, "LogisticRegression"), MODEL_KEYS, tuned=True)


@query()
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.attributions(B.tasks(spark, sf_dir, "LogisticRegression", "RandomForest", "GradientBoostedTrees"), MODEL_KEYS), 9)


@query()
def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.feature_importances(B.tasks(spark, sf_dir, "LogisticRegression", "RandomForest", "GradientBoostedTrees"), MODEL_KEYS), 9)


@query()
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = models.predictions(B.tasks(spark, sf_dir, "DummyMajority", "DummyStratified", "LogisticRegression"), MODEL_KEYS)
    return metrics.all_metrics(p.select("algorithm", "fold_index", F.col("true_label").alias("y"), F.col("predicted_probability").alias("p")), ["algorithm", "fold_index"])


# Resampling: the draws are hashes, so SQL can draw the same.


DRAWS, SELECTION = resample.DRAWS, ["target", "tier", "algorithm"]
_BOOT = f"""WITH pr AS (SELECT 'quality' AS target, CASE WHEN doc_id % 3 = 0 THEN 'Tier1_Field' ELSE 'Tier2_Reduced' END AS tier, CASE WHEN doc_id % 2 = 0 THEN 'LogisticRegression' ELSE 'RandomForest' END AS algorithm,
      doc_id AS sample_id, CAST(r AS INTEGER) AS repeat_index, quality AS y, ((doc_id * 37 + r * 11) % 101) / 101 AS p FROM labels, range(2) AS t(r)),
    wells AS (SELECT target, tier, algorithm, sample_id, count(*) AS repeats, max(y) AS y, row_number() OVER (PARTITION BY target, tier, algorithm ORDER BY sample_id) - 1 AS pos, count(*) OVER (PARTITION BY target, tier, algorithm) AS n FROM pr GROUP BY target, tier, algorithm, sample_id),
    slots AS (SELECT target, tier, algorithm, draw, pos AS slot, ('0x' || substr(md5('well:' || draw || ':' || pos), 1, 8))::BIGINT % n AS at FROM wells, range({DRAWS}) AS t(draw)),
    drawn AS (SELECT s.target, s.tier, s.algorithm, draw, slot, w.sample_id, w.y, ('0x' || substr(md5('repeat:' || draw || ':' || slot), 1, 8))::BIGINT % repeats AS repeat_index FROM slots s JOIN wells w ON (s.target, s.tier, s.algorithm, s.at) = (w.target, w.tier, w.algorithm, w.pos)),
    d AS (SELECT drawn.target, drawn.tier, drawn.algorithm, draw, drawn.y, p FROM drawn JOIN pr USING (sample_id, repeat_index)), ok AS (SELECT * FROM d WHERE (target, tier, algorithm, draw) IN (SELECT (target, tier, algorithm, draw) FROM d GROUP BY target, tier, algorithm, draw HAVING min(y) < max(y))),
    t AS (SELECT target, tier, algorithm, draw, p, sum(y) AS tp, sum(1 - y) AS fp FROM ok GROUP BY ALL), u AS (SELECT *, sum(tp) OVER w AS a, sum(fp) OVER w AS f FROM t WINDOW w AS (PARTITION BY target, tier, algorithm, draw ORDER BY p DESC)),
    ap AS (SELECT target, tier, algorithm, draw, sum(tp * a / (a + f)) / sum(tp) AS average_precision, sum(fp * (a - tp + tp / 2)) / (sum(tp) * sum(fp)) AS roc_auc FROM u GROUP BY ALL),
    cm AS (SELECT target, tier, algorithm, draw, count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE y = 1) AS recall, count(*) FILTER (WHERE p >= 0.5 AND y = 1) / greatest(1, count(*) FILTER (WHERE p >= 0.5)) AS prec, avg((y - p) * (y - p)) AS brier_score FROM ok GROUP BY ALL),
    v AS (SELECT target, tier, algorithm, draw, average_precision, roc_auc, recall, CASE WHEN 4 * prec + recall > 0 THEN 5 * prec * recall / (4 * prec + recall) ELSE 0 END AS f2_score, brier_score FROM ap JOIN cm USING (target, tier, algorithm, draw))"""


@query(f"{_BOOT} " + " UNION ALL ".join(f"SELECT target, tier, algorithm, '{m}' AS metric, round(quantile_cont({m}, 0.5), 6) AS median, round(quantile_cont({m}, 0.025), 6) AS lower_ci, round(quantile_cont({m}, 0.975), 6) AS upper_ci FROM v GROUP BY target, tier, algorithm" for m in ("average_precision", "roc_auc", "recall", "f2_score", "brier_score")))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws of the method, for each selection; the wells are all labelled documents.  The calibration metrics of the same draws are ``bootstrap_calibration``."""
    return rounded(resample.intervals(resample.draw_counts(_labelled_predictions(spark, sf_dir), DRAWS, SELECTION), keys=SELECTION))


@query()
def bootstrap_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.calibration_intervals(resample.draw_counts(_labelled_predictions(spark, sf_dir), DRAWS, SELECTION), SELECTION))


def _labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = B.table(spark, sf_dir, "labels")
    tier, algorithm = F.when(F.col("doc_id") % 3 == 0, "Tier1_Field").otherwise("Tier2_Reduced"), F.when(F.col("doc_id") % 2 == 0, "LogisticRegression").otherwise("RandomForest")
    return lab.withColumn("repeat_index", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.lit("quality").alias("target"), tier.alias("tier"), algorithm.alias("algorithm"), F.col("doc_id").alias("sample_id"), "repeat_index", F.col("quality").alias("y"), (((F.col("doc_id") * 37 + F.col("repeat_index") * 11) % 101) / 101).alias("p"))


# Joins and the like on plain tables.


@query("SELECT n_name, r_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS mean_balance, count(DISTINCT c_mktsegment) AS n_segments FROM nation JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) >= 3")
def dimension_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (B.table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n_customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.countDistinct("c_mktsegment").alias("n_segments")).where("n_customers >= 3")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


