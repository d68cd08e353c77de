"""From wide text rows to measurements, labels and eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenmark import config as C
from fenmark.functions import scalars as S
from fenmark.operators.ranks import quantiles
from fenmark.operators.upsert import last_write_wins


def quoted(name: str) -> str:
    return f"`{name}`"


def with_index(df: DataFrame, id_col: str = "SampleID") -> DataFrame:
    """Rows with ``original_row_index`` in input order and an id; rows of a table without ids are ROW_0001, ...

    df is a scan: its partitions are the same each time, which those of a shuffle need not be.
    """
    out = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the input's partitions
    before = out.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    out = out.join(before, "_part").withColumn("original_row_index", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
    return out if id_col in df.columns else out.withColumn(id_col, F.format_string("ROW_%04d", F.col("original_row_index") + 1))


def raw_samples(rows: DataFrame, id_col: str = "SampleID") -> DataFrame:
    """(sample_id, original_row_index, raw_json): one per id, the last row."""
    data = [c for c in rows.columns if c != "original_row_index"]
    out = rows.select(F.col(quoted(id_col)).alias("sample_id"), "original_row_index", F.to_json(F.struct(*(F.col(quoted(c)) for c in data)), {"ignoreNullFields": "false"}).alias("raw_json"))
    return last_write_wins(out, ["sample_id"], [F.col("original_row_index")])


def to_long(rows: DataFrame, id_col: str = "SampleID", skip: Sequence[str] = ("Location",)) -> DataFrame:
    """(sample_id, original_row_index, variable_name, raw_value_text)."""
    values = [c for c in rows.columns if c not in (id_col, "original_row_index", *skip)]
    keyed = rows.select(F.col(quoted(id_col)).alias("sample_id"), "original_row_index", *(F.col(quoted(c)).cast("string").alias(c) for c in values))
    return keyed.unpivot(["sample_id", "original_row_index"], [quoted(c) for c in values], "variable_name", "raw_value_text")


def min_detected(long: DataFrame) -> DataFrame:
    """(variable_name, min_detected): least value above 0 of cells that are plain numbers."""
    cell = S.trimmed(F.col("raw_value_text"))
    found = long.select("variable_name", S.parse_float(cell).alias("v")).where(S.is_finite(F.col("v")) & (F.col("v") > 0))
    return found.groupBy("variable_name").agg(F.min("v").alias("min_detected"))


def configured_limits(spark: SparkSession, limits: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(limits.items()), "variable_name string, configured_limit double")


def clean(long: DataFrame, limits: DataFrame, method: str = "limit_div_sqrt2", use_min_detected: bool = True) -> DataFrame:
    """cleaned_measurements: per (sample_id, variable_name) the last cell that isn't blank, else the first blank one.

    limits (variable_name, configured_limit) and the least detected values are one row a variable.
    """
    blank = S.trimmed(F.coalesce("raw_value_text", F.lit(""))) == ""
    # A later cell replaces an earlier one unless it is blank; among blanks the first stays.
    order = [~blank, F.when(blank, -F.col("original_row_index")).otherwise(F.col("original_row_index"))]
    cells = last_write_wins(long, ["sample_id", "variable_name"], order)
    with_limits = cells.join(limits, "variable_name", "left").join(min_detected(long), "variable_name", "left")
    fallback = F.col("min_detected") if use_min_detected else F.lit(None).cast("double")
    usable = F.when(S.is_finite(F.col("configured_limit")) & (F.col("configured_limit") > 0), F.col("configured_limit"))
    limit = F.lit(None).cast("double") if method == "none" else F.coalesce(usable, fallback)
    raw = F.col("_cell")
    parsed = with_limits.withColumns(S.cell_parts(F.col("raw_value_text")) | {"_limit": limit, "_no_limit": usable.isNull()})
    parsed = parsed.withColumns({f"_{n}": c for n, c in S.parse_parts(raw, F.col("_plain"), F.col("_below"), F.col("_limit")).items()})
    blank = raw == ""
    # The notes.
    note = (
        F.when(blank, F.lit("empty_value"))
        .when(F.col("_is_err") == 1, F.lit("failed_numeric_parse"))
        .when(F.col("_rule") == "bdl_stored_as_missing_no_limit", F.lit("bdl_stored_as_missing"))
        .when((F.col("_is_bdl") == 1) & raw.startswith("<"), F.lit("bdl_substituted_using_reported_detection_limit"))
        .when((F.col("_is_bdl") == 1) & F.col("_no_limit"), F.lit("bdl_substituted_using_min_detected_fallback"))
        .when(F.col("_is_bdl") == 1, F.lit("bdl_substituted_using_configured_detection_limit"))
        .otherwise(F.lit(""))
    )
    units = F.create_map(*(F.lit(x) for c in (*C.SPECIAL_UNITS, *C.MEASURED_IN_MG_L) for x in (c, C.measurement_unit(c))))
    unit = F.when(~blank, F.coalesce(F.element_at(units, F.col("variable_name")), F.lit("unknown")))
    value = F.when(F.isnan("_value"), None).otherwise(F.col("_value"))
    return parsed.select(
        "sample_id", "variable_name", "raw_value_text", value.alias("cleaned_value_real"), unit.alias("unit"), F.col("_is_bdl").alias("bdl_flag"),
        F.when(~blank, F.coalesce("_rule", F.lit(""))).alias("bdl_rule"), ((F.col("_is_err") == 1) | value.isNull()).cast("int").alias("missing_flag"), note.alias("cleaning_note"),
    )


def to_wide(measurements: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row a sample, one double column a variable, by conditional aggregates in one pass."""
    value = S.finite(F.col("cleaned_value_real"))
    return measurements.where(F.col("variable_name").isin(*variables)).groupBy("sample_id").agg(*(F.max(F.when(F.col("variable_name") == v, value)).alias(v) for v in variables))


def derived_rows(measurements: DataFrame) -> DataFrame:
    """Measurements of the derived variables that are finite; their text is their formula."""
    base = ("Na", "Cl", "Mg", "Ca", "HCO3")
    wide = to_wide(measurements, base)
    made = S.derived({c: F.col(c) for c in base})
    long = wide.select("sample_id", *(e.alias(n) for n, e in made.items())).unpivot("sample_id", list(made), "variable_name", "cleaned_value_real")
    told = F.create_map(*(x for n, (formula, unit) in C.DERIVED_FORMULAS.items() for x in (F.lit(n), F.struct(F.lit(formula).alias("formula"), F.lit(unit).alias("unit")))))
    own = F.element_at(told, F.col("variable_name"))
    rows = long.where(S.is_finite(F.col("cleaned_value_real"))).withColumn("_told", own)
    return rows.select("sample_id", "variable_name", F.col("_told.formula").alias("raw_value_text"), "cleaned_value_real", F.col("_told.unit").alias("unit"), F.lit(0).alias("bdl_flag"), F.lit(0).alias("missing_flag"), F.lit(C.DERIVED_NOTE).alias("cleaning_note"))


def feature_matrix(measurements: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row a sample with the features asked for; ratios are computed from their analytes."""
    base = sorted({*(f for f in features if f not in C.DERIVED), *(("Na", "Cl", "Mg", "Ca", "HCO3") if any(f in C.DERIVED for f in features) else ())})
    wide = to_wide(measurements, base)
    made = S.derived({c: F.col(quoted(c)) for c in base}) if any(f in C.DERIVED for f in features) else {}
    return wide.select("sample_id", *(S.finite(made[f]).alias(f) if f in made else F.col(quoted(f)) for f in features))


def thresholds_frame(spark: SparkSession, known: Sequence[C.Threshold]) -> DataFrame:
    return spark.createDataFrame([(t.name, t.column, t.unit, None if t.threshold_value is None else float(t.threshold_value), t.threshold_source, t.exceedance_direction, t.notes) for t in known], "target_contaminant string, source_column string, unit string, threshold_value double, threshold_source string, exceedance_direction string, notes string")


def labels(samples: DataFrame, measurements: DataFrame, thresholds: DataFrame) -> DataFrame:
    """target_labels: every sample (sample_id) for every target; thresholds is one row a target."""
    grid = samples.select("sample_id").distinct().join(F.broadcast(thresholds.select("target_contaminant", "source_column", "threshold_value", "exceedance_direction")))
    m = measurements.select(F.col("sample_id"), F.col("variable_name").alias("source_column"), F.col("cleaned_value_real").alias("measured_value"), F.lit(1).alias("_row"))
    v, t = F.col("measured_value"), F.col("threshold_value")
    above = F.when(F.col("exceedance_direction") == "less_than", v < t).otherwise(v > t)
    status = F.when(t.isNull(), F.lit("no_threshold")).when(F.col("_row").isNull(), F.lit("missing_column")).when(v.isNull(), F.lit("missing_value")).otherwise(F.lit("labelled"))
    return grid.join(m, ["sample_id", "source_column"], "left").withColumn("label_status", status).select(
        "target_contaminant", "sample_id", "measured_value", "threshold_value", F.when(F.col("label_status") == "labelled", above.cast("int")).alias("true_label"), "label_status"
    )


def eligibility(labelled: DataFrame, min_positive: int = 5) -> DataFrame:
    """target_eligibility of target_labels."""
    g = labelled.groupBy("target_contaminant").agg(F.count("true_label").alias("n_samples"), F.coalesce(F.sum("true_label"), F.lit(0)).cast("long").alias("n_positive"), F.max("threshold_value").alias("threshold_value"))
    g = g.withColumn("n_negative", F.col("n_samples") - F.col("n_positive"))
    p, n = F.col("n_positive"), F.col("n_negative")
    status = F.when(F.col("threshold_value").isNull(), "no_threshold").when(p < 3, "descriptive_only").when((p < min_positive) | (n < min_positive), "exploratory_only").otherwise("modelled")
    # The notes.
    note = (
        F.when(F.col("ml_status") == "no_threshold", F.lit("Threshold not configured — cannot generate labels"))
        .when(p < 3, F.format_string("Only %d positive cases; insufficient for any ML", p))
        .when(p < min_positive, F.format_string(f"%d positive cases < minimum {min_positive} for standard CV", p))
        .when(n < min_positive, F.format_string("Class distribution too extreme for reliable CV (n_pos=%d, n_neg=%d)", p, n))
        .otherwise(F.format_string("%d positive, %d negative — ML feasible", p, n))
    )
    return g.withColumn("ml_status", status).select(
        "target_contaminant", "n_samples", "n_positive", "n_negative", F.when(F.col("n_samples") > 0, p / F.col("n_samples")).otherwise(F.lit(0.0)).alias("prevalence"),
        ((p >= min_positive) & (n >= min_positive)).cast("int").alias("cv_feasible"), "ml_status", F.when(F.col("ml_status") == "modelled", "Main text").otherwise("Supplement").alias("reporting_level"),
        note.alias("eligibility_note"),
    )


def missing_coordinates(samples: DataFrame, measurements: DataFrame, lat: str = "Dy", lon: str = "Dx") -> DataFrame:
    """Samples without a value of both coordinates."""
    have = coordinates(measurements, lat, lon).select("sample_id")
    return samples.select("sample_id").distinct().join(have, "sample_id", "left_anti")


def coordinates(measurements: DataFrame, lat: str = "Dy", lon: str = "Dx") -> DataFrame:
    """(sample_id, lat, lon) where both are known."""
    value = S.finite(F.col("cleaned_value_real"))
    g = measurements.where(F.col("variable_name").isin(lat, lon)).groupBy("sample_id").agg(F.max(F.when(F.col("variable_name") == lat, value)).alias("lat"), F.max(F.when(F.col("variable_name") == lon, value)).alias("lon"))
    return g.where("lat is not null and lon is not null")


def audit(long: DataFrame, measurements: DataFrame, lat: str = "Dy", lon: str = "Dx", max_errors: int = 5) -> DataFrame:
    """data_audit: one row.  Repeated ids are counted on the input, before upserts remove them."""
    rows = long.groupBy("sample_id", "original_row_index").agg(F.lit(1).alias("one")).groupBy("sample_id").agg(F.count("*").alias("n"))
    a = rows.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_samples"), (F.sum("n") - F.count("*")).alias("duplicate_sample_count"))
    v = measurements.agg(F.countDistinct("variable_name").alias("n_variables"), F.sum("bdl_flag").alias("n_bdl"), F.sum("missing_flag").alias("n_missing"), F.sum((F.col("cleaning_note") == "failed_numeric_parse").cast("int")).alias("n_parse_errors"))
    m = missing_coordinates(long, measurements, lat, lon).agg(F.count("*").alias("missing_coordinate_count"))
    return a.join(v).join(m).withColumn("audit_status", F.when(F.col("n_parse_errors") > max_errors, "WARNING").otherwise("OK"))


def described(names: DataFrame) -> DataFrame:
    """The column dictionary of names (column_name): role, unit and flags."""
    name = F.col("column_name")
    roles = {"identifier": C.IDENTIFIERS, "coordinate": C.COORDINATES, "field_parameter": C.FIELD_VARIABLES, "target_contaminant": C.TARGETS}
    role = F
    for r, own in roles.items():
        role = role.when(name.isin(*own), F.lit(r))
    role = role.otherwise(F.lit("laboratory_chemical"))
    units = {**{c: "text" for c in C.IDENTIFIERS}, **{c: C.dictionary_unit(c) for c in C.SPECIAL_UNITS}}
    unit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in units.items() for x in pair)), name), F.lit(C.dictionary_unit("")))
    flags = {"is_coordinate": "coordinate", "is_target_candidate": "target_contaminant", "is_field_variable": "field_parameter", "is_lab_variable": "laboratory_chemical"}
    out = names.select(name, F.lit("numeric").alias("inferred_type"), role.alias("scientific_role"), unit.alias("unit"))
    return out.select("*", *((F.col("scientific_role") == r).cast("int").alias(c) for c, r in flags.items()), F.lit(0).alias("is_derived_variable"))


def column_dictionary(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """The dictionary of a file's columns."""
    return described(spark.createDataFrame([(c,) for c in columns], "column_name string"))


def validation(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column_name, present, n_bdl_cells): required columns that are missing, and cells that say bdl."""
    have = [c for c in rows.columns]
    counts = rows.agg(*(F.sum((F.lower(S.trimmed(F.col(quoted(c)).cast("string"))) == "bdl").cast("long")).alias(c) for c in have))
    long = counts.unpivot([], [quoted(c) for c in have], "column_name", "n_bdl_cells").withColumn("present", F.lit(1))
    spark = rows.sparkSession
    asked = spark.createDataFrame([(c, 1) for c in required], "column_name string, is_required int")
    return long.join(asked, "column_name", "full").select("column_name", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("is_required", F.lit(0)).alias("is_required"), F.coalesce("n_bdl_cells", F.lit(0)).alias("n_bdl_cells"))


def summary(measurements: DataFrame) -> DataFrame:
    """Per variable: counts of valid, censored and missing cells, and min, max and median of the valid ones (rounded to 3)."""
    own = measurements.withColumn("_value", F.when(F.col("bdl_flag") == 0, F.col("cleaned_value_real")))
    g = own.groupBy("variable_name").agg(
        F.count("_value").alias("n_valid"), F.sum("bdl_flag").cast("long").alias("n_bdl"), F.sum(F.when((F.col("bdl_flag") == 0) & F.col("cleaned_value_real").isNull(), 1).otherwise(0)).cast("long").alias("n_missing"),
        F.round(F.min("_value"), 3).alias("min_value"), F.round(F.max("_value"), 3).alias("max_value"),
    )
    medians = quantiles(own, ["variable_name"], "_value", {"median_value": 0.5})
    return g.join(medians, "variable_name", "left").withColumn("median_value", F.round("median_value", 3))
