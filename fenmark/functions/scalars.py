"""Scalar expressions: censored numbers, logistic helpers, distances, classes, bins, ids."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
SQRT2 = math.sqrt(2)
#: The numbers that count as such; Spark's own cast would take 1d, 1f and hexadecimal, too.
FLOAT = r"(?i)^[+-]?(inf(inity)?|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"
BLANKS = " \t\n\x0b\f\r"

#: Lower limits of the priority classes, highest first.
PRIORITY = ((0.75, "Very_High"), (0.5, "High"), (0.25, "Moderate"))


def trimmed(raw: Column) -> Column:
    return F.btrim(raw, F.lit(BLANKS))


def parse_float(text: Column) -> Column:
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(is_finite(x), x)


def cell_parts(raw: Column) -> dict[str, Column]:
    """What parse_parts looks at, by name: the trimmed cell, and the numbers of it and of what follows its first character.

    As columns of a frame they are computed once a row; inside one expression they would be repeated wherever they are used.
    """
    t = trimmed(F.coalesce(raw, F.lit("")))
    return {"_cell": t, "_plain": parse_float(t), "_below": parse_float(trimmed(F.substr(t, F.lit(2))))}


def parse_parts(cell: Column, plain: Column, below: Column, limit: Column) -> dict[str, Column]:
    """value, is_bdl, is_err and rule of a cell; see parse_censored."""
    low = F.lower(cell)
    marker = low.isin("bdl", "nd", "n.d.", "<dl", "bl") | (cell == "-")
    usable = is_finite(limit) & (limit > 0)
    less = cell.startswith("<")
    return {
        "value": F.when(cell == "", None).when(marker, F.when(usable, limit / SQRT2)).when(less, below / SQRT2).otherwise(plain),
        "is_bdl": ((cell != "") & (marker | less)).cast("int"),
        "is_err": ((cell != "") & ~marker & F.when(less, below.isNull()).otherwise(plain.isNull())).cast("int"),
        "rule": F.when(cell == "", None)
        .when(marker, F.when(usable, F.lit("substituted_as_limit_div_sqrt2")).otherwise(F.lit("bdl_stored_as_missing_no_limit")))
        .when(less, F.when(below.isNotNull(), F.lit("substituted_as_reported_limit_div_sqrt2")).otherwise(F.lit("failed_bdl_limit_parse"))),
    }


def parse_censored(raw: Column, limit: Column | None = None) -> Column:
    """(value, is_bdl, is_err, rule) of a cell; limit is its variable's detection limit, if there is one.

    A marker of no detection takes limit / sqrt(2), "<X" takes X / sqrt(2), and what is neither
    these nor a number is an error.  A blank cell has no value and is no error.
    """
    parts = cell_parts(raw)
    made = parse_parts(*parts.values(), F.lit(None).cast("double") if limit is None else limit)
    return F.struct(*(c.alias(n) for n, c in made.items()))


def sigmoid(x: Column) -> Column:
    return F.when(x > 30, F.lit(1 - 1e-15)).when(x < -30, F.lit(1e-15)).otherwise(1 / (1 + F.exp(-x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def run_id(target: Column, tier: Column, algorithm: Column, cv_mode: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("_", target, F.replace(tier, F.lit(" "), F.lit("_")), algorithm, cv_mode), 256), 1, 32)


def priority_class(p: Column) -> Column:
    out = F
    for low, name in PRIORITY:
        out = out.when(p >= low, F.lit(name))
    return out.otherwise(F.lit("Low"))


def priority_reason(klass: Column) -> Column:
    # The reasons.
    return (
        F.when(klass == "Very_High", F.lit("Urgent confirmatory laboratory testing recommended"))
        .when(klass == "High", F.lit("Confirmatory testing recommended"))
        .when(klass == "Moderate", F.lit("Monitor or retest seasonally"))
        .otherwise(F.lit("Lower immediate priority; routine monitoring"))
    )


def bin_right_closed(p: Column, bins: int) -> Column:
    """1..bins: right-closed bins of [0, 1], the least value in the first."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(p * bins))).cast("int")


def fixed(x: Column, digits: int, null: str = "") -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", x), F.lit(null))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else null."""
    return F.when(den > 0, num / den)


def derived(v: dict[str, Column]) -> dict[str, Column]:
    """The derived variables of measured ones."""
    sar = F.sqrt(0.5 * (v["Ca"] / 20.04 + v["Mg"] / 12.155))
    return {
        "Na_Cl_ratio": safe_ratio(v["Na"], v["Cl"]),
        "Mg_Ca_ratio": safe_ratio(v["Mg"], v["Ca"]),
        "HCO3_Cl_ratio": safe_ratio(v["HCO3"], v["Cl"]),
        "SAR": F.when(sar > 0, (v["Na"] / 22.99) / sar),
        "Ca_Mg_ratio": safe_ratio(v["Ca"], v["Mg"]),
    }


def confusion_from_sensitivity(fn: Column, fp: Column, sensitivity: Column, specificity: Column) -> dict[str, Column]:
    """TP and TN rebuilt from false counts and rates, guarded against rates of one."""
    p = F.round(fn / F.greatest(1 - sensitivity, F.lit(1e-6)))
    n = F.round(fp / F.greatest(1 - specificity, F.lit(1e-6)))
    return {"tp": F.greatest(F.lit(0.0), p - fn), "tn": F.greatest(F.lit(0.0), n - fp)}


def title(text: Column) -> Column:
    """The first line after the first that isn't blank, trimmed."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: trimmed(x))
    return F.get(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: x != ""), F.lit(0))


def model_class(algorithm: Column) -> Column:
    """Baseline for the dummies, else Model."""
    return F.when(algorithm.rlike("^Dummy"), F.lit("Baseline")).otherwise(F.lit("Model"))


def level(value: Column, levels: Sequence[str]) -> Column:
    """The place of a value among ordered levels, from 1; null for what is none of them."""
    at = F.array_position(F.array(*map(F.lit, levels)), value)
    return F.when(at > 0, at.cast("int"))
