"""Typed configuration: run settings, thresholds, detection limits and leakage rules, read from YAML."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

# The domain's vocabulary.
TARGETS = ("Na", "Cl", "TDS", "B", "F", "NO3")
FIELD_VARIABLES = ("pH", "Temp.", "EC")
COORDINATES = ("Dx", "Dy")
IDENTIFIERS = ("SampleID", "Location")
TIERS = {
    "Tier1_Field": ("pH", "Temp.", "EC", "Dx", "Dy"),
    "Tier2_Reduced": ("pH", "Temp.", "EC", "Dx", "Dy", "Na", "K", "Mg", "Ca", "Cl", "HCO3", "SO4"),
    "Tier3_Full": ("pH", "Temp.", "EC", "Dx", "Dy", "Na", "K", "Mg", "Ca", "Cl", "HCO3", "SO4", "CO3", "NO3", "F", "B", "Na_Cl_ratio", "Mg_Ca_ratio", "HCO3_Cl_ratio", "SAR", "Ca_Mg_ratio"),
}
DERIVED = ("Na_Cl_ratio", "Mg_Ca_ratio", "HCO3_Cl_ratio", "SAR", "Ca_Mg_ratio")
#: What the derived variables are computed by, and their units.
DERIVED_FORMULAS = {
    "Na_Cl_ratio": ("Na/Cl", "mg/L ratio"),
    "Mg_Ca_ratio": ("Mg/Ca", "mg/L ratio"),
    "HCO3_Cl_ratio": ("HCO3/Cl", "mg/L ratio"),
    "SAR": ("Na/sqrt(0.5*(Ca+Mg))", "(meq/L)^0.5"),
    "Ca_Mg_ratio": ("Ca/Mg", "mg/L ratio"),
}
DERIVED_NOTE = "Derived ratio computed post-ingestion"
#: A target's variants have the middle tier's features.
VARIANT_TIER = "Tier2_Reduced"
VARIANT_TIERS = ("Tier2_Reduced_TDS_EC_inclusive", "Tier2_Reduced_TDS_EC_strict")
HYPERPARAMETERS = {"LogisticRegression": "C", "RandomForest": "n_estimators_depth", "GradientBoostedTrees": "n_estimators_lr"}
FILE_ROLES = ("raw_groundwater_csv", "manuscript_outline", "thresholds_yaml", "leakage_rules_yaml", "runtime_config_yaml")
CV_MODES = ("Stratified_Nested_CV", "Spatial_Group_CV")
ALGORITHMS = ("DummyMajority", "DummyStratified", "EcOnlyLogistic", "LogisticRegression", "RandomForest", "GradientBoostedTrees")
SPECIAL_UNITS = {"pH": "dimensionless", "Temp.": "°C", "EC": "µS/cm", "Dx": "decimal_degrees_lon", "Dy": "decimal_degrees_lat"}
MEASURED_IN_MG_L = ("TDS", "Na", "K", "Mg", "Ca", "Cl", "SO4", "HCO3", "CO3", "NO3", "F", "B")


def dictionary_unit(column: str) -> str:
    """Of the column dictionary: mg/L by default."""
    return "text" if column in IDENTIFIERS else SPECIAL_UNITS.get(column, "mg/L")


def measurement_unit(column: str) -> str:
    """Of measurements: unknown by default."""
    return SPECIAL_UNITS.get(column) or ("mg/L" if column in MEASURED_IN_MG_L else "unknown")


@dataclass(frozen=True)
class CvConfig:
    outer_folds: int = 5
    spatial_outer_folds: int = 3
    inner_folds: int = 3
    repeats: int = 5
    random_seed: int = 20260531
    minimum_positive_cases_for_ml: int = 5


@dataclass(frozen=True)
class SpatialConfig:
    latitude_column: str = "Dy"
    longitude_column: str = "Dx"
    clustering_method: str = "kmeans"
    number_of_spatial_clusters: int | None = None
    max_clusters: int = 8

    def __post_init__(self) -> None:
        if self.clustering_method != "kmeans":
            raise ValueError(f"clustering_method {self.clustering_method!r}: only kmeans is known")


@dataclass(frozen=True)
class RunConfig:
    name: str = "screening"
    version: str = "0"
    paths: dict[str, str] = field(default_factory=dict)
    cv: CvConfig = CvConfig()
    spatial: SpatialConfig = SpatialConfig()
    models: dict[str, bool] = field(default_factory=dict)
    outputs: dict[str, bool] = field(default_factory=dict)

    def algorithms(self, *, ec_strict: bool = False) -> list[str]:
        """The algorithms that run; all unless a switch turns one off, and no EC-only model without EC."""
        switch = {"DummyMajority": "run_majority_dummy", "DummyStratified": "run_stratified_dummy", "EcOnlyLogistic": "run_ec_only_logistic", "LogisticRegression": "run_regularized_logistic", "RandomForest": "run_random_forest", "GradientBoostedTrees": "run_gradient_boosted_tree"}
        return [a for a in ALGORITHMS if self.models.get(switch[a], True) and not (ec_strict and a == "EcOnlyLogistic")]


@dataclass(frozen=True)
class Threshold:
    name: str
    column: str
    unit: str = ""
    threshold_value: float | None = None
    threshold_source: str = ""
    exceedance_direction: str = "greater_than"
    notes: str = ""


@dataclass(frozen=True)
class Censoring:
    """How cells below detection get values: by configured limits, then (unless turned off) the least detected value."""

    method: str = "limit_div_sqrt2"
    use_min_detected_fallback: bool = True
    detection_limits: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class ThresholdsConfig:
    targets: tuple[Threshold, ...] = ()
    censoring: Censoring = Censoring()


@dataclass(frozen=True)
class TargetRules:
    forbidden_exact: tuple[str, ...] = ()
    forbidden_contains: tuple[str, ...] = ()
    #: variant: (allow, forbidden_exact)
    variants: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)


@dataclass(frozen=True)
class LeakageRules:
    global_forbidden_patterns: tuple[str, ...] = ()
    targets: dict[str, TargetRules] = field(default_factory=dict)


def _yaml(path: str | Path) -> dict[str, Any]:
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found


def _known(cls: type, given: dict[str, Any] | None) -> Any:
    """Of a mapping what the class knows; other keys are told and left out."""
    if other := sorted(set(given or {}) - set(cls.__dataclass_fields__)):
        logging.getLogger(__name__).warning("%s: unknown keys %s are left out", cls.__name__, other)
    return cls(**{k: v for k, v in (given or {}).items() if k in cls.__dataclass_fields__})


def read_run_config(path: str | Path) -> RunConfig:
    y = _yaml(path)
    return RunConfig(y["project"]["name"], str(y["project"]["version"]), y.get("paths", {}), _known(CvConfig, y.get("cv")), _known(SpatialConfig, y.get("spatial")), y.get("models", {}), y.get("outputs", {}))


def read_thresholds(path: str | Path) -> ThresholdsConfig:
    y = _yaml(path)
    targets = tuple(_known(Threshold, {"column": name, **body, "name": name}) for name, body in y["targets"].items())
    c = y.get("bdl_substitution", {})
    limits = {k: float(v["value"]) for k, v in (c.get("detection_limits") or {}).items() if v.get("value") is not None}
    limits = {k: v for k, v in limits.items() if 0 < v < float("inf")}
    return ThresholdsConfig(targets, Censoring(c.get("method", "limit_div_sqrt2"), c.get("use_min_detected_fallback", True), limits))


def read_leakage_rules(path: str | Path) -> LeakageRules:
    y = _yaml(path)
    targets = {}
    for name, body in y["targets"].items():
        variants = {v: (tuple(r.get("allow", ())), tuple(r.get("forbidden_exact", ()))) for v, r in (body.get("special_models") or {}).items()}
        targets[name] = TargetRules(tuple(body.get("forbidden_exact", ())), tuple(body.get("forbidden_contains", ())), variants)
    return LeakageRules(tuple(y.get("global_forbidden_patterns", ())), targets)


# The study's rules, for use without files.
STUDY_THRESHOLDS = ThresholdsConfig(tuple(Threshold(t, t, "mg/L", v, "75 % of the guideline value") for t, v in (("Na", 150.0), ("Cl", 187.5), ("TDS", 750.0), ("B", 1.125), ("F", 1.125), ("NO3", 37.5))))
STUDY_RULES = LeakageRules(
    ("_exceedance", "_label", "_class", "_exceeds", "_binary"),
    {
        "Na": TargetRules(("Na",), ("Na_", "_Na", "SAR", "sodium")),
        "Cl": TargetRules(("Cl",), ("Cl_", "_Cl", "Cl_HCO3", "chloride")),
        "TDS": TargetRules(("TDS",), ("TDS_", "_TDS", "salinity"), {"TDS_EC_inclusive": (("EC",), ()), "TDS_EC_strict": ((), ("EC",))}),
        "B": TargetRules(("B",), ("B_", "_B", "boron")),
        "F": TargetRules(("F",), ("F_", "_F", "fluoride")),
        "NO3": TargetRules(("NO3",), ("NO3_", "_NO3", "nitrate", "nitrogen")),
    },
)
