"""The command line: python -m fenmark.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from fenmark import config as C
from fenmark.plans import screening
from fenmark.sources.sinks import run_manifest
from fenmark.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fenmark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        q = sub.add_parser(name)
        q.add_argument("--store", required=name != "validate-inputs")
        for o in options:
            q.add_argument(f"--{o}", required=o not in ("outline", "variant", "out") and not (o == "rules" and name == "ingest-inputs") and not (o == "config" and name.startswith("run-")))
        return q

    command("validate-inputs", "csv", "config", "thresholds", "rules")
    command("init-db")
    command("ingest-inputs", "csv", "config", "thresholds", "outline", "rules")
    command("audit-leakage", "rules")
    one = command("run-target", "config")
    one.add_argument("--target", required=True, choices=C.TARGETS)
    one.add_argument("--tier", required=True, choices=(*C.TIERS, *C.VARIANT_TIERS))
    one.add_argument("--cv-mode", required=True, choices=C.CV_MODES)
    command("run-pipeline", "config", "out")
    command("export-r", "out")
    command("export-gis", "out")
    vacuum = command("vacuum")
    vacuum.add_argument("--keep", type=int, default=1, help="versions that stay")
    vacuum.add_argument("--grace", type=float, default=86400.0, help="seconds for which files that no version names stay")
    return p


def _config(store: Store, path: str | None) -> C.RunConfig:
    """The run configuration, by default the one registered at ingest."""
    return C.read_run_config((path or screening.registered(store, "runtime_config_yaml")).removeprefix("file:"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fenmark").getOrCreate()
    store = Store(spark, a.store) if a.store else None
    if a.command == "validate-inputs":
        required = [*C.IDENTIFIERS[:1], *C.COORDINATES, *C.FIELD_VARIABLES, *C.TARGETS]
        screening.validate(spark, a.csv, required, [a.config, a.thresholds, a.rules]).show(100, False)
    elif a.command == "init-db":
        store.create_all()
    elif a.command == "ingest-inputs":
        screening.ingest_study(store, a.csv, C.read_run_config(a.config), C.read_thresholds(a.thresholds), a.outline, {"runtime_config_yaml": a.config, "thresholds_yaml": a.thresholds, **({"leakage_rules_yaml": a.rules} if a.rules else {})})
    elif a.command == "audit-leakage":
        screening.register(store, {"leakage_rules_yaml": a.rules})
        screening.audit_leakage(store, C.read_leakage_rules(a.rules))
    elif a.command == "run-target":
        print(screening.run_models(store, _config(store, a.config), [a.target], [a.tier], [a.cv_mode]))
    elif a.command == "run-pipeline":
        began = time.time()
        counts = screening.run_models(store, _config(store, a.config))
        if a.out:
            groups = store.read("model_runs").select("target_contaminant", "predictor_tier", "cv_mode").distinct().count()
            run_manifest(f"{a.out}/run_manifest.json", {"pipeline_completed_at": screening.now(), "total_run_groups": groups, "elapsed_ms": int(1000 * (time.time() - began)), "targets": C.TARGETS, "tiers": tuple(C.TIERS), "cv_modes": C.CV_MODES, "counts": counts})
        print(counts)
    elif a.command == "vacuum":
        print(len(store.vacuum(a.keep, a.grace)))
    else:
        if not a.out:
            raise SystemExit("--out is needed")
        print(screening.export(store, a.out, "r" if a.command == "export-r" else "gis"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
