"""Writers: properly quoted CSV, and manifests of what was written."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fenmark.functions.scalars import fixed
from fenmark.sources.readers import file_hashes


def write_csv(df: DataFrame, path: str, single: bool = True, digits: dict[str, int] | None = None) -> str:
    """df as CSV with a header under the folder path; quoted where needed, quotes doubled.

    Reports are small and ordered, so they go to one file; pass single=False for large ones.
    """
    counted_csv(df, path, single, digits)
    return path


def counted_csv(df: DataFrame, path: str, single: bool = True, digits: dict[str, int] | None = None) -> int:
    """write_csv, and how many rows it wrote, counted as they went."""
    seen = Observation()
    shaped = df.select(*(fixed(F.col(c), digits[c]).alias(c) if digits and c in digits else F.col(c) for c in df.columns))
    shaped = shaped.observe(seen, F.count(F.lit(1)).alias("n"))
    (shaped.coalesce(1) if single else shaped).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    return seen.get["n"]


def export_manifest(spark, files: Sequence[tuple[str, str, int]], created_at: str) -> DataFrame:
    """gis_exports_manifest rows of (folder, type, row count): the hash is that of the folder's part files, in order of their names."""
    rows = []
    for folder, kind, n in files:
        parts = file_hashes(spark, folder, "part-*").select(F.col("file_path").alias("path"), F.col("sha256_hash").alias("h"))
        one = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), ""), 256)).first()[0]
        rows.append((folder, kind, created_at, None, n, one))
    return spark.createDataFrame(rows, "export_file string, export_type string, created_at string, source_query string, row_count long, sha256_hash string")


def run_manifest(path: str | Path, content: dict[str, Any]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True), encoding="utf-8")
