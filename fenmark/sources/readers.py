"""Readers: strict CSV as text, exports with numbers, whole texts, file hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path).columns


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, headers and fields trimmed; a row of another length than the header fails the read."""
    schema = T.StructType([T.StructField(c.strip(), T.StringType()) for c in csv_header(spark, path)])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"').csv(path)


def read_export(spark: SparkSession, path: str, numbers: Sequence[str] = ()) -> DataFrame:
    """An exported CSV, the columns named as numbers made doubles where they are such (NaN and blanks are null)."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    value = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    return df.select(*(value(c).alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, full_text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("full_text"))


#: Bytes that a hash takes in at a time.
CHUNK = 1 << 22


def opened(path: str):
    """A file by Spark's name of it (file:/.., hdfs://.., s3://..), as a stream of its bytes as they are (compressed ones too), read a chunk at a time."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    system, at = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
    return system.open_input_stream(at, compression=None)


def file_hashes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file_path, sha256_hash, file_size_bytes) of files, such as have names like pattern.

    Spark lists the files and deals them to tasks by size; a task streams its files through the hash, so a file of any size takes a chunk of memory.
    """
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length")  # the content isn't read here

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["path"]:
                digest = hashlib.sha256()
                with opened(name) as stream:
                    while part := stream.read(CHUNK):
                        digest.update(part)
                out.append(digest.hexdigest())
            yield pd.DataFrame({"file_path": batch["path"], "sha256_hash": out, "file_size_bytes": batch["length"]})

    return files.mapInPandas(hashed, "file_path string, sha256_hash string, file_size_bytes long")
