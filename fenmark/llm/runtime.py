"""Tables, shared folders and row identities for the operators of this subpackage."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Spark's setting by which a plan's shuffle files are removed when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RUN, _SERIAL, _WRITTEN = uuid.uuid4().hex[:12], itertools.count(), {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (in local tests) a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="fenmark-"))
    return spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage, survives lost executors.

    The plan's shuffle files go as soon as the table stands (CLEANUP, set for this write alone).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fenmark-{_RUN}/{next(_SERIAL)}-{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables behind frames of written(); what reads them can't be used afterwards."""
    for frame in frames:
        _remove(frame._written_at)


def discard_written() -> None:
    """Removes all tables of written() that are left: at the interpreter's end, or between the jobs of a long session."""
    for path in list(_WRITTEN):
        _remove(path)


def _remove(path: str) -> None:
    spark = _WRITTEN.pop(path)
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended, and its gateway with it
        return


atexit.register(discard_written)


def identity(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with a column ``_uid`` that, beside the key, tells apart rows which share a key.

    Keys are looked through once (that column alone).  Where none repeats or is
    null, ``_uid`` is 0; else it is a hash of the text, so that rows of one key
    and different texts stay apart and repeated rows go together.
    """
    doubtful = docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count()
    return docs.withColumn("_uid", F.xxhash64(text) if doubtful else F.lit(0).cast("long")), "_uid"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ...: no name of theirs can clash with ours, or with each other but for case.

    Every operator reads its rows through here, so this is where the batches that Python workers get are bounded:
    by rows and by bytes, as texts may be long (one longer than that is a batch of its own).
    """
    for name, value in BATCH.items():
        docs.sparkSession.conf.set(name, value)
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place(docs: DataFrame, name: str) -> str:
    """numbered()'s name of a column."""
    return f"c{docs.columns.index(name)}"


def core(docs: DataFrame, key: str, text: str, **more: str) -> DataFrame:
    """Only the key (as bigint doc_id), the text and more columns (ours=theirs, as strings), under names of our own."""
    own = numbered(docs)
    return own.select(
        F.col(place(docs, key)).cast("long").alias("doc_id"),
        F.col(place(docs, text)).cast("string").alias("text"),
        *(F.col(place(docs, theirs)).cast("string").alias(ours) for ours, theirs in more.items()),
    )


def ddl(df: DataFrame) -> str:
    """The columns of df as a schema string."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
