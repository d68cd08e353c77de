"""SimHash near-duplicates by covering locality-sensitive hashing.

Each document has a 64-bit SimHash of its word shingles (XXH64).  Two
fingerprints are linked if they differ in ``radius`` bits at most.

*Tables.*  The bits are dealt to 2 ** (radius + 1) - 1 groups, numbered from 1;
table v keeps the bits of the groups g whose bitwise and with v has an odd number of ones.
For any ``radius`` groups some v is orthogonal to all of them, so a pair within
the radius agrees on every bit that this table keeps: no pair is missed.

*Buckets.*  Equal fingerprints are one vertex (their least doc_id stands for
them).  Buckets of up to ``pair_limit`` vertices compare their pairs; a larger
bucket is never paired: each of its fingerprints is put under every value within
radius / 2 flips of the bits its table leaves out, and fingerprints that meet under a value are linked
through the least of them.  Two fingerprints meet there only if they lie within the radius, and
all such pairs do, so the components are the same, at a cost that is linear in the bucket.

A null or empty text has no shingle and the fingerprint 0, linked like any
other.  Repeated rows have one fingerprint; a null doc_id takes part, but
names no component (unless all its members' are null); an empty table gives an empty result;
texts of any length are fingerprinted whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm.components import components
from fenmark.llm.runtime import core, numbered, place, written

SHINGLE, SEED, RADIUS, PAIR_LIMIT = 3, 42, 2, 32


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits kept by each table, as unsigned numbers."""
    n = 2 ** (radius + 1) - 1
    group = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (group[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text's lower-cased words."""
    own = text.lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        starts = [0, *(ends[: len(own) - size] + 1).tolist()]
        ends = [*ends[size - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.array(hashes[k : k + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                fps = [signed(fingerprint(chunk.text(i), size)) for i in range(chunk.n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.rows.start, chunk.n), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return core(docs, key, text).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) whose components are those of all pairs within the radius."""
    if radius % 2:
        raise ValueError("an even radius is needed: fingerprints of large buckets meet halfway")
    kept = masks(radius)
    tables = F.array(*(F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for v, m in enumerate(kept)))
    keyed = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(written(sizes, "sizes"), ["t", "k"]), "buckets")
    few = met.where(F.col("n") <= pair_limit)
    a, b = few.select("t", "k", F.col("fp").alias("a")), few.select("t", "k", F.col("fp").alias("b"))
    pairs = a.join(b, ["t", "k"]).where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    free = [[i for i in range(64) if not m >> i & 1] for m in kept]
    flips = F.array(*(F.array(*(F.lit(signed(sum(1 << i for i in c))) for r in range(radius // 2 + 1) for c in itertools.combinations(own, r))) for own in free))
    near = met.where(F.col("n") > pair_limit).select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    centres = near.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(written(centres, "centres"), "value").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).  The radius has to be even."""
    fps = written(fingerprints(docs, key, text, size), "fingerprints")
    vertices = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "vertices")
    roots = components(links(vertices, radius))
    placed = vertices.join(roots, vertices.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is their component_id in found, once.

    Of rows that repeat an id, those of one text count once, and those of different texts stay.
    """
    own, at = numbered(docs), place(docs, key)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    kept = own.join(keep, F.col(at).cast("long").eqNullSafe(F.col("_keep")), "left_semi")
    twice = own.groupBy(at).count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([at, place(docs, text)]) if twice else kept).toDF(*docs.columns)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: its least doc_id, once (see ``representatives``)."""
    return representatives(docs, near_duplicates(docs, key, text, size, radius), key, text)
