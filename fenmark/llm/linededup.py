"""Reversible line dedup: sharded cuckoo filters before exact reference counts.

A line's key is the line, stripped of [\x20\x09-\x0D] at both ends and with A-Z
lower-cased; it is kept as its 128-bit MD5.  The index has three parts:

*postings* (key, doc_id, uid)   which documents hold a key, once each; what a deletion takes back
*references* (key, docs, last)  exact count of distinct documents, and the largest doc_id
*filters* (shard, filter)       per shard of the key space a cuckoo filter of the
                                keys found in at least ``min_docs`` documents

``insert`` and ``delete`` write what they change and no more: the new postings or the deleted ids, the references of the keys they
touch, and the filters of shards with a key whose count crossed ``min_docs`` (by cuckoo insertions
and deletions).  Frames of the index put the latest of these over the older ones; ``compacted`` writes them as one again.

*Lookup.*  Postings are dealt to the filters by shard, whatever the filters' size: a shard's filter comes first in its partition and the postings
stream past it, so a task holds one filter.  A shard whose most frequent key is in very many documents is dealt in several salts, each with a copy of the filter.  Filters can err only
by letting a key through: the postings they pass are looked up in the exact references.

Frequent keys are counted by partial aggregates and looked up by joins that AQE may
split.  A null or empty text is one empty line; a document may repeat (same doc_id):
its rows count as one document, and each row loses the same lines; null doc_ids
count as one document that is the smallest; an empty table gives an empty result; texts and lines of any length are taken whole.
Keys are equal if their 128 bits are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm.runtime import core, discard, identity, numbered, place, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a filter, and documents of a shard's most frequent key for each salt.
SHARD_KEYS, SALT_DOCS = 50_000, 1 << 18
_POSTINGS = "key binary, doc_id long, uid long"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; every key has two buckets, each found from the other.

    Keys are 16-byte digests.  Deleting a key that was inserted is exact; a key
    that was never inserted must not be deleted.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int) -> None:
        self.table = np.zeros((1 << max(1, (buckets - 1).bit_length()), self.SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter of distinct keys, at most 80 % full; doubled until all of them fit."""
        out = cls(max(2, len(keys) * 10 // (8 * cls.SLOTS) + 1))
        while not all(out.insert(k) for k in keys):
            out = cls(2 * len(out.table))
        return out

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "big") or 1
        one = int.from_bytes(key[4:8], "big") & (len(self.table) - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)

    def insert(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        for kick in range(self.KICKS):
            slot = (mark + kick) % self.SLOTS
            self.table[two, slot], mark = mark, int(self.table[two, slot])
            two = self._other(two, mark)
            free = np.flatnonzero(self.table[two] == 0)
            if len(free):
                self.table[two, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        for b in (one, two):
            held = np.flatnonzero(self.table[b] == mark)
            if len(held):
                self.table[b, held[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        return bool(self.holds(np.frombuffer(key, np.uint8).reshape(1, 16))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (rows of 16 bytes) may be in the filter."""
        mark = np.maximum(keys[:, :2].copy().view(">u2").ravel().astype(np.int64), 1)
        one = keys[:, 4:8].copy().view(">u4").ravel().astype(np.int64) & (len(self.table) - 1)
        return ((self.table[one] == mark[:, None]) | (self.table[self._other(one, mark)] == mark[:, None])).any(1)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, "<u2").reshape(-1, cls.SLOTS).copy()
        return out


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def postings(keyed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id, uid) of keyed (doc_id, uid, text): each row's distinct long keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids = batch.column("doc_id"), batch.column("uid")
            for chunk in K.chunks(batch.column("text")):
                keys, rows = [], []
                for i in range(chunk.n):
                    own = {digest(k) for line in chunk.text(i).split(b"\n") if long_enough(k := line_key(line), min_chars)}
                    keys += own
                    rows += [chunk.rows.start + i] * len(own)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids.take(at), uids.take(at)], ["key", "doc_id", "uid"])

    return keyed.mapInArrow(run, _POSTINGS)


def references(of: DataFrame) -> DataFrame:
    """(key, docs, last) of postings; rows that share a doc_id are one document."""
    once = of.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


def _shard(key: str, shards: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of distinct keys."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of([bytes(k) for k in group["key"]])
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "filter": [made.to_bytes()]})

    return keys.select(_shard("key", shards).alias("shard"), "key").groupBy("shard").applyInPandas(run, "shard int, filter binary")


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of filters and postings, by shard and salt, a filter before its postings: the postings that their filter lets through."""
    own, held = None, None
    for batch in batches:
        is_filter = batch.column("filter").is_valid().to_numpy(zero_copy_only=False)
        shard, salt = (batch.column(c).to_numpy() for c in ("shard", "salt"))
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | is_filter[1:] | is_filter[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if is_filter[a]:
                own, held = (shard[a], salt[a]), CuckooFilter.from_bytes(batch.column("filter")[a].as_py())
            elif own == (shard[a], salt[a]):
                rows = batch.slice(a, b - a)
                keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(-1, 16)
                yield rows.select(["key", "doc_id", "uid"]).filter(pa.array(held.holds(keys)))


@dataclass(frozen=True)
class LineIndex:
    """Postings, references and filters (shard, filter) of the documents inserted so far (see the module)."""

    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, keyed: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """The index of keyed (doc_id, uid, text)."""
        held = written(postings(keyed, min_chars), "postings")
        refs = written(references(held), "references")
        often = refs.where(F.col("docs") >= min_docs)
        shards = max(1, -(-often.count() // shard_keys))
        return cls(held, refs, written(build_filters(often.select("key"), shards), "filters"), shards, min_chars, min_docs)

    def insert(self, keyed: DataFrame) -> LineIndex:
        """With more documents; rows of a known doc_id add their lines to it."""
        new = written(postings(keyed, self.min_chars), "postings")
        return self._moved(self.postings.unionByName(new), new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents named in the first column of doc_ids: as if they had never been inserted."""
        gone = written(doc_ids.toDF("_gone", *doc_ids.columns[1:]).select("_gone").distinct(), "gone")
        match = F.col("doc_id").eqNullSafe(F.col("_gone"))
        return self._moved(self.postings.join(gone, match, "left_anti"), self.postings.join(gone, match, "left_semi"))

    def _moved(self, held: DataFrame, changed: DataFrame) -> LineIndex:
        touched = written(changed.select("key").distinct(), "touched")
        fresh = written(references(held.join(touched, "key", "left_semi")), "references")
        before = self.references.select("key", F.col("docs").alias("was"))
        crossed = touched.join(before, "key", "left").join(fresh, "key", "left").select("key", (F.coalesce("was", F.lit(0)) >= self.min_docs).alias("was"), (F.coalesce("docs", F.lit(0)) >= self.min_docs).alias("now")).where("was <> now")
        moves = written(crossed.select(_shard("key", self.shards).alias("shard"), "key", "now"), "moves")
        refs = self.references.join(touched, "key", "left_anti").unionByName(fresh)
        updated = written(self._updated(moves), "filters")
        broken = updated.where(F.col("filter").isNull()).select("shard")
        keys = refs.where(F.col("docs") >= self.min_docs).select("key", _shard("key", self.shards).alias("shard"))
        rebuilt = build_filters(keys.join(broken, "shard", "left_semi").select("key"), self.shards)
        fine = written(updated.where(F.col("filter").isNotNull()).unionByName(rebuilt), "filters")
        filters = self.filters.join(moves.select("shard").distinct(), "shard", "left_anti").unionByName(fine)
        return LineIndex(held, refs, filters, self.shards, self.min_chars, self.min_docs)

    def compacted(self) -> LineIndex:
        """The same index, each of its tables written as one."""
        return LineIndex(written(self.postings, "postings"), written(self.references, "references"), written(self.filters, "filters"), self.shards, self.min_chars, self.min_docs)

    def _updated(self, moves: DataFrame) -> DataFrame:
        """The filters of the moves' shards after deletions and insertions; null for a shard that overflowed."""

        def run(key: tuple, old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(2)
            for k in moved["key"][~moved["now"]]:
                made.delete(bytes(k))
            pending = [bytes(k) for k in moved["key"][moved["now"]]]
            if not all(made.insert(k) for k in pending):
                return pd.DataFrame({"shard": [key[0]], "filter": [None]})
            return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes()]})

        old, new = self.filters.join(moves.select("shard").distinct(), "shard", "left_semi").groupBy("shard"), moves.groupBy("shard")
        return old.cogroup(new).applyInPandas(run, "shard int, filter binary")

    def passing(self, some: DataFrame, salt_docs: int = SALT_DOCS) -> DataFrame:
        """Those of some postings whose key the filter of its shard lets through."""
        most = self.references.where(F.col("docs") >= self.min_docs).groupBy(_shard("key", self.shards).alias("shard")).agg(F.max("docs").alias("most"))
        salts = (F.floor(F.col("most") / salt_docs) + 1).cast("int")
        known = written(self.filters.join(most, "shard").withColumn("salts", salts).select("shard", "salts", "filter"), "dealt")
        copies = known.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("uid"))
        rows = some.withColumn("shard", _shard("key", self.shards)).join(known.select("shard", "salts"), "shard")
        rows = rows.select("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("binary").alias("filter"), "key", "doc_id", "uid")
        dealt = copies.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        return dealt.mapInArrow(_passed, _POSTINGS)

    def dropped(self, salt_docs: int = SALT_DOCS) -> DataFrame:
        """(doc_id, uid, keys): per row of the index the keys whose lines go."""
        exact = self.references.where(F.col("docs") >= self.min_docs).select("key", "last")
        lost = written(self.passing(self.postings, salt_docs), "passed").join(exact, "key").where(~F.col("doc_id").eqNullSafe(F.col("last")))
        return lost.groupBy("doc_id", "uid").agg(F.collect_set("key").alias("keys"))


def _rebuilt(min_chars: int):
    """Per batch of (doc_id, text, keys): the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                lost = batch.column("keys").slice(chunk.rows.start, chunk.n).to_pylist()
                n, gone, kept = [], [], []
                for i in range(chunk.n):
                    lines = chunk.text(i).split(b"\n")
                    left = lines
                    if lost[i]:
                        own = set(lost[i])
                        left = [x for x in lines if not (long_enough(k := line_key(x), min_chars) and digest(k) in own)]
                    n.append(len(lines))
                    gone.append(len(lines) - len(left))
                    kept.append(b"\n".join(left))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.rows.start, chunk.n), batch.column("uid").slice(chunk.rows.start, chunk.n), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())],
                    ["doc_id", "uid", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
                )

    return run


def _lost(index: LineIndex) -> DataFrame:
    """dropped() of an index that isn't kept."""
    out = written(index.dropped(), "lost")
    discard(index.postings, index.references, index.filters)
    return out


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, length: str | None = None) -> DataFrame:
    """docs, all columns, with their repeated lines gone; a text without any stays as it is (a null text too).

    length names a column that takes the number of characters that each text has afterwards.
    """
    own, at, names = numbered(docs), place(docs, text), docs.columns
    known, uid = identity(own, place(docs, key), at)
    keyed = known.select(F.col(place(docs, key)).cast("long").alias("doc_id"), F.col(uid).alias("uid"), F.col(at).cast("string").alias("text"))
    lost = _lost(LineIndex.of(keyed, min_chars, min_docs)).select(F.col("doc_id").alias("_d"), F.col("uid").alias("_u"), F.col("keys").alias("_keys")).hint("merge")  # grows with the documents: never broadcast
    match = F.col(place(docs, key)).cast("long").eqNullSafe(F.col("_d")) & (F.col(uid) == F.col("_u"))
    with_keys = known.join(lost, match, "left").select(*own.columns, "_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, new = batch.column(at), []
            for t, keys in zip(old, batch.column("_keys"), strict=True):
                if not keys.is_valid or not t.is_valid:
                    new.append(t.as_py())
                    continue
                gone = set(keys.as_py())
                new.append(b"\n".join(x for x in t.as_py().encode().split(b"\n") if not (long_enough(k := line_key(x), min_chars) and digest(k) in gone)).decode())
            kept = [c for c in batch.schema.names if c != "_keys"]
            yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if c == at else batch.column(c) for c in kept], kept)

    left = with_keys.mapInArrow(run, own.schema)
    if length is not None:
        left = left.withColumn(place(docs, length), F.length(at).cast(own.schema[place(docs, length)].dataType))
    return left.toDF(*names)


def keyed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    known, uid = identity(core(docs, key, text), "doc_id", "text")
    return known.select("doc_id", F.col(uid).alias("uid"), "text")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256, kept_text (the lines that stay, joined by newlines)."""
    keyed = keyed_rows(docs, key, text)
    lost = _lost(LineIndex.of(keyed, min_chars, min_docs)).select(F.col("doc_id").alias("_d"), F.col("uid").alias("_u"), "keys").hint("merge")  # grows with the documents: never broadcast
    with_keys = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("uid") == F.col("_u")), "left").select("doc_id", "uid", "text", "keys")
    return with_keys.mapInArrow(_rebuilt(min_chars), "doc_id long, uid long, n_lines long, n_dropped long, kept_sha256 string, kept_text string").drop("uid")
