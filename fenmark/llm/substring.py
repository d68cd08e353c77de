"""Substring dedup by de Bruijn compaction.

Every window of ``size`` consecutive words is an edge of a de Bruijn graph (from
its first size - 1 words to its last).  Edges are not shuffled one by one:

1.  Each document is cut into *paths*, runs of consecutive edges that share
    one minimizer (the occurrence of their least ``anchor``-word k-mer by hash).  Equal
    edges have equal minimizers, so they lie on paths of one minimizer.  There
    is about one path per (size - anchor + 2) / 2 words.
2.  Minimizers are counted; a path whose minimizer occurs once holds no
    repeated edge and is dropped by a join.
3.  A path is compacted: its copies are one word sequence, and all but the one of the
    earliest source coordinates (document, first word; an aggregate) repeat all of its edges.
4.  Where a minimizer has paths of several sequences (a branch), the first copies of these
    may share some edges.  Only their edges are spelled out, from the text at their
    source coordinates, and resolved one by one.
5.  Words covered by a repeated edge that has an earlier coordinate go.

Sequences count as equal if two independent 64-bit hashes agree (minimizer and
path, or two window hashes).  All groups are reduced by partial aggregates (min,
max, count), and joins are plain equi-joins that AQE may split, so copies that
make up a third of the corpus meet in no single task.

A null text is an empty one; rows of one doc_id and different texts are judged
apart (neither comes before the other at the same position); repeated rows
are each other's equals and lose the same words; a null doc_id comes last; an empty table gives an empty result; texts
and words of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm.runtime import core, identity, written

WINDOW, ANCHOR = 20, 6

_PATHS = "mini long, path long, doc_id long, uid long, start int, edges int"


def _paths(size: int, anchor: int):
    """Per batch of (doc_id, uid, text): the documents' paths."""
    reach = size - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids = batch.column("doc_id"), batch.column("uid")
            for chunk in K.chunks(batch.column("text")):
                words = chunk.words(~K.SPACE)
                at = words.windows(size)
                if not len(at):
                    continue
                mini = words.runs(0).at(np.arange(len(words) - anchor + 1), anchor)
                place = at + np.lib.stride_tricks.sliding_window_view(mini, reach)[at].argmin(1)
                row = words.rows()[at]
                new = np.ones(len(at), bool)
                new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                edges = np.diff(np.append(first, len(at)))
                start, row = at[first], row[first]
                path = words.runs(1).at(start, edges + size - 1)
                own = pa.array(row + chunk.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini[place[first]].view(np.int64)), pa.array(path.view(np.int64)), ids.take(own), uids.take(own), pa.array((start - words.first[row]).astype(np.int32)), pa.array(edges.astype(np.int32))],
                    ["mini", "path", "doc_id", "uid", "start", "edges"],
                )

    return run


def _edges(size: int):
    """Per batch of (doc_id, uid, text, spans): the edges that start in the spans, spelled by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids = batch.column("doc_id"), batch.column("uid")
            for chunk in K.chunks(batch.column("text")):
                words = chunk.words(~K.SPACE)
                spans = batch.column("spans").slice(chunk.rows.start, chunk.n)
                row, low, count = _spans(spans)
                if not len(row):
                    continue
                at = np.repeat(words.first[row] + low - np.cumsum(count) + count, count) + np.arange(count.sum())
                row = np.repeat(row, count)
                own = pa.array(row + chunk.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(words.runs(s).at(at, size).view(np.int64)) for s in (1, 2)), ids.take(own), uids.take(own), pa.array((at - words.first[row]).astype(np.int32))],
                    ["edge", "check", "doc_id", "uid", "start"],
                )

    return run


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of words of packed spans (first << 32 | number)."""
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), count), flat >> 32, flat & 0xFFFFFFFF


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (doc_id, text, spans): what is left without the spans' words."""
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            words = chunk.words(~K.SPACE)
            row, low, count = _spans(batch.column("spans").slice(chunk.rows.start, chunk.n))
            gone = K.cover(len(words), words.first[row] + low, words.first[row] + low + count)
            removed = K.sums_by_row(words.first, gone)
            kept = []
            for i in range(chunk.n):
                own = chunk.text(i).split()
                if removed[i]:
                    mark = gone[words.first[i] : words.first[i + 1]]
                    own = [own[j] for j in np.flatnonzero(~mark)]
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.rows.start, chunk.n), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def repeated_spans(keyed: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, uid, start, length): spans of words of keyed (doc_id, uid, text) that repeat earlier ones."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    paths = keyed.mapInArrow(_paths(size, anchor), _PATHS)
    often = paths.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1").select("mini")
    # Each aggregate is written before a join with it: the join then deals both sides anew, so that AQE may split
    # frequent keys, and the shuffle files behind the aggregate are free to go.
    often = written(often, "often")
    shared = written(paths.join(often, "mini"), "paths")
    sequences = written(shared.groupBy("mini", "path").agg(F.min(place).alias("earliest")), "distinct")
    branching = written(sequences.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1").select("mini"), "branching")
    later = F.col("place") != F.col("earliest")
    judged = written(shared.withColumn("place", place).join(sequences, ["mini", "path"]).select("mini", "doc_id", "uid", "start", "edges", later.alias("later")), "judged")
    # A later copy of a path repeats all of its edges.  The first of each path stays, unless edges of it are on other paths, too.
    whole = judged.where("later").select("doc_id", "uid", "start", (F.col("edges") + (size - 1)).alias("length"))
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("edges").cast("long"))
    open_ = judged.where("not later").join(branching, "mini").groupBy("doc_id", "uid").agg(F.collect_list(packed).alias("spans"))
    edges = written(_with(keyed, open_, "inner").mapInArrow(_edges(size), "edge long, check long, doc_id long, uid long, start int"), "edges")
    first = edges.groupBy("edge", "check").agg(F.count("*").alias("n"), F.min(place).alias("earliest")).where("n > 1")
    first = written(first, "first")
    single = edges.join(first, ["edge", "check"]).where(place != F.col("earliest")).select("doc_id", "uid", "start", F.lit(size).alias("length"))
    return whole.unionByName(single)


def _with(keyed: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """keyed with the spans of its rows; null ids find each other."""
    s = spans.select(F.col("doc_id").alias("_d"), F.col("uid").alias("_u"), "spans")
    return keyed.join(s, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("uid") == F.col("_u")), how).select("doc_id", "uid", "text", "spans")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by spaces)."""
    known, uid = identity(core(docs, key, text), "doc_id", "text")
    keyed = known.select("doc_id", F.col(uid).alias("uid"), "text")
    spans = repeated_spans(keyed, size, anchor)
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    of_doc = spans.groupBy("doc_id", "uid").agg(F.collect_list(packed).alias("spans"))
    return _with(keyed, of_doc, "left").drop("uid").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
