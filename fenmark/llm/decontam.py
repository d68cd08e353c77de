"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item becomes its windows of ``WINDOW`` consecutive words (an item of fewer
words is one window).  A window is the set of its ``SHINGLE``-word shingles, each with its
position; it occurs in a document only if all of them do, so the overlap that the
join asks for is the whole set and the necessary prefix, once shingles are
ordered by rarity, is the rarest one alone.

1.  Shingles of the benchmark are counted over all documents, in one pass.
2.  Each distinct window is filed under its rarest shingle, with the shingle's offset.
3.  Documents look up their shingles; a found one names the only place where the
    window could start (positional bound), which has to leave room for the window in the
    document (length bound).
4.  The window at that place is joined with the benchmark's windows as a whole, by two independent
    64-bit hashes of its words.

What the executors hold of the benchmark are bit tables of its shingles and places, ``MAX_BITS`` bits each at most, however large it is.
They only let a place through that step 4 turns down; counts, windows and items stay tables and meet documents in joins that
AQE may split.  Of the documents only found windows are shuffled.

Null or empty texts have no words and are never contaminated; items without words
or with a null id are left out, repeated items count once; repeated documents are judged
each on its own; an empty table of documents gives an empty result, an empty benchmark contaminates none.  Texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm.runtime import core, ddl, numbered, place, written

WINDOW, SHINGLE, MAX_BITS = 13, 5, 1 << 28
#: A document is contaminated if hits make up 1 / RATIO of its words.
RATIO = 20
_PIECE = 1 << 19

_WINDOWS = "item string, size int, shingle int, w1 long, w2 long, keys array<long>"
_FOUND = pa.list_(pa.struct([("size", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("starts", pa.list_(pa.int32()))]))
_FOUND_SQL = "array<struct<size: int, w1: long, w2: long, starts: array<int>>>"
_SAME = ["size", "w1", "w2"]


def shingle_keys(runs: K.Runs, n: int, shingle: int) -> np.ndarray:
    """The keys of all shingles of a size among n words."""
    return K.joined(runs.at(np.arange(n - shingle + 1), shingle), np.uint64(shingle)) if n >= shingle else np.zeros(0, np.uint64)


def place_keys(keys: np.ndarray, offset: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """The keys of windows of a size that hold a shingle at an offset."""
    return K.joined(keys, np.asarray(offset, np.uint64) * np.uint64(64) + np.asarray(size, np.uint64))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (item, text): windows, and the keys of each one's shingles in order."""
    for batch in batches:
        names = batch.column("item").to_pylist()
        for chunk in K.chunks(batch.column("text"), lower=True):
            words = chunk.words(K.ALNUM)
            one, two = words.runs(0), words.runs(1)
            keys = {s: shingle_keys(one, len(words), s) for s in range(1, SHINGLE + 1)}
            for i in range(chunk.n):
                lo, n = words.first[i], words.counts[i]
                if not n:
                    continue
                size = min(WINDOW, int(n))
                shingle = min(SHINGLE, size)
                at = np.arange(lo, lo + n - size + 1)
                sets = np.lib.stride_tricks.sliding_window_view(keys[shingle][lo : lo + n - shingle + 1].view(np.int64), size - shingle + 1)
                w1, w2 = (r.at(at, size).view(np.int64) for r in (one, two))
                for k in range(0, len(at), 4096):
                    own = slice(k, k + 4096)
                    m = len(w1[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[chunk.rows.start + i]] * m), pa.array([size] * m, pa.int32()), pa.array([shingle] * m, pa.int32()), pa.array(w1[own]), pa.array(w2[own]), pa.array(list(sets[own]), pa.list_(pa.int64()))],
                        ["item", "size", "shingle", "w1", "w2", "keys"],
                    )


class Bits:
    """A table of bits that tells keys which aren't in a set from those that may be."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.mask = table, np.uint64(8 * len(table) - 1)

    @classmethod
    def of(cls, keys: DataFrame, most: int = MAX_BITS) -> Bits:
        """Of a frame's one column of bigints: pieces of the table are put together by Spark, at most ``most`` bits reach the driver."""
        n = keys.count()
        bits = max(_PIECE, min(most, 1 << (16 * n).bit_length()))
        at = keys.toDF("k").select(F.col("k").bitwiseAND(F.lit(bits - 1)).alias("at")).distinct()

        def piece(group: pd.DataFrame) -> pd.DataFrame:
            own = np.zeros(_PIECE, bool)
            own[group["at"].to_numpy(np.int64) % _PIECE] = True
            return pd.DataFrame({"piece": [int(group["piece"].iloc[0])], "bits": [np.packbits(own, bitorder="little").tobytes()]})

        table = np.zeros(bits // 8, np.uint8)
        for r in at.withColumn("piece", F.floor(F.col("at") / _PIECE)).groupBy("piece").applyInPandas(piece, "piece long, bits binary").toLocalIterator():
            table[r.piece * (_PIECE // 8) : (r.piece + 1) * (_PIECE // 8)] = np.frombuffer(r.bits, np.uint8)
        return cls(table)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counter(bits, shingle_sizes: list[int]):
    """Per batch of texts: how often keys that may be the benchmark's occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            for chunk in K.chunks(batch.column("text"), lower=True):
                words = chunk.words(K.ALNUM)
                runs = words.runs(0)
                for size in shingle_sizes:
                    keys = shingle_keys(runs, len(words), size)
                    own, n = np.unique(keys[known.may_hold(keys)], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"key": own.view(np.int64), "n": n.astype(np.int64)})

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, offset, size = (batch.column(c).to_numpy() for c in ("key", "offset", "size"))
        yield pa.RecordBatch.from_arrays([pa.array(place_keys(key.view(np.uint64), offset, size).view(np.int64))], ["place"])


@dataclass(frozen=True)
class Index:
    """The benchmark, filed: its distinct windows (size, w1, w2), its items (size, w1, w2, item), and what finds places in documents."""

    windows: DataFrame
    items: DataFrame
    rarest: object
    places: object
    #: (shingle size, offset, window size) in use, a few dozen at most.
    kinds: list[tuple[int, int, int]]

    @classmethod
    def of(cls, docs: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", text: str = "text", most_bits: int = MAX_BITS) -> Index:
        """With rarity counted over all rows of docs."""
        context, own = docs.sparkSession.sparkContext, numbered(benchmark)
        named = own.select(F.col(place(benchmark, item)).cast("string").alias("item"), F.col(place(benchmark, item_text)).cast("string").alias("text")).where("item is not null")
        windows = written(named.mapInArrow(_item_windows, _WINDOWS), "windows")
        items = written(windows.select(*_SAME, "item").distinct(), "items")
        each = written(windows.dropDuplicates(_SAME).select(*_SAME, "shingle", F.posexplode("keys").alias("offset", "key")), "shingles")
        shingle_sizes = sorted(r.shingle for r in each.select("shingle").distinct().collect())
        bits = context.broadcast(Bits.of(each.select("key").distinct(), most_bits))
        texts = numbered(docs).select(F.col(place(docs, text)).cast("string").alias("text"))
        counts = written(texts.mapInArrow(_counter(bits, shingle_sizes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "rarity")
        first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset", "shingle")).alias("first")
        filed = written(each.join(counts, "key", "left").groupBy(*_SAME).agg(first).select(*_SAME, "first.*"), "filed")
        kinds = sorted((r.shingle, r.offset, r["size"]) for r in filed.select("shingle", "offset", "size").distinct().collect())
        rarest, places = Bits.of(filed.select("key").distinct(), most_bits), Bits.of(filed.select("key", "offset", "size").mapInArrow(_placed, "place long").distinct(), most_bits)
        return cls(filed.select(*_SAME), items, context.broadcast(rarest), context.broadcast(places), kinds)


def _finder(rarest, places, kinds: list[tuple[int, int, int]]):
    """Per chunk: words of each row, and the windows that stand where filed ones may: a list of (size, w1, w2, starts)."""

    def find(chunk: K.Chunk) -> tuple[np.ndarray, pa.Array]:
        words = chunk.words(K.ALNUM)
        one, starts, sizes = words.runs(0), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shingle in sorted({s for s, _, _ in kinds}):
            keys = shingle_keys(one, len(words), shingle)
            at = np.flatnonzero(rarest.value.may_hold(keys))
            for _, offset, size in (k for k in kinds if k[0] == shingle):
                own = at[places.value.may_hold(place_keys(keys[at], offset, size))] - offset
                own = own[(own >= 0) & (own + size <= len(words))]
                starts.append(own)
                sizes.append(np.full(len(own), size))
        start, size = np.concatenate(starts), np.concatenate(sizes)
        row = np.searchsorted(words.first, start, "right") - 1
        room = start + size <= words.first[row + 1]
        start, size, row = start[room], size[room], row[room]
        w1, w2 = one.at(start, size), _second(words, row).at(start, size) if len(start) else start.astype(np.uint64)
        order = np.lexsort((start, w2, w1, size, row))
        start, size, row, w1, w2 = (x[order] for x in (start, size, row, w1, w2))
        new, other = np.ones(len(start), bool), np.ones(len(start), bool)
        other[1:] = (row[1:] != row[:-1]) | (size[1:] != size[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        new[1:] = other[1:] | (start[1:] != start[:-1])
        head = np.flatnonzero(other[new])
        start, size, row, w1, w2 = (x[new] for x in (start, size, row, w1, w2))
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(start)), pa.int32()), pa.array((start - words.first[row]).astype(np.int32)))
        each = pa.StructArray.from_arrays([pa.array(size[head].astype(np.int32)), pa.array(w1[head].view(np.int64)), pa.array(w2[head].view(np.int64)), lists], fields=list(_FOUND.value_type))
        return words.counts.astype(np.int64), pa.ListArray.from_arrays(pa.array(np.searchsorted(row[head], np.arange(chunk.n + 1)), pa.int32()), each)

    return find


def _second(words: K.Words, row: np.ndarray) -> K.Runs:
    """Runs of the second hashes of the words of some rows; those of other rows are left 0."""
    out = np.zeros(len(words), np.uint64)
    own = np.flatnonzero(np.isin(words.rows(), np.unique(row)))
    out[own] = K.word_hashes(words.chunk.data, words.starts[own], words.ends[own], 1)
    return K.Runs(out)


def verdicts(found: DataFrame, index: Index) -> DataFrame:
    """(row, n_hit, items) of found (row, found): rows in which a benchmark window occurs."""
    each = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    hit = written(each.join(index.windows, _SAME, "left_semi"), "hits")
    spans = hit.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("size")).alias("e")))))).alias("spans"))
    # Spans by their first words: each adds the words that end beyond all before it.
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", none, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")), lambda a: a["n"].cast("long"))
    named = hit.join(index.items, _SAME).select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return written(spans.select("row", covered.alias("n_hit")).join(named, "row"), "verdicts")


def _contaminated(n_hit: str, n_words: str) -> F.Column:
    return (F.col(n_hit) > 0) & (F.lit(RATIO) * F.col(n_hit) >= F.col(n_words))


def judged(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    index = Index.of(docs, benchmark, text=text, most_bits=most_bits)
    find = _finder(index.rarest, index.places, index.kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text"), lower=True):
                n, found = find(chunk)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.rows.start, chunk.n), pa.array(n), found], ["doc_id", "n_words", "found"])

    rows = written(core(docs, key, text).mapInArrow(run, f"doc_id long, n_words long, found {_FOUND_SQL}").withColumn("row", F.monotonically_increasing_id()), "words")
    out = rows.join(verdicts(rows, index), "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated("n_hit", "n_words").alias("contaminated"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns unchanged, that aren't contaminated; only rows with a place that may be a window's are written and joined."""
    index, own, at = Index.of(docs, benchmark, text=text, most_bits=most_bits), numbered(docs), place(docs, text)
    find = _finder(index.rarest, index.places, index.kinds)

    def part(doubtful: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in K.chunks(batch.column(at), lower=True):
                    n, found = find(chunk)
                    keep = np.diff(found.offsets.to_numpy()) > 0
                    rows = batch.slice(chunk.rows.start, chunk.n)
                    if not doubtful:
                        yield rows.filter(pa.array(~keep))
                    elif keep.any():
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n), found], [*rows.schema.names, "n_words", "found"]).filter(pa.array(keep))

        return run

    doubtful = own.mapInArrow(part(True), f"{ddl(own)}, n_words long, found {_FOUND_SQL}").withColumn("row", F.monotonically_increasing_id())
    doubtful = written(doubtful, "doubtful")
    gone = doubtful.select("row", "n_words").join(verdicts(doubtful, index), "row").where(_contaminated("n_hit", "n_words")).select("row")
    back = doubtful.join(written(gone, "contaminated"), "row", "left_anti").select(*own.columns)
    return own.mapInArrow(part(False), own.schema).unionByName(back).toDF(*docs.columns)

