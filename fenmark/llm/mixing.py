"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

*Targets.*  The sources, ordered by code point with null last, have weights
that repeat ``WEIGHTS``; they share ``SHARE`` of all words by weight, none above ``MOST`` times
its own words, the excess being shared again by weight.  They are a table, and its rounds of sharing are aggregates.

*Quotas.*  A source whose target is p whole passes and a rest takes each document p times,
and of one more pass exactly the rest's number of words: as many whole blocks of ``BLOCK`` words as it holds, and the words left over.

*Tree.*  The output shards are common to all sources, about ``SHARD_BLOCKS`` blocks each.  Documents go to them by hash, and each source's quota is split down a
binary tree over the shards: a node deals its blocks to its two halves by a hypergeometric draw from the blocks they
hold (and the few words left over likewise from the words that remain), which is how a random sample without replacement
would fall on them.  Draws are exact at any size, by ratios of uniforms.  Each is seeded by its node's
place, so they depend on neither partitioning nor retries.  A task takes ``LEVELS`` levels of the tree, of one source, at a time.

*Blocks.*  Within a shard and source, documents stand in a random order, their words are cut into
blocks, and the quota's number of them is drawn by a permutation; words left over come from the first blocks not drawn.  However
large a source is, no task gathers more than a shard.

Null texts have size 0 and are taken 0 times; rows that repeat a document are documents of
their own, in the same shard; null doc_ids are allowed; an empty table gives an empty mix; texts of any length are one document of one shard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm.runtime import core, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, SHARD_BLOCKS, LEVELS, SEED = 64, 1024, 12, 11


def rng(*place: object) -> np.random.Generator:
    return np.random.default_rng(np.frombuffer(hashlib.sha256(repr((SEED, *place)).encode()).digest(), np.uint64))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, words) -> (source, words, target), one row a source."""
    # Places in the order of code points, from the sorted parts' sizes: no task sees all sources.
    parts = written(sizes.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    known = written(parts.withColumn("part", part).join(before, "part").select("source", "words", weight.alias("weight")), "weights")
    # A source is full if its limit is below its part of what the others leave; each round finds more of them.
    limit, left, total, full = F.col("words") * MOST, None, None, None
    while True:
        is_full = F.lit(False) if left is None else F.lit(left) * F.col("weight") / F.lit(total) > limit
        r = known.agg(F.sum("words").alias("words"), F.coalesce(F.sum(F.when(is_full, limit)), F.lit(0)).alias("gone"), F.sum(F.when(~is_full, F.col("weight"))).alias("total"), F.count(F.when(is_full, 1)).alias("full")).first()
        if full == r.full or not r.total:
            break
        left, total, full = SHARE * r.words - r.gone, r.total, r.full
    if left is None:
        return known.select("source", "words", limit.cast("double").alias("target"))
    return known.select("source", "words", F.least(F.lit(left) * F.col("weight") / F.lit(total), limit.cast("double")).alias("target"))


def _log_factorial_step(a: int, d: int) -> float:
    """log((a + d)! / a!), without loss of digits where a is large."""
    x = d / a if a else 1.0
    if a < 1e6 or abs(x) > 1e-3:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    bend = x * x * (-0.5 + x * (1 / 3 + x * (-0.25 + x * 0.2)))  # log1p(x) - x
    return d * math.log(a) + a * bend + (d + 0.5) * math.log1p(x) + (1 / (a + d) - 1 / a) / 12


def hypergeometric(good: int, bad: int, n: int, draw: np.random.Generator) -> int:
    """How many of n that are drawn without replacement from good + bad are good, at any size.

    The ratio of uniforms (Stadlober): the hat of a unimodal distribution's square root, and exact acceptance by the chance's ratio to the mode's.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    every = good + bad
    mean = n * good / every
    spread = mean * bad / every * (every - n) / max(1, every - 1)
    width = 1.7155277699214135 * math.sqrt(spread + 0.5) + 0.8989161620588988  # 2 sqrt(2 / e), 3 - 2 sqrt(3 / e)
    mode = min(max((n + 1) * (good + 1) // (every + 2), low), high)
    while True:
        u, v = 1 - draw.random(), draw.random()
        x = mean + 0.5 + width * (v - 0.5) / u
        if not low <= x < high + 1:
            continue
        k = int(x)
        d = k - mode
        ratio = -sum(_log_factorial_step(a, s * d) for a, s in ((mode, 1), (good - mode, -1), (n - mode, -1), (bad - n + mode, 1)))
        if 2 * math.log(u) <= ratio:
            return k


def split(blocks: np.ndarray, words: np.ndarray, quota: tuple[int, int], levels: int, place: tuple) -> np.ndarray:
    """The quota (blocks, words left over) of a node dealt to its 2 ** levels descendants, which hold these blocks and words.

    place is (source, depth below the root, number among the nodes of that depth).
    """
    if not levels:
        return np.array([quota], np.int64)
    half, (source, depth, node), draw = 1 << (levels - 1), place, rng("node", *place)
    held, rest = (int(x[:half].sum()) for x in (blocks, words))
    b = hypergeometric(held, int(blocks.sum()) - held, quota[0], draw)
    # What remains of either half's words once its blocks are gone.
    over, other = rest - b * BLOCK, int(words.sum()) - rest - (quota[0] - b) * BLOCK
    w = hypergeometric(over, other, quota[1], draw)
    sides = ((blocks[:half], words[:half], (b, w), 2 * node), (blocks[half:], words[half:], (quota[0] - b, quota[1] - w), 2 * node + 1))
    return np.concatenate([split(x, y, q, levels - 1, (source, depth + 1, n)) for x, y, q, n in sides])


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, digest, row) per row: a hash of the text, which orders rows of one doc_id, and a number of the row's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                n = chunk.words(~K.SPACE).counts.astype(np.int64)
                ids, src = (batch.column(c).slice(chunk.rows.start, chunk.n) for c in ("doc_id", "source"))
                own = K.byte_hashes(chunk.data, chunk.offsets[:-1], chunk.offsets[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, src, pa.array(n), pa.array(own)], ["doc_id", "source", "size", "digest"])

    return core(docs, key, text, source=source).mapInArrow(run, "doc_id long, source string, size long, digest long").withColumn("row", F.monotonically_increasing_id())


def _dealer(depth: int, levels: int):
    def deal(group: pd.DataFrame) -> pd.DataFrame:
        """The quota of a node, dealt to its descendants ``levels`` levels below."""
        first, parent = group.iloc[0], int(group["parent"].iloc[0])
        blocks, words = np.zeros(1 << levels, np.int64), np.zeros(1 << levels, np.int64)
        at = (group["child"] - (parent << levels)).to_numpy(np.int64)
        blocks[at], words[at] = group["blocks"], group["words"]
        source = None if pd.isna(first["source"]) else first["source"]
        quota = split(blocks, words, (int(first["quota"]), int(first["over"])), levels, (source, depth, parent))[at]
        return pd.DataFrame({"source": group["source"], "node": group["child"], "quota": quota[:, 0], "over": quota[:, 1]})

    return deal


def _quotas(cells: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(source, node, quota, over) of the shards: the tree's draws from the root down."""
    quotas = roots.select("source", F.lit(0).cast("long").alias("node"), "quota", "over")
    for level in range(0, max(depth, 1), LEVELS):
        step = min(LEVELS, depth - level)
        child = F.shiftright("shard", depth - level - step)
        children = cells.groupBy("source", child.alias("child")).agg(F.sum("blocks").alias("blocks"), F.sum("words").alias("words")).withColumn("parent", F.shiftright("child", step))
        q = quotas.withColumnsRenamed({"source": "_s", "node": "_n"})
        under = children.join(q, children.source.eqNullSafe(q["_s"]) & (F.col("parent") == F.col("_n"))).drop("_s", "_n")
        quotas = written(under.groupBy("source", "parent").applyInPandas(_dealer(level, step), "source string, node long, quota long, over long"), "quotas")
    return quotas


def _draw(group: pd.DataFrame) -> pd.DataFrame:
    """What a shard takes: per row the spans of words drawn (first << 32 | number)."""
    return pd.concat([_draw_source(own) for _, own in group.groupby("source", sort=False, dropna=False)])


def _draw_source(group: pd.DataFrame) -> pd.DataFrame:
    source = None if pd.isna(group["source"].iloc[0]) else group["source"].iloc[0]
    draw = rng("shard", source, int(group["shard"].iloc[0]))
    group = group.sort_values(["doc_id", "digest", "size", "row"], kind="stable", na_position="last").iloc[draw.permutation(len(group))]
    size, quota, over = group["size"].to_numpy(np.int64), int(group["quota"].iloc[0]), int(group["over"].iloc[0])
    taken = np.zeros(int(size.sum()), bool)
    whole = len(taken) // BLOCK
    taken[: whole * BLOCK].reshape(whole, BLOCK)[draw.permutation(whole)[:quota]] = True
    taken[np.flatnonzero(~taken)[:over]] = True
    ends = np.cumsum(size)
    edge = np.zeros(len(taken) + 1, bool)
    edge[np.append(0, ends)] = True  # spans end with their rows
    now, last = np.append(taken, False), np.append(False, taken)
    start, end = np.flatnonzero(now & (~last | edge)), np.flatnonzero(last & (~now | edge))
    at = np.searchsorted(ends, start, "right")
    spans = ((start - ends[at] + size[at]) << 32) | (end - start)
    cut = np.flatnonzero(np.diff(np.append(-1, at)))
    return pd.DataFrame({"row": group["row"].to_numpy()[at[cut]], "drawn": np.add.reduceat(end - start, cut) if len(cut) else [], "spans": np.split(spans, cut[1:]) if len(cut) else []})


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sized rows with their source's numbers, and what is drawn of them for the rest of a pass.

    rows: doc_id, source, size, digest, row, source_size, target, passes, shard, quota and over (blocks and words of the shard's part of the source)
    drawn: row, drawn (words), spans (first << 32 | number of words)
    """
    rows = written(sized(docs, key, text, source), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("words")))
    passes = F.when(F.col("words") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("words")))).otherwise(0).cast("int")
    rest = F.when(F.col("passes") < MOST, F.least(F.col("words"), F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("words"))))).otherwise(0).cast("long")
    known = written(goal.withColumn("passes", passes).withColumn("rest", rest).select(F.col("source").alias("_s"), F.col("words").alias("source_size"), "target", "passes", "rest"), "targets")
    shards = max(1, -(-(known.agg(F.sum("source_size")).first()[0] or 0) // (BLOCK * SHARD_BLOCKS)))
    depth = (shards - 1).bit_length()
    placed = rows.join(known, rows.source.eqNullSafe(known["_s"])).drop("_s").withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", F.lit(SEED)), F.lit(shards)))
    cells = written(placed.groupBy("source", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.floor(F.col("words") / BLOCK)), "cells")
    held = cells.groupBy("source").agg(F.sum("blocks").alias("blocks"))
    roots = held.join(known, held.source.eqNullSafe(known["_s"])).withColumn("quota", F.least("blocks", F.floor(F.col("rest") / BLOCK))).select("source", "quota", (F.col("rest") - F.col("quota") * BLOCK).alias("over"))
    q = _quotas(cells, roots, depth).withColumnsRenamed({"source": "_s", "node": "_n"}).hint("merge")  # as many as cells, which grow with the documents
    placed = written(placed.join(q, placed.source.eqNullSafe(q["_s"]) & (F.col("shard") == F.col("_n"))).drop("_s", "_n"), "placed")
    drawn = placed.where("quota + over > 0 and size > 0").groupBy("shard").applyInPandas(_draw, "row long, drawn long, spans array<long>")
    return placed, drawn


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words of it that the mix takes, repeats counted)."""
    rows, drawn = plan(docs, key, text, source)
    return rows.join(drawn.select("row", "drawn"), "row", "left").select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.coalesce("drawn", F.lit(0))).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: doc_id, source, shard, pass, text, n_words; one row per document and pass that takes some of it.

    A whole pass has the document's text; the rest's pass has the words
    drawn, in the document's order.  Shards are shuffled by ``rank``, a hash of document and pass.
    """
    rows, drawn = plan(docs, key, text, source)
    planned = rows.join(drawn, "row", "left").where("passes > 0 or drawn is not null").select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "row", "source", "shard", "passes", "spans")
    once = sized_texts(docs, key, text)
    if core(docs, key, text).groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count():
        once = once.dropDuplicates(["doc_id", "digest"])
    return planned.join(once, planned["_d"].eqNullSafe(once.doc_id) & (planned["_g"] == once.digest)).select("doc_id", "source", "shard", "passes", "spans", "text").mapInArrow(_passes, "doc_id long, source string, shard long, pass int, rank long, n_words long, text string")


def sized_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, digest, text) with sized()'s digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                own = K.byte_hashes(chunk.data, chunk.offsets[:-1], chunk.offsets[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.rows.start, chunk.n), pa.array(own), batch.column("text").slice(chunk.rows.start, chunk.n)], ["doc_id", "digest", "text"])

    return core(docs, key, text).mapInArrow(run, "doc_id long, digest long, text string")


_MIXED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("shard", pa.int64()), ("pass", pa.int32()), ("rank", pa.int64()), ("n_words", pa.int64()), ("text", pa.string())])


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pass; a few rows at a time, so that few texts are Python objects at once."""
    for batch in batches:
        out, size = [], 0
        for k in range(batch.num_rows):
            r = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
            text = r["text"] or ""
            own = text.encode().split()
            parts = [(k, len(own), text) for k in range(r["passes"])]
            if r["spans"]:
                words = [w for x in r["spans"] for w in own[x >> 32 : (x >> 32) + (x & 0xFFFFFFFF)]]
                parts.append((r["passes"], len(words), b" ".join(words).decode()))
            for number, n, part in parts:
                rank = hashlib.sha256(repr((SEED, r["doc_id"], number)).encode()).digest()[:8]
                out.append({"doc_id": r["doc_id"], "source": r["source"], "shard": r["shard"], "pass": number, "rank": int.from_bytes(rank, "big", signed=True), "n_words": n, "text": part})
                size += len(part)
            if size > K.CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist(out, _MIXED)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _MIXED)
