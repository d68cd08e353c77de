"""Toxicity by a convolutional text classifier, trained here in NumPy.

A word (lower-case letters and digits) is the sum of hashed embeddings: of itself and of its first ``STEMS`` bytes, so that a
form which was never met shares what its stem has learned.  Filters of several widths run over a text's words; each one's greatest response, which
is at least 0, is its feature (max pooling), and a logistic layer scores the features.  One toxic word or phrase in a very long
text is therefore as visible as in a short one.

*Learning.*  From all labelled documents, whole texts, but for every ``KEPT``-th (by hash), which calibrates.  A start is made in the driver on at most about ``TRAIN_DOCS``
of each class, of which only hashed words get there.  If there are more, all of them are dealt to shards of about ``SHARD``; each shard goes on from the start over all its documents, and the model is the start and the mean of
the shards' changes, each number's weighed by the squares of its gradients in the shard (a word met in one shard keeps what it learned there).  Rows that ``held_out`` marks are never read for it.
A run is seeded and what it learns from is sorted: reruns and partitionings agree.

*Thresholds.*  Per language a threshold on the raw score is chosen that separates all kept-back documents best (F1), from counts by language, class and raw score in steps of 1 / ``STEP``.
The language is that which ``langid`` reads from the text; those with too few documents of either class take the threshold of all.
The score is the logistic function of the raw score less the threshold, so 0.5 is every language's threshold.

A null or empty text, or one without words, has a score, that of a text with no response at all.  Null doc_ids are not held out and not learned from; of labels that repeat
an id the greatest counts, and equal rows count once; without labels of both classes every score is 0; an empty table gives an empty result; texts of any length are read whole, a block of words at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm import langid
from fenmark.llm.runtime import core, discard, numbered, place, written

#: Labelled documents of each class that make the start, at most about; every KEPT-th of all calibrates; documents of a shard.
TRAIN_DOCS, KEPT, SHARD = 3000, 5, 8192
#: Steps of a raw score in 1, and its greatest size, by which kept-back documents are counted; pieces that the shards' changes of embeddings are added up in.
STEP, MOST, PIECES = 256, 64, 16
#: Rows of the embedding table (two bytes tell them), numbers a row, widths of filters, filters of each width, bytes of a word's stems.
BUCKETS, DIM, WIDTHS, FILTERS, STEMS = 1 << 16, 12, (1, 2, 3), 12, (4, 5, 6)
#: Passes over the start's documents and over a shard's (more if that makes fewer than LEAST_STEPS batches); the share of words that are read by their stems alone, anew in each pass.
EPOCHS, PASSES, LEAST_STEPS, BATCH, RATE, SEED, STEMS_ALONE = 8, 2, 80, 64, 0.1, 11, 0.5
#: Documents of either class that a language's own threshold needs; words of a block.
ENOUGH, BLOCK = 20, 1 << 16
_PAD = max(WIDTHS) - 1


def word_ids(chunk: K.Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table of each word (itself, then its stems), and where each row's words begin; chunks are lower-cased."""
    words = chunk.words(K.ALNUM)
    spans = [words.ends, *(np.minimum(words.ends, words.starts + k) for k in STEMS)]
    # Seeds keep a short word apart from its stem of the same bytes; stems of different lengths share theirs.
    hashes = [K.word_hashes(chunk.data, words.starts, e, int(j > 0)) for j, e in enumerate(spans)]
    return np.column_stack([(h % np.uint64(buckets)).astype(np.int32) for h in hashes]), words.first


@dataclass
class Model:
    """Embeddings, a matrix and a bias for each width, and the logistic layer."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    intercept: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Model:
        filters = {w: rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        embedding = np.append(rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM)), axis=0).astype(np.float32)  # the last row is no word
        return cls(embedding, filters, bias, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        out = self.embedding[ids[:, 0]].copy()
        for j in range(1, ids.shape[1]):
            out += self.embedding[ids[:, j]]
        return out

    def responses(self, words: np.ndarray) -> np.ndarray:
        """Each filter's response at each word; the last ``_PAD`` rows are what windows may reach into, and have none."""
        n, out = len(words) - _PAD, []
        for w in WIDTHS:
            at = words[:n] @ self.filters[w][0]
            for o in range(1, w):
                at += words[o : o + n] @ self.filters[w][o]
            out.append(at + self.bias[w])
        return np.concatenate(out, axis=1)

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's features; its words are ids[first[i] : first[i + 1]], and windows end in zeros after its last one."""
        out = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        for low in range(0, len(ids), BLOCK):
            high = min(low + BLOCK, len(ids))
            reach = min(high + _PAD, len(ids))
            rows = np.arange(np.searchsorted(first, low, "right") - 1, np.searchsorted(first, high))
            rows = rows[first[rows + 1] > first[rows]]
            begin, end = np.maximum(first[rows], low), np.minimum(first[rows + 1], reach)
            words, size = self.embedded(ids[low:reach]), end - begin
            # A text's words of this block, then zeros: what a window reaches into is the text's own or nothing.
            to = np.arange(len(rows)) * _PAD + np.append(0, np.cumsum(size[:-1])) if len(rows) else np.zeros(0, np.int64)
            spread = np.zeros((int(size.sum()) + len(rows) * _PAD + _PAD, DIM), np.float32)
            spread[np.repeat(to - (begin - low), size) + np.repeat(begin - low, size) + _within(size)] = words[np.repeat(begin - low, size) + _within(size)]
            own = np.minimum(first[rows + 1], high) - begin  # windows that begin in this block
            bounds = np.column_stack([to, to + own]).ravel()
            found = np.maximum.reduceat(self.responses(spread), bounds, axis=0)[::2] if len(rows) else out[:0]
            out[rows] = np.maximum(out[rows], found)
        return out

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.intercept


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Adagrad:
    """Steps that shrink with the squares of the gradients so far."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.seen = x, np.full(x.shape, 1e-6, np.float32)

    def step(self, g: np.ndarray, at=slice(None)) -> None:
        self.seen[at] += g * g
        self.x[at] -= RATE * g / np.sqrt(self.seen[at])


def train(ids: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> Model:
    """A model of texts (each one's word ids) and labels; classes weigh the same."""
    return _started(ids, y, seed)[0]


def _layers(m: Model) -> list[_Adagrad]:
    return [_Adagrad(m.embedding), *(_Adagrad(m.filters[w]) for w in WIDTHS), *(_Adagrad(m.bias[w]) for w in WIDTHS), _Adagrad(m.weights)]


def _started(ids: list[np.ndarray], y: np.ndarray, seed: int) -> tuple[Model, list[_Adagrad]]:
    rng = np.random.default_rng(seed)
    m = Model.fresh(rng)
    layers = _layers(m)
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    _learn(m, layers, ids, y, weight, rng, max(EPOCHS, LEAST_STEPS // (1 + len(y) // BATCH)))
    return m, layers


def _learn(m: Model, layers: list[_Adagrad], ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, passes: int) -> None:
    """Changes m in so many passes over texts, in batches.  The loss' gradient goes through the windows of the greatest responses alone."""
    empty = np.zeros((_PAD, DIM), np.float32)
    for _ in range(passes):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            texts = [np.where((rng.random(len(ids[r])) < STEMS_ALONE)[:, None] & (np.arange(1 + len(STEMS)) == 0), BUCKETS, ids[r]) for r in rows]
            pooled, at, words = np.zeros((len(rows), len(WIDTHS) * FILTERS), np.float32), np.zeros((len(rows), len(WIDTHS) * FILTERS), np.int64), []
            for j, own in enumerate(texts):
                words.append(np.concatenate([m.embedded(own), empty]))
                if len(own):
                    found = m.responses(words[-1])
                    at[j] = found.argmax(0)
                    pooled[j] = np.maximum(found[at[j], np.arange(found.shape[1])], 0)
            e = (weight[rows] * (sigmoid(m.raw(pooled)) - y[rows])).astype(np.float32) / len(rows)
            back = np.where(pooled > 0, e[:, None] * m.weights, 0)
            layers[-1].step(e @ pooled + 1e-4 * m.weights)
            m.intercept -= RATE * float(e.sum())
            touched, moved = [], []
            for i, w in enumerate(WIDTHS):
                g, filters = back[:, i * FILTERS : (i + 1) * FILTERS], m.filters[w].copy()
                step = np.zeros_like(filters)
                for j, own in enumerate(texts):
                    live = np.flatnonzero(g[j])
                    for o in range(w):
                        where = at[j, i * FILTERS + live] + o
                        step[o][:, live] += words[j][where].T * g[j, live]
                        inside = where < len(own)
                        touched.append(own[where[inside]])
                        moved.append((filters[o][:, live] * g[j, live]).T[inside])
                layers[1 + i].step(step)
                layers[1 + len(WIDTHS) + i].step(g.sum(0))
            if touched:
                rows_, delta = np.concatenate(touched), np.concatenate(moved)
                known, back_to = np.unique(rows_.ravel(), return_inverse=True)
                total = np.zeros((len(known), DIM), np.float32)
                np.add.at(total, back_to.ravel(), np.repeat(delta, rows_.shape[1], axis=0))
                layers[0].step(total[known < BUCKETS], known[known < BUCKETS])


def _small(m: Model) -> np.ndarray:
    """All numbers of a model but its embeddings and intercept."""
    return np.concatenate([*(m.filters[w].ravel() for w in WIDTHS), *(m.bias[w] for w in WIDTHS), m.weights])


def _shard_changes(shard: int, m: Model, layers: list[_Adagrad], ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What a shard's documents change in a model (which is overwritten): (piece, rows of embeddings, change, squares of gradients), piece -1 for all else."""
    before, small, seen, intercept = m.embedding.copy(), _small(m), [x.seen.copy() for x in layers], m.intercept
    _learn(m, layers, ids, y, weight, np.random.default_rng([SEED, shard]), max(PASSES, LEAST_STEPS // (1 + len(y) // BATCH)))
    gained = [x.seen - s for x, s in zip(layers, seen, strict=True)]
    changed = np.flatnonzero(gained[0].any(1))
    for piece in range(PIECES):
        own = changed[changed % PIECES == piece]
        yield piece, own, m.embedding[own] - before[own], gained[0][own]
    rest = np.append(_small(m) - small, m.intercept - intercept)
    yield -1, np.arange(len(rest)), rest, np.append(np.concatenate([g.ravel() for g in gained[1:]]), len(y))


def _changed(m: Model, piece: int, at: np.ndarray, change: np.ndarray) -> None:
    """Adds a mean change to a model."""
    if piece >= 0:
        m.embedding[at] += change.reshape(len(at), DIM)
        return
    parts = [*(m.filters[w] for w in WIDTHS), *(m.bias[w] for w in WIDTHS), m.weights]
    whole, low = np.zeros(sum(x.size for x in parts) + 1, np.float32), 0
    whole[at] = change
    for x in parts:
        x += whole[low : low + x.size].reshape(x.shape)
        low += x.size
    m.intercept += float(whole[low])


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def best_threshold(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between raw scores at which F1 is greatest; of equally good gaps, the widest."""
    order = np.argsort(-raw, kind="stable")
    r, tp, fp = raw[order], np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * tp / (tp + fp + (weight * y).sum())
    below = np.append(r[1:], r[-1] - 2.0)
    f1 = np.where(r > below, f1, -1.0)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(r[best] - below[best])]
    return float((r[k] + below[k]) / 2)


@dataclass
class Classifier:
    """A trained model, the profiles that languages are read by, and a threshold for each language (that of all is under None)."""

    model: Model | None
    profiles: langid.Profiles
    thresholds: dict[str | None, float]

    def languages(self, column: pa.Array) -> list[str]:
        known = self.profiles.sorted()
        return [langid.predict(t.as_py(), known)[0] for t in column]

    def raw(self, column: pa.Array) -> np.ndarray:
        """Each text's raw score."""
        return np.concatenate([self.model.raw(self.model.pooled(*word_ids(c))) for c in K.chunks(column, lower=True)] or [np.zeros(0)]).astype(float)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Each text's score."""
        if self.model is None:
            return np.zeros(len(column))
        raw = self.raw(column)
        languages = self.languages(column) if len(self.thresholds) > 1 else [None] * len(column)
        return sigmoid(raw - np.array([self.thresholds.get(x, self.thresholds[None]) for x in languages]))


def _kept(seed: int = SEED + 1) -> Column:
    """Whether a labelled text (doc_id, hash) calibrates."""
    return F.pmod(F.xxhash64("hash", "doc_id", F.lit(seed)), F.lit(KEPT)) == 0


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, hash) of the rows that may be learned from, and the different ones (doc_id, hash, y) that have a label, in a table without the texts."""
    own = core(docs, key, text).where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("hash", F.xxhash64("doc_id", "text"))
    told = numbered(labels).select(F.col(place(labels, key)).cast("long").alias("doc_id"), F.col(place(labels, label)).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return own, written(own.select("doc_id", "hash").distinct().join(told.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id"), "labelled")


def _sample(own: DataFrame, known: DataFrame, n: dict[int, int], train_docs: int) -> DataFrame:
    """(doc_id, hash, y, text) of at most about train_docs labelled texts of each class; the chosen ones, which are few whatever the corpus, are broadcast to where the texts are read."""
    rank = F.pmod(F.xxhash64("hash", F.lit(SEED)), F.lit(1 << 32))
    limit = F.coalesce(*(F.when(F.col("y") == y, F.lit(int(min(1.0, train_docs / c) * (1 << 32)))) for y, c in n.items()), F.lit(0))
    few = F.broadcast(known.where(~_kept() & (rank < limit)))
    return own.join(few, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])


def _hashed(column: pa.Array) -> list[np.ndarray]:
    """Each text's word ids."""
    out: list[np.ndarray] = []
    for chunk in K.chunks(column, lower=True):
        ids, first = word_ids(chunk)
        out += [ids[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def _go_on(m: Model, layers: list[_Adagrad], own: DataFrame, known: DataFrame, n: dict[int, int]) -> Model:
    """The start m and the mean of the changes that all shards of labelled documents make in it."""
    total = n[0] + n[1]
    shard = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(-(-total // SHARD))).cast("int").alias("shard")
    start = own.sparkSession.sparkContext.broadcast(pickle.dumps((m, [x.seen for x in layers])))

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        made = {"piece": [], "shard": [], "at": [], "change": [], "squares": []}
        label = dict(zip(zip(told["doc_id"].to_pylist(), told["hash"].to_pylist(), strict=True), told["y"].to_pylist(), strict=True))
        here = list(zip(texts["doc_id"].to_pylist(), texts["hash"].to_pylist(), strict=True))
        first = {k: i for i, k in enumerate(here) if k in label}  # rows alike count once
        keys = sorted(first)
        if keys:
            model, seen = pickle.loads(start.value)
            at = _layers(model)
            for layer, x in zip(at, seen, strict=True):
                layer.seen = x
            y = np.array([label[k] for k in keys])
            ids = _hashed(texts["text"].take(pa.array([first[k] for k in keys])).combine_chunks())
            own_shard = told["shard"][0].as_py()
            for piece, rows, change, squares in _shard_changes(own_shard, model, at, ids, y, np.where(y == 1, total / (2 * n[1]), total / (2 * n[0]))):
                for c, v in zip(made, (piece, own_shard, rows.astype(np.int32).tobytes(), change.astype(np.float32).tobytes(), squares.astype(np.float32).tobytes()), strict=True):
                    made[c].append(v)
        return pa.table([pa.array(v, t) for v, t in zip(made.values(), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], list(made))

    def mean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, piece, weighed, squares = 1, None, None, None
        for batch in rows:
            for r in batch.to_pylist():
                piece, at = r["piece"], np.frombuffer(r["at"], np.int32)
                if weighed is None:
                    dim = DIM if piece >= 0 else 1
                    weighed, squares = (np.zeros(((BUCKETS + 1) if piece >= 0 else len(at), dim)) for _ in range(2))
                g = np.frombuffer(r["squares"], np.float32).reshape(-1, dim).astype(float)
                weighed[at] += g * np.frombuffer(r["change"], np.float32).reshape(-1, dim)
                squares[at] += g
        at = np.flatnonzero(squares.any(1))
        change = np.where(squares[at] > 0, weighed[at] / np.where(squares[at] > 0, squares[at], 1), 0).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([change.tobytes()])], ["piece", "at", "change"])

    texts = own.select(shard, "doc_id", "hash", "text").where(~_kept()).groupBy("shard")
    told = known.where(~_kept()).select(shard, "doc_id", "hash", "y").groupBy("shard")
    changes = written(texts.cogroup(told).applyInArrow(run, "piece int, shard int, at binary, change binary, squares binary"), "changes")
    # A piece's shards are added up in their order, so that sums are the same in any partitioning.
    dealt = changes.repartition("piece").sortWithinPartitions("piece", "shard")
    for r in dealt.groupBy("piece").applyInArrow(mean, "piece int, at binary, change binary").collect():  # as large as a model
        _changed(m, r.piece, np.frombuffer(r.at, np.int32), np.frombuffer(r.change, np.float32))
    discard(changes)
    return m


def _thresholds(model: Model, profiles: langid.Profiles, own: DataFrame, known: DataFrame) -> dict[str | None, float]:
    """Thresholds of all (under None) and of each language with enough kept-back documents of both classes."""
    bare = own.sparkSession.sparkContext.broadcast(Classifier(model, profiles, {None: 0.0}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = bare.value
            at = np.clip(np.round(c.raw(batch.column("text")) * STEP), -MOST * STEP, MOST * STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(c.languages(batch.column("text")), pa.string()), pa.array(at)], ["doc_id", "hash", "lang", "at"])

    told = own.where(_kept()).select("doc_id", "hash", "text").mapInArrow(run, "doc_id long, hash long, lang string, at int").dropDuplicates(["doc_id", "hash"])
    counts = told.join(known, ["doc_id", "hash"]).groupBy("lang", "at", "y").agg(F.count("*").alias("n")).orderBy("lang", "at", "y").collect()  # at most 2 * MOST * STEP + 1 scores a language and class
    found: dict[str | None, float] = {None: 0.0}
    for lang in [None, *sorted({r.lang for r in counts})]:
        mine = [r for r in counts if lang is None or r.lang == lang]
        raw, y, n = np.array([r["at"] for r in mine]) / STEP, np.array([r.y for r in mine]), np.array([r.n for r in mine], float)
        if min(n[y == 1].sum(), n[y == 0].sum()) >= (1 if lang is None else ENOUGH):
            found[lang] = best_threshold(raw, y, n)
    return found


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", train_docs: int = TRAIN_DOCS, profiles: langid.Profiles | None = None) -> Classifier:
    """A classifier learned from all labelled rows that are not held out."""
    profiles = profiles or langid.learn(docs, key, text, lang)
    own, known = _labelled(docs, labels, key, text, label)
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    none = Classifier(None, profiles, {None: 0.0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x.astype(np.uint16).tobytes() for x in _hashed(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), batch.column("y"), pa.array(held, pa.binary())], ["doc_id", "hash", "y", "ids"])

    if len(n) < 2:
        return none
    sample = _sample(own, known, n, train_docs).select("doc_id", "hash", "y", "text")
    rows = sample.mapInArrow(run, "doc_id long, hash long, y int, ids binary").toArrow()  # bounded: train_docs of each class
    order = np.lexsort((rows["hash"].to_numpy(), rows["doc_id"].to_numpy()))
    rows = rows.take(pa.array(order))
    y = rows["y"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return none
    model, layers = _started([np.frombuffer(x.as_py(), np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int32) for x in rows["ids"]], y, SEED)
    if max(n.values()) > train_docs:
        model = _go_on(model, layers, own, known, n)
    thresholds = _thresholds(model, profiles, own, known)
    discard(known)
    return Classifier(model, profiles, thresholds)


def scored(docs: DataFrame, labels: DataFrame | None = None, classifier: Classifier | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  No shuffle: rows are scored where they are; a classifier is a few megabytes."""
    known = docs.sparkSession.sparkContext.broadcast(classifier or fit(docs, labels, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = known.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return core(docs, key, text).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
