"""Iterative fits over rows that stay in their workers: one barrier job, in which the workers tell each other their parts of sums.

Each task of the job keeps its rows in files that are mapped into memory (what memory lacks is read again), and works through the same steps: its part of a sum, all parts,
and the change that the total makes, which is the same everywhere.  Parts are files in the shared folder, as large as a model or a list of quantiles and not as the data
(``allGather`` looks for an answer once a second, and a descent has a thousand steps).
"""

from __future__ import annotations

import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

from fenmark.operators import learn, preprocess
from fenmark.sources.scratch import new_folder, remove, shared_dir

#: Numbers of a piece of rows whose sums are taken at once: 2 MB of features.
PIECE_CELLS = 1 << 18
Told = Callable[[object], list]
Statistics = dict[int, dict[str, np.ndarray]]
Cuts = dict[tuple[int, int], learn.Cuts]


def workers(spark: SparkSession, cells: int) -> int:
    """How many tasks a job over so many numbers may have: those that run at once; 0 if executors come and go, which barrier jobs can't do with, or if Python can't reach the shared folder."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    try:
        fs.FileSystem.from_uri(shared_dir(spark))
    except (ValueError, OSError):
        return 0
    inner = sc._jsc.sc()
    return min(inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()), -(-cells // PIECE_CELLS))


class Exchange:
    """What each of count workers tells in a round, in their order; all of them have to call it equally often."""

    def __init__(self, folder: str, me: int, count: int) -> None:
        self.system, self.at = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.at, recursive=True)
        self.me, self.count, self.round = me, count, 0

    def _name(self, k: int, back: int = 0) -> str:
        return f"{self.at}/{self.round - back}-{k}"

    def __call__(self, own: object) -> list:
        self.round += 1
        with self.system.open_output_stream(f"{self._name(self.me)}.part") as out:
            out.write(pickle.dumps(own, 5))
        self.system.move(f"{self._name(self.me)}.part", self._name(self.me))
        found, wait = [], 0.0005
        for k in range(self.count):
            while self.system.get_file_info(self._name(k)).type != fs.FileType.File:
                time.sleep(wait)
                wait = min(1.2 * wait, 0.05)
            with self.system.open_input_stream(self._name(k)) as f:
                found.append(pickle.loads(f.read()))
        if self.round > 1:  # whoever is in this round has read the last one
            self.system.delete_file(self._name(self.me, 1))
        return found


def total(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums (keys, two numbers each) added up by key, keys in order; the least key is -1."""
    if not (parts := [p for p in parts if len(p[0])]):
        return np.zeros(0, np.int64), np.zeros((0, 2))
    keys, numbers = (np.concatenate([p[k] for p in parts]) for k in range(2))
    some = np.flatnonzero(np.bincount(keys + 1))
    return some - 1, np.column_stack([np.bincount(keys + 1, numbers[:, c])[some] for c in range(2)])


def pieces(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(task, x, y, inner, h) of rows (task, y, inner, h, x), in pieces of about so many numbers of one task; what isn't finite is NaN."""
    held: dict[int, list[pa.RecordBatch]] = {}
    sizes: dict[int, int] = {}

    def made(i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        part = pa.Table.from_batches(held.pop(i)).combine_chunks()
        x = np.array(part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(part), -1)
        return i, np.where(np.isfinite(x), x, np.nan), part.column("y").to_numpy().astype(float), part.column("inner").to_numpy(), part.column("h").to_numpy().view(np.uint64)

    for batch in batches:
        task = batch.column("task").to_numpy()
        for i in np.unique(task).tolist():
            own = batch.filter(pa.array(task == i))
            held.setdefault(i, []).append(own)
            sizes[i] = sizes.get(i, 0) + len(own.column("x").flatten())
            if sizes[i] >= cells:
                yield made(i)
                sizes[i] = 0
    for i in list(held):
        yield made(i)


class Held:
    """Training rows of one task (of d features) in one worker."""

    def __init__(self, d: int) -> None:
        self.d, self.file, self.more = d, tempfile.TemporaryFile(), []

    def add(self, x: np.ndarray, *more: np.ndarray) -> None:
        self.file.write(x.tobytes())
        self.more.append(more)

    def close(self) -> None:
        """All rows are there; ``ranked`` has each feature's known values in order."""
        self.file.flush()
        self.y, self.inner, self.h = (np.concatenate([np.zeros(0, t), *(m[k] for m in self.more)]) for k, t in enumerate((float, np.int32, np.uint64)))
        del self.more
        n = len(self.y)
        self.x, ranked = (np.asarray(np.memmap(f, float, "r+", shape=s)) if n * self.d else np.zeros(s) for f, s in ((self.file, (n, self.d)), (self._file(n), (self.d, n))))
        for j in range(self.d):
            ranked[j] = np.sort(self.x[:, j])  # unknown ones last
        self.ranked = [r[: n - np.isnan(r).sum()] for r in ranked]

    def _file(self, n: int):
        out = tempfile.TemporaryFile()
        out.truncate(8 * n * self.d)
        return out

    def blocks(self, s: dict[str, np.ndarray]) -> list[learn.Block]:
        """The rows, imputed and scaled where they are, in pieces."""
        del self.ranked
        step, out = max(1, PIECE_CELLS // max(self.d, 1)), []
        for a in range(0, len(self.y), step):
            x = self.x[a : a + step]
            x[:] = (np.where(np.isnan(x), s["med"], x) - s["mean"]) / s["sd"]
            out.append(learn.Block(x, self.y[a : a + step], self.inner[a : a + step], self.h[a : a + step]))
        return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles' bits as integers in the same order, and back."""
    return x ^ ((x >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def order_statistics(at: np.ndarray, below: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The numbers at 0-based places in order, below(values) being how many are at most these values: halved bit by bit, all places at once."""
    low, high = (np.full(at.shape, _ordered(np.float64(v).view(np.int64))) for v in (-np.finfo(float).max, np.finfo(float).max))
    while (open_ := low < high).any():
        mid = (low >> 1) + (high >> 1) + (low & high & 1)
        enough = below(_ordered(mid).view(np.float64)) > at
        low, high = np.where(open_ & ~enough, mid + 1, low), np.where(open_ & enough, mid, high)
    return _ordered(low).view(np.float64)


def statistics(held: dict[int, Held], told: Told, binned: set[int]) -> tuple[Statistics, Cuts]:
    """Medians, means and deviations of the tasks' features over all workers' rows, and the cuts of the binned tasks' scaled features."""
    summed = lambda own: sum(told(own))
    columns = [(k, j) for k in sorted(held) for j in range(held[k].d)]
    ranked = [held[k].ranked[j] for k, j in columns]
    n, known = summed(np.array([[len(held[k].y) for k, _ in columns], [len(r) for r in ranked]], np.int64).reshape(2, -1))
    middle = (known - 1) / 2
    at = np.column_stack([np.floor(middle), np.ceil(middle)]).astype(np.int64)
    below = lambda of, v: summed(np.array([np.searchsorted(ranked[c], x, "right") for c, x in zip(of, v, strict=True)]).reshape(v.shape))
    sides = order_statistics(at, lambda v: below(range(len(columns)), v))
    med = np.where(known > 0, sides[:, 0] * (1 - (middle - at[:, 0])) + sides[:, 1] * (middle - at[:, 0]), 0.0)
    lack = n - known

    def over_all(f: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
        """Sums of f(values of a column, its number) with medians for what isn't known."""
        parts = told([learn.sum_parts(f(np.append(r, np.repeat(m, len(held[k].y) - len(r))), c)) for c, ((k, _), r, m) in enumerate(zip(columns, ranked, med, strict=True))])
        return np.array([learn.sum_parts(np.concatenate([p[c] for p in parts]))[0] for c in range(len(columns))])

    mean = over_all(lambda x, c: x) / np.maximum(n, 1)
    sd = np.maximum(np.sqrt(over_all(lambda x, c: (x - mean[c]) ** 2) / np.maximum(n - 1, 1)), preprocess.MIN_SD)
    found = {k: {c: v[[i for i, (own, _) in enumerate(columns) if own == k]] for c, v in (("med", med), ("mean", mean), ("sd", sd))} for k in held}
    cut = [i for i, (k, _) in enumerate(columns) if k in binned]
    if not cut:
        return found, {}
    bins = 2 * learn.BINS
    places = np.maximum(-(-np.arange(bins + 1) * n[cut][:, None] // bins) - 1, 0)
    quantiles = order_statistics(places, lambda v: below(cut, v) + lack[cut][:, None] * (med[cut][:, None] <= v))
    few = told([np.unique(ranked[i]) if np.count_nonzero(np.diff(ranked[i])) < bins else None for i in cut])
    cuts = {}
    for c, i in enumerate(cut):
        values = quantiles[c]
        if all(worker[c] is not None for worker in few):
            every = np.unique(np.concatenate([*(worker[c] for worker in few), med[[i]][: lack[i]]]))
            values = every if len(every) <= bins else values
        cuts[columns[i]] = learn.Cuts.of((values - mean[i]) / sd[i])
    return found, cuts


def run(learners: dict[tuple[int, int], object], blocks: dict[int, list[learn.Block]], first: dict[int, int], told: Told) -> None:
    """All steps of the learners (task, number) on the blocks of their task's first one of equal rows."""
    while going := {k: v for k, v in learners.items() if not v.done}:
        parts = told({k: total([v.sums(b) for b in blocks[first[k[0]]]]) for k, v in going.items()})
        for k, v in going.items():
            v.advance(*total([p[k] for p in parts]))


def with_cuts(learners: dict[tuple[int, int], object], cuts: Cuts, first: dict[int, int]) -> None:
    """Gives trees the cuts of their task's features."""
    for (i, _), v in learners.items():
        if isinstance(v, learn.Trees):
            v.cuts = [cuts[first[i], f] for f in range(len(v.cuts))]


def fit(rows: DataFrame, count: int, first: dict[int, int], d: dict[int, int], learners: dict[tuple[int, int], object]) -> tuple[Statistics, Cuts, dict[tuple[int, int], object]]:
    """Statistics, cuts and the learners (task, number), fitted but for forests, by a job of count tasks over rows (task, y, inner, h, x)."""
    binned = {first[i] for (i, _), v in learners.items() if isinstance(v, learn.Trees)}
    own = {k: v for k, v in learners.items() if not isinstance(v, learn.Forest)}
    folder = new_folder(rows.sparkSession, "told")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        attempt = context.allGather(uuid.uuid4().hex)[0]  # a stage that is tried again finds no file of the last time
        told = Exchange(f"{folder}/{attempt}", context.partitionId(), count)
        held = {k: Held(n) for k, n in d.items()}
        for k, *more in pieces(batches, PIECE_CELLS):
            held[k].add(*more)
        for h in held.values():
            h.close()
        stats, cuts = statistics(held, told, binned)
        blocks = {k: h.blocks(stats[k]) for k, h in held.items()}
        with_cuts(own, cuts, first)
        run(own, blocks, first, told)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((stats, cuts, own))], pa.binary())], ["found"])

    try:
        (found,) = rows.repartition(count).mapInArrow(work, "found binary", barrier=True).collect()  # as large as models
    finally:
        remove(rows.sparkSession, folder)
    return pickle.loads(found.found)
