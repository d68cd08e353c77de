"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document.  Only the counts of vote
patterns (at most 3 ** rules of them, whatever the corpus) reach the driver,
where expectation-maximisation estimates how each rule votes on good and on bad
documents.  A document's verdict is its posterior probability of being good,
so no single rule decides.  The counts cover every document of the input.

Null and empty texts have no words and fail the base rule; an empty table gives
an empty result; repeated rows are judged alike, each on its own; texts of any length are counted
whole.  Lines and windows of a text are compared by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm.runtime import core, ddl, numbered, place, written

GOOD, ABSTAIN, BAD = 0, 1, 2
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: The contract's counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_ALNUM = _LETTER.copy()
_ALNUM[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True
#: First bytes of code points: all but UTF-8's continuation bytes.
_POINT = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Rule:
    """Votes good within [good_from, good_to], bad outside [bad_below, bad_above], else abstains."""

    name: str
    over: str
    per: str | None
    good_from: float
    good_to: float
    bad_below: float
    bad_above: float

    def vote(self, f: dict[str, np.ndarray]) -> np.ndarray:
        value = f[self.over].astype(float)
        known = np.ones(len(value), bool)
        if self.per:
            known = f[self.per] > 0
            value = value / np.maximum(f[self.per], 1)
        out = np.full(len(value), ABSTAIN)
        out[(value >= self.good_from) & (value <= self.good_to)] = GOOD
        out[(value < self.bad_below) | (value > self.bad_above)] = BAD
        out[~known] = ABSTAIN
        return out


INF = float("inf")
#: The prior chances of the votes good, abstain and bad in the good and in the bad class, and the share of all documents that they weigh.
PRIOR_CHANCE, PRIOR_SHARE = np.array([[0.9, 0.5], [0.09, 0.2], [0.01, 0.3]]), 0.03
RULES = (
    Rule("length", "n_words", None, 50, INF, MIN_WORDS, INF),
    Rule("symbols", "n_symbols", "n_words", 0, 0.05, -INF, 0.2),
    Rule("alphanumerics", "n_alnum", "word_bytes", 0.9, 1, 0.82, INF),
    Rule("bare_words", "n_bare", "n_words", 0, 0.05, -INF, 0.2),
    Rule("stutter", "n_stutter", "n_words", 0, 0.05, -INF, 0.3),
    Rule("capitals", "n_upper", "n_letters", 0, 0.15, -INF, 0.4),
    Rule("exclamations", "n_bangs", "n_words", 0, 0.05, -INF, 0.3),
    Rule("word_length", "word_chars", "n_words", 3, 9, 2, 13),
    Rule("stops", "n_stops", "n_words", 0.04, 0.4, 0.005, 0.7),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0, 0.1, -INF, 0.4),
    Rule("repeats", "n_repeat_words", "n_words", 0, 0.1, -INF, 0.3),
)


def features(chunk: K.Chunk) -> dict[str, np.ndarray]:
    """Counts per row of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    words = chunk.words(~K.SPACE)
    by_row = lambda marks: K.sums_by_row(offsets, marks)
    in_word = ~K.SPACE[data]
    alnum = _ALNUM[data]
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(alnum, out=held[1:])
    f = {
        "n_words": words.counts.astype(np.int64),
        "word_bytes": by_row(in_word),
        "word_chars": by_row(in_word & _POINT[data]),
        "n_symbols": by_row(_SYMBOL[data]),
        "n_alnum": by_row(alnum),
        "n_bare": K.sums_by_row(words.first, held[words.ends] == held[words.starts]),
        "n_letters": by_row(_LETTER[data]),
        "n_upper": by_row(_UPPER[data]),
        "n_stops": by_row(_STOP[data]),
        "n_bangs": by_row(_BANG[data]),
    }
    f["n_lines"], f["n_dup_lines"] = _lines(chunk, in_word)
    hashes = words.hashes()
    f["n_repeat_words"] = _repeats(words, hashes)
    again = np.zeros(len(words), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.first[:-1][words.counts > 0]] = False
    f["n_stutter"] = K.sums_by_row(words.first, again)
    return f


def _lines(chunk: K.Chunk, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of their row."""
    starts = np.union1d(chunk.offsets[:-1], np.flatnonzero(chunk.data == 0x0A) + 1)
    ends = np.append(starts[1:], len(chunk.data))
    ends[:-1] -= chunk.data[starts[1:] - 1] == 0x0A  # short of the newline, if one ended the line
    row = np.searchsorted(chunk.offsets, starts, "right") - 1
    held = np.zeros(len(in_word) + 1, np.int64)
    np.cumsum(in_word, out=held[1:])
    full = held[ends] > held[starts]
    starts, ends, row = starts[full], ends[full], row[full]
    own = _by_row(K.byte_hashes(chunk.data, starts, ends), row)
    _, first = np.unique(own, return_index=True)
    n, distinct = np.bincount(row, minlength=chunk.n), np.bincount(row[first], minlength=chunk.n)
    return n, n - distinct


def _by_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return K.mix(hashes ^ K.mix(row.astype(np.uint64) + np.uint64(1)))


def _repeats(words: K.Words, hashes: np.ndarray) -> np.ndarray:
    """Words inside windows that occur twice or more in their row."""
    at = words.windows(WINDOW)
    if not len(at):
        return np.zeros(words.chunk.n, np.int64)
    own = _by_row(K.Runs(hashes).at(at, WINDOW), words.rows()[at])
    order = np.sort(own)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(words.chunk.n, np.int64)
    near = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)]
    at = at[near == own]
    return K.sums_by_row(words.first, K.cover(len(words), at, at + WINDOW))


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def patterns(f: dict[str, np.ndarray]) -> np.ndarray:
    """The rules' votes as one number in base 3."""
    out = np.zeros(len(f["n_words"]), np.int64)
    for rule in RULES:
        out = out * 3 + rule.vote(f)
    return out


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Votes (rows by rules) of pattern numbers."""
    return np.stack([codes // 3 ** (len(RULES) - 1 - k) % 3 for k in range(len(RULES))], 1).astype(np.int64)


@dataclass(frozen=True)
class VoteModel:
    """log_odds[rule, vote] of good against bad, and the prior's log odds."""

    prior: float
    log_odds: np.ndarray
    accuracy: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        votes = unpacked(codes)
        total = self.prior + sum(self.log_odds[k, votes[:, k]] for k in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_votes(codes: np.ndarray, counts: np.ndarray, rounds: int = 300, tolerance: float = 1e-7) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    Each rule has, for either class, the chances of its three votes.  These have a prior, ``PRIOR_CHANCE`` with the weight of
    ``PRIOR_SHARE`` of all documents: what a rule's author believes of it.  It keeps a small kind of bad documents,
    which few rules see, from being taken for good ones because another kind is more frequent; as it grows with the corpus,
    a corpus and ten copies of it give one model.  A bad vote may not speak for the good class,
    nor a good one for the bad, which fixes the classes' meaning.  Documents start as bad if two rules say so.
    """
    if not len(codes):
        codes, counts = np.zeros(1, np.int64), np.ones(1)
    votes, weight = unpacked(codes), counts / counts.sum()
    good = np.array([0.95, 0.5, 0.05])[np.minimum((votes == BAD).sum(1), 2)]
    rules, log_odds, prior = range(votes.shape[1]), np.zeros((votes.shape[1], 3)), 0.0
    for _ in range(rounds):
        mass = np.array([(weight * good).sum(), (weight * (1 - good)).sum()])
        chance = np.empty((votes.shape[1], 3, 2))
        for k in rules:
            for v in range(3):
                own = weight * (votes[:, k] == v)
                seen = np.array([own @ good, own @ (1 - good)])
                chance[k, v] = (seen + PRIOR_SHARE * PRIOR_CHANCE[v]) / (mass + PRIOR_SHARE)
        before, log_odds = log_odds, np.log(chance[:, :, 0] / chance[:, :, 1])
        log_odds[:, GOOD] = np.maximum(log_odds[:, GOOD], 0)
        log_odds[:, BAD] = np.minimum(log_odds[:, BAD], 0)
        log_odds[:, ABSTAIN] = 0
        prior = float(np.log((mass[0] + PRIOR_SHARE) / (mass[1] + PRIOR_SHARE)))
        good = VoteModel(prior, log_odds, chance[:, 0, 0]).posterior(codes)
        if np.abs(log_odds - before).max() < tolerance:
            break
    voted = [(votes[:, k] != ABSTAIN) * weight for k in rules]
    right = [(weight * np.where(votes[:, k] == GOOD, good, 1 - good) * (votes[:, k] != ABSTAIN)).sum() for k in rules]
    return VoteModel(prior, log_odds, np.array([r / max(v.sum(), 1e-300) for r, v in zip(right, voted, strict=True)]))


def judged_by(patterns: DataFrame) -> VoteModel:
    """The vote model of the rows' patterns (column pattern); at most 3 ** rules counts reach the driver."""
    found = patterns.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    return fit_votes(found["pattern"].to_numpy(np.int64), found["n"].to_numpy(float))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed and pattern (of votes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                f = features(chunk)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.rows.start, chunk.n), *(pa.array(f[c].astype(np.int64)) for c in COUNTS), pa.array(base_failed(f)), pa.array(patterns(f))], ["doc_id", *COUNTS, "base_failed", "pattern"])

    return core(docs, key, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, pattern long")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> VoteModel:
    """The vote model of all rows of docs."""
    return judged_by(counted(docs, key, text))


def scored(docs: DataFrame, model: VoteModel | None = None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: the base counts, base_failed, posterior and kept.  Texts are read once: counts and votes are written, and judged from there."""
    rows = written(counted(docs, key, text), "votes")
    model = model or judged_by(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.posterior(batch.column("pattern").to_numpy())
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & (good >= threshold)
            own = [c for c in batch.schema.names if c != "pattern"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(good), pa.array(kept)], [*own, "posterior", "kept"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, posterior double, kept boolean")


def accepted(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns unchanged, that quality rules keep.  Texts are counted once: rows are written with their votes, and kept by these."""
    own, at = numbered(docs), place(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(at)):
                f, rows = features(chunk), batch.slice(chunk.rows.start, chunk.n)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(base_failed(f)), pa.array(patterns(f))], [*rows.schema.names, "_failed", "_pattern"])

    voted = written(own.mapInArrow(run, f"{ddl(own)}, _failed boolean, _pattern long"), "votes")
    counts = voted.groupBy(F.col("_pattern").alias("pattern")).agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    codes = counts["pattern"].to_numpy(np.int64)
    good = codes[fit_votes(codes, counts["n"].to_numpy(float)).posterior(codes) >= threshold].tolist() if len(codes) else []
    # At most 3 ** rules patterns.
    known = docs.sparkSession.createDataFrame([(c,) for c in good], "_good long")
    kept = voted.where(~F.col("_failed")).join(F.broadcast(known), F.col("_pattern") == F.col("_good"), "left_semi")
    return kept.select(*own.columns).toDF(*docs.columns)
