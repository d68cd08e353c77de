"""Language identification by rank-order profiles.

A profile is a language's ``PROFILE`` most frequent letter n-grams (1 to 3, words set apart by one
boundary), most frequent first, ties by n-gram.  A document's own n-grams are
ranked likewise, over its whole text; its distance to a profile is the sum of how far each
of them is out of place, ``PROFILE`` for one that the profile lacks.  The least distance wins,
ties by the language's name.

Profiles are learned from at most about ``PROFILE_DOCS`` documents of each language (those of the least
hashes of doc_id), counted in Spark; rows that held_out() marks are never learned from.

A text that is null or has no letter is ``und`` with score 0, as is any text if nothing could
be learned.  Null doc_ids are not held out and not learned from; repeated rows are predicted alike; an empty table gives an empty result;
texts of any length are ranked whole, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenmark.llm.runtime import core

UNKNOWN, PROFILE, PROFILE_DOCS, PIECE = "und", 300, 2000, 1 << 18
_BOUNDARY = 1


@cache
def _letters() -> np.ndarray:
    """Marks of the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> Iterator[np.ndarray]:
    """A text's letters, ``PIECE`` characters at a time, with one boundary for each run of others and at both ends."""
    low, last = text.lower(), 0
    for k in range(0, len(low), PIECE):
        codes = np.frombuffer(low[k : k + PIECE].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        own = np.where(_letters()[codes], codes, _BOUNDARY)
        before = np.append(last, own[:-1])
        last = own[-1]
        own = own[(own != _BOUNDARY) | (before != _BOUNDARY)]
        yield np.append(_BOUNDARY, own[int(own[0] == _BOUNDARY) :]) if not k and len(own) else own
    if last and last != _BOUNDARY:
        yield np.array([_BOUNDARY])


def _grams(text: str) -> Iterator[np.ndarray]:
    """The codes of a text's letter n-grams, piece by piece; 21 bits a letter, so n is seen from the code."""
    held = np.zeros(0, np.int64)
    for new in _symbols(text):
        own = np.append(held, new)
        three = own[:-2] << 42 | own[1:-1] << 21 | own[2:]
        two = own[max(0, len(held) - 1) : -1] << 21 | own[max(1, len(held)) :]
        yield np.concatenate([new[new != _BOUNDARY], two, three])
        held = own[-2:]


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text, each as often as it occurs; none of a text without letters."""
    return np.concatenate([np.zeros(0, np.int64), *_grams(text)]) if any(map(str.isalpha, text)) else np.zeros(0, np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts.  Pieces are counted one after the other, so memory is bounded by a piece and the distinct n-grams."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for piece in _grams(text):
        own, n = np.unique(piece, return_counts=True)
        if len(grams):
            own, at = np.unique(np.append(grams, own), return_inverse=True)
            n = np.bincount(at, np.append(counts, n)).astype(np.int64)
        grams, counts = own, n
    letters = (grams != _BOUNDARY) & (grams != _BOUNDARY << 21 | _BOUNDARY)
    return grams[letters], counts[letters]


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, in order."""
    grams, counts = counted(text)
    if len(grams) > size:  # all that could be among the first, so that fewer have to be sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:size]


@dataclass(frozen=True)
class Profiles:
    """Ranked n-grams of each language."""

    grams: dict[str, np.ndarray]

    def sorted(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        return [(lang, np.sort(g), np.argsort(g)) for lang, g in sorted(self.grams.items()) if len(g)]


def predict(text: str | None, profiles: list[tuple[str, np.ndarray, np.ndarray]], size: int = PROFILE) -> tuple[str, float]:
    """(language, score): the score is 1 less the share of the greatest possible distance."""
    own = ranked(text, size) if text else ()
    if not len(own) or not profiles:
        return UNKNOWN, 0.0
    best = None
    place = np.arange(len(own))
    for lang, grams, rank in profiles:
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        distance = int(np.where(grams[at] == own, np.abs(rank[at] - place), size).sum())
        if best is None or distance < best[0]:
            best = distance, lang
    return best[1], max(0.0, 1 - best[0] / (size * len(own)))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", profile: int = PROFILE, profile_docs: int = PROFILE_DOCS) -> Profiles:
    """Profiles of the languages of docs, without the rows held out."""
    rows = core(docs, key, text, lang=lang).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).withColumn("id", F.col("doc_id").cast("string"))
    share = {r.lang: min(1.0, profile_docs / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Profiles({})
    limits = F.create_map(*(x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 32))))))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < F.element_at(limits, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                grams, counts = counted(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    totals = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    grams: dict[str, list[int]] = {}
    for r in first.orderBy("lang", "rank").collect():
        grams.setdefault(r.lang, []).append(r.gram)
    return Profiles({k: np.array(v, np.int64) for k, v in grams.items()})


def identified(docs: DataFrame, profiles: Profiles | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    known = (profiles or learn(docs, key, text, lang)).sorted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py(), known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    own = core(docs, key, text).select("doc_id", held_out().alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
