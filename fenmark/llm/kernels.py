"""NumPy kernels over Arrow string columns: words, their hashes, and hashes of windows of words.

A column of texts is read as one byte buffer plus row offsets, so that finding
words and hashing them costs a few vector operations per word and no Python
object per word.  Work is cut into chunks of about ``CHUNK_BYTES`` (a longer
text is a chunk of its own), which bounds memory by the chunk, not the batch.

*Hashes.*  A word's bytes are taken eight at a time through a mixing function of 64 bits (words beyond ``BLOCKS`` such
steps through XXH3), a run's hash is that of a tree over its words' hashes.  No step is linear, so sequences of few
letters or words (Thue-Morse words, periods) collide no more often than others.  Seeds give hashes that are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20

#: The separators [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes inside [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all of UTF-8 beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words of more than so many times eight bytes are hashed by XXH3.
BLOCKS = 4
_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F))
_ODD = tuple(np.uint64(x) for x in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
#: Marks of the first k bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pairs (a, b); for either of them fixed, a bijection of the other."""
    with np.errstate(over="ignore"):
        return mix(a * _ODD[0] ^ (b + _ODD[1]))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH3 of data[s:e] for each span: for lines and whole texts, which are few."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of data[s:e] for each span; for spans of words, which are short."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8 * BLOCKS + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8 * BLOCKS,), "<u8", padded, strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) ^ _SEEDS[seed])
        for k in range(1, BLOCKS):
            more = np.flatnonzero(size > 8 * k)
            if not len(more):
                break
            out[more] = joined(out[more], eight[starts[more] + 8 * k] & _FIRST[np.minimum(size[more] - 8 * k, 8)])
        out = mix(out + size.astype(np.uint64) * _ODD[2])
    long = np.flatnonzero(size > 8 * BLOCKS)
    if len(long):
        out[long] = byte_hashes(data, starts[long], ends[long], int(_SEEDS[seed]))
    return out


class Runs:
    """Hashes of runs of consecutive values: of 1, 2, 4, ... values by a tree, of other sizes by their binary digits."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(joined(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def at(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """The hashes of values[s : s + size]; size is one number or one for each start."""
        if np.ndim(size):
            out = np.zeros(len(starts), np.uint64)
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                out[own] = self.at(starts[own], n)
            return out
        if not len(starts):
            return np.zeros(0, np.uint64)
        out, done = None, 0
        for k in reversed(range(size.bit_length())):
            if size >> k & 1:
                part = self._level(k)[starts + done]
                out, done = part if out is None else joined(out, part), done + (1 << k)
        return out


class Chunk:
    """Some rows of a batch: ``data`` (their bytes), ``offsets`` (row limits in data), ``rows`` (a slice of the batch)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice) -> None:
        self.data, self.offsets, self.rows, self.n = data, offsets, rows, len(offsets) - 1

    def words(self, inside: np.ndarray) -> Words:
        return Words(self, inside)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """The maximal runs of bytes marked by ``inside``; a run ends with its row."""

    def __init__(self, chunk: Chunk, inside: np.ndarray) -> None:
        flag = inside[chunk.data]
        before = np.zeros(len(flag) + 1, bool)
        before[1:] = flag
        before[chunk.offsets] = False
        after = np.zeros(len(flag) + 1, bool)
        after[:-1] = flag
        after[chunk.offsets] = False
        self.starts = np.flatnonzero(flag & ~before[:-1])
        self.ends = np.flatnonzero(flag & ~after[1:]) + 1
        self.chunk = chunk
        #: Words of row i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.starts, chunk.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return word_hashes(self.chunk.data, self.starts, self.ends, seed)

    def runs(self, seed: int = 0) -> Runs:
        return Runs(self.hashes(seed))

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words that lie within one row."""
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self))
        return at[at + size <= last]


def cover(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks of the positions inside any of the spans."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def sums_by_row(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], 0 for empty ranges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one array of 64-bit offsets, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    texts = strings(column)
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        part = whole[at[row] : at[end]]
        yield Chunk(LOWER[part] if lower else part, at[row : end + 1] - at[row], slice(row, end))
        row = end
