"""Cross-tokenizer alignment: which tokens of one tokenizer stand where those of another do, and how often over the corpus.

Each text, with one space before it, is encoded by a byte-level BPE (A) and by a piece BPE (B, which adds that space itself).  Byte offsets at which
tokens of both end cut the text into groups; every A token of a group is linked with every B token of it.

*Pieces.*  A space between two characters that can't be white space begins a new pre-token of A, and no piece of B holds a space
after another character (this is looked up in B's vocabulary; else a text is one piece).  So texts are cut before such spaces, equal pieces of a
batch are found by Arrow's dictionary encoding, and each piece is encoded and grouped once: tokens, groups and links of a text are those of its pieces in turn.

*Counts.*  A pair of ids is packed in an int64.  A partition counts in how many of its documents a pair is linked (``np.unique``, partial counts
are let go whenever there are ``HELD`` of them); these are range-partitioned, sorted, and runs of equal pairs are summed as they stream by.
Each range becomes a shard, a file of sorted pairs and one of their counts in the shared folder, which tasks map into memory and look up by ``searchsorted``.
What goes through the driver is a row a shard, and each A id's highest count (as many as the vocabulary has ids).

Texts that are null or empty, or whose tokens of A or B don't give back their bytes (such as one with U+2581), have no tokens, and count for nothing.  Each row is a document, so repeated
rows count as often as they come, whatever their id, which may be null.  Strings of special tokens are plain text.  An empty table gives an empty result;
texts of any length are encoded whole, those without spaces as one piece.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm import kernels as K
from fenmark.llm.runtime import core, shared_dir, written

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Partial counts that a partition holds before it lets them go; pieces, and bytes of them, that a worker remembers.
HELD, PIECES, PIECE_BYTES = 1 << 22, 1 << 19, 1 << 25
#: Bytes of the texts that are encoded together; a longer text is by itself.
TEXT_BYTES = 1 << 22
# Fixed value: how the byte-level tokenizer cuts a text to pre-tokens.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Groups with up to so many links are spelled out pair by pair, larger ones through their distinct ids.
SMALL = 64
_SHIFT = 32


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << _SHIFT | b


@dataclass(frozen=True)
class Files:
    """The tokenizers' files, read once on the driver: a few megabytes, whatever the corpus."""

    a: str
    b: bytes

    @classmethod
    def read(cls, folder: str = TOKENIZERS, a: str = FILE_A, b: str = FILE_B) -> Files:
        return cls((Path(folder) / a).read_text(encoding="utf-8"), (Path(folder) / b).read_bytes())


def byte_characters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and each id's bytes' number."""

    def __init__(self, files: Files) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(files.a), sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.a.encode_special_tokens = True
        of_char = byte_characters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: Whether no piece holds a space after another character, so that texts may be cut before spaces.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        # The same vocabulary, whose ids are in the order of its merges, in a form that is quicker for short texts.
        added = set(self.a.get_added_tokens_decoder())
        ranks = {t: i for i, t in enumerate(self.bytes_a) if i not in added}
        self.quick = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space.  Those of ASCII and Latin letters alone, whose classes no version of Unicode disputes, take the quicker way."""
        quick = self.quick._core_bpe.encode_ordinary
        ids: list = [quick(t) if t.isascii() or max(t) < "\u0250" and min(filter("\x7f".__lt__, t)) >= "\u00c0" else None for t in texts]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(rest, self.a.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        return ids, self.b.encode([t[1:] for t in texts], num_threads=1)


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Marks of spaces before which a text may be cut: both neighbours are printable ASCII, or of U+00C0 to U+07FF, where no white space is."""
    ascii_, two, rest = (data > 0x20) & (data < 0x7F), (data >= 0xC3) & (data < 0xE0), (data >= 0x80) & (data < 0xC0)
    ends = ascii_.copy()
    ends[1:] |= rest[1:] & two[:-1]
    out = np.zeros(len(data), bool)
    out[1:-1] = (data[1:-1] == 0x20) & ends[:-2] & (ascii_ | two)[2:]
    return out


def _lists(values: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and where each list begins in it."""
    first = np.append(0, np.cumsum(np.fromiter(map(len, values), np.int64, len(values))))
    return np.fromiter(chain.from_iterable(values), np.int64, int(first[-1])), first


def _spelled(ids: np.ndarray, known: list[bytes]) -> bytes:
    return b"".join(map(known.__getitem__, ids.tolist()))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them), one range after the other."""
    end = np.cumsum(count)
    return np.repeat(first - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0)


class Pieces:
    """What is known of pieces, by number: tokens, groups, and distinct links with how often they come.

    ``lookup`` gives the corpus' count of pairs and whether it is the highest of their A id; then sums are kept, too.
    """

    FIELDS = ("valid", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def __init__(self, encoders: Encoders, lookup=None) -> None:
        self.encoders, self.lookup = encoders, lookup
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.table = np.zeros((0, len(self.FIELDS)), np.int64)
        self.groups: list[str] = []
        self.pairs: list[np.ndarray] = []

    def numbers(self, texts: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; those not met before are encoded together."""
        if len(self.known) > PIECES or self.bytes > PIECE_BYTES:
            self._clear()
        new = [t for t in texts if t not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.bytes += sum(map(len, new))
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))

    def _learn(self, texts: list[str]) -> None:
        e, n = self.encoders, len(texts)
        ids_a, ids_b = e.encode(texts)
        (a, first_a), (b, first_b) = _lists(ids_a), _lists(ids_b)
        own = [t.encode() for t in texts]
        # Pieces are valid if their tokens spell them; mostly all are, which is seen at once.
        size = np.fromiter(map(len, own), np.int64, n)
        sizes = [K.sums_by_row(first, known[ids]) for ids, first, known in ((a, first_a, e.size_a), (b, first_b, e.size_b))]
        valid = (sizes[0] == size) & (sizes[1] == size)
        whole = b"".join(own)
        if not (valid.all() and _spelled(a, e.bytes_a) == whole and _spelled(b, e.bytes_b) == whole):
            valid = np.fromiter((b"".join(map(e.bytes_a.__getitem__, x)) == t == b"".join(map(e.bytes_b.__getitem__, y)) for t, x, y in zip(own, ids_a, ids_b, strict=True)), bool, n)
            (a, first_a), (b, first_b) = (_lists([x if v else [] for x, v in zip(ids, valid, strict=True)]) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(e.size_a[a]), np.cumsum(e.size_b[b])
        shared = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
        shared[end_a] = True
        common = end_b[shared[end_b]]  # pieces are whole in both, so their ends are common, too
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        many_a, many_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        from_a, from_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        piece = np.repeat(np.arange(n), np.diff(first_a))[from_a] if len(common) else np.zeros(0, np.int64)
        links = many_a * many_b
        # Distinct links of each piece: small groups are spelled out together, large ones go by their distinct ids.
        small = np.flatnonzero(links <= SMALL)
        each = ranges(np.zeros(len(small), np.int64), links[small])
        wide = np.repeat(many_b[small], links[small])
        pair = packed(a[np.repeat(from_a[small], links[small]) + each // np.maximum(wide, 1)], b[np.repeat(from_b[small], links[small]) + each % np.maximum(wide, 1)])
        owner, times = np.repeat(piece[small], links[small]), np.ones(len(pair), np.int64)
        more = [(owner, pair, times)]
        for g in np.flatnonzero(links > SMALL).tolist():
            x, nx = np.unique(a[from_a[g] : from_a[g] + many_a[g]], return_counts=True)
            y, ny = np.unique(b[from_b[g] : from_b[g] + many_b[g]], return_counts=True)
            more.append((np.full(len(x) * len(y), piece[g]), packed(np.repeat(x, len(y)), np.tile(y, len(x))), np.outer(nx, ny).ravel()))
        owner, pair, times = (np.concatenate(x) for x in zip(*more, strict=True))
        order = np.lexsort((pair, owner))
        owner, pair, times = owner[order], pair[order], times[order]
        start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        owner, pair, times = owner[start], pair[start], np.add.reduceat(times, start) if len(start) else times
        sums = np.zeros((n, len(self.FIELDS)), np.int64)
        sums[:, 0], sums[:, 1], sums[:, 2] = valid, np.diff(first_a), np.diff(first_b)
        sums[:, 3] = np.bincount(piece, minlength=n)
        np.add.at(sums[:, 4], piece, links)
        if self.lookup is None:
            at = np.searchsorted(owner, np.arange(n + 1))
            self.pairs += [pair[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        else:
            count, best = self.lookup(pair)
            np.add.at(sums[:, 5], owner, times * best)
            np.add.at(sums[:, 6], owner, times * count)
            self._spell(a.tolist(), b.tolist(), many_a.tolist(), many_b.tolist(), sums[:, 3].tolist())
        self.table = np.concatenate([self.table, sums])

    def _spell(self, a: list[int], b: list[int], many_a: list[int], many_b: list[int], n_groups: list[int]) -> None:
        a, b, out, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
        for m, n in zip(many_a, many_b, strict=True):
            left = a[i] if m == 1 else ",".join(a[i : i + m])
            out.append(f"{left}|{b[j]}" if n == 1 else f"{left}|{','.join(b[j : j + n])}")
            i, j = i + m, j + n
        g = 0
        for n in n_groups:
            self.groups.append(out[g] if n == 1 else ";".join(out[g : g + n]))
            g += n


def encoded(column: pa.Array, pieces: Pieces) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Chunks of rows: which, the numbers of their pieces in order, and where each row's begin; rows without text have none."""
    texts = K.strings(column)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    row = 0
    while row < len(texts):
        end = max(row + 1, min(len(texts), row + int(np.searchsorted(np.cumsum(sizes[row:]), TEXT_BYTES, "right"))))
        some = texts.slice(row, end - row)
        own = pc.if_else(pc.equal(some, ""), some, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), some, pa.scalar(" ", pa.large_string())))
        at = np.append(0, np.cumsum(sizes[row:end] + (sizes[row:end] > 0)))
        _, offsets, buffer = own.buffers()
        low = int(np.frombuffer(offsets, np.int64)[own.offset])
        data = np.frombuffer(buffer, np.uint8)[low : low + at[-1]] if at[-1] else np.zeros(0, np.uint8)
        marks = piece_starts(data) if pieces.encoders.cuts else np.zeros(len(data), bool)
        marks[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(marks)
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        numbers = pieces.numbers(cut.dictionary.to_pylist())[cut.indices.to_numpy()]
        yield slice(row, end), numbers, np.searchsorted(starts, at)
        row = end


def _per_row(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each row's pieces."""
    total = np.zeros((len(values) + 1, values.shape[1]), np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _whole(first: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which rows have pieces, all of them valid."""
    return (np.diff(first) > 0) & (_per_row(first, 1 - valid[:, None])[:, 0] == 0)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])


def partial_counts(docs: DataFrame, files, key: str, text: str) -> DataFrame:
    """(pair, n): in how many of a partition's documents a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, size = Pieces(Encoders(files.value)), [], 0
        for batch in batches:
            for _, numbers, first in encoded(batch.column("text"), pieces):
                whole, own = _whole(first, pieces.table[numbers, 0]), []
                for r in np.flatnonzero(whole).tolist():
                    own.append(np.unique(np.concatenate([pieces.pairs[i] for i in np.unique(numbers[first[r] : first[r + 1]]).tolist()])))
                if own:
                    held.append(np.unique(np.concatenate(own), return_counts=True))
                    size += len(held[-1][0])
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield _batch(*held[0])
                        held, size = [], 0
        if held:
            yield _batch(*_merged(held))

    return core(docs, key, text).mapInArrow(run, "pair long, n long")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def local_file(path: str) -> str:
    """A path by which this machine can map a shared file: the file itself, or an executor's copy among its Spark files."""
    system, at = _opened(path)
    if isinstance(system, fs.LocalFileSystem):
        return at
    mine = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(at))
    if not os.path.exists(mine):
        part = f"{mine}.{uuid.uuid4().hex}"
        fs.copy_files(at, part, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        os.replace(part, mine)
    return mine


class Counts:
    """Sorted count shards: files of pairs and of their counts, each shard (path, first, last, n), in the order of the pairs."""

    def __init__(self, shards: list[tuple[str, int, int, int]]) -> None:
        self.shards = sorted(shards, key=lambda s: s[1])
        self.first = np.array([s[1] for s in self.shards], np.int64)
        self._mapped: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.shards

    def __setstate__(self, shards) -> None:
        self.__init__(shards)

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._mapped:
            self._mapped[k] = tuple(np.memmap(local_file(self.shards[k][0] + end), np.int64, "r", shape=(self.shards[k][3],)) for end in (".pairs", ".counts"))
        return self._mapped[k]

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The counts of pairs, 0 for those that are nowhere."""
        out = np.zeros(len(pairs), np.int64)
        where = np.searchsorted(self.first, pairs, "right") - 1
        for k in np.unique(where[where >= 0]).tolist():
            own = np.flatnonzero(where == k)
            keys, counts = self.shard(k)
            at = np.minimum(np.searchsorted(keys, pairs[own]), len(keys) - 1)
            out[own] = np.where(keys[at] == pairs[own], counts[at], 0)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """(a, b, n): all counted pairs, a task a shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column("k").to_pylist():
                    keys, counts = self.shard(k)
                    for i in range(0, len(keys), 1 << 16):
                        x = np.asarray(keys[i : i + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array(x >> _SHIFT), pa.array(x & ((1 << _SHIFT) - 1)), pa.array(np.asarray(counts[i : i + (1 << 16)]))], ["a", "b", "n"])

        return spark.range(0, len(self.shards), 1, max(1, len(self.shards))).withColumnRenamed("id", "k").mapInArrow(run, "a long, b long, n long")


def counted(partial: DataFrame) -> Counts:
    """Partial counts (pair, n), range-partitioned and sorted, equal pairs summed, and written as shards by the tasks.

    Only a task that ends tells its shard's name, so what a lost executor left behind is never read.
    """
    folder = f"{shared_dir(partial.sparkSession)}/pairs-{uuid.uuid4().hex}"
    _, at = _opened(folder)
    sorted_ = partial.repartitionByRange("pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(folder)
        path, first, last, n, waiting = f"{folder}/{uuid.uuid4().hex}", None, None, 0, None
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            if out is None:
                system.create_dir(at, recursive=True)
                out = [system.open_output_stream(_opened(path + end)[1]) for end in (".pairs", ".counts")]
            if waiting is not None:  # the run that the batch before ended with may go on
                keys, counts = np.append(waiting[0], keys), np.append(waiting[1], counts)
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[start], np.add.reduceat(counts, start)
            waiting = keys[-1:], counts[-1:]
            for stream, x in zip(out, (keys[:-1], counts[:-1]), strict=True):
                stream.write(x.tobytes())
            first, n = int(keys[0]) if first is None else first, n + len(keys) - 1
        if out is not None:
            for stream, x in zip(out, waiting, strict=True):
                stream.write(x.tobytes())
                stream.close()
            last = int(waiting[0][0])
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first]), pa.array([last]), pa.array([n + 1])], ["path", "first", "last", "n"])

    return Counts([tuple(r) for r in sorted_.mapInArrow(run, "path string, first long, last long, n long").collect()])  # a row a shard


def highest(spark: SparkSession, counts: Counts) -> np.ndarray:
    """Each A id's highest count: as many numbers as the vocabulary has ids."""
    rows = counts.frame(spark).groupBy("a").agg(F.max("n").alias("n")).toPandas()
    out = np.zeros(int(rows["a"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["a"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def pair_counts(docs: DataFrame, files: Files | None = None, key: str = "doc_id", text: str = "text") -> Counts:
    """In how many documents each pair of ids is linked."""
    shipped = docs.sparkSession.sparkContext.broadcast(files or Files.read())
    return counted(written(partial_counts(docs, shipped, key, text), "pairs"))


def aligned(docs: DataFrame, files: Files | None = None, counts: Counts | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups (`a1,a2|b1;a3|b2,b3`, empty without tokens).

    counts may come from other documents, as when a corpus grows; pairs that they lack count 0.
    """
    spark = docs.sparkSession
    files = files or Files.read()
    counts = counts or pair_counts(docs, files, key, text)
    shipped = spark.sparkContext.broadcast((files, counts, highest(spark, counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, best = shipped.value

        def lookup(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n, a = known.of(pairs), pairs >> _SHIFT
            top = np.zeros(len(pairs), np.int64)
            inside = a < len(best)
            top[inside] = best[a[inside]]
            return n, (n > 0) & (n == top)

        pieces = Pieces(Encoders(own), lookup)
        for batch in batches:
            for rows, numbers, first in encoded(batch.column("text"), pieces):
                found = pieces.table[numbers]
                whole = _whole(first, found[:, 0])
                sums = np.where(whole[:, None], _per_row(first, found), 0)
                groups = [";".join(map(pieces.groups.__getitem__, numbers[i:j].tolist())) if w else "" for w, i, j in zip(whole.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, rows.stop - rows.start), *(pa.array(sums[:, k]) for k in range(1, 7)), pa.array(groups, pa.string())], ["doc_id", *Pieces.FIELDS[1:], "groups"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return core(docs, key, text).mapInArrow(run, schema)
