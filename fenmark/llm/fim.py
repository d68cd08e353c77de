"""Fill-in-middle: a text is cut at two places and put together again with its middle last.

A batch of texts is handled as one buffer of UTF-8 bytes.  A table of byte classes marks where units begin: a code point begins at
every byte that doesn't continue one, a word at a byte that isn't white space and comes after one that is.  Every text's first
byte begins a unit, which resets the running count of units at each document, and a binary search in that count finds the cuts of all
rows together.  The three parts are views of the same buffer, which Arrow joins with the sentinels.

Cuts and form come from the hexadecimal SHA-256 of ``seed:doc_id``: its first four groups of eight digits are h1 to h4.  The prefix ends after the
lesser of h1 % (n + 1) and h2 % (n + 1) units, the middle after the greater.  A text stays plain if it is empty or holds a
sentinel, or if h3 % 100 >= ``fim_percent``; else it is spm if h4 % 100 < ``spm_percent``, and psm otherwise.  No sentinel begins
with a character that another one goes on with, so a text without any can always be read back (``restored``).

A null text is an empty one, a null doc_id hashes as no digits; repeated rows give the same; an empty table gives an empty result; texts
of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.llm.kernels import SPACE
from fenmark.llm.runtime import core

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 1, 90, 20

#: Bytes that continue a code point.
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True


def unit_starts(data: np.ndarray, first: np.ndarray, unit: str = "char") -> np.ndarray:
    """Marks of the bytes at which units begin; first holds the offsets of the documents' first bytes."""
    if unit == "char":
        marks = ~CONTINUES[data]
    elif unit == "word":
        blank = SPACE[data]
        marks = ~blank
        marks[1:] &= blank[:-1]
    else:
        raise ValueError(f"no unit {unit!r}")
    marks[first[first < len(data)]] = True
    return marks


def _view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """A string column without nulls as offsets, bytes and the buffer that holds them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2] or pa.py_buffer(b"")
    return offsets, np.frombuffer(buffer, np.uint8), buffer


def _holding(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a sentinel."""
    known = np.zeros(256, bool)
    known[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = True
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & known[data[1:-1]]) if len(data) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = (row >= 0) & (row < len(offsets) - 1)
    inside[inside] = at[inside] + 3 <= offsets[row[inside] + 1]
    out = np.zeros(len(offsets) - 1, bool)
    out[row[inside]] = True
    return out


def cut(column: pa.Array, hashes: np.ndarray, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, unit: str = "char") -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars (in code points) and output of each row; hashes has h1 to h4 as columns."""
    column = pc.fill_null(column, "")
    offsets, data, buffer = _view(column)
    low, rows = int(offsets[0]), len(column)
    data, own = data[low : int(offsets[-1])], offsets.astype(np.int64) - low
    marks = unit_starts(data, own[:-1], unit)
    count = np.append(0, np.cumsum(marks, dtype=np.int32))  # units that begin before a byte
    base = count[own[:-1]]
    n = (count[own[1:]] - base).astype(np.int64)
    k = np.sort(hashes[:, :2] % (n + 1)[:, None], axis=1)
    # The byte where the k-th unit of a row begins: that before which base + k + 1 are first reached; k = n leads to the row's end.
    at = np.minimum(np.searchsorted(count[1:], base[:, None] + k + 1), own[1:, None])
    plain = (n == 0) | _holding(data, own) | (hashes[:, 2] % 100 >= fim_percent)
    spm = ~plain & (hashes[:, 3] % 100 < spm_percent)
    if unit == "char":
        chars = k
    else:
        points = np.append(0, np.cumsum(~CONTINUES[data], dtype=np.int32))
        chars = (points[at] - points[own[:-1], None]).astype(np.int64)
    ends = np.column_stack([own[:-1], at, own[1:]]) + low  # where the parts begin and end
    bounds = np.append(ends[:, :3].ravel(), int(offsets[-1])).astype(np.int32)
    parts = pa.StringArray.from_buffers(3 * rows, pa.py_buffer(bounds), buffer)
    prefix, middle, suffix = (parts.take(pa.array(np.arange(j, 3 * rows, 3))) for j in range(3))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    as_psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    as_spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    output = pc.if_else(pa.array(plain), column, pc.if_else(pa.array(spm), as_spm, as_psm))
    return {
        "n": pa.array(n),
        "form": pa.array(form.tolist(), pa.string()),
        "prefix_chars": pa.array(chars[:, 0], mask=plain),
        "middle_chars": pa.array(chars[:, 1] - chars[:, 0], mask=plain),
        "output": output,
    }


def hash_groups(key: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4 of a document's number."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * g + 1, 8), 16, 10).cast("long").alias(f"h{g + 1}") for g in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, unit: str = "char", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output.  No shuffle: rows are handled where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.column_stack([batch.column(f"h{g}").to_numpy() for g in range(1, 5)])
            made = cut(batch.column("text"), hashes, fim_percent, spm_percent, unit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.values()], ["doc_id", *made])

    rows = core(docs, key, text).select("doc_id", "text", *hash_groups(F.col("doc_id"), seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    parts = F.split(F.substr(output, F.lit(4)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[0], parts[2], parts[1])).when(form == "spm", F.concat(parts[1], parts[2], parts[0])).otherwise(output)
