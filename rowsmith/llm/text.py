"""Texts of a batch as one byte array, with vectorised words, hashes and sums.

Word separators are ASCII, so words are found on UTF-8 bytes. All functions
here work inside Spark tasks on a few megabytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled together; one longer text is handled alone.
CHUNK_BYTES = 2 << 20
LONG_SPAN = 512

SPACES = (0x20, *range(0x09, 0x0E))
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and of its next element."""
    return mix(h * _GOLDEN + following)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(
    df: DataFrame,
    function: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict],
    schema: str,
    text: str = "text",
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """Apply `function(rows, bytes, bounds)` piece by piece; it returns the columns of `schema` as arrays."""

    def run(batches):
        for rows in pieces(batches, text, limit):
            out = function(rows, *text_bytes(rows.column(text)))
            if out is not None:
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    return df.mapInArrow(run, schema)


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs end with their row."""
    inside = is_word[data]
    return runs(inside, bounds)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of marked bytes within a row."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time; spans of over LONG_SPAN bytes by BLAKE2."""
    length = (end - start).astype(np.int64)
    h = mix(length.astype(np.uint64) * _GOLDEN + np.uint64(seed))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    window = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    long = np.flatnonzero(length > LONG_SPAN)
    live = np.flatnonzero(length <= LONG_SPAN) if len(long) else np.arange(len(length))
    at = 0
    live = live[length[live] > 0]
    while len(live):
        left = np.minimum(length[live] - at, 8)
        part = window[start[live] + at] & _MASKS[left]
        h[live] = joined(h[live], part)
        at += 8
        live = live[length[live] > at]
    for i in long:
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = np.frombuffer(digest, dtype="<u8")[0]
    return h


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a value per byte (or per element) over each row."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def group_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's elements, from the ascending row numbers of the elements."""
    return np.searchsorted(rows, np.arange(n + 1))


def positions_in_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.arange(len(rows)) - group_bounds(rows, n)[rows]


def distinct_in_rows(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, ascending within the row."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    first = np.ones(len(r), dtype=bool)
    first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[first], h[first]


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte offset (n + 1 values)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
