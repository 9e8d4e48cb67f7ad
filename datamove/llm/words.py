"""Word and shingle hashes of whole texts, vectorised over Arrow buffers.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z count as a-z. Texts are processed in slices of a few
megabytes, so memory does not depend on the batch size; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 18  # hashing holds about forty times that
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_powers: dict[int, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def text_batches(spark: SparkSession) -> None:
    """Batches for columns of whole texts: the defaults of 10,000 rows for Arrow and 4,096 for the Parquet reader hold many copies of tens of megabytes, in the JVM and
    in each Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=_U)
        steps[0] = 1
        known = np.cumprod(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and text number of every word; `bounds` are the offsets of the texts inside `data`."""
    is_word = np.zeros(len(data) + 2, dtype=bool)
    is_word[1:-1] = _IS_WORD[data]
    before, after = ~is_word[:-2], ~is_word[2:]
    inner = bounds[:-1][(bounds[:-1] < len(data))]
    before[inner] = True  # a text's first byte starts a word, its last byte ends one
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(is_word[1:-1] & before), np.flatnonzero(is_word[1:-1] & after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def span_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial from prefix sums, then mixed with the length."""
    out = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):  # blocks of whole words, so that the tables of powers stay small
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, side="right")))
        base, end = int(starts[at]), int(ends[stop - 1])
        sums = np.zeros(end - base + 1, dtype=_U)
        np.cumsum((lowered[base:end].astype(_U) + _U(1)) * _power(_BASE, end - base), out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[e] - sums[s]) * _power(_INVERSE, end - base)[s]
        at = stop
    return mix(out ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, row after the last, hashes of all words, number of words of each row."""
    data, offsets = text_buffers(column)
    for first, last in slices(offsets):
        lowered = _LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, text = word_spans(lowered, offsets[first : last + 1] - offsets[first])
        yield first, last, span_hashes(lowered, starts, ends), np.bincount(text, minlength=last - first)


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, and their bounds by text; a shorter text is one shingle, an empty one none."""
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    hashed, of = [], []
    for k in range(1, width + 1):
        if k < width:
            at = first[counts == k]
        elif len(words) >= width:
            at = np.flatnonzero(text[width - 1 :] == text[: len(text) - width + 1])
        else:
            at = np.zeros(0, np.int64)
        if len(at):
            value = mix(words[at] + _U(k))
            for j in range(1, k):
                value = mix(value * _U(0x9FB21C651E98DF25) + words[at + j])
            hashed.append(value)
            of.append(text[at])
    if not hashed:
        return np.zeros(0, _U), np.zeros(len(counts) + 1, np.int64)
    hashed, of = np.concatenate(hashed), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return hashed[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(counts)))])


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's whole text, in row order."""
    for _, _, words, counts in hashed_words(column):
        hashed, bounds = shingles(words, counts, width)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(hashed[a:b])


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
