"""Words of many texts at once, as positions in one byte buffer.

Python loops over words cost microseconds each; here a slice of a batch (a quarter of a megabyte of text, or
one longer text) is one numpy buffer, and word bounds and word hashes are array expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes that Spark sends a Python worker at a time.
BATCH_BYTES = 4 << 20
#: Bytes of text, and rows, that are worked on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 18
SLICE_ROWS = 1 << 13
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: [^\x20\x09-\x0D]: all but ASCII white space.
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and every byte of a non-ASCII character.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of about ``BATCH_BYTES``, or one longer row; a smaller setting stays.

    Spark's own bound is 10,000 rows, whatever their size: with whole texts that is a task's share of the table at once, in buffers outside the heap and again in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that a slice holds at most ``rows`` rows, and ``most`` bytes of text or one row."""
    for batch in batches:
        text = batch.column(column)
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.nan_to_num(text_lengths(text)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # a worker lives on after its task: what a batch took goes back


def text_lengths(text: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and where each begins (one entry more than texts). Null is empty."""
    lengths = text_lengths(text)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    data = b"".join(x for x in text.cast(pa.binary()).to_pylist() if x)
    return np.frombuffer(data, np.uint8), ends


def word_bounds(buf: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one entry more)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    mark = is_word[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = mark[:-1], mark[1:]
    first = ends[:-1][ends[:-1] < n]
    before[first] = False
    before[0] = False
    last = ends[1:][ends[1:] > 0] - 1
    after[last] = False
    after[n - 1] = False
    starts = np.flatnonzero(mark & ~before)
    stops = np.flatnonzero(mark & ~after) + 1
    return starts, stops, np.searchsorted(starts, ends)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept between calls."""
    global _POWERS
    if n > len(_POWERS[0]):
        size = max(n, 2 * len(_POWERS[0]), 1 << 12)
        out = []
        for x in (_BASE, _INVERSE):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS = tuple(out)
    return _POWERS


_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes only. Equal hashes still need a look at the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mixed((total[stops] - total[starts]) * down[starts])


def joined_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive words, by the index of its first."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = mixed(out * np.uint64(31) + h[k : k + n] + np.uint64(k))
    return mixed(out)


def one_text(text: str | bytes, is_word: np.ndarray, lower: bool = True) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text
    buf = np.frombuffer(data, np.uint8)
    if lower:
        buf = LOWER[buf]
    starts, stops, _ = word_bounds(buf, np.array([0, len(buf)]), is_word)
    out = buf.tobytes()
    return [out[s:e] for s, e in zip(starts.tolist(), stops.tolist())]
