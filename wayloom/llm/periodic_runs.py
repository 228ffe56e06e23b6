"""Periodic runs of words: all lags are scanned.

A run is a stretch of words with smallest period q and length at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` that can't be extended. The array of word
ids is compared with itself shifted by q, for every q up to n / MIN_EXPONENT, and the stretches of true places that are long enough are runs of period q
or of a divisor of q (by the theorem of Fine and Wilf), which is then the period.

Short lags are compared in full. For a longer one a stretch of k true places is asked for, k >= (MIN_EXPONENT - 1) * q, so that
every (k - 2)-th place and the two after it are compared first: a stretch has one such triple at least. Only around a triple of true places
the comparison goes on, until the stretch ends on both sides; so no lag is left out and no run lost, but a lag q costs n / q comparisons. The
texts of a slice lie end to end, longest first, with ids of their own, so one comparison serves all texts that are long enough for its lag.

A text with more lags than ``LAGS`` is dealt over the cluster as (text, range of lags), and the ranges' runs are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.shared import written

from .words import NOT_BLANK, buffer_of, slices, word_bounds

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Lags that one task scans of one text; a text with more is dealt out by ranges of lags.
LAGS = 1 << 15
#: Lags below this are compared in full.
DENSE = 8
#: Bytes of text worked on at a time.
SLICE = 1 << 21


def word_ids(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each word; equal words, equal numbers."""
    if not len(starts):
        return np.zeros(0, np.int64)
    places = np.concatenate(([0], np.cumsum(stops - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(buf[NOT_BLANK[buf]].tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _true_stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _extent(x: np.ndarray, q: int, at: int) -> tuple[int, int]:
    """The stretch of places i with x[i] == x[i + q] around ``at``, which is one."""
    end, step = at, 64
    while end < len(x) - q:
        same = x[end : end + step] [: len(x) - q - end] == x[end + q : end + q + step]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + len(same), 2 * step
    begin, step = at, 64
    while begin > 0:
        low = max(0, begin - step)
        same = x[low:begin] == x[low + q : begin + q]
        if not same.all():
            begin -= int(same[::-1].argmin())
            break
        begin, step = low, 2 * step
    return begin, end


def smallest_period(x: np.ndarray, q: int) -> int:
    """Of a stretch that has period q and is at least twice as long: the divisor of q that is its smallest period."""
    rest, d = q, 2
    while rest > 1:
        if rest % d:
            d = d + 1 if d * d <= rest else rest
            continue
        rest //= d
        if (x[: len(x) - q // d] == x[q // d :]).all():
            q //= d
    return q


def scan(ids: np.ndarray, lengths: np.ndarray, low: int = 1, high: int | None = None) -> np.ndarray:
    """Rows (start, stop, period) of the runs that lags low to high (high left out) show; ``ids``: of texts end to end, longest first."""
    found = np.zeros((0, 3), np.int64)
    if not len(lengths):
        return found
    ends, most = np.cumsum(lengths), int(lengths[0]) // MIN_EXPONENT
    ids = ids + np.repeat(np.arange(len(lengths)), lengths) * (int(ids.max(initial=0)) + 1)  # no word is another text's
    for q in range(low, min(most + 1, high or most + 1)):
        texts = int(np.searchsorted(-lengths, -max(MIN_LENGTH, MIN_EXPONENT * q), side="right"))
        if not texts:
            break
        x, need = ids[: ends[texts - 1]], max(MIN_LENGTH - q, (MIN_EXPONENT - 1) * q)
        m = len(x) - q
        if q < DENSE:
            begins, stops = _true_stretches(x[:m] == x[q:])
            keep = stops - begins >= need
            new = [(b, e) for b, e in zip(begins[keep].tolist(), stops[keep].tolist())]
        else:
            new, step = [], need - 2
            same = x[: m - 2 : step] == x[q : m + q - 2 : step]
            if not same.any():
                continue
            at = np.flatnonzero(same) * step
            at = at[(x[at + 1] == x[at + 1 + q]) & (x[at + 2] == x[at + 2 + q])]
            if len(at) and len(found):
                # in a known run whose period divides q, the stretch of lag q is that run
                known = found[(q % found[:, 2] == 0) & (found[:, 1] - found[:, 0] > q)]
                if len(known):
                    known = known[np.argsort(known[:, 0], kind="stable")]
                    upto, k = np.maximum.accumulate(known[:, 1] - q), np.searchsorted(known[:, 0], at, side="right") - 1
                    at = at[(k < 0) | (upto[k] <= at)]
            k = 0
            while k < len(at):
                begin, end = _extent(x, q, int(at[k]))
                if end - begin >= need:
                    new.append((begin, end))
                k = max(k + 1, int(np.searchsorted(at, end)))
        if new:
            rows = np.array([(b, e + q, smallest_period(x[b : e + q], q)) for b, e in new], np.int64)
            found = np.unique(np.concatenate((found, rows)), axis=0)
    return found


class _Texts:
    """A slice's words."""

    def __init__(self, text: pa.Array):
        self.buf, self.ends = buffer_of(text)
        self.starts, self.stops, self.first = word_bounds(self.buf, self.ends, NOT_BLANK)

    def runs(self, low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, start, stop, period) in words of that text, by text, start and period."""
        lengths = np.diff(self.first)
        order = np.argsort(-lengths, kind="stable")
        ids = word_ids(self.buf, self.starts, self.stops)
        sorted_lengths = lengths[order]
        begin = np.cumsum(sorted_lengths) - sorted_lengths
        moved = ids[np.arange(len(ids)) - np.repeat(begin, sorted_lengths) + np.repeat(self.first[order], sorted_lengths)]
        found = scan(moved, sorted_lengths, low, high)
        which = np.searchsorted(begin + sorted_lengths, found[:, 0], side="right")
        rows = np.column_stack((order[which], found[:, 0] - begin[which], found[:, 1] - begin[which], found[:, 2]))
        return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]

    def collapsed(self, runs: np.ndarray) -> pa.Array:
        """The texts' words, joined by one space, without those after a run's first period."""
        n = len(self.starts)
        change, base = np.zeros(n + 1, np.int64), self.first[runs[:, 0]]
        np.add.at(change, base + runs[:, 1] + runs[:, 3], 1)
        np.add.at(change, base + runs[:, 2], -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        text = np.searchsorted(self.first, kept, side="right") - 1
        more = np.concatenate((text[1:] == text[:-1], [False])) if len(kept) else np.zeros(0, bool)
        mark = np.zeros(len(self.buf) + 1, np.int8)
        mark[self.starts[kept]] += 1
        np.add.at(mark, self.stops[kept] + more, -1)  # a word, and the blank after it if another one follows
        inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
        out = np.where(NOT_BLANK[self.buf], self.buf, np.uint8(32))[inside]
        places = np.concatenate(([0], np.cumsum(inside)))[self.ends]
        return pa.LargeStringArray.from_buffers(len(self.ends) - 1, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SHAPE = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _result(doc_id: pa.Array, texts: _Texts, runs: np.ndarray) -> pa.RecordBatch:
    n = len(doc_id)
    places = pa.array(np.searchsorted(runs[:, 0], np.arange(n + 1)), pa.int32())
    each = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 1], runs[:, 2] - runs[:, 1], runs[:, 3])], fields=list(_RUN))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(texts.first)), pa.ListArray.from_arrays(places, each), texts.collapsed(runs)], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame, lags: int = LAGS) -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words without those that any
    run has after its first period, joined by one space).

    Words: ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A null text has none: no runs, '' collapsed. Repeated rows give repeated rows; null ids
    stay; other columns are ignored; an empty table gives no rows. ``lags``: a text that may have more is dealt out by ranges of so many.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    bound = 2 * MIN_EXPONENT * lags  # a word takes two bytes, the blank after it included

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            texts = _Texts(batch.column("text"))
            yield _result(batch.column("doc_id"), texts, texts.runs())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1):
            low = batch.column("low")[0].as_py()
            runs = _Texts(batch.column("text")).runs(low, low + lags)
            row = np.full(len(runs), batch.column("row")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, *runs[:, 1:].T)], names=["row", "start", "stop", "period"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1):
            runs = np.array([(0, r["start"], r["stop"], r["period"]) for r in batch.column("found")[0].as_py() or []], np.int64).reshape(-1, 4)
            yield _result(batch.column("doc_id"), _Texts(batch.column("text")), runs)

    short = rows.filter(size < bound).mapInArrow(whole, _SHAPE)
    long = written(rows.filter(size >= bound).withColumn("row", F.monotonically_increasing_id()), "long_texts")
    dealt = long.select("row", "text", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / bound).cast("int"))).alias("k"))
    dealt = dealt.select("row", "text", (F.col("k") * lags + 1).cast("bigint").alias("low")).repartition("row", "low")
    found = dealt.mapInArrow(part, "row bigint, start bigint, stop bigint, period bigint").distinct()
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "stop"))).alias("found"))
    return short.unionByName(long.join(found, "row", "left").select("doc_id", "text", "found").mapInArrow(together, _SHAPE))


def planted(documents: DataFrame) -> DataFrame:
    """The contract's texts: every tenth document, by crc32 of its id, is periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    chosen = chosen.withColumn("_words", F.when(F.col("_g").isNotNull(), words)).withColumn("_n", F.size("_words"))
    chosen = chosen.withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    chosen = chosen.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    block = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), " ")
    return chosen.withColumn("text", F.when(F.col("_n") > 0, text).otherwise(F.col("text"))).drop("_g", "_words", "_n", "_a", "_p")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    # greatest length first, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = periodic_runs(planted(documents)).withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
