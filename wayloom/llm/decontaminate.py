"""Benchmark decontamination as a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words is one window). A window
occurs in a document when all its words stand there in a row, so as a set of word shingles it must be
contained whole: with that threshold a window's *prefix*, the shingles that a match can't lack, is its single
rarest shingle. The steps:

1. count the benchmark's shingles over all documents (rarity);
2. take each window's rarest shingle, with its offset in the window, as its prefix;
3. join the documents' shingles with the prefixes; a match at position p puts the window at p - offset,
   which must lie within the document (length and positional bounds);
4. verify the words of the window there, byte by byte, and mark them.

The benchmark is worked on in blocks of at most ``block_bytes`` of item text (one item at least), so what is
broadcast is bounded however large the benchmark; a block costs a pass over the documents. Documents aren't
shuffled: each is a row that is read, worked on and done. A shingle that is common in the
documents makes no group of rows, and is a prefix only where a window has no rarer one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import dropped, written
from .words import ALNUM, LOWER, buffer_of, joined_hashes, slices, word_bounds, word_hashes

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20


class Windows:
    """The windows of a block of items as flat arrays: the items' lowered bytes, word bounds and word hashes, and for each window its first word.

    A window takes about 30 bytes beside the items' text, so a block of 8 MB stays under 100 MB on the driver and in a task.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int, shingle: int):
        self.names = [name for name, _ in items]
        ends = np.concatenate(([0], np.cumsum([len(text) for _, text in items]))).astype(np.int64)
        buf = LOWER[np.frombuffer(b"".join(text for _, text in items), np.uint8)]
        starts, stops, first = word_bounds(buf, ends, ALNUM)
        self.hashes = word_hashes(buf, starts, stops)
        self.data, self.starts, self.stops = buf.tobytes(), starts.astype(np.int32), stops.astype(np.int32)
        counts = np.diff(first)
        width = np.minimum(counts, size)
        n = np.where(counts > 0, counts - width + 1, 0)
        #: per window: the item, its first word (in the block) and its number of words
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), n)
        self.begin = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)).astype(np.int32)
        self.width = np.repeat(width, n).astype(np.int32)
        self.shingle = shingle
        self.sizes = np.unique(np.minimum(self.width, shingle)).tolist()
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *(joined_hashes(self.hashes, k) for k in self.sizes)]))

    def prefixes(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each window's rarest shingle (ties: the smaller hash): the distinct hashes, where the windows of each begin, those windows, and the shingle's place in them."""
        key, place = np.zeros(len(self.begin), np.uint64), np.zeros(len(self.begin), np.int32)
        for k in self.sizes:
            own = joined_hashes(self.hashes, k)
            seen = counts[np.searchsorted(self.all, own)]
            some = np.flatnonzero(np.minimum(self.width, self.shingle) == k)
            best = np.full(len(some), -1)
            for at in range(int((self.width[some] - k + 1).max(initial=0))):
                here = self.begin[some] + at
                fits = at <= self.width[some] - k
                here = np.where(fits, here, self.begin[some])
                better = fits & ((best < 0) | (seen[here] < seen[best]) | ((seen[here] == seen[best]) & (own[here] < own[best])))
                best = np.where(better, here, best)
            key[some], place[some] = own[best], best - self.begin[some]
        order = np.argsort(key, kind="stable").astype(np.int32)
        keys, at = np.unique(key[order], return_index=True)
        return keys, np.append(at, len(order)).astype(np.int32), order, place

    def same(self, window: int, words: list[bytes]) -> bool:
        low = int(self.begin[window])
        return all(self.data[self.starts[low + i] : self.stops[low + i]] == x for i, x in enumerate(words))


class _Sieve:
    """Membership in a sorted set of hashes: a bit table first, then a binary search for what passes it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(12, int(len(keys)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` whose hash is a key, and which key."""
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[key] == h[at]
        return at[ok], key[ok]


def _tokenized(batch: pa.RecordBatch):
    buf, ends = buffer_of(batch.column("text"))
    buf = LOWER[buf]
    starts, stops, first = word_bounds(buf, ends, ALNUM)
    return buf, starts, stops, first, word_hashes(buf, starts, stops)


def _inside(at: np.ndarray, doc_of: np.ndarray, size: int) -> np.ndarray:
    """Shingles that don't run over into the next document."""
    return doc_of[at] == doc_of[at + size - 1]


def shingle_counts(documents: DataFrame, windows) -> np.ndarray:
    """How often each of the benchmark's shingles stands in all documents. ``windows``: a broadcast block."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        sieve, total = _Sieve(w.all), np.zeros(len(w.all), np.int64)
        for batch in slices(batches):
            _, starts, _, first, h = _tokenized(batch)
            doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for size in w.sizes:
                at, key = sieve.find(joined_hashes(h, size))
                total += np.bincount(key[_inside(at, doc_of, size)], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["shingle", "n"])

    out = np.zeros(len(windows.value.all), np.int64)
    got = documents.select("text").mapInArrow(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("shingle").to_numpy()] = got.column("n").to_numpy()
    return out


def _block_hits(documents: DataFrame, windows, prefixes, clean_only: bool = False, more: bool = False) -> DataFrame:
    """doc_id, n_words, hit (merged [start, end) word ranges as a flat list), items; or the rows of ``documents`` without a hit.

    Columns hit and items of ``documents``, from blocks before, are taken in; ``more`` keeps the text for the blocks to come.
    """
    names = ["doc_id", "n_words", "hit", "items", *["text"] * more]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        keys, bounds, order, place = prefixes.value
        sieve = _Sieve(keys)
        for batch in slices(batches):
            buf, starts, stops, first, h = _tokenized(batch)
            n_words = np.diff(first)
            doc_of = np.repeat(np.arange(len(n_words)), n_words)
            marks: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            data = buf.tobytes()
            for size in w.sizes:
                at, key = sieve.find(joined_hashes(h, size))
                ok = _inside(at, doc_of, size)
                at, key = at[ok], key[ok]
                # every window that a matched shingle is the prefix of, where it would stand
                n = bounds[key + 1] - bounds[key]
                window = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[key], n)]
                begin = np.repeat(at, n) - place[window]
                width = w.width[window]
                doc = np.repeat(doc_of[at], n)
                ok = (np.minimum(width, w.shingle) == size) & (begin >= first[doc]) & (begin + width <= first[doc + 1])
                for i in range(int(width.max(initial=0))):
                    here = np.flatnonzero(ok & (width > i))
                    ok[here] = h[begin[here] + i] == w.hashes[w.begin[window[here]] + i]
                for d, k, low in zip(doc[ok].tolist(), window[ok].tolist(), begin[ok].tolist()):
                    high = low + int(w.width[k])
                    if w.same(k, [data[starts[i] : stops[i]] for i in range(low, high)]):
                        marks.setdefault(d, []).append((low - int(first[d]), high - int(first[d])))
                        items.setdefault(d, set()).add(w.names[w.item[k]])
            if clean_only:
                yield batch.filter(pa.array([d not in marks for d in range(len(n_words))], pa.bool_()))
                continue
            if "hit" in batch.schema.names:
                for d, (ranges, known) in enumerate(zip(batch.column("hit").to_pylist(), batch.column("items").to_pylist())):
                    if ranges:
                        marks.setdefault(d, []).extend(zip(ranges[::2], ranges[1::2]))
                        items.setdefault(d, set()).update(known)
            merged = [_merge(marks.get(d, ())) for d in range(len(n_words))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(merged, pa.list_(pa.int64())), pa.array([sorted(items.get(d, ())) for d in range(len(n_words))], pa.list_(pa.string())), *[batch.column("text")] * more],
                names=names,
            )

    if clean_only:
        return documents.mapInArrow(hits, documents.schema)
    before = [c for c in ("hit", "items") if c in documents.columns]
    return documents.select(F.col("doc_id").cast("bigint"), "text", *before).mapInArrow(hits, "doc_id bigint, n_words bigint, hit array<bigint>, items array<string>" + ", text string" * more)


def _merge(ranges) -> list[int]:
    out: list[int] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, in blocks of about ``block_bytes``, dealt by a hash of the id."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r.item_id, r.text.encode()) for r in part.orderBy("item_id").toLocalIterator()]


def contamination(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (ids of the items with an occurring window, sorted), hit
    (the hit word ranges, start and end in turn).

    Words are runs of digits, letters and non-ASCII characters after A-Z became lower case. A null text has no words;
    items without words or with a null id have no windows; a doc_id that stands in several rows, or is null, gives a row each.
    Other columns are ignored. Each block of the benchmark adds to the rows that the block before has written: no key joins them.
    """
    sc = documents.sparkSession.sparkContext
    found, blocks = documents.select("doc_id", "text"), _blocks(benchmark, block_bytes)
    items = next(blocks)
    while items is not None:
        following = next(blocks, None)
        windows = Windows(items, size, shingle)
        sent = sc.broadcast(windows)
        prefixes = sc.broadcast(windows.prefixes(shingle_counts(documents, sent)))
        before, found = found, _block_hits(found, sent, prefixes, more=following is not None)
        if following is not None:
            found = written(found, "hits")
            dropped(before)
        items = following
    ends = F.filter("hit", lambda x, i: i % 2 == 1)
    begins = F.filter("hit", lambda x, i: i % 2 == 0)
    n_hit = F.aggregate(F.zip_with(ends, begins, lambda e, b: e - b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "hit")


def decontaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents``, whole, in which no window of any item occurs. Nothing is shuffled; between two blocks of a large benchmark the rows are written, and the block's windows given back."""
    sc = documents.sparkSession.sparkContext
    kept, blocks = documents, _blocks(benchmark, block_bytes)
    items = next(blocks, None)
    while items is not None:
        windows = Windows(items, size, shingle)
        sent = sc.broadcast(windows)
        prefixes = sc.broadcast(windows.prefixes(shingle_counts(documents, sent)))
        before, kept = kept, _block_hits(kept, sent, prefixes, clean_only=True)
        items = next(blocks, None)
        if items is not None:
            kept = written(kept, "clean")
            dropped(before)
            sent.unpersist(), prefixes.unpersist()
    return kept


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
occ AS (SELECT doc_id, item, i, dw.size FROM dw JOIN wins USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
