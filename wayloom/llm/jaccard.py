"""Pairs of texts whose word-shingle sets have a Jaccard similarity of at least ``num / den``: an exact set-similarity join.

Shingles have one order for all texts. Of two sets of the similarity asked for, the first n - ceil(t n) + 1 shingles of each (its prefix)
have a shingle in common, whatever the order is; so texts meet by the shingles of their prefixes, and no pair is missed. The
order is by rarity: every shingle of every text is counted in a hashed table of a fixed size, and the smallest counts come first. That two shingles share a cell only
changes the order, which changes the groups' sizes but no result.

* Texts with equal shingle sets are one class, by a 64-bit hash of the set; that two sets with one hash are equal is taken for granted.
* First every class of a group is held against the group's head, the class with the fewest shingles that no other text has; then, in
  groups that are not connected yet, each pair of classes of different components.
* Each set has a sketch, the number of its shingles in each of some bins, which bounds from above what two sets can share: it rules most
  other pairs out before their texts are fetched.
* Only pairs that can reach the similarity by the sizes of their sets, and by how much is left of both after the shingle they meet by, are looked at.
* A pair counts once the exact sets of shingles (bytes, no hashes) have the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.shared import dropped, written
from .words import LOWER, NOT_BLANK, buffer_of, joined_hashes, one_text, slices, word_bounds, word_hashes

SHINGLE = 5
NUM, DEN = 4, 5
#: Cells of the table of counts, as a power of two: at most, and how many a text. Cells that travel together. Classes that a task remembers.
CELL_BITS, CELLS_A_TEXT, CELLS_A_ROW = 20, 4, 1 << 10
REMEMBERED = 1 << 20


def shingle_hashes(buf: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted. A text of fewer words is one shingle, one without words has none."""
    buf = LOWER[buf]
    starts, stops, first = word_bounds(buf, ends, NOT_BLANK)
    h = word_hashes(buf, starts, stops)
    runs = joined_hashes(h, shingle)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        k = high - low
        own = runs[low : high - shingle + 1] if k >= shingle else joined_hashes(h[low:high], k) if k else h[:0]
        out.append(np.unique(own.view(np.int64)))
    return out


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def rarity(documents: DataFrame) -> np.ndarray:
    """How many texts hold the shingles of each cell: a table of at most 2 ** CELL_BITS counts over all documents, whatever their number.

    Each task adds up its own table; tables travel in rows of ``CELLS_A_ROW`` cells and are added up as they come, so no task holds more than one table. Only the sum
    (8 MB at most) comes to the driver.
    """
    bits = min(CELL_BITS, max(10, (documents.count() * CELLS_A_TEXT).bit_length()))
    width = min(CELLS_A_ROW, 1 << bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int64)
        for batch in slices(batches, most=1 << 20):
            table += np.bincount(_cells(np.concatenate(shingle_hashes(*buffer_of(batch.column("text")))), bits), minlength=1 << bits)
        rows = [(k, table[k * width : (k + 1) * width].tobytes()) for k in range(len(table) // width)]
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64]), (pa.int32(), pa.binary()))], names=["k", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("k").to_pylist(), batch.column("cells")):
                own = np.frombuffer(cells.as_buffer(), np.int64)
                total[k] = total[k] + own if k in total else own.copy()
        for k, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["k", "cells"])

    shape = "k int, cells binary"
    out = np.zeros(1 << bits, np.int64)
    for r in documents.select(F.col("text").cast("string")).mapInArrow(counted, shape).repartition("k").mapInArrow(added, shape).toLocalIterator():
        out[r.k * width : (r.k + 1) * width] = np.frombuffer(bytes(r.cells), np.int64)
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """How many shingles fall into each of a power of two of bins, about four a bin, as 32-bit numbers."""
    bits = max(4, int(len(hashes) - 1).bit_length() - 2)
    return np.bincount((hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4").tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """An upper bound of the shingles that two sets share: in no bin can it be more than the fewer of both."""
    u, v = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    while len(u) > len(v):
        u = u.reshape(-1, 2).sum(axis=1)
    while len(v) > len(u):
        v = v.reshape(-1, 2).sum(axis=1)
    return int(np.minimum(u, v).sum())


def with_prefixes(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, text, c (the class), n (distinct shingles), prefix, sketch. Texts without words are left out. ``counts``: of ``rarity``, or empty.

    Of a task's rows of one class only the first has its prefix and sketch: however often a text is copied, it sends a task's worth of shingles at most.
    """
    bits, sent = len(counts).bit_length() - 1, documents.sparkSession.sparkContext.broadcast(counts)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets = shingle_hashes(*buffer_of(batch.column("text")))
            keep = [k for k, s in enumerate(sets) if len(s)]
            prefixes, classes, sketches = [], [], []
            for k in keep:
                s = sets[k]
                classes.append(xxhash.xxh64_intdigest(s.tobytes()))
                if classes[-1] in seen:
                    prefixes.append(s[:0])
                    sketches.append(None)
                    continue
                if len(seen) == REMEMBERED:
                    seen.clear()
                seen.add(classes[-1])
                late = sent.value[_cells(s, bits)] if bits > 0 else np.zeros(len(s), np.int64)
                prefixes.append(s[np.lexsort((s, late))][: len(s) - -(-len(s) * NUM // DEN) + 1])
                sketches.append(sketch(s))
            at = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("text").take(rows), pa.array(np.array(classes, np.uint64).view(np.int64)),
                    pa.array([len(sets[k]) for k in keep], pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "text", "c", "n", "prefix", "sketch"],
            )

    columns = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return columns.mapInArrow(made, "doc_id bigint, text string, c bigint, n int, prefix array<bigint>, sketch binary")


def shingle_set(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    words = one_text(text or "", NOT_BLANK)
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def similar(x: set, y: set) -> bool:
    both = len(x & y)
    return DEN * both >= NUM * (len(x) + len(y) - both)


def reachable(n: str, i: str, n2: str, i2: str) -> str:
    """Whether sets of n and n2 shingles that first share the one at places i and i2 (from 0) can be similar: by their sizes, and by what is left after it."""
    return f"{DEN} * least({n}, {n2}) >= {NUM} * greatest({n}, {n2}) AND {NUM + DEN} * (1 + least({n} - {i} - 1, {n2} - {i2} - 1)) >= {NUM} * ({n} + {n2})"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, set()
    for batch in batches:
        keep = []
        for k in range(batch.num_rows):  # a pair of texts at a time, however long they are
            x, y = (batch.column(c)[k].as_py() for c in ("x", "y"))
            if x != last:
                last, held = x, shingle_set(x)
            if similar(held, shingle_set(y)):
                keep.append(k)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "x", "y")))
        keep = [k for k, (n1, n2, x, y) in enumerate(rows) if (NUM + DEN) * most_shared(x, y) >= NUM * (n1 + n2)]
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _verified(pairs: DataFrame, documents: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs of classes (a, b) that are similar.

    First the pairs whose sketches rule it out go (none that is similar does); only for the rest a document of each class is fetched.
    """
    x, y = (reps.select(F.col("c").alias(c), F.col("n").alias(n), F.col("sketch").alias(t)) for c, n, t in (("a", "n1", "x"), ("b", "n2", "y")))
    pairs = written(pairs.join(y, "b").join(x, "a").select("a", "b", "n1", "n2", "x", "y").mapInArrow(_possible, "a bigint, b bigint"), "possible")
    asked = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    needed = written(reps.join(asked, "c", "left_semi").select("c", F.col("rep").alias("doc_id")), "needed")
    some = documents.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = with_prefixes(some, np.zeros(0, np.int64)).join(needed.select("c"), "c", "left_semi").groupBy("c").agg(F.min("text").alias("text"))
    texts = written(texts, "texts")
    x, y = (texts.select(F.col("c").alias(c), F.col("text").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    out = written(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_checked, "a bigint, b bigint"), "similar")
    for df in (pairs, needed, texts):
        dropped(df)
    return out


def similar_links(documents: DataFrame) -> DataFrame:
    """Edges (a, b: doc_id) that connect exactly the documents that pairs of similar texts connect. Rows without an id or a text are left out;
    an id that stands in several rows stands for all their texts. An empty table gives no rows.
    """
    documents = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    made = written(with_prefixes(documents, rarity(documents)).drop("text"), "prefixes")
    # every class by its smallest document
    reps = written(made.groupBy("c").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")), "reps")
    entries = made.select("c", "n", F.size("prefix").alias("p"), F.posexplode("prefix").alias("i", "s"))
    # one shuffle: which shingles several classes have is seen where their rows meet
    w = W.partitionBy("s")
    met = entries.withColumns({"_low": F.min("c").over(w), "_high": F.max("c").over(w)}).filter("_low < _high").drop("_low", "_high")
    met = written(met.distinct(), "met")
    # a group's head is its class with the fewest shingles of its own, so that edited copies meet the text that they are nearest to
    alone = met.groupBy("c").agg((F.lit(1.0) - F.count("*") / F.max("p")).alias("alone"))
    shared = written(met.drop("p").join(alone, "c"), "shared")
    heads = shared.groupBy("s").agg(F.min_by(F.struct("c", "n", "i"), F.struct("alone", "c")).alias("h"))
    stars = shared.join(heads, "s").filter(f"c <> h.c AND {reachable('n', 'i', 'h.n', 'h.i')}").select(F.col("h.c").alias("a"), F.col("c").alias("b")).distinct()
    stars = written(stars, "stars")
    near = _verified(stars, documents, reps)

    groups = connected_components(near).withColumnRenamed("node", "c")
    named = shared.drop("alone").join(groups, "c", "left").withColumn("g", F.coalesce("component", "c")).drop("component")
    # a group whose classes are connected has nothing left to find
    open_ = named.groupBy("s").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high").select("s")
    named = written(named.join(open_, "s", "left_semi"), "open")
    right = named.select("s", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "i", "g")])
    pairs = named.join(right, "s").filter(f"c < c2 AND g <> g2 AND {reachable('n', 'i', 'n2', 'i2')}").select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct()
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _verified(pairs.join(seen, ["a", "b"], "left_anti"), documents, reps)

    between = near.unionByName(rest)
    for c in ("a", "b"):
        between = between.join(reps.select(F.col("c").alias(c), F.col("rep").alias(f"{c}_rep")), c)
    for df in (met, shared, stars, named):
        dropped(df)
    own = made.select("doc_id", "c").join(reps, "c").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return own.unionByName(between.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
