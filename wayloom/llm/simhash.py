"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has 64 bits: bit k is 1 if it is 1 in over half of its word shingles' XXH64 hashes.
Documents whose fingerprints differ in at most ``budget`` bits are linked; groups are the connected components.

Equal fingerprints meet in one grouping first, so a copy, however often it stands in the corpus, is one row from there
on. The distinct fingerprints are joined with themselves:

* The 64 bits are cut into budget + 2 blocks. Two fingerprints within the budget agree in at least two blocks, so each pair of
  blocks (15 at a budget of 4) roots a forest of tries, one for each value of the two blocks: the rows are dealt by (pair of blocks,
  value). These are the node pairs of the top levels of the trie that have spent no error.
* Within a trie the other bits are traversed level by level, node pairs together: both nodes' children are paired,
  differing bits are added up, and a pair over the budget is pruned. Each node is a range of the sorted fingerprints, so a level of all
  tries of a batch is a few array expressions.
* What comes out is a spanning forest of the links found, not every pair: a trie of m rows gives at most m - 1 edges.
  Rows that are already connected (with the trie's first row, with a sorted neighbour) make uniform nodes, and a pair of
  nodes of one and the same group isn't entered.
* A trie with over ``split_rows`` rows is split into chunks by a hash of the fingerprint, and each pair of chunks is a task's
  work of its own; no row is dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.shared import written
from .words import LOWER, NOT_BLANK, buffer_of, slices, word_bounds

SHINGLE = 4
BUDGET = 4
SEED = 42
SPLIT_ROWS = 1 << 14
FRONTIER = 1 << 20


def fingerprints_of(buf: np.ndarray, ends: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints (unsigned) of the texts in a buffer; A-Z is lowered here."""
    starts, stops, first = word_bounds(buf, ends, NOT_BLANK)
    data = LOWER[buf].tobytes()
    n = len(ends) - 1
    counts = np.diff(first)
    words = [data[s:e] for s, e in zip(starts.tolist(), stops.tolist())]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes: list[int] = []
    sizes = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= shingle:
            hashes += [digest(join(words[i : i + shingle]), SEED) for i in range(low, high - shingle + 1)]
        elif high > low:
            hashes.append(digest(join(words[low:high]), SEED))
    out = np.zeros(n, np.uint64)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = np.concatenate(([0], np.cumsum(sizes)))
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    some = np.flatnonzero(sizes)
    # sums of runs of rows: no row of a text without words stands between them
    ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
    out[some] = ((2 * ones > sizes[some, None]) * place).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (bigint, the fingerprint's 64 bits). A null text, or one without words, has 0."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints_of(*buffer_of(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(made, "doc_id bigint, fp bigint")


def block_masks(budget: int) -> list[int]:
    """For each pair of the budget + 2 blocks, the mask of their bits."""
    n = budget + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (an index of a member, the least) after the links a-b."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new[labels]]
        while True:
            again = new[new]
            if np.array_equal(again, new):
                break
            new = again
        if np.array_equal(new, labels):
            return labels
        labels = new


def _uniform_until(labels: np.ndarray) -> np.ndarray:
    """For each row, where the run of its label ends."""
    change = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    stops = np.append(change, len(labels))
    return stops[np.searchsorted(change, np.arange(len(labels)), side="right")]


def trie_links(fp: np.ndarray, trie: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect, in each trie, exactly the rows that links within the budget connect.

    ``fp`` (unsigned) is sorted within equal values of ``trie``.
    """
    n = len(fp)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    begin = np.flatnonzero(np.concatenate(([True], trie[1:] != trie[:-1])))
    end = np.append(begin[1:], n)
    big = end - begin > 1
    begin, end = begin[big], end[big]
    if not len(begin):
        return none, none
    rows = np.arange(n)
    own = np.clip(np.searchsorted(begin, rows, side="right") - 1, 0, None)
    head = begin[own]
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside)[:n] > 0
    near = lambda a, b: np.bitwise_count(fp[a] ^ fp[b]) <= budget
    middle = head + (end - begin)[own] // 2
    links = []
    for other in (head, np.where(inside, middle, rows), np.where(inside & (rows > head), rows - 1, rows)):
        ok = inside & (rows != other)
        ok[ok] = near(rows[ok], other[ok])
        links.append((rows[ok], other[ok]))
    a, b = (np.concatenate(x) for x in zip(*links))
    labels = _roots(np.arange(n), a, b)
    kept = [(a, b)]
    ones = np.zeros(n + 1, np.int32)

    def zeros_in(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return low + (high - low) - (ones[high] - ones[low])

    work = [(63, begin, end, begin, end, np.zeros(len(begin), np.int8))]
    while work:
        bit, al, ah, bl, bh, diff = work.pop()
        until = _uniform_until(labels)
        live = ~((labels[al] == labels[bl]) & (until[al] >= ah) & (until[bl] >= bh))
        al, ah, bl, bh, diff = (x[live] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        if bit < 0:  # both nodes are single fingerprints (equal ones can't be in a trie twice)
            kept.append((al, bl))
            labels = _roots(labels, al, bl)
            continue
        if len(al) > FRONTIER:
            for part in np.array_split(np.arange(len(al)), 2 * len(al) // FRONTIER):
                work.append((bit, al[part], ah[part], bl[part], bh[part], diff[part]))
            continue
        np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        am, bm = zeros_in(al, ah), zeros_in(bl, bh)
        own = al == bl
        two = ~own
        d1 = diff + np.int8(1)
        parts = [
            (al, am, bl, bm, diff, np.ones(len(al), bool)), (am, ah, bm, bh, diff, np.ones(len(al), bool)),
            (al, am, bm, bh, d1, np.ones(len(al), bool)), (am, ah, bl, bm, d1, two),
        ]
        cat = [np.concatenate(x) for x in zip(*parts)]
        al, ah, bl, bh, diff, ok = cat
        ok &= (ah > al) & (bh > bl) & (diff <= budget)
        ok &= ~((al == bl) & (ah - al < 2))
        al, ah, bl, bh, diff = (x[ok] for x in (al, ah, bl, bh, diff))
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():  # two leaves: the rest of the path at once
            sa, sb = al[single], bl[single]
            good = near(sa, sb) & (labels[sa] != labels[sb])
            if good.any():
                kept.append((sa[good], sb[good]))
                labels = _roots(labels, sa[good], sb[good])
            al, ah, bl, bh, diff = (x[~single] for x in (al, ah, bl, bh, diff))
        if len(al):
            work.append((bit - 1, al, ah, bl, bh, diff))
    # a spanning forest: every row that is not its component's root, linked with the root
    moved = np.flatnonzero(labels != rows)
    return moved, labels[moved]


def link_edges(classes: DataFrame, budget: int = BUDGET, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges (a, b) between the ``rep`` of distinct fingerprints (rep, fp) that connect what the budget links."""
    masks = block_masks(budget)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    dealt = classes.select(
        "rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("bigint")) for m in masks])).alias("forest", "path")
    ).select("rep", "fp", F.xxhash64("forest", "path").alias("trie"))  # equal hashes of other tries only add work
    sizes = dealt.groupBy("trie").agg(F.count("*").alias("n"))
    dealt = dealt.join(sizes.filter("n > 1"), "trie")
    # chunks 0 .. g-1 of a trie; (i, j) with i <= j is one piece of work, to which chunks i and j go
    g = F.ceil(F.col("n") / split_rows).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(1), "fp"), g.cast("bigint")).cast("int")
    pieces = F.when(F.col("n") <= split_rows, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), g - 1), lambda k: F.struct(F.least(chunk, k).alias("i"), F.greatest(chunk, k).alias("j")))
    )
    work = dealt.select("rep", "fp", F.col("trie"), F.explode(pieces).alias("p")).select(
        "rep", "fp", F.when((F.col("p.i") == 0) & (F.col("p.j") == 0), F.col("trie")).otherwise(F.xxhash64("trie", "p.i", "p.j")).alias("trie")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            trie, fp, rep = (table.column(c).to_numpy() for c in ("trie", "fp", "rep"))
            order = np.lexsort((fp.view(np.uint64), trie))
            trie, fp, rep = trie[order], fp.view(np.uint64)[order], rep[order]
            a, b = trie_links(fp, trie, budget)
            return pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            # a trie may go on in the next batch: hold back the last one
            trie = batch.column("trie").to_numpy()
            cut = int(np.searchsorted(trie, trie[-1], side="left"))
            if cut == 0:
                if held and held[-1].column("trie")[-1].as_py() != trie[0]:
                    yield out(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
            else:
                yield out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield out(pa.Table.from_batches(held))

    work = work.repartition("trie").sortWithinPartitions("trie").select("trie", "fp", "rep")
    return work.mapInArrow(linked, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id that links reach, itself included).

    Documents without words all have fingerprint 0 and are linked like others. Rows with a null doc_id are left out; an id that
    stands in several rows links them. Other columns are ignored; an empty table gives no rows.
    """
    made = written(fingerprints(documents.filter("doc_id IS NOT NULL"), shingle), "fingerprints")
    # an id with several texts links their fingerprints: by its smallest
    classes = written(made.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    several = made.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("doc_id")
    shared_ids = made.join(several, "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = link_edges(classes, budget, split_rows).unionByName(shared_ids)
    groups = connected_components(edges)
    rooted = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return made.join(rooted, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
