"""Alignment of two tokenizers' tokens over the same text.

The text's bytes are marked twice, in two packed bitsets: where tokens of A end, and where tokens of B end. Their AND
has the shared cuts; a rank (popcount) at each cut gives the range of A's and of B's tokens between two cuts, a group, and
every A token of a group is linked with every B token of it.

A text is worked on in chunks. A chunk begins where a space follows a character that is surely no white space. A's pre-tokenizer has a boundary at
every such place, and no piece of B reaches over one (``Pair`` looks through the vocabulary), so both tokenizers give a chunk the same
tokens as they give it inside its text, and its bounds are shared cuts. All results of a text are then sums over its chunks, and a
chunk that occurs again isn't encoded again (a task keeps up to ``KEPT`` of them).

How many documents hold a pair of ids linked is counted over the whole corpus. A slice (about 2 MB of texts) lists its distinct pairs once, and its
documents point into that list; only the lists are grouped and joined with the counts, not every document's pairs, and nothing that grows is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.shared import written

from .words import slices, text_lengths

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks that a worker keeps; then it begins anew.
KEPT = 400_000
#: Chunks that B encodes in one piece.
TOGETHER = 64
#: Bytes of text worked on at a time.
SLICE = 1 << 21


class Bitset:
    """Bits in 64-bit words, with the number of set bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bitset:
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        return cls(np.packbits(bits, bitorder="little").view(np.uint64))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits up to and with each place."""
        at, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[at] + np.bitwise_count(self.words[at] & upto)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Pair:
    """Both tokenizers, and each id's bytes."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet, special = _byte_alphabet(), self.a.get_added_tokens_decoder()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = entry.encode() if k in special else bytes(alphabet[c] for c in entry)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, ...]:
        """Whether each chunk's bytes come back, A's and B's ids of all chunks that do, end to end, and how many each has.

        Chunks that end in no white space are encoded in one piece: there is a boundary between each two of them. One with a
        U+2581 of its own never comes back from B, which writes a space so, and one that isn't UTF-8 never from either.
        """
        n = len(chunks)
        texts = [c.decode("utf-8", "replace") for c in chunks]
        plain = np.fromiter((not (t[-1].isspace() or "\ufffd" in t or "▁" in t) for t in texts), bool, n)
        one = np.flatnonzero(plain).tolist()
        found = self._encode_one([chunks[k] for k in one], [texts[k] for k in one])
        if found is None:
            plain[:] = False
            found = [np.zeros(0, np.int64)] * 4
        known, counts = plain.copy(), np.zeros((2, n), np.int64)
        counts[:, plain] = found[2:]
        rest = {}
        for k in np.flatnonzero(~plain).tolist():
            a, b = self.a.encode(texts[k], add_special_tokens=False).ids, self.b.encode(texts[k][1:], num_threads=1) or [self.blank]
            if b"".join([self.a_bytes[x] for x in a]) == chunks[k] == b"".join([self.b_bytes[x] for x in b]):
                known[k], rest[k], counts[:, k] = True, (a, b), (len(a), len(b))
        flat = []
        for which in (0, 1):
            ids, at = np.zeros(int(counts[which].sum()), np.int64), np.cumsum(counts[which]) - counts[which]
            inside = np.repeat(plain, counts[which])
            ids[inside] = found[which]
            for k, x in rest.items():
                ids[at[k] : at[k] + len(x[which])] = x[which]
            flat.append(ids)
        return known, *flat, *counts

    def _encode_one(self, chunks: list[bytes], texts: list[str]) -> list[np.ndarray] | None:
        """A's ids, B's ids and how many each chunk has, of chunks in one piece; None if the bytes don't come back."""
        whole, data = "".join(texts), b"".join(chunks)
        if not whole:
            return [np.zeros(0, np.int64)] * 4
        a = np.array(self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int64)
        pieces = ["".join(texts[k : k + TOGETHER])[1:] for k in range(0, len(texts), TOGETHER)]  # B's queue of merges is fastest when short
        b = np.concatenate([np.array(x or [self.blank], np.int64) for x in self.b.encode(pieces, num_threads=1)])
        bounds = np.cumsum([len(c) for c in chunks])
        out = [a, b]
        for ids, lengths, table in ((a, self.a_lengths, self.a_bytes), (b, self.b_lengths, self.b_bytes)):
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, bounds)
            if not len(ends) or ends[-1] != len(data) or (ends[at] != bounds).any() or b"".join([table[k] for k in ids.tolist()]) != data:
                return None
            out.append(np.diff(at + 1, prepend=0))
        return out


_NOT_CUT_AFTER = np.zeros(256, bool)
_NOT_CUT_AFTER[:33] = True


def chunk_starts(buf: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts laid end to end (``texts``: where these begin); each text begins with a space."""
    n = len(buf)
    space = np.flatnonzero(buf == 32)
    space = space[space > 0]
    prev = buf[space - 1]
    sure = ~_NOT_CUT_AFTER[prev] & (prev != 127)
    two, three = buf[np.maximum(space - 2, 0)], buf[np.maximum(space - 3, 0)]
    # characters that may be white space in Unicode: U+0085, U+00A0, U+1680, U+2000 to 207F, U+3000 to 303F
    sure &= ~((two == 0xC2) & ((prev == 0x85) | (prev == 0xA0)))
    sure &= ~((three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80))
    mark = np.zeros(n + 1, bool)
    mark[space[sure]] = True
    mark[texts] = True
    return np.flatnonzero(mark[:n])


def spaced(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, a space before each that isn't empty, and where each begins (one entry more)."""
    lengths = text_lengths(text)
    data = b"".join(b" " + x for x in text.cast(pa.binary()).to_pylist() if x)
    return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(lengths + (lengths > 0))))


class Chunks:
    """Known chunks, by number: whether both tokenizers give their bytes back, and what alignment says of them."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.facts = np.zeros((0, 5), np.int64)  # valid, n_a, n_b, n_groups, n_links
        self.at = np.zeros(1, np.int64)  # where each chunk's links begin in pairs and times
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.number) > KEPT:
            self.forget()
        number = self.number
        new = [c for c in chunks if c not in number]
        if new:
            self._add(new)
        return np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))

    def _add(self, new: list[bytes]) -> None:
        base = len(self.number)
        self.number.update(zip(new, range(base, base + len(new))))
        known, a, b, n_a, n_b = self.pair.encode(new)
        owner, a_from, b_from, a_to, b_to = self._align(a, b, n_a)
        wide, high = a_to - a_from, b_to - b_from
        n_groups, n_links = np.bincount(owner, minlength=len(new)), np.bincount(owner, wide * high, len(new)).astype(np.int64)
        self.facts = np.concatenate((self.facts, np.stack((known.astype(np.int64), n_a, n_b, n_groups, n_links), 1)))
        pairs, times, counts = links(a, b, owner, a_from, a_to, b_from, b_to, len(self.pair.b_bytes), len(new))
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(counts)))
        text, ends = written_groups(a, b, a_to, b_to, n_a, n_b)
        self.groups += [text[s:e] for s, e in zip([0, *ends], ends)]

    def _align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each group's chunk, and its ranges of A's and B's tokens, over all new chunks laid end to end."""
        if not len(a):
            return (np.zeros(0, np.int64),) * 5
        a_ends, b_ends = np.cumsum(self.pair.a_lengths[a]), np.cumsum(self.pair.b_lengths[b])
        size = int(a_ends[-1]) + 1
        marks_a, marks_b = Bitset.of(a_ends, size), Bitset.of(b_ends, size)
        cuts = (marks_a & marks_b).select()
        a_to, b_to = marks_a.rank(cuts), marks_b.rank(cuts)
        a_from, b_from = np.concatenate(([0], a_to[:-1])), np.concatenate(([0], b_to[:-1]))
        return np.searchsorted(np.cumsum(n_a), a_from, side="right"), a_from, b_from, a_to, b_to


_DECIMALS: dict[int, np.ndarray] = {}


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to ``most``, left-justified with a place to spare, and how many each has."""
    if most not in _DECIMALS:
        text = np.array([str(k) for k in range(most + 1)], "S")
        _DECIMALS[most] = np.pad(text.view(np.uint8).reshape(most + 1, -1), ((0, 0), (0, 1)))
    table = _DECIMALS[most]
    return table, (table > 0).sum(1)


def written_groups(a, b, a_to, b_to, n_a, n_b) -> tuple[bytes, list[int]]:
    """The groups of all chunks as ``a1,a2|b1;a3|b2,b3;``, each with its semicolon, and where each chunk's end."""
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    group_a, group_b = np.repeat(np.arange(len(a_to)), np.diff(a_to, prepend=0)), np.repeat(np.arange(len(b_to)), np.diff(b_to, prepend=0))
    b_before = np.concatenate(([0], b_to[:-1])) if len(b_to) else b_to
    at_a, at_b = np.arange(len(a)) + b_before[group_a], np.arange(len(b)) + a_to[group_b]
    ids[at_a], ids[at_b] = a, b
    mark[at_a[a_to - 1]], mark[at_b[b_to - 1]] = ord("|"), ord(";")
    table, digits = _decimals(1 << max(16, int(ids.max(initial=0)).bit_length()))
    rows, length = table[ids], digits[ids]
    rows[np.arange(len(ids)), length] = mark
    text = rows[np.arange(rows.shape[1]) <= length[:, None]].tobytes()
    ends = np.concatenate(([0], np.cumsum(length + 1)))[np.cumsum(n_a + n_b)]
    return text, ends.tolist()


#: Links of a group, and of groups together, that are laid out at a time.
_LAID_OUT = 1 << 22


def _product(a: np.ndarray, b: np.ndarray, owner: np.ndarray, a_from, wide, b_from, high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (owner, a id, b id) of some groups."""
    each = wide * high
    group = np.repeat(np.arange(len(each)), each)
    k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return owner[group], a[a_from[group] + k // high[group]], b[b_from[group] + k % high[group]]


def links(a, b, owner, a_from, a_to, b_from, b_to, n_ids_b: int, n_owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (a * n_ids_b + b) of each owner, in order of owners; how often each is linked; and how many each owner has."""
    wide, high = a_to - a_from, b_to - b_from
    large = np.flatnonzero(wide * high > _LAID_OUT)  # of these, equal ids are counted first
    small = np.flatnonzero(wide * high <= _LAID_OUT)
    owners, pairs, times = [], [], []

    def add(o: np.ndarray, p: np.ndarray, t: np.ndarray) -> None:
        if len(p):
            order = np.lexsort((p, o))
            o, p, t = o[order], p[order], t[order]
            first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (p[1:] != p[:-1]))))
            owners.append(o[first]), pairs.append(p[first]), times.append(np.add.reduceat(t, first))

    cut = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum((wide * high)[small]) // _LAID_OUT)) + 1, [len(small)]))
    for s, e in zip(cut[:-1], cut[1:]):
        g = small[s:e]
        o, x, y = _product(a, b, owner[g], a_from[g], wide[g], b_from[g], high[g])
        add(o, x * n_ids_b + y, np.ones(len(o), np.int64))
    for g in large:
        x, n_x = np.unique(a[a_from[g] : a_to[g]], return_counts=True)
        y, n_y = np.unique(b[b_from[g] : b_to[g]], return_counts=True)
        add(np.full(len(x) * len(y), owner[g]), (x[:, None] * n_ids_b + y).ravel(), (n_x[:, None] * n_y).ravel())
    if len(owners) > 1:
        o, p, t = (np.concatenate(x) for x in (owners, pairs, times))
        owners, pairs, times = [], [], []
        add(o, p, t)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_owners, np.int64)
    return pairs[0], times[0], np.bincount(owners[0], minlength=n_owners)


def _ragged(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at[k] to at[k + 1] for each k in ``of``, end to end, and for each the index in ``of``."""
    n = at[of + 1] - at[of]
    row = np.repeat(np.arange(len(of)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + at[of][row], row


class _Slice:
    """A slice of a batch: each document's chunks by number."""

    def __init__(self, batch: pa.RecordBatch, chunks: Chunks):
        buf, ends = spaced(batch.column("text"))
        self.n = batch.num_rows
        starts = chunk_starts(buf, np.unique(ends[:-1][ends[:-1] < len(buf)])) if chunks.pair.apart else np.unique(ends[:-1][ends[:-1] < len(buf)])
        places = pa.py_buffer(np.append(starts, len(buf)).astype(np.int64).tobytes())
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(buf.tobytes())]).dictionary_encode()
        known = chunks.numbers(coded.dictionary.to_pylist())
        self.chunk = known[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
        self.begin = np.searchsorted(starts, ends)  # of each document's chunks (one entry more)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.begin))
        bad = np.bincount(self.doc, chunks.facts[self.chunk, 0] == 0, self.n)
        self.valid = bad == 0

    def sums(self, of_chunks: np.ndarray) -> np.ndarray:
        """The sum over each document's chunks; no tokens, no sum. Exact: from differences of running sums."""
        run = np.concatenate(([0], np.cumsum(of_chunks[self.chunk], dtype=np.int64)))
        return np.where(self.valid, run[self.begin[1:]] - run[self.begin[:-1]], 0)

    def linked(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times), each pair of a document once."""
        keep = self.valid[self.doc]
        key, n = np.unique(self.doc[keep] << 32 | self.chunk[keep], return_counts=True)
        at, row = _ragged(chunks.at, key & 0xFFFFFFFF)
        doc, pair, times = (key >> 32)[row], chunks.pairs[at], chunks.times[at] * n[row]
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))) if len(pair) else np.zeros(0, np.int64)
        return doc[first], pair[first], np.add.reduceat(times, first) if len(first) else times

    def digests(self, chunks: Chunks) -> list[str]:
        numbers, begin, groups = self.chunk.tolist(), self.begin.tolist(), chunks.groups
        return [hashlib.sha256(b"".join([groups[k] for k in numbers[s:e]])[:-1]).hexdigest() if ok and e > s else "" for s, e, ok in zip(begin, begin[1:], self.valid.tolist())]


def planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as four planes of bytes: those of small numbers are mostly zeros, which compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


#: A worker's chunks, which its next task may use again. No result depends on them.
_WARM: dict[tuple[str, str], Chunks] = {}
_FACTS = ("n_a", "n_b", "n_groups", "n_links")
_ROW = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_KEPT = f"{_ROW}, slice bigint, held binary, times binary, pairs array<bigint>, counts array<bigint>"


def aligned_slices(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document with its facts and, as ``held`` and ``times``, which of its slice's pairs it holds linked and how often;
    and a row a slice with its ``pairs`` (A's id times the number of B's ids, plus B's id) and how many of its documents hold each."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (a_path, b_path) not in _WARM:
            _WARM[a_path, b_path] = Chunks(Pair(a_path, b_path))
        chunks, key = _WARM[a_path, b_path], TaskContext.get().partitionId() << 32
        schema = pa.schema([pa.field(n, t) for n, t in zip((x.split()[0] for x in _KEPT.split(", ")), (*[pa.int64()] * 5, pa.string(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 2))])
        for batch in slices(batches, most=SLICE):
            part = _Slice(batch, chunks)
            doc, pair, times = part.linked(chunks)
            pairs, place, counts = np.unique(pair, return_inverse=True, return_counts=True)
            cut = np.searchsorted(doc, np.arange(part.n + 1)).tolist()
            rows = {c: part.sums(chunks.facts[:, 1 + k]).tolist() for k, c in enumerate(_FACTS)} | {"groups_sha256": part.digests(chunks)}
            rows |= {"doc_id": batch.column("doc_id").to_pylist(), "slice": [key] * part.n, "held": [planes(np.diff(place[s:e], prepend=0)) for s, e in zip(cut, cut[1:])], "times": [planes(times[s:e]) for s, e in zip(cut, cut[1:])]}
            yield pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * part.n), f.type) for f in schema], schema=schema)
            one = {"slice": key, "pairs": pairs, "counts": counts}
            yield pa.RecordBatch.from_arrays([pa.array([one.get(f.name)], f.type) for f in schema], schema=schema)
            key += 1

    return rows.mapInArrow(aligned, _KEPT)


def align(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A row counts as a document of its own, whatever its doc_id; null ids stay. A text that is null or empty, or whose joined token bytes aren't
    the text with a space before it (so also one that isn't UTF-8), has no tokens: zeros and ''. Pairs whose counts tie for their A id's
    highest are all best. Other columns are ignored. An empty table gives no rows.
    """
    size = len(Pair(a_path, b_path).b_bytes)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = written(aligned_slices(rows, a_path, b_path), "aligned")
    each = kept.filter("pairs IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    each = each.select("slice", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / size))
    counts = written(counts, "pair_counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # at most one row an id of A
    counts = counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    looked_up = each.select("slice", "place", "pair").join(counts, "pair").groupBy("slice").agg(
        F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("x"))
    looked_up = looked_up.select(F.col("slice").alias("of"), F.col("x.n").alias("n"), F.col("x.best").alias("best"))

    def summed(documents: pa.Table, tables: pa.Table) -> pa.Table:
        n, best = (tables.column(c).combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.int64) if tables.num_rows else np.zeros(0, np.int64) for c in ("n", "best"))
        sums = []
        for held, times in zip(documents.column("held").to_pylist(), documents.column("times").to_pylist()):
            place, times = np.cumsum(from_planes(held)), from_planes(times)
            sums.append((int(times @ best[place]), int(times @ n[place])))
        more = {c: pa.array(x, pa.int64()) for c, x in zip(("n_best", "count_sum"), zip(*sums))}
        return pa.table({c: documents.column(c) for c in ("doc_id", *_FACTS, "groups_sha256")} | more)

    found = kept.filter("pairs IS NULL").drop("pairs", "counts").groupBy("slice").cogroup(looked_up.groupBy("of"))
    return found.applyInArrow(summed, f"{_ROW}, n_best bigint, count_sum bigint")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(documents, public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
