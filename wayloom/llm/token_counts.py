"""Edit-aware token counts.

A document is cut into segments of pre-tokens, and a segment tree over them keeps, for every node, the sums of characters and of tokens
below it. An edit descends by character sums to the segments it touches; only these are encoded again, together with the
neighbour whose edge the edit may have moved, and the sums on their paths to the root are updated.

Segments begin where a space stands before a non-space. The pre-tokenizer's pattern puts a boundary at every such place whatever stands around it
(a space is only ever the first character of a pre-token, or part of a run of white space that leaves its last space to the word), so segments
are encoded independently and their counts add up to the count of the whole text. An edit that touches the
space or the character after it may remove the boundary: then the segment before it is encoded along.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Tokens of a segment, at least (the last one of a text may have fewer).
SEGMENT = 48
RANKS = "byte_bpe_50k.tiktoken"

#: (begin, end, replacement), in characters of the text before any edit.
Edit = tuple[int, int, str]


class Tokenizer:
    """A byte-level BPE from a ranks file; with tables of each token's bytes and of those that begin a word."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.begins = np.zeros(len(self.bytes), bool)
        for token, k in ranks.items():
            self.bytes[k] = len(token)
            # a space, then something that is surely no white space
            self.begins[k] = len(token) > 1 and token[0] == 32 and 32 < token[1] < 127

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def count(self, text: str) -> int:
        return len(self.encode(text)) if text else 0

    def segments(self, text: str) -> list[tuple[str, int]]:
        """(text, tokens) of the segments of a text, in order; an empty text has none."""
        if not text:
            return []
        ids = self.encode(text)
        starts = np.flatnonzero(self.begins[ids])
        cuts, last = [0], 0
        k = np.searchsorted(starts, SEGMENT)
        while k < len(starts):
            last = int(starts[k])
            cuts.append(last)
            k = np.searchsorted(starts, last + SEGMENT)
        ends = np.concatenate(([0], np.cumsum(self.bytes[ids])))
        data = text.encode("utf-8", "replace")
        at = [*ends[cuts].tolist(), len(data)]
        counts = np.diff([*cuts, len(ids)]).tolist()
        return [(data[s:e].decode(), n) for s, e, n in zip(at, at[1:], counts)]


class TokenTree:
    """The segment tree of one document."""

    def __init__(self, tokenizer: Tokenizer, text: str):
        self.tokenizer = tokenizer
        parts = tokenizer.segments(text)
        self.size = 1 << max(0, (len(parts) - 1).bit_length())
        self.pieces = [p for p, _ in parts] + [""] * (self.size - len(parts))
        self.chars, self.tokens = ([0] * (2 * self.size) for _ in range(2))
        for k, (p, n) in enumerate(parts):
            self.chars[self.size + k], self.tokens[self.size + k] = len(p), n
        for k in range(self.size - 1, 0, -1):
            self._add_up(k)
        self.encoded = 0

    def _add_up(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds character ``at``, and the character's place in it; past the end: the last segment that isn't empty."""
        k = 1
        at = min(max(at, 0), max(self.chars[1] - 1, 0))
        while k < self.size:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.size, at

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replaces characters begin..end of the text as it is now."""
        begin = min(max(begin, 0), self.chars[1])
        end = min(max(end, begin), self.chars[1])
        first, _ = self.find(begin - 2)  # one that begins at begin or begin - 1 may lose its boundary
        last, _ = self.find(end + 1)  # and so may one that begins at end or just before it
        before = self._chars_before(first)
        old = "".join(self.pieces[first : last + 1])
        text = old[: begin - before] + new + old[end - before :]
        count = self.tokenizer.count(text)
        self.encoded += count
        for k in range(first, last + 1):
            self.pieces[k] = text if k == first else ""
            self.chars[self.size + k], self.tokens[self.size + k] = (len(text), count) if k == first else (0, 0)
        nodes = {(self.size + k) // 2 for k in range(first, last + 1)} - {0}
        while nodes:
            for k in nodes:
                self._add_up(k)
            nodes = {k // 2 for k in nodes if k > 1}

    def _chars_before(self, leaf: int) -> int:
        k, out = self.size + leaf, 0
        while k > 1:
            if k % 2:
                out += self.chars[k - 1]
            k //= 2
        return out

    def apply(self, edits: list[Edit]) -> None:
        """Edits that don't overlap, in places of the text before them; from the back, so that no place moves."""
        for begin, end, new in sorted(edits, reverse=True):
            self.edit(begin, end, new)


_PRIVATE = re.compile(
    r"(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.-]*\w"  # mail addresses, from where a run begins: a long word is passed once
    r"|\b\d{1,3}(?:\.\d{1,3}){3}\b"  # IPv4 addresses
    r"|\b[0-9a-fA-F]{32,64}\b"  # keys and digests
    r"|\b(?:\d[ -]?){13,16}\b",  # card numbers
    re.ASCII,
)
REDACTED = "[REDACTED]"


def redactions(text: str) -> list[Edit]:
    """The production edits: personal data and keys give way to a mark."""
    return [(m.start(), m.end(), REDACTED) for m in _PRIVATE.finditer(text)]


def edit_aware_counts(documents: DataFrame, ranks_path: str, pattern: str, edits_of: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_edits, n_tokens_after, n_encoded (tokens of the regions encoded again).

    ``edits_of`` gives a text's edits. A null text counts as an empty one: all zero. Repeated rows give repeated rows; other columns are
    ignored; an empty table gives no rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks_path, pattern)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                edits = edits_of(text)
                if not edits:
                    n = tokenizer.count(text)
                    rows.append((n, 0, n, 0))
                    continue
                tree = TokenTree(tokenizer, text)
                before = tree.total
                tree.apply(edits)
                rows.append((before, len(edits), tree.total, tree.encoded))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"])

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(counted, "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_encoded bigint")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edit_aware_counts(documents, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
