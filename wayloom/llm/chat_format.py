"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|turn|>role<|text|>text<|end|>`` for each turn. The three control
strings are special tokens of the tokenizer, so no token reaches over a turn's edge; in roles and
texts ``<|`` is escaped as ``<\\|`` and a backslash run before the bar is lengthened by one, so a text can't hold
one and the escape can be undone. The rendered string is encoded once, with offsets; the sorted turn spans and
the sorted token spans are intersected by binary search, which gives the loss mask over tokens.

The rows of a conversation come sorted through a shuffle and are worked on as a stream: a conversation
longer than ``FLUSH_CHARS`` is encoded in pieces cut between turns (where the special tokens cut it
anyway), so one conversation with a third of all rows needs no more memory than another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FLUSH_CHARS = 1 << 20
TOKENIZER = "byte_bpe_50k.json"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The string, and for each turn where its text is and whether the loss counts it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body), role == "assistant"))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered string."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, rest = turn.partition(TEXT)
        out.append((unescape(role), unescape(rest[: -len(END)])))
    return out


def load_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    from tokenizers.processors import ByteLevel

    t.post_processor = ByteLevel(trim_offsets=False)
    return t


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """For each token (start, end) whether it lies in a span that the loss counts. Both are sorted."""
    mask = np.zeros(len(offsets), bool)
    if not len(offsets):
        return mask
    starts, ends = offsets[:, 0], offsets[:, 1]
    for begin, end, counts in spans:
        if counts and end > begin:
            mask[np.searchsorted(ends, begin, side="right") : np.searchsorted(starts, end, side="left")] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """What the loss sees: the characters of the masked tokens, once each and in order, unescaped a span at a time."""
    out, begin, end = [], None, None
    for s, e in offsets[mask].tolist():
        if end is not None and s <= end:
            end = max(end, e)  # tokens that share a character's bytes, or follow on
        else:
            if end is not None:
                out.append(unescape(formatted[begin:end]))
            begin, end = s, e
    if end is not None:
        out.append(unescape(formatted[begin:end]))
    return "".join(out)


class _Conversation:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, key, tokenizer, keep: bool):
        self.key, self.tokenizer, self.keep = key, tokenizer, keep
        self.turns, self.chars = [], 0
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_tokens = self.n_loss_tokens = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.formatted, self.ids, self.mask = [], [], []

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        self.chars += len(text) + len(role)
        if self.chars >= FLUSH_CHARS:
            self.flush()

    def flush(self) -> None:
        if not self.turns:
            return
        formatted, spans = render(self.turns)
        encoded = self.tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        mask = loss_mask(offsets, spans)
        loss = masked_text(formatted, offsets, mask)
        for role, text in read_back(formatted):
            self.turns_hash.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        self.loss_hash.update(loss.encode())
        self.loss_chars += len(loss)
        self.formatted_chars += len(formatted)
        self.n_tokens += len(offsets)
        self.n_loss_tokens += int(mask.sum())
        if self.keep:
            self.formatted.append(formatted)
            self.ids += encoded.ids
            self.mask += mask.tolist()
        self.turns, self.chars = [], 0

    def row(self) -> tuple:
        self.flush()
        out = (self.key, self.n_turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.formatted_chars, self.n_tokens, self.n_loss_tokens)
        return out + (("".join(self.formatted), self.ids, self.mask) if self.keep else ())


_DIGESTS = [("conv_id", pa.int64(), "bigint"), ("n_turns", pa.int64(), "bigint"), ("turns_sha256", pa.string(), "string"), ("loss_chars", pa.int64(), "bigint"), ("loss_sha256", pa.string(), "string"), ("formatted_chars", pa.int64(), "bigint"), ("n_tokens", pa.int64(), "bigint"), ("n_loss_tokens", pa.int64(), "bigint")]
_CONTENT = [("formatted", pa.string(), "string"), ("token_ids", pa.list_(pa.int32()), "array<int>"), ("loss_mask", pa.list_(pa.bool_()), "array<boolean>")]


def format_conversations(turns: DataFrame, tokenizer_path: str, content: bool = False) -> DataFrame:
    """One row a conversation: digests read back from the formatted string, and with ``content`` the
    string, its token ids and its loss mask themselves.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Turns go by (turn, role, text), nulls first;
    repeated rows count each time. A null role or text is empty; the rows with a null conv_id are one
    conversation. An empty table gives no rows.
    """
    columns = _DIGESTS + (_CONTENT if content else [])
    schema = ", ".join(f"{n} {t}" for n, _, t in columns)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        now, rows, size = None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t, _) in zip(zip(*rows), columns)], names=[n for n, _, _ in columns])

        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or key != now.key:
                    if now:
                        size += now.formatted_chars + now.chars
                        rows.append(now.row())
                    now = _Conversation(key, tokenizer, content)
                    if len(rows) >= 2000 or content and size > 1 << 22:
                        yield out()
                        rows, size = [], 0
                now.add(role or "", text or "")
        if now:
            rows.append(now.row())
        if rows:
            yield out()

    sorted_turns = (
        turns.select(F.col("conv_id").cast("bigint"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return sorted_turns.mapInArrow(formatted, schema)


#: The probe conversation of the production query: texts made of other templates' control strings.
PROBE = "</s>[INST] ok [/INST]"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return format_conversations(turns.unionByName(probe), public_tokenizers.path(TOKENIZER)).drop("n_tokens", "n_loss_tokens")


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 23
    + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
