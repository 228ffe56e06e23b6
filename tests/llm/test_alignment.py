from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from wayloom.llm import alignment as al

PATHS = P.path(al.A_FILE), P.path(al.B_FILE)
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    return al.Pair(*PATHS)


def slow(pair: al.Pair, rows: list[tuple]) -> Counter:
    """Whole texts encoded at once, groups found byte by byte, all links written out."""
    found, held = [], Counter()
    for _, text in rows:
        groups = []
        whole = (" " + (text or "")).encode()
        a, b = pair.a.encode(whole.decode(), add_special_tokens=False).ids, pair.b.encode(text or "")
        if text and b"".join(pair.a_bytes[k] for k in a) == whole == b"".join(pair.b_bytes[k] for k in b):
            i = j = x = y = 0
            left, right = [], []
            while i < len(a) or j < len(b):
                if x <= y and i < len(a) and not (x == y and left and right):
                    left.append(a[i])
                    x, i = x + len(pair.a_bytes[a[i]]), i + 1
                else:
                    right.append(b[j])
                    y, j = y + len(pair.b_bytes[b[j]]), j + 1
                if x == y:
                    groups.append((left, right))
                    left, right = [], []
        found.append((len(a) if groups else 0, len(b) if groups else 0, groups))
        held.update({(s, t) for g in groups for s in g[0] for t in g[1]})
    top = Counter()
    for (s, _), n in held.items():
        top[s] = max(top[s], n)
    out = Counter()
    for (doc_id, _), (n_a, n_b, groups) in zip(rows, found):
        links = [(s, t) for g in groups for s in g[0] for t in g[1]]
        text = ";".join(f"{','.join(map(str, s))}|{','.join(map(str, t))}" for s, t in groups)
        out[doc_id, n_a, n_b, len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n"), (6, "a "), (7, "a  b   c"), (8, "a\n  b\n\n c \n"), (9, "▁"), (10, "x▁ y z"), (11, "<s> </s> <unk> <0x41> <|endoftext|>"),
    (12, "\0a\x1c b\x7f c"), (13, "naïve  thing　 next  one\u0085 two"), (14, "日本語 の テキスト 🙂🙂 naïve"), (15, "\t x \t y"), (None, "the same words"), (None, "the same words"),
    (16, "the same words"), (16, "other words"), (17, "a" * 5000 + " b" * 3000), (18, " " * 700 + "end" + " " * 70), (19, "it's we'll 'tis 12345678 9 ..."), (20, "� bad �"), (21, "ends with "), (22, "x'\n 's"),
]


def rows_of(df) -> Counter:
    return Counter(tuple(r[f] for f in FIELDS) for r in df.collect())


def test_odd_texts(spark, pair):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id bigint, text string, slice int, pairs int").repartition(5)
    assert rows_of(al.align(docs, *PATHS)) == slow(pair, ODD)


def test_empty_table(spark):
    assert al.align(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS).count() == 0


def test_query(spark, small, pair):
    from wayloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = slow(pair, rows)
    assert rows_of(QUERIES["op11_alignment"](spark, small)) == want
    assert sum(r[4] for r in want) > 100_000


def test_kept_chunks_run_out(pair, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(al, "KEPT", 20)
    chunks = al.Chunks(pair)
    texts = [f"word{k} and word{k + 1} at {k}" for k in range(60)]
    for k in range(0, 60, 6):
        part = al._Slice(pa.RecordBatch.from_pydict({"text": texts[k : k + 6]}), chunks)
        assert part.sums(chunks.facts[:, 1]).tolist() == [len(pair.a.encode(" " + t).ids) for t in texts[k : k + 6]]
        assert part.sums(chunks.facts[:, 2]).tolist() == [len(pair.b.encode(t)) for t in texts[k : k + 6]]


def test_large_groups_are_counted_by_id(monkeypatch):
    import numpy as np

    def both():
        a, b, zero = np.array([5, 5, 6, 7]), np.array([1, 1, 2]), np.zeros(1, np.int64)
        return al.links(a, b, zero, zero, np.array([4]), zero, np.array([3]), 10, 1)

    plain = both()
    monkeypatch.setattr(al, "_LAID_OUT", 1)
    assert [x.tolist() for x in both()] == [x.tolist() for x in plain] == [[51, 52, 61, 62, 71, 72], [4, 2, 2, 1, 2, 1], [6]]


def test_bitset_rank_and_select():
    import numpy as np

    places = np.array([0, 1, 63, 64, 130, 199])
    bits = al.Bitset.of(places, 200)
    assert bits.select().tolist() == places.tolist()
    assert bits.rank(np.array([0, 62, 63, 64, 129, 199])).tolist() == [1, 2, 3, 4, 4, 6]
