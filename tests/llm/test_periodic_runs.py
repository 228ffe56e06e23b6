from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayloom.llm import periodic_runs as pr


def slow(words: list) -> list[tuple[int, int, int]]:
    """Every (start, length, period), by definition: for each period all maximal stretches, then those whose smallest period it is."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                piece = words[i : j + q]
                if not any(all(a == b for a, b in zip(piece, piece[d:])) for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def noisy(rng: random.Random) -> str:
    """Runs inside runs, runs that touch, and words between."""
    words: list[str] = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.3:
            block = block * rng.randint(2, 9) + [rng.choice("abc")]
        words += (block * rng.randint(1, 9))[: rng.randint(1, 200)]
        words += [rng.choice("abcdxyz") for _ in range(rng.randint(0, 9))]
    return rng.choice([" ", "\n", "  \t", "\x0b"]).join(words)


ODD = [None, "", " \n\t ", "one", "a " * 6, "a " * 5, "x y " * 9, "a b " * 4, "a b a b a b a", "  lead " * 7 + " ", "ä ö " * 5, "w " * 3000, ("w " * 500 + "v ") * 12, "a\x0ba\x0ca\x1ca a a a"]


def result(df) -> Counter:
    return Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in df.collect())


def expected(rows: list[tuple]) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        words = split(text)
        runs = slow(words)
        out[doc_id, len(words), tuple(runs), collapsed(words, runs)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [noisy(rng) for _ in range(150)]
    return list(enumerate(texts)) + [(None if k % 2 else 5, t) for k, t in enumerate(ODD)] + [(3, texts[3])]


def test_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, runs int, row string").repartition(3)
    want = expected(rows)
    assert result(pr.periodic_runs(docs)) == want
    assert sum(len(x[2]) for x in want) > 300


def test_ranges_of_lags(spark, rows):
    """Texts dealt out by ranges of five lags give the same rows."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert result(pr.periodic_runs(docs, lags=5)) == expected(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pr.periodic_runs(empty).count() == 0
    assert pr.planted(empty).count() == 0


def test_many_equal_words_take_few_steps():
    ids = np.zeros(200_000, np.int64)
    assert pr.scan(ids, np.array([200_000])).tolist() == [[0, 200_000, 1]]
    assert pr.scan(np.arange(200_000) % 30_000, np.array([200_000]), 30_000, 40_000).tolist() == [[0, 200_000, 30_000]]
    assert pr.scan(ids, np.array([200_000]), 40_000, 50_000).tolist() == [[0, 200_000, 1]]


def planted(doc_id, words: list) -> list:
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark, small):
    from wayloom.llm.queries import QUERIES

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = planted(r.doc_id, split(r.text))
        runs = slow(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want[r.doc_id] = (len(runs), s, n, q, runs and 1000 * n // q or None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(collapsed(words, runs)))
    got = QUERIES["op12_periodic_runs"](spark, small)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(bool(x[0]) for x in want.values()) > 10
