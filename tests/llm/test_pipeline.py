"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

import re

import pytest
import xxhash

from wayloom.llm import language_id, mixing, secret_scan
from wayloom.operators.shared import written

from ..oracle import sql_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # of bytes: A-Z only


def _fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", _lowered(text))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _windows(text: str | None) -> set[bytes]:
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lowered(text))
    return {b" ".join(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def _five_words(text: str | None) -> set[tuple]:
    words = re.findall(rb"[^\x20\x09-\x0D]+", _lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _alike(x: set, y: set) -> bool:
    return bool(x and y) and 10 * len(x & y) >= 8 * len(x | y)


def _first_of_groups(texts: dict[int, str | None]) -> set[int]:
    """The least id of each group; two texts are linked by their fingerprints, or by a Jaccard similarity of 0.8 of their five-word shingles."""
    ids = sorted(texts)
    fp = {i: _fingerprint(texts[i]) for i in ids}
    five = {i: _five_words(texts[i]) for i in ids}
    stay, seen = set(), set()
    for i in ids:
        if i in seen:
            continue
        stay.add(i)
        seen.add(i)
        front = [i]
        while front:
            a = front.pop()
            near = [b for b in ids if b not in seen and ((fp[a] ^ fp[b]).bit_count() <= 4 or _alike(five[a], five[b]))]
            seen.update(near)
            front += near
    return stay


def _leaks(text: str | None, items: list[set[bytes]]) -> bool:
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lowered(text))
    line = b" " + b" ".join(words) + b" "
    return any(b" " + w + b" " in line for item in items for w in item)


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, small), name)
        states[name] = before, {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(states[name][1])  # an id once
        assert docs.columns[: len(columns)] == columns

    before, after = states["language_id"]
    whole = spark.read.parquet(f"{small}/documents.parquet")
    judged = language_id.identify(whole, language_id.fit(whole, ~language_id.in_fold("doc_id", 4, 2))).collect()
    assert set(after) == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= language_id.AMBIGUOUS}
    assert not any(re.search(r"[^\W\d_]", before[i].text or "") is None for i in after)
    assert len(after) >= 0.95 * sum(re.search(r"[^\W\d_]", r.text or "") is not None for r in before.values())

    before, after = states["near_duplicates"]
    assert set(after) == _first_of_groups({i: r.text for i, r in before.items()})
    assert len(after) < len(before)

    before, after = states["decontamination"]
    items = [_windows(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert set(after) == {i for i, r in before.items() if not _leaks(r.text, items)}

    before, after = states["secrets"]
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    assert set(after) == set(before)
    for i, r in before.items():
        text = r.text
        for _, s, e, score in reversed(secret_scan.findings_of([r.text], forest)):
            if score >= secret_scan.THRESHOLD:
                text = text[:s] + secret_scan.MASK + text[e:]
        assert after[i].text == text

    before, after = states["mixing"]
    spark.createDataFrame(list(before.values()), whole.schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    (file,) = (tmp_path / "in").glob("*.parquet")
    file.rename(tmp_path / "documents.parquet")
    want = sql_rows(mixing.OP7_SQL, str(tmp_path)).to_pylist()
    assert set(after) == {r["doc_id"] for r in want if r["kept"]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).select("doc_id").collect()} == set(after)
