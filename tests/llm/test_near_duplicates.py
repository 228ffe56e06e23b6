"""The pipeline's near-duplicate stage against brute-force Jaccard."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from wayloom.llm import jaccard
from wayloom.operators.components import connected_components


def _shingles(text: str) -> set[tuple]:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _texts() -> dict[int, str]:
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choices(words, k=30))
    out = {}
    for _ in range(25):
        base = rng.choices(words, k=rng.choice((40, 120, 300)))
        out[len(out)] = " ".join(base)
        for edits in (1, 2, 3, 4, 6):  # similarities around 0.8, and chains of them
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = rng.choice(words)
            base = copy if edits % 2 else base
            out[len(out)] = " ".join(copy)
        out[len(out)] = line + " " + " ".join(rng.choices(words, k=20))
    return out | {len(out): "Two words", len(out) + 1: "two  WORDS", len(out) + 2: "two words more"}


def test_jaccard_pairs_in_one_group(spark):
    texts = _texts()
    sets = {i: _shingles(t) for i, t in texts.items()}
    alike = [(a, b) for a, b in itertools.combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in texts}
    for _ in texts:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = connected_components(jaccard.similar_links(docs)).collect()
    assert {i: i for i in texts} | {r.node: r.component for r in got} == root
    # the stage keeps at most one document of each such group
    stay = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert len(alike) > 50 and stay <= set(root.values()) and 0 in stay


def test_sketch_never_rules_out():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 3, 17, 300, 5000):
        x = rng.integers(-(1 << 62), 1 << 62, n)
        y = np.unique(np.concatenate((x[: n - n // 10], rng.integers(-(1 << 62), 1 << 62, n // 5))))
        other = rng.integers(-(1 << 62), 1 << 62, n)
        assert jaccard.most_shared(jaccard.sketch(x), jaccard.sketch(y)) >= len(np.intersect1d(x, y))
        if n > 100:
            assert jaccard.most_shared(jaccard.sketch(x), jaccard.sketch(other)) < 8 / 9 * n
