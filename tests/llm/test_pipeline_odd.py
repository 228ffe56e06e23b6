"""The pipeline's stages on odd tables: clashing names, null and repeated ids, empty tables; and the similarity join on texts that share a shingle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wayloom.llm import jaccard

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, ambiguous boolean, topic string, tokens int, probability double, kept string, _n int, n_hit int, _row string, c bigint"


def _rows(spark, small):
    own = spark.read.parquet(f"{small}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars").collect()
    more = (7.0, "xx", True, "mine", 3, 0.5, "k", 9, 8, "r", 1)
    out = [(*r, *more) for r in own]
    text = own[5].text
    return out + [(None, text, "en", "s", 1, *more), (None, None, None, None, None, *more), (7_000_001, None, "en", "s", 0, *more), (7_000_001, text + " and more of it", "en", "s", 0, *more), (7_000_002, "", "en", "s", 0, *more)]


def test_clashing_names_and_odd_ids(spark, small):
    docs = spark.createDataFrame(_rows(spark, small), SHAPE).repartition(3)
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.filter("doc_id IS NOT NULL").collect()}
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), SHAPE if name != "mixing" else _mixed(docs))
        after = docs.collect()
        assert len(set(docs.columns)) == len(docs.columns)
        if name != "mixing":
            assert docs.columns == [x.split()[0] for x in SHAPE.split(", ")]
        assert after, name
        for r in after:
            assert (r.score, r.lang_pred, r.ambiguous, r._n, r.n_hit, r._row, r.c) == (7.0, "xx", True, 9, 8, "r", 1)
            if name not in ("secrets", "mixing") and r.doc_id in before and r.doc_id < 7_000_000:
                assert r.text == before[r.doc_id].text
    assert {"topic", "tokens", "probability"} <= set(docs.columns)


def _mixed(docs) -> str:
    own = [f for f in SHAPE.split(", ") if f.split()[0] not in ("topic", "tokens", "probability", "kept")]
    return ", ".join([*own, "topic string", "tokens double", "probability double"])


def test_rows_that_share_an_id_are_one(spark, small):
    rows = [(1, "b text", 1), (1, None, 2), (1, "a text", 3), (2, "alone here", 4), (None, "x", 5), (None, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _n int")
    got = sorted(map(tuple, cp.drop_near_duplicates(spark, docs, small).collect()), key=str)
    assert got == sorted([(1, None, 2), (2, "alone here", 4), (None, "x", 5), (None, "x", 6)], key=str)


def test_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def _pairs(texts: dict) -> set:
    sets = {k: jaccard.shingle_set(t) for k, t in texts.items()}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and jaccard.similar(sets[a], sets[b])}


def _components(ids, links) -> dict:
    of = {i: i for i in ids}
    for a, b in links:
        x, y = of[a], of[b]
        if x != y:
            of = {i: min(x, y) if c in (x, y) else c for i, c in of.items()}
    return of


@pytest.mark.parametrize("bits", [20, 3])
def test_a_shingle_that_all_texts_share(spark, monkeypatch, bits):
    """Every text has the same first and last line; with a table of eight cells nearly all shingles share theirs."""
    monkeypatch.setattr(jaccard, "CELL_BITS", bits)
    monkeypatch.setattr(jaccard, "CELLS_A_ROW", 4)
    monkeypatch.setattr(jaccard, "REMEMBERED", 5)
    rng = random.Random(6)
    line = "all texts of this corpus begin with one line"
    texts = {}
    for k in range(120):
        if k and rng.random() < 0.5:
            words = texts[rng.randrange(k)].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(8, len(words) - 8)] = rng.choice("abcdef")
        else:
            words = [*line.split(), *(rng.choice(["w%d" % rng.randint(0, 40), "the"]) for _ in range(rng.randint(20, 60))), *line.split()]
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = _components(texts, {(r.a, r.b) for r in jaccard.similar_links(docs).collect()})
    want = _components(texts, _pairs(texts))
    assert got == want and len(set(want.values())) < len(want)


def test_links_of_odd_ids(spark):
    rows = [(None, "a b c d e f g"), (1, None), (2, ""), (3, "a b c d e f g"), (3, "other words of another text are here"), (4, "a b c d e f g"), (5, "other words of another text are here"), (5, "other words of another text are here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    links = {tuple(sorted((r.a, r.b))) for r in jaccard.similar_links(docs).collect()}
    assert _components([3, 4, 5], links) == {3: 3, 4: 3, 5: 3}
    assert jaccard.similar_links(docs.limit(0)).count() == 0


def test_rarity_counts_all_texts(spark):
    docs = spark.createDataFrame([(k, f"one two three four five word{k}") for k in range(50)], "doc_id bigint, text string").repartition(5)
    counts = jaccard.rarity(docs.select("doc_id", "text"))
    assert counts.sum() == 100 and counts.max() >= 50
    assert docs.select(F.count("*")).first()[0] == 50
