"""Misspellings of words whose beginning is learned."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.llm import toxicity


def test_misspelled_beginnings(spark):
    forms = ("idiots", "idiotic", "idiot", "idiotically")
    texts = [(k, f"you are {forms[k % 4]} number {k}", 1) for k in range(80)] + [(100 + k, f"a fine day number {k} for them", 0) for k in range(160)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    exact, inflected, *wrong, clean = toxicity.context_counts(["you idiot", "you idiotics", "you idxot", "you idiiot", "you fine day"], model.lexicon)
    none = toxicity.context_counts([""], model.lexicon)[0]
    assert all((x != none).any() for x in (exact, inflected, *wrong)) and (clean == none).all()


def test_more_terms_than_a_table_holds():
    """Tables run in turn accept what one table of all terms does."""
    import random

    import numpy as np

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(4, 9))).encode() for _ in range(60)]
    terms = [(w, rng.random() < 0.7, rng.choice((1, 2))) for w in dict.fromkeys(words)]
    texts = [" ".join(rng.choice([w.decode(), w.decode()[1:], w.decode() + "x", "abc"]) for w in rng.choices(words, k=12)) for _ in range(40)]
    one, many = toxicity.Lexicon(terms), toxicity.Lexicons(terms, size=7)
    assert len(many.parts) > 5
    assert np.array_equal(toxicity.context_counts(texts, one), toxicity.context_counts(texts, many))
    assert len(toxicity.Lexicons([]).parts) == 1


def test_long_runs_are_whole_words():
    long = "überlanges" * 3 + "wort"
    (own,) = toxicity._beginnings([f"{long} abc"])
    assert {w for w in own if w.endswith(b"\0")} == {long.encode() + b"\0"}
