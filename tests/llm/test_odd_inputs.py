"""Empty tables, repeated rows, repeated and null ids, edges of texts, ties and clashing names."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from wayloom.llm import ann, chat_format, decontaminate, language_id, mixing, secret_scan, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "mine", "mine") for i, t, lang in rows], DOCS)


def test_decontamination_of_nothing(spark):
    docs = documents(spark, [(1, "aa bb cc", "en"), (1, "aa bb cc", "en"), (None, "x aa bb cc", "en"), (2, None, "en")])
    items = spark.createDataFrame([("i", "aa bb cc")], "item_id string, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    got = decontaminate.contamination(docs, items.limit(0)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got) == [(0, 4, 0), (1, 3, 0), (1, 3, 0), (2, 0, 0)] and {tuple(r["items"]) for r in got} == {()}
    got = decontaminate.contamination(docs, items.union(items)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == [(0, 4, 3, ("i",)), (1, 3, 3, ("i",)), (1, 3, 3, ("i",)), (2, 0, 0, ())]


def test_nearest_with_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 0.0]), (4, [1.0, -2.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 3, 0.0), (2, 1, 2.0), (3, 2, 2.0)]


def test_toxicity_of_nothing_and_of_repeats(spark):
    docs = documents(spark, [(7, "one two", "en"), (7, "one two", "de"), (None, "one two", None)])
    model = toxicity.fit(docs, spark.createDataFrame([(7, 0), (7, None)], "doc_id bigint, toxic int"), F.lit(True))
    assert toxicity.score(docs.limit(0).withColumn("held_out", F.lit(True)), model).count() == 0
    got = toxicity.score(docs.withColumn("held_out", F.lit(True)), model).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and {r.predicted for r in got} == {0}


def test_secrets_at_the_edges_and_in_repeats(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    a, z = "ghp_3fZk9QmXw27LbTe8RsVd1YuHnJc5PaKo4GiB", "ghp_Zq81LmTe5RbVx7WuHnYc3PaDo9GiKs2JfXw6"
    texts = [f"{a} and later {z}", f"{a} and later {z}"]
    docs = documents(spark, [(5, texts[0], "en"), (5, texts[1], "en"), (None, a, None)])
    found = secret_scan.scan(docs, forest).filter("is_secret").collect()
    assert sorted((r.doc_id or 0, r.value) for r in found) == sorted([(5, a), (5, z)] * 2 + [(0, a)])
    got = sorted((r.doc_id or 0, r.text) for r in secret_scan.masked(docs, forest).collect())
    assert got == [(0, "[SECRET]")] + [(5, "[SECRET] and later [SECRET]")] * 2


def test_mixing_of_repeats(spark):
    """Rows that share an id share their fate; a part of one keeps every row."""
    docs = documents(spark, [(i // 2, "some words of a text", "en" if i % 3 else "de") for i in range(400)])
    got = mixing.calibrated(docs, part=1.0).collect()
    assert len(got) == 400 and all(r.kept and r.probability == pytest.approx(1.0) for r in got)
    half = mixing.calibrated(documents(spark, [(i // 2, "some words of a text", "en") for i in range(400)]), part=0.5).groupBy("doc_id").agg(F.countDistinct("kept").alias("n"), F.count("*").alias("m")).collect()
    assert {(r.n, r.m) for r in half} == {(1, 2)}


def test_chat_of_repeats(spark):
    import public_tokenizers

    path = public_tokenizers.path(chat_format.TOKENIZER)
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes")]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3), path).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(1, 4, 6)]
    assert got[0].turns_sha256 == hashlib.sha256(b"user\nb\nuser\nb\nassistant\nyes\nassistant\nyes\n").hexdigest()


def test_urls_of_nothing_repeats_ties_and_length(spark):
    schema = "page_id bigint, url string"
    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/x"), (2, "http://b.com/" + "y" * 100_000)]
    pages = spark.createDataFrame(rows, schema)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    at = time.time()
    got = url_filter.judge_urls(pages, rules=(("allow", "a.com/"), ("block", "a.com/")), globs=()).collect()
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in got) == [(0, "a.com/", "block"), (1, "a.com/", "block"), (1, "a.com/", "block"), (2, "", "allow")]
    assert time.time() - at < 60


def test_language_of_nothing_repeats_and_signs(spark):
    docs = documents(spark, [(3, "the cat and the dog", "en"), (3, "the cat and the dog", "en"), (None, "der Hund und die Katze", "de"), (4, "½ ² 12", "en"), (5, "le chat", None)] * 3)
    model = language_id.fit(docs, F.lit(True))
    assert language_id.identify(docs.limit(0), model).count() == 0
    got = language_id.identify(docs, model).collect()
    assert len(got) == 15 and {r.lang_pred for r in got if r.doc_id == 3} == {"en"} and {r.lang_pred for r in got if r.doc_id == 4} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id is None} == {"de"} and len({r.score for r in got if r.doc_id == 3}) == 1
