"""The corpus pipeline: documents in, a clean and mixed corpus out. Each stage is one operator of wayloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import decontaminate, jaccard, language_id, mixing, secret_scan, simhash
from wayloom.llm.words import small_batches
from wayloom.operators.components import connected_components
from wayloom.operators.shared import written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter (null and empty texts too), and those that no language has a majority for, go.

    Rows come out as they went in, whatever their columns are called; null and repeated ids are judged by their texts alone. An empty table stays empty.
    """
    small_batches(spark)
    model = language_id.fit(docs, ~language_id.in_fold("doc_id", 4, 2))
    judged = language_id.identify(docs.select("text", F.struct(*docs.columns).alias("_row")), model)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")
    return judged.filter(known).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group. Documents without an id all stay.

    Two documents are linked if their fingerprints are (op2_simhash), or if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Rows
    that share an id are one document, of which the row with the smallest text stays (nulls first; then by all columns). Columns stay whatever they are called; an empty table stays empty.
    """
    small_batches(spark)
    groups = written(simhash.near_duplicates(docs).select("doc_id", "component_id").distinct(), "fingerprint_groups")
    links = groups.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(jaccard.similar_links(docs.select("doc_id", "text")))
    hung = connected_components(links).filter("node <> component").select(F.col("node").alias("doc_id"))
    repeated = docs.select("doc_id").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    # written first, so that Spark knows their sizes: texts are only shuffled if the ids are too many to broadcast
    hung, repeated = written(hung, "hung"), written(repeated, "repeated")
    single = docs.join(hung.unionByName(repeated).distinct(), "doc_id", "left_anti")
    # the first of the rows that share an id is kept as they come, a row an id and task, however many there are
    shared = docs.join(repeated.join(hung, "doc_id", "left_anti"), "doc_id", "left_semi")
    row = F.struct(*docs.columns)
    one = shared.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("_row")).select("_row.*")
    return single.select(*docs.columns).unionByName(one)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Rows with null texts stay; null and repeated ids are judged row by row; an empty table, or an empty benchmark, changes nothing."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminated(docs, benchmark)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked, and n_chars (if there) counted anew where that happened; all else, null texts too, as it was."""
    small_batches(spark)
    return secret_scan.masked(docs, secret_scan.train(secret_scan.labelled_findings(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose sources, languages and topics have the target shares, with each document's topic, tokens and probability.

    These three take the place of columns of their names. Documents without tokens aren't drawn; rows that share an id share their fate, null ids too. An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("topic", "tokens", "probability", "cell_weight", "kept")]
    return mixing.calibrated(docs).filter("kept").select(*own, "topic", "tokens", "probability")


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Trained models and hashed fingerprints can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
