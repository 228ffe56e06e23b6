"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token sums are raked: scaled in turn until their margins over sources,
languages and topics are the target shares. A document's inclusion probability is its cell's raked weight over its cell's tokens, times
a factor that makes the expected sum of sampled tokens the wanted part of the corpus; cells that would need more than all
their documents are taken whole, and the factor is found anew for the rest. Documents are then drawn by a hash of their id.

Only the first grouping sees documents, and it is combined before the shuffle, so a source with a third of all rows costs
no more than another. Cells are a table of sums: as many as there are sources x languages x topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import dropped, written

#: The topic is the first whose marker stands in the text.
TOPICS = (("table", " | "), ("markup", "&&&"), ("shouting", "!!"))
OTHER_TOPIC = "prose"
#: Target shares of a margin are its token sums to this power, normed: 1 keeps the corpus's mix, 0 makes all values equal.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BYTES_PER_TOKEN = 4
ROUNDS = 8
PART = 0.5
FACTOR_STEPS = 6
#: Cells up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, marker in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(marker)), name).otherwise(out)
    return F.coalesce(out, F.lit(OTHER_TOPIC))


def tokens_of(text: Column) -> Column:
    """Tokens, estimated from the bytes of the text."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / BYTES_PER_TOKEN).cast("double")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id only."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _profile(documents: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        topic_of(F.coalesce(text, F.lit(""))).alias("topic"), tokens_of(text).alias("tokens"),
    ]


def rake(cells: DataFrame, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens > 0) with ``w``: shares of the whole whose margins are the targets, after ``rounds`` rounds."""
    now = cells.withColumn("w", F.col("tokens"))
    for m in MARGINS:
        t = cells.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(temper[m])).alias("t"))
        total = F.broadcast(t.agg(F.sum("t").alias("all")))  # one row
        now = now.join(t.crossJoin(total).select(m, (F.col("t") / F.col("all")).alias(f"target_{m}")), m)
    now = written(now, "raked")
    for _ in range(rounds):
        for m in MARGINS:
            now = now.withColumn("w", F.col("w") * F.col(f"target_{m}") / F.sum("w").over(W.partitionBy(m)))
        after = written(now, "raked")
        dropped(now)
        now = after
    return now.select(*cells.columns, "w")


def residual(raked: DataFrame, temper: dict[str, float] = TEMPER) -> float:
    """The greatest difference between a margin's share and its target, as a part of the target."""
    worst = 0.0
    for m in MARGINS:
        t = raked.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(temper[m])).alias("t"), F.sum("w").alias("w"))
        all_t, all_w = t.agg(F.sum("t"), F.sum("w")).first()
        worst = max(worst, t.agg(F.max(F.abs(F.col("w") / all_w / (F.col("t") / all_t) - 1))).first()[0] or 0.0)
    return worst


def factor_for(raked: DataFrame, part: float, steps: int = FACTOR_STEPS) -> float:
    """The factor k for which the sum of min(tokens, k x w) is ``part`` of all tokens, by ``steps`` steps of taking full cells out."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0.0
    k = part * total
    for _ in range(steps):
        full = F.col("w") * k >= F.col("tokens")
        taken, rest = raked.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not rest:
            break
        k = (part * total - taken) / rest
    return k


def calibrated(documents: DataFrame, temper: dict[str, float] = TEMPER, part: float = PART, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with topic, tokens, cell_weight, probability, kept appended (same-named columns are replaced).

    Needs doc_id, text, source, lang. A null source or lang counts as an empty one. A text without tokens (null or empty) has
    probability 0 and isn't kept. Rows with the same id share their fate. An empty table gives no rows.
    """
    cells = written(documents.select(*_profile(documents)).filter("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, temper, rounds)
    k = factor_for(raked, part)
    rates = raked.select(
        F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("w").alias("cell_weight"),
        F.least(F.lit(1.0), F.col("w") * k / F.col("tokens")).alias("_p"),
    )
    if rates.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    base = documents.drop("topic", "tokens", "cell_weight", "probability", "kept")
    source, lang, topic, tokens = _profile(base)
    joined = base.withColumns({"_source": source, "_lang": lang, "topic": topic, "tokens": tokens}).join(
        rates, (F.col("_source") == F.col("_s")) & (F.col("_lang") == F.col("_l")) & (F.col("topic") == F.col("_t")), "left"
    )
    p = F.when(F.col("tokens") > 0, F.coalesce("_p", F.lit(0.0))).otherwise(0.0)
    return joined.select(*base.columns, "topic", "tokens", "cell_weight", p.alias("probability"), (uniform(F.col("doc_id")) < p).alias("kept"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return calibrated(documents).select("doc_id", "topic", F.col("tokens").cast("bigint").alias("tokens"), F.round("probability", 6).alias("probability"), "kept")


def _sql() -> str:
    steps = [
        "profile AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, "
        + "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{m}') THEN '{n}'" for n, m in TOPICS) + f" ELSE '{OTHER_TOPIC}' END AS topic, "
        + f"CAST(ceil(coalesce(strlen(text), 0) / {float(BYTES_PER_TOKEN)}) AS DOUBLE) AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens, sum(tokens) AS w FROM profile WHERE tokens > 0 GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"target_{m} AS MATERIALIZED (SELECT {m}, t / sum(t) OVER () AS target FROM (SELECT {m}, pow(sum(tokens), {TEMPER[m]}) AS t FROM cells GROUP BY {m}))")
    now = "cells"
    for r in range(ROUNDS):
        for m in MARGINS:
            new = f"w_{r}_{m}"
            steps.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * target / sum(w) OVER (PARTITION BY {m}) AS w FROM {now} JOIN target_{m} USING ({m}))")
            now = new
    steps.append(f"k0 AS MATERIALIZED (SELECT {PART} * sum(tokens) AS k FROM cells)")
    for i in range(FACTOR_STEPS):
        steps.append(
            f"k{i + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(sum(w) FILTER (w * k < tokens), 0) = 0 THEN any_value(k) ELSE ((SELECT k FROM k0) - coalesce(sum(tokens) FILTER (w * k >= tokens), 0)) / sum(w) FILTER (w * k < tokens) END AS k FROM {now}, k{i})"
        )
    return (
        "WITH " + ",\n".join(steps) + f", rates AS (SELECT source, lang, topic, least(1.0, w * k / tokens) AS p FROM {now}, k{FACTOR_STEPS})\n"
        "SELECT doc_id, topic, CAST(tokens AS BIGINT) AS tokens, round(p, 6) AS probability, "
        "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept FROM ("
        "SELECT d.doc_id, d.topic, d.tokens, CASE WHEN d.tokens > 0 THEN coalesce(r.p, 0.0) ELSE 0.0 END AS p FROM profile d LEFT JOIN rates r USING (source, lang, topic))"
    )


OP7_SQL = _sql()
