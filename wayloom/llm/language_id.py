"""Language identification by error-correcting output codes.

Each language has a codeword of bits, and for each bit a binary classifier over byte n-grams (logistic regression on
square roots of hashed n-gram frequencies) says which half of the languages a text belongs to. The classifiers' margins
are compared with every codeword under a logistic loss, each bit weighted by how well its classifier does for that
language on texts it wasn't fitted on; the codeword with the least loss wins. A text whose two nearest codewords are close
is flagged as ambiguous.

Classifiers are fitted on a bounded sample of labelled rows (``per_language`` rows a language, by a hash of the id: a
parameter); features of the sample and predictions of all rows are made where the rows are. Predictions never see lang, source
or doc_id.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, buffer_of, slices

DIM = 4096
PER_LANGUAGE = 500
#: A score (the winner's share of the softmax over losses) under this is ambiguous.
AMBIGUOUS = 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Rows whose features are made at a time: they are dense.
ROWS = 256

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 32


def features(text: pa.Array, dim: int = DIM) -> np.ndarray:
    """Texts x dim: square roots of the frequencies of hashed byte pairs and triples. A row of zeros for an empty text."""
    buf, ends = buffer_of(text)
    n = len(ends) - 1
    out = np.zeros((n, dim), np.float32)
    if len(buf) < 2:
        return out
    b = _FOLD[buf].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(ends))
    gap = (b[:-1] == 32) & (b[1:] == 32)  # runs of marks and digits say nothing
    grams = []
    for size in (2, 3):
        if len(b) < size:
            continue
        h = b[: len(b) - size + 1].copy()
        for k in range(1, size):
            h = h * np.uint32(257) + b[k : len(b) - size + 1 + k]
        h = ((h * np.uint32(2654435761)) >> np.uint32(7)) % np.uint32(dim)
        inside = (doc[: len(h)] == doc[size - 1 :]) & ~gap[: len(h)] & ~gap[size - 2 :]
        grams.append((doc[: len(h)][inside] * dim + h[inside]))
    counts = np.bincount(np.concatenate(grams), minlength=n * dim).reshape(n, dim).astype(np.float32)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def codewords(n: int) -> np.ndarray:
    """n x bits, of -1 and 1. Up to 7 languages: every split into two groups; more: the random code with the largest least distance of 50."""
    if n <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).reshape(-1, n).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        code[rng.integers(n, size=bits), np.arange(bits)] *= -1
        code = code[:, np.abs(code.sum(axis=0)) < n]
        d = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9).min()
        if d > most:
            best, most = code, d
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 1e-4, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions, one for each column of ``y`` (-1, 1), by Adam on the whole sample.

    The ridge pulls to ``start`` (else to zero), so a feature that the sample lacks keeps its weight there.
    """
    first = np.zeros((x.shape[1], y.shape[1]), np.float32) if start is None else start.astype(np.float32)
    w, c = first.copy(), np.zeros(y.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(c)]
    v = [np.zeros_like(w), np.zeros_like(c)]
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + c), -30, 30))) / len(x)
        for k, (p, d) in enumerate(((w, x.T @ g + ridge * (w - first)), (c, g.sum(axis=0)))):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p -= 0.3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return w, c


class Model:
    """Languages, their codewords, the bits' classifiers and the weights of the decoding."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        n = len(self.languages)
        if n < 2:
            return
        at = np.array([self.languages.index(v) for v in labels])
        self.code = codewords(n)
        self.w, self.c = fit_bits(x, self.code[at])
        # how often each bit is right for each language, on the half that a classifier hasn't seen
        right, seen = np.ones((n, self.code.shape[1])), np.full((n, 1), 2.0)
        for half in (0, 1):
            fit, test = np.arange(len(at)) % 2 == half, np.arange(len(at)) % 2 != half
            if fit.any() and test.any():
                w, c = fit_bits(x[fit], self.code[at[fit]])
                ok = (x[test] @ w + c) * self.code[at[test]] > 0
                np.add.at(right, at[test], ok)
                np.add.at(seen, at[test], 1)
        weight = right / seen
        self.weight = (weight / weight.sum(axis=1, keepdims=True)).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest language and its share of the softmax of the losses."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = np.clip(x @ self.w + self.c, -8, 8)
        loss = (self.weight[None] * np.log1p(np.exp(-margin[:, None, :] * self.code[None]))).sum(axis=2)
        share = np.exp(4 * (loss.min(axis=1, keepdims=True) - loss))
        best = loss.argmin(axis=1)
        return best, share[np.arange(len(x)), best] / share.sum(axis=1)


def in_fold(doc_id: str, folds: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds)) == remainder


def fit(documents: DataFrame, training, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows where ``training`` holds and lang is not null: about ``per_language`` rows each, chosen by a hash of the id."""
    rows = documents.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros((0, DIM), np.float32), [])
    most = 1 << 31
    bound = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(most, int(most * per_language / n) + 1)))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(most)) < bound[F.col("lang")])
    # rows that share an id, or have none, count as one: however many they are, they don't swell the sample
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=ROWS):
            x = features(batch.column("text")).astype(np.float16)
            some = np.array([bool(t and _LETTER.search(t)) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(pa.array(some)), batch.column("lang").filter(pa.array(some)), pa.array([r.tobytes() for r in x[some]], pa.binary())], names=["doc_id", "lang", "x"]
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, x = [], []
        for batch in batches:
            labels += batch.column("lang").to_pylist()
            x += [np.frombuffer(v, np.float16) for v in batch.column("x").to_pylist()]
        model = Model(np.stack(x).astype(np.float32) if x else np.zeros((0, DIM), np.float32), labels)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, so one task fits the model; the driver gets the weights alone
    rows = sample.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(made, "doc_id bigint, lang string, x binary")
    got = rows.repartition(1).sortWithinPartitions("doc_id", "lang", "x").mapInArrow(fitted, "model binary").first()
    return pickle.loads(got.model) if got else Model(np.zeros((0, DIM), np.float32), [])


def identify(documents: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``documents`` with lang_pred, score (0 to 1) and ambiguous (boolean) appended; same-named columns are replaced.

    A text that is null or without a letter is ``und`` with score 0, and not ambiguous; so is every text if the model knows no language.
    Repeated rows each get the same prediction; an empty table gives no rows; ties between languages go to the first in alphabetical order.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    base = documents.drop("lang_pred", "score", "ambiguous")
    names = base.columns
    from pyspark.sql import types as T

    schema = T.StructType(base.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, rows=ROWS):
            known = np.array([bool(m.languages and t and _LETTER.search(t)) for t in batch.column("text").to_pylist()])
            best, score = m.decode(features(batch.column("text")))
            score = np.where(known, score, 0.0)
            pred = [m.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(known & (score < ambiguous))]
            yield pa.RecordBatch.from_arrays(batch.columns + added, names=names + ["lang_pred", "score", "ambiguous"])

    return base.mapInArrow(judged, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = in_fold("doc_id", 4, 2)
    model = fit(documents, ~held_out)
    return identify(documents.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
