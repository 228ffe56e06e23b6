"""Toxicity by Levenshtein automata over a lexicon trie, and context windows.

The lexicon is a short seed list and what the labels teach: words, and beginnings of words, that stand far more often
in documents marked toxic. Its trie is intersected with Levenshtein automata (one error for words of five letters or more) once,
on the driver, into one deterministic table; tasks run that table over all words of a slice of text together, one byte a step, so a
misspelling costs no more to find than a correct spelling. Each hit is then seen in its window of words: quotation marks and
words of reporting make it a quotation, words of address make it abuse. A logistic regression over the counts gives the score.

Terms and weights are learned on a bounded sample of labelled rows (a parameter); every whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import fit_bits, in_fold
from ..operators.shared import written
from .words import ALNUM, buffer_of, slices, word_bounds

SEED_TERMS = ("idiot", "moron", "scum", "stupid", "loser", "worthless", "pathetic", "disgusting", "trash", "clown", "imbecile", "bastard", "bitch", "asshole", "fuck", "shit", "cunt", "retard")
#: Weights before any label is seen, in the order of COUNTS.
PRIOR = (1.0, 0.5, 1.0, 0.0, 0.3, 5.0, 3.0, 0.5)
PRIOR_BIAS = -4.0
#: A word one error from a term that stands in so many clean documents of the sample is a word of its own.
ORDINARY = 2
ADDRESS = frozenset(b"you your yours youre u ur they them these those he she him her everyone".split())
REPORT = frozenset(b"said says say quoted quote wrote writes called calls word term phrase cited cites reported mentions mentioned slur".split())
#: Rows of each label that terms and weights are learned on, about.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
#: A term stands in at least this share of the toxic documents: words of one text and its copies teach nothing.
TERM_SHARE = 0.02
#: Terms whose trie and automata make one table; more terms make more tables, which are run in turn.
TABLE_TERMS = 150
MIN_ODDS, STRONG_ODDS = 8.0, 40.0
WINDOW = 6
_LOOK = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_IS_WORD = ALNUM.copy()
_IS_WORD[64] = True
DEAD = 0


class Lexicon:
    """The trie of terms intersected with Levenshtein automata, as a table: state x byte class to state.

    A term is (bytes, whole word or only its beginning, kind 1 or 2); kind 3 is given for a word one error off.
    """

    def __init__(self, terms: list[tuple[bytes, bool, int]]):
        children, ends, errors, begun = [{}], [None], [0], [0]
        for text, whole, kind in terms:
            at, allowed = 0, int(whole and len(text) >= 5)
            errors[0] = max(errors[0], allowed)
            for c in text:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(None)
                    errors.append(0)
                    begun.append(0)
                at = children[at][c]
                errors[at] = max(errors[at], allowed)
            # a word and a beginning can be spelled the same: both stay
            if not whole:
                begun[at] = min(begun[at] or kind, kind)
            elif ends[at] is None or kind < ends[at][1]:
                ends[at] = (whole, kind, allowed)
        looks = {ord(a): ord(b) for a, b in _LOOK.items()}
        used = sorted({c for t, _, _ in terms for c in t})
        self.cls = np.zeros(256, np.int32)
        for k, c in enumerate(used):
            self.cls[c] = k + 1
        for a, b in looks.items():
            if not self.cls[a]:
                self.cls[a] = self.cls[b]
        n_cls = len(used) + 1
        byte_of = [None, *used]

        def closed(state: dict[int, int]) -> frozenset:
            todo = list(state)
            while todo:
                n = todo.pop()
                e = state[n] + 1
                for child in children[n].values():  # a letter left out
                    if e <= errors[child] and state.get(child, 9) > e:
                        state[child] = e
                        todo.append(child)
            return frozenset(state.items())

        stuck = {1: 1, 2: 2}  # states after a beginning was met: whatever follows
        start = closed({0: 0})
        numbers = {frozenset(): DEAD, ("met", 1): 1, ("met", 2): 2, start: 3}
        todo, rows, accept = [start], {DEAD: [DEAD] * n_cls, 1: [1] * n_cls, 2: [2] * n_cls}, {DEAD: 0, **stuck}
        while todo:
            state = todo.pop()
            k = numbers[state]
            best = 0
            for n, e in state:
                if ends[n] and ends[n][0] and e <= ends[n][2]:
                    kind = ends[n][1] if e == 0 else 3
                    best = kind if not best else min(best, kind)
            accept[k], rows[k] = best, []
            for c in range(n_cls):
                new: dict[int, int] = {}
                met = 0
                for n, e in state:
                    child = children[n].get(byte_of[c]) if c else None
                    if child is not None and e <= errors[child]:
                        new[child] = min(new.get(child, 9), e)
                        if e == 0 and begun[child]:
                            met = begun[child]
                    if e + 1 <= errors[n]:
                        new[n] = min(new.get(n, 9), e + 1)  # a letter too many
                    for child in children[n].values():  # a wrong letter
                        if e + 1 <= errors[child]:
                            new[child] = min(new.get(child, 9), e + 1)
                key = ("met", met) if met else closed(new)
                if key not in numbers:
                    numbers[key] = len(numbers)
                    todo.append(key)
                rows[k].append(numbers[key])
        self.table = np.array([rows[k] for k in range(len(numbers))], np.int32)
        self.accept = np.array([accept[k] for k in range(len(numbers))], np.int8)

        self.ordinary: frozenset[bytes] = frozenset()

    def find(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that a term accepts, and the kinds."""
        found, kinds = [], []
        rows = np.arange(len(starts))
        at, left = starts.copy(), stops - starts
        state = np.full(len(starts), 3, np.int32)
        while len(rows):
            state = self.table[state, self.cls[buf[at]]]
            at, left = at + 1, left - 1
            over = left == 0
            kind = self.accept[state]
            hit = (over & (kind > 0)) | ((state == 1) | (state == 2))
            if hit.any():
                found.append(rows[hit])
                kinds.append(kind[hit])
            go = ~(over | hit) & (state != DEAD)
            rows, at, left, state = rows[go], at[go], left[go], state[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int8)
        found, kinds = np.concatenate(found), np.concatenate(kinds)
        order = np.argsort(found)
        return found[order], kinds[order]


class Lexicons:
    """Any number of terms: tables of ``TABLE_TERMS`` terms each, run in turn over the same words. A word that several accept has the strongest kind."""

    def __init__(self, terms: list[tuple[bytes, bool, int]], size: int = TABLE_TERMS):
        ordered = sorted(set(terms))  # terms with a common beginning share a table
        self.parts = [Lexicon(ordered[k : k + size]) for k in range(0, max(1, len(ordered)), size)]
        self.ordinary: frozenset[bytes] = frozenset()

    def find(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(starts), 9, np.int8)
        for part in self.parts:
            words, kinds = part.find(buf, starts, stops)
            best[words] = np.minimum(best[words], kinds)
        words = np.flatnonzero(best < 9)
        return words, best[words]


_QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "’": "'", "‘": "'"})
_HAS_QUOTE = re.compile("[“”„«»’‘]")


def lowered(texts: list[str | None]) -> pa.Array:
    out = [(t or "").lower() for t in texts]
    return pa.array([t.translate(_QUOTES) if _HAS_QUOTE.search(t) else t for t in out], pa.string())


COUNTS = ("strong", "weak", "misspelled", "quoted", "addressed", "any_strong", "any_misspelled", "density")


def context_counts(texts: list[str | None], lexicon: Lexicon | Lexicons) -> np.ndarray:
    """Texts x COUNTS. A hit in quotation marks or next to a word of reporting counts as quoted, and not as its kind."""
    low = lowered(texts)
    buf, ends = buffer_of(low)
    starts, stops, first = word_bounds(buf, ends, _IS_WORD)
    words, kinds = lexicon.find(buf, starts, stops)
    raw = np.zeros((len(texts), 5))
    data = buf.tobytes()
    docs = np.searchsorted(first, words, side="right") - 1
    for w, kind, d in zip(words.tolist(), kinds.tolist(), docs.tolist()):
        if kind == 3 and data[starts[w] : stops[w]] in lexicon.ordinary:
            continue
        lo, hi = max(int(first[d]), w - WINDOW), min(int(first[d + 1]), w + WINDOW + 1)
        near = {data[starts[i] : stops[i]] for i in range(lo, hi) if i != w}
        before, after = data[starts[lo] : starts[w]], data[stops[w] : stops[hi - 1]]
        quoted = (before.count(b'"') % 2 == 1 and b'"' in after) or (near & REPORT and b'"' in before + after)
        if quoted:
            raw[d, 3] += 1
        else:
            raw[d, kind - 1] += 1
            if near & ADDRESS:
                raw[d, 4] += 1
    n_words = np.maximum(np.diff(first), 1)
    plain = raw[:, 0] + raw[:, 1] + raw[:, 2]
    return np.column_stack([np.log1p(raw), raw[:, 0] > 0, raw[:, 2] > 0, np.log1p(100 * plain / n_words)])


class Model:
    def __init__(self, lexicon: Lexicon | Lexicons, w: np.ndarray, c: float):
        self.lexicon, self.w, self.c = lexicon, w, c

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(context_counts(texts, self.lexicon) @ self.w + self.c, -30, 30)))


def _beginnings(texts: list[str | None]) -> Iterator[set[bytes]]:
    """For each text its words (with a NUL after them) and their beginnings of four to eight letters."""
    for t in lowered(texts).to_pylist():
        out = set()
        for w in set(re.findall(r"[^\W\d_]{4,}", t)):
            out.add(w.encode() + b"\0")
            out.update(w[:k].encode() for k in range(4, min(8, len(w)) + 1))
        yield out


def learned_terms(sample: DataFrame, toxic: int, clean: int) -> list[tuple[bytes, bool, int]]:
    """Terms of a labelled sample (text, toxic): all that are far more frequent in toxic documents, the most telling first.

    Each stands in ``TERM_SHARE`` of the toxic documents, so there are at most 1 / TERM_SHARE times as many as a toxic document has words and beginnings.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            for own, label in zip(_beginnings(batch.column("text").to_pylist()), batch.column("toxic").to_pylist()):
                seen[label].update(own)
        keys = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), 20000):
            part = keys[at : at + 20000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[1][k] for k in part], pa.int64()), pa.array([seen[0][k] for k in part], pa.int64())], names=["term", "t", "c"])

    least = max(5, int(TERM_SHARE * toxic))
    counts = sample.mapInArrow(counted, "term binary, t bigint, c bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = ((F.col("t") + 0.1) / F.lit(toxic + 1.0)) / ((F.col("c") + 0.5) / F.lit(clean + 1.0))
    top = counts.filter((F.col("t") >= least) & (odds >= MIN_ODDS)).withColumn("odds", odds).orderBy((F.col("t") * F.log("odds")).desc(), F.length("term").desc(), "term").collect()
    out: list[tuple[bytes, bool, int]] = []
    covered: list[tuple[bytes, bool, int]] = []
    for r in top:
        text, whole = bytes(r.term).rstrip(b"\0"), bytes(r.term).endswith(b"\0")
        kind = 1 if r.odds >= STRONG_ODDS else 2
        if whole and any(not w and text.startswith(t) for t, w, _ in out):
            covered.append((text, whole, kind))  # its misspellings aren't covered by the beginning
            continue
        if any(text.startswith(t) if not w else text == t for t, w, _ in out) or not whole and any(t.startswith(text) for t, _, _ in out):
            continue
        out.append((text, whole, kind))
    return out + covered


def ordinary_words(clean: DataFrame, lexicon: Lexicons) -> frozenset[bytes]:
    """Words of clean documents that are one error from a term, and stand in at least ORDINARY of them."""
    sent = clean.sparkSession.sparkContext.broadcast(lexicon)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            buf, ends = buffer_of(lowered(batch.column("text").to_pylist()))
            starts, stops, first = word_bounds(buf, ends, _IS_WORD)
            words, kinds = sent.value.find(buf, starts, stops)
            docs, data = np.searchsorted(first, words, side="right"), buf.tobytes()
            seen.update({(d, data[starts[w] : stops[w]]) for w, k, d in zip(words.tolist(), kinds.tolist(), docs.tolist()) if k == 3})
            one = Counter(w for _, w in seen)
            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(one), pa.binary()), pa.array(list(one.values()), pa.int64())], names=["word", "n"])

    return frozenset(bytes(r.word) for r in clean.mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= ORDINARY).collect())


def fit(documents: DataFrame, labels: DataFrame, training, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """A model of the labelled documents where ``training`` (a condition on doc_id) holds.

    About ``toxic_rows`` and ``clean_rows`` of them, chosen by a hash of the id. Without labels of both kinds, only the seed
    terms are known and weigh by rule. Rows with a null id, label or text teach nothing; of rows that share an id, the first text does.
    """
    marked = labels.filter(training & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    seeds = [(t.encode(), True, 1) for t in SEED_TERMS]
    by_rule = Model(Lexicons(seeds), np.array(PRIOR), PRIOR_BIAS)
    if not total.get(0) or not total.get(1):
        return by_rule
    most = 1 << 31
    share = F.when(F.col("toxic") == 1, int(min(1, toxic_rows / total[1]) * most)).otherwise(int(min(1, clean_rows / total[0]) * most))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(most)) < share)
    # at most a few thousand rows (the two parameters), so they are sent to the documents
    sample = written(documents.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), "labelled")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return by_rule
    terms = learned_terms(sample.select("text", "toxic"), n[1], n[0])
    known = {t for t, whole, _ in terms if whole}
    lexicon = Lexicons(terms + [s for s in seeds if s[0] not in known])
    lexicon.ordinary = ordinary_words(sample.filter("toxic = 0").select("text"), lexicon)
    sent = documents.sparkSession.sparkContext.broadcast(lexicon)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = context_counts(batch.column("text").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = sorted(sample.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(made, "doc_id bigint, toxic int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x))
    x, y = np.array([r.x for r in got], np.float32), np.array([[1.0 if r.toxic else -1.0] for r in got], np.float32)
    w, c = fit_bits(x, y, steps=400, ridge=1e-3, start=np.array(PRIOR)[:, None])
    return Model(lexicon, w[:, 0].astype(np.float64), float(c[0]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted. ``held_out`` is the caller's column; other columns are ignored.

    Null and empty texts have the score of a text without a hit. Repeated rows each get the same score; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = sent.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("bigint"), "held_out", F.col("text").cast("string")).mapInArrow(judged, "doc_id bigint, held_out boolean, score double, predicted int")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = in_fold("doc_id", 5, 0)
    return score(documents.withColumn("held_out", held_out), fit(documents, labels, ~held_out))
