"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayloom.llm import ann, chat_format, decontaminate, language_id, mixing, queries, secret_scan, simhash, token_counts, toxicity, url_filter

from ..oracle import difference

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score string"
ODD = [None, "", " \t\n", "a", "ü" * 3, "word " * 40000, "x" * 300000, "!!! ###", "the same", "the same"]


def documents(spark, texts, ids=None):
    """Rows with null ids, langs and sources among them, and columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if k % 3 == 2 else "en", None if k % 4 == 3 else "s", len(t or ""), "mine", "mine") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    assert difference(queries.QUERIES[name](spark, small), queries.SQL[name], small) == ""


# token counts


def tokenizer():
    import public_tokenizers

    return token_counts.Tokenizer(public_tokenizers.path(token_counts.RANKS), public_tokenizers.PATTERN)


def test_edits_keep_counts():
    t, rng = tokenizer(), random.Random(3)
    alphabet = ["a", "bc", " ", "  ", "\n", "12", "é", "'s", "!", " the", "\u00a0", "\u2003", "日本"]
    make = lambda k: "".join(rng.choices(alphabet, k=k))
    for _ in range(60):
        text = make(rng.randint(0, 1500))
        tree = token_counts.TokenTree(t, text)
        assert (tree.text, tree.total) == (text, t.count(text))
        for _ in range(8):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 30))
            new = make(rng.randint(0, 6))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert (tree.text, tree.total) == (text, t.count(text))


def test_edit_encodes_little():
    t = tokenizer()
    tree = token_counts.TokenTree(t, "the quick brown fox " * 20000)
    tree.edit(200_000, 200_005, "slow")
    assert tree.encoded < 500 and tree.total == t.count(tree.text)


def test_token_counts_rows(spark, small):
    t = tokenizer()
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_counts"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        text = r.text or ""
        edited = text
        for a, b, new in sorted(token_counts.redactions(text), reverse=True):
            edited = edited[:a] + new + edited[b:]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_after) == (t.count(text), t.count(edited))


def test_token_counts_odd(spark):
    import public_tokenizers

    got = token_counts.edit_aware_counts(documents(spark, ODD), public_tokenizers.path(token_counts.RANKS), public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) and sorted(r.n_tokens for r in got)[:2] == [0, 0]
    assert token_counts.edit_aware_counts(documents(spark, []), public_tokenizers.path(token_counts.RANKS), public_tokenizers.PATTERN).count() == 0


# near-duplicates


def fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, budget=4):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(fps.items(), 2):
        if (x ^ y).bit_count() <= budget:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in fps}


def test_simhash_rows(spark, small):
    fps = {r.doc_id: fingerprint(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = {(i, f"{fps[i]:016x}", c) for i, c in groups(fps).items()}
    assert {tuple(r) for r in queries.QUERIES["op2_simhash"](spark, small).collect()} == want


@pytest.mark.parametrize("split_rows", [1 << 14, 7])
def test_simhash_links(spark, split_rows):
    """Chains, clusters and lone fingerprints, through whole and split tries."""
    rng = random.Random(split_rows)
    fps = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
    fps = dict(enumerate(dict.fromkeys(fps)))
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    edges = [tuple(r) for r in simhash.link_edges(spark.createDataFrame(rows, "rep bigint, fp bigint"), split_rows=split_rows).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 12 for a, b in edges)
    from wayloom.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {i: got.get(i, i) for i in fps} == groups(fps)


def test_simhash_odd(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, ODD)).collect()}
    assert len(got) == len(ODD) and got[0].fp == got[1].fp == 0 and got[2].component_id == 0 and got[9].component_id == got[8].component_id
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    twice = simhash.near_duplicates(documents(spark, ["a b c", "d e f", "d e f"], [5, 5, 3])).collect()
    assert {r.component_id for r in twice} == {3}


# decontamination


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_decontamination(spark, block):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(12)] + ["é", "日本"]
    make = lambda k: " ".join(rng.choices(words, k=k))
    items = [(i, make(rng.choice((0, 1, 3, 10, 11, 25)))) for i in range(30)] + [(99, None), (98, "!!")]
    texts = [make(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "").upper() + "," + make(5) for _ in range(80)] + ODD
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    for k, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        if len(w) > 500:
            continue
        for item, text in items:
            own = split(text)
            size = min(10, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        assert (got[k].n_words, got[k].n_hit, got[k].items) == (len(w), len(hit), sorted(found)), k
    clean = decontaminate.decontaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.n_hit} and clean.columns == docs.columns


# nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 48))
    x = (centres[rng.integers(20, size=3000)] + 0.3 * rng.normal(size=(3000, 48))).astype(np.float32)
    x[100] = x[7]
    x[105] = x[7]
    rows = [(i, v.tolist(), "mine") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5100, [0.0] * 48, ""), (5200, [float("nan")] * 48, ""), (5300, [None] * 48, ""), (5400, [1.0], "")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string").repartition(5)
    for block in (8192, 7):
        got = ann.nearest(table, F.col("vec_id") % 100 == 0, block=block).collect()
        y, found, all_ = x.astype(np.float64), {}, 0
        for r in got:
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert sorted(found) == list(range(0, 3000, 100))
        for q, own in found.items():
            d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
            want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
            own.sort()
            assert [r for r, _, _ in own] == list(range(1, 11))
            assert np.allclose([s for _, _, s in own], d[[v for _, v, _ in own]], rtol=1e-12)
            all_ += len(set(want) & {v for _, v, _ in own})
        assert all_ >= 0.97 * 300
    few = ann.nearest(spark.createDataFrame(rows[:4], table.schema), F.col("vec_id") == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2, 3]
    assert ann.nearest(spark.createDataFrame([], table.schema), F.col("vec_id") == 0).count() == 0


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton():
    terms = [(t.encode(), True, 1) for t in ("idiot", "moron", "scum", "worthless")]
    lexicon, rng = toxicity.Lexicon(terms), random.Random(1)
    words = ["".join(rng.choices("idotmrnscuwhle", k=rng.randint(1, 10))) for _ in range(400)]
    for t, _, _ in terms:
        for _ in range(60):
            w = list(t.decode())
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice(["", "x", "a", w[k] * 2])
            words.append("".join(w) or "a")
    data = " ".join(words).encode()
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])[:-1]
    found, kinds = lexicon.find(np.frombuffer(data, np.uint8), starts, starts + [len(w) for w in words])
    got = dict(zip(found.tolist(), kinds.tolist()))
    for k, w in enumerate(words):
        exact = any(w.encode() == t for t, _, _ in terms)
        near = any(len(t) >= 5 and distance(w.encode(), t) <= 1 for t, _, _ in terms)
        assert got.get(k, 0) == (1 if exact else 3 if near else 0), w


def test_quotation():
    m = toxicity.Model(toxicity.Lexicon([(b"idiot", True, 1)]), np.array(toxicity.PRIOR), toxicity.PRIOR_BIAS)
    abuse, typo, quote, clean, empty, null = m.score(["you are an idiot", "you are an idoit idiiot", 'he wrote "an idiot" in the report', "a fine day", "", None])
    assert min(abuse, typo) > 0.5 > max(quote, clean) and empty == null == clean


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    got = queries.QUERIES["op5_toxicity"](spark, d).cache()
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.collect())
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93


def test_toxicity_odd(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark, ODD), none, F.lit(True))
    got = toxicity.score(documents(spark, ODD).withColumn("held_out", F.lit(False)), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.5 for r in got)


# secret scans


def test_secrets(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    held = secret_scan.labelled_findings(spark, 800, seed=77).collect()
    x = np.array([secret_scan.describe(r.value, (r.before or "")[-40:], (r.after or "")[:40]) for r in held])
    assert np.mean((forest.score(x) >= 0.5) == [r.label == 1 for r in held]) > 0.95
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [f'set token = "{key}" now', f"commit {key} fixed it", *ODD]
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in secret_scan.scan(docs, forest).collect()}
    assert found[0].value == key and found[1].value == key and {k for k, r in found.items() if r.is_secret} == {0}  # a long run is a candidate whatever it is made of
    masked = {r.doc_id: r for r in secret_scan.masked(docs, forest).collect()}
    assert masked[0].text == 'set token = "[SECRET]" now' and masked[0].n_chars == len(masked[0].text)
    assert [masked[k].text for k in range(1, len(texts))] == texts[1:] and masked[0].fp == "mine"
    assert secret_scan.scan(documents(spark, []), forest).count() == 0


# mixing


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "some words and more " * rng.randint(1, 30) + rng.choice(["", " | ", "!!"]), rng.choice(["en", "en", "de"]), rng.choice(["big"] * 6 + ["a", "b"]), 0, "", "") for i in range(6000)]
    got = mixing.calibrated(spark.createDataFrame(rows, DOCS)).toPandas()
    assert abs(got.tokens[got.kept].sum() / got.tokens.sum() - mixing.PART) < 0.03
    inside = got[got.probability < 1]
    for m in ("source", "lang"):
        want = got.groupby(m).tokens.sum() ** mixing.TEMPER[m]
        have = (got.tokens * got.probability).groupby(got[m]).sum()
        if (inside[m].value_counts() == got[m].value_counts()).all():  # nothing was taken whole
            assert np.allclose(have / have.sum(), want / want.sum(), atol=0.01)
    cells = spark.createDataFrame(got.groupby(["source", "lang", "topic"], as_index=False).tokens.sum())
    assert mixing.residual(mixing.rake(cells)) < 1e-6  # after the production number of rounds
    assert mixing.calibrated(documents(spark, [])).count() == 0
    odd = {r.doc_id: r for r in mixing.calibrated(documents(spark, ODD)).collect()}
    assert len(odd) == len(ODD) and not odd[0].kept and not odd[1].kept and odd[0].probability == 0 and odd[0].score == "mine"


# chat formatting


def test_chat_round_trip(spark):
    import public_tokenizers

    rng = random.Random(6)
    bits = ["<", "|", "\\", "<|turn|>", "<|end|>", "<\\|", "a", "é", "🙂", " ", "\n", "</s>", "[INST]", "assistant"]
    make = lambda: rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 12)))])
    rows = [(c, t, rng.choice(["user", "assistant", None, "<|x"]), make(), "mine") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "hi", ""), (77, 0, "assistant", "long " * 300000, "")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns string")
    got = chat_format.format_conversations(table, public_tokenizers.path(chat_format.TOKENIZER), content=True).collect()
    assert len(got) == 42
    for r in got:
        own = [(role or "", text or "") for c, _, role, text, _ in rows if c == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert chat_format.read_back(r.formatted) == own and len(r.token_ids) == len(r.loss_mask) == r.n_tokens
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
    assert chat_format.format_conversations(table.limit(0), public_tokenizers.path(chat_format.TOKENIZER)).count() == 0


# URL filters


def test_globs_match_regular_expressions():
    rng = random.Random(8)
    globs = ["".join(rng.choices("ab*", k=rng.randint(1, 8))) for _ in range(60)]
    patterns = [[url_filter._ANY if c == "*" else ord(c) for c in g] for g in globs]
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 14))) for _ in range(300)]
    hit = url_filter.run(url_filter.compile_globs(patterns), [t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert hit[i, j] == bool(re.match(g.replace("*", ".*"), t)), (t, g)


def test_urls_odd(spark):
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://notexample.com/en/", "http://a.net/es/é", "http://net/fr/", "http://x.org?com/", "a://b://c.com/"]
    rows = [(i, u, "mine", "mine") for i, u in enumerate(urls)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, rule string, extra string")).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5][2:] == ("example.com/en/", "block")
    assert got[6][2:] == ("com/", "allow") and got[7][2:] == ("net/es/", "block") and got[8][2:] == ("net/fr/", "block")
    assert got[9] == ("x.org", "", None, "allow") and got[10] == ("b:", "//c.com/", None, "allow")


# language ID


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.QUERIES["op10_language_id"](spark, d).collect()
    assert len(got) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    rows = [r for r in got if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.97


def test_language_odd(spark):
    d = documents(spark, ODD + ["12 34"])
    none = language_id.identify(d, language_id.fit(d.filter("doc_id < 0"), F.lit(True))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = {r.doc_id: r for r in language_id.identify(d, language_id.fit(d, F.lit(True))).collect()}
    assert [one[k].lang_pred for k in (0, 1, 2, 7, 10)] == ["und"] * 5 and one[3].lang_pred == "en" and one[0].score == 0.0


def test_many_languages_decode():
    rng = np.random.default_rng(0)
    centres = rng.random((12, 64)).astype(np.float32)
    at = rng.integers(12, size=1500)
    x = centres[at] + 0.1 * rng.normal(size=(1500, 64)).astype(np.float32)
    m = language_id.Model(x[:1000], [f"l{k:02d}" for k in at[:1000]])
    best, score = m.decode(x[1000:])
    assert np.mean(best == at[1000:]) > 0.95 and ((score > 0) & (score <= 1)).all()
