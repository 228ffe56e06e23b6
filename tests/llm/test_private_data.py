from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from wayloom.llm import private_data as pd

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text: str | None) -> list[tuple[str, int, int]]:
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_random_texts():
    rng, pieces = random.Random(3), ["a@b.c", "@", "x.y", "..", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "+", "4539 1488 0343 6467", "4539148803436467", "0", "00", "-", " ", ".", "5", "é", "a-b", "%", "x@", "@y.z", "\n", "1.1", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert [x[:3] for x in pd.spans_of(text) if x[3]] == slow(text), text
        assert pd.detect(text) == slow(text), text


#: (text, kind, what the span covers)
DISGUISED = [
    ("write to john.doe [at] mail [dot] example [dot] com now", "email", "john.doe [at] mail [dot] example [dot] com"),
    ("write to john.doe(at)example.com now", "email", "john.doe(at)example.com"),
    ("ask jane dot roe at example dot org, please", "email", "jane dot roe at example dot org"),
    ("JOHN AT EXAMPLE DOT COM", "email", "JOHN AT EXAMPLE DOT COM"),
    ("me {at} example{dot}net", "email", "me {at} example{dot}net"),
    ("jоhn@exаmple.com with Cyrillic", "email", "jоhn@exаmple.com"),
    ("ａｂｃ＠ｅｘａｍｐｌｅ．ｃｏｍ wide", "email", "ａｂｃ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("j​ohn@exam​ple.com", "email", "j​ohn@exam​ple.com"),
    ("john&#64;example.com", "email", "john&#64;example.com"),
    ("john @ example.com", "email", "john @ example.com"),
    ("john_at_example_dot_com", "email", "john_at_example_dot_com"),
    ("é server at 192 dot 168 dot 0 dot 17 ok", "ip", "192 dot 168 dot 0 dot 17"),
    ("10[.]20[.]30[.]40", "ip", "10[.]20[.]30[.]40"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("１０．２０．３０．４０", "ip", "１０．２０．３０．４０"),
    ("card four five three nine one four eight eight zero three four three six four six seven end", "card", "four five three nine one four eight eight zero three four three six four six seven"),
    ("card 4539 1488 0343 6467", "card", "4539 1488 0343 6467"),
    ("card 4539–1488–0343–6467", "card", "4539–1488–0343–6467"),
    ("٤٥٣٩١٤٨٨٠٣٤٣٦٤٦٧", "card", "٤٥٣٩١٤٨٨٠٣٤٣٦٤٦٧"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("call +1 (five five five) one two three - four five six seven", "phone", "+1 (five five five) one two three - four five six seven"),
    ("ruf plus vier neun, drei null, eins zwei drei vier fünf sechs", "phone", "plus vier neun, drei null, eins zwei drei vier fünf sechs"),
    ("call plus four four double seven one two three four five six", "phone", "plus four four double seven one two three four five six"),
    ("＋１ ５５５ １２３ ４５６７", "phone", "＋１ ５５５ １２３ ４５６７"),
]


@pytest.mark.parametrize("text, kind, covered", DISGUISED)
def test_disguises(text, kind, covered):
    assert [(k, text[s:e], base) for k, s, e, base in pd.spans_of(text)] == [(kind, covered, False)]


CLEAN = [
    None, "", " ", "we met at noon and the dot on the map was red", "one two three and four", "see it at https://example.com/a.b and at home", "call one two three", "plus one more thing",
    "version 1.2.3 of 2010–2015, m², 1º", "a [dot] and an [at] sign", "Привет, это обычный текст. Пишите нам в офис.", "un deux trois, nous irons au bois, quatre cinq six", "point à la ligne at point zero",
    "4111 1111 1111 1112 fails", "the array a[at] = b[.]", "dos y tres son cinco, seis y siete", "x @ y", "email me @ noon. dot com",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts(text):
    assert pd.spans_of(text) == []


def test_base_spans_stay_beside_wider_ones():
    text = "write to аnn@example.com dot now"
    assert [(text[s:e], base) for _, s, e, base in pd.spans_of(text)] == [("аnn@example.com", False), ("nn@example.com", True)]
    assert [x[3] for x in pd.spans_of("ann@example.com dot net")] == [True]


def test_long_runs_take_linear_time():
    at = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "at dot " * 40_000, "[at" * 100_000, "one " * 80_000, "( " * 150_000, "-" * 300_000, "plus " * 60_000):
        pd.spans_of(text)
    assert time.time() - at < 60


def test_query(spark, small):
    from wayloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op13_private_data"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        base = slow(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pd.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in base) and r.n_added == 0  # these texts disguise nothing
    assert sum(r.n_email for r in got) and sum(r.n_phone for r in got)


def test_odd_rows(spark):
    rows = [(None, "a@b.c", 1), (1, None, 2), (1, "a@b.c", 3), (1, "a@b.c", 3), (2, "", 4), (3, "🙂 a@b.c", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int").repartition(3)
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.spans]) for r in pd.find_private(docs).collect()), key=str)
    mail = ("email", 0, 5, True)
    assert got == sorted([(0, [mail]), (1, []), (1, [mail]), (1, [mail]), (2, []), (3, [("email", 2, 7, True)])], key=str)
    assert pd.find_private(docs.limit(0)).count() == 0
