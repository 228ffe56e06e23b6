"""URL filters by a bit-parallel wildcard automaton.

Every rule is compiled to glob patterns over a *canonical URL*: the host, A-Z lower-cased and written
backwards, then NUL, then the path. A host rule with its subdomains is then an anchored prefix, and the
star between host and path can't run over the NUL. The patterns stand side by side in multiword
Shift-And masks, one bit a position; a batch of URLs advances together, one byte a step:

    D = (((D << 1) & NO_CARRY) | (D & STAR[c]) | FIRST) & ...

so all patterns are simulated at once over each URL. Nothing is shuffled: rules are a parameter of the
operator, the table is only scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import LOWER

ALLOW, BLOCK = "allow", "block"

#: (verdict, host/path) rules of the production query.
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)
#: Globs over "host/path" that decide where no rule fits; everything else is allowed.
JUNK_GLOBS = ("*spam-farm.*/*", "*cheap-pills.*/*")

_BOUNDARY = 0
_ANY, _HOST = 256, 257  # a star over any byte, and one that stops at the boundary


@dataclass(frozen=True)
class Automaton:
    """``step[c]``: positions that byte c enters; ``stay[c]``: star positions that keep their bit."""

    step: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    accept: np.ndarray  # pattern x word
    words: int


def compile_globs(patterns: list[list[int]]) -> Automaton:
    """Patterns are lists of bytes and stars, anchored at the start and open at the end.

    A bit for each literal; a star belongs to the literal before it and keeps that bit. A pattern
    that begins with a star has an extra position that is on from the start.
    """
    step, stay, first, accept = [], [], [], []  # as Python integers of any width
    step, stay = [0] * 256, [0] * 256
    first = 0
    at = 0
    last_bits = []
    for p in patterns:
        begin = at
        # position `begin` is the pattern's start state
        at += 1
        first |= 1 << begin
        for c in p:
            if c in (_ANY, _HOST):
                for b in range(256):
                    if c == _ANY or b != _BOUNDARY:
                        stay[b] |= 1 << (at - 1)
            else:
                step[c] |= 1 << at
                at += 1
        last_bits.append(at - 1)
        for b in range(256):  # a match is kept to the end
            stay[b] |= 1 << (at - 1)
    words = max(1, -(-at // 64))
    split = lambda x: [(x >> (64 * w)) & ((1 << 64) - 1) for w in range(words)]
    return Automaton(
        np.array([split(x) for x in step], np.uint64).T.copy(),
        np.array([split(x) for x in stay], np.uint64).T.copy(),
        np.array(split(first), np.uint64),
        np.array([split(1 << b) for b in last_bits], np.uint64).reshape(len(patterns), words),
        words,
    )


def run(a: Automaton, texts: list[bytes]) -> np.ndarray:
    """Which pattern matches which text: a boolean array, text x pattern."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
    left = lengths[order]
    buf = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    state = [np.full(n, a.first[w], np.uint64) for w in range(a.words)]
    one, top = np.uint64(1), np.uint64(63)
    alive = np.searchsorted(-left, 0, side="left")
    i = 0
    while alive:
        c = buf[starts[:alive] + i]
        carry = None
        for w in range(a.words):
            d = state[w][:alive]
            shifted = d << one
            if carry is not None:
                shifted |= carry
            carry = d >> top
            state[w][:alive] = (shifted & a.step[w][c]) | (d & a.stay[w][c])
        i += 1
        alive = int(np.searchsorted(-left, -i, side="left"))
    hit = np.zeros((n, len(a.accept)), bool)
    for w in range(a.words):
        hit |= (state[w][:, None] & a.accept[None, :, w]) != 0
    out = np.empty_like(hit)
    out[order] = hit
    return out


def host_and_path(url: bytes | None) -> tuple[bytes, bytes]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end."""
    if url is None:
        return b"", b""
    _, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    rest = rest.split(b"#", 1)[0].split(b"?", 1)[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(LOWER.tobytes()), slash + path


def rule_patterns(rule: str) -> list[list[int]]:
    """The host itself and its subdomains, as two patterns over the canonical URL."""
    host, slash, path = rule.partition("/")
    back, rest = list(host.encode()[::-1]), list((slash + path).encode())
    return [back + [_BOUNDARY] + rest, back + [ord("."), _HOST, _BOUNDARY] + rest]


def glob_pattern(glob: str) -> list[list[int]]:
    """``host-glob/path-glob``: a star in the host part stays in the host."""
    host, slash, path = glob.partition("/")
    back = [_HOST if c == 42 else c for c in host.encode()[::-1]]
    rest = [_ANY if c == 42 else c for c in (slash + path).encode()]
    return [back + [_BOUNDARY] + rest]


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    globs: tuple[str, ...] = JUNK_GLOBS,
) -> DataFrame:
    """``pages`` with columns host, path, rule, verdict appended (same-named columns are replaced).

    The longest rule that fits decides (ties: block before allow, then the smaller rule); where none fits,
    ``rule`` is null and a URL that matches one of ``globs`` is blocked, any other allowed. A null
    URL, or one without ``://``, has an empty host and path, which no rule fits; an empty rule host never fits.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1].encode()), r[0] != BLOCK, r[1]))
    patterns, owner = [], []
    for k, (_, rule) in enumerate(ranked):
        for p in rule_patterns(rule):
            patterns.append(p)
            owner.append(k)
    for g in globs:
        patterns += glob_pattern(g)
        owner.append(len(ranked))
    automaton = compile_globs(patterns)
    owner = np.array(owner)
    names = [r for _, r in ranked] + [None]
    verdicts = [v for v, _ in ranked]
    kept = [f for f in pages.schema.fields if f.name not in ("host", "path", "rule", "verdict")]
    schema = T.StructType(kept + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    keep_names = [f.name for f in kept]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                parts = [host_and_path(u) for u in batch.column(url).cast(pa.binary()).to_pylist()]
                hit = run(automaton, [h[::-1] + b"\0" + p for h, p in parts])
                best = np.full(len(parts), len(ranked) + 1)
                for k in range(len(ranked), -1, -1):
                    best[hit[:, owner == k].any(axis=1)] = k
                rule = [names[min(k, len(ranked))] for k in best]
                verdict = [verdicts[k] if k < len(ranked) else BLOCK if k == len(ranked) else ALLOW for k in best]
                added = [pa.array([x[i].decode() for x in parts], pa.string()) for i in (0, 1)]
                added += [pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep_names] + added, names=schema.names)

    return pages.mapInArrow(judged, schema)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url"))
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://')
      THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      ELSE '' END AS host,
    CASE WHEN contains(url, '://')
      THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*(/[^?#]*)?', 1)
      ELSE '' END AS path
  FROM pages),
rules(kind, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, kind,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, kind DESC, rule_host || rule_path) AS k
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.kind, CASE WHEN p.path <> '' AND regexp_matches(p.host, 'spam-farm\.|cheap-pills\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
