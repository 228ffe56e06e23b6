"""Personal data in texts, disguised or not, with places in the text as it stands.

Base spans are what four patterns find in the text itself. Then two transducers write the text anew: the first replaces look-alikes of ASCII
characters (Cyrillic and Greek letters, full-width and mathematical forms, other scripts' digits), character for character; the second rewrites
disguises (``[at]``, ``at ... dot``, spelled digits, ``plus``, invisible characters) and keeps, for every stretch that it writes, which stretch of the source it
stands for. The same four detectors run over its output, and what they find there is mapped back to the source.

All patterns take time in proportion to the text: a mail address is looked for from its ``@``, and no pattern begins anew
inside a run of digits.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TEN = str.maketrans("", "", " ().+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap: of each ``@`` that a domain follows, with the run of local characters before it."""
    last = 0
    for m in _DOMAIN.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            last = m.end()
            yield begin, last


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].translate(_TEN)) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(m[0].translate(_TEN)) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ғ": "F", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "｡": ".", "․": ".", "·": ".",
}
INVISIBLE = "­​‌‍⁠﻿"


@functools.cache
def folding() -> tuple[dict[int, str], re.Pattern]:
    """Each look-alike's ASCII character, and a pattern for texts that may hold one: all of the basic plane's, and whatever is beyond it.

    Besides the list above: characters whose compatibility form is one printable ASCII character (raised and lowered ones left out) and
    the decimal digits of every script.
    """
    table = {ord(c): x for c, x in LOOK_ALIKES.items()}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(c) == "Nd":
            table.setdefault(ord(c), str(unicodedata.decimal(c)))
        elif (form := unicodedata.decomposition(c)) and not form.startswith(("<super>", "<sub>")):
            if len(x := unicodedata.normalize("NFKC", c)) == 1 and " " <= x <= "~":
                table.setdefault(ord(c), x)
    return table, re.compile("[" + "".join(chr(c) for c in table if c < 1 << 16) + INVISIBLE + "\U00010000-\U0010ffff]")


#: Spelled digits by language, from 0 on.
DIGITS = {
    "en": ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    "de": ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    "fr": ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    "es": ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
}
_DIGIT_OF = {w: str(k) for words in DIGITS.values() for k, w in enumerate(words)} | {"oh": "0"}
_TIMES = {"double": 2, "triple": 3}
_SPELLED = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_DIGIT = rf"(?:(?:{'|'.join(_TIMES)})\s+)?(?:{_SPELLED})"
_AT, _DOT = "at|arroba|arobase", "dot|punto|point|punkt"
_OPEN, _CLOSE = r"[ \t]*[\[({<]\s*", r"\s*[\])}>][ \t]*"
_SPACED_DOT = rf"(?:\s+|[_-])(?:{_DOT})(?:\s+|[_-])"
_BRACKET_DOT = rf"{_OPEN}(?:{_DOT}|\.){_CLOSE}"
_ANY_DOT = rf"(?:{_BRACKET_DOT}|{_SPACED_DOT})"
_REWRITES = re.compile(
    rf"(?P<none>[{INVISIBLE}]+)"
    rf"|(?P<at>(?<=[A-Za-z0-9._%+-]){_OPEN}(?:{_AT}|@){_CLOSE}(?=[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9])(?:&\#0*64;|&commat;|%40)(?=[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9._%+-])(?:[ \t]+@[ \t]*|@[ \t]+)(?=[A-Za-z0-9-]+(?:\.[A-Za-z]|{_ANY_DOT}))"
    rf"|(?<=[A-Za-z0-9])(?:\s+|[_-])(?:{_AT})(?:\s+|[_-])(?=[A-Za-z0-9-]+{_ANY_DOT}[A-Za-z]))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_BRACKET_DOT}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?:&\#0*46;|&period;)(?=[A-Za-z0-9]))"
    rf"|(?P<weak>(?<=[A-Za-z0-9]){_SPACED_DOT}(?=[A-Za-z0-9]))"
    rf"|(?<![^\W_])(?P<digits>{_DIGIT}(?:(?:[ \t]*[,-][ \t]*|\s+){_DIGIT})+|{_DIGIT}(?={_ANY_DOT}|\.)|(?<=[Dd][Oo][Tt][ _-])(?:{_SPELLED}))(?![^\W_])"
    rf"|(?<![^\W_])(?P<plus>plus\s+)(?=[0-9]|(?:{_SPELLED})(?![^\W_]))",
    re.IGNORECASE,
)
#: What a text must hold for the second transducer to have work that a detector could see: characters or words, one of which must be there, and a pattern, for the text in lower case.
_GATES = (
    ("[({<&%", re.compile(rf"[\[({{<]\s*(?:{_AT}|{_DOT}|[@.])\s*[\])}}>]|&\#0*(?:64|46);|&commat;|&period;|%40")),
    (_DOT.split("|"), re.compile(rf"[\s_-](?:{_DOT})[\s_-]")),
    ("@", re.compile(r"\s@|@\s")),
    (("plus",), re.compile(r"plus\s")),
    (("",), re.compile(rf"(?:{_SPELLED})(?:\s[\s,-]*|[,-][\s,-]*)(?:{_SPELLED})[\s,-]+(?:{_SPELLED})")),
)


def disguised(text: str) -> bool:
    low = text.lower()
    return any(any(x in low for x in needed) and pattern.search(low) for needed, pattern in _GATES)


def _digits(spelled: str) -> str:
    out, times = [], 1
    for word in re.findall(r"[^\W\d_]+", spelled.lower()):
        if word in _TIMES:
            times = _TIMES[word]
        else:
            out.append(_DIGIT_OF[word] * times)
            times = 1
    return "".join(out)


class Rewritten:
    """The transducers' output, and for each stretch of it the source's stretch behind it."""

    def __init__(self, source: str):
        table, pattern = folding()
        odd = not source.isascii() and pattern.search(source)
        self.folded = source.translate(table) if odd else source
        parts, self.at, self.behind, self.strong = [], [0], [(0, 0, False)], []
        written = done = 0

        def put(text: str, begin: int, end: int, whole: bool) -> None:
            nonlocal written
            if text:
                parts.append(text)
                self.at.append(written)
                self.behind.append((begin, end, whole))
                written += len(text)

        if odd or disguised(self.folded):
            for m in _REWRITES.finditer(self.folded):
                kind = m.lastgroup
                if kind == "weak" and _DOMAIN.search(self.folded[self._word(m.start(), done) : m.start()]):
                    continue  # "a@b.c dot ..." is a whole address and a word
                new = {"none": "", "at": "@", "dot": ".", "weak": ".", "plus": "+"}.get(kind)
                if new is None:
                    new = _digits(m[0])
                put(self.folded[done : m.start()], done, m.start(), False)
                put(new, *m.span(), True)
                if kind != "weak":
                    self.strong.append(m.start())
                done = m.end()
        put(self.folded[done:], done, len(source), False)
        self.text = "".join(parts)
        self.changed = self.text != source

    def _word(self, end: int, least: int) -> int:
        """Where the word before ``end`` begins, not before ``least``."""
        begin = end
        while begin > least and not self.folded[begin - 1].isspace():
            begin -= 1
        return begin

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        def behind(place: int) -> tuple[int, int]:
            k = bisect_right(self.at, place) - 1
            begin, stop, whole = self.behind[k]
            return (begin, stop) if whole else (begin + place - self.at[k], begin + place - self.at[k] + 1)

        return behind(start)[0], behind(end - 1)[1]


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of one text, by kind as listed, then start, then end."""
    text = text or ""
    base = detect(text)
    new = Rewritten(text)
    if not new.changed:
        return [(*x, True) for x in base]
    known, added = set(base), []
    for kind, s, e in detect(new.text):
        begin, end = new.source_span(s, e)
        if (kind, begin, end) in known or text[begin:end] == new.text[s:e]:
            continue
        met = [x for x in base if x[0] == kind and x[1] < end and begin < x[2]]
        # beyond a base span only what more than a word "dot" disguises
        strong = new.folded[begin:end] != text[begin:end] or any(begin <= k < end for k in new.strong)
        if not met or strong and not any(x[1] <= begin and end <= x[2] for x in met):
            added.append((kind, begin, end))
    both = [(*x, True) for x in base] + [(*x, False) for x in added]
    return sorted(both, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_private(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, spans (kind, start, end in code points, end exclusive, base; by kind as listed in KINDS, then start).

    Spans that are not base ones come from the rewritten text. One that lies inside a base span of its kind isn't added; one that reaches beyond it is,
    and both stay. A null text has none. Repeated rows give repeated rows; null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SPAN]
        for batch in slices(batches):
            spans = [[dict(zip(names, x)) for x in spans_of(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(found, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")


def op13_private_data(spark, sf_dir: str) -> DataFrame:
    """n_email to n_phone count base spans, as base_sha256 does; n_added counts the others."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda x: x["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return find_private(documents).select(
        "doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"), (F.size("spans") - F.size(base)).cast("bigint").alias("n_added")
    )
