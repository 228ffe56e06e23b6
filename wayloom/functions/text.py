"""Names and codes: normalizing, tokens, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

# Accented letters and what they fold to, dashes, stop words of route names.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇáàâäãåéèêëíìîïóòôöõúùûüñçß"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCaaaaaaeeeeiiiiooooouuuuncs"
DASHES = "‐‑‒–—―"
STOP_WORDS = ("san", "santa", "jose", "del", "las", "los", "por", "con", "cartago", "ruta", "buses", "bus", "ida", "vuelta")
# The classes of a route name, in the order in which they are tried: (class, must match, must not match).
CATEGORIES = (
    ("expreso", r"(^|[^A-Z])(EXPRESO|DIRECTO)([^A-Z]|$)", None),
    ("troncal", r"(^|[^A-Z])(TRONCAL|CORREDOR|TERMINAL)([^A-Z]|$)", None),
    ("interurbana", r"^[A-Z ]+-(LIMON|SAN JOSE|ALAJUELA)($|[^A-Z])", r"^(LIMON|SAN JOSE|ALAJUELA)-"),
    ("local", r"(BARRIO|B[.]|URBANIZACION|RESIDENCIAL)", None),
    (
        "local",
        r"^(CARTAGO|ALAJUELA|HEREDIA|SAN JOSE|CARIARI|GRECIA|LIBERIA|NICOYA|PUNTARENAS|CIUDAD QUESADA|PEREZ ZELEDON|PALMARES)-",
        r"-(SAN JOSE|TURRIALBA|PARAISO|LIMON|ALAJUELA|HEREDIA|LIBERIA|NICOYA|PUNTARENAS|CIUDAD QUESADA|PEREZ ZELEDON|PALMARES)($|[^A-Z])",
    ),
    ("interurbana", r"(SAN JOSE|TURRIALBA|PARAISO|OROSI|CERVANTES|PACAYAS|JUAN VINAS|TRES RIOS|LA UNION|IRAZU|TEJAR|EL GUARCO|COT|LIMON)", None),
    (
        "local",
        r"(TARAS|SAN NICOLAS|AGUACALIENTE|GUADALUPE|OCCIDENTAL|ORIENTAL|LOURDES|DULCE NOMBRE|TIERRA BLANCA|BLANQUILLO|EL ALTO|MATA DE MORA|PIEDRA AZUL|PE.?A BLANCA|LOAIZA|EL HUMO|LA PUEBLA|PARQUE INDUSTRIAL|RIO MACHO|SANTIAGO)",
        None,
    ),
)


def route_code(x) -> Column:
    """Digits only, padded to four; null without a digit."""
    return F.lpad(F.nullif(F.regexp_replace(c(x), "[^0-9]", ""), F.lit("")), 4, "0")


def squeezed(x) -> Column:
    """White space collapsed and trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c(x), r"\s+", " ")), F.lit(""))


def direction(x) -> Column:
    v = F.upper(F.trim(F.coalesce(c(x), F.lit(""))))
    return F.when(v == "1-2", "ida").when(v == "2-1", "vuelta").when(v == "ANILLO HORARIO", "loop_horario").when(v == "ANILLO ANTIHORARIO", "loop_antihorario").otherwise("sin_definir")


def family_code(x) -> Column:
    """A three-part code without its last number: variants of one family share it."""
    return F.when(c(x).rlike(r"^[^-]+-[^-]+-[0-9]+$"), F.regexp_replace(c(x), "-[0-9]+$", "")).otherwise(c(x))


def folded(x) -> Column:
    """Upper case without accents, plain dashes, single spaces."""
    plain = F.translate(F.translate(F.coalesce(c(x), F.lit("")), ACCENTED, PLAIN), DASHES, "-" * len(DASHES))
    return F.upper(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def name_tokens(x) -> Column:
    """Distinct words of three letters or more that tell names apart, sorted."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(c(x), F.lit("")), r"[^\p{L}\p{N}]+", " ")), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))))


def category(search_name) -> Column:
    """The operating class of a folded route name; the first class that fits."""
    name, out = c(search_name), F.lit("desconocida")
    for label, must, must_not in reversed(CATEGORIES):
        fits = name.rlike(must) if must_not is None else name.rlike(must) & ~name.rlike(must_not)
        out = F.when(fits, label).otherwise(out)
    return out


def short_walk_penalty(straight_m, walk_m) -> Column:
    """Metres added to a search score when most of a short trip is walked anyway."""
    s, w = c(straight_m), c(walk_m)
    ratio = w / s
    return (
        F.when(s.isNull() | (s <= 0) | w.isNull(), 0)
        .when((s <= 1000) & (w >= 450) & (ratio > 0.85), 260)
        .when((s <= 1200) & (w >= 500) & (ratio > 0.70), 180)
        .otherwise(0)
    )


def walk_minutes(m, per_minute: float = 80.0) -> Column:
    return F.greatest(F.lit(1), F.floor(c(m) / per_minute + 0.5)).cast("int")


def fnv1a(x) -> Column:
    """FNV-1a, 32 bits, over the characters of an ASCII string."""
    codes = F.transform(F.sequence(F.lit(1), F.length(c(x))), lambda i: F.ascii(F.substring(c(x), i, F.lit(1))).cast("bigint"))
    step = lambda h, v: (h.bitwiseXOR(v) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(c(x)) > 0, F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)).otherwise(F.lit(2166136261).cast("bigint"))


def labels(*pairs: tuple[Column, str]) -> Column:
    """The labels whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))
