"""Text functions as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(text: Column | str) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " ")))


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-case text, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[a-z0-9]+"), F.lit(0))


def shingles(text: Column | str, size: int) -> Column:
    """The set of runs of ``size`` tokens, each joined by blanks; empty for shorter texts."""
    def runs(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, size), " "))
        return F.when(F.size(t) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    # bound to a lambda's variable, the tokens are found once, not once for each run
    return F.get(F.transform(F.array(tokens(text)), runs), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def _plain_letters() -> tuple[str, str]:
    """Letters with diacritics below U+0250 and the base letters they decompose to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and not chr(c).isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(text: Column | str) -> Column:
    return F.translate(_col(text), *_plain_letters())


def index_terms(text: Column | str) -> Column:
    """Terms of the lexical index: runs of letters and digits, lower case, without diacritics."""
    return F.regexp_extract_all(F.lower(unaccented(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def excerpt(text: Column | str, limit: int = 700) -> Column:
    flat = F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


def slug(text: Column | str, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def text_quality(text: Column | str) -> Column:
    """Share of printable, of alphanumeric or blank characters, and length, less replacement characters; 0 to 1.

    Of the text without the white space around it; 0 for a blank text, also for null.
    """
    white = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
    t = F.regexp_replace(_col(text), rf"^{white}|{white}$", "")
    n = F.length(t).cast("double")
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    printable = count(r"[^\P{C}\n\r\t]|[\p{Z}&&[^ ]]") / n
    solid = count(r"[^\p{L}\p{N}\s\x{1c}-\x{1f}\x{85}\p{Z}]") / n
    broken = (n - F.length(F.replace(t, F.lit("�"), F.lit("")))) / n
    score = 0.55 * printable + 0.30 * F.least(F.lit(1.0), solid / 0.55) + 0.15 * F.least(F.lit(1.0), n / 80) - F.least(F.lit(0.5), 4 * broken)
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)).otherwise(F.lit(0.0))


def spans(text: Column | str, pattern: str) -> Column:
    """Array of (raw, char_start, char_end) of all matches, places counted in code points from 0.

    The text is cut at markers set around each match, and the places are summed lengths. Markers already
    in the text are blanked first, which keeps all places.
    """
    mark = "\u0001"
    clean = F.translate(_col(text), mark, " ")
    parts = F.split(F.regexp_replace(clean, pattern, f"{mark}$0{mark}"), mark)
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<raw:string,char_start:int,char_end:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x)).alias("at"),
            (s["k"] + 1).alias("k"),
            F.when(s["k"] % 2 == 1, F.concat(s["out"], F.array(F.struct(x.alias("raw"), s["at"].alias("char_start"), (s["at"] + F.length(x)).alias("char_end"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return walk
