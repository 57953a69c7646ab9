"""Linking records by explicit keys, and resolving keys by rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.ids import stable_id
from docketry.functions.text import spans

#: Patterns of explicit references (fixed values).
CASE = r"(?i)\bPC\s*-\s*(\d{4})\s*-\s*(\d{1,4})\s*-\s*([A-Z][A-Z0-9&]*)\b"
DOCKET = r"(?i)\bD\s*-\s*(\d{1,5}(?:\s*-\s*\d{1,5})?)\b"
ORDINANCE = r"(?i)\bORDINANCE(?:\s+NO\.?)?\s+(\d{1,4}\s*-\s*\d{4})\b"


def references(evidence: DataFrame, text: str) -> DataFrame:
    """(evidence_id, kind, normalized_key, raw_text, char_start, char_end): case, docket and ordinance keys."""
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    keys = {
        "planning_case": (CASE, lambda r: F.concat(F.lit("PC-"), F.regexp_extract(r, CASE, 1), F.lit("-"), F.regexp_extract(r, CASE, 2).cast("int").cast("string"), F.lit("-"), F.upper(F.regexp_extract(r, CASE, 3)))),
        "docket": (DOCKET, lambda r: F.concat(F.lit("D-"), squeezed(F.regexp_extract(r, DOCKET, 1)))),
        "ordinance": (ORDINANCE, lambda r: F.concat(F.lit("ORDINANCE-"), squeezed(F.regexp_extract(r, ORDINANCE, 1)))),
    }

    def named(kind: str, norm) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(kind).alias("kind"), norm(m["raw"]).alias("normalized_key"), m["raw"].alias("raw_text"), m["char_start"].alias("char_start"), m["char_end"].alias("char_end"))

    every = [F.transform(spans(F.col(text), p), named(k, n)) for k, (p, n) in keys.items()]
    return evidence.select("evidence_id", F.explode(F.flatten(F.array(*every))).alias("r")).select("evidence_id", "r.*")


#: Patterns of dates in running text (fixed values); a month's year may be missing.
NUMERIC_DATE = r"\b(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(\d{4}|\d{2})\b"
_MONTHS = "january february march april may june july august september october november december".split()
MONTH_DATE = r"(?i)\b(" + "|".join([*_MONTHS, *(m[:3] for m in _MONTHS)]) + r")\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b"


def date_references(evidence: DataFrame, text: str, context_date: str) -> DataFrame:
    """(evidence_id, normalized_key, raw_text, char_start, char_end, basis): dates, two-digit years being 20yy.

    A month and day without a year take the year of ``context_date`` (a date column), where it is known.
    Days that no month has are no dates. Dates alone link no records.
    """
    day = lambda y, m, d: F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))

    def numeric(m: Column) -> Column:
        g = lambda k: F.regexp_extract(m["raw"], NUMERIC_DATE, k)
        year = F.when(F.length(g(3)) == 2, F.concat(F.lit("20"), g(3))).otherwise(g(3))
        return F.struct(day(year, g(1), g(2)).cast("string").alias("normalized_key"), m["raw"].alias("raw_text"), m["char_start"].alias("char_start"), m["char_end"].alias("char_end"), F.lit("literal_date").alias("basis"))

    def worded(m: Column) -> Column:
        g = lambda k: F.regexp_extract(m["raw"], MONTH_DATE, k)
        month = F.array_position(F.array(*(F.lit(x[:3]) for x in _MONTHS)), F.lower(F.left(g(1), F.lit(3)))).cast("string")
        year = F.when(g(3) != "", g(3)).otherwise(F.date_format(context_date, "yyyy"))
        return F.struct(day(year, month, g(2)).cast("string").alias("normalized_key"), m["raw"].alias("raw_text"), m["char_start"].alias("char_start"), m["char_end"].alias("char_end"), F.when(g(3) != "", "literal_date").otherwise("context_year").alias("basis"))

    found = F.concat(F.transform(spans(F.col(text), NUMERIC_DATE), numeric), F.transform(spans(F.col(text), MONTH_DATE), worded))
    return evidence.select("evidence_id", F.explode(found).alias("r")).where("r.normalized_key is not null").select("evidence_id", "r.*")


def key_matches(found: DataFrame, kind: str, key: str, unit: str, least: int = 2) -> DataFrame:
    """(kind, key, units): keys that stand in ``least`` units or more."""
    return found.groupBy(kind, key).agg(F.count_distinct(unit).alias("units")).where(F.col("units") >= least)


@dataclass(frozen=True)
class KeyRule:
    """A component of a matter's key: its role, a regex whose first group is the value, and whether it is needed."""

    role: str
    regex: str
    required: bool = True


def resolved_keys(segments: DataFrame, text: str, key: str, rules: list[KeyRule]) -> DataFrame:
    """(key, status, reasons, matter_key): resolved where every needed component has one value; ambiguous beats insufficient.

    A component found several times with the same value is one value.
    """
    reasons, values = [], []
    for r in rules:
        found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r.regex), F.lit(1)), lambda v: F.upper(F.regexp_replace(v, r"\s+", " "))))
        values.append((r, found))
        reasons.append(F.when(F.size(found) > 1, F.lit(f"ambiguous:{r.role}")))
        if r.required:
            reasons.append(F.when(F.size(found) == 0, F.lit(f"missing:{r.role}")))
    why = F.array_compact(F.array(*reasons))
    parts = [F.concat(F.lit(f"{r.role}="), F.coalesce(F.get(v, F.lit(0)), F.lit(""))) for r, v in values]
    status = F.when(F.exists("_why", lambda x: x.startswith("ambiguous")), "ambiguous").when(F.size("_why") > 0, "insufficient").otherwise("resolved")
    out = segments.where(F.col(text).isNotNull()).select(F.col(key), why.alias("_why"), stable_id("matter", *parts).alias("_id"))
    return out.select(key, status.alias("status"), F.array_join("_why", ",").alias("reasons"), F.when(F.size("_why") == 0, F.col("_id")).alias("matter_key"))


def populations(values: DataFrame, by: list[str], value: str, unit: str) -> DataFrame:
    """Groups of two units or more with the distinct values they give."""
    groups = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count_distinct(unit).alias("units"), F.count_distinct(value).alias("values"), F.min(value).alias("least"), F.max(value).alias("most"))
    return groups.where("units >= 2")


def conflicts(groups: DataFrame) -> DataFrame:
    """Populations that give more than one value."""
    return groups.where("values >= 2")


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.lit(False), "")
    for name, holds in rules:
        out = out.when(holds, name)
    return out.otherwise(default)


def context(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The text around a span, folded: ``radius`` characters on either side."""
    lo = F.greatest(start - radius, F.lit(0))
    return F.lower(F.trim(F.regexp_replace(F.substring(text, lo + 1, end + radius - lo), r"(?U)\s+", " ")))
