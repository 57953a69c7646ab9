"""Structured facts from evidence texts: money, dates, identifiers, from rows and from prose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import spans

#: Patterns of explicit money, by parser version (fixed values). Flags: ignore case, Unicode classes.
MONEY = {
    1: r"(?iU)(?<!\w)(?:USD\s*|\$\s*)(?:\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)",
    2: r"(?iU)(?<!\w)(?:USD\s*|\$\s*)(?:\d{1,3}(?:\s*,\s*\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)(?:[A-Za-z]{1,4})?(?!\w)",
    3: r"(?iU)(?<!\w)(?:USD\s*|\$\s*)(?>\d{1,3}(?:\s*,\s*\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)(?:[A-Za-z]{1,4})?(?!\w)",
}
#: Magnitudes that may follow an amount (fixed values).
MAGNITUDES = {"K": 10**3, "M": 10**6, "MM": 10**6, "B": 10**9, "BN": 10**9}
#: Patterns of explicit dates (fixed values).
ISO_DATE = r"\b(19\d{2}|20\d{2})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])\b"
US_DATE = r"\b(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(19\d{2}|20\d{2})\b"
MONTH_DATE = (
    r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+"
    r"(\d{1,2})(?:st|nd|rd|th)?[,]?\s+(19\d{2}|20\d{2})\b"
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Words in a field's name that tell its kind (fixed values).
MONEY_FIELDS = ("amount", "budget", "cost", "expenditure", "fee", "payment", "price", "spend", "total", "value")
IDENTIFIER_FIELDS = ("case", "contract", "docket", "id", "identifier", "invoice", "number", "permit", "record", "reference")
IDENTIFIER_MARKS = ("id", "identifier", "number", "reference")
DATE_FIELDS = ("date", "dated", "effective", "issued", "received", "signed")


def field_kind(name: Column) -> Column:
    """money, date or identifier, by the words in a field's name; null for any other."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    words = F.split(norm, "_")
    has = lambda some: F.arrays_overlap(words, F.array(*map(F.lit, some)))
    return (
        F.when(norm.endswith("_date") | has(DATE_FIELDS), "date")
        .when(norm.endswith("_id") | norm.endswith("_number"), "identifier")
        .when(has(MONEY_FIELDS), "money")
        .when(has(IDENTIFIER_FIELDS) & has(IDENTIFIER_MARKS), "identifier")
    )


def amount(raw: Column, version: int = 3) -> Column:
    """The decimal(38,2) that a money text states, half to even; null where it states none."""
    t = F.trim(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    bare = F.trim(F.regexp_replace(t, r"^(?i)(\$|USD)", ""))
    if version == 1:
        return F.bround(F.regexp_replace(bare, ",", "").try_cast("decimal(38,6)"), 2).cast("decimal(38,2)")
    suffix = F.upper(F.regexp_extract(bare, r"([A-Za-z]{1,4})$", 1))
    number = F.regexp_replace(F.regexp_replace(bare, r"[A-Za-z]{1,4}$", ""), r"(?U)[\s,]+", "").try_cast("decimal(28,6)")
    scale = reduce(lambda c, kv: c.when(suffix == kv[0], F.lit(kv[1]).cast("decimal(10,0)")), MAGNITUDES.items(), F.when(suffix == "", F.lit(1).cast("decimal(10,0)")))
    return F.bround((number * scale).cast("decimal(38,6)"), 2).cast("decimal(38,2)")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))


def date_of(raw: Column, whole: bool = False) -> Column:
    """The date of an explicit date text; ``whole``: the text must be nothing but the date."""
    at = lambda p: (lambda k: F.regexp_extract(raw, f"^(?:{p})$" if whole else p, k))
    iso, us, word = at(ISO_DATE), at(US_DATE), at(MONTH_DATE)
    month = reduce(lambda c, km: c.when(F.lower(F.left(word(1), F.lit(3))) == km[1], F.lit(f"{km[0]:02d}")), enumerate(_MONTHS, 1), F.when(F.lit(False), F.lit("")))
    return F.when(iso(1) != "", _date(iso(1), iso(2), iso(3))).when(us(1) != "", _date(us(3), us(1), us(2))).when(word(1) != "", _date(word(3), month, word(2)))


_FACT = "struct<fact_type:string,field_name:string,raw_text:string,normalized_text:string,numeric_value:double,unit:string,char_start:int,char_end:int>"


def _fact(kind: str, raw: Column, norm: Column, value: Column, unit: Column, field: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind), field, raw, norm, value, unit, start, end).cast(_FACT)


def prose_money(text: Column, version: int = 3) -> Column:
    none = F.lit(None)

    def fact(m: Column) -> Column:
        v = amount(m["raw"], version)
        return _fact("money", m["raw"], v.cast("string"), v.cast("double"), F.lit("USD"), none, m["char_start"], m["char_end"])

    return F.filter(F.transform(spans(text, MONEY[version]), fact), lambda f: f["normalized_text"].isNotNull())


def prose_dates(text: Column) -> Column:
    none = F.lit(None)

    def fact(m: Column) -> Column:
        return _fact("date", m["raw"], date_of(m["raw"]).cast("string"), none, none, none, m["char_start"], m["char_end"])

    every = F.flatten(F.array(*(F.transform(spans(text, p), fact) for p in (ISO_DATE, US_DATE, MONTH_DATE))))
    return F.filter(every, lambda f: f["normalized_text"].isNotNull())


def row_facts(columns: Column, version: int = 3) -> Column:
    """Facts of a row given as map of field name to value; blank values and formulas state nothing."""
    none = F.lit(None)

    def fact(e: Column) -> Column:
        name, raw = e["key"], e["value"]
        v = F.trim(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
        kind = F.when((v == "") | v.startswith("="), None).otherwise(field_kind(name))
        money, day = amount(v, version), date_of(v, whole=True)
        return (
            F.when((kind == "money") & money.isNotNull(), _fact("money", raw, money.cast("string"), money.cast("double"), F.lit("USD"), name, none, none))
            .when((kind == "date") & day.isNotNull(), _fact("date", raw, day.cast("string"), none, none, name, none, none))
            .when((kind == "identifier") & (F.length(v) <= 160), _fact("identifier", raw, F.lower(v), none, none, name, none, none))
        )

    return F.array_compact(F.transform(F.map_entries(columns), fact))


def row_columns(text: Column) -> Column:
    """The map of a spreadsheet row kept as JSON ``{"columns": {...}}``; null for any other text."""
    got = F.from_json(text, "columns map<string,string>")["columns"]
    return F.when(F.ltrim(text).startswith("{"), got)


def extracted_facts(evidence: DataFrame, text: str, version: int = 3) -> DataFrame:
    """One row per fact of each text, with its ordinal; a row's fields or a prose text's patterns, never both.

    Null and blank texts state nothing; a fact repeated in all its parts counts once.
    """
    columns = row_columns(F.col(text))
    prose = F.concat(prose_money(F.col(text), version), prose_dates(F.col(text)))
    facts = F.array_distinct(F.when(columns.isNotNull(), row_facts(columns, version)).otherwise(prose))
    keep = [c for c in evidence.columns if c != text]
    return evidence.where(F.trim(text) != "").select(*keep, F.posexplode(facts).alias("ordinal", "fact")).select(*keep, "ordinal", "fact.*")


def money_between(facts: DataFrame, least: float | None, most: float | None, limit: int) -> DataFrame:
    """The ``limit`` largest amounts in a range, ties by evidence and fact id."""
    _check(limit)
    if least is not None and most is not None and least > most:
        raise ValueError("minimum must not exceed maximum")
    rows = facts.where("fact_type = 'money' and numeric_value is not null")
    rows = rows if least is None else rows.where(F.col("numeric_value") >= least)
    rows = rows if most is None else rows.where(F.col("numeric_value") <= most)
    return rows.orderBy(F.desc("numeric_value"), "evidence_id", "fact_id").limit(limit)


def dates_between(facts: DataFrame, start: str | None, end: str | None, limit: int) -> DataFrame:
    _check(limit)
    rows = facts.where("fact_type = 'date' and normalized_text is not null")
    rows = rows if start is None else rows.where(F.col("normalized_text") >= start)
    rows = rows if end is None else rows.where(F.col("normalized_text") <= end)
    return rows.orderBy("normalized_text", "evidence_id", "fact_id").limit(limit)


def with_identifier(facts: DataFrame, value: str, limit: int) -> DataFrame:
    _check(limit)
    return facts.where((F.col("fact_type") == "identifier") & (F.col("normalized_text") == value.strip().casefold())).orderBy("evidence_id", "fact_id").limit(limit)


def _check(limit: int) -> None:
    if limit < 1:
        raise ValueError("limit must be at least 1")


def parser_delta(evidence: DataFrame, text: str, key: str, old: int, new: int) -> DataFrame:
    """(key, char_start, old_value, new_value, outcome): money found by two parser versions, by place."""
    one, two = (
        evidence.select(key, F.explode(prose_money(F.col(text), v)).alias("f")).groupBy(key, F.col("f.char_start").alias("char_start")).agg(F.max("f.normalized_text").alias(f"{n}_value"))
        for v, n in ((old, "old"), (new, "new"))
    )
    outcome = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") == F.col("new_value"), "unchanged").otherwise("changed")
    return one.join(two, [key, "char_start"], "full_outer").withColumn("outcome", outcome)
