"""Queries over facts, the lexical index and segments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import evidence, facts, search, segments
from docketry.plans.evidence import _PREFERRED
from docketry.plans.registry import query
from docketry.session import cut, ensure_checkpoint_dir, exists
from docketry.sources.tables import table


def _facts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "evidence_facts", "fact_id", "evidence_id", "artifact_id", "fact_type", "normalized_text", "numeric_value", *more)


def preferred_text(spark: SparkSession, d: str) -> DataFrame:
    """Preferred readings of all units that aren't blank."""
    rows = table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "quality_score", "occurred_at", "extracted_text")
    return evidence.preferred_extractions(rows).where(F.trim("extracted_text") != "").select("evidence_id", "extracted_text")


_TEXTS = f"(SELECT evidence_id, extracted_text FROM ({_PREFERRED}) WHERE trim(extracted_text) <> '')"


@query(
    """WITH f AS (SELECT DISTINCT fact_id, evidence_id, artifact_id, numeric_value FROM evidence_facts WHERE fact_type = 'money' AND numeric_value BETWEEN 300000 AND 5000000
      ORDER BY numeric_value DESC, evidence_id, fact_id LIMIT 100),
    s AS (SELECT artifact_id, min(source_uri) source_uri, count(DISTINCT source_id) n_sources FROM source_snapshots JOIN sources USING (source_id) GROUP BY 1)
    SELECT f.fact_id, f.evidence_id, f.numeric_value, s.source_uri, coalesce(s.n_sources, 0) n_sources FROM f LEFT JOIN s USING (artifact_id)"""
)
def amounts_range(spark: SparkSession, d: str) -> DataFrame:
    """The hundred largest amounts of a range, with where they come from.

    The hundred largest different values bound the rows that can be among them, so copies are only removed from
    these, and only the artifacts of the hundred are traced.
    """
    rows = _facts(spark, d).where("fact_type = 'money' and numeric_value between 300000 and 5000000").select("fact_id", "evidence_id", "artifact_id", "fact_type", "numeric_value")
    least = rows.select("numeric_value").distinct().orderBy(F.desc("numeric_value")).limit(100).agg(F.min("numeric_value")).first()[0]
    rows = rows.where(F.col("numeric_value") >= F.lit(300000.0 if least is None else least)).distinct()
    top = F.broadcast(cut(facts.money_between(rows, 300000.0, 5000000.0, 100)))  # a hundred rows
    seen = table(spark, d, "source_snapshots", "artifact_id", "source_id").join(top.select("artifact_id").distinct(), "artifact_id", "left_semi")
    origin = evidence.provenance(seen, table(spark, d, "sources")).groupBy("artifact_id").agg(F.min("source_uri").alias("source_uri"), F.count_distinct("source_id").alias("n_sources"))
    return top.join(origin, "artifact_id", "left").select("fact_id", "evidence_id", "numeric_value", "source_uri", F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"))


@query(
    r"""WITH f AS (SELECT DISTINCT fact_id, evidence_id, coalesce(normalized_text, (CASE WHEN regexp_matches(raw_text, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(raw_text AS DATE)
      WHEN regexp_matches(raw_text, '^\d{2}/\d{2}/\d{4}$') THEN try_strptime(raw_text, '%m/%d/%Y')::DATE
      WHEN regexp_matches(raw_text, '^[A-Z][a-z]+ \d{1,2}, \d{4}$') THEN coalesce(try_strptime(raw_text, '%B %d, %Y'), try_strptime(raw_text, '%b %d, %Y'))::DATE END)::VARCHAR) normalized_text
      FROM evidence_facts WHERE fact_type = 'date')
    SELECT fact_id, evidence_id, normalized_text FROM f WHERE normalized_text BETWEEN '2020-01-01' AND '2020-12-31' ORDER BY normalized_text, evidence_id, fact_id LIMIT 200"""
)
def dates_range(spark: SparkSession, d: str) -> DataFrame:
    day = F.coalesce("normalized_text", facts.date_of(F.col("raw_text"), whole=True).cast("string"))
    rows = _facts(spark, d, "raw_text").where("fact_type = 'date'").select("fact_id", "evidence_id", "fact_type", day.alias("normalized_text")).distinct()
    return facts.dates_between(rows, "2020-01-01", "2020-12-31", 200).select("fact_id", "evidence_id", "normalized_text")


@query(
    """WITH v AS (SELECT normalized_text, count(DISTINCT evidence_id) units, count(DISTINCT artifact_id) artifacts FROM evidence_facts
    WHERE fact_type = 'identifier' AND normalized_text IS NOT NULL GROUP BY 1) SELECT * FROM v WHERE units > 1"""
)
def repeated_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that stand in several units."""
    rows = _facts(spark, d).where("fact_type = 'identifier' and normalized_text is not null")
    return rows.groupBy("normalized_text").agg(F.count_distinct("evidence_id").alias("units"), F.count_distinct("artifact_id").alias("artifacts")).where("units > 1")


@query("SELECT DISTINCT fact_id, evidence_id FROM evidence_facts WHERE fact_type = 'identifier' AND normalized_text = 'c-63223/18' ORDER BY evidence_id, fact_id LIMIT 50")
def identifier_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = _facts(spark, d).select("fact_id", "evidence_id", "fact_type", "normalized_text").distinct()
    return facts.with_identifier(rows, " C-63223/18 ", 50).select("fact_id", "evidence_id")


@query("SELECT fact_type, count(*) n, count(DISTINCT fact_id) distinct_facts, count(numeric_value) with_value FROM evidence_facts GROUP BY 1")
def fact_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("fact_type").agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("distinct_facts"), F.count("numeric_value").alias("with_value"))


_MONEY_V1 = r"(?i)(?:^|[^\w])((?:USD\s*|\$\s*)(?:\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?))"


@query(
    f"""WITH m AS (SELECT evidence_id, unnest(regexp_extract_all(extracted_text, '{_MONEY_V1}', 1)) raw FROM {_TEXTS} WHERE NOT starts_with(ltrim(extracted_text), '{{'))
    SELECT evidence_id, count(*) n, sum(regexp_replace(raw, '(?i)[$,\\s]|USD', '', 'g')::DECIMAL(18, 2))::DOUBLE total FROM m GROUP BY 1"""
)
def prose_money_v1(spark: SparkSession, d: str) -> DataFrame:
    """Explicit money in prose, first parser: how many amounts a unit states, and their sum."""
    rows = preferred_text(spark, d).where(~F.ltrim("extracted_text").startswith("{"))
    one = rows.select("evidence_id", F.explode(facts.prose_money(F.col("extracted_text"), 1)).alias("f"))
    return one.groupBy("evidence_id").agg(F.count("*").alias("n"), F.sum(F.col("f.normalized_text").cast("decimal(18,2)")).cast("double").alias("total"))


_ISO = r"\b(?:19\d{2}|20\d{2})[-/](?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12]\d|3[01])\b"
_US = r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:19\d{2}|20\d{2})\b"


@query(
    f"""WITH x AS (SELECT * FROM {_TEXTS} WHERE NOT starts_with(ltrim(extracted_text), '{{')),
    m AS (SELECT evidence_id, try_cast(replace(unnest(regexp_extract_all(extracted_text, '{_ISO}')), '/', '-') AS DATE) v FROM x
      UNION ALL SELECT evidence_id, try_cast(split_part(u, '/', 3) || '-' || lpad(split_part(u, '/', 1), 2, '0') || '-' || lpad(split_part(u, '/', 2), 2, '0') AS DATE)
      FROM (SELECT evidence_id, unnest(regexp_extract_all(extracted_text, '{_US}')) u FROM x))
    SELECT evidence_id, count(*) n, min(v)::VARCHAR first_date, max(v)::VARCHAR last_date FROM m WHERE v IS NOT NULL GROUP BY 1"""
)
def prose_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in figures in prose."""
    rows = preferred_text(spark, d).where(~F.ltrim("extracted_text").startswith("{"))
    one = rows.select("evidence_id", F.explode(facts.prose_dates(F.col("extracted_text"))).alias("f")).where(F.col("f.raw_text").rlike(r"^\d"))
    day = F.col("f.normalized_text")
    return one.groupBy("evidence_id").agg(F.count("*").alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@query()
def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """All facts of all preferred readings, from rows and from prose, with their places."""
    return facts.extracted_facts(preferred_text(spark, d), "extracted_text")


@query()
def parser_delta(spark: SparkSession, d: str) -> DataFrame:
    """What the third money parser reads otherwise than the first."""
    delta = facts.parser_delta(preferred_text(spark, d), "extracted_text", "evidence_id", 1, 3)
    return delta.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("evidence_id").alias("units"))


@query(
    f"""WITH r AS (SELECT evidence_id, unnest(json_keys(extracted_text, '$.columns')) k, extracted_text t FROM {_TEXTS}
      WHERE starts_with(ltrim(extracted_text), '{{') AND json_valid(extracted_text))
    SELECT k AS field, count(*) n, count(DISTINCT evidence_id) units FROM r GROUP BY 1"""
)
def row_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of spreadsheet rows."""
    rows = preferred_text(spark, d).select("evidence_id", F.explode(facts.row_columns(F.col("extracted_text"))).alias("field", "value"))
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("evidence_id").alias("units"))


_INDEX = f"""x AS (SELECT evidence_id id, regexp_extract_all(lower(strip_accents(extracted_text)), '[\\p{{L}}\\p{{N}}]+') terms FROM {_TEXTS}),
sizes AS (SELECT id, len(terms) dl FROM x), totals AS (SELECT count(*) n, avg(dl) a FROM sizes),
posts AS (SELECT term, id, count(*) tf FROM (SELECT id, unnest(terms) term FROM x) GROUP BY 1, 2)"""


def _bm25(terms: list[str], k: int) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH {_INDEX}, h AS (SELECT * FROM posts WHERE term IN ({wanted})),
    w AS (SELECT term, greatest(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)), 0) raw FROM h, totals GROUP BY 1),
    s AS (SELECT h.id, count(*) c, sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) s
      FROM h JOIN w USING (term) JOIN sizes USING (id), totals GROUP BY 1)
    SELECT id AS evidence_id, round(-s, 6) score FROM s WHERE c = {len(terms)} ORDER BY -s, id LIMIT {k}"""


_stored: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, d: str) -> search.LexicalIndex:
    """The lexical index of the tables below ``d``: built and stored once in a session, in the shared checkpoint folder, read from there after."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    path = _stored.get((folder, d))
    if path is None or not exists(spark, f"{path}/totals/_SUCCESS"):
        path = f"{folder}/lexical-{uuid.uuid4().hex}"
        search.build(preferred_text(spark, d), "evidence_id", "extracted_text").save(path)
        _stored[folder, d] = path
    return search.LexicalIndex.load(spark, path)


def _search(spark: SparkSession, d: str, text: str, k: int) -> DataFrame:
    return search.search(index(spark, d), text, k).select(F.col("id").alias("evidence_id"), F.round("score", 6).alias("score"))


@query(_bm25(["storm", "water", "storage"], 20))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Best units that hold every term."""
    return _search(spark, d, "Storm water storage", 20)


@query(_bm25(["limestone", "appraisal"], 20))
def bm25_search_rare(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "limestone appraisal", 20)


@query(f"WITH {_INDEX} SELECT term, count(*) df, sum(tf)::BIGINT cf FROM posts GROUP BY 1")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return search.document_frequencies(index(spark, d))


#: Items of agendas and legislation start a line with their kind and number.
RULES = [
    segments.Rule("legislation", ".*", r"(?im)^((?:Ordinance|Resolution|Ord\.|Res\.)(?: No\.)? \d+[-/]\d{4})[ \t]*$", "legislation", 25),
    segments.Rule("agenda-item", ".*", r"(?im)^(Item(?: No\.)? \d+(?:[-/]\d{4}| of \d{4}))[ \t]*$", "agenda_item", 25),
]


@query()
def cut_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of all preferred readings, with spans, hashes and identifiers."""
    names = evidence.provenance(table(spark, d, "source_snapshots"), table(spark, d, "sources")).groupBy("artifact_id").agg(F.array_sort(F.collect_set(F.coalesce("source_name", F.lit("")))).alias("source_names"))
    units = table(spark, d, "evidence_units", "evidence_id", "artifact_id").join(names, "artifact_id")
    return segments.cut_segments(preferred_text(spark, d).join(units, "evidence_id").select("evidence_id", "extracted_text", "source_names"), "extracted_text", RULES)


@query(
    f"""SELECT evidence_id, len(regexp_extract_all(extracted_text, '(?im)^((?:Ordinance|Resolution|Ord\\.|Res\\.)(?: No\\.)? \\d+[-/]\\d{{4}})[ \\t]*$')) anchors
    FROM {_TEXTS} WHERE regexp_matches(extracted_text, '(?im)^((?:Ordinance|Resolution|Ord\\.|Res\\.)(?: No\\.)? \\d+[-/]\\d{{4}})[ \\t]*$')"""
)
def segment_anchors(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces of legislation each unit holds."""
    from docketry.functions.text import spans

    found = preferred_text(spark, d).select("evidence_id", F.size(spans("extracted_text", RULES[0].anchor_regex)).cast("long").alias("anchors"))
    return found.where("anchors > 0")


_SEGMENTS = "(SELECT DISTINCT segment_id, evidence_id, artifact_id, segment_type, normalized_anchor, normalized_text, text_sha256, locator, char_start, char_end FROM evidence_segments)"


def distinct_segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_segments", "segment_id", "evidence_id", "artifact_id", "segment_type", "normalized_anchor", "normalized_text", "text_sha256", "locator", "char_start", "char_end").distinct()


@query(
    f"""SELECT segment_type, text_sha256, min(normalized_text) "text", count(DISTINCT segment_id) occurrences, count(DISTINCT artifact_id) artifacts
    FROM {_SEGMENTS} GROUP BY 1, 2 HAVING count(DISTINCT artifact_id) >= 2"""
)
def repeated_segments(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand word for word in several artifacts."""
    return segments.exact_repeats(distinct_segments(spark, d), 2)


@query(
    f"""SELECT segment_id, evidence_id, char_start FROM {_SEGMENTS} WHERE normalized_anchor = 'item no. 845-2024' ORDER BY artifact_id, locator, char_start, segment_id LIMIT 20"""
)
def segment_anchor(spark: SparkSession, d: str) -> DataFrame:
    return segments.with_anchor(distinct_segments(spark, d), "  ITEM No.\t845-2024 ", 20).select("segment_id", "evidence_id", "char_start")


@query(
    f"""SELECT segment_type, count(*) n, round(avg(length(normalized_text)), 4) mean_chars, count(DISTINCT normalized_anchor) anchors FROM {_SEGMENTS} GROUP BY 1"""
)
def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = distinct_segments(spark, d)
    return rows.groupBy("segment_type").agg(F.count("*").alias("n"), F.round(F.avg(F.length("normalized_text")), 4).alias("mean_chars"), F.count_distinct("normalized_anchor").alias("anchors"))


_MARK = "string_split(regexp_replace(replace(extracted_text, chr(1), ' '), '{p}', chr(1) || '\\0', 'g'), chr(1))"
_CUT_RULES = [(r.name, r.segment_type, r.anchor_regex, r.min_chars) for r in RULES]
_STRIP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_ONE = " UNION ALL ".join(
    f"SELECT evidence_id, '{n}' rule_name, {m} least, regexp_extract(p, '{a}', 1) anchor, regexp_replace(regexp_replace(p, '^{_STRIP}', ''), '{_STRIP}$', '') raw FROM (SELECT evidence_id, unnest({_MARK.replace('{p}', a)}[2:]) p FROM tx)" for n, _, a, m in _CUT_RULES
)


@query(
    f"""WITH tx AS (SELECT t.* FROM {_TEXTS} t JOIN evidence_units u USING (evidence_id) WHERE u.artifact_id IN (SELECT artifact_id FROM source_snapshots JOIN sources USING (source_id))), c AS ({_ONE}),
    n AS (SELECT *, lower(trim(regexp_replace(raw, '{_STRIP}', ' ', 'g'))) norm FROM c) SELECT evidence_id, rule_name, lower(trim(regexp_replace(anchor, '{_STRIP}', ' ', 'g'))) normalized_anchor, sha256(norm) text_sha256, count(*) n FROM n WHERE length(norm) >= least GROUP BY ALL"""
)
def segment_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is cut from each unit: the text of every segment by its hash."""
    return cut_segments(spark, d).groupBy("evidence_id", "rule_name", "normalized_anchor", "text_sha256").agg(F.count("*").alias("n"))


_MONTH = r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{1,2})(?:st|nd|rd|th)?[,]?\s+(19\d{2}|20\d{2})\b"


@query(
    rf"""WITH x AS (SELECT * FROM {_TEXTS} WHERE NOT starts_with(ltrim(extracted_text), '{{')), m AS (SELECT evidence_id, unnest(regexp_extract_all(extracted_text, '{_MONTH}')) r FROM x),
    v AS (SELECT evidence_id, try_cast(regexp_extract(r, '(\d{{4}})$', 1) || '-' || lpad((list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(substr(r, 1, 3))))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(r, '\s(\d{{1,2}})', 1), 2, '0') AS DATE) d FROM m)
    SELECT evidence_id, count(*) n, min(d)::VARCHAR first_date, max(d)::VARCHAR last_date FROM v WHERE d IS NOT NULL GROUP BY 1"""
)
def prose_month_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates with the month's name in prose."""
    rows = preferred_text(spark, d).where(~F.ltrim("extracted_text").startswith("{"))
    one = rows.select("evidence_id", F.explode(facts.prose_dates(F.col("extracted_text"))).alias("f")).where(~F.col("f.raw_text").rlike(r"^\d"))
    day = F.col("f.normalized_text")
    return one.groupBy("evidence_id").agg(F.count("*").alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


_MONEY_V2 = r"(?i)(?:^|[^\w])((?:USD\s*|\$\s*)(?:\d{1,3}(?:\s*,\s*\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)(?:[A-Za-z]{1,4})?)(?:$|[^\w])"


@query(
    rf"""WITH m AS (SELECT evidence_id, unnest(regexp_extract_all(extracted_text, '{_MONEY_V2}', 1)) raw FROM {_TEXTS} WHERE NOT starts_with(ltrim(extracted_text), '{{')),
    k AS (SELECT evidence_id, upper(regexp_extract(regexp_replace(raw, '(?i)^USD', ''), '([A-Za-z]{{1,4}})$', 1)) s, try_cast(regexp_replace(raw, '(?i)USD|[$,\s]|[A-Za-z]+$', '', 'g') AS DECIMAL(28, 6)) v FROM m),
    w AS (SELECT evidence_id, CASE s WHEN '' THEN 1 WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'MM' THEN 1000000 WHEN 'B' THEN 1000000000 WHEN 'BN' THEN 1000000000 END f, v FROM k)
    SELECT evidence_id, count(*) n, round(sum(v::DOUBLE * f), 2) total FROM w WHERE f IS NOT NULL AND v IS NOT NULL GROUP BY 1"""
)
def prose_money_v2(spark: SparkSession, d: str) -> DataFrame:
    """Explicit money in prose, second parser: magnitudes read, spaced thousands joined."""
    rows = preferred_text(spark, d).where(~F.ltrim("extracted_text").startswith("{"))
    one = rows.select("evidence_id", F.explode(facts.prose_money(F.col("extracted_text"), 2)).alias("f"))
    return one.groupBy("evidence_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("f.numeric_value")), 2).alias("total"))


_KIND = """CASE WHEN suffix(nm, '_date') OR list_has_any(string_split(nm, '_'), ['date', 'dated', 'effective', 'issued', 'received', 'signed']) THEN 'date' WHEN suffix(nm, '_id') OR suffix(nm, '_number') THEN 'identifier'
  WHEN list_has_any(string_split(nm, '_'), ['amount', 'budget', 'cost', 'expenditure', 'fee', 'payment', 'price', 'spend', 'total', 'value']) THEN 'money'
  WHEN list_has_any(string_split(nm, '_'), ['case', 'contract', 'docket', 'id', 'identifier', 'invoice', 'number', 'permit', 'record', 'reference']) AND list_has_any(string_split(nm, '_'), ['id', 'identifier', 'number', 'reference']) THEN 'identifier' END"""


@query(
    f"""WITH r AS (SELECT evidence_id, unnest(json_keys(extracted_text, '$.columns')) k, extracted_text t FROM {_TEXTS} WHERE starts_with(ltrim(extracted_text), '{{') AND json_valid(extracted_text)),
    v AS (SELECT evidence_id, k, trim(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '_') nm, regexp_replace(regexp_replace(json_extract_string(t, '$.columns."' || k || '"'), '^{_STRIP}', ''), '{_STRIP}$', '') val FROM r)
    SELECT DISTINCT evidence_id, k field_name, lower(val) normalized_text FROM v WHERE val <> '' AND NOT starts_with(val, '=') AND length(val) <= 160 AND {_KIND} = 'identifier'"""
)
def row_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that spreadsheet rows state in fields of that kind."""
    rows = preferred_text(spark, d).withColumn("columns", facts.row_columns(F.col("extracted_text"))).where("columns is not null")
    found = rows.select("evidence_id", F.explode(facts.row_facts(F.col("columns"))).alias("f")).select("evidence_id", "f.*")
    return found.where("fact_type = 'identifier'").select("evidence_id", "field_name", "normalized_text").distinct()


@query(
    rf"""WITH t AS (SELECT evidence_id, string_split(regexp_replace(replace(extracted_text, chr(1), ' '), '(?i)(^|[^\w])((?:USD\s*|\$\s*)(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d{{1,2}})?|\d+(?:\.\d{{1,2}})?))', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) p FROM {_TEXTS}),
    h AS (SELECT evidence_id, p, unnest(range(1, (len(p) - 1) // 2 + 1)) i FROM t), a AS (SELECT evidence_id, list_sum(list_transform(p[1:2 * i - 1], lambda x: length(x)))::INTEGER s, p[2 * i] raw FROM h)
    SELECT DISTINCT f.fact_id, f.evidence_id, try_cast(regexp_replace(raw, '(?i)USD|[$,\s]', '', 'g') AS DECIMAL(18, 2))::VARCHAR found FROM a JOIN evidence_facts f ON f.evidence_id = a.evidence_id AND f.char_start = s AND f.char_end = s + length(raw) WHERE f.fact_type = 'money'"""
)
def anchored_money_v1(spark: SparkSession, d: str) -> DataFrame:
    """Recorded amounts whose span is that of an amount that the first parser finds."""
    found = preferred_text(spark, d).select("evidence_id", F.explode(facts.prose_money(F.col("extracted_text"), 1)).alias("m")).select("evidence_id", F.col("m.char_start").alias("char_start"), F.col("m.char_end").alias("char_end"), F.col("m.normalized_text").alias("found"))
    f = table(spark, d, "evidence_facts", "fact_id", "evidence_id", "fact_type", "char_start", "char_end").where("fact_type = 'money'").drop("fact_type").distinct()
    return f.join(found, ["evidence_id", "char_start", "char_end"]).select("fact_id", "evidence_id", "found").distinct()
