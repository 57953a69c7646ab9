"""Queries that compare, link, measure and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import shingles, text_quality
from docketry.operators import changes, evaluation, evidence, layout, linkage, similarity, versions
from docketry.plans.evidence import _PREFERRED, _STEP
from docketry.plans.indexes import _SEGMENTS, _TEXTS, distinct_segments, preferred_text
from docketry.plans.registry import query
from docketry.sources.tables import table

_NEAR = f"""s AS (SELECT segment_id id, artifact_id family, regexp_extract_all(lower(normalized_text), '[a-z0-9]+') t FROM {_SEGMENTS}),
h AS (SELECT DISTINCT id, family, array_to_string(t[i:i + 2], ' ') g FROM (SELECT *, unnest(range(1, len(t) - 1)) i FROM s)),
n AS (SELECT id, family, count(*) c FROM h GROUP BY 1, 2),
r AS (SELECT g FROM h GROUP BY g HAVING count(*) BETWEEN 2 AND 64),
p AS (SELECT a.id a, b.id b FROM h a JOIN h b USING (g) JOIN r USING (g) WHERE a.id < b.id AND a.family <> b.family GROUP BY 1, 2 HAVING count(*) >= 3),
q AS (SELECT p.a, p.b, count(*) shared FROM p JOIN h x ON x.id = p.a JOIN h y ON y.id = p.b AND y.g = x.g GROUP BY 1, 2),
e AS (SELECT a, b, shared, shared / (na.c + nb.c - shared) similarity FROM q JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE shared / (na.c + nb.c - shared) >= 0.6)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    occurrences = distinct_segments(spark, d).select(F.col("segment_id").alias("id"), F.col("artifact_id").alias("family"), F.col("normalized_text").alias("text"))
    return similarity.near_duplicates(occurrences, size=3, threshold=0.6, least_shared=3, most_frequent=64)


@query(f"WITH {_NEAR} SELECT a, b, shared, round(similarity, 6) similarity FROM e")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Similar segments of different artifacts, by shared shingles that aren't too common."""
    return _near(spark, d).select("a", "b", "shared", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE {_NEAR}, d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    c(x, y) AS (SELECT a, a FROM d UNION SELECT c.x, d.b FROM c JOIN d ON c.y = d.a), m AS (SELECT x id, min(y) root FROM c GROUP BY 1)
    SELECT root, count(*) members, count(DISTINCT s.family) families FROM m JOIN s USING (id) GROUP BY 1"""
)
def recurrence_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Segments linked by similarity, directly or not."""
    groups = similarity.smallest_reachable(_near(spark, d), "a", "b")
    homes = distinct_segments(spark, d).select(F.col("segment_id").alias("id"), "artifact_id")
    return groups.join(homes, "id").groupBy("root").agg(F.count("*").alias("members"), F.count_distinct("artifact_id").alias("families"))


_FACTS = "(SELECT DISTINCT fact_id, evidence_id, fact_type, normalized_text, char_start fs, char_end fe FROM evidence_facts WHERE char_start IS NOT NULL AND char_end IS NOT NULL)"


@query(f"SELECT s.segment_id, count(DISTINCT f.fact_id) facts, count(DISTINCT f.fact_type) kinds FROM {_SEGMENTS} s JOIN {_FACTS} f USING (evidence_id) WHERE fs >= s.char_start AND fe <= s.char_end GROUP BY 1")
def segment_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that lie within each segment."""
    return _span_facts(spark, d).groupBy("segment_id").agg(F.count_distinct("fact_id").alias("facts"), F.count_distinct("fact_type").alias("kinds"))


def _span_facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "evidence_facts", "fact_id", "evidence_id", "fact_type", "normalized_text", "numeric_value", "char_start", "char_end").distinct()
    s = distinct_segments(spark, d).select("segment_id", "evidence_id", "normalized_anchor", "char_start", "char_end")
    return similarity.span_facts(s, f)


@query(
    f"""WITH v AS (SELECT s.normalized_anchor "cluster", s.segment_id occurrence, f.fact_type || ':' || f.normalized_text v FROM {_SEGMENTS} s JOIN {_FACTS} f USING (evidence_id)
      WHERE fs >= s.char_start AND fe <= s.char_end AND s.normalized_anchor IS NOT NULL AND f.normalized_text IS NOT NULL),
    n AS (SELECT "cluster", count(DISTINCT occurrence) n FROM v GROUP BY 1), e AS (SELECT "cluster", v, count(DISTINCT occurrence) o FROM v GROUP BY 1, 2)
    SELECT "cluster", v AS "value", o AS occurrences, CASE WHEN o = n THEN 'common' ELSE 'varying' END kind FROM e JOIN n USING ("cluster")"""
)
def common_vs_varying(spark: SparkSession, d: str) -> DataFrame:
    """Values that all, or only some, segments under one anchor state."""
    rows = _span_facts(spark, d).where("normalized_anchor is not null and normalized_text is not null")
    return similarity.common_and_varying(rows.select(F.col("normalized_anchor").alias("cluster"), F.col("segment_id").alias("occurrence"), F.concat_ws(":", "fact_type", "normalized_text").alias("value")))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """(pair, before, after): successive different artifacts of each source."""
    rows = table(spark, d, "source_snapshots", "snapshot_id", "source_id", "artifact_id", "retrieved_at").distinct()
    return changes.supersessions(rows).where("supersedes is not null").select(F.col("snapshot_id").alias("pair"), F.col("supersedes").alias("before"), F.col("artifact_id").alias("after"))


_PAIRS = f"pairs AS (SELECT snapshot_id pair, p before_id, artifact_id after_id FROM {_STEP} WHERE p <> artifact_id)"


@query(
    f"""WITH {_PAIRS}, t AS (SELECT u.artifact_id, u.unit_type, u.locator, p.extracted_text x FROM evidence_units u LEFT JOIN ({_PREFERRED}) p USING (evidence_id)),
    b AS (SELECT pair, unit_type, locator, x FROM pairs JOIN t ON artifact_id = before_id), a AS (SELECT pair, unit_type, locator, x FROM pairs JOIN t ON artifact_id = after_id)
    SELECT pair, unit_type, locator, CASE WHEN b.pair IS NULL THEN 'added' WHEN a.pair IS NULL THEN 'removed' WHEN b.x IS NOT DISTINCT FROM a.x THEN 'unchanged' ELSE 'changed' END outcome
    FROM b FULL JOIN a USING (pair, unit_type, locator)"""
)
def version_diff_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of successive versions side by side."""
    before, after = _version_units(spark, d)
    return versions.unit_diff(before, after, ["pair", "unit_type", "locator"]).select("pair", "unit_type", "locator", "outcome")


def _version_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "quality_score", "occurred_at", "extracted_text")
    units = evidence.preferred_evidence(table(spark, d, "evidence_units", "evidence_id", "artifact_id", "unit_type", "locator"), rows, keep_unread=True)
    texts = units.select("artifact_id", "unit_type", "locator", F.col("extracted_text").alias("text"))
    steps = _steps(spark, d)
    return tuple(steps.select("pair", F.col(c).alias("artifact_id")).join(texts, "artifact_id").drop("artifact_id") for c in ("before", "after"))


@query()
def version_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike the texts of changed units are."""
    before, after = _version_units(spark, d)
    rows = versions.unit_diff(before, after, ["pair", "unit_type", "locator"]).where("outcome = 'changed'")
    return rows.select("pair", "unit_type", "locator", versions.sequence_ratio("before_text", "after_text").alias("similarity"))


_MONEY = "m AS (SELECT DISTINCT artifact_id, fact_id, round(numeric_value, 2)::DECIMAL(18, 2) v FROM evidence_facts WHERE fact_type = 'money' AND numeric_value IS NOT NULL AND abs(numeric_value) < 1e14)"
_MULTI = f"""{_PAIRS}, {_MONEY}, b AS (SELECT pair, v, count(*) n FROM pairs JOIN m ON artifact_id = before_id GROUP BY 1, 2), a AS (SELECT pair, v, count(*) n FROM pairs JOIN m ON artifact_id = after_id GROUP BY 1, 2),
x AS (SELECT pair, v, coalesce(b.n, 0) nb, coalesce(a.n, 0) na FROM b FULL JOIN a USING (pair, v)),
diff AS (SELECT pair, v, greatest(nb - na, 0) removed, greatest(na - nb, 0) added, least(nb, na) kept FROM x)"""


def _money_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_facts", "artifact_id", "fact_id", "fact_type", "numeric_value").where("fact_type = 'money' and numeric_value is not null and abs(numeric_value) < 1e14")
    money = rows.select("artifact_id", "fact_id", F.round("numeric_value", 2).cast("decimal(18,2)").alias("v")).distinct().drop("fact_id")
    steps = _steps(spark, d)
    before, after = (steps.select("pair", F.col(c).alias("artifact_id")).join(money, "artifact_id").drop("artifact_id") for c in ("before", "after"))
    return versions.multiset_diff(before, after, ["pair"], "v")


@query(f"WITH {_MULTI} SELECT pair, v::DOUBLE v, removed, added, kept FROM diff")
def multiset_money_diff(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that went, came and stayed between successive versions, each as often as it stands there."""
    return _money_diff(spark, d).withColumn("v", F.col("v").cast("double"))


@query(
    f"""WITH {_MULTI}, o AS (SELECT pair, v "old" FROM diff WHERE removed > 0), n AS (SELECT pair, v "new" FROM diff WHERE added > 0), k AS (SELECT pair, v base FROM diff WHERE kept > 0 AND v > 0),
    c AS (SELECT *, abs("new" - "old") delta FROM o JOIN n USING (pair) JOIN k USING (pair))
    SELECT pair, "old"::DOUBLE "old", "new"::DOUBLE "new", base::DOUBLE base, (delta / base)::INTEGER multiple FROM c
    WHERE delta > 0 AND base <> "old" AND base <> "new" AND base <> delta AND delta % base = 0 AND delta / base BETWEEN 2 AND 36"""
)
def arithmetic_relations(spark: SparkSession, d: str) -> DataFrame:
    """Changes of an amount by a whole multiple of one that stayed."""
    rel = versions.arithmetic_relations(_money_diff(spark, d), ["pair"], "v")
    return rel.select("pair", *(F.col(c).cast("double").alias(c) for c in ("old", "new", "base")), "multiple")


_ORD = r"(?i)\bORDINANCE(?:\s+NO\.?)?\s+(\d{1,4}\s*-\s*\d{4})\b"
_REFS = f"""r AS (SELECT evidence_id, 'ORDINANCE-' || regexp_replace(unnest(regexp_extract_all(extracted_text, '{_ORD}', 1)), '\\s+', '', 'g') k FROM {_TEXTS})"""


@query(f"WITH {_REFS} SELECT evidence_id, k AS normalized_key, count(*) n FROM r GROUP BY 1, 2")
def explicit_references(spark: SparkSession, d: str) -> DataFrame:
    """Ordinances that units name."""
    found = linkage.references(preferred_text(spark, d), "extracted_text").where("kind = 'ordinance'")
    return found.groupBy("evidence_id", "normalized_key").agg(F.count("*").alias("n"))


@query(f"WITH {_REFS} SELECT 'ordinance' kind, k AS normalized_key, count(DISTINCT evidence_id) units FROM r GROUP BY 2 HAVING count(DISTINCT evidence_id) >= 2")
def reference_matches(spark: SparkSession, d: str) -> DataFrame:
    """Units linked by naming the same ordinance."""
    found = linkage.references(preferred_text(spark, d), "extracted_text").where("kind = 'ordinance'")
    return linkage.key_matches(found, "kind", "normalized_key", "evidence_id")


#: Components of a segment's key: its contract number, and its request for proposals if it names one.
KEY_RULES = [linkage.KeyRule("contract", r"\b(C-\d+/\d{2})\b"), linkage.KeyRule("request", r"\b(RFP \d{2}-\d+)\b", required=False)]


@query(
    """WITH s AS (SELECT DISTINCT segment_id, raw_text FROM evidence_segments WHERE raw_text IS NOT NULL),
    k AS (SELECT segment_id, list_distinct(regexp_extract_all(raw_text, '\\b(C-\\d+/\\d{2})\\b', 1)) c, list_distinct(regexp_extract_all(raw_text, '\\b(RFP \\d{2}-\\d+)\\b', 1)) r FROM s)
    SELECT segment_id, CASE WHEN len(c) > 1 OR len(r) > 1 THEN 'ambiguous' WHEN len(c) = 0 THEN 'insufficient' ELSE 'resolved' END status,
    concat_ws(',', CASE WHEN len(c) > 1 THEN 'ambiguous:contract' END, CASE WHEN len(c) = 0 THEN 'missing:contract' END, CASE WHEN len(r) > 1 THEN 'ambiguous:request' END) reasons,
    CASE WHEN len(c) = 1 AND len(r) <= 1 THEN 'matter:' || sha256('contract=' || c[1] || chr(31) || 'request=' || coalesce(r[1], '')) END matter_key FROM k"""
)
def matter_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of each segment, where its components are unambiguous."""
    return linkage.resolved_keys(table(spark, d, "evidence_segments", "segment_id", "raw_text").distinct(), "raw_text", "segment_id", KEY_RULES)


_POP = f"""v AS (SELECT DISTINCT s.normalized_anchor, s.evidence_id, f.fact_type, f.normalized_text FROM {_SEGMENTS} s JOIN {_FACTS} f USING (evidence_id)
  WHERE fs >= s.char_start AND fe <= s.char_end AND s.normalized_anchor IS NOT NULL AND f.fact_type = 'identifier'),
g AS (SELECT normalized_anchor, fact_type, count(DISTINCT evidence_id) units, count(DISTINCT normalized_text) "values", min(normalized_text) least, max(normalized_text) most
  FROM v WHERE normalized_text IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT evidence_id) >= 2)"""


def _populations(spark: SparkSession, d: str) -> DataFrame:
    rows = _span_facts(spark, d).where("normalized_anchor is not null and fact_type = 'identifier'")
    return linkage.populations(rows, ["normalized_anchor", "fact_type"], "normalized_text", "evidence_id")


@query(f'WITH {_POP} SELECT * FROM g')
def comparison_populations(spark: SparkSession, d: str) -> DataFrame:
    """Units that treat the same matter, with the identifiers they give."""
    return _populations(spark, d)


@query(f'WITH {_POP} SELECT normalized_anchor, fact_type, units, "values" FROM g WHERE "values" >= 2')
def value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return linkage.conflicts(_populations(spark, d)).select("normalized_anchor", "fact_type", "units", "values")


@query(
    r"""WITH p AS (SELECT doc_id, lower(regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '[À-ɏ]', '_', 'g'), '\b(?:[A-Z][A-Za-z0-9&''’.-]{2,})(?:\s+(?:[A-Z][A-Za-z0-9&''’.-]{2,})){1,3}\b')), '\s+', ' ', 'g')) phrase FROM documents)
    SELECT phrase, count(DISTINCT doc_id) docs FROM p WHERE length(phrase) >= 7 GROUP BY 1"""
)
def benchmark_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised phrases of the documents."""
    return evaluation.phrases(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


@query(
    rf"""WITH s AS (SELECT extraction_id, regexp_replace(regexp_replace(coalesce(extracted_text, ''), '^{_WHITE}', ''), '{_WHITE}$', '') t FROM evidence_extractions),
    k AS (SELECT extraction_id, length(t)::DOUBLE n, length(regexp_replace(t, '[^\p{{C}}\p{{Z}}]', '', 'g')) - length(regexp_replace(t, '[^ \n\r\t]', '', 'g')) hidden,
      length(regexp_replace(t, '[^\p{{L}}\p{{N}}\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]', '', 'g')) solid, length(t) - length(replace(t, chr(65533), '')) broken FROM s)
    SELECT extraction_id, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.55 * (n - hidden) / n + 0.30 * least(1.0, solid / n / 0.55) + 0.15 * least(1.0, n / 80) - least(0.5, 4 * broken / n))), 4) END::DOUBLE quality
    FROM k"""
)
def reading_quality(spark: SparkSession, d: str) -> DataFrame:
    """The computed quality of every reading's text."""
    return table(spark, d, "evidence_extractions", "extraction_id", "extracted_text").select("extraction_id", text_quality("extracted_text").alias("quality"))


@query(
    """WITH s AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(t) tokens, CASE WHEN len(t) >= 5 THEN len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')))) ELSE 0 END shingles FROM s"""
)
def document_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and distinct runs of five tokens of each document."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return rows.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).cast("long").alias("tokens"), F.size(shingles("text", 5)).cast("long").alias("shingles"))


_REGIONS = """g AS (SELECT label page, vec_id region, round(least(embedding[1], embedding[3])::DOUBLE * 100, 2) x0, round(least(embedding[2], embedding[4])::DOUBLE * 100, 2) y0,
  round(greatest(embedding[1], embedding[3])::DOUBLE * 100, 2) x1, round(greatest(embedding[2], embedding[4])::DOUBLE * 100, 2) y1 FROM embeddings),
c AS (SELECT page, s.region s_region, t.region t_region, round((t.x0 + t.x1) / 2 - (s.x0 + s.x1) / 2, 3) dx, round((t.y0 + t.y1) / 2 - (s.y0 + s.y1) / 2, 3) dy FROM g s JOIN g t USING (page) WHERE s.region <> t.region),
d AS (SELECT *, round(sqrt(dx * dx + dy * dy), 3) distance FROM c)"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on pages, from the first four coordinates of vectors; a label is a page."""
    e = F.col("embedding")
    box = lambda f, i, j: F.round(f(e[i].cast("double"), e[j].cast("double")) * 100, 2)
    return table(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("label").alias("page"), F.col("vec_id").alias("region"), box(F.least, 0, 2).alias("x0"), box(F.least, 1, 3).alias("y0"), box(F.greatest, 0, 2).alias("x1"), box(F.greatest, 1, 3).alias("y1"))


@query(
    f"""WITH {_REGIONS} SELECT page, CASE WHEN dx = 0 AND dy = 0 THEN 'overlap' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN dy > 0 THEN 'below' ELSE 'above' END direction,
    count(*) n, round(min(distance), 2) nearest, round(max(distance), 2) farthest FROM d GROUP BY 1, 2"""
)
def layout_relations(spark: SparkSession, d: str) -> DataFrame:
    """Where the regions of each page lie to each other."""
    return layout.relations(_regions(spark, d)).groupBy("page", "direction").agg(F.count("*").alias("n"), F.round(F.min("distance"), 2).alias("nearest"), F.round(F.max("distance"), 2).alias("farthest"))


@query(f"WITH {_REGIONS} SELECT page, s_region, arg_min(t_region, (distance, t_region)) t_region FROM d GROUP BY 1, 2")
def nearest_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return layout.nearest(_regions(spark, d)).select("page", "s_region", "t_region")


@query(
    f"""WITH RECURSIVE {_REGIONS}, b AS (SELECT page, s_region, arg_min(t_region, (distance, t_region)) t_region FROM d GROUP BY 1, 2),
    u AS (SELECT page, s_region x, t_region y FROM b UNION SELECT page, t_region, s_region FROM b),
    r(page, x, y) AS (SELECT page, x, x FROM u UNION SELECT r.page, r.x, u.y FROM r JOIN u ON r.page = u.page AND r.y = u.x), m AS (SELECT page, x, min(y) root FROM r GROUP BY 1, 2)
    SELECT page, root, count(*) regions FROM m GROUP BY 1, 2"""
)
def layout_components(spark: SparkSession, d: str) -> DataFrame:
    """Regions grouped by nearest neighbours."""
    groups = similarity.smallest_reachable(layout.edges_of(layout.nearest(_regions(spark, d))), "a", "b")
    return groups.groupBy("root").agg(F.count("*").alias("regions")).select(F.split("root", r"\|")[0].cast("int").alias("page"), F.split("root", r"\|")[1].cast("long").alias("root"), "regions")
