"""Queries over readings, units, artifacts, snapshots and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import ids
from docketry.operators import changes, evidence, similarity
from docketry.plans.registry import query
from docketry.sources import links
from docketry.sources.tables import table

_PREFERRED = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY coalesce(quality_score, -1) DESC,
  occurred_at DESC NULLS LAST, extraction_id DESC) rn FROM evidence_extractions) WHERE rn = 1"""


@query(f"SELECT evidence_id, extraction_id, quality_score, occurred_at FROM ({_PREFERRED})")
def preferred_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Quality before recency."""
    return evidence.preferred_extractions(table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "quality_score", "occurred_at"))


@query(
    """SELECT evidence_id, extraction_id, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id
    ORDER BY occurred_at DESC NULLS LAST, extraction_id DESC) rn FROM evidence_extractions) WHERE rn = 1"""
)
def latest_extraction(spark: SparkSession, d: str) -> DataFrame:
    return evidence.latest_extractions(table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "occurred_at"))


@query(
    """SELECT evidence_id, count(DISTINCT extraction_id) attempts, count(DISTINCT method) methods, min(occurred_at) first_at, max(occurred_at) last_at
    FROM evidence_extractions GROUP BY 1"""
)
def extraction_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "method", "occurred_at")
    return rows.groupBy("evidence_id").agg(F.count_distinct("extraction_id").alias("attempts"), F.count_distinct("method").alias("methods"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_units", "evidence_id", "artifact_id", "unit_type", "locator")


def _readings(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "quality_score", "occurred_at", *more)


@query(
    f"""SELECT u.evidence_id, u.artifact_id, u.unit_type, u.locator, p.quality_score, p.extraction_id
    FROM evidence_units u LEFT JOIN ({_PREFERRED}) p USING (evidence_id) WHERE coalesce(p.quality_score, 0) < 0.7"""
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Units whose preferred reading is missing or poor."""
    return evidence.review_queue(_units(spark, d), _readings(spark, d), 0.7).select("evidence_id", "artifact_id", "unit_type", "locator", "quality_score", "extraction_id")


@query(
    f"""SELECT u.unit_type, count(*) units, count(*) FILTER (WHERE coalesce(p.quality_score, 0) < 0.7) to_review
    FROM evidence_units u LEFT JOIN ({_PREFERRED}) p USING (evidence_id) GROUP BY 1"""
)
def review_count(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.preferred_evidence(_units(spark, d), _readings(spark, d), keep_unread=True)
    return rows.groupBy("unit_type").agg(F.count("*").alias("units"), F.count_if(F.coalesce("quality_score", F.lit(0.0)) < 0.7).alias("to_review"))


@query(
    f"""SELECT u.artifact_id, coalesce(bool_or(regexp_matches(p.extracted_text, '[^\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]')), false) has_text
    FROM evidence_units u LEFT JOIN ({_PREFERRED}) p USING (evidence_id) GROUP BY 1"""
)
def substantive_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.substantive(_units(spark, d), _readings(spark, d, "extracted_text"))


_TABLES = ("sources", "artifacts", "source_snapshots", "evidence_units", "evidence_extractions", "evidence_facts", "evidence_segments", "source_relations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table; only file footers are read."""
    parts = [table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT source_id, count(DISTINCT artifact_id) artifacts FROM source_snapshots GROUP BY 1 HAVING count(DISTINCT artifact_id) > 1")
def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    return evidence.changed_sources(table(spark, d, "source_snapshots", "source_id", "artifact_id"))


@query("SELECT artifact_id, count(DISTINCT source_id) n_sources FROM source_snapshots GROUP BY 1 HAVING count(DISTINCT source_id) > 1")
def shared_artifacts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_snapshots", "source_id", "artifact_id")
    return rows.groupBy("artifact_id").agg(F.count_distinct("source_id").alias("n_sources")).where("n_sources > 1")


@query(
    """SELECT method, count(*) readings, round(min(quality_score), 4) least, round(avg(quality_score), 4) mean, round(max(quality_score), 4) most,
    count(*) FILTER (WHERE quality_score < 0.7) low, count(*) FILTER (WHERE quality_score IS NULL) unknown FROM evidence_extractions GROUP BY 1"""
)
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality_score")
    return table(spark, d, "evidence_extractions", "method", "quality_score").groupBy("method").agg(
        F.count("*").alias("readings"), F.round(F.min(q), 4).alias("least"), F.round(F.avg(q), 4).alias("mean"), F.round(F.max(q), 4).alias("most"),
        F.count_if(q < 0.7).alias("low"), F.count_if(q.isNull()).alias("unknown"),
    )


@query("SELECT unit_type, count(*) units, count(DISTINCT artifact_id) artifacts FROM evidence_units GROUP BY 1")
def units_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_units", "unit_type", "artifact_id").groupBy("unit_type").agg(F.count("*").alias("units"), F.count_distinct("artifact_id").alias("artifacts"))


@query(
    """SELECT source_id, artifact_id, retrieved_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at DESC NULLS LAST,
    snapshot_id DESC) rn FROM source_snapshots) WHERE rn = 1"""
)
def latest_artifact_per_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_snapshots", "source_id", "artifact_id", "retrieved_at", "snapshot_id")
    return evidence.latest_per_source(rows).select("source_id", "artifact_id", "retrieved_at")


@query("SELECT DISTINCT s.artifact_id, s.source_id, o.source_uri, o.source_name FROM source_snapshots s JOIN sources o USING (source_id)")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return evidence.provenance(table(spark, d, "source_snapshots"), table(spark, d, "sources"))


@query(
    """SELECT DISTINCT s.native_identifier, e.evidence_id, e.locator FROM source_snapshots s JOIN evidence_units e USING (artifact_id)
    WHERE s.native_identifier IS NOT NULL"""
)
def native_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Units of every native identifier."""
    names = table(spark, d, "source_snapshots", "artifact_id", "native_identifier").where("native_identifier is not null").distinct()
    return names.join(table(spark, d, "evidence_units", "artifact_id", "evidence_id", "locator"), "artifact_id").select("native_identifier", "evidence_id", "locator").distinct()


@query(
    """SELECT DISTINCT r.relation_id, a.source_uri AS uri, r.relation_type, b.source_uri AS related_uri FROM source_relations r
    JOIN sources a ON a.source_id = r.source_id JOIN sources b ON b.source_id = r.related_source_id"""
)
def relation_ends(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "source_relations", "relation_id", "source_id", "relation_type", "related_source_id")
    s = table(spark, d, "sources", "source_id", "source_uri")
    out = r.join(s.withColumnRenamed("source_uri", "uri"), "source_id").join(s.toDF("related_source_id", "related_uri"), "related_source_id")
    return out.select("relation_id", "uri", "relation_type", "related_uri").distinct()


@query(
    """SELECT DISTINCT relation_id, related_source_id FROM source_relations r WHERE related_source_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = r.related_source_id)"""
)
def dangling_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose other end is no known source."""
    r = table(spark, d, "source_relations", "relation_id", "related_source_id")
    return evidence.orphans(r, table(spark, d, "sources", "source_id"), "related_source_id", "source_id").select("relation_id", "related_source_id").distinct()


_FAMILIES = """WITH RECURSIVE e AS (SELECT DISTINCT source_id a, related_source_id b FROM source_relations
  WHERE relation_type = 'historical_version_of' AND source_id IS NOT NULL AND related_source_id IS NOT NULL),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(s, t) AS (SELECT a, a FROM d UNION SELECT r.s, d.b FROM r JOIN d ON r.t = d.a),
f AS (SELECT s, min(t) root FROM r GROUP BY s)
"""


@query(_FAMILIES + "SELECT o.source_id, coalesce(f.root, o.source_id) root FROM (SELECT DISTINCT source_id FROM sources) o LEFT JOIN f ON f.s = o.source_id")
def source_families(spark: SparkSession, d: str) -> DataFrame:
    return similarity.families(table(spark, d, "sources", "source_id"), table(spark, d, "source_relations", "source_id", "relation_type", "related_source_id"), "historical_version_of")


@query(
    _FAMILIES
    + """, m AS (SELECT coalesce(f.root, o.source_id) root, o.source_id FROM (SELECT DISTINCT source_id FROM sources) o LEFT JOIN f ON f.s = o.source_id)
SELECT root, 'source-family:' || sha256(string_agg(source_id, chr(31) ORDER BY source_id)) family_id, count(*)::INTEGER members FROM m GROUP BY 1"""
)
def family_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return similarity.family_ids(source_families(spark, d))


@query(
    """SELECT source_uri, 'source:' || sha256(source_uri) expected_id FROM sources"""
)
def source_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers hashed from the address alone."""
    return table(spark, d, "sources", "source_uri").select("source_uri", ids.source_id("source_uri").alias("expected_id"))


@query(
    """SELECT artifact_id, unit_type, locator, 'evidence:' || sha256(coalesce(artifact_id, '') || chr(31) || coalesce(unit_type, '') || chr(31) || coalesce(locator, '')) expected_id
    FROM evidence_units"""
)
def evidence_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("artifact_id", "unit_type", "locator", ids.evidence_id("artifact_id", "unit_type", "locator").alias("expected_id"))


@query(
    """SELECT lower(trim(split_part(media_type, ';', 1))) media, count(*) artifacts, sum(byte_size)::BIGINT bytes,
    sha256(string_agg(artifact_id, chr(10) ORDER BY artifact_id) || chr(10)) signature FROM artifacts GROUP BY 1"""
)
def artifact_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts by media type, with a signature of the set."""
    rows = table(spark, d, "artifacts", "artifact_id", "media_type", "byte_size")
    # the hashes of a kind are folded by a sorted list, as the signature is defined over all of them in order
    return rows.groupBy(F.lower(F.trim(F.split("media_type", ";")[0])).alias("media")).agg(F.count("*").alias("artifacts"), F.sum("byte_size").alias("bytes"), ids.set_signature(F.collect_list("artifact_id")).alias("signature"))


_STEP = """(SELECT *, lag(artifact_id) OVER (PARTITION BY source_id ORDER BY retrieved_at NULLS FIRST, snapshot_id) p
  FROM (SELECT DISTINCT source_id, artifact_id, retrieved_at, snapshot_id FROM source_snapshots))"""


@query(f"SELECT snapshot_id, source_id, artifact_id, CASE WHEN p <> artifact_id THEN p END supersedes FROM {_STEP}")
def supersessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_snapshots", "snapshot_id", "source_id", "artifact_id", "retrieved_at").distinct()
    return changes.supersessions(rows).select("snapshot_id", "source_id", "artifact_id", "supersedes")


@query(
    """WITH p AS (SELECT DISTINCT artifact_id, try_cast(regexp_extract(locator, '^page:(\\d+)$', 1) AS BIGINT) n FROM evidence_units),
    s AS (SELECT artifact_id, n, lead(n) OVER (PARTITION BY artifact_id ORDER BY n) nx FROM p WHERE n IS NOT NULL AND artifact_id IS NOT NULL)
    SELECT artifact_id, unnest(range(n + 1, nx)) missing FROM s WHERE nx > n + 1"""
)
def page_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Pages that lie between an artifact's first and last and have no unit."""
    n = F.regexp_extract("locator", r"^page:(\d+)$", 1)
    pages = table(spark, d, "evidence_units", "artifact_id", "locator").select(F.col("artifact_id").alias("grp"), F.when(n != "", n.cast("long")).alias("number"))
    return changes.sequence_gaps(pages).withColumnRenamed("grp", "artifact_id")


@query(
    """SELECT source_uri, CASE WHEN lower(source_uri) LIKE '%html=true%' THEN 'html' WHEN lower(source_uri) LIKE '%packet=true%' THEN 'packet'
    WHEN lower(source_uri) LIKE '%/previousversions/%' THEN 'versions' WHEN regexp_matches(lower(source_uri), '\\.pdf($|\\?)|/viewfile/') THEN 'pdf' ELSE 'other' END format
    FROM sources"""
)
def link_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "source_uri").select("source_uri", links.link_format(F.col("source_uri")).alias("format"))


@query(
    """SELECT CASE WHEN regexp_matches(source_uri, 'onbase') THEN 'agenda_item' WHEN regexp_matches(source_uri, 'AgendaCenter/ViewFile') THEN 'agenda_file'
    WHEN regexp_matches(source_uri, 'PreviousVersions') THEN 'version' ELSE 'other' END "role", count(*) n_sources FROM sources GROUP BY 1"""
)
def source_roles(spark: SparkSession, d: str) -> DataFrame:
    rules = [("agenda_item", "onbase"), ("agenda_file", "AgendaCenter/ViewFile"), ("version", "PreviousVersions")]
    return table(spark, d, "sources", "source_uri").groupBy(links.classified(rules, "other", F.col("source_uri")).alias("role")).agg(F.count("*").alias("n_sources"))


@query(
    """SELECT source_uri, CASE WHEN source_uri IS NULL OR source_uri NOT LIKE 'https://%' THEN 'not_https' WHEN position('?' IN source_uri) = 0 THEN 'no_query'
    WHEN position('itemId=' IN source_uri) = 0 THEN 'no_item' END reason FROM sources"""
)
def link_checks(spark: SparkSession, d: str) -> DataFrame:
    """The first check that each address fails; null where it is accepted."""
    u = F.col("source_uri")
    checks = [("not_https", ~u.startswith("https://")), ("no_query", ~u.contains("?")), ("no_item", ~u.contains("itemId="))]
    return table(spark, d, "sources", "source_uri").select("source_uri", links.first_failure(checks).alias("reason"))


@query(
    r"""WITH u AS (SELECT regexp_extract(source_uri, '^https?://[^/?#]+([^?#]*)', 1) p, regexp_extract(source_uri, '\?([^#]*)', 1) q FROM sources),
    k AS (SELECT p || '?' || array_to_string(list_sort(list_distinct(list_transform(string_split(q, '&'), lambda x: string_split(x, '=')[1]))), '&') s FROM u)
    SELECT regexp_replace(s, '\d+', '0', 'g') signature, count(*) n_sources FROM k GROUP BY 1"""
)
def link_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of addresses: path depth aside, which query keys occur with which path."""
    sig = F.regexp_replace(links.signature(F.col("source_uri")), r"\d+", "0")
    return table(spark, d, "sources", "source_uri").groupBy(sig.alias("signature")).agg(F.count("*").alias("n_sources"))


@query(
    """SELECT method, extraction_id FROM (SELECT method, extraction_id, row_number() OVER (PARTITION BY method ORDER BY sha256(extraction_id), extraction_id) rn
    FROM (SELECT DISTINCT method, extraction_id FROM evidence_extractions)) WHERE rn <= 5"""
)
def stable_samples(spark: SparkSession, d: str) -> DataFrame:
    """Five readings of each method, by hash."""
    rows = table(spark, d, "evidence_extractions", "method", "extraction_id").distinct()
    return links.stable_sample(rows, "extraction_id", 5, by="method").select("method", "extraction_id")


@query(
    """SELECT DISTINCT r.relation_id, r.source_id FROM source_relations r WHERE r.source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_snapshots s WHERE s.source_id = r.source_id AND s.native_identifier IS NOT NULL)"""
)
def unnamed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of sources that were never retrieved under a native identifier."""
    r = table(spark, d, "source_relations", "relation_id", "source_id")
    named = table(spark, d, "source_snapshots", "source_id", "native_identifier").where("native_identifier is not null")
    return evidence.orphans(r, named, "source_id").select("relation_id", "source_id").distinct()


_SERIAL = r"try_cast(regexp_extract(native_identifier, '^[A-Z]+-(\d+)$', 1) AS BIGINT) // 1000"


@query(
    f"""WITH p AS (SELECT DISTINCT split_part(native_identifier, '-', 1) series, {_SERIAL} n FROM source_snapshots), s AS (SELECT series, n, lead(n) OVER (PARTITION BY series ORDER BY n) nx FROM p WHERE n IS NOT NULL)
    SELECT series, unnest(range(n + 1, nx)) missing FROM s WHERE nx > n + 1"""
)
def serial_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Thousands of each series of native identifiers in which none was seen."""
    n = F.floor(F.regexp_extract("native_identifier", r"^[A-Z]+-(\d+)$", 1).try_cast("long") / 1000)
    rows = table(spark, d, "source_snapshots", "native_identifier").select(F.split("native_identifier", "-")[0].alias("grp"), n.alias("number"))
    return changes.sequence_gaps(rows).withColumnRenamed("grp", "series")
