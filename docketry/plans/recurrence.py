"""Queries over recurring segments: occurrences by source family, clusters, packets and their variation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import evidence, similarity
from docketry.plans.evidence import _FAMILIES, _PREFERRED, source_families
from docketry.plans.registry import query
from docketry.sources.tables import table

_HOMES = f"""{_FAMILIES}, home AS (SELECT DISTINCT s.artifact_id, coalesce(f.root, o.source_id) family FROM source_snapshots s JOIN (SELECT DISTINCT source_id FROM sources) o USING (source_id) LEFT JOIN f ON f.s = o.source_id)"""
_OCCURRENCES = f"""{_HOMES}, g AS (SELECT DISTINCT segment_id, evidence_id, artifact_id, normalized_text, char_start, char_end FROM evidence_segments WHERE segment_type = 'agenda_item'),
o AS (SELECT family || '|' || segment_id id, family, segment_id, evidence_id, char_start, char_end, regexp_extract_all(lower(normalized_text), '[a-z0-9]+') t FROM g JOIN home USING (artifact_id)),
h AS (SELECT DISTINCT id, family, array_to_string(t[i:i + 2], ' ') x FROM (SELECT *, unnest(range(1, len(t) - 1)) i FROM o)),
n AS (SELECT id, count(*) c FROM h GROUP BY 1), sh AS (SELECT x, count(*) c FROM h GROUP BY 1),
p AS (SELECT a.id a, b.id b, bool_or(a.family = b.family) same, count(*) c FROM h a JOIN h b USING (x) JOIN sh USING (x) WHERE sh.c BETWEEN 2 AND 64 AND a.id < b.id GROUP BY 1, 2),
q AS (SELECT p.a, p.b, count(*) shared FROM p JOIN h u ON u.id = p.a JOIN h v ON v.id = p.b AND v.x = u.x WHERE NOT p.same AND p.c >= 3 GROUP BY 1, 2),
ed AS (SELECT a, b, shared, shared / (na.c + nb.c - shared) similarity FROM q JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE shared / (na.c + nb.c - shared) >= 0.6)"""

#: Shingles of three tokens, three shared of those that at most 64 occurrences have, similarity 0.6 (fixed values).
_HOW = (3, 0.6, 3, 64)


def _homes(spark: SparkSession, d: str) -> DataFrame:
    return similarity.artifact_families(table(spark, d, "source_snapshots", "artifact_id", "source_id"), source_families(spark, d))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "evidence_segments", "segment_id", "evidence_id", "artifact_id", "segment_type", "normalized_text", "char_start", "char_end").where("segment_type = 'agenda_item'").drop("segment_type").distinct()
    return similarity.occurrences(segments, _homes(spark, d))


@query(f"{_HOMES} SELECT artifact_id, family FROM home")
def artifact_families(spark: SparkSession, d: str) -> DataFrame:
    """The source families that publish each artifact."""
    return _homes(spark, d)


@query(
    f"""{_HOMES}, p AS (SELECT DISTINCT supersedes_artifact_id a, artifact_id b FROM source_snapshots WHERE supersedes_artifact_id IS NOT NULL)
    SELECT p.a, p.b, coalesce(bool_or(x.family = y.family), false) shared FROM p LEFT JOIN home x ON x.artifact_id = p.a LEFT JOIN home y ON y.artifact_id = p.b GROUP BY 1, 2"""
)
def superseded_in_family(spark: SparkSession, d: str) -> DataFrame:
    """Whether an artifact and the one it supersedes come from one family."""
    s = table(spark, d, "source_snapshots", "supersedes_artifact_id", "artifact_id").where("supersedes_artifact_id is not null")
    return similarity.sharing_family(s.toDF("a", "b"), _homes(spark, d))


@query(f"{_OCCURRENCES} SELECT a, b, shared, round(similarity, 6) similarity FROM ed")
def family_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Similar agenda items of different source families."""
    return similarity.near_duplicates(_occurrences(spark, d), *_HOW).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""{_OCCURRENCES} SELECT (SELECT count(*) FROM o) occurrences, (SELECT count(*) * (count(*) - 1) // 2 FROM o) possible_pairs, count(*) FILTER (WHERE NOT same) AS "generated",
    count(*) FILTER (WHERE NOT same AND c >= 3) compared, (SELECT count(*) FROM ed) matched, count(*) FILTER (WHERE same) same_family, (SELECT count(*) FROM sh WHERE c > 64) common_ignored FROM p"""
)
def near_duplicate_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs the candidates spare."""
    return similarity.near_duplicate_counters(_occurrences(spark, d), *_HOW)


_CLUSTERS = f"""{_OCCURRENCES}, l AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
w(x, y) AS (SELECT a, a FROM l UNION SELECT w.x, l.b FROM w JOIN l ON w.y = l.a), m AS (SELECT x id, min(y) root FROM w GROUP BY 1),
k AS (SELECT root, 'segment-recurrence-cluster:' || sha256('0.6' || chr(31) || string_agg(id, chr(31) ORDER BY id)) cluster_id, count(*) n FROM m GROUP BY 1)"""


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from docketry.session import cut

    occurrences = cut(_occurrences(spark, d))
    return occurrences, *similarity.clusters(similarity.near_duplicates(occurrences, *_HOW), 0.6)


@query(
    f"""{_CLUSTERS}, s AS (SELECT root, count(*) edges, min(similarity) least, max(similarity) most, avg(similarity) mean FROM ed JOIN m ON m.id = ed.a GROUP BY 1)
    SELECT cluster_id, n AS occurrences, edges, round(least, 6) least, round(most, 6) most, round(mean, 6) mean FROM k JOIN s USING (root)"""
)
def cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of recurring agenda items with their identifiers and edges."""
    stats = _clustered(spark, d)[2]
    return stats.select("cluster_id", "occurrences", "edges", *(F.round(c, 6).alias(c) for c in ("least", "most", "mean")))


_PACKETS = f"""{_CLUSTERS}, mo AS (SELECT cluster_id, o.* EXCLUDE (t) FROM m JOIN k USING (root) JOIN o USING (id)),
v AS (SELECT DISTINCT mo.cluster_id, mo.id, f.fact_type || ':' || f.normalized_text || ':' || coalesce(f.unit, '') v FROM mo JOIN evidence_facts f USING (evidence_id)
  WHERE f.char_start >= mo.char_start AND f.char_end <= mo.char_end AND f.normalized_text IS NOT NULL),
z AS (SELECT cluster_id, count(DISTINCT id) occurrences, count(DISTINCT family) families, count(DISTINCT evidence_id) units FROM mo GROUP BY 1),
c AS (SELECT cluster_id, v, count(*) n FROM v GROUP BY 1, 2),
li AS (SELECT cluster_id, list_sort(list(v) FILTER (WHERE n = occurrences)) common, list_sort(list(v) FILTER (WHERE n < occurrences)) vary FROM c JOIN z USING (cluster_id) GROUP BY 1),
packets AS (SELECT z.*, occurrences - coalesce((SELECT count(DISTINCT id) FROM v WHERE v.cluster_id = z.cluster_id), 0) bare, coalesce(common, []) common, coalesce(vary, []) vary FROM z LEFT JOIN li USING (cluster_id))"""


def _packets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    occurrences, members, _ = _clustered(spark, d)
    facts = table(spark, d, "evidence_facts", "evidence_id", "fact_type", "normalized_text", "unit", "char_start", "char_end").where("normalized_text is not null")
    value = F.concat("fact_type", F.lit(":"), "normalized_text", F.lit(":"), F.coalesce("unit", F.lit("")))
    return similarity.packets(members, occurrences, facts.withColumn("value", value)), members, occurrences


@query(f"""{_PACKETS} SELECT cluster_id, occurrences, bare, families, units, array_to_string(common, '|') common, array_to_string(vary, '|') AS "varying" FROM packets""")
def recurrence_packets(spark: SparkSession, d: str) -> DataFrame:
    """What the members of each cluster all state, and what only some do."""
    return _packets(spark, d)[0].withColumn("common", F.array_join("common", "|")).withColumn("varying", F.array_join("varying", "|"))


@query(
    f"""{_PACKETS}, x AS (SELECT mo.cluster_id, bool_or(b.extraction_id IS NULL) unread, bool_or(b.quality_score IS NULL) unknown, min(b.quality_score) quality,
      string_agg(DISTINCT family || chr(31) || segment_id || chr(31) || mo.evidence_id || chr(31) || coalesce(b.extraction_id, 'none'), chr(31) ORDER BY family || chr(31) || segment_id || chr(31) || mo.evidence_id || chr(31) || coalesce(b.extraction_id, 'none')) inputs
      FROM mo LEFT JOIN ({_PREFERRED}) b USING (evidence_id) GROUP BY 1),
    y AS (SELECT *, CASE WHEN families < 2 THEN 'requires_multiple_source_families' WHEN units < 2 THEN 'requires_multiple_evidence_units' WHEN len(vary) = 0 THEN 'no_structured_fact_variation'
      WHEN len(common) = 0 THEN 'no_common_structured_fact_anchor' WHEN bare > 0 THEN 'occurrence_missing_structured_facts' WHEN unread THEN 'missing_preferred_extraction' WHEN unknown THEN 'unknown_extraction_quality'
      WHEN quality < 0.7 THEN 'extraction_quality_below_threshold' END reason FROM packets JOIN x USING (cluster_id))
    SELECT cluster_id, coalesce(reason, 'eligible_recurrence_fact_variation') reason, quality, CASE WHEN reason IS NULL THEN 'recurrence-variation-inputs:' || sha256(array_to_string(
      list_concat([cluster_id, inputs], list_concat(list_transform(common, lambda v: 'common:' || v), list_transform(vary, lambda v: 'varying:' || v))), chr(31))) END fingerprint FROM y"""
)
def recurrence_variation(spark: SparkSession, d: str) -> DataFrame:
    """Whether the values that vary within a cluster can be relied on."""
    packets, members, occurrences = _packets(spark, d)
    read = evidence.preferred_extractions(table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "quality_score", "occurred_at"))
    return similarity.variation(packets, members, occurrences, read, 0.7)
