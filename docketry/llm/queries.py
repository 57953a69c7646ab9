"""Queries over the evidence tables for the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import chosen_path, components, consensus, mixing, packing, paragraphs, personal, scanned, spans, tokens
from docketry.sources.tables import table

#: Relation types that state that two sources are the same record (fixed values).
MATCH_TYPES = ("historicalversionof", "duplicateof", "samerecordas")


def _spans(spark: SparkSession, sf_dir: str) -> spans.SharedSpans:
    return spans.SharedSpans(_texts(spark, sf_dir), "record_id", "evidence_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and segments with a run of 200 characters that also stands in those of another unit."""
    return _spans(spark, sf_dir).records()


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each such record stands elsewhere too."""
    return _spans(spark, sf_dir).coverage()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "evidence_extractions", "extraction_id", "evidence_id", "extracted_text").toDF("record_id", "evidence_id", "text")
    return read.unionByName(table(spark, sf_dir, "evidence_segments", "segment_id", "evidence_id", "raw_text").toDF("record_id", "evidence_id", "text"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs of each record stand, nearly or exactly, in records of other units, and how many of them can go."""
    return paragraphs.repeated(_texts(spark, sf_dir), "record_id", "evidence_id", "text")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records linked through shared passages."""
    return _spans(spark, sf_dir).groups()


def _similar(spark: SparkSession, sf_dir: str) -> chosen_path.Similar:
    rows = table(spark, sf_dir, "evidence_segments", "segment_id", "evidence_id", "normalized_text")
    return chosen_path.similar_records(rows, "segment_id", "evidence_id", "normalized_text", size=3, threshold=0.6)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of different units that are alike but for small edits."""
    return _similar(spark, sf_dir).pairs().toDF("segment_id_a", "segment_id_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with its class of equal texts, the class's copies, and how many similar classes there are."""
    return _similar(spark, sf_dir).classes().withColumnRenamed("key", "segment_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group identifier of every source at either end of a match relation."""
    edges = table(spark, sf_dir, "source_relations", "source_id", "related_source_id", "relation_type").where(components.spelled(F.col("relation_type")).isin(*MATCH_TYPES))
    return components.connected_groups(edges, "source_id", "related_source_id").withColumnRenamed("id", "source_id")


def _readings(spark: SparkSession, sf_dir: str) -> tuple:
    rows = table(spark, sf_dir, "evidence_extractions", "evidence_id", "extraction_id", "extracted_text", "quality_score", "occurred_at")
    return rows, "evidence_id", "extraction_id", "extracted_text", "quality_score", "occurred_at"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving reading of every unit with several, by completeness and trust."""
    return consensus.most_trusted(*_readings(spark, sf_dir))


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading closest to a vote on every token, weighted by quality scores."""
    return consensus.surviving(*_readings(spark, sf_dir))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving readings as whole records, missing fields filled from the reading's own other row."""
    fields = ("occurred_at", "method", "extracted_text", "quality_score", "software_version", "model_version", "warnings_json")
    rows = table(spark, sf_dir, "evidence_extractions", "evidence_id", "extraction_id", *fields)
    return consensus.merged_readings(rows, "evidence_id", "extraction_id", *fields).join(p1_found(spark, sf_dir), ["evidence_id", "extraction_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of noise each reading holds."""
    return scanned.noise(table(spark, sf_dir, "evidence_extractions", "extraction_id", "evidence_id", "extracted_text"), "extraction_id", "evidence_id", "extracted_text")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading as continuous paragraphs."""
    return scanned.repaired(table(spark, sf_dir, "evidence_extractions", "extraction_id", "extracted_text"), "extraction_id", "extracted_text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or its pieces, in containers of each capacity."""
    docs = tokens.sized(table(spark, sf_dir, "documents", "doc_id", "text"), "text")
    return packing.packed(docs, table(spark, sf_dir, "pack_sizes"), "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in each mix."""
    docs = tokens.sized(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "text")
    return mixing.balanced(docs, table(spark, sf_dir, "mix_targets"), "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token shares that each mix reaches, by source."""
    return mixing.shares(p8_copies(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


#: Kinds of personal data that p9_found reports (fixed values).
PII_KINDS = ("email", "phone", "id_number", "address", "name")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal data in the documents."""
    found = personal.find(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return found.where(F.col("pii_kind").isin(*PII_KINDS)).select("doc_id", "pii_kind", "char_start")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders in place of personal data."""
    return personal.redact(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


P1_SQL = r"""
WITH m AS (
  SELECT evidence_id, extraction_id, max(extracted_text) t, max(quality_score) q, max(occurred_at) o
  FROM evidence_extractions GROUP BY 1, 2),
l AS (SELECT *, length(trim(regexp_replace(coalesce(t, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))) n FROM m),
u AS (SELECT *, max(n) OVER w longest, count(*) OVER w k FROM l WINDOW w AS (PARTITION BY evidence_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY CASE WHEN q BETWEEN 0 AND 1 THEN q ELSE -1 END DESC,
  o DESC NULLS LAST, extraction_id DESC) rn FROM u WHERE k > 1 AND n > 0 AND n >= 0.8 * longest)
SELECT evidence_id, extraction_id FROM r WHERE rn = 1
"""

P5_SQL = r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT source_id a, related_source_id b FROM source_relations
  WHERE regexp_replace(lower(relation_type), '[^a-z0-9]+', '', 'g') IN ('historicalversionof', 'duplicateof', 'samerecordas')
    AND source_id IS NOT NULL AND related_source_id IS NOT NULL),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(s, t) AS (SELECT a, a FROM d UNION SELECT r.s, d.b FROM r JOIN d ON r.t = d.a)
SELECT s AS source_id, min(t) AS group_id FROM r GROUP BY s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_consensus": p1_consensus,
        "p1_records": p1_records,
        "p3_found": p3_found,
        "p3_shared": p3_shared,
        "p3_groups": p3_groups,
        "p3_paragraphs": p3_paragraphs,
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_repaired": p6_repaired,
        "p7_containers": p7_containers,
        "p7_fill": p7_fill,
        "p8_copies": p8_copies,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_redacted": p9_redacted,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p5_found": P5_SQL}
