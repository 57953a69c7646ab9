"""Queries that observe change between versions and along sources, trace it, and read events back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import changes, evidence, observations
from docketry.plans.evidence import _PREFERRED, _STEP, _readings, _units
from docketry.plans.registry import query
from docketry.sources.tables import table

_UNITS = f"un AS (SELECT u.artifact_id, u.unit_type, u.locator, u.evidence_id, p.extraction_id, md5(coalesce(p.extracted_text, '')) h, p.extracted_text x FROM evidence_units u LEFT JOIN ({_PREFERRED}) p USING (evidence_id))"
_VALUES = """va AS (SELECT artifact_id, 'money' kind, round(numeric_value, 2)::DECIMAL(18, 2)::VARCHAR v, count(*) n FROM (SELECT DISTINCT artifact_id, fact_id, numeric_value FROM evidence_facts WHERE fact_type = 'money' AND numeric_value IS NOT NULL AND abs(numeric_value) < 1e14) GROUP BY ALL
  UNION ALL SELECT artifact_id, 'date', normalized_text, count(*) FROM (SELECT DISTINCT artifact_id, fact_id, normalized_text FROM evidence_facts WHERE fact_type = 'date' AND normalized_text IS NOT NULL) GROUP BY ALL)"""


def _compared(asked: str) -> str:
    """SQL of the comparison of pairs; ``asked`` names a table with before_id and after_id."""
    return f"""{_UNITS}, {_VALUES}, pr AS (SELECT DISTINCT before_id, after_id FROM {asked} WHERE before_id <> after_id),
ub AS (SELECT before_id, after_id, unit_type, locator, h FROM pr JOIN un ON un.artifact_id = before_id), ua AS (SELECT before_id, after_id, unit_type, locator, h FROM pr JOIN un ON un.artifact_id = after_id),
uc AS (SELECT before_id, after_id, count(*) FILTER (WHERE ub.h IS NULL OR ua.h IS NULL OR ub.h <> ua.h) units_changed FROM ub FULL JOIN ua USING (before_id, after_id, unit_type, locator) GROUP BY 1, 2),
ui AS (SELECT before_id, after_id, sha256(count(*)::VARCHAR || ':' || sum(('0x' || substr(sha256(side || chr(31) || unit_type || chr(31) || locator || chr(31) || evidence_id || chr(31) || coalesce(extraction_id, 'none')), 1, 15))::BIGINT::HUGEINT)::VARCHAR) inputs
  FROM (SELECT *, 'before' side FROM pr JOIN un ON un.artifact_id = before_id UNION ALL SELECT *, 'after' side FROM pr JOIN un ON un.artifact_id = after_id) GROUP BY 1, 2),
vb AS (SELECT before_id, after_id, kind, v, n nb FROM pr JOIN va ON va.artifact_id = before_id), vf AS (SELECT before_id, after_id, kind, v, n na FROM pr JOIN va ON va.artifact_id = after_id),
vd AS (SELECT before_id, after_id, kind || ':' || v kv, coalesce(na, 0) - coalesce(nb, 0) dd FROM vb FULL JOIN vf USING (before_id, after_id, kind, v)),
vl AS (SELECT before_id, after_id, string_agg(repeat(kv || '|', abs(dd)), '' ORDER BY kv) FILTER (WHERE dd < 0) removed, string_agg(repeat(kv || '|', abs(dd)), '' ORDER BY kv) FILTER (WHERE dd > 0) added FROM vd WHERE dd <> 0 GROUP BY 1, 2),
tx AS (SELECT artifact_id FROM un GROUP BY 1 HAVING bool_or(regexp_matches(x, '[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]')))"""


_STATUS = """CASE WHEN before_id IS NULL OR after_id IS NULL THEN 'missing_artifact' WHEN before_id = after_id THEN 'same_artifact'
  WHEN before_id NOT IN (SELECT artifact_id FROM tx) OR after_id NOT IN (SELECT artifact_id FROM tx) THEN 'insufficient_evidence' WHEN coalesce(units_changed, 0) = 0 THEN 'unchanged' ELSE 'observed' END"""
_OID = "CASE WHEN status IN ('observed', 'already_observed') THEN 'observation:' || sha256('version_change' || chr(31) || before_id || chr(31) || after_id || chr(31) || inputs) END"
_LATEST = """led AS (SELECT source_id, arg_max(artifact_id, (retrieved_at, snapshot_id)) a FROM source_snapshots WHERE native_identifier IS NOT NULL AND retrieved_at IS NOT NULL GROUP BY 1),
snp AS (SELECT source_id, arg_max(artifact_id, (retrieved_at, snapshot_id)) a FROM source_snapshots WHERE retrieved_at IS NOT NULL GROUP BY 1),
la AS (SELECT source_id, coalesce(led.a, snp.a) artifact_id FROM led FULL JOIN snp USING (source_id))"""
_RELATED = f"""{_LATEST}, asked AS (SELECT DISTINCT relation_id, x.artifact_id before_id, y.artifact_id after_id FROM source_relations r LEFT JOIN la x ON x.source_id = r.source_id LEFT JOIN la y ON y.source_id = r.related_source_id
  WHERE regexp_replace(lower(r.relation_type), '[^a-z0-9]+', '', 'g') IN ('historicalversionof', 'duplicateof', 'samerecordas'))"""


def _preferred_units(spark: SparkSession, d: str) -> DataFrame:
    return evidence.preferred_evidence(_units(spark, d), _readings(spark, d, "extracted_text"), keep_unread=True).select("artifact_id", "unit_type", "locator", "evidence_id", "extraction_id", F.col("extracted_text").alias("text"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_facts", "artifact_id", "fact_id", "fact_type", "numeric_value", "normalized_text")
    money = rows.where("fact_type = 'money' and numeric_value is not null and abs(numeric_value) < 1e14").select("artifact_id", "fact_id", "numeric_value").distinct()
    dates = rows.where("fact_type = 'date' and normalized_text is not null").select("artifact_id", "fact_id", "normalized_text").distinct()
    one = money.select("artifact_id", F.lit("money").alias("kind"), F.round("numeric_value", 2).cast("decimal(18,2)").cast("string").alias("value"))
    return one.unionByName(dates.select("artifact_id", F.lit("date").alias("kind"), F.col("normalized_text").alias("value")))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_snapshots", "source_id", "artifact_id", "retrieved_at", "snapshot_id", "native_identifier")
    visits = s.where("native_identifier is not null and retrieved_at is not null").select("source_id", F.col("retrieved_at").alias("at"), F.col("snapshot_id").alias("seq"), "artifact_id")
    return observations.latest_artifacts(visits, s)


@query(f"WITH {_LATEST} SELECT source_id, artifact_id FROM la")
def latest_by_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The latest artifact of each source: by its named visits, else by its snapshots."""
    return _latest(spark, d)


def _observed(spark: SparkSession, d: str, asked: DataFrame, known: DataFrame | None = None, **names: str) -> DataFrame:
    units = _preferred_units(spark, d)
    compared = observations.changes_of_pairs(asked.where("before <> after"), units, _values(spark, d))
    full = evidence.substantive(_units(spark, d), _readings(spark, d, "extracted_text"))
    none = spark.createDataFrame([], "observation_id string")
    return observations.observed(asked, compared, full, none if known is None else known, **names)


def _related(spark: SparkSession, d: str) -> DataFrame:
    kind = F.regexp_replace(F.lower("relation_type"), "[^a-z0-9]+", "")
    r = table(spark, d, "source_relations", "relation_id", "source_id", "related_source_id", "relation_type").where(kind.isin("historicalversionof", "duplicateof", "samerecordas"))
    latest = _latest(spark, d)
    both = r.join(latest.toDF("source_id", "before"), "source_id", "left").join(latest.toDF("related_source_id", "after"), "related_source_id", "left")
    return both.select("relation_id", "before", "after").distinct()


def _flat(rows: DataFrame) -> DataFrame:
    """Arrays of values as text, each value ended by a bar."""
    ended = lambda c: F.when(F.size(c) > 0, F.concat(F.array_join(c, "|"), F.lit("|")))
    return rows.withColumn("removed", ended("removed")).withColumn("added", ended("added"))


@query(
    f"""WITH {_RELATED}, {_compared("asked")}, st AS (SELECT *, {_STATUS} status FROM asked LEFT JOIN uc USING (before_id, after_id) LEFT JOIN ui USING (before_id, after_id) LEFT JOIN vl USING (before_id, after_id))
    SELECT relation_id, status, {_OID} observation_id, units_changed, removed, added FROM st"""
)
def version_observations(spark: SparkSession, d: str) -> DataFrame:
    """What became of each version relation: compared or not and why, and what changed."""
    return _flat(_observed(spark, d, _related(spark, d))).select("relation_id", "status", "observation_id", "units_changed", "removed", "added")


@query(
    f"""WITH {_RELATED}, {_compared("asked")}, st AS (SELECT *, {_STATUS} s0 FROM asked LEFT JOIN uc USING (before_id, after_id) LEFT JOIN ui USING (before_id, after_id)),
    s2 AS (SELECT *, CASE WHEN s0 = 'observed' THEN 'already_observed' ELSE s0 END status FROM st) SELECT status, count(*) relations, count(DISTINCT {_OID}) observations FROM s2 GROUP BY 1"""
)
def version_observations_again(spark: SparkSession, d: str) -> DataFrame:
    """A second run over the same readings finds every observation known."""
    asked = _related(spark, d)
    known = _observed(spark, d, asked).where("status = 'observed'").select("observation_id")
    return _observed(spark, d, asked, known).groupBy("status").agg(F.count("*").alias("relations"), F.count_distinct("observation_id").alias("observations"))


_WATCHED = f"asked AS (SELECT snapshot_id, p before_id, artifact_id after_id FROM {_STEP} WHERE p <> artifact_id)"


@query(
    f"""WITH {_WATCHED}, {_compared("asked")}, st AS (SELECT *, {_STATUS} s0 FROM asked LEFT JOIN uc USING (before_id, after_id) LEFT JOIN ui USING (before_id, after_id) LEFT JOIN vl USING (before_id, after_id)),
    s2 AS (SELECT *, CASE WHEN s0 = 'unchanged' THEN 'no_substantive_change' ELSE s0 END status FROM st) SELECT snapshot_id, status, {_OID} observation_id, units_changed, removed, added FROM s2"""
)
def watch_observations(spark: SparkSession, d: str) -> DataFrame:
    """What changed at each change that the visits of a source saw; going back and forth is two changes."""
    rows = table(spark, d, "source_snapshots", "snapshot_id", "source_id", "artifact_id", "retrieved_at").distinct()
    asked = changes.supersessions(rows).where("supersedes is not null").select("snapshot_id", F.col("supersedes").alias("before"), F.col("artifact_id").alias("after"))
    return _flat(_observed(spark, d, asked, unchanged="no_substantive_change", same="invalid_same_artifact")).select("snapshot_id", "status", "observation_id", "units_changed", "removed", "added")


@query(
    f"""WITH {_WATCHED}, {_compared("asked")}, st AS (SELECT *, {_STATUS} status FROM asked LEFT JOIN uc USING (before_id, after_id) LEFT JOIN ui USING (before_id, after_id)),
    ob AS (SELECT DISTINCT {_OID} observation_id, unnest([before_id, after_id]) artifact_id FROM st WHERE status = 'observed'),
    lx AS (SELECT * FROM (SELECT evidence_id, extraction_id, row_number() OVER (PARTITION BY evidence_id ORDER BY occurred_at DESC NULLS LAST, extraction_id DESC) rn FROM evidence_extractions) WHERE rn = 1)
    SELECT observation_id, u.evidence_id, artifact_id, a.sha256, lx.extraction_id, coalesce((SELECT count(DISTINCT source_id) FROM source_snapshots s JOIN sources o USING (source_id) WHERE s.artifact_id = ob.artifact_id), 0) sources
    FROM ob JOIN evidence_units u USING (artifact_id) LEFT JOIN artifacts a USING (artifact_id) LEFT JOIN lx ON lx.evidence_id = u.evidence_id"""
)
def observation_trace(spark: SparkSession, d: str) -> DataFrame:
    """The units, artifacts, newest readings and sources behind every observed change."""
    rows = table(spark, d, "source_snapshots", "snapshot_id", "source_id", "artifact_id", "retrieved_at").distinct()
    asked = changes.supersessions(rows).where("supersedes is not null").select("snapshot_id", F.col("supersedes").alias("before"), F.col("artifact_id").alias("after"))
    seen = _observed(spark, d, asked).where("status = 'observed'").select("observation_id", F.explode(F.array("before", "after")).alias("artifact_id"))
    latest = evidence.latest_extractions(table(spark, d, "evidence_extractions", "evidence_id", "extraction_id", "occurred_at"))
    origin = evidence.provenance(table(spark, d, "source_snapshots"), table(spark, d, "sources"))
    return observations.traced(seen, _units(spark, d), table(spark, d, "artifacts", "artifact_id", "sha256"), latest, origin)


@query(
    f"""WITH {_WATCHED}, {_compared("asked")}, st AS (SELECT *, {_STATUS} status FROM asked LEFT JOIN uc USING (before_id, after_id) LEFT JOIN ui USING (before_id, after_id) LEFT JOIN vl USING (before_id, after_id)),
    ob AS (SELECT DISTINCT {_OID} observation_id, coalesce(removed, '') || coalesce(added, '') v FROM st WHERE status = 'observed')
    SELECT 'lead:' || sha256('lead-package' || chr(31) || observation_id) lead_id, observation_id, contains(v, 'money:')::INTEGER + contains(v, 'date:')::INTEGER questions FROM ob WHERE contains(v, 'money:') OR contains(v, 'date:')"""
)
def packaged_leads(spark: SparkSession, d: str) -> DataFrame:
    """Observed changes of amounts or dates, each with what to ask about it."""
    rows = table(spark, d, "source_snapshots", "snapshot_id", "source_id", "artifact_id", "retrieved_at").distinct()
    asked = changes.supersessions(rows).where("supersedes is not null").select("snapshot_id", F.col("supersedes").alias("before"), F.col("artifact_id").alias("after"))
    seen = _observed(spark, d, asked).where("status = 'observed'").withColumn("v", F.concat("removed", "added"))
    has = lambda kind: F.exists("v", lambda v: v.startswith(f"{kind}:"))
    ask = F.array_compact(F.array(F.when(has("money"), "Which record explains the other amount?"), F.when(has("date"), "What is each date the date of?")))
    return observations.packaged(seen, ask, F.array(F.lit("An amendment or a correction."))).select("lead_id", "observation_id", F.size("questions").alias("questions"))


_STATUSES = ["pymupdf_native_text", "tesseract_ocr", "python_csv", "utf8_text"]
_EVENTS = """ev AS (SELECT DISTINCT evidence_id subject, occurred_at, method status, software_version reviewer, extraction_id rationale FROM evidence_extractions),
ch AS (SELECT *, CASE WHEN coalesce(status IN ('pymupdf_native_text', 'tesseract_ocr', 'python_csv', 'utf8_text'), false) = false THEN 'status not allowed' WHEN coalesce(trim(reviewer), '') = '' THEN 'reviewer cannot be empty'
  WHEN coalesce(trim(rationale), '') = '' THEN 'rationale cannot be empty' WHEN occurred_at IS NULL THEN 'time missing' WHEN subject NOT IN (SELECT evidence_id FROM evidence_units WHERE unit_type <> 'record') THEN 'unknown subject' END reason FROM ev),
ei AS (SELECT *, 'review-event:' || sha256(coalesce(subject, '') || chr(31) || coalesce(strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), '') || chr(31) || coalesce(status, '') || chr(31) || coalesce(reviewer, '') || chr(31) || coalesce(rationale, '')) event_id FROM ch)"""


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Readings as events on their units, units of one kind aside: they show every reason."""
    e = table(spark, d, "evidence_extractions", "evidence_id", "occurred_at", "method", "software_version", "extraction_id").toDF("subject", "occurred_at", "status", "reviewer", "rationale").distinct()
    subjects = table(spark, d, "evidence_units", "evidence_id", "unit_type").where("unit_type <> 'record'").select(F.col("evidence_id").alias("subject"))
    return subjects, observations.checked_events(e, subjects, _STATUSES)


@query(f"WITH {_EVENTS} SELECT event_id, subject, reason FROM ei")
def checked_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their identifiers, and why some are not taken."""
    return _events(spark, d)[1].select("event_id", "subject", "reason")


@query(
    f"""WITH {_EVENTS}, l AS (SELECT subject, arg_max(status, (occurred_at, event_id)) s FROM ei WHERE reason IS NULL GROUP BY 1)
    SELECT u.evidence_id subject, coalesce(s, 'candidate') status FROM (SELECT DISTINCT evidence_id FROM evidence_units WHERE unit_type <> 'record') u LEFT JOIN l ON l.subject = u.evidence_id"""
)
def current_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of each unit by its last taken event."""
    subjects, events = _events(spark, d)
    return observations.current_status(subjects, events.where("reason is null"), "candidate")
