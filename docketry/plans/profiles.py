"""Queries that profile artifacts, contexts, relations and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import folded
from docketry.operators import evidence, facts, layout, linkage
from docketry.plans.analytics import _REGIONS, _regions
from docketry.plans.evidence import _PREFERRED, _readings, _units
from docketry.plans.indexes import _TEXTS, preferred_text
from docketry.plans.registry import query
from docketry.sources import links
from docketry.sources.tables import table


@query(
    f"""SELECT u.artifact_id, count(*) pages, count(*) FILTER (WHERE trim(p.extracted_text) <> '') nonblank, count(*) FILTER (WHERE coalesce(p.quality_score, 0) < 0.7) low,
    count(DISTINCT p.method) methods, min(CASE WHEN regexp_matches(u.locator, '^page:\\d+$') THEN substr(u.locator, 6)::INTEGER END) first_page,
    max(CASE WHEN regexp_matches(u.locator, '^page:\\d+$') THEN substr(u.locator, 6)::INTEGER END) last_page
    FROM evidence_units u LEFT JOIN ({_PREFERRED}) p USING (evidence_id) WHERE u.unit_type = 'page' GROUP BY 1"""
)
def page_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each artifact: how many are read, how well, by how many methods."""
    rows = evidence.preferred_evidence(_units(spark, d).where("unit_type = 'page'"), _readings(spark, d, "method", "extracted_text"), keep_unread=True)
    page = F.regexp_extract("locator", r"^page:(\d+)$", 1)
    number = F.when(page != "", page.cast("int"))
    return rows.groupBy("artifact_id").agg(
        F.count("*").alias("pages"), F.count_if(F.trim("extracted_text") != "").alias("nonblank"), F.count_if(F.coalesce("quality_score", F.lit(0.0)) < 0.7).alias("low"),
        F.count_distinct("method").alias("methods"), F.min(number).alias("first_page"), F.max(number).alias("last_page"),
    )


@query(
    """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY occurred_at DESC NULLS LAST, extraction_id DESC, coalesce(quality_score, -1) DESC) rn
      FROM evidence_extractions) WHERE rn = 1)
    SELECT u.unit_type, count(*) FILTER (WHERE coalesce(l.quality_score, 0) < 0.7) needs_review FROM evidence_units u LEFT JOIN l USING (evidence_id) GROUP BY 1"""
)
def needs_review_latest(spark: SparkSession, d: str) -> DataFrame:
    """Units to review by their newest reading, where ``review_count`` goes by the preferred one."""
    newest = F.struct("occurred_at", "extraction_id", F.coalesce("quality_score", F.lit(-1.0)).alias("q"))
    rows = _units(spark, d).join(evidence.top_per_group(_readings(spark, d), ["evidence_id"], newest), "evidence_id", "left")
    return rows.groupBy("unit_type").agg(F.count_if(F.coalesce("quality_score", F.lit(0.0)) < 0.7).alias("needs_review"))


@query(
    """SELECT extraction_id, count(*) n_rows, count(DISTINCT md5(coalesce(extracted_text, '-'))) texts, count(DISTINCT coalesce(quality_score, -1)) scores FROM evidence_extractions GROUP BY 1 HAVING count(*) > 1"""
)
def repeated_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings that stand in several rows, and whether these agree."""
    rows = table(spark, d, "evidence_extractions", "extraction_id", "extracted_text", "quality_score")
    out = rows.groupBy("extraction_id").agg(F.count("*").alias("n_rows"), F.count_distinct(F.md5(F.coalesce("extracted_text", F.lit("-")))).alias("texts"), F.count_distinct(F.coalesce("quality_score", F.lit(-1.0))).alias("scores"))
    return out.where("n_rows > 1")


@query(
    """WITH n AS (SELECT DISTINCT s.artifact_id, lower(trim(regexp_replace(o.source_name, '\\s+', ' ', 'g'))) name FROM source_snapshots s JOIN sources o USING (source_id) WHERE o.source_name IS NOT NULL)
    SELECT artifact_id, count(*) names, CASE WHEN count(*) = 1 THEN min(name) END name FROM n GROUP BY 1"""
)
def artifact_names(spark: SparkSession, d: str) -> DataFrame:
    """The name that all of an artifact's sources give it, without regard to case and spacing; null where they differ."""
    names = evidence.provenance(table(spark, d, "source_snapshots"), table(spark, d, "sources")).where("source_name is not null").select("artifact_id", folded("source_name").alias("name")).distinct()
    return names.groupBy("artifact_id").agg(F.count("*").alias("names"), F.min("name").alias("least")).select("artifact_id", "names", F.when(F.col("names") == 1, F.col("least")).alias("name"))


_LATEST = "(SELECT source_id, arg_max(artifact_id, (retrieved_at, snapshot_id)) artifact_id FROM source_snapshots WHERE retrieved_at IS NOT NULL GROUP BY 1)"


@query(
    f"""SELECT DISTINCT r.relation_id, CASE WHEN a.artifact_id IS NULL OR b.artifact_id IS NULL THEN 'missing_artifact' WHEN a.artifact_id = b.artifact_id THEN 'same_artifact' ELSE 'comparable' END status
    FROM source_relations r LEFT JOIN {_LATEST} a ON a.source_id = r.source_id LEFT JOIN {_LATEST} b ON b.source_id = r.related_source_id WHERE r.relation_type = 'historical_version_of'"""
)
def version_relation_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether the latest artifacts of two versions can be compared."""
    rows = table(spark, d, "source_snapshots", "source_id", "artifact_id", "retrieved_at", "snapshot_id").where("retrieved_at is not null")
    latest = evidence.latest_per_source(rows).select("source_id", "artifact_id")
    r = table(spark, d, "source_relations", "relation_id", "source_id", "related_source_id", "relation_type").where("relation_type = 'historical_version_of'").distinct()
    both = r.join(latest.toDF("source_id", "a"), "source_id", "left").join(latest.toDF("related_source_id", "b"), "related_source_id", "left")
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing_artifact").when(F.col("a") == F.col("b"), "same_artifact").otherwise("comparable")
    return both.select("relation_id", status.alias("status")).distinct()


@query(
    """WITH s AS (SELECT DISTINCT snapshot_id, source_id, artifact_id, retrieved_at FROM source_snapshots),
    t AS (SELECT s.*, a.byte_size, lag(s.artifact_id) OVER w p, lag(a.byte_size) OVER w pb FROM s JOIN artifacts a USING (artifact_id) WINDOW w AS (PARTITION BY source_id ORDER BY retrieved_at NULLS FIRST, snapshot_id))
    SELECT snapshot_id, source_id, p = artifact_id same_artifact, byte_size - pb byte_delta FROM t WHERE p IS NOT NULL"""
)
def artifact_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Successive artifacts of each source: the same or not, and by how many bytes they differ."""
    s = table(spark, d, "source_snapshots", "snapshot_id", "source_id", "artifact_id", "retrieved_at").distinct().join(table(spark, d, "artifacts", "artifact_id", "byte_size"), "artifact_id")
    w = Window.partitionBy("source_id").orderBy("retrieved_at", "snapshot_id")
    rows = s.withColumn("p", F.lag("artifact_id").over(w)).withColumn("pb", F.lag("byte_size").over(w)).where("p is not null")
    return rows.select("snapshot_id", "source_id", (F.col("p") == F.col("artifact_id")).alias("same_artifact"), (F.col("byte_size") - F.col("pb")).alias("byte_delta"))


@query(
    """SELECT fact_type, normalized_text AS "value", count(DISTINCT evidence_id) units, count(DISTINCT artifact_id) artifacts FROM evidence_facts
    WHERE normalized_text IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT evidence_id) > 1"""
)
def fact_value_sets(spark: SparkSession, d: str) -> DataFrame:
    """Values that several units state."""
    rows = table(spark, d, "evidence_facts", "fact_type", "normalized_text", "evidence_id", "artifact_id").where("normalized_text is not null")
    return rows.groupBy("fact_type", F.col("normalized_text").alias("value")).agg(F.count_distinct("evidence_id").alias("units"), F.count_distinct("artifact_id").alias("artifacts")).where("units > 1")


@query(
    """SELECT fact_type, max(numeric_value) most, max(numeric_value) + greatest(2 * abs(max(numeric_value)), 1e6) + 12345.67 negative FROM evidence_facts
    WHERE numeric_value IS NOT NULL GROUP BY 1"""
)
def negative_controls(spark: SparkSession, d: str) -> DataFrame:
    """A value of each kind that no fact has, far beyond the greatest."""
    most = F.max("numeric_value")
    rows = table(spark, d, "evidence_facts", "fact_type", "numeric_value").where("numeric_value is not null")
    return rows.groupBy("fact_type").agg(most.alias("most"), (most + F.greatest(2 * F.abs(most), F.lit(1e6)) + 12345.67).alias("negative"))


@query(
    f"""WITH f AS (SELECT DISTINCT fact_id, evidence_id, char_start s, char_end e FROM evidence_facts WHERE fact_type = 'money' AND char_start IS NOT NULL AND char_end IS NOT NULL)
    SELECT fact_id, sha256(lower(trim(regexp_replace(substr(extracted_text, greatest(s - 80, 0) + 1, e + 80 - greatest(s - 80, 0)), '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')))) context_sha256
    FROM f JOIN {_TEXTS} t USING (evidence_id)"""
)
def money_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the folded text around every amount with a place."""
    f = table(spark, d, "evidence_facts", "fact_id", "evidence_id", "fact_type", "char_start", "char_end").where("fact_type = 'money' and char_start is not null and char_end is not null").distinct()
    both = f.join(preferred_text(spark, d), "evidence_id")
    return both.select("fact_id", F.sha2(linkage.context(F.col("extracted_text"), F.col("char_start"), F.col("char_end"), 80), 256).alias("context_sha256"))


@query()
def anchored_money(spark: SparkSession, d: str) -> DataFrame:
    """Recorded amounts whose span is that of an amount that the text's patterns find."""
    found = preferred_text(spark, d).select("evidence_id", F.explode(facts.prose_money(F.col("extracted_text"))).alias("m")).select("evidence_id", F.col("m.char_start").alias("char_start"), F.col("m.char_end").alias("char_end"), F.col("m.normalized_text").alias("found"))
    f = table(spark, d, "evidence_facts", "fact_id", "evidence_id", "fact_type", "char_start", "char_end").where("fact_type = 'money'").distinct()
    return f.join(found, ["evidence_id", "char_start", "char_end"]).select("fact_id", "evidence_id", "found")


@query("SELECT source_id, row_number() OVER (ORDER BY sha256(source_uri), source_uri) rank FROM sources ORDER BY 2 LIMIT 32")
def source_hash_rank(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty-two sources by the hash of their address."""
    top = links.stable_sample(table(spark, d, "sources", "source_id", "source_uri"), "source_uri", 32)
    w = Window.orderBy(F.sha2("source_uri", 256), "source_uri")  # of thirty-two rows
    return top.select("source_id", F.row_number().over(w).alias("rank"))


@query(
    """WITH k AS (SELECT DISTINCT source_id, artifact_id FROM source_snapshots), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sha256(artifact_id), artifact_id) r FROM k)
    SELECT source_id, artifact_id FROM r ORDER BY r > 1, sha256(artifact_id), artifact_id, source_id LIMIT 8"""
)
def distinct_first_sample(spark: SparkSession, d: str) -> DataFrame:
    """Eight artifacts, of as many sources as there are, by hash."""
    rows = table(spark, d, "source_snapshots", "source_id", "artifact_id").distinct()
    return links.distinct_first_sample(rows, "artifact_id", "source_id", 8).select("source_id", "artifact_id")


@query(
    """WITH h AS (SELECT DISTINCT regexp_extract(source_uri, '^(https?://[^/]+)', 1) host FROM sources)
    SELECT host || '/Calendar?year=' || y || '&month=' || m uri, y AS "year", m AS "month" FROM h, (SELECT unnest([2024, 2025]) y), (SELECT unnest(range(1, 13))::INTEGER m)"""
)
def calendar_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every month's calendar, of each host and two years."""
    hosts = table(spark, d, "sources", "source_uri").select(F.regexp_extract("source_uri", r"^(https?://[^/]+)", 1).alias("host")).distinct()
    every = hosts.withColumn("year", F.explode(F.array(F.lit(2024), F.lit(2025)))).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return every.select(F.concat("host", F.lit("/Calendar?year="), "year", F.lit("&month="), "month").alias("uri"), "year", "month")


@query(
    f"""WITH {_REGIONS}, b AS (SELECT page, s_region, min(distance) x FROM d GROUP BY 1, 2)
    SELECT page, count(*) regions, round(min(x), 2) least, round(median(x), 2) middle, round(max(x), 2) most FROM b GROUP BY 1"""
)
def nearest_distance_summary(spark: SparkSession, d: str) -> DataFrame:
    """Distances to the nearest region, by page."""
    near = layout.nearest(_regions(spark, d))
    return near.groupBy("page").agg(F.count("*").alias("regions"), F.round(F.min("distance"), 2).alias("least"), F.round(F.median("distance"), 2).alias("middle"), F.round(F.max("distance"), 2).alias("most"))


@query(
    f"""WITH {_REGIONS}, n AS (SELECT page, s_region, t_region, row_number() OVER (PARTITION BY page, s_region ORDER BY distance, abs(t_region - s_region), t_region) rank FROM d WHERE distance <= 8)
    SELECT page, s_region, count(*) neighbours, min(t_region) FILTER (WHERE rank = 1) nearest FROM n WHERE rank <= 12 GROUP BY 1, 2"""
)
def bounded_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Up to twelve neighbours of each region within a distance."""
    near = layout.within(_regions(spark, d), 8.0, 12)
    return near.groupBy("page", "s_region").agg(F.count("*").alias("neighbours"), F.min(F.when(F.col("rank") == 1, F.col("t_region"))).alias("nearest"))
