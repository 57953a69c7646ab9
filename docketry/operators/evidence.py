"""Choosing, counting and tracing evidence: readings, units, artifacts, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: Column) -> DataFrame:
    """The whole row with the greatest ``order`` (a struct with a total order) of each group, combined before the shuffle.

    Null groups are a group; ties in order fall to either of equal rows; an empty input gives no row.
    """
    rest = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*group, *(F.col(f"_best.{c}").alias(c) for c in rest))


def quality_first() -> Column:
    """Highest quality (null lowest), then newest, then greatest id."""
    return F.struct(F.coalesce("quality_score", F.lit(-1.0)).alias("q"), F.col("occurred_at").alias("t"), F.col("extraction_id").alias("i"))


def newest_first() -> Column:
    return F.struct(F.col("occurred_at").alias("t"), F.col("extraction_id").alias("i"))


def preferred_extractions(extractions: DataFrame) -> DataFrame:
    """One reading per unit: quality before recency. A null time is earliest. See ``top_per_group``."""
    return top_per_group(extractions, ["evidence_id"], quality_first())


def latest_extractions(extractions: DataFrame) -> DataFrame:
    """One reading per unit by recency alone."""
    return top_per_group(extractions, ["evidence_id"], newest_first())


def preferred_evidence(units: DataFrame, extractions: DataFrame, keep_unread: bool = False) -> DataFrame:
    """Units with their preferred reading; ``keep_unread`` keeps units without any."""
    return units.join(preferred_extractions(extractions), "evidence_id", "left" if keep_unread else "inner")


def provenance(snapshots: DataFrame, sources: DataFrame) -> DataFrame:
    """(artifact_id, source_id, source_uri, source_name): the distinct sources of each artifact."""
    return snapshots.select("artifact_id", "source_id").distinct().join(sources.select("source_id", "source_uri", "source_name"), "source_id").select("artifact_id", "source_id", "source_uri", "source_name")


def review_queue(units: DataFrame, extractions: DataFrame, threshold: float) -> DataFrame:
    """Units whose preferred reading is missing or below the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    return preferred_evidence(units, extractions, keep_unread=True).where(F.coalesce("quality_score", F.lit(0.0)) < threshold)


def latest_per_source(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each source, by time and then id."""
    return top_per_group(snapshots, ["source_id"], F.struct("retrieved_at", "snapshot_id"))


def changed_sources(snapshots: DataFrame) -> DataFrame:
    """(source_id, artifacts): sources seen with more than one artifact."""
    return snapshots.groupBy("source_id").agg(F.count_distinct("artifact_id").alias("artifacts")).where("artifacts > 1")


def append_new(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not known yet, one per key: the only way rows enter an append-only table."""
    return new.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose non-null key no row of ``parent`` has."""
    ids = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(ids, key, "left_anti")


def substantive(units: DataFrame, extractions: DataFrame) -> DataFrame:
    """(artifact_id, has_text): whether any preferred reading of the artifact holds more than white space."""
    text = F.coalesce(F.col("extracted_text").rlike(r"(?U)\S"), F.lit(False))
    return preferred_evidence(units, extractions, keep_unread=True).groupBy("artifact_id").agg(F.bool_or(text).alias("has_text"))
