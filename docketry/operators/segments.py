"""Cutting texts into segments at anchors, and finding exact repeats of segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.ids import stable_id
from docketry.functions.text import folded, spans


@dataclass(frozen=True)
class Rule:
    """Segments start at matches of ``anchor_regex`` (Java syntax; its first group is the anchor)."""

    name: str
    source_name_regex: str
    anchor_regex: str
    segment_type: str
    min_chars: int = 0


def cut_segments(evidence: DataFrame, text: str, rules: list[Rule], version: str = "1") -> DataFrame:
    """One row per segment: from each anchor to the next or the text's end, trimmed; shorter ones are dropped.

    ``evidence`` has evidence_id, source_names (array) and the text. A rule applies to texts of which any
    source name matches. Rules are few and become part of the plan, so texts are never joined with them.
    What stands before the first anchor is in no segment; null texts have none.
    """
    out = None
    for r in rules:
        names = r.source_name_regex
        rows = evidence.where(F.exists("source_names", lambda n: n.rlike(names)))  # noqa: B023 - called at once
        rows = rows.withColumn("at", spans(F.col(text), r.anchor_regex))
        at = F.col("at")
        # an anchor's segment ends where the next one starts
        ends = F.concat(F.transform(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a: a["char_start"]), F.array(F.length(text)))
        both = F.zip_with(at, ends, lambda a, e: F.struct(a.alias("a"), e.alias("e")))
        hit = rows.where(F.size(at) > 0).select("evidence_id", text, F.explode(both).alias("z")).select("evidence_id", text, F.col("z.a").alias("a"), F.col("z.e").alias("e"))
        raw = hit.withColumn("raw", F.expr(f"substring({text}, a.char_start + 1, e - a.char_start)"))
        lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
        body = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
        cutout = raw.select(
            "evidence_id", F.lit(r.name).alias("rule_name"), F.lit(r.segment_type).alias("segment_type"),
            F.regexp_extract(F.col("a.raw"), r.anchor_regex, 1).alias("anchor_text"), body.alias("raw_text"),
            (F.col("a.char_start") + lead).alias("char_start"), F.lit(r.min_chars).alias("least"),
        )
        out = cutout if out is None else out.unionByName(cutout)
    if out is None:
        raise ValueError("a plan needs at least one rule")
    full = out.withColumn("normalized_text", folded("raw_text")).where(F.length("normalized_text") >= F.col("least"))
    full = full.withColumn("normalized_anchor", folded("anchor_text")).withColumn("text_sha256", F.sha2("normalized_text", 256)).withColumn("char_end", F.col("char_start") + F.length("raw_text"))
    return full.withColumn("segment_id", stable_id("segment", F.lit(version), "rule_name", "evidence_id", "char_start", "char_end", "text_sha256")).drop("least")


def with_anchor(segments: DataFrame, value: str, limit: int) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    wanted = " ".join(value.split()).casefold()
    return segments.where(F.col("normalized_anchor") == wanted).orderBy("artifact_id", "locator", "char_start", "segment_id").limit(limit)


def exact_repeats(segments: DataFrame, least: int) -> DataFrame:
    """(segment_type, text_sha256, text, occurrences, artifacts) of texts that stand in ``least`` artifacts or more."""
    groups = segments.groupBy("segment_type", "text_sha256").agg(F.min("normalized_text").alias("text"), F.count_distinct("segment_id").alias("occurrences"), F.count_distinct("artifact_id").alias("artifacts"))
    return groups.where(F.col("artifacts") >= least)
