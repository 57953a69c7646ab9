"""Observations of change between versions, with what they rest on; events that are appended and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.ids import stable_id
from docketry.operators import evidence
from docketry.session import cut


def fingerprint(*parts: Column) -> Column:
    """Aggregate: one hash over all rows of a group, whatever their order and number, without bringing them together.

    The sum of 60-bit hashes of the rows with their count; null parts count as empty.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    total = F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), total.cast("string")), 256)


def latest_artifacts(ledger: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(source_id, artifact_id): by the ledger of visits (source_id, at, seq, artifact_id) where it has a successful one, else by snapshots."""
    own = ledger.where("artifact_id is not null").groupBy("source_id").agg(F.max_by("artifact_id", F.struct("at", "seq")).alias("own"))
    kept = evidence.latest_per_source(snapshots.where("retrieved_at is not null").select("source_id", "artifact_id", "retrieved_at", "snapshot_id")).select("source_id", "artifact_id")
    return kept.join(own, "source_id", "full_outer").select("source_id", F.coalesce("own", "artifact_id").alias("artifact_id"))


def changes_of_pairs(pairs: DataFrame, units: DataFrame, values: DataFrame) -> DataFrame:
    """(before, after, units_changed, removed, added, inputs) of different artifacts compared.

    ``pairs``: before, after; ``units``: artifact_id, unit_type, locator, evidence_id, extraction_id, text - the
    preferred reading of every unit; ``values``: artifact_id, kind, value - one row for each time an artifact
    states it. Units are aligned by type and locator; ``removed`` and ``added`` are arrays of kind:value, sorted,
    a value as often as it went or came; ``units_changed`` is null where neither side has a unit; ``inputs`` is a fingerprint of the readings compared. Each pair is
    compared once, however many relations name it.
    """
    by = ["before", "after"]
    pairs = cut(pairs.select(*by).distinct())
    side = lambda c: pairs.join(units.withColumnRenamed("artifact_id", c), c)
    b = side("before").select(*by, "unit_type", "locator", F.md5(F.coalesce("text", F.lit(""))).alias("hb"), F.lit(1).alias("in_b"))
    a = side("after").select(*by, "unit_type", "locator", F.md5(F.coalesce("text", F.lit(""))).alias("ha"), F.lit(1).alias("in_a"))
    both = b.join(a, [*by, "unit_type", "locator"], "full_outer")
    differ = F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull() | (F.col("ha") != F.col("hb")))
    changed = both.groupBy(*by).agg(differ.alias("units_changed"))
    seen = side("before").withColumn("side", F.lit("before")).unionByName(side("after").withColumn("side", F.lit("after")))
    inputs = seen.groupBy(*by).agg(fingerprint(F.col("side"), F.col("unit_type"), F.col("locator"), F.col("evidence_id"), F.coalesce("extraction_id", F.lit("none"))).alias("inputs"))
    counted = values.groupBy("artifact_id", "kind", "value").agg(F.count("*").alias("n"))
    stated = lambda c, name: pairs.join(counted.withColumnRenamed("artifact_id", c), c).select(*by, "kind", "value", F.col("n").alias(name))
    diff = stated("before", "nb").join(stated("after", "na"), [*by, "kind", "value"], "full_outer").withColumn("d", F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).where("d <> 0")
    named = F.concat_ws(":", "kind", "value")
    lists = diff.groupBy(*by).agg(*(F.array_sort(F.flatten(F.collect_list(F.when(cond, F.array_repeat(named, F.abs("d").cast("int")))))).alias(name) for name, cond in (("removed", F.col("d") < 0), ("added", F.col("d") > 0))))
    none = F.array().cast("array<string>")
    out = pairs.join(changed, by, "left").join(inputs, by, "left").join(lists, by, "left")
    return out.select(*by, "units_changed", F.coalesce("removed", none).alias("removed"), F.coalesce("added", none).alias("added"), "inputs")


def observed(asked: DataFrame, compared: DataFrame, substantive: DataFrame, known: DataFrame, unchanged: str = "unchanged", same: str = "same_artifact") -> DataFrame:
    """``asked`` (before, after and others) with status and observation_id.

    In this order: missing_artifact, ``same``, insufficient_evidence (a side whose preferred readings hold no
    text), ``unchanged``, already_observed (its identifier is in ``known``, column observation_id), observed. The
    identifier is hashed from both artifacts and the readings compared, so a new reading makes a new observation
    and a repeated run adds nothing.
    """
    full = substantive.where("has_text").select("artifact_id")
    rows = asked.join(full.select(F.col("artifact_id").alias("before"), F.lit(True).alias("_fb")), "before", "left").join(full.select(F.col("artifact_id").alias("after"), F.lit(True).alias("_fa")), "after", "left")
    rows = rows.join(compared, ["before", "after"], "left")
    oid = stable_id("observation", F.lit("version_change"), "before", "after", "inputs")
    rows = rows.withColumn("_id", F.when(F.col("units_changed") > 0, oid)).join(known.select(F.col("observation_id").alias("_id"), F.lit(True).alias("_known")).distinct(), "_id", "left")
    status = (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "missing_artifact").when(F.col("before") == F.col("after"), same).when(F.col("_fb").isNull() | F.col("_fa").isNull(), "insufficient_evidence")
        .when(F.coalesce("units_changed", F.lit(0)) == 0, unchanged).when(F.col("_known"), "already_observed").otherwise("observed")
    )
    out = rows.withColumn("status", status).withColumn("observation_id", F.when(F.col("status").isin("observed", "already_observed"), F.col("_id")))
    return out.select(*asked.columns, "status", "observation_id", "units_changed", "removed", "added")


def traced(observations: DataFrame, units: DataFrame, artifacts: DataFrame, latest: DataFrame, provenance: DataFrame) -> DataFrame:
    """(observation_id, evidence_id, artifact_id, sha256, extraction_id, sources): all that observations (observation_id, artifact_id) rest on.

    A unit without a reading and an artifact without a source stay, with null and no sources.
    """
    origin = provenance.groupBy("artifact_id").agg(F.count_distinct("source_id").alias("sources"))
    rows = observations.distinct().join(units.select("artifact_id", "evidence_id"), "artifact_id").join(artifacts.select("artifact_id", "sha256"), "artifact_id", "left")
    rows = rows.join(latest.select("evidence_id", "extraction_id"), "evidence_id", "left").join(origin, "artifact_id", "left")
    return rows.select("observation_id", "evidence_id", "artifact_id", "sha256", "extraction_id", F.coalesce("sources", F.lit(0)).alias("sources"))


def packaged(observations: DataFrame, questions: Column, explanations: Column) -> DataFrame:
    """(lead_id, observation_id, questions, explanations) of observations that have a question and an ordinary explanation; others are left out."""
    rows = observations.select("observation_id", questions.alias("questions"), explanations.alias("explanations")).where("size(questions) > 0 and size(explanations) > 0").dropDuplicates(["observation_id"])
    return rows.select(stable_id("lead", F.lit("lead-package"), "observation_id").alias("lead_id"), "observation_id", "questions", "explanations")


def checked_events(events: DataFrame, subjects: DataFrame, statuses: list[str]) -> DataFrame:
    """``events`` (subject, occurred_at, status, reviewer, rationale) with event_id and the first reason not to take it, null if none."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = events.join(subjects.select("subject", F.lit(True).alias("_known")).distinct(), "subject", "left")
    reason = (
        F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "status not allowed").when(blank("reviewer"), "reviewer cannot be empty").when(blank("rationale"), "rationale cannot be empty")
        .when(F.col("occurred_at").isNull(), "time missing").when(F.col("_known").isNull(), "unknown subject")
    )
    eid = stable_id("review-event", "subject", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "status", "reviewer", "rationale")
    return rows.withColumn("event_id", eid).withColumn("reason", reason).drop("_known")


def current_status(subjects: DataFrame, events: DataFrame, stored: str) -> DataFrame:
    """(subject, status): of the last event by time and identifier, or the stored status where there is none."""
    last = events.groupBy("subject").agg(F.max_by("status", F.struct("occurred_at", "event_id")).alias("last"))
    return subjects.select("subject").distinct().join(last, "subject", "left").select("subject", F.coalesce("last", F.lit(stored)).alias("status"))
