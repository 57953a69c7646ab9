"""Change capture over visits of sources: states, changes, gaps, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a visit (fixed values).
STATES = ("new", "unchanged", "changed", "unavailable")


def _state(previous: Column) -> Column:
    return F.when(F.col("artifact").isNull(), "unavailable").when(previous.isNull(), "new").when(previous == F.col("artifact"), "unchanged").otherwise("changed")


def visit_states(visits: DataFrame) -> DataFrame:
    """``visits`` (source, at, seq, artifact) with ``previous`` and ``state``.

    A visit is compared with the last successful one of its source, so a failed visit (null artifact)
    changes nothing, and going back to an earlier artifact is a change. Ties in time fall to ``seq``.
    """
    w = Window.partitionBy("source").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last("artifact", ignorenulls=True).over(w)
    return visits.withColumn("previous", previous).withColumn("state", _state(F.col("previous")))


def changes(states: DataFrame) -> DataFrame:
    return states.where("state <> 'unchanged'")


def latest_successful(visits: DataFrame) -> DataFrame:
    """(source, artifact): of each source the artifact of its last successful visit."""
    return visits.where("artifact is not null").groupBy("source").agg(F.max_by("artifact", F.struct("at", "seq")).alias("artifact"))


def state_counts(states: DataFrame) -> DataFrame:
    """(state, visits) with a row for every state, also those that don't occur."""
    every = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(states.groupBy("state").count(), "state", "left").select("state", F.coalesce("count", F.lit(0)).cast("long").alias("visits"))


def reversions(states: DataFrame) -> DataFrame:
    """Changes that go back to an artifact that the source had before."""
    w = Window.partitionBy("source", "artifact").orderBy("at", "seq")
    return states.where("artifact is not null").withColumn("times", F.row_number().over(w)).where("state = 'changed' and times > 1").drop("times")


def change_runs(states: DataFrame) -> DataFrame:
    """(source, run, artifact, first_at, last_at, visits): successive successful visits that saw the same artifact."""
    w = Window.partitionBy("source").orderBy("at", "seq")
    ok = states.where("artifact is not null").withColumn("run", F.sum((F.col("state") != "unchanged").cast("int")).over(w))
    return ok.groupBy("source", "run").agg(F.first("artifact").alias("artifact"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("visits"))


def sequence_gaps(numbers: DataFrame) -> DataFrame:
    """(grp, first, last, missing): numbers of each group that lie between its least and greatest and don't occur.

    ``missing`` is a row each; found from neighbours, so no group's numbers are collected.
    """
    w = Window.partitionBy("grp").orderBy("number")
    steps = numbers.where("grp is not null and number is not null").select("grp", "number").distinct().withColumn("next", F.lead("number").over(w))
    return steps.where("next > number + 1").select("grp", F.explode(F.sequence(F.col("number") + 1, F.col("next") - 1)).alias("missing"))


def supersessions(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the artifact that preceded theirs at the same source, where it differs."""
    w = Window.partitionBy("source_id").orderBy("retrieved_at", "snapshot_id")
    previous = F.lag("artifact_id").over(w)
    return snapshots.withColumn("supersedes", F.when(previous != F.col("artifact_id"), previous))
