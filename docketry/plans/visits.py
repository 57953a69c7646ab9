"""Queries over visits: user events stand for visits of sources, errors for failed ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import changes
from docketry.plans.registry import query
from docketry.session import cut, ensure_checkpoint_dir
from docketry.sources.tables import table
from docketry.streaming import ledger

_VISITS = """v AS (SELECT user_id::VARCHAR source, ts "at", event_id seq,
  CASE WHEN event_type <> 'error' THEN event_type || ':' || floor("value" / 50)::BIGINT::VARCHAR END artifact FROM events),
s AS (SELECT *, last_value(artifact IGNORE NULLS) OVER (PARTITION BY source ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) previous FROM v),
t AS (SELECT *, CASE WHEN artifact IS NULL THEN 'unavailable' WHEN previous IS NULL THEN 'new' WHEN previous = artifact THEN 'unchanged' ELSE 'changed' END state FROM s)
"""


def _visits(events: DataFrame) -> DataFrame:
    seen = F.concat_ws(":", "event_type", F.floor(F.col("value") / 50).cast("string"))
    seen = F.when((F.col("event_type") != "error") & F.col("value").isNotNull(), seen)
    return events.select(F.col("user_id").cast("string").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), seen.alias("artifact"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return changes.visit_states(_visits(table(spark, d, "events", "user_id", "ts", "event_id", "event_type", "value")))


@query(f"WITH {_VISITS} SELECT seq, source, artifact, previous, state FROM t")
def watch_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("seq", "source", "artifact", "previous", "state")


@query(f"WITH {_VISITS} SELECT seq, source, state FROM t WHERE state <> 'unchanged'")
def watch_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes.changes(_states(spark, d)).select("seq", "source", "state")


@query(f"WITH {_VISITS}, k(state) AS (VALUES ('new'), ('unchanged'), ('changed'), ('unavailable')) SELECT k.state, count(t.seq) visits FROM k LEFT JOIN t USING (state) GROUP BY 1")
def watch_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return changes.state_counts(_states(spark, d))


@query(f"WITH {_VISITS} SELECT source, arg_max(artifact, (\"at\", seq)) artifact FROM v WHERE artifact IS NOT NULL GROUP BY 1")
def latest_successful(spark: SparkSession, d: str) -> DataFrame:
    return changes.latest_successful(_visits(table(spark, d, "events", "user_id", "ts", "event_id", "event_type", "value")))


@query(
    f"""WITH {_VISITS}, n AS (SELECT *, row_number() OVER (PARTITION BY source, artifact ORDER BY "at", seq) times FROM t WHERE artifact IS NOT NULL)
    SELECT seq, source, artifact FROM n WHERE state = 'changed' AND times > 1"""
)
def watch_reversions(spark: SparkSession, d: str) -> DataFrame:
    """Changes back to what a source showed before."""
    return changes.reversions(_states(spark, d)).select("seq", "source", "artifact")


@query(
    f"""WITH {_VISITS}, r AS (SELECT *, sum(CASE WHEN state <> 'unchanged' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY "at", seq) run FROM t WHERE artifact IS NOT NULL)
    SELECT source, run::BIGINT run, any_value(artifact) artifact, min("at") first_at, max("at") last_at, count(*) visits FROM r GROUP BY source, run"""
)
def change_runs(spark: SparkSession, d: str) -> DataFrame:
    return changes.change_runs(_states(spark, d))


@query(f"WITH {_VISITS} SELECT seq, source, artifact, previous, state FROM t")
def watch_states_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same states from a stream of what there is, kept in a ledger batch by batch."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    visits = _visits(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*"))
    ledger.follow(visits, base).awaitTermination()
    return spark.read.parquet(f"{base}/ledger").select("seq", "source", "artifact", "previous", "state")


@query(f"WITH {_VISITS} SELECT seq, source, artifact, previous, state FROM t")
def watch_ledger_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same states from batches by day, each delivered with the day before it once more."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    visits = cut(_visits(table(spark, d, "events", "user_id", "ts", "event_id", "event_type", "value")))
    first, last = visits.agg(F.min("at"), F.max("at")).first()
    step = (last - first) / 3
    for batch in range(3):
        # a third of the time, after the third before it again
        upto = first + step * (batch + 1) if batch < 2 else last
        ledger.append_batch(visits.where(F.col("at").between(first + step * max(0, batch - 1), upto)), batch, base)
        if batch == 1:
            ledger.append_batch(visits.where(F.col("at").between(first, upto)), batch, base)
    return spark.read.parquet(f"{base}/ledger").select("seq", "source", "artifact", "previous", "state")
