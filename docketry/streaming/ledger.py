"""A ledger of visits that grows by micro-batches: states by SQL windows, each visit once, whatever is delivered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.changes import visit_states
from docketry.session import exists


def append_batch(visits: DataFrame, batch: int, folder: str, key: str = "seq") -> None:
    """Add a batch of ``visits`` (source, at, seq, artifact) with their states to the ledger below ``folder``.

    Visits whose ``key`` the ledger holds already are left out, repeated ones count once. The last artifact of
    each source is kept as a table by batch; a batch that is run again finds the table of the batch before it and
    overwrites its own output, so a repeated run changes nothing. States come from windows, which spill, so no
    source's visits meet in memory. A visit that arrives after a later one was taken is compared with that one.
    """
    spark = visits.sparkSession
    ledger, state = f"{folder}/ledger", f"{folder}/state"
    new = visits.dropDuplicates([key])
    if exists(spark, ledger):
        known = spark.read.parquet(ledger).where(F.col("batch") < batch).select(key)
        new = new.join(known, key, "left_anti")
    before = f"{state}/batch={batch - 1}"
    last = spark.read.parquet(before) if exists(spark, before) else spark.createDataFrame([], "source string, last string")
    # what was there before stands as a visit before all others
    start = last.join(new.select("source").distinct(), "source", "left_semi").select("source", F.lit(None).cast("timestamp").alias("at"), F.lit(-1).cast("long").alias("seq"), F.col("last").alias("artifact"), F.lit(True).alias("_old"))
    rows = visit_states(start.unionByName(new.select("source", "at", F.col("seq").cast("long").alias("seq"), "artifact", F.lit(False).alias("_old")))).where("not _old").drop("_old")
    rows.write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
    done = spark.read.parquet(f"{ledger}/batch={batch}").where("artifact is not null").groupBy("source").agg(F.max_by("artifact", F.struct("at", "seq")).alias("new"))
    last.join(done, "source", "full_outer").select("source", F.coalesce("new", "last").alias("last")).write.mode("overwrite").parquet(f"{state}/batch={batch}")


def follow(visits: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Keep the ledger below ``folder`` up with a streaming ``visits``; ``once``: take what there is and end."""
    writer = visits.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, batch, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def index_batch(docs: DataFrame, batch: int, folder: str, key: str, text: str) -> None:
    """Add the postings of a micro-batch of texts to a lexical index below ``folder``; a batch run again replaces its own."""
    from docketry.operators import search

    built = search.build(docs, key, text)
    built.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={batch}")
    built.totals.write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")


def index_of(spark, folder: str):
    """The index that batches have made, its totals summed over them."""
    from docketry.operators.search import LexicalIndex

    totals = spark.read.parquet(f"{folder}/totals").agg(F.sum("n_docs").alias("n_docs"), (F.sum(F.col("avgdl") * F.col("n_docs")) / F.sum("n_docs")).alias("avgdl"))
    return LexicalIndex(spark.read.parquet(f"{folder}/postings").drop("batch"), totals)
