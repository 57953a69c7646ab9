"""Visits over recorded responses: checks of what came, which failures are worth another try, and how files are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.ids import snapshot_id, source_id
from docketry.operators.evidence import append_new
from docketry.sources.addresses import part
from docketry.sources.documents import base_media


def download_error(content_type: Column, expected: Column, head: Column) -> Column:
    """Why a response can't be taken: another media type than expected, or a PDF without its first bytes; null if it can. ``head``: the first bytes in hexadecimal."""
    actual, wanted = base_media(content_type), base_media(expected)
    pdf = F.coalesce((actual == "application/pdf") | (wanted == "application/pdf"), F.lit(False))
    return F.when(actual.isNotNull() & wanted.isNotNull() & (actual != wanted), F.concat(F.lit("expected media type "), wanted, F.lit(", received "), actual)).when(pdf & ~F.coalesce(F.upper(head).startswith("255044462D"), F.lit(False)), "missing PDF magic bytes")


def retryable(status: Column) -> Column:
    """No answer at all, too many requests, or an error of the server."""
    return status.isNull() | (status == 429) | status.between(500, 599)


def visits(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """(visit, source, attempts, status, error, artifact): how each visit ends, from its attempts.

    ``attempts``: visit, source, attempt, status, content_type, expected, head, artifact. A visit ends with the
    first attempt that succeeds or fails for good, or with the last of ``retries``; later attempts never
    happened. A failed visit has no artifact, so it changes nothing in the ledger.
    """
    if retries < 1:
        raise ValueError("retries must be at least 1")
    s = F.col("status")
    wrong = download_error(F.col("content_type"), F.col("expected"), F.col("head"))
    error = F.when(s.isNull(), "no answer").when((s < 200) | (s >= 300), F.concat(F.lit("HTTP "), s.cast("string"))).otherwise(wrong)
    w = Window.partitionBy("visit").orderBy("attempt")
    rows = attempts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= retries).withColumn("error", error)
    ends = F.col("error").isNull() | ~retryable(s)
    last = F.min(F.when(ends, F.col("n"))).over(Window.partitionBy("visit"))
    most = F.max("n").over(Window.partitionBy("visit"))
    ended = rows.withColumn("at", F.coalesce(last, most)).where(F.col("n") == F.col("at"))
    return ended.select("visit", "source", F.col("n").alias("attempts"), "status", "error", F.when(F.col("error").isNull(), F.col("artifact")).alias("artifact"))


def blob_address(uri: Column, payload: Column, api: str, blobs: str) -> Column:
    """struct(uri, reason): the file that an envelope at ``uri`` points to, if host and tenant are as they must be.

    ``api`` is the suffix of the envelope's host, before which the tenant stands; ``blobs`` is the only host of files.
    """
    host = F.lower(part(uri, "HOST"))
    tenant = F.regexp_extract(host, rf"^([^.]+){api.replace('.', '[.]')}$", 1)
    blob = F.get_json_object(payload, "$.blobUri")
    reason = (
        F.when(~uri.startswith("https://") | (tenant == ""), "not one tenant's envelope").when(F.get_json_object(payload, "$").isNull(), "not a JSON object").when(F.coalesce(blob, F.lit("")) == "", "no blobUri")
        .when(~blob.startswith("https://") | (F.lower(part(blob, "HOST")) != blobs), "host not allowed").when(~part(blob, "PATH").startswith(F.concat(F.lit("/stream/"), F.upper(tenant), F.lit("/"))), "another tenant's path")
    )
    return F.struct(F.when(reason.isNull(), blob).alias("uri"), reason.alias("reason"))


def bytes_address(uri: Column, wrapper: Column) -> Column:
    """The byte route of a document, if the page at its address declares that route; null otherwise."""
    return F.when(wrapper.contains("DownloadFileBytes") & uri.contains("/DownloadFile/"), F.replace(uri, F.lit("/DownloadFile/"), F.lit("/DownloadFileBytes/")))


def blob_path(sha: Column) -> Column:
    """Where content of a hash is kept."""
    return F.concat(F.lit("sha256/"), F.left(sha, F.lit(2)), F.lit("/"), sha)


def store_blobs(files: DataFrame, folder: str) -> None:
    """Write ``files`` (content) by their hash, in folders by its first two digits; content that is there already is not written again."""
    rows = files.select("content").where("content is not null").withColumn("sha256", F.sha2("content", 256)).withColumn("prefix", F.left("sha256", F.lit(2)))
    try:
        known = files.sparkSession.read.parquet(folder).select("sha256")
    except Exception:  # nothing is kept yet
        known = rows.select("sha256").limit(0)
    append_new(rows, known, "sha256").write.mode("append").partitionBy("prefix").parquet(folder)


def damaged_blobs(kept: DataFrame) -> DataFrame:
    """(sha256): kept contents (sha256, content) that no longer have their hash."""
    return kept.where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def ingested(files: DataFrame, known_artifacts: DataFrame, known_snapshots: DataFrame) -> DataFrame:
    """(source_id, artifact_id, snapshot_id, sha256, byte_size, stored_path, new_artifact, new_snapshot) of ``files`` (source_uri, content).

    Equal content is one artifact and a source's visit of it one snapshot, known or not; repeated files count once.
    """
    rows = files.where("source_uri is not null and content is not null").select(source_id("source_uri").alias("source_id"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("byte_size")).distinct()
    rows = rows.withColumn("artifact_id", F.concat(F.lit("artifact:"), "sha256")).withColumn("snapshot_id", snapshot_id("source_id", "artifact_id")).withColumn("stored_path", blob_path(F.col("sha256")))
    a = known_artifacts.select("artifact_id", F.lit(False).alias("new_artifact")).distinct()
    s = known_snapshots.select("snapshot_id", F.lit(False).alias("new_snapshot")).distinct()
    out = rows.join(a, "artifact_id", "left").join(s, "snapshot_id", "left")
    return out.withColumn("new_artifact", F.coalesce("new_artifact", F.lit(True))).withColumn("new_snapshot", F.coalesce("new_snapshot", F.lit(True)))
