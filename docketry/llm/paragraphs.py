"""Repeated paragraphs by MinHash banding: tuned bands, verified similarity, removals by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.chosen_path import verified
from docketry.llm.components import connected_groups
from docketry.llm.hashing import TokenHasher, minima, mix, seeds, shingles
from docketry.session import cut

_U = np.uint64


def tuned_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): of bandings with at most ``most`` hashes that let a pair of just ``threshold`` collide with a chance of ``recall``, the one of most rows and then fewest bands."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding of so few hashes reaches that recall")


def _banded(size: int, bands: int, rows: int):
    seed = seeds(bands * rows, salt=3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHasher()
        for batch in batches:
            values, runs = shingles([t.lower() for t in batch.column("text").to_pylist()], size, hasher)
            keep = runs > 0
            if not keep.any():
                continue
            least = minima(values, runs[keep], seed)
            with np.errstate(over="ignore"):
                key = np.repeat(mix(np.arange(bands, dtype=_U))[None, :], len(least), axis=0)
                for r in range(rows):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + least[:, r::rows])
            ids = batch.column("id").to_numpy()[keep]
            yield pa.record_batch({"band": pa.array(key.T.reshape(-1).view(np.int64)), "id": pa.array(np.tile(ids, bands))})

    return run


def similar_paragraphs(texts: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(a, b, similarity): pairs of different ``texts`` (id long, text) that collide in a band and whose sets of ``size`` tokens in a row have a Jaccard similarity of ``threshold``.

    Texts must be distinct, so a paragraph that stands in a million records is one member of its buckets; what is
    left in a bucket differs and is nearly all similar. Only buckets of two or more are joined.
    """
    bands, rows = tuned_bands(threshold, recall)
    posts = cut(texts.mapInArrow(_banded(size, bands, rows), "band long, id long"))
    # written, so that the join can split a hot bucket
    several = cut(posts.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"))
    met = cut(posts.join(several, "band"))
    pairs = met.withColumnRenamed("id", "a").join(met.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b").distinct()
    return verified(texts.withColumn("text", F.lower("text")), pairs, size, threshold)


def repeated(rows: DataFrame, key: str, group: str, text: str, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, paragraphs, repeated, removable) of every record with paragraphs of at least ``size`` tokens.

    Paragraphs end at blank lines. Those that are equal or similar, directly or not, are one cluster; of each
    cluster the paragraph of the least (key, place) stays and the others are removable; ``repeated`` counts
    those whose cluster stands in records of two groups or more. Null keys, groups and texts are ignored;
    repeated rows count once; an empty input gives no row. Long texts are cut like any other.
    """
    records = rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(text).alias("text")).where("key is not null and grp is not null and text is not null")
    parts = records.select("key", "grp", F.posexplode(F.split("text", r"\r?\n[ \t]*\r?\n\s*")).alias("place", "text"))
    enough = rf"(?i)(?:[a-z0-9]+[^a-z0-9]+){{{size - 1}}}[a-z0-9]"
    parts = parts.where(F.col("text").rlike(enough)).withColumn("class", F.unhex(F.md5(F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")))))
    classes = cut(parts.groupBy("class").agg(F.min("text").alias("text")).withColumn("id", F.monotonically_increasing_id()))
    placed = cut(parts.select("key", "grp", "place", "class").distinct().join(classes.select("class", "id"), "class").drop("class"))
    linked = connected_groups(similar_paragraphs(classes.select("id", "text"), size, threshold), "a", "b")
    clusters = cut(placed.join(linked, "id", "left").select("key", "grp", "place", F.coalesce("group_id", "id").alias("cluster")))
    seen = cut(clusters.groupBy("cluster").agg(F.min(F.struct("key", "place")).alias("first"), (F.min("grp") < F.max("grp")).alias("wide")))
    marked = clusters.join(seen, "cluster")
    stays = (F.col("key") == F.col("first.key")) & (F.col("place") == F.col("first.place"))
    out = marked.groupBy("key").agg(F.count("*").alias("paragraphs"), F.count_if("wide").alias("repeated"), F.count_if(~stays).alias("removable"))
    return out.withColumnRenamed("key", key)
