"""Near-duplicate candidates through shared shingles, families of sources, clusters and their facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.ids import stable_id
from docketry.functions.text import shingles
from docketry.session import cut, release


def smallest_reachable(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root): every id at either end with the least id linked to it, directly or not.

    Least labels spread along edges and jump to their label's label, so long chains take few rounds. Each
    round is written to the shared checkpoint folder. Null ends are ignored, loops are groups of their own.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        step = labels.join(near, "x", "left").select("x", "root", F.least("root", F.coalesce("r", "root")).alias("new"))
        jump = labels.select(F.col("x").alias("new"), F.col("root").alias("far"))
        after = cut(step.join(jump, "new", "left").select("x", F.least("new", F.coalesce("far", "new")).alias("new"), "root"))
        release(labels)
        moved = not after.where("new <> root").isEmpty()
        labels = after.select("x", F.col("new").alias("root"))
        if not moved:
            return labels.withColumnRenamed("x", "id")
        labels = cut(labels)
        release(after)


def families(sources: DataFrame, relations: DataFrame, relation_type: str) -> DataFrame:
    """(source_id, root): sources linked by one relation type; a source without links is its own family."""
    linked = smallest_reachable(relations.where(F.col("relation_type") == relation_type), "source_id", "related_source_id")
    return sources.select("source_id").distinct().join(linked.withColumnRenamed("id", "source_id"), "source_id", "left").select("source_id", F.coalesce("root", "source_id").alias("root"))


def family_ids(members: DataFrame) -> DataFrame:
    """(root, family_id, members): the identifier hashed from the sorted members of each family."""
    groups = members.groupBy("root").agg(F.array_sort(F.collect_set("source_id")).alias("m"))
    return groups.select("root", stable_id("source-family", F.array_join("m", "\x1f")).alias("family_id"), F.size("m").alias("members"))


def artifact_families(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """(artifact_id, family): the source families that publish each artifact; ``members`` as ``families`` gives them."""
    return snapshots.select("artifact_id", "source_id").distinct().join(members, "source_id").select("artifact_id", F.col("root").alias("family")).distinct()


def sharing_family(pairs: DataFrame, homes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of artifacts with ``shared``: whether any family publishes both."""
    left, right = homes.toDF("a", "fa"), homes.toDF("b", "fb")
    both = pairs.select("a", "b").distinct().join(left, "a", "left").join(right, "b", "left")
    return both.groupBy("a", "b").agg(F.coalesce(F.bool_or(F.col("fa") == F.col("fb")), F.lit(False)).alias("shared"))


def occurrences(segments: DataFrame, homes: DataFrame) -> DataFrame:
    """Segments (with artifact_id, normalized_text and others) once for each family that publishes them; ``id`` names the occurrence.

    A segment whose artifact no known source publishes occurs in no family.
    """
    return segments.join(homes, "artifact_id").withColumn("id", F.concat_ws("|", "family", "segment_id")).withColumn("text", F.col("normalized_text"))


def _sets(occurrences: DataFrame, size: int) -> DataFrame:
    hashed = F.transform(shingles("text", size), lambda x: F.xxhash64(x))
    return cut(occurrences.select("id", "family", hashed.alias("s")).where(F.size("s") > 0).withColumn("n", F.monotonically_increasing_id()))


def _proposed(sets: DataFrame, most_frequent: int) -> tuple[DataFrame, DataFrame]:
    """((t, c): how many occurrences have a shingle; (n, nb, f, fb): one row per shared shingle that isn't too common)."""
    posts = sets.select("n", F.xxhash64("family").alias("f"), F.explode("s").alias("t"))
    counts = posts.groupBy("t").agg(F.count("*").alias("c"))
    # written, as a join with an aggregate just made is never split
    rare = cut(counts.where(F.col("c").between(2, most_frequent)).select("t"))
    kept = posts.join(rare, "t")
    other = kept.select("t", F.col("n").alias("nb"), F.col("f").alias("fb"))
    return counts, kept.join(other, "t").where("n < nb")


def near_duplicates(occurrences: DataFrame, size: int, threshold: float, least_shared: int, most_frequent: int) -> DataFrame:
    """(a, b, shared, similarity): pairs of occurrences (id, family, text) of different families.

    Candidates share ``least_shared`` shingles or more among those that stand in at most ``most_frequent``
    occurrences; the cap is part of the definition: commoner shingles propose no pair but count in the
    similarity. Pairs come from buckets of bounded size, so no bucket can grow hot.
    """
    _check(size, threshold, least_shared, most_frequent)
    sets = _sets(occurrences, size)
    pairs = _proposed(sets, most_frequent)[1].where("f <> fb").groupBy("n", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= least_shared).select("n", "nb")
    return _compared(sets, pairs).where(F.col("similarity") >= threshold)


def _compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    right = sets.select(F.col("n").alias("nb"), F.col("id").alias("id_b"), F.col("s").alias("sb"))
    both = pairs.join(sets.select("n", "id", "s"), "n").join(right, "nb").withColumn("shared", F.size(F.array_intersect("s", "sb")))
    ratio = F.col("shared") / (F.size("s") + F.size("sb") - F.col("shared"))
    return both.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"), F.col("shared").cast("long").alias("shared"), ratio.alias("similarity"))


def near_duplicate_counters(occurrences: DataFrame, size: int, threshold: float, least_shared: int, most_frequent: int) -> DataFrame:
    """One row telling how much work ``near_duplicates`` spares: occurrences, possible_pairs, generated, compared, matched, same_family, common_ignored."""
    _check(size, threshold, least_shared, most_frequent)
    sets = _sets(occurrences, size)
    counts, shared = _proposed(sets, most_frequent)
    pairs = cut(shared.groupBy("n", "nb").agg(F.count("*").alias("c"), F.bool_or(F.col("f") == F.col("fb")).alias("same")))
    apart = F.count_if(~F.col("same"))
    made = pairs.agg(apart.alias("generated"), F.count_if(~F.col("same") & (F.col("c") >= least_shared)).alias("compared"), F.count_if("same").alias("same_family"))
    matched = _compared(sets, pairs.where(~F.col("same") & (F.col("c") >= least_shared)).select("n", "nb")).agg(F.count_if(F.col("similarity") >= threshold).alias("matched"))
    n = occurrences.agg(F.count("*").alias("occurrences")).withColumn("possible_pairs", F.expr("occurrences * (occurrences - 1) div 2"))
    # each side is one row
    return n.crossJoin(made).crossJoin(matched).crossJoin(counts.agg(F.count_if(F.col("c") > most_frequent).alias("common_ignored")))


def _check(size: int, threshold: float, least_shared: int, most_frequent: int) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    if size < 1 or least_shared < 1:
        raise ValueError("sizes of shingles and least shared numbers must be positive")
    if most_frequent < 2:
        raise ValueError("most_frequent must be at least 2")


def clusters(edges: DataFrame, threshold: float, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """((cluster_id, id): members; (cluster_id, occurrences, edges, least, most, mean)) of edges (a, b, similarity), directly linked or not.

    The identifier is hashed from the threshold and the sorted members, which meet in one row per cluster.
    """
    edges = cut(edges.select("a", "b", "similarity"))
    roots = smallest_reachable(edges, "a", "b")
    named = roots.groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("m")).where(F.size("m") >= least)
    named = cut(named.select("root", stable_id("segment-recurrence-cluster", F.lit(f"{threshold:.12g}"), F.array_join("m", "\x1f")).alias("cluster_id"), F.size("m").cast("long").alias("occurrences")))
    members = roots.join(named, "root")
    stats = edges.join(roots.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.count("*").alias("edges"), F.min("similarity").alias("least"), F.max("similarity").alias("most"), F.avg("similarity").alias("mean"))
    return members.select("cluster_id", "id"), named.join(stats, "root").drop("root")


def packets(members: DataFrame, occurrences: DataFrame, facts: DataFrame) -> DataFrame:
    """(cluster_id, occurrences, bare, families, units, common, varying): what the segments of each cluster state.

    ``members``: (cluster_id, id); ``occurrences``: id, family, segment_id, evidence_id, char_start, char_end;
    ``facts``: evidence_id, value, char_start, char_end. A value stated in every occurrence is common, any other
    varying; both are sorted arrays. ``bare`` counts occurrences that state nothing. Facts without a place are left out.
    """
    rows = cut(members.join(occurrences.select("id", "family", "segment_id", "evidence_id", "char_start", "char_end"), "id"))
    f = facts.where("char_start is not null and char_end is not null and value is not null").select("evidence_id", "value", F.col("char_start").alias("fs"), F.col("char_end").alias("fe"))
    stated = rows.join(f, "evidence_id").where("fs >= char_start and fe <= char_end").select("cluster_id", "id", "value").distinct()
    sizes = cut(rows.groupBy("cluster_id").agg(F.count_distinct("id").alias("occurrences"), F.count_distinct("family").alias("families"), F.count_distinct("evidence_id").alias("units")))
    with_facts = stated.groupBy("cluster_id").agg(F.count_distinct("id").alias("stating"))
    each = stated.groupBy("cluster_id", "value").agg(F.count("*").alias("n")).join(sizes, "cluster_id").withColumn("all", F.col("n") == F.col("occurrences"))
    lists = each.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.when(F.col("all"), F.col("value")))).alias("common"), F.array_sort(F.collect_list(F.when(~F.col("all"), F.col("value")))).alias("varying"))
    none = F.array().cast("array<string>")
    out = sizes.join(with_facts, "cluster_id", "left").join(lists, "cluster_id", "left")
    return out.select("cluster_id", "occurrences", (F.col("occurrences") - F.coalesce("stating", F.lit(0))).alias("bare"), "families", "units", F.coalesce("common", none).alias("common"), F.coalesce("varying", none).alias("varying"))


def variation(packets: DataFrame, members: DataFrame, occurrences: DataFrame, preferred: DataFrame, least_quality: float) -> DataFrame:
    """(cluster_id, reason, quality, fingerprint): whether a cluster's variation can be told from noise, and if not, the first reason.

    ``preferred``: evidence_id, extraction_id, quality_score. The fingerprint is hashed from the members, their
    readings and the values, so it changes with any of them; only clusters without a reason have one.
    """
    if not 0 <= least_quality <= 1:
        raise ValueError("least_quality must be between 0 and 1")
    rows = members.join(occurrences.select("id", "family", "segment_id", "evidence_id"), "id").join(preferred.select("evidence_id", "extraction_id", "quality_score"), "evidence_id", "left")
    read = rows.groupBy("cluster_id").agg(
        F.bool_or(F.col("extraction_id").isNull()).alias("unread"), F.bool_or(F.col("quality_score").isNull()).alias("unknown"), F.min("quality_score").alias("quality"),
        F.array_sort(F.collect_set(F.concat_ws("\x1f", "family", "segment_id", "evidence_id", F.coalesce("extraction_id", F.lit("none"))))).alias("inputs"),
    )
    c = F.col
    reason = (
        F.when(c("families") < 2, "requires_multiple_source_families").when(c("units") < 2, "requires_multiple_evidence_units").when(F.size("varying") == 0, "no_structured_fact_variation")
        .when(F.size("common") == 0, "no_common_structured_fact_anchor").when(c("bare") > 0, "occurrence_missing_structured_facts").when(c("unread"), "missing_preferred_extraction")
        .when(c("unknown"), "unknown_extraction_quality").when(c("quality") < least_quality, "extraction_quality_below_threshold")
    )
    tagged = lambda name: F.transform(name, lambda v: F.concat(F.lit(f"{name}:"), v))
    parts = F.array_join(F.concat(F.array("cluster_id"), c("inputs"), tagged("common"), tagged("varying")), "\x1f")
    both = packets.join(read, "cluster_id", "left").withColumn("reason", reason)
    return both.select("cluster_id", F.coalesce("reason", F.lit("eligible_recurrence_fact_variation")).alias("reason"), "quality", F.when(c("reason").isNull(), stable_id("recurrence-variation-inputs", parts)).alias("fingerprint"))


def span_facts(segments: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts within segments: same evidence, and the fact's span inside the segment's."""
    f = facts.where("char_start is not null and char_end is not null").select("fact_id", "evidence_id", "fact_type", "normalized_text", "numeric_value", F.col("char_start").alias("fs"), F.col("char_end").alias("fe"))
    return segments.join(f, "evidence_id").where("fs >= char_start and fe <= char_end").drop("fs", "fe")


def common_and_varying(values: DataFrame) -> DataFrame:
    """(cluster, value, occurrences, kind) from (cluster, occurrence, value): values of all, or of some, occurrences."""
    sizes = values.groupBy("cluster").agg(F.count_distinct("occurrence").alias("n"))
    each = values.where("value is not null").groupBy("cluster", "value").agg(F.count_distinct("occurrence").alias("occurrences"))
    return each.join(sizes, "cluster").select("cluster", "value", "occurrences", F.when(F.col("occurrences") == F.col("n"), "common").otherwise("varying").alias("kind"))
