"""Scoring retrieval against expected targets, and drawing benchmark cases from a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A capitalised phrase of two to four words (a fixed value).
PHRASE = r"\b(?:[A-Z][A-Za-z0-9&'’.-]{2,})(?:\s+(?:[A-Z][A-Za-z0-9&'’.-]{2,})){1,3}\b"


def resolved_targets(targets: DataFrame, sources: DataFrame, snapshots: DataFrame, artifacts: DataFrame, units: DataFrame) -> DataFrame:
    """(case_id, target, evidence_id): the units that targets (case_id, source_uri, locator, sha256 or null) name; null where none is."""
    asked = targets.select("case_id", "source_uri", "locator", F.col("sha256").alias("wanted")).distinct().withColumn("target", F.concat_ws("|", "source_uri", "locator", F.coalesce("wanted", F.lit(""))))
    at = asked.join(sources.select("source_uri", "source_id"), "source_uri").join(snapshots.select("source_id", "artifact_id").distinct(), "source_id").join(artifacts.select("artifact_id", "sha256"), "artifact_id").where("wanted is null or wanted = sha256")
    found = at.join(units.select("artifact_id", "locator", "evidence_id"), ["artifact_id", "locator"]).select("case_id", "target", "evidence_id").distinct()
    return asked.select("case_id", "target").join(found, ["case_id", "target"], "left")


def valid_hits(hits: DataFrame, units: DataFrame, provenance: DataFrame) -> DataFrame:
    """``hits`` (evidence_id, artifact_id, locator and others) with ``valid``: the unit exists so and its artifact has a source."""
    known = units.select("evidence_id", "artifact_id", "locator").join(provenance.select("artifact_id").distinct(), "artifact_id", "left_semi").distinct().withColumn("valid", F.lit(True))
    return hits.join(known, ["evidence_id", "artifact_id", "locator"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def case_results(cases: DataFrame, expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Each case (case_id, mode, expect_empty) with what it expects and finds, and how it fails, if it does.

    ``expected`` is (case_id, target, evidence_id), the unit null where a target names none; ``returned`` is
    (case_id, evidence_id, valid). Units count once. Adds targets, unresolved, returned, found, hit, recall,
    validity, met and failure; a case that expects nothing is met by nothing.
    """
    e = expected.groupBy("case_id").agg(F.count_distinct("evidence_id").alias("targets"), F.count_distinct(F.when(F.col("evidence_id").isNull(), F.col("target"))).alias("unresolved"))
    found = expected.select("case_id", "evidence_id").where("evidence_id is not null").distinct().join(returned.select("case_id", "evidence_id").distinct(), ["case_id", "evidence_id"]).groupBy("case_id").agg(F.count("*").alias("found"))
    hits = returned.groupBy("case_id").agg(F.count_distinct("evidence_id").alias("returned"), F.avg(F.col("valid").cast("double")).alias("validity"))
    rows = cases
    for part in (e, found, hits):
        rows = rows.join(part, "case_id", "left")
    rows = rows.fillna(0, ["targets", "unresolved", "found", "returned"]).fillna(1.0, ["validity"])
    empty, none = F.col("expect_empty"), F.col("returned") == 0
    rows = rows.withColumn("hit", F.when(empty, none).otherwise(F.col("found") > 0)).withColumn("recall", F.when(empty, none.cast("double")).otherwise(F.coalesce(F.try_divide("found", "targets"), F.lit(0.0))))
    rows = rows.withColumn("met", F.when(empty, none).otherwise((F.col("targets") > 0) & (F.col("found") == F.col("targets"))))
    failure = (
        F.when(F.col("unresolved") > 0, "unresolved_target").when(empty, F.when(~none, "unexpected_results")).when(F.col("found") == 0, "miss_all_targets")
        .when(F.col("found") < F.col("targets"), "partial_target_recall").when(F.col("validity") < 1, "invalid_provenance")
    )
    return rows.withColumn("failure", failure)


def metrics(results: DataFrame) -> DataFrame:
    """By mode and for all ('all'): cases, accuracy, positives, hit_rate, mean_recall, target_recall, negatives, negative_accuracy, validity; 1 where there is nothing to measure."""
    positive, negative = ~F.col("expect_empty"), F.col("expect_empty")
    share = lambda c, which: F.coalesce(F.avg(F.when(which, c.cast("double"))), F.lit(1.0))
    aggs = [
        F.count("*").alias("cases"), share(F.col("met"), F.lit(True)).alias("accuracy"), F.count_if(positive).alias("positives"), share(F.col("hit"), positive).alias("hit_rate"), share(F.col("recall"), positive).alias("mean_recall"),
        F.coalesce(F.try_divide(F.sum(F.when(positive, F.col("found"))), F.sum(F.when(positive, F.col("targets")))), F.lit(1.0)).alias("target_recall"),
        F.count_if(negative).alias("negatives"), share(F.col("met"), negative).alias("negative_accuracy"), share(F.col("validity"), F.lit(True)).alias("validity"),
    ]
    return results.rollup("mode").agg(*aggs).withColumn("mode", F.coalesce("mode", F.lit("all")))


def scorable(results: DataFrame) -> DataFrame:
    """``metrics`` of the cases whose targets are all known, with the number of the others (unscorable) by mode and for all."""
    left = results.rollup("mode").agg(F.count_if(F.col("unresolved") > 0).alias("unscorable"), F.sum("unresolved").alias("unresolved")).withColumn("mode", F.coalesce("mode", F.lit("all")))
    return left.join(metrics(results.where("unresolved = 0")), "mode", "left")


#: Words that tell a phrase's worth as a query (fixed values).
MONTHS = "jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december".split()
BOILERPLATE = (
    "agenda meeting open posted regular special minutes req request leg legislation for purch purchase enter necessary agmts agreement agreements support plans "
    "ordinance resolution approve approval authorizing authorize"
).split()
GENERIC_START = "agenda meeting posted regular special req request enter support ordinance resolution approve approval".split()
METADATA = ["ordinance", "resolution"]
INSTITUTIONAL = ["the building code", "building code fund"]
UI_PREFIX, UI_FRAGMENT = "contact item details", "supporting documents"
INCOMPLETE_END = "back documents for regarding supporting ward".split()
PROJECT = "project water main replacement improvement bridge street road sewer park avenue ave building facility".split()


def phrase_quality(phrase: Column) -> Column:
    """struct(reason, natural, project, long, chars): why a phrase is no good query, by the first rule that holds, or how good it is.

    Only the phrase is looked at, never what it finds.
    """
    raw = F.filter(F.split(phrase, r"\s+"), lambda w: w != "")
    words = F.transform(raw, lambda w: F.lower(F.regexp_replace(w, "^[.,:;()\\[\\]{}\"']+|[.,:;()\\[\\]{}\"']+$", "")))
    plain = F.array_join(words, " ")
    among = lambda some: F.arrays_overlap(words, F.array(*map(F.lit, some)))
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    lettered = F.filter(raw, lambda w: w.rlike(r"\p{L}"))
    capitals = (F.size(lettered) > 0) & F.forall(lettered, lambda w: F.upper(w) == w)
    reason = (
        F.when(F.size(raw) < 2, "too_short").when((plain == UI_PREFIX) | plain.startswith(UI_PREFIX + " ") | plain.contains(UI_FRAGMENT), "publisher_ui_fragment")
        .when(last.isin(*INCOMPLETE_END), "trailing_incomplete_phrase").when(first == last, "repeated_edge_token").when(first.isin(*GENERIC_START), "generic_heading_start")
        .when(among(MONTHS), "calendar_heading").when(among(METADATA), "record_metadata_fragment").when(plain.isin(*INSTITUTIONAL), "generic_institutional_heading")
        .when(F.size(F.filter(words, lambda w: w.isin(*BOILERPLATE))) >= 2, "procedural_boilerplate").when(capitals & ~among(PROJECT), "all_caps_fragment")
    )
    natural = F.exists(raw, lambda w: w.rlike(r"\p{Ll}")).cast("int")
    long, chars = F.size(F.filter(words, lambda w: F.length(w) >= 5)), F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    return F.struct(reason.alias("reason"), natural.alias("natural"), among(PROJECT).cast("int").alias("project"), long.alias("long"), chars.alias("chars"))


def case_id(prefix: str, signature: Column) -> Column:
    """``prefix-`` and twelve digits of a hash."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.concat(F.lit(f"{prefix}:"), signature), 256), F.lit(12)))


def first_by_hash(cases: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """``n`` cases of each ``by`` in the order of their key's hash; cut off before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.sha2(key, 256), key)
    return cases.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def top_per_case(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` rows of each case_id in the order ``by``; cut off before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(*by))).where(F.col("_r") <= n).drop("_r")


def phrases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(phrase, docs): capitalised phrases, folded, with the number of documents that hold them."""
    raw = F.explode(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)))
    folded = docs.select(F.col(key).alias("k"), raw.alias("p")).select("k", F.lower(F.regexp_replace("p", r"\s+", " ")).alias("phrase")).where(F.length("phrase") >= 7)
    return folded.groupBy("phrase").agg(F.count_distinct("k").alias("docs"))
