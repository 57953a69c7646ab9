"""Queries that draw benchmark cases from the corpus, curate them, run them over the indexes and measure the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import evaluation, evidence, search
from docketry.plans.evidence import _units
from docketry.plans.indexes import _INDEX, _TEXTS, index, preferred_text
from docketry.plans.registry import query
from docketry.session import cut
from docketry.sources.tables import table

#: Cases of each kind, targets that a case may have, and results looked at (parameters).
PER_KIND, TARGETS, K = 6, 5, 5
#: Phrases that are no query (fixed values), and what the negative cases look for.
STOP = ["board of control", "city council", "state of ohio", "united states"]
ABSENT, NO_NATIVE, NO_IDENTIFIER = "zzbenchmarkmissingzz", "__missing_native_id__", "__missing_identifier__"
_ACCENTS = "[À-ɏ]"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Units with a text and a source: (evidence_id, artifact_id, locator, sha256, source_uri, text)."""
    origin = evidence.provenance(table(spark, d, "source_snapshots"), table(spark, d, "sources")).groupBy("artifact_id").agg(F.min("source_uri").alias("source_uri"))
    units = _units(spark, d).drop("unit_type").join(table(spark, d, "artifacts", "artifact_id", "sha256"), "artifact_id").join(origin, "artifact_id")
    return units.join(preferred_text(spark, d).withColumnRenamed("extracted_text", "text"), "evidence_id")


def _pool(spark: SparkSession, d: str, per_kind: int) -> tuple[DataFrame, DataFrame]:
    """(cases, targets): (case_id, kind, mode, query, value, expect_empty) and (case_id, evidence_id); nothing is retrieved for it."""
    records = _records(spark, d)
    ids = cut(records.select("evidence_id", "artifact_id"))
    plain = F.regexp_replace("text", _ACCENTS, "_")
    shown = records.select("evidence_id", F.explode(F.regexp_extract_all(plain, F.lit(evaluation.PHRASE), F.lit(0))).alias("p")).select("evidence_id", F.regexp_replace("p", r"\s+", " ").alias("p"))
    phrases = shown.withColumn("q", F.lower("p")).where((F.length("q") >= 7) & ~F.col("q").isin(*STOP)).groupBy("q", "evidence_id").agg(F.min("p").alias("p"))
    snapshots = table(spark, d, "source_snapshots", "native_identifier", "artifact_id").where("trim(native_identifier) <> ''").distinct()
    natives = snapshots.join(ids, "artifact_id").select(F.col("native_identifier").alias("q"), "evidence_id", F.col("native_identifier").alias("p")).distinct()
    facts = table(spark, d, "evidence_facts", "fact_type", "normalized_text", "numeric_value", "evidence_id").where("normalized_text is not null").join(ids.select("evidence_id"), "evidence_id", "left_semi")

    def family(rows: DataFrame, prefix: str, mode: str, kind) -> tuple[DataFrame, DataFrame]:
        groups = rows.groupBy("q").agg(F.count_distinct("evidence_id").alias("n"), F.min("p").alias("display"), F.max("v").alias("value")).where(F.col("n") <= TARGETS)
        groups = groups.where("value is not null") if mode == "money" else groups
        cases = evaluation.first_by_hash(groups.withColumn("kind", kind), "kind", "q", per_kind)
        cases = cut(cases.select(evaluation.case_id(prefix, F.col("q")).alias("case_id"), "kind", F.lit(mode).alias("mode"), "q", F.col("display").alias("query"), "value"))
        return cases, cases.select("case_id", "q").join(rows.select("q", "evidence_id").distinct(), "q").select("case_id", "evidence_id")

    none = F.lit(None).cast("double")
    fact = lambda t: facts.where(F.col("fact_type") == t).select(F.col("normalized_text").alias("q"), "evidence_id", F.col("normalized_text").alias("p"), F.col("numeric_value").alias("v"))
    parts = [
        family(phrases.withColumn("v", none), "lexical-entity", "lexical", F.when(F.col("n") == 1, "lexical_entity_unique").otherwise("lexical_entity_cross")),
        family(natives.withColumn("v", none), "native-id", "native_identifier", F.lit("native_identifier")),
        family(fact("money"), "money", "money", F.lit("money_exact")),
        family(fact("date").withColumn("v", none), "date", "date", F.lit("date_exact")),
        family(fact("identifier").withColumn("v", none), "identifier", "identifier", F.lit("content_identifier")),
    ]
    cases, targets = parts[0]
    for c, t in parts[1:]:
        cases, targets = cases.unionByName(c), targets.unionByName(t)
    cases = cases.withColumn("expect_empty", F.lit(False)).unionByName(_controls(records, snapshots.join(ids.select("artifact_id").distinct(), "artifact_id", "left_semi"), facts))
    return cases, targets


def _controls(records: DataFrame, snapshots: DataFrame, facts: DataFrame) -> DataFrame:
    """Five cases that must find nothing: longer, greater or later than anything there is."""

    def longer(rows: DataFrame, text: str, base: str, pad: str) -> DataFrame:
        run = F.length(F.regexp_extract(F.lower(text), f"{base}{pad}*", 0))
        return rows.agg(F.concat(F.lit(base), F.repeat(F.lit(pad), F.greatest(F.coalesce(F.max(run), F.lit(0)) - len(base) + 1, F.lit(0)))).alias("q"))

    value = F.coalesce(F.max(F.when(F.col("fact_type") == "money", F.col("numeric_value"))), F.lit(0.0))
    year = F.greatest(F.coalesce(F.max(F.when((F.col("fact_type") == "date") & F.col("normalized_text").rlike(r"^\d{4}-12-31$"), F.left("normalized_text", F.lit(4)).cast("int"))), F.lit(0)) + 1, F.lit(2099))
    rows = [
        ("negative-lexical", "lexical", longer(records, "text", ABSENT, "z").withColumn("value", F.lit(None).cast("double"))),
        ("negative-native", "native_identifier", longer(snapshots, "native_identifier", NO_NATIVE, "x").withColumn("value", F.lit(None).cast("double"))),
        ("negative-identifier", "identifier", longer(facts.where("fact_type = 'identifier'"), "normalized_text", NO_IDENTIFIER, "x").withColumn("value", F.lit(None).cast("double"))),
        ("negative-money", "money", facts.agg((value + F.greatest(F.abs(value) * 2, F.lit(1e6)) + 12345.67).alias("value")).withColumn("q", F.format_string("%.2f", "value"))),
        ("negative-date", "date", facts.agg(F.concat(year.cast("string"), F.lit("-12-31")).alias("q")).withColumn("value", F.lit(None).cast("double"))),
    ]
    out = None
    for prefix, mode, one in rows:
        case = one.select(evaluation.case_id(prefix, F.col("q")).alias("case_id"), F.lit("negative_control").alias("kind"), F.lit(mode).alias("mode"), "q", F.col("q").alias("query"), "value", F.lit(True).alias("expect_empty"))
        out = case if out is None else out.unionByName(case)
    return out


def _case(prefix: str) -> str:
    return f"'{prefix}-' || substr(sha256('{prefix}:' || q), 1, 12)"


_PHRASE_SQL = evaluation.PHRASE.replace("'", "''")
_RECORDS = f"""rec AS (SELECT u.evidence_id, u.artifact_id, u.locator, a.sha256, t.extracted_text x, (SELECT min(source_uri) FROM source_snapshots s JOIN sources o USING (source_id) WHERE s.artifact_id = u.artifact_id) source_uri
  FROM evidence_units u JOIN artifacts a USING (artifact_id) JOIN {_TEXTS} t USING (evidence_id) WHERE u.artifact_id IN (SELECT artifact_id FROM source_snapshots JOIN sources USING (source_id)))"""


def _pool_sql(per_kind: int) -> str:
    stop = ", ".join(f"'{s}'" for s in STOP)
    longer = lambda text, source, base, pad: f"(SELECT '{base}' || repeat('{pad}', greatest(coalesce(max(length(regexp_extract(lower({text}), '{base}{pad}*'))), 0) - {len(base)} + 1, 0)::INTEGER) q FROM {source})"
    return rf"""{_RECORDS}, ph AS (SELECT lower(p) q, evidence_id, min(p) p, NULL::DOUBLE v FROM (SELECT evidence_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(x, '{_ACCENTS}', '_', 'g'), '{_PHRASE_SQL}')), '\s+', ' ', 'g') p FROM rec)
  WHERE length(p) >= 7 AND lower(p) NOT IN ({stop}) GROUP BY 1, 2),
na AS (SELECT DISTINCT native_identifier q, evidence_id, native_identifier p, NULL::DOUBLE v FROM source_snapshots JOIN rec USING (artifact_id) WHERE trim(native_identifier) <> ''),
fa AS (SELECT fact_type, normalized_text q, evidence_id, normalized_text p, numeric_value v FROM evidence_facts WHERE normalized_text IS NOT NULL AND evidence_id IN (SELECT evidence_id FROM rec)),
al AS (SELECT 'lexical-entity' pre, 'lexical' md, q, evidence_id, p, v FROM ph UNION ALL SELECT 'native-id', 'native_identifier', q, evidence_id, p, v FROM na
  UNION ALL SELECT fact_type, fact_type, q, evidence_id, p, CASE WHEN fact_type = 'money' THEN v END FROM fa WHERE fact_type IN ('money', 'date', 'identifier')),
gr AS (SELECT pre, md, q, count(DISTINCT evidence_id) n, min(p) p, max(v) v FROM al GROUP BY 1, 2, 3 HAVING count(DISTINCT evidence_id) <= {TARGETS} AND (md <> 'money' OR max(v) IS NOT NULL)),
ki AS (SELECT *, CASE md WHEN 'lexical' THEN CASE WHEN n = 1 THEN 'lexical_entity_unique' ELSE 'lexical_entity_cross' END WHEN 'native_identifier' THEN md WHEN 'identifier' THEN 'content_identifier' ELSE md || '_exact' END kind FROM gr),
rk AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha256(q), q) r FROM ki),
pos AS (SELECT pre || '-' || substr(sha256(pre || ':' || q), 1, 12) case_id, kind, md, q, p, v, pre FROM rk WHERE r <= {per_kind}),
mx AS (SELECT coalesce(max(v) FILTER (WHERE fact_type = 'money'), 0) m, greatest(coalesce(max(try_cast(substr(q, 1, 4) AS INTEGER)) FILTER (WHERE fact_type = 'date' AND regexp_matches(q, '^\d{{4}}-12-31$')), 0) + 1, 2099) y FROM fa),
neg AS (SELECT {_case("negative-lexical")} case_id, 'lexical' md, q, NULL::DOUBLE v FROM {longer("x", "rec", ABSENT, "z")}
  UNION ALL SELECT {_case("negative-native")}, 'native_identifier', q, NULL FROM {longer("q", "na", NO_NATIVE, "x")}
  UNION ALL SELECT {_case("negative-identifier")}, 'identifier', q, NULL FROM {longer("q", "(SELECT q FROM fa WHERE fact_type = 'identifier')", NO_IDENTIFIER, "x")}
  UNION ALL SELECT {_case("negative-money")}, 'money', q, v FROM (SELECT v, printf('%.2f', v) q FROM (SELECT m + greatest(abs(m) * 2, 1e6) + 12345.67 v FROM mx))
  UNION ALL SELECT {_case("negative-date")}, 'date', q, NULL FROM (SELECT y || '-12-31' q FROM mx)),
cases AS (SELECT case_id, kind, md, q, p AS "query", v, false em FROM pos UNION ALL SELECT case_id, 'negative_control', md, q, q, v, true FROM neg),
tg AS (SELECT DISTINCT case_id, evidence_id FROM pos JOIN al ON al.pre = pos.pre AND al.q = pos.q)"""


@query(f"""WITH {_pool_sql(PER_KIND)} SELECT case_id, kind, md AS "mode", "query", round(v, 2) AS "value", em AS expect_empty, (SELECT count(*) FROM tg WHERE tg.case_id = cases.case_id) targets FROM cases""")
def benchmark_pool(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark cases: phrases, native identifiers, amounts, dates and identifiers of few units, and what nothing must be found for."""
    cases, targets = _pool(spark, d, PER_KIND)
    n = targets.groupBy("case_id").agg(F.count("*").alias("targets"))
    return cases.join(n, "case_id", "left").select("case_id", "kind", "mode", "query", F.round("value", 2).alias("value"), "expect_empty", F.coalesce("targets", F.lit(0)).alias("targets"))


@query(f"WITH {_pool_sql(PER_KIND)} SELECT kind, count(*) cases FROM cases GROUP BY 1")
def benchmark_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d, PER_KIND)[0].groupBy("kind").agg(F.count("*").alias("cases"))


def _hits(spark: SparkSession, d: str, cases: DataFrame) -> DataFrame:
    """(case_id, evidence_id): the first ``K`` results of each case by its mode's own order, all cases at once."""
    cases = cut(cases)
    of = lambda mode: cases.where(F.col("mode") == mode)
    lexical = search.search_many(index(spark, d), of("lexical").select("case_id", "query"), K).select("case_id", F.col("id").alias("evidence_id"))
    units = _units(spark, d).select("evidence_id", "artifact_id")
    read = units.join(preferred_text(spark, d).select("evidence_id"), "evidence_id", "left_semi")
    names = table(spark, d, "source_snapshots", "native_identifier", "artifact_id").distinct()
    native = of("native_identifier").select("case_id", F.col("query").alias("native_identifier")).join(names, "native_identifier").join(read, "artifact_id").select("case_id", "evidence_id").distinct()
    facts = table(spark, d, "evidence_facts", "fact_id", "evidence_id", "fact_type", "normalized_text", "numeric_value").distinct()
    money = of("money").select("case_id", F.col("value").alias("numeric_value")).join(facts.where("fact_type = 'money'"), "numeric_value")
    text = F.lower(F.trim("query"))
    other = cases.where(F.col("mode").isin("date", "identifier")).select("case_id", F.col("mode").alias("fact_type"), text.alias("normalized_text")).join(facts, ["fact_type", "normalized_text"])
    first = lambda rows, *by: evaluation.top_per_case(rows, K, *by)
    out = lexical.unionByName(first(native, "evidence_id").select("case_id", "evidence_id"))
    return out.unionByName(first(money.unionByName(other, allowMissingColumns=True).select("case_id", "evidence_id", "fact_id"), "evidence_id", "fact_id").select("case_id", "evidence_id"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    cases, targets = _pool(spark, d, PER_KIND)
    records = _records(spark, d).select("evidence_id", "source_uri", "locator", "sha256")
    # targets are told by address, place and content, and found again through them
    named = targets.join(records, "evidence_id").select("case_id", "source_uri", "locator", "sha256")
    units = _units(spark, d)
    expected = evaluation.resolved_targets(named, table(spark, d, "sources", "source_id", "source_uri"), table(spark, d, "source_snapshots", "source_id", "artifact_id"), table(spark, d, "artifacts", "artifact_id", "sha256"), units)
    hits = _hits(spark, d, cases).join(units.select("evidence_id", "artifact_id", "locator"), "evidence_id")
    origin = evidence.provenance(table(spark, d, "source_snapshots"), table(spark, d, "sources"))
    return evaluation.case_results(cases.select("case_id", "kind", "mode", "expect_empty"), expected, evaluation.valid_hits(hits, units, origin))


_RESULTS = f"""{_pool_sql(PER_KIND)}, {_INDEX.replace("x AS (", "ix AS (").replace("FROM x)", "FROM ix)").replace("FROM x),", "FROM ix),")},
qt AS (SELECT case_id, term, count(*) times FROM (SELECT case_id, unnest(regexp_extract_all(lower(strip_accents("query")), '[\\p{{L}}\\p{{N}}]+')) term FROM cases WHERE md = 'lexical') GROUP BY 1, 2),
ne AS (SELECT case_id, count(*) need FROM qt GROUP BY 1), hh AS (SELECT * FROM posts WHERE term IN (SELECT term FROM qt)),
wt AS (SELECT term, greatest(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)), 0) raw FROM hh, totals GROUP BY 1),
sc AS (SELECT case_id, hh.id, count(*) c, -sum(times * CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) s FROM qt JOIN hh USING (term) JOIN wt USING (term) JOIN sizes ON sizes.id = hh.id, totals GROUP BY 1, 2),
lx AS (SELECT case_id, id evidence_id, row_number() OVER (PARTITION BY case_id ORDER BY round(s, 9), id) r FROM sc JOIN ne USING (case_id) WHERE c = need),
nt AS (SELECT case_id, evidence_id, row_number() OVER (PARTITION BY case_id ORDER BY evidence_id) r FROM (SELECT DISTINCT case_id, u.evidence_id FROM cases JOIN source_snapshots s ON s.native_identifier = cases."query" JOIN evidence_units u USING (artifact_id)
  WHERE md = 'native_identifier' AND u.evidence_id IN (SELECT evidence_id FROM {_TEXTS}))),
df AS (SELECT DISTINCT fact_id, evidence_id, fact_type, normalized_text, numeric_value FROM evidence_facts),
ft AS (SELECT case_id, evidence_id, row_number() OVER (PARTITION BY case_id ORDER BY evidence_id, fact_id) r FROM (SELECT case_id, evidence_id, fact_id FROM cases JOIN df ON md = 'money' AND fact_type = 'money' AND numeric_value = v
  UNION ALL SELECT case_id, evidence_id, fact_id FROM cases JOIN df ON md IN ('date', 'identifier') AND fact_type = md AND normalized_text = lower(trim("query")))),
ht AS (SELECT * FROM lx WHERE r <= {K} UNION ALL SELECT * FROM nt WHERE r <= {K} UNION ALL SELECT * FROM ft WHERE r <= {K}),
ex AS (SELECT DISTINCT tg.case_id, u.evidence_id FROM tg JOIN rec USING (evidence_id) JOIN sources o ON o.source_uri = rec.source_uri JOIN source_snapshots s ON s.source_id = o.source_id JOIN artifacts a ON a.artifact_id = s.artifact_id AND a.sha256 = rec.sha256
  JOIN evidence_units u ON u.artifact_id = a.artifact_id AND u.locator = rec.locator),
cr AS (SELECT case_id, kind, md AS "mode", em, (SELECT count(*) FROM ex WHERE ex.case_id = cases.case_id) targets, (SELECT count(DISTINCT evidence_id) FROM ht WHERE ht.case_id = cases.case_id) returned,
  (SELECT count(DISTINCT ht.evidence_id) FROM ht JOIN ex USING (case_id, evidence_id) WHERE ht.case_id = cases.case_id) found,
  coalesce((SELECT avg((u.artifact_id IN (SELECT artifact_id FROM source_snapshots JOIN sources USING (source_id)))::INTEGER) FROM ht JOIN evidence_units u USING (evidence_id) WHERE ht.case_id = cases.case_id), 1) validity FROM cases),
res AS (SELECT *, CASE WHEN em THEN returned = 0 ELSE found > 0 END hit, CASE WHEN em THEN (returned = 0)::INTEGER::DOUBLE ELSE coalesce(found / nullif(targets, 0), 0) END recall, CASE WHEN em THEN returned = 0 ELSE targets > 0 AND found = targets END met,
  CASE WHEN em THEN CASE WHEN returned > 0 THEN 'unexpected_results' END WHEN found = 0 THEN 'miss_all_targets' WHEN found < targets THEN 'partial_target_recall' WHEN validity < 1 THEN 'invalid_provenance' END failure FROM cr)"""


@query(f'WITH {_RESULTS} SELECT case_id, kind, "mode", targets, returned, found, round(recall, 6) recall, round(validity, 6) validity, met, failure FROM res')
def retrieval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every case run over its index: what it found of its targets, and how it failed if it did."""
    r = _results(spark, d)
    return r.select("case_id", "kind", "mode", "targets", "returned", "found", F.round("recall", 6).alias("recall"), F.round("validity", 6).alias("validity"), "met", "failure")


_MEASURES = """count(*) cases, round(avg(met::INTEGER), 6) accuracy, count(*) FILTER (WHERE NOT em) positives, round(coalesce(avg(hit::INTEGER) FILTER (WHERE NOT em), 1), 6) hit_rate, round(coalesce(avg(recall) FILTER (WHERE NOT em), 1), 6) mean_recall,
  round(coalesce(sum(found) FILTER (WHERE NOT em) / sum(targets) FILTER (WHERE NOT em), 1), 6) target_recall, count(*) FILTER (WHERE em) negatives, round(coalesce(avg(met::INTEGER) FILTER (WHERE em), 1), 6) negative_accuracy, round(avg(validity), 6) validity"""


@query(f"""WITH {_RESULTS} SELECT coalesce("mode", 'all') AS "mode", {_MEASURES} FROM res GROUP BY ROLLUP ("mode")""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, hit rate, recall and validity by mode and for all."""
    m = evaluation.metrics(_results(spark, d))
    return m.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes))


@query(f"""WITH {_RESULTS} SELECT coalesce("mode", 'all') AS "mode", 0::BIGINT unscorable, 0::BIGINT unresolved, {_MEASURES} FROM res GROUP BY ROLLUP ("mode")""")
def scorable_report(spark: SparkSession, d: str) -> DataFrame:
    """The same over cases whose targets are all known, and how many others there are."""
    m = evaluation.scorable(_results(spark, d))
    return m.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes))


@query(f"WITH {_RESULTS} SELECT coalesce(failure, 'none') failure, count(*) cases FROM res GROUP BY 1")
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy(F.coalesce("failure", F.lit("none")).alias("failure")).agg(F.count("*").alias("cases"))


def _among(some: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in some) + "]"


_WORTH = f"""{_pool_sql(200)}, w0 AS (SELECT case_id, kind, "query", list_filter(regexp_split_to_array("query", '\\s+'), lambda w: w <> '') raw FROM cases WHERE md = 'lexical' AND NOT em),
w1 AS (SELECT *, list_transform(raw, lambda w: lower(trim(w, '.,:;()[]{{}}"'''))) ws FROM w0),
w2 AS (SELECT *, array_to_string(ws, ' ') pl, list_filter(raw, lambda w: regexp_matches(w, '\\p{{L}}')) le FROM w1),
wo AS (SELECT *, CASE WHEN len(raw) < 2 THEN 'too_short' WHEN pl = 'contact item details' OR starts_with(pl, 'contact item details ') OR contains(pl, 'supporting documents') THEN 'publisher_ui_fragment'
  WHEN ws[-1] IN {tuple(evaluation.INCOMPLETE_END)} THEN 'trailing_incomplete_phrase' WHEN ws[1] = ws[-1] THEN 'repeated_edge_token' WHEN ws[1] IN {tuple(evaluation.GENERIC_START)} THEN 'generic_heading_start'
  WHEN list_has_any(ws, {_among(evaluation.MONTHS)}) THEN 'calendar_heading' WHEN list_has_any(ws, {_among(evaluation.METADATA)}) THEN 'record_metadata_fragment' WHEN pl IN {tuple(evaluation.INSTITUTIONAL)} THEN 'generic_institutional_heading'
  WHEN len(list_filter(ws, lambda w: w IN {tuple(evaluation.BOILERPLATE)})) >= 2 THEN 'procedural_boilerplate'
  WHEN len(le) > 0 AND len(list_filter(le, lambda w: upper(w) <> w)) = 0 AND NOT list_has_any(ws, {_among(evaluation.PROJECT)}) THEN 'all_caps_fragment' END reason,
  (len(list_filter(raw, lambda w: regexp_matches(w, '\\p{{Ll}}'))) > 0)::INTEGER natural_case, list_has_any(ws, {_among(evaluation.PROJECT)})::INTEGER project, len(list_filter(ws, lambda w: length(w) >= 5))::INTEGER "long", coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::INTEGER chars FROM w2)"""


def _worth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cases = _pool(spark, d, 200)[0]
    phrases = cases.where("mode = 'lexical' and not expect_empty").withColumn("q", evaluation.phrase_quality(F.col("query")))
    return cases, phrases.select("case_id", "kind", "mode", "query", "q.*")


@query(f'WITH {_WORTH} SELECT case_id, "query", reason, natural_case, project, "long", chars FROM wo')
def phrase_quality(spark: SparkSession, d: str) -> DataFrame:
    """Why mined phrases are no good queries, by the first of ten rules that holds, or how good they are."""
    return _worth(spark, d)[1].select("case_id", "query", "reason", F.col("natural").alias("natural_case"), "project", "long", "chars")


@query(f"WITH {_WORTH} SELECT coalesce(reason, 'accepted') reason, count(*) cases FROM wo GROUP BY 1")
def rejection_counts(spark: SparkSession, d: str) -> DataFrame:
    return _worth(spark, d)[1].groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("cases"))


@query(
    f"""WITH {_WORTH}, c1 AS (SELECT case_id, kind, row_number() OVER (PARTITION BY kind ORDER BY natural_case DESC, project DESC, "long" DESC, chars DESC, sha256(lower("query"))) r FROM wo WHERE reason IS NULL
      UNION ALL SELECT case_id, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256(case_id), case_id) FROM cases WHERE md <> 'lexical' AND NOT em UNION ALL SELECT case_id, kind, 1 FROM cases WHERE em)
    SELECT case_id, kind FROM c1 WHERE r <= {PER_KIND}"""
)
def curated_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The best phrases, and of each other kind the first by hash; every negative case."""
    from pyspark.sql import Window

    cases, worth = _worth(spark, d)
    best = Window.partitionBy("kind").orderBy(F.desc("natural"), F.desc("project"), F.desc("long"), F.desc("chars"), F.sha2(F.lower("query"), 256))
    phrases = worth.where("reason is null").withColumn("r", F.row_number().over(best)).where(F.col("r") <= PER_KIND)
    rest = evaluation.first_by_hash(cases.where("mode <> 'lexical' and not expect_empty"), "kind", "case_id", PER_KIND)
    return phrases.select("case_id", "kind").unionByName(rest.select("case_id", "kind")).unionByName(cases.where("expect_empty").select("case_id", "kind"))


_SNIPPET = """list_filter(regexp_split_to_array(extracted_text, '[ \\t\\n\\f\\r\\x0b]+'), lambda w: w <> '')"""


@query(
    f"""WITH {_INDEX}, h AS (SELECT * FROM posts WHERE term IN ('storm', 'water')), w AS (SELECT term, greatest(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)), 0) raw FROM h, totals GROUP BY 1),
    s AS (SELECT h.id, count(*) c, -sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) s FROM h JOIN w USING (term) JOIN sizes USING (id), totals GROUP BY 1),
    t AS (SELECT id, s FROM s WHERE c = 2 ORDER BY s, id LIMIT 20), k AS (SELECT id, s, {_SNIPPET} ws FROM t JOIN {_TEXTS} e ON e.evidence_id = t.id),
    f AS (SELECT *, list_transform(ws, lambda w: list_has_any(regexp_extract_all(lower(strip_accents(w)), '[\\p{{L}}\\p{{N}}]+'), ['storm', 'water'])) hit FROM k),
    g AS (SELECT *, greatest(coalesce(list_position(hit, true), 1) - 8, 1) st FROM f)
    SELECT id AS evidence_id, round(s, 6) score, CASE WHEN st > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(range(st, least(st + 24, len(ws) + 1)), lambda i: CASE WHEN hit[i] THEN '[' || ws[i] || ']' ELSE ws[i] END), ' ')
      || CASE WHEN st + 23 < len(ws) THEN ' …' ELSE '' END snippet, (SELECT count(DISTINCT source_id) FROM source_snapshots s2 JOIN sources USING (source_id) WHERE s2.artifact_id = u.artifact_id) sources
    FROM g JOIN evidence_units u ON u.evidence_id = g.id"""
)
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best units with the words around the match and the number of their sources."""
    terms = search.query_terms("storm water")
    top = search.search(index(spark, d), "storm water", 20)
    # twenty rows meet the large tables, which are cut down to them before anything else
    hits = F.broadcast(cut(top.withColumnRenamed("id", "evidence_id")))
    shown = preferred_text(spark, d).join(hits, "evidence_id").select("evidence_id", "score", search.snippet(F.col("extracted_text"), F.array(*map(F.lit, terms))).alias("snippet"))
    homes = table(spark, d, "evidence_units", "evidence_id", "artifact_id").join(hits, "evidence_id", "left_semi")
    origin = table(spark, d, "source_snapshots", "artifact_id", "source_id").join(F.broadcast(homes), "artifact_id").join(table(spark, d, "sources", "source_id"), "source_id", "left_semi").groupBy("evidence_id").agg(F.count_distinct("source_id").alias("sources"))
    return shown.join(origin, "evidence_id", "left").select("evidence_id", F.round("score", 6).alias("score"), "snippet", F.coalesce("sources", F.lit(0)).alias("sources"))


@query(
    f"""SELECT DISTINCT s.native_identifier, u.evidence_id, substr(t.extracted_text, 1, 500) snippet FROM source_snapshots s JOIN evidence_units u USING (artifact_id) JOIN {_TEXTS} t USING (evidence_id) WHERE s.native_identifier IS NOT NULL"""
)
def native_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The units of every native identifier with the beginning of their text."""
    names = table(spark, d, "source_snapshots", "artifact_id", "native_identifier").where("native_identifier is not null").distinct()
    units = _units(spark, d).select("artifact_id", "evidence_id").join(preferred_text(spark, d), "evidence_id").select("artifact_id", "evidence_id", F.left("extracted_text", F.lit(500)).alias("snippet"))
    return names.join(units, "artifact_id").select("native_identifier", "evidence_id", "snippet").distinct()
