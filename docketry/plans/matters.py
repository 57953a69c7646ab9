"""Queries that key matters and give amounts their roles, under rules stated here as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import roles
from docketry.operators.roles import Component, ContextRule, Identity, KeyPolicy
from docketry.plans.indexes import _TEXTS, preferred_text
from docketry.plans.registry import query
from docketry.sources.tables import table

_PROJECT = r"\bC-(\d{3,6}/\d{2})\b"
_RENEWAL = r"\bagreement\s+with\s+([A-Z][^,;]{2,60}?)\s+for\b"
_AWARD = r"\bcontract\s+with\s+([A-Z][^,;]{2,60}?)\s+for\b"
#: Legislation by its contract number and the party that it deals with.
POLICY = KeyPolicy(
    "legislation-contracts", "council-legislation", _PROJECT,
    (Identity("renewal", "renewal", _RENEWAL, (Component("counterparty", 1, "party"),)), Identity("award", "contract_award", _AWARD, (Component("counterparty", 1, "party"),))),
)

_SEGMENT = "s AS (SELECT DISTINCT segment_id, evidence_id, artifact_id, rule_name, raw_text, char_start, char_end FROM evidence_segments)"
_PARTY = lambda x: rf"array_to_string(regexp_extract_all(regexp_replace(replace(lower({x}), '&', ' and '), '\.', '', 'g'), '[a-z0-9]+'), ' ')"
_KEYED = rf"""{_SEGMENT},
a AS (SELECT *, regexp_extract_all(coalesce(raw_text, ''), '{_PROJECT}', 1) pr, regexp_extract_all(coalesce(raw_text, ''), '{_RENEWAL}', 1) re, regexp_extract_all(coalesce(raw_text, ''), '{_AWARD}', 1) aw FROM s),
b AS (SELECT *, list_distinct(list_transform(pr, lambda x: regexp_replace(x, '\D', '', 'g')::BIGINT::VARCHAR)) ids, len(re) + len(aw) n, rule_name IS NOT DISTINCT FROM 'council-legislation' inside,
  CASE WHEN len(re) = 1 THEN {_PARTY("re[1]")} ELSE {_PARTY("aw[1]")} END who FROM a),
k AS (SELECT *, CASE WHEN NOT inside THEN 'insufficient_identity' WHEN len(ids) > 1 OR n > 1 THEN 'ambiguous' WHEN len(ids) = 0 OR n = 0 OR who = '' THEN 'insufficient_identity' ELSE 'resolved' END status,
  CASE WHEN NOT inside THEN 'segment_rule_not_in_policy_scope' ELSE concat_ws(',',
    CASE WHEN len(ids) = 0 THEN 'missing_project_id' WHEN len(ids) > 1 THEN 'multiple_project_ids' WHEN len(pr) > 1 THEN 'repeated_same_project_id' END,
    CASE WHEN n = 0 THEN 'unrecognized_transaction_identity' WHEN n > 1 THEN 'multiple_transaction_identity_matches' END, CASE WHEN len(ids) = 1 AND n = 1 AND who = '' THEN 'missing_counterparty' END) END reasons FROM b),
keyed AS (SELECT *, CASE WHEN status = 'resolved' THEN 'matter-key:' || sha256('legislation-contracts' || chr(31) || CASE WHEN len(re) > 0 THEN 'renewal' ELSE 'award' END || chr(31) || 'project_id=' || ids[1] || chr(31)
  || 'transaction_role=' || CASE WHEN len(re) > 0 THEN 'renewal' ELSE 'contract_award' END || chr(31) || 'counterparty=' || who) END matter_key FROM k)"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "evidence_segments", "segment_id", "evidence_id", "artifact_id", "rule_name", "raw_text", "char_start", "char_end").distinct()
    return roles.matter_keys(segments, POLICY)


@query(f"WITH {_KEYED} SELECT segment_id, status, reasons, matter_key FROM keyed")
def matter_key_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether each segment's matter is clear, why not, and its key."""
    return _keyed(spark, d).select("segment_id", "status", F.array_join("reasons", ",").alias("reasons"), "matter_key")


@query(f"WITH {_KEYED} SELECT status, count(*) segments FROM keyed GROUP BY 1")
def matter_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).groupBy("status").agg(F.count("*").alias("segments"))


@query(f"WITH {_KEYED} SELECT segment_id, ids[1] AS project, who AS counterparty FROM keyed WHERE status = 'resolved'")
def matter_components(spark: SparkSession, d: str) -> DataFrame:
    """The normalised components of each clear matter."""
    of = lambda role: F.get(F.filter("components", lambda c: c["role"] == role), F.lit(0))["normal"]
    return _keyed(spark, d).where("status = 'resolved'").select("segment_id", of("project_id").alias("project"), of("counterparty").alias("counterparty"))


#: The same by project alone, so that several segments share a key.
BY_PROJECT = KeyPolicy("legislation-projects", "council-legislation", _PROJECT, (Identity("any", "any", r"(?i)^\s*((?:Ordinance|Resolution|Ord\.|Res\.))"),))
_GROUPED = rf"""{_SEGMENT}, b AS (SELECT *, regexp_extract_all(coalesce(raw_text, ''), '{_PROJECT}', 1) pr, regexp_matches(coalesce(raw_text, ''), '(?i)^\s*((?:Ordinance|Resolution|Ord\.|Res\.))') one FROM s WHERE rule_name = 'council-legislation'),
c AS (SELECT *, list_distinct(list_transform(pr, lambda x: regexp_replace(x, '\D', '', 'g')::BIGINT::VARCHAR)) ids FROM b WHERE one),
keyed AS (SELECT *, 'matter-key:' || sha256('legislation-projects' || chr(31) || 'any' || chr(31) || 'project_id=' || ids[1] || chr(31) || 'transaction_role=any') matter_key FROM c WHERE len(ids) = 1)"""


def _by_project(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "evidence_segments", "segment_id", "evidence_id", "artifact_id", "rule_name", "raw_text", "char_start", "char_end").distinct()
    return roles.matter_keys(segments, BY_PROJECT)


@query(f"WITH {_GROUPED} SELECT matter_key, count(DISTINCT segment_id) occurrences, count(DISTINCT evidence_id) units, count(DISTINCT artifact_id) artifacts FROM keyed GROUP BY 1 HAVING count(DISTINCT segment_id) >= 2")
def matter_groups(spark: SparkSession, d: str) -> DataFrame:
    """Matters that several segments deal with."""
    return roles.key_groups(_by_project(spark, d))


_SUM = r"((?:USD\s?|US\$\s?|\$\s?)\d[\d,]*(?:\.\d+)?(?:MM|M|K|B)?)"
#: What precedes an amount tells its role; each rule's group is the amount.
AMOUNT_RULES = [
    ("payment", "payment", r"in\s+the\s+sum\s+of\s+" + _SUM),
    ("ceiling", "ceiling", r"not\s+to\s+exceed\s+" + _SUM),
    ("price", "price", r",\s+at\s+" + _SUM),
    ("sum", "payment", r"the\s+sum\s+of\s+" + _SUM),
    ("grant", "grant", r"grant\s+of\s+" + _SUM),
    ("bond", "bond", r"bond\s+of\s+" + _SUM),
]


def _placed(rule: tuple[str, str, str]) -> str:
    """SQL for the places of a rule's amounts: the text is cut at marks set around each."""
    lead = rule[2].removesuffix(_SUM)
    parts = f"string_split(regexp_replace(raw_text, '({lead}){_SUM}', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1))"
    return f"""SELECT segment_id, '{rule[0]}' AS "rule", '{rule[1]}' AS "role", char_start + coalesce(list_sum(list_transform(p[1:2 * i - 1], lambda x: length(x))), 0)::BIGINT at0, length(p[2 * i]) n
    FROM (SELECT segment_id, char_start, p, unnest(range(1, (len(p) - 1) // 2 + 1)) i FROM (SELECT segment_id, char_start, {parts} p FROM keyed WHERE raw_text IS NOT NULL))"""


_ROLES = f"""{_GROUPED}, h AS ({" UNION ALL ".join(map(_placed, AMOUNT_RULES))}),
f AS (SELECT DISTINCT fact_id, evidence_id, normalized_text, char_start fs, char_end fe FROM evidence_facts WHERE fact_type = 'money' AND char_start IS NOT NULL AND char_end IS NOT NULL),
j AS (SELECT keyed.segment_id, keyed.evidence_id, artifact_id, matter_key, fact_id, normalized_text, fs, fe FROM keyed JOIN f USING (evidence_id) WHERE fs >= char_start AND fe <= char_end),
roles AS (SELECT j.segment_id, evidence_id, artifact_id, matter_key, fact_id, normalized_text, count("rule") n, CASE WHEN count("rule") = 0 THEN 'unknown' WHEN count("rule") = 1 THEN 'assigned' ELSE 'ambiguous' END status,
  CASE WHEN count("rule") = 1 THEN min("role") END "role" FROM j LEFT JOIN h ON h.segment_id = j.segment_id AND h.at0 = fs AND h.at0 + h.n = fe GROUP BY ALL)"""


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "evidence_facts", "fact_id", "evidence_id", "fact_type", "normalized_text", "char_start", "char_end").where("fact_type = 'money'")
    return roles.amount_roles(_by_project(spark, d), facts, AMOUNT_RULES)


@query(f'WITH {_ROLES} SELECT segment_id, fact_id, status, "role", n AS rules FROM roles')
def amount_roles(spark: SparkSession, d: str) -> DataFrame:
    """The role of each amount in a clear matter, by rules that match its exact span."""
    return _amounts(spark, d).select("segment_id", "fact_id", "status", "role", F.size("rules").cast("long").alias("rules"))


@query(f'WITH {_ROLES} SELECT status, "role", count(*) n FROM roles GROUP BY 1, 2')
def amount_role_counts(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d).groupBy("status", "role").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ROLES} SELECT matter_key, "role", count(*) occurrences, count(DISTINCT evidence_id) units, count(DISTINCT artifact_id) artifacts, array_to_string(list_sort(list_distinct(list(normalized_text))), '|') AS "values",
    len(list_distinct(list(normalized_text))) >= 2 conflict FROM roles WHERE status = 'assigned' GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def role_populations(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of one matter and role, with their distinct values, and whether these differ."""
    return roles.role_populations(_amounts(spark, d)).withColumn("values", F.array_join("values", "|"))


_ANCHORED = f"""c AS (SELECT f.fact_id, f.normalized_text, t.extracted_text AS x, f.char_start AS s, f.char_end AS e FROM (SELECT DISTINCT fact_id, evidence_id, normalized_text, char_start, char_end FROM evidence_facts
  WHERE fact_type = 'money' AND char_start IS NOT NULL AND char_end IS NOT NULL) f JOIN {_TEXTS} t USING (evidence_id))"""
_FOLD = lambda x: f"lower(trim(regexp_replace({x}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')))"


def _window(radius: int, side: int) -> str:
    near = _FOLD(f"substr(x, greatest(s - {radius}, 0) + 1, least(e + {radius}, length(x)) - greatest(s - {radius}, 0))")
    left, right = _FOLD(f"substr(x, greatest(s - {side}, 0) + 1, s - greatest(s - {side}, 0))"), _FOLD(f"substr(x, e + 1, least(e + {side}, length(x)) - e)")
    return f"{_ANCHORED}, w AS (SELECT *, {near} near, {left} lft, {right} rgt FROM c)"


#: Roles of amounts by what stands around them; the first that holds counts.
CONTEXT_RULES = [
    ContextRule("payment", all=("payment",), any=("in the sum of", "invoice"), none=("appraisal",), left=r"sum of$"),
    ContextRule("bond", any=("surety", "bond of"), left=r"bond of$"),
    ContextRule("ceiling", left=r"not to exceed$"),
    ContextRule("local_match", all=("grant",), left=r"local match of$"),
    ContextRule("appraised_value", all=("appraisal",)),
    ContextRule("round_sum", numbers=("100000.00", "250000.00", "1000000.00")),
]


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "evidence_facts", "fact_id", "evidence_id", "fact_type", "normalized_text", "char_start", "char_end").where("fact_type = 'money' and char_start is not null and char_end is not null")
    return f.drop("fact_type").distinct().join(preferred_text(spark, d).withColumnRenamed("extracted_text", "text"), "evidence_id")


@query(
    f"""WITH {_window(320, 180)} SELECT fact_id, CASE WHEN contains(near, 'payment') AND (contains(near, 'in the sum of') OR contains(near, 'invoice')) AND NOT contains(near, 'appraisal') AND regexp_matches(lft, 'sum of$') THEN 'payment'
    WHEN (contains(near, 'surety') OR contains(near, 'bond of')) AND regexp_matches(lft, 'bond of$') THEN 'bond' WHEN regexp_matches(lft, 'not to exceed$') THEN 'ceiling'
    WHEN contains(near, 'grant') AND regexp_matches(lft, 'local match of$') THEN 'local_match' WHEN contains(near, 'appraisal') THEN 'appraised_value'
    WHEN normalized_text IN ('100000.00', '250000.00', '1000000.00') THEN 'round_sum' ELSE 'unclassified_money' END AS "role" FROM w"""
)
def context_roles(spark: SparkSession, d: str) -> DataFrame:
    """The role of every amount with a place, by the text around it."""
    rows = _anchored(spark, d)
    return rows.select("fact_id", roles.in_context(rows, CONTEXT_RULES, "unclassified_money", 320, 180).alias("role"))


#: Two axes: what a passage is about, then what an amount in it is; the first axis tells the scope.
SUBJECTS = [ContextRule("purchase", any=("rfp", "bids", "vendor")), ContextRule("property", any=("appraisal", "easement", "parcel"), none=("rfp",)), ContextRule("claim", any=("settles", "claim"))]
AMOUNTS = [
    ContextRule("early_amount", kinds=("purchase", "property"), before=r"RFP \d"),
    ContextRule("late_amount", kinds=("purchase",), after=r"RFP \d{2}-\d+"),
    ContextRule("dated_amount", kinds=("property", "claim"), right=r"^(?:is )?as of"),
]
SCOPES = {"purchase": "contract", "property": "asset", "claim": "settlement"}
_RFP = r"regexp_extract(x, 'RFP \d')"
_RFP_ALL = r"regexp_extract(x, 'RFP \d{2}-\d+')"


@query(
    f"""WITH {_window(420, 220)}, k AS (SELECT *, CASE WHEN contains(near, 'rfp') OR contains(near, 'bids') OR contains(near, 'vendor') THEN 'purchase'
      WHEN (contains(near, 'appraisal') OR contains(near, 'easement') OR contains(near, 'parcel')) AND NOT contains(near, 'rfp') THEN 'property' WHEN contains(near, 'settles') OR contains(near, 'claim') THEN 'claim' ELSE 'unknown' END subject FROM w)
    SELECT fact_id, subject, CASE subject WHEN 'purchase' THEN 'contract' WHEN 'property' THEN 'asset' WHEN 'claim' THEN 'settlement' ELSE 'unknown' END AS "scope",
    CASE WHEN subject IN ('purchase', 'property') AND {_RFP} <> '' AND s < strpos(x, {_RFP}) - 1 THEN 'early_amount'
    WHEN subject = 'purchase' AND {_RFP_ALL} <> '' AND s > strpos(x, {_RFP_ALL}) - 1 + length({_RFP_ALL}) THEN 'late_amount'
    WHEN subject IN ('property', 'claim') AND regexp_matches(rgt, '^(?:is )?as of') THEN 'dated_amount' ELSE 'unknown' END amount FROM k"""
)
def amount_representations(spark: SparkSession, d: str) -> DataFrame:
    """Subject, scope and kind of every amount with a place."""
    rows = _anchored(spark, d)
    rows = rows.withColumn("subject", roles.in_context(rows, SUBJECTS, "unknown", 420, 220))
    scope = F.coalesce(F.create_map(*(F.lit(x) for kv in SCOPES.items() for x in kv))[F.col("subject")], F.lit("unknown"))
    return rows.select("fact_id", "subject", scope.alias("scope"), roles.in_context(rows, AMOUNTS, "unknown", 420, 220, "subject").alias("amount"))
