from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry.operators import layout, observations, roles, similarity
from docketry.operators.roles import Component, ContextRule, Identity, KeyPolicy

POLICY = KeyPolicy("p", "items", r"\bGP\s*(\d{3,5})\b", (Identity("change", "change_order", r"(?i)\bchange order (\d+) with (.+?) in the amount", (Component("change_order_number", 1, "number"), Component("counterparty", 2, "party"))), Identity("award", "award", r"\baward to ([A-Z]\w+)", (Component("counterparty", 1, "party"),))))
SCHEMA = "segment_id string, evidence_id string, artifact_id string, rule_name string, raw_text string, char_start int, char_end int"


def frame(spark, texts):
    return spark.createDataFrame([(f"s{i}", f"e{i}", "a", rule, t, 10, 10 + len(t or "")) for i, (rule, t) in enumerate(texts)], SCHEMA).withColumn("status_", F.lit("clash"))


def test_matter_keys(spark):
    texts = [
        ("items", "GP 0123: Change order 007 with A. & B. Co. in the amount of $5"), ("items", "GP123 and GP 123, change order 7 with a and b co in the amount"), ("other", "GP 123 award to Acme"), ("items", "GP 123 GP 456 award to Acme"),
        ("items", "award to Acme"), ("items", "GP 123 only"), ("items", "GP 123 award to Acme, award to Bolt"), ("items", None), (None, ""), ("items", "GP 123 change order 9 with ., in the amount"),
    ]
    got = {r["segment_id"]: r for r in roles.matter_keys(frame(spark, texts), POLICY).collect()}
    assert [got[f"s{i}"]["status"] for i in range(10)] == ["resolved", "resolved", "insufficient_identity", "ambiguous", "insufficient_identity", "insufficient_identity", "ambiguous", "insufficient_identity", "insufficient_identity", "insufficient_identity"]
    assert got["s0"]["matter_key"] == got["s1"]["matter_key"] and got["s1"]["reasons"] == ["repeated_same_project_id"]
    assert got["s2"]["reasons"] == ["segment_rule_not_in_policy_scope"] and got["s4"]["reasons"] == ["missing_project_id"] and got["s5"]["reasons"] == ["unrecognized_transaction_identity"]
    assert got["s9"]["reasons"] == ["missing_counterparty"]
    for c in got["s0"]["components"]:
        assert texts[0][1][c["char_start"] : c["char_end"]] == c["raw"]
    assert {c["role"]: c["normal"] for c in got["s0"]["components"]} == {"project_id": "123", "transaction_role": "change_order", "change_order_number": "7", "counterparty": "a and b co"}
    assert roles.matter_keys(frame(spark, texts).limit(0), POLICY).count() == 0


def test_amount_roles_by_exact_span(spark):
    text = "GP 123 award to Acme in the sum of $50 and the fee of $7 and $9"
    keyed = roles.matter_keys(frame(spark, [("items", text)]), POLICY)
    at = lambda s: 10 + text.index(s)
    facts = [("f1", "e0", "50.00", at("$50"), at("$50") + 3), ("f2", "e0", "7.00", at("$7"), at("$7") + 2), ("f3", "e0", "9.00", at("$9"), at("$9") + 2), ("f4", "e0", "5.00", at("$50"), at("$50") + 2), ("f5", "e0", None, None, None)]
    df = spark.createDataFrame(facts + facts[:1], "fact_id string, evidence_id string, normalized_text string, char_start int, char_end int")
    rules = [("sum", "price", r"in the sum of (\$\d+)"), ("of", "fee", r"of (\$\d+)")]
    got = {r["fact_id"]: (r["status"], r["role"], r["rules"]) for r in roles.amount_roles(keyed, df, rules).collect()}
    assert got == {"f1": ("ambiguous", None, ["sum", "of"]), "f2": ("assigned", "fee", ["of"]), "f3": ("unknown", None, []), "f4": ("unknown", None, [])}


def test_context_rules(spark):
    rows = [("Paid the sum of  $5 for X", 17, 19, "5.00"), ("no $6 here", 3, 5, "6.00"), ("RFP 1 then $7", 11, 13, "7.00")]
    df = spark.createDataFrame(rows, "text string, char_start int, char_end int, normalized_text string")
    rules = [ContextRule("sum", all=("paid",), any=("SUM  of", "x"), none=("rfp",), left="sum of$", right="^for"), ContextRule("six", numbers=("6.00",)), ContextRule("after", after=r"RFP \d")]
    assert [r[0] for r in df.select(roles.in_context(df, rules, "none", 30, 20)).collect()] == ["sum", "six", "after"]


def test_observations(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "before string, after string")
    units = spark.createDataFrame([("a", "page", "1", "ea", "x1", "old"), ("b", "page", "1", "eb", "x2", "new"), ("b", "page", "2", "eb2", None, None), ("c", "page", "1", "ec", "x3", "new"), ("c", "page", "2", "ec2", "x4", "")], "artifact_id string, unit_type string, locator string, evidence_id string, extraction_id string, text string")
    values = spark.createDataFrame([("a", "money", "1.00"), ("a", "money", "1.00"), ("b", "money", "1.00"), ("b", "date", "2024-01-01")], "artifact_id string, kind string, value string")
    got = {(r["before"], r["after"]): r for r in observations.changes_of_pairs(pairs, units, values).collect()}
    assert (got["a", "b"]["units_changed"], got["a", "b"]["removed"], got["a", "b"]["added"]) == (2, ["money:1.00"], ["date:2024-01-01"])
    assert got["b", "c"]["units_changed"] == 0 and got["a", "b"]["inputs"] != got["b", "c"]["inputs"]
    asked = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", None, "b"), ("r4", "a", "a"), ("r5", "a", "d")], "r string, before string, after string")
    full = spark.createDataFrame([(x, x != "d") for x in "abcd"], "artifact_id string, has_text boolean")
    compared = observations.changes_of_pairs(asked.where("before <> after"), units, values)
    none = spark.createDataFrame([], "observation_id string")
    first = observations.observed(asked, compared, full, none)
    assert {r["r"]: r["status"] for r in first.collect()} == {"r1": "observed", "r2": "unchanged", "r3": "missing_artifact", "r4": "same_artifact", "r5": "insufficient_evidence"}
    again = observations.observed(asked, compared, full, first.where("observation_id is not null").select("observation_id"))
    assert {r["r"]: r["status"] for r in again.collect()}["r1"] == "already_observed"


def test_nearest_by_rings_equals_all_pairs(spark):
    import random

    rnd = random.Random(6)
    rows = [(p, i, x, y, x + 2, y + 1) for p in range(3) for i in range(60) for x, y in [(rnd.choice([0.0, 1000.0]) + rnd.random() * 20, rnd.random() * (1 if p else 900))]] + [(9, 1, 0.0, 0.0, 1.0, 1.0), (8, 1, 0.0, 0.0, 1.0, 1.0), (8, 2, 0.0, 0.0, 1.0, 1.0)]
    regions = spark.createDataFrame(rows, "page int, region long, x0 double, y0 double, x1 double, y1 double")
    every = layout.relations(regions).groupBy("page", "s_region").agg(F.min(F.struct("distance", "t_region")).alias("m")).collect()
    got = {(r["page"], r["s_region"]): (r["distance"], r["t_region"]) for r in layout.nearest(regions).collect()}
    assert got == {(r["page"], r["s_region"]): (r["m"]["distance"], r["m"]["t_region"]) for r in every}
    near = {(r["page"], r["s_region"], r["t_region"]) for r in layout.within(regions, 5.0, 1000).collect()}
    assert near == {(r["page"], r["s_region"], r["t_region"]) for r in layout.relations(regions).where("distance <= 5").collect()}


def test_limits_are_checked(spark):
    empty = spark.createDataFrame([], "id string, family string, text string")
    for bad in ((0, 0.6, 3, 64), (3, 1.5, 3, 64), (3, 0.6, 0, 64), (3, 0.6, 3, 1)):
        with pytest.raises(ValueError):
            similarity.near_duplicates(empty, *bad)
    assert similarity.near_duplicate_counters(empty, 3, 0.6, 3, 64).first()["matched"] == 0
