from __future__ import annotations

import random
import sqlite3
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docketry.operators import changes, evaluation, evidence, facts, layout, linkage, search, segments, similarity, versions

T0 = datetime(2024, 1, 1)


def test_preferred_and_latest(spark):
    rows = [("u", "a", 0.9, T0), ("u", "b", 0.9, T0 + timedelta(1)), ("u", "c", None, T0 + timedelta(9)), ("v", "d", None, None), ("v", "e", None, None), ("v", "e", None, None), (None, "f", 0.1, T0)]
    df = spark.createDataFrame(rows, "evidence_id string, extraction_id string, quality_score double, occurred_at timestamp")
    assert {r[0]: r[1] for r in evidence.preferred_extractions(df).select("evidence_id", "extraction_id").collect()} == {"u": "b", "v": "e", None: "f"}
    assert {r[0]: r[1] for r in evidence.latest_extractions(df).select("evidence_id", "extraction_id").collect()}["u"] == "c"
    assert evidence.preferred_extractions(df.limit(0)).count() == 0
    units = spark.createDataFrame([("u",), ("w",)], "evidence_id string")
    assert sorted(r["evidence_id"] for r in evidence.review_queue(units, df, 0.95).collect()) == ["u", "w"]
    with pytest.raises(ValueError):
        evidence.review_queue(units, df, 2)


def test_append_only(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, v int")
    assert [(r["k"], r["v"]) for r in evidence.append_new(new, old, "k").collect()] == [("b", 3)]
    assert evidence.orphans(new, old, "k").count() == 2


VISITS = [("s", 1, "A"), ("s", 2, None), ("s", 3, "B"), ("s", 4, "A"), ("s", 5, "A"), ("t", 1, None), ("t", 2, "A")]
STATES = {("s", 1): "new", ("s", 2): "unavailable", ("s", 3): "changed", ("s", 4): "changed", ("s", 5): "unchanged", ("t", 1): "unavailable", ("t", 2): "new"}


def visits(spark, rows=VISITS):
    return spark.createDataFrame([(s, T0 + timedelta(hours=n), n, a) for s, n, a in rows], "source string, at timestamp, seq long, artifact string")


def test_visit_states(spark):
    states = changes.visit_states(visits(spark))
    assert {(r["source"], r["seq"]): r["state"] for r in states.collect()} == STATES
    assert [(r["source"], r["seq"]) for r in changes.reversions(states).collect()] == [("s", 4)]
    assert {r["state"]: r["visits"] for r in changes.state_counts(states.where("source = 's'")).collect()} == {"new": 1, "unavailable": 1, "changed": 2, "unchanged": 1}
    assert {r["source"]: r["artifact"] for r in changes.latest_successful(visits(spark)).collect()} == {"s": "A", "t": "A"}
    assert sorted((r["artifact"], r["visits"]) for r in changes.change_runs(states.where("source = 's'")).collect()) == [("A", 1), ("A", 2), ("B", 1)]
    assert changes.visit_states(visits(spark, [])).count() == 0


def test_sequence_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 7), (None, 3), ("a", None)], "grp string, number long")
    assert sorted((r["grp"], r["missing"]) for r in changes.sequence_gaps(df).collect()) == [("a", 2), ("a", 3)]


ROW = '{"columns":{"award_date":"08/18/2026","amount":"250000","contract_id":"C-001","vendor":"Acme","fee":"=C2*2","total":" "},"raw":[]}'
PROSE = {
    "Approved August 18, 2026 for $410,000. Internal count: 93821.": (["410000.00"], ["2026-08-18"]),
    "Total expenditure (if applicable): $ 51 ,780.00": (["51780.00"], []),
    "Sold over $138MM since 2013, 466+ transactions": (["138000000.00"], []),
    "Reported exposure: $138XYZ during the period.": ([], []),
    "range $20,001___- $100,000 Applicable Fee $500": (["100000.00", "500.00"], []),
    "$20,001 - $100,000 on 2024-02-30 and 2/29/2024": (["20001.00", "100000.00"], ["2024-02-29"]),
    "": ([], []),
}


def test_facts_of_rows_and_prose(spark):
    texts = [ROW, *PROSE, None, "{not json $5"]
    df = spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(texts)], "evidence_id string, t string").withColumn("fact", F.lit("x"))
    got: dict = {}
    for r in facts.extracted_facts(df.drop("fact"), "t").collect():
        got.setdefault(r["evidence_id"], []).append(r)
    assert {(r["fact_type"], r["field_name"], r["normalized_text"]) for r in got["e0"]} == {("money", "amount", "250000.00"), ("date", "award_date", "2026-08-18"), ("identifier", "contract_id", "c-001")}
    for i, (text, (money, dates)) in enumerate(PROSE.items(), 1):
        own = got.get(f"e{i}", [])
        assert sorted(r["normalized_text"] for r in own if r["fact_type"] == "money") == sorted(money), text
        assert [r["normalized_text"] for r in own if r["fact_type"] == "date"] == dates, text
        assert all(text[r["char_start"] : r["char_end"]] == r["raw_text"] for r in own)
    assert [r["normalized_text"] for r in got[f"e{len(texts) - 1}"]] == ["5.00"]


def test_parser_versions(spark):
    df = spark.createDataFrame([("a", "Total $ 51 ,780.00 and $138MM")], "k string, t string")
    one = [[f["normalized_text"] for f in df.select(facts.prose_money(F.col("t"), v)).first()[0]] for v in (1, 2, 3)]
    assert one == [["51.00", "138.00"], ["51780.00", "138000000.00"], ["51780.00", "138000000.00"]]
    assert {r["outcome"] for r in facts.parser_delta(df, "t", "k", 1, 3).collect()} == {"changed"}


def test_fact_ranges(spark):
    df = spark.createDataFrame([("f1", "e", "money", None, 5.0), ("f2", "d", "money", None, 5.0), ("f3", "e", "money", None, None), ("f4", "e", "identifier", "c-1", None), ("f5", "e", "date", "2024-01-02", None)], "fact_id string, evidence_id string, fact_type string, normalized_text string, numeric_value double")
    assert [r["fact_id"] for r in facts.money_between(df, 1.0, None, 5).collect()] == ["f2", "f1"]
    assert [r["fact_id"] for r in facts.with_identifier(df, " C-1 ", 5).collect()] == ["f4"]
    assert facts.dates_between(df, "2024-01-03", None, 5).count() == 0
    for bad in (lambda: facts.money_between(df, 2.0, 1.0, 5), lambda: facts.money_between(df, None, None, 0)):
        with pytest.raises(ValueError):
            bad()


def test_bm25_equals_fts5(spark):
    rnd = random.Random(4)
    words = ["storm", "water", "sewer", "bond", "park", "señal", "levee", "the"]
    docs = [(f"d{i:03d}", " ".join(rnd.choices(words, k=rnd.randrange(1, 30)))) for i in range(80)] + [("blank", "  "), ("null", None)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, content, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into f values (?, ?)", [d for d in docs if d[1] and d[1].strip()])
    index = search.build(spark.createDataFrame(docs, "k string, t string"), "k", "t")
    for query in ("storm water", "the the bond", "senal"):
        terms = " AND ".join(f'"{t}"' for t in search.query_terms(query))
        want = db.execute("select id, bm25(f) from f where f match ? order by bm25(f), id limit 10", (terms,)).fetchall()
        got = [(r["id"], r["score"]) for r in search.search(index, query, 10).collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))
    with pytest.raises(ValueError):
        search.query_terms(" !? ")


def test_segments(spark):
    text = "AGENDA HEADER\nOrdinance 3/2026\nAward a contract for $100.00.\n\nOrdinance 52/2026\nPay the sum of $57,000.00.\n1.\n"
    rule = segments.Rule("board", "^Board", r"(?m)^Ordinance (\d+/\d{4})$", "agenda_item", 25)
    df = spark.createDataFrame([("e", text, ["Board of Control"]), ("f", text, ["Council"]), ("g", None, ["Board"])], "evidence_id string, t string, source_names array<string>")
    got = sorted(segments.cut_segments(df, "t", [rule]).collect(), key=lambda r: r["char_start"])
    assert [r["anchor_text"] for r in got] == ["3/2026", "52/2026"]
    assert all(text[r["char_start"] : r["char_end"]] == r["raw_text"] and r["evidence_id"] == "e" for r in got)
    assert len({r["segment_id"] for r in got}) == 2


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(7)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("aeiou") for _ in range(30)] for _ in range(15)]
    rows = []
    for i in range(60):
        t = list(base[i % 15])
        for _ in range(rnd.randrange(3)):
            t[rnd.randrange(30)] = "zz"
        rows.append((f"i{i:02d}", f"f{i % 7}", " ".join(t)))
    rows += [("short", "f9", "a b"), ("null", "f9", None)]
    got = {(r["a"], r["b"]) for r in similarity.near_duplicates(spark.createDataFrame(rows, "id string, family string, text string"), 3, 0.6, 3, 64).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, _, t in rows if t}
    fam = {i: f for i, f, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and fam[a] != fam[b] and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got == want


def test_reachable_and_families(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(25)] + [("z", "z"), (None, "q")]
    got = {r["id"]: r["root"] for r in similarity.smallest_reachable(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {**{f"n{i:02d}": "n00" for i in range(26)}, "z": "z"}
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    rel = spark.createDataFrame([("b", "x", "a"), ("c", "y", "a")], "source_id string, relation_type string, related_source_id string")
    assert {r["source_id"]: r["root"] for r in similarity.families(sources, rel, "x").collect()} == {"a": "a", "b": "a", "c": "c"}


def test_version_diffs(spark):
    b = spark.createDataFrame([("p", "page:1", "x"), ("p", "page:2", None), ("p", "page:3", "y")], "pair string, locator string, text string")
    a = spark.createDataFrame([("p", "page:1", "x2"), ("p", "page:2", None), ("p", "page:4", "y")], "pair string, locator string, text string")
    assert {r["locator"]: r["outcome"] for r in versions.unit_diff(b, a, ["pair", "locator"]).collect()} == {"page:1": "changed", "page:2": "unchanged", "page:3": "removed", "page:4": "added"}
    old = spark.createDataFrame([("p", 100), ("p", 100), ("p", 50), ("p", 9)], "pair string, v int").withColumn("v", F.col("v").cast("decimal(18,2)"))
    new = spark.createDataFrame([("p", 100), ("p", 50), ("p", 300), ("p", 9)], "pair string, v int").withColumn("v", F.col("v").cast("decimal(18,2)"))
    diff = versions.multiset_diff(old, new, ["pair"], "v")
    assert {int(r["v"]): (r["removed"], r["added"], r["kept"]) for r in diff.collect()} == {100: (1, 0, 1), 50: (0, 0, 1), 300: (0, 1, 0), 9: (0, 0, 1)}
    assert [(int(r["old"]), int(r["new"]), int(r["base"]), r["multiple"]) for r in versions.arithmetic_relations(diff, ["pair"], "v").collect()] == [(100, 300, 50, 4)]
    x, y = "abc " * 80, "abd " * 79 + "tail"
    df = spark.createDataFrame([(x, y), (None, y)], "x string, y string").select(versions.sequence_ratio("x", "y"))
    assert [r[0] for r in df.collect()] == [round(SequenceMatcher(None, x, y).ratio(), 6), None]


def test_layout(spark):
    words = spark.createDataFrame(
        [(1, "Grand", 0.0, 0.0, 5.0, 1.0, 0, 0, 0), (1, "Total:", 6.0, 0.0, 9.0, 1.0, 0, 0, 1), (1, "$5", 20.0, 0.0, 22.0, 1.0, 0, 1, 0), (1, " ", 1.0, 1.0, 2.0, 2.0, 0, 1, 1)],
        "page int, text string, x0 double, y0 double, x1 double, y1 double, block int, line int, word int",
    )
    ordered = layout.ordered_words(words)
    assert sorted((r["order_index"], r["text"]) for r in ordered.collect()) == [(1, "Grand"), (2, "Total:"), (3, "$5")]
    assert {r["line"]: (r["text"], r["x1"]) for r in layout.lines(ordered).collect()} == {0: ("Grand Total:", 9.0), 1: ("$5", 22.0)}
    assert [tuple(r) for r in layout.phrase_regions(ordered, ["grand", "total"]).collect()] == [(1, 1, 0.0, 0.0, 9.0, 1.0)]
    spans = spark.createDataFrame([(1, "Grand  Total: $5", 7, 12), (1, "Grand  Total: $5", 14, 16), (1, "Other", 0, 2)], "page int, source_text string, char_start int, char_end int")
    got = {(r["char_start"], r["status"]): (r["words"], r["x0"], r["x1"]) for r in layout.anchored_spans(ordered, spans).collect()}
    assert got == {(7, "anchored"): (1, 6.0, 9.0), (14, "anchored"): (1, 20.0, 22.0), (0, "unaligned"): (0, None, None)}
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 1.0), (1, 2, 3.0, 0.0, 5.0, 1.0), (1, 3, 30.0, 0.5, 31.0, 2.0), (2, 4, 0.0, 0.0, 1.0, 1.0)], "page int, region int, x0 double, y0 double, x1 double, y1 double")
    rel = layout.relations(regions)
    r = rel.where("s_region = 1 and t_region = 2").first()
    assert (r["dx"], r["dy"], r["distance"], r["x_gap"], r["y_overlap"], r["direction"]) == (3.0, 0.0, 3.0, 1.0, 1.0, "right")
    assert {(r["s_region"], r["t_region"], r["mutual"]) for r in layout.nearest(regions).collect()} == {(1, 2, True), (2, 1, True), (3, 2, False)}
    assert layout.within(regions, 10.0, 1).count() == 2


def test_references_and_keys(spark):
    df = spark.createDataFrame([("e", "See PC-2024-007-cu, D - 12 - 3 and Ordinance No. 12 - 2024."), ("f", "ORDINANCE 12-2024"), ("g", None)], "evidence_id string, t string")
    found = linkage.references(df, "t")
    assert {(r["evidence_id"], r["normalized_key"]) for r in found.collect()} == {("e", "PC-2024-7-CU"), ("e", "D-12-3"), ("e", "ORDINANCE-12-2024"), ("f", "ORDINANCE-12-2024")}
    assert [(r["normalized_key"], r["units"]) for r in linkage.key_matches(found, "kind", "normalized_key", "evidence_id").collect()] == [("ORDINANCE-12-2024", 2)]
    rules = [linkage.KeyRule("contract", r"(C-\d+)"), linkage.KeyRule("lot", r"lot (\d+)", required=False)]
    segs = spark.createDataFrame([("a", "C-1 and C-1"), ("b", "C-1 or C-2"), ("c", "none"), ("d", "C-9 lot 1 lot 2"), ("e", None)], "k string, t string")
    got = {r["k"]: (r["status"], r["reasons"]) for r in linkage.resolved_keys(segs, "t", "k", rules).collect()}
    assert got == {"a": ("resolved", ""), "b": ("ambiguous", "ambiguous:contract"), "c": ("insufficient", "missing:contract"), "d": ("ambiguous", "ambiguous:lot")}
    text = F.lit("The quick  brown fox")
    assert spark.range(1).select(linkage.context(text, F.lit(4), F.lit(9), 5)).first()[0] == "the quick bro"


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", "m", False), ("b", "m", False), ("c", "n", True), ("d", "n", False), ("e", "n", True), ("f", "m", False)], "case_id string, mode string, expect_empty boolean")
    expected = spark.createDataFrame([("a", "t1", "1"), ("a", "t2", "2"), ("b", "t3", "3"), ("d", "t4", None), ("f", "t5", "6")], "case_id string, target string, evidence_id string")
    returned = spark.createDataFrame([("a", "1", True), ("a", "1", True), ("b", "9", True), ("c", "5", True), ("f", "6", False)], "case_id string, evidence_id string, valid boolean")
    results = evaluation.case_results(cases, expected, returned)
    assert {r["case_id"]: r["failure"] for r in results.collect()} == {"a": "partial_target_recall", "b": "miss_all_targets", "c": "unexpected_results", "d": "unresolved_target", "e": None, "f": "invalid_provenance"}
    m = {r["mode"]: r for r in evaluation.metrics(results).collect()}
    assert m["all"]["hit_rate"] == 0.5 and abs(m["m"]["target_recall"] - 2 / 4) < 1e-9 and m["n"]["negative_accuracy"] == 0.5 and m["all"]["positives"] == 4 and abs(m["m"]["mean_recall"] - 0.5) < 1e-9
    s = {r["mode"]: r for r in evaluation.scorable(results).collect()}
    assert s["all"]["unscorable"] == 1 and s["all"]["cases"] == 5 and s["n"]["positives"] == 0 and s["n"]["hit_rate"] == 1.0


def test_phrase_quality(spark):
    rows = [("Agenda", "too_short"), ("Contact Item Details", "publisher_ui_fragment"), ("Main Street Ward", "trailing_incomplete_phrase"), ("Water over Water", "repeated_edge_token"), ("Special Permit", "generic_heading_start"), ("Budget March Summary", "calendar_heading"), ("Old Ordinance Text", "record_metadata_fragment"), ("The Building Code", "generic_institutional_heading"), ("Old Plans Support", "procedural_boilerplate"), ("GRAND TOTALS", "all_caps_fragment"), ("GRAND BRIDGE", None), ("Harbor Bridge (East)", None)]
    got = {r["p"]: r["q"] for r in spark.createDataFrame([(p,) for p, _ in rows], "p string").select("p", evaluation.phrase_quality(F.col("p")).alias("q")).collect()}
    assert {p: q["reason"] for p, q in got.items()} == dict(rows)
    assert got["Harbor Bridge (East)"][1:] == (1, 1, 2, 16)


def test_stored_index_and_many_queries(spark, tmp_path):
    docs = [(f"d{i:02d}", f"alpha beta {'gamma ' * (i % 4)}word{i}") for i in range(30)]
    built = search.build(spark.createDataFrame(docs, "k string, t string"), "k", "t")
    built.save(str(tmp_path / "index"))
    stored = search.LexicalIndex.load(spark, str(tmp_path / "index"))
    want = [tuple(r) for r in search.search(built, "gamma beta", 7).collect()]
    assert [tuple(r) for r in search.search(stored, "gamma beta", 7).collect()] == want
    cases = spark.createDataFrame([("one", "Gamma, beta"), ("two", "word3"), ("none", "absent beta"), ("blank", " ?! ")], "case_id string, query string")
    many = search.search_many(stored, cases, 7).orderBy("case_id", "rank").collect()
    assert [(r["id"], round(r["score"], 9)) for r in many if r["case_id"] == "one"] == [(i, round(x, 9)) for i, x in want]
    assert [r["id"] for r in many if r["case_id"] == "two"] == ["d03"] and {r["case_id"] for r in many} == {"one", "two"}
    plan = stored.of_terms(["gamma"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    text = " ".join(f"w{i}" for i in range(40))
    got = spark.range(1).select(search.snippet(F.lit(text), F.array(F.lit("w20"))).alias("s")).first()["s"]
    assert got.startswith("… w12 ") and " [w20] " in got and got.endswith(" w35 …")
