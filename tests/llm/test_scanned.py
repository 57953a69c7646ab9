from __future__ import annotations

from pyspark.sql import functions as F

from docketry.llm import scanned

PLAIN = "The contractor shall repair the culvert before the meeting of the council and report the number of employees in attendance at once."


def corpus():
    rows = [(f"p{i}", f"u{i}", f"Ordinance {i}-2020\n{PLAIN}\nNotice was given to the employees on 04/0{i % 9 + 1}/2020 as Docket 2020.{1000 + i}.") for i in range(12)]
    rows += [
        ("broken", "ub", "Ordinance 3-2020\nThe contractor shall re-\npair the culvert before the meet¬\ning of the council."),
        ("misread", "um", "Item 4 of 2020\nThe contractor shall repair the culvert before the rneeting of the council."),
        ("figure", "uf", "Item 5 of 2020\nNotice was given to the council on 04/O1/2020."),
        ("head1", "uh1", "Board of Control of Elm\nItem 6 of 2020\n" + PLAIN),
        ("head2", "uh2", "Item 7 of 2020\nThe contractor shall repair the\n- 3 -\nBoard of Control of Elm\nculvert before the meeting of the council."),
        ("page", "up", "Item 8 of 2020\n" + PLAIN + "\n[12]"),
        ("roman", "ur", "Item 9 of 2020\n" + PLAIN + "\niv"),
        ("both", "uo", "BOARD OF CONTROL OF ELM   Page 7\nItem 9 of 2020\n" + PLAIN),
        ("empty", "ue", ""), ("null", "un", None), (None, "ux", PLAIN),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, g string, t string").withColumn("key", F.lit("x")).withColumn("text", F.lit("clash")).withColumn("line", F.lit("x")).withColumn("s", F.lit("x"))


def test_kinds(spark):
    rows = corpus()
    got: dict[str, set] = {}
    for r in scanned.noise(frame(spark, rows + rows[:2]), "k", "g", "t").collect():
        got.setdefault(r["k"], set()).add(r["noise_kind"])
    assert got == {
        "broken": {"broken_word"}, "misread": {"misread"}, "figure": {"misread"}, "head1": {"running_head"}, "head2": {"running_head", "page_no"},
        "page": {"page_no"}, "roman": {"page_no"}, "both": {"running_head", "page_no"},
    }


def test_repair(spark):
    out = {r["k"]: r["t"] for r in scanned.repaired(frame(spark, corpus()), "k", "t").collect()}
    assert out["broken"] == "Ordinance 3-2020\nThe contractor shall repair the culvert before the meeting of the council."
    assert out["misread"].endswith("before the meeting of the council.")
    assert "04/01/2020" in out["figure"]
    assert out["head2"] == "Item 7 of 2020\nThe contractor shall repair the culvert before the meeting of the council."
    assert out["p3"] == out["p3"].strip() and PLAIN in out["p3"]


def test_single_headings_stay(spark):
    rows = [*corpus(), ("own", "uw", "Item 2 of 2020\nThe contractor shall repair the culvert.\nCapital Improvement Program Overview\nThe council shall report the number of employees.")]
    out = {r["k"]: r["t"] for r in scanned.repaired(frame(spark, rows), "k", "t").collect()}
    assert "Capital Improvement Program Overview" in out["own"]
    assert ("own", "running_head") not in {tuple(r) for r in scanned.noise(frame(spark, rows), "k", "g", "t").collect()}


def test_heads_with_figures(spark):
    assert scanned.head("City of Elm 2026 Budget Page 3") == ("City of Elm # Budget", True, True)
    rows = [*corpus()] + [(f"m{i}", f"um{i}", f"Council Minutes March {i + 3}, 2024\nItem No. {i}-2020\n{PLAIN}\nItem No. {i + 50}-2020\n{PLAIN}") for i in range(4)]
    got = {r["k"] for r in scanned.noise(frame(spark, rows), "k", "g", "t").collect() if r["noise_kind"] == "running_head"}
    assert {f"m{i}" for i in range(4)} <= got and not any(k.startswith("p") and k[1:].isdigit() for k in got)
    out = {r["k"]: r["t"] for r in scanned.repaired(frame(spark, rows), "k", "t").collect()}
    assert "Council Minutes" not in out["m1"] and out["m1"].count("Item No.") == 2


def test_neighbours_decide(spark):
    rows = [(f"a{i}", f"a{i}", "We heard the modern burn of the mill.") for i in range(200)] + [(f"c{i}", f"c{i}", "They swept the old barn by the road.") for i in range(200)]
    rows += [(f"d{i}", f"d{i}", "He read dear letters aloud today.") for i in range(40)] + [(f"e{i}", f"e{i}", "Skies were clear above town today.") for i in range(40)]
    rows += [("x", "x", "Skies were c1ear above town today."), ("y", "y", "He read d3ar letters aloud today."), ("z", "z", "He read cIear letters aloud today.")]
    rows += [(f"r{i}", f"r{i}", "Old folk call this hillside rnodern gate field.") for i in range(4)] + [("w", "w", "We heard the rnodern burn of the mill.")]
    read = scanned._rows(frame(spark, rows), "k", "g", "t").mapInArrow(scanned._read, scanned._READ).withColumn("id", F.col("key"))
    wrong = {(r["id"], r["word"]): r["right"] for r in scanned.misreadings(read).collect()}
    assert wrong["x", "c1ear"] == "clear" and wrong["z", "ciear"] == "dear"
    assert wrong["w", "rnodern"] == "modern"  # its neighbours are those of the known form
    assert not any(k.startswith("r") for k, _ in wrong)  # beside these no known form has stood


def test_page_numbers():
    assert all(scanned.page_number(x) for x in ("12", "- 3 -", "—9—", "[4]", "Page 7 of 12", "pg 9", "p. 4", "xlvi", "iii", "Page l2"))
    assert not any(scanned.page_number(x) for x in ("civil", "lot 12.", "9-9.", "12.", "I am", "page 9 of the report.", "Docket 2020.1", ""))


def test_numbers():
    assert scanned.numbers_misread("lot 26B72 and") and scanned.numbers_misread("$2S7,534") and scanned.numbers_misread("2O26-01-01")
    assert not scanned.numbers_misread("File 59810-B21 for $2.66B and USD 3B, 4,043 L")
    assert scanned.numbers_misread("File 59810-K2O closed")


def test_skeleton_groups_confusable_forms():
    for a, b in (("employee", "ernployee"), ("immediate", "immecliate"), ("supply", "siipply"), ("which", "wliich"), ("owing", "ovving"), ("report", "rep0rt"), ("storage", "stor@ge")):
        assert scanned.skeleton(a) == scanned.skeleton(b)


def test_empty(spark):
    assert scanned.noise(frame(spark, []), "k", "g", "t").count() == 0
    assert scanned.repaired(frame(spark, []), "k", "t").count() == 0
