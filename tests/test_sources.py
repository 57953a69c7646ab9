from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docketry.sources import documents, links
from docketry.sources.recorded import RecordedResponses

HTML = "<!doctype html><html><head><style>x{}</style><script>var t='</p>';</script></head><body><h2>City  Council</h2><p>Agenda\t for <b>May</b></p><ul><li><a href='/a?x=1'>Minutes <i>pdf</i></a></li><li>Two&amp;</li></ul></body></html>"
CSV = "﻿contract_id,vendor,vendor\nC-1,Acme,Inc\n , ,\nC-2,Bolt\n".encode()


def test_visible_text():
    assert documents.visible_text(HTML) == "City Council\nAgenda for May\nMinutes pdf\nTwo&"


def test_blocks_of_tables_and_figures():
    page = "<table><caption>One</caption><thead><tr><th>A</th></tr></thead><tbody><tr><td>B</td></tr></tbody></table>x<figure>y<figcaption>z</figcaption></figure>w<fieldset>v</fieldset>"
    assert documents.visible_text(page) == "One\nA\nB\nxy\nz\nwv"


def test_csv_units():
    units = documents.csv_units(CSV)
    assert [u[1] for u in units] == ["sheet:CSV!A1:C1", "sheet:CSV!A2:C2", "sheet:CSV!A4:B4"]
    assert json.loads(units[1][2]) == {"columns": {"contract_id": "C-1", "vendor": "Acme", "vendor__C": "Inc"}, "raw": ["C-1", "Acme", "Inc"]}
    assert documents.csv_units(b"") == []
    assert [documents.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_files_to_units(spark, tmp_path):
    for name, content in (("a.html", HTML.encode()), ("b.csv", CSV), ("c.txt", b"plain \xff text"), ("d.pdf", b"%PDF-1.7"), ("e.html", HTML.encode())):
        (tmp_path / name).write_bytes(content)
    files = documents.read_files(spark, str(tmp_path))
    assert files.select("sha256").distinct().count() == 4
    media = {r["path"].rsplit("/", 1)[-1]: (r["m"], r["r"]) for r in files.select("path", documents.sniffed(F.col("content")).alias("m"), documents.reader_of(F.lit(None).cast("string"), F.col("path")).alias("r")).collect()}
    assert media["a.html"] == ("text/html", "html") and media["d.pdf"] == ("application/pdf", "pdf") and media["c.txt"] == (None, "text")
    units = documents.evidence_units(files.select(F.concat(F.lit("artifact:"), "sha256").alias("artifact_id"), documents.reader_of(F.lit("").cast("string"), F.col("path")).alias("reader"), "content"))
    rows = units.collect()
    assert sum(r["error"] == "no reader" for r in rows) == 1 and sum(r["unit_type"] == "record" for r in rows) == 3
    mine = documents.evidence_units(files.where("path like '%.pdf'").select(F.lit("x").alias("artifact_id"), F.lit("pdf").alias("reader"), "content"), {"pdf": lambda b: [("page", "page:1", b.decode())]})
    assert [r["text"] for r in mine.collect()] == ["%PDF-1.7"]
    bad = documents.evidence_units(files.limit(1).select(F.lit("x").alias("artifact_id"), F.lit("boom").alias("reader"), "content"), {"boom": lambda b: 1 / 0})
    assert [r["error"] for r in bad.collect()] == ["ZeroDivisionError"]


def test_escalation(spark):
    units = spark.createDataFrame([("e1", "a", "page", "page:2"), ("e2", "a", "page", "page:3"), ("e3", "a", "record", "record:1")], "evidence_id string, artifact_id string, unit_type string, locator string")
    known = spark.createDataFrame([("e2", 0.9)], "evidence_id string, quality_score double")
    assert [(r["evidence_id"], r["text"]) for r in documents.escalate(units, known, lambda a, p: f"{a}:{p}", 0.7).collect()] == [("e1", "a:2")]


def test_links(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None)], "k int, h string")
    assert [tuple(r) for r in documents.page_links(pages, "k", "h").collect()] == [(1, 0, "City Council", "City Council", "/a?x=1", "Minutes pdf")]
    df = spark.createDataFrame([("https://h/a/b?z=1&y=2&z=3",), ("http://h/x",), (None,)], "u string")
    assert [r[0] for r in df.select(links.signature(F.col("u"))).collect()] == ["/a/b?y&z", "/x?", "?"]
    checks = [("scheme", ~F.col("u").startswith("https")), ("query", ~F.col("u").contains("?"))]
    assert [r[0] for r in df.select(links.first_failure(checks)).collect()] == [None, "scheme", "scheme"]
    rules = [("a", "^https"), ("b", "/x"), ("c", "/b")]
    assert [r[0] for r in df.where("u like 'http:%'").select(links.classified(rules, "d", F.col("u"))).collect()] == ["b"]
    with pytest.raises(Exception, match="ambiguous"):
        df.select(links.classified(rules, "d", F.col("u"))).collect()


def test_samples_don_t_depend_on_order(spark):
    df = spark.createDataFrame([(f"k{i}", f"g{i % 3}") for i in range(50)], "k string, g string")
    one, two = ({r["k"] for r in links.stable_sample(x, "k", 7).collect()} for x in (df, df.orderBy(F.desc("k"))))
    assert one == two and len(one) == 7
    assert links.stable_sample(df, "k", 2, by="g").count() == 6
    assert {r["g"] for r in links.distinct_first_sample(df, "k", "g", 3).collect()} == {"g0", "g1", "g2"}


def test_recorded_responses(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"source_uri": "u", "http_status": 200, "body": "x"}\n\n{"source_uri": "v", "http_status": 503}\n')
    spark.dataSource.register(RecordedResponses)
    rows = spark.read.format("recorded").option("path", str(tmp_path / "*.jsonl")).load().collect()
    assert [(r["source_uri"], r["http_status"], r["body"]) for r in rows] == [("u", 200, "x"), ("v", 503, None)]
