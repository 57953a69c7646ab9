from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import linkage
from docketry.sources import discovery


def test_embedded_objects(spark):
    html = 'var a = data({"x": "}{\\"", "y": {"z": 1}}); data({broken; data({"x": 2})'
    got = discovery.embedded_objects(html, "data(")
    assert [json.loads(g)["x"] for g in got if g.endswith("}")][0] == '}{"'
    df = spark.createDataFrame([(html,), (None,)], "h string")
    assert [len(r[0]) for r in df.select(discovery.embedded(F.col("h"), "data(")).collect()] == [len(got), 0]


def test_published_files(spark):
    files = [
        {"fileId": 7, "type": "Agenda", "name": "a", "url": "https://h/x/fileId=7"}, {"fileId": 8, "type": "Agenda", "name": "b", "url": "https://other/x/fileId=8"},
        {"fileId": 9, "type": "Draft", "name": "c", "url": "https://h/x/fileId=9"}, {"fileId": 1, "type": "Agenda", "name": "d", "url": "https://h/x/fileId=2"}, {"fileId": 3, "type": "Agenda", "name": "e", "url": "https://h/x/fileId=3?q=1"},
    ]
    df = spark.createDataFrame([(1, json.dumps({"publishedFiles": files}), "https://h/meta"), (2, "no json", "https://h/m"), (3, None, None)], "k int, p string, u string")
    assert [(r["k"], r["file_id"]) for r in discovery.published_files(df, "k", "p", "u", ["Agenda"]).collect()] == [(1, "7")]


def test_agreed_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in discovery.agreed(df, "k", "v").collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="differing rows of 1"):
        discovery.agreed(df.union(spark.createDataFrame([(1, "b")], df.schema)), "k", "v").collect()


def test_archived_versions(spark):
    links = spark.createDataFrame([("l", "May", "/AgendaCenter/ViewFile/1"), ("l", "May", "/agendacenter/archivedagenda/9"), ("l", "June", "/AgendaCenter/ViewFile/2"), ("m", "May", "/ArchivedAgenda/3")], "listing string, heading string, href string")
    got = discovery.archived_versions(spark.createDataFrame([("l",)], "listing string"), links).collect()
    assert [tuple(r) for r in got] == [("l", "/AgendaCenter/ViewFile/1", "/agendacenter/archivedagenda/9")]


def test_date_references(spark):
    df = spark.createDataFrame([("e", "On 2/30/2024 and 2/3/24, March 5th; Apr 6, 2020; May 40", "2023-07-01"), ("f", "March 5", None)], "evidence_id string, t string, d string").withColumn("d", F.col("d").cast("date"))
    got = {(r["evidence_id"], r["normalized_key"], r["basis"]) for r in linkage.date_references(df, "t", "d").collect()}
    assert got == {("e", "2024-02-03", "literal_date"), ("e", "2023-03-05", "context_year"), ("e", "2020-04-06", "literal_date")}
