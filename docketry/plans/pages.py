"""Queries over words on pages, made here from the texts of documents in a known layout: ten words to a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import layout
from docketry.plans.registry import query
from docketry.sources.tables import table

_W = """w AS (SELECT doc_id page, i - 1 AS k, ws[i] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r\\x0b]+'), lambda x: x <> '') ws FROM documents WHERE text IS NOT NULL))),
o AS (SELECT page, t AS text, ((k % 10) * 50.0)::DOUBLE AS x0, ((k // 10) * 12.0)::DOUBLE AS y0, ((k % 10) * 50.0 + 5.5 * length(t))::DOUBLE AS x1, ((k // 10) * 12.0 + 10.0)::DOUBLE AS y1, 0 AS block, (k // 10)::INTEGER AS line, (k % 10)::INTEGER word, (k + 1)::INTEGER order_index FROM w)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("page"), F.posexplode(words).alias("k", "text"))
    x0, y0 = (F.col("k") % 10) * 50.0, F.floor(F.col("k") / 10) * 12.0
    return rows.select("page", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.length("text") * 5.5).alias("x1"), (y0 + 10.0).alias("y1"), F.lit(0).alias("block"), F.floor(F.col("k") / 10).cast("int").alias("line"), (F.col("k") % 10).cast("int").alias("word"))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return layout.ordered_words(_words(spark, d))


@query(f"WITH {_W} SELECT page, order_index, text, x0, x1 FROM o")
def page_words(spark: SparkSession, d: str) -> DataFrame:
    """Words in reading order."""
    return _ordered(spark, d).select("page", "order_index", "text", "x0", "x1")


@query(f"""WITH {_W} SELECT page, line, string_agg(text, ' ' ORDER BY order_index) AS text, min(x0) x0, max(x1) x1, count(*) words FROM o GROUP BY 1, 2""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of words with their hulls."""
    return layout.lines(_ordered(spark, d)).select("page", "line", "text", "x0", "x1", "words")


@query(f"""WITH {_W} SELECT page, sha256('[' || string_agg('[' || order_index || ',"' || replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '",' || x0::DECIMAL(18, 3) || ',' || y0::DECIMAL(18, 3) || ',' || x1::DECIMAL(18, 3) || ',' || y1::DECIMAL(18, 3) || ',' || block || ',' || line || ',' || word || ']', ',' ORDER BY order_index) || ']') signature FROM o GROUP BY 1""")
def word_signatures(spark: SparkSession, d: str) -> DataFrame:
    """One hash over all words of a page with their places."""
    return layout.word_signatures(_ordered(spark, d))


@query(f"""WITH {_W}, n AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') v FROM o) SELECT a.page, a.order_index start_index, a.x0, b.x1 FROM n a JOIN n b ON b.page = a.page AND b.order_index = a.order_index + 1 AND b.line = a.line WHERE a.v = 'paving' AND b.v = 'co'""")
def phrase_regions(spark: SparkSession, d: str) -> DataFrame:
    """Where two words stand side by side on a line."""
    return layout.phrase_regions(_ordered(spark, d), ["Paving", "Co"]).select("page", "start_index", "x0", "x1")


@query(
    f"""WITH {_W}, m AS (SELECT doc_id page, text, regexp_extract(text, '\\$\\d[\\d,]*') raw FROM documents WHERE regexp_matches(text, '\\$\\d[\\d,]*')), s AS (SELECT *, strpos(text, raw) - 1 AS char_start FROM m),
    p AS (SELECT page, char_start, char_start + length(raw) char_end, len(list_filter(regexp_split_to_array(substr(text, 1, char_start), '[ \\t\\n\\f\\r\\x0b]+'), lambda x: x <> '')) before, regexp_matches(substr(text, 1, char_start), '[^ \\t\\n\\f\\r\\x0b]$') inside, raw FROM s)
    SELECT p.page, char_start, char_end, order_index first_word, x0, text AS word FROM p JOIN o ON o.page = p.page AND o.order_index = p.before + CASE WHEN inside THEN 0 ELSE 1 END WHERE text = raw"""
)
def anchored_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the first plain amount of each document, found by aligning words and text; amounts that are part of a longer word are left to tests."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("raw", F.regexp_extract("text", r"\$\d[\d,]*", 0)).where("raw <> ''")
    start = F.instr("text", F.col("raw")) - 1
    spans = docs.select(F.col("doc_id").alias("page"), F.col("text").alias("source_text"), start.cast("int").alias("char_start"), (start + F.length("raw")).cast("int").alias("char_end"), "raw")
    words = _ordered(spark, d)
    boxes = layout.anchored_spans(words, spans.drop("raw")).where("status = 'anchored' and words = 1")
    found = boxes.join(words.select("page", "order_index", "text", F.col("x0").alias("wx0"), F.col("y0").alias("wy0")), "page").where("x0 = wx0 and y0 = wy0").join(spans.select("page", "char_start", "raw"), ["page", "char_start"]).where("text = raw")
    return found.select("page", "char_start", "char_end", F.col("order_index").alias("first_word"), "x0", F.col("text").alias("word"))


@query(
    """WITH m AS (SELECT DISTINCT model_version, CASE WHEN model_version IS NULL THEN NULL ELSE 'language=' || split_part(model_version, '-', 1) || ';dpi=' || (200 + length(model_version)) END v FROM evidence_extractions)
    SELECT v AS model, CASE WHEN v IS NULL THEN 'eng' ELSE split_part(model_version, '-', 1) END "language", CASE WHEN v IS NULL THEN 200 ELSE 200 + length(model_version) END dpi FROM m"""
)
def ocr_settings(spark: SparkSession, d: str) -> DataFrame:
    """Language and resolution of readings by the text that records them."""
    m = table(spark, d, "evidence_extractions", "model_version").distinct()
    text = F.when(F.col("model_version").isNotNull(), F.concat(F.lit("language="), F.split("model_version", "-")[0], F.lit(";dpi="), (F.length("model_version") + 200).cast("string")))
    return m.select(text.alias("model")).select("model", *(c.alias(n) for c, n in zip(layout.ocr_settings(F.col("model")), ("language", "dpi"))))


_PAIRS = f"""WITH {_W}, g AS (SELECT * FROM o WHERE order_index <= 20), p AS (SELECT s.page, s.order_index s, t.order_index t, s.line = t.line same_line, round((t.x0 + t.x1) / 2 - (s.x0 + s.x1) / 2, 3) dx, round((t.y0 + t.y1) / 2 - (s.y0 + s.y1) / 2, 3) dy,
  greatest(0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) ox, least(s.x1 - s.x0, t.x1 - t.x0) wx, CASE WHEN s.x1 < t.x0 THEN round(t.x0 - s.x1, 3) WHEN t.x1 < s.x0 THEN round(s.x0 - t.x1, 3) ELSE 0 END x_gap, CASE WHEN s.y1 < t.y0 THEN round(t.y0 - s.y1, 3) WHEN t.y1 < s.y0 THEN round(s.y0 - t.y1, 3) ELSE 0 END y_gap
  FROM g s JOIN g t ON t.page = s.page AND abs(t.order_index - s.order_index) = 1)"""


@query(
    f"""{_PAIRS} SELECT page, s, t, dx, dy, round(CASE WHEN wx > 0 THEN ox / wx ELSE 0 END, 6) x_overlap, x_gap::DOUBLE x_gap, y_gap::DOUBLE y_gap, round(dx / 600, 6) dx_page, round(dy / 800, 6) dy_page, round(round(sqrt(dx * dx + dy * dy), 3) / 1000, 6) distance_page, round(round(sqrt(dx * dx + dy * dy), 3) / 10, 6) distance_height, t - s order_delta, same_line FROM p"""
)
def word_relations(spark: SparkSession, d: str) -> DataFrame:
    """How the first twenty words of each page lie to their neighbours in reading order, also as shares of the page."""
    words = _ordered(spark, d).where("order_index <= 20")
    regions = words.select("page", F.col("order_index").alias("region"), "x0", "y0", "x1", "y1", F.col("order_index").alias("first_word"), F.col("order_index").alias("last_word"), F.concat_ws(":", "block", "line").alias("line_key"), F.lit(10.0).alias("height_sum"), F.lit(1).alias("n_words"))
    near = words.select("page", F.col("order_index").alias("s_region"), F.explode(F.array(F.col("order_index") - 1, F.col("order_index") + 1)).alias("t_region"))
    rel = layout.measured(layout.pair_geometry(near, regions), regions, F.lit(600.0), F.lit(800.0))
    return rel.select("page", F.col("s_region").alias("s"), F.col("t_region").alias("t"), "dx", "dy", "x_overlap", "x_gap", "y_gap", "dx_page", "dy_page", "distance_page", "distance_height", "order_delta", "same_line")
