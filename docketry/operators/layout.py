"""Geometry of words on pages: lines, regions, relations, neighbours, anchors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.ids import stable_id
from docketry.session import cut


def ordered_words(words: DataFrame) -> DataFrame:
    """Words (page, text, x0, y0, x1, y1, block, line, word) with their 1-based reading order."""
    boxed = words.select("page", "text", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")), "block", "line", "word").where("text is not null and trim(text) <> ''")
    w = Window.partitionBy("page").orderBy("block", "line", "word", "y0", "x0", "y1", "x1", "text")
    return boxed.withColumn("order_index", F.row_number().over(w))


def lines(words: DataFrame) -> DataFrame:
    """(page, block, line, text, x0, y0, x1, y1, words): words of a line joined in order, with their hull."""
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda s: s["text"]), " ")
    return words.groupBy("page", "block", "line").agg(text.alias("text"), *hull, F.count("*").alias("words"))


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shared, least = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)), F.least(a1 - a0, b1 - b0)
    return F.when(least > 0, F.round(shared / least, 6)).otherwise(F.lit(0.0))


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.when(a1 < b0, F.round(b0 - a1, 3)).when(b1 < a0, F.round(a0 - b1, 3)).otherwise(F.lit(0.0))


def _geometry(both: DataFrame) -> DataFrame:
    """Centres, distance, overlaps, gaps and direction of rows that hold both boxes (s_x0 ... t_y1)."""
    mid = lambda p, a: (F.col(f"{p}_{a}0") + F.col(f"{p}_{a}1")) / 2
    both = both.withColumn("dx", F.round(mid("t", "x") - mid("s", "x"), 3)).withColumn("dy", F.round(mid("t", "y") - mid("s", "y"), 3))
    c = F.col
    direction = F.when((c("dx") == 0) & (c("dy") == 0), "overlap").when(F.abs("dx") >= F.abs("dy"), F.when(c("dx") > 0, "right").otherwise("left")).otherwise(F.when(c("dy") > 0, "below").otherwise("above"))
    return both.select(
        "page", "s_region", "t_region", "dx", "dy", F.round(F.hypot("dx", "dy"), 3).alias("distance"),
        _overlap(c("s_x0"), c("s_x1"), c("t_x0"), c("t_x1")).alias("x_overlap"), _overlap(c("s_y0"), c("s_y1"), c("t_y0"), c("t_y1")).alias("y_overlap"),
        _gap(c("s_x0"), c("s_x1"), c("t_x0"), c("t_x1")).alias("x_gap"), _gap(c("s_y0"), c("s_y1"), c("t_y0"), c("t_y1")).alias("y_gap"), direction.alias("direction"),
    )


def _side(regions: DataFrame, p: str) -> DataFrame:
    return regions.select("page", *(F.col(c).alias(f"{p}_{c}") for c in ("region", "x0", "y0", "x1", "y1")))


def pair_geometry(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """The geometry of given ordered pairs (page, s_region, t_region) of regions."""
    return _geometry(pairs.join(_side(regions, "s"), ["page", "s_region"]).join(_side(regions, "t"), ["page", "t_region"]))


def relations(regions: DataFrame) -> DataFrame:
    """Ordered pairs of all regions (page, region, x0, y0, x1, y1) of a page with their geometry.

    The result is as large as the square of a page's regions by its definition; ``nearest`` and ``within`` need
    no such pairs.
    """
    return _geometry(_side(regions, "s").join(_side(regions, "t"), "page").where("s_region <> t_region"))


def measured(related: DataFrame, regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """``related`` with distances as shares of the page and of the words' height, the step in reading order, and whether both lie on one line.

    ``regions`` also has first_word, last_word, line_key (null if it spans lines), height_sum and n_words.
    """
    side = lambda p: regions.select("page", *(F.col(c).alias(f"{p}_{c}") for c in ("region", "first_word", "last_word", "line_key", "height_sum", "n_words")))
    rows = related.join(side("s"), ["page", "s_region"]).join(side("t"), ["page", "t_region"])
    mean = (F.col("s_height_sum") + F.col("t_height_sum")) / (F.col("s_n_words") + F.col("t_n_words"))
    share = lambda x, of: F.round(F.when(of > 0, x / of).otherwise(0.0), 6)
    rows = rows.withColumn("dx_page", share(F.col("dx"), width)).withColumn("dy_page", share(F.col("dy"), height)).withColumn("distance_page", share(F.col("distance"), F.hypot(width, height))).withColumn("distance_height", share(F.col("distance"), mean))
    rows = rows.withColumn("order_delta", F.col("t_first_word") - F.col("s_last_word")).withColumn("same_line", F.coalesce(F.col("s_line_key") == F.col("t_line_key"), F.lit(False)))
    return rows.select(*related.columns, "dx_page", "dy_page", "distance_page", "distance_height", "order_delta", "same_line")


def _celled(regions: DataFrame, size: Column) -> DataFrame:
    mid = lambda a: (F.col(f"{a}0") + F.col(f"{a}1")) / 2
    return regions.withColumn("cx", F.floor(mid("x") / size).cast("long")).withColumn("cy", F.floor(mid("y") / size).cast("long"))


def _around(source: DataFrame, target: DataFrame, reach: int) -> DataFrame:
    """The geometry of pairs whose cells (cx, cy) lie at most ``reach`` apart; sources are copied to the cells around, targets are not."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    s = source.select("page", *(F.col(c).alias(f"s_{c}") for c in ("region", "x0", "y0", "x1", "y1")), F.explode(F.transform(step, lambda k: F.col("cx") + k)).alias("cx"), "cy")
    s = s.withColumn("cy", F.explode(F.transform(step, lambda k: F.col("cy") + k)))
    t = target.select("page", "cx", "cy", *(F.col(c).alias(f"t_{c}") for c in ("region", "x0", "y0", "x1", "y1")))
    return _geometry(s.join(t, ["page", "cx", "cy"]).where("s_region <> t_region"))


def nearest(regions: DataFrame) -> DataFrame:
    """The nearest other region of each region (page, region, x0, y0, x1, y1), ties by region, and whether the choice is mutual.

    Found by rings: a page is laid out in square cells that hold about two regions, every region looks into the
    cells around its own, and those whose nearest so far may be beaten from farther away, or who found none, look
    again with cells twice as large, so pairs grow with the regions and not with their square. A region alone on
    its page has no row.
    """
    c = F.col
    spread = regions.groupBy("page").agg(F.count("*").alias("n"), F.greatest(F.max((c("x0") + c("x1")) / 2) - F.min((c("x0") + c("x1")) / 2), F.max((c("y0") + c("y1")) / 2) - F.min((c("y0") + c("y1")) / 2), F.lit(1e-6)).alias("span"))
    sized = cut(regions.join(cut(spread.where("n > 1").select("page", (c("span") / F.sqrt(c("n") / 2)).alias("size"), "span")), "page"))
    open_, best, scale = sized, None, 1.0
    while True:
        size = c("size") * scale
        found = _around(_celled(open_, size), _celled(sized, size), 1).groupBy("page", "s_region").agg(F.min(F.struct("distance", c("t_region").alias("t"))).alias("m"))
        looked = open_.select("page", c("region").alias("s_region"), size.alias("sure"), "span").join(found, ["page", "s_region"], "left")
        # nothing outside the ring is nearer than a cell's side; distances are rounded to thousandths
        done = cut(looked.withColumn("settled", F.coalesce(c("m.distance") < c("sure") - 0.001, F.lit(False)) | (c("sure") > c("span") * 2 + 1)))
        part = done.where("settled and m is not null").select("page", "s_region", c("m.t").alias("t_region"), c("m.distance").alias("distance"))
        best = part if best is None else best.unionByName(part)
        rest = done.where("not settled").select("page", c("s_region").alias("region"))
        if rest.isEmpty():
            break
        open_, scale = cut(sized.join(rest, ["page", "region"], "left_semi")), scale * 2
    best = cut(best)
    back = best.select("page", c("s_region").alias("t_region"), c("t_region").alias("back"))
    return best.join(back, ["page", "t_region"], "left").select("page", "s_region", "t_region", "distance", F.coalesce(c("back") == c("s_region"), F.lit(False)).alias("mutual"))


def within(regions: DataFrame, most: float, limit: int) -> DataFrame:
    """Up to ``limit`` nearest neighbours of each region within a distance: cells of that side, and the ring around each."""
    if most <= 0 or limit < 1:
        raise ValueError("distance and limit must be positive")
    celled = _celled(regions, F.lit(float(most)))
    w = Window.partitionBy("page", "s_region").orderBy("distance", F.abs(F.col("t_region") - F.col("s_region")), "t_region")
    return _around(celled, celled, 1).where(F.col("distance") <= most).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def word_signatures(words: DataFrame) -> DataFrame:
    """(page, signature): one hash over the words of a page in order, with places to three decimals, as a list in JSON."""
    plain = lambda c: F.col(c).cast("decimal(18,3)").cast("string")
    text = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    one = F.concat(F.lit("["), F.concat_ws(",", F.col("order_index").cast("string"), F.concat(F.lit('"'), text, F.lit('"')), *map(plain, ("x0", "y0", "x1", "y1")), *(F.col(c).cast("string") for c in ("block", "line", "word"))), F.lit("]"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("order_index", one.alias("j")))), lambda s: s["j"])
    return words.groupBy("page").agg(F.sha2(F.concat(F.lit("["), F.array_join(every, ","), F.lit("]")), 256).alias("signature"))


def ocr_settings(model: Column) -> tuple[Column, Column]:
    """(language, dpi) of a recorded ``language=...;dpi=...``; English at 200 where none is recorded, an error for any other text."""
    p = r"^\s*language=([^;]+);dpi=(\d+)\s*$"
    fit = model.rlike(p) & (F.regexp_extract(model, p, 2).try_cast("int") >= 72)
    bad = F.raise_error(F.concat(F.lit("unknown settings: "), model))
    blank = F.coalesce(model, F.lit("")) == ""
    return F.when(blank, "eng").when(fit, F.regexp_extract(model, p, 1)).otherwise(bad), F.when(blank, 200).when(fit, F.regexp_extract(model, p, 2).cast("int")).otherwise(bad.cast("int"))


def edges_of(near: DataFrame) -> DataFrame:
    """Undirected edges (a, b) of nearest regions, named page and region, for ``similarity.smallest_reachable``."""
    name = lambda c: F.concat_ws("|", F.col("page").cast("string"), F.lpad(F.col(c).cast("string"), 10, "0"))
    return near.select(name("s_region").alias("a"), name("t_region").alias("b"))


def phrase_regions(words: DataFrame, phrase: list[str]) -> DataFrame:
    """(page, start_index, x0, y0, x1, y1) of every run of words of a line that reads like the phrase."""
    n = len(phrase)
    w = Window.partitionBy("page", "block", "line").orderBy("order_index")
    norm = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    rows = words.withColumn("n", norm)
    hit = F.lit(True)
    for k, p in enumerate(phrase):
        hit = hit & F.coalesce(F.lead("n", k).over(w) == p.casefold(), F.lit(False))
    span = w.rowsBetween(0, n - 1)
    hull = [F.min("x0").over(span).alias("hx0"), F.min("y0").over(span).alias("hy0"), F.max("x1").over(span).alias("hx1"), F.max("y1").over(span).alias("hy1")]
    out = rows.select("page", F.col("order_index").alias("start_index"), hit.alias("hit"), *hull).where("hit")
    return out.select("page", "start_index", *(F.col(f"h{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def _anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for page, text, start, end, words in zip(pdf["page"], pdf["source_text"], pdf["char_start"], pdf["char_end"], pdf["words"]):
            at, hits, status = 0, [], "anchored"
            for w in sorted(words, key=lambda w: w["order_index"]):
                place = text.find(w["text"], at)
                if place < 0 or text[at:place].strip():
                    status = "unaligned"
                    break
                at = place + len(w["text"])
                if place < end and at > start:
                    hits.append((w, place, at))
            if status == "anchored" and not hits:
                status = "no_words"
            first = last = None
            box = (None,) * 4
            if status == "anchored":
                first, last = hits[0][1], hits[-1][2]
                extra = text[first:start] + text[end:last]
                if any(ch.isalnum() for ch in extra):
                    status = "expands"
                box = (min(h[0]["x0"] for h in hits), min(h[0]["y0"] for h in hits), max(h[0]["x1"] for h in hits), max(h[0]["y1"] for h in hits))
            out.append((page, start, end, status, len(hits) if status == "anchored" else 0, *(box if status == "anchored" else (None,) * 4)))
        yield pd.DataFrame(out, columns=["page", "char_start", "char_end", "status", "words", "x0", "y0", "x1", "y1"])


def anchored_spans(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Boxes of text spans (page, source_text, char_start, char_end) found by aligning the page's words with its text.

    Words must follow each other with nothing but white space between; a span may grow by punctuation only.
    One page's words, which are few, meet in one row; status tells why a span has no box.
    """
    page = words.groupBy("page").agg(F.collect_list(F.struct("order_index", "text", "x0", "y0", "x1", "y1")).alias("words"))
    both = spans.select("page", "source_text", "char_start", "char_end").join(page, "page")
    kind = words.schema["page"].dataType.simpleString()
    return both.mapInPandas(_anchor, f"page {kind}, char_start int, char_end int, status string, words int, x0 double, y0 double, x1 double, y1 double")


def region_id(page: str = "page", method: str = "v1") -> Column:
    return stable_id("region", F.lit(method), page, "region")
