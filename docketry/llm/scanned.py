"""Repairing the noise in text from scanned and laid-out pages.

Words are grouped by the skeleton that confusable glyphs share, and a frequent form that the neighbours support
stands for its group; lines are recognised as running heads with figures masked; what is left is joined across
lines and reflowed into paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import cut

#: Glyphs as the strokes they are mistaken for (fixed values): equal strokes, equal skeleton.
STROKES = {
    "m": "rn", "d": "cl", "u": "ll", "h": "ll", "w": "vv", "i": "l", "1": "l", "|": "l", "!": "l", "e": "c", "é": "c",
    "0": "o", "5": "s", "8": "b", "6": "b", "@": "a", "q": "g", "9": "g",
}
_STROKES = str.maketrans(STROKES)
_DIGITS = str.maketrans("OoIlSB", "001158")
#: Letters that stand for digits in a number (fixed values).
DIGIT_LETTERS = "OoIlSB"
#: Occurrences in the corpus from which a form of letters is known, whatever the corpus' size.
KNOWN = 3
#: A form with less than this share of its group's most frequent form is no known word but a misreading of it.
RARE = 0.15
#: Of the known words the most frequent so many are left out of joins: a table of bounded size.
FREQUENT = 20_000
#: A title with figures is a head where this share of its lines stand first or last in their text.
AT_EDGE = 0.9

_HYPHEN = "-¬­‐"
_BROKEN = re.compile(rf"(?<=[^\W\d_])[{_HYPHEN}][ \t]*\n\s*(?=\S)")
_NUMBER = rf"[\d{DIGIT_LETTERS}]{{1,5}}"
_OF = rf"(?:\s*(?:of|/)\s*{_NUMBER})?"
_ROMAN = r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_OWN = re.compile(rf"(?:[-–—\[(|]\s*)?(?:(?:page|pg\.?|p\.)\s*{_NUMBER}{_OF}|(?=[^\n]*\d){_NUMBER}{_OF}|(?=[ivxlc]){_ROMAN})(?:\s*[-–—\])|])?", re.IGNORECASE)
_PAGE_END = re.compile(rf"[\s|,·–—-]+(?:page|pg\.?|p\.)\s*{_NUMBER}{_OF}\s*$", re.IGNORECASE)
_PAGE_START = re.compile(rf"^(?:page|pg\.?|p\.)\s*{_NUMBER}{_OF}[\s|,·–—-]+", re.IGNORECASE)
_FIGURES = re.compile(rf"[\d{DIGIT_LETTERS}]*\d[\d{DIGIT_LETTERS}]*")
#: A longer word in small letters that no head has but for its marks.
_BODY = re.compile(r"(?<![^\W\d_])(?!(?:page|cont|continued)(?![^\W\d_]))[a-z][A-Za-z]{3,}(?![^\W\d_])")
_CONTINUED = re.compile(r"\s*\((?:cont\.?|cont'd|continued)\)\s*$", re.IGNORECASE)
_COPY = re.compile(r"^[^\W\d_][\w'’]* copy:\s*", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W\d_][\w@]*")
_GLYPHED = re.compile(rf"(?<![\w])\$?(?=[.,/\d{DIGIT_LETTERS}-]*\d)(?=[.,/\d-]*[{DIGIT_LETTERS}])[\d{DIGIT_LETTERS}]+(?:[.,/-][\d{DIGIT_LETTERS}]+)*(?:MM|M|K|k|BN|N)?(?![\w])")
_LETTERED = re.compile(r"(?<=\d-)[A-HK](?=[\dOIlSB]{2}(?!\w))(?=\d?[OIlSB])[\dOIlSB]{2}")


def skeleton(word: str) -> str:
    return word.lower().translate(_STROKES)


def page_number(line: str) -> bool:
    """A page number alone on its line."""
    return len(line) < 40 and _OWN.fullmatch(line) is not None


def head(line: str) -> tuple[str, bool, bool] | None:
    """(title with figures masked, page number within, marked) if the line has the looks of a running head."""
    if len(line) > 130 or _BODY.search(line) and " copy:" not in line:  # most lines end here
        return None
    bare = _PAGE_START.sub("", _PAGE_END.sub("", line)).strip()
    page = bare != line
    title = _COPY.sub("", _CONTINUED.sub("", bare)).strip()
    if not title or len(title) > 80 or title[-1] in ".,;:" + _HYPHEN:
        return None
    words = _LETTERS.findall(title)
    if len(words) < 2 or not any(len(w) >= 4 for w in words) or not all(w[0].isupper() or not w.isascii() for w in words if len(w) >= 4):
        return None
    return _FIGURES.sub("#", title), page, page or title != bare


def numbers_misread(text: str) -> bool:
    """A letter stands among the digits of a number."""
    for m in _GLYPHED.finditer(text):
        t = m[0]
        letters = re.sub(r"[^A-Za-z]|(?:MM|M|K|k|N)$", "", t)
        if letters == "B" and (re.search(r"-B\d\d$", t) or re.search("BN?$", t) and (t[0] == "$" or text[max(0, m.start() - 4) : m.start()].upper().strip() in ("USD", "US$", "$"))):
            continue
        return True
    return _LETTERED.search(text) is not None


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def _titles(lines: list[str]) -> list[tuple[str, bool] | None]:
    """For each line the (skeleton of its title, whether it is first or last) if only other texts can tell whether it is a head."""
    full = [k for k, x in enumerate(lines) if x]
    out: list[tuple[str, bool] | None] = [None] * len(lines)
    for k in full:
        if not page_number(lines[k]) and (h := head(lines[k])) and not h[2]:
            out[k] = (skeleton(h[0]), k in (full[0], full[-1]))
    return out


_READ = "key string, grp string, kinds array<string>, heads array<struct<title:string,edge:boolean>>, words array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each reading's lines show, and the words of its text without page numbers and marked heads, broken words joined."""
    heads_type = pa.list_(pa.struct([("title", pa.string()), ("edge", pa.bool_())]))
    for batch in batches:
        out: dict[str, list] = {"kinds": [], "heads": []}
        words, ends = [], [0]
        for text in batch.column("text").to_pylist():
            lines = [x for x in _lines(text) if x]
            kinds, body, titles = set(), [], []
            for k, line in enumerate(lines):
                if page_number(line):
                    kinds.add("page_no")
                    continue
                h = head(line)
                if h and h[1]:
                    kinds.add("page_no")
                if h and h[2]:
                    kinds.add("running_head")
                    continue
                if h:
                    titles.append({"title": skeleton(h[0]), "edge": k in (0, len(lines) - 1)})
                body.append(line)
            if any(line[-1] in _HYPHEN and len(line) > 1 and line[-2].isalpha() for line in lines[:-1]):
                kinds.add("broken_word")
            flow = _BROKEN.sub("", "\n".join(body))
            if numbers_misread(flow):
                kinds.add("misread")
            out["kinds"].append(sorted(kinds))
            out["heads"].append(titles)
            found = _WORD.findall(flow.lower())
            # the last word may be cut off
            words += found[:-1] if found and flow.rstrip()[-1:].isalnum() else found
            ends.append(len(words))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()))
        yield pa.record_batch({"key": batch.column("key"), "grp": batch.column("grp"), "kinds": pa.array(out["kinds"], pa.list_(pa.string())), "heads": pa.array(out["heads"], heads_type), "words": lists})


def _skeletons(word: Column) -> Column:
    """``skeleton`` of lower-case words in the JVM: glyphs of one stroke first, which make none of two."""
    one = {k: v for k, v in STROKES.items() if len(v) == 1}
    out = F.translate(word, "".join(one), "".join(one.values()))
    for k, v in STROKES.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def misreadings(read: DataFrame) -> DataFrame:
    """(id, word, right): the words of each text (id, words) that are misread, with the form they stand for.

    Forms are grouped by the skeleton that confusable glyphs share. A form of letters is known from ``KNOWN``
    occurrences and ``RARE`` of its group's most frequent form on; any other form of the group is a misreading.
    Where a group has several known forms, or the other form occurs ``KNOWN`` times itself and so may be a rare
    word, its neighbours decide: the known form that the corpus has most often beside the same neighbours is
    taken, and a form that may be a rare word is let be where no known form has ever stood beside them. Short
    words need a very frequent form. All forms are tables, joined and never collected; which of them are
    broadcast is left to the optimizer's size check.
    """
    counts = cut(read.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.length("word") > 1).withColumn("s", _skeletons(F.col("word"))))
    common = counts.where((F.col("n") >= KNOWN) & F.col("word").rlike(r"^\p{L}+$"))
    best = cut(common.groupBy("s").agg(F.max(F.struct("n", "word")).alias("best")))
    known = cut(common.join(best, "s").where(F.col("n") >= RARE * F.col("best.n")).select("s", "word", "n"))
    total = known.agg(F.sum("n")).first()[0] or 0
    rivals = known.groupBy("s").agg(F.count("*").alias("rivals"))
    enough = F.when(F.length("word") < 3, 0.001).when(F.length("word") < 4, 0.0002).otherwise(0.0) * float(total)
    another = F.col("word").rlike(r"^\p{L}+$") | F.substring("word", 2, 1 << 20).rlike(r"\p{L}")
    wrong = counts.join(known.select("word"), "word", "left_anti").join(best, "s").where((F.col("best.word") != F.col("word")) & another & (F.col("best.n") >= enough))
    fixes = cut(wrong.join(rivals, "s").select("word", "s", F.col("best.word").alias("right"), ((F.col("rivals") > 1) | (F.col("n") >= KNOWN)).alias("open"), (F.col("n") >= KNOWN).alias("rare")))

    # the most frequent words are known, so the bulk of all words meets no other table
    frequent = F.broadcast(cut(known.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")))
    around = F.transform("words", lambda x, i: F.struct(x.alias("word"), F.get("words", i - 1).alias("prev"), F.get("words", i + 1).alias("next")))
    placed = read.select("id", F.explode(around).alias("t")).select("id", "t.*").join(frequent, "word", "left_anti")
    hits = cut(placed.join(fixes, "word").select("id", "word", "prev", "next", "s", "right", "open", "rare"))
    plain = hits.where("not open").select("id", "word", "right").distinct()
    beside = hits.where("open").select("id", "word", "s", "rare", "prev", "next")
    forms = cut(beside.select("word", "s").distinct().join(known.withColumnRenamed("word", "right"), "s").select("word", "right", F.col("n").alias("often")))
    asked = cut(beside.drop("s").join(forms, "word"))
    pairs = [asked.select(F.concat_ws(" ", *c).alias("pair")).where(f"{side} is not null") for side, c in (("prev", ("prev", "right")), ("next", ("right", "next")))]
    wanted = cut(pairs[0].unionByName(pairs[1]).distinct())
    every = F.zip_with("words", F.slice("words", 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    seen = cut(read.select(F.explode(every).alias("pair")).join(wanted, "pair").groupBy("pair").agg(F.count("*").alias("n")))
    scored = asked.withColumn("left", F.concat_ws(" ", "prev", "right")).withColumn("after", F.concat_ws(" ", "right", "next"))
    scored = scored.join(seen.toDF("left", "n_prev"), "left", "left").join(seen.toDF("after", "n_next"), "after", "left")
    support = F.coalesce(F.when(F.col("prev").isNotNull(), F.col("n_prev")), F.lit(0)) + F.coalesce(F.when(F.col("next").isNotNull(), F.col("n_next")), F.lit(0))
    votes = scored.groupBy("id", "word", "right").agg(F.sum(support).alias("support"), F.max("often").alias("often"), F.bool_or("rare").alias("rare"))
    top = F.max(F.struct("support", "often", "right"))
    decided = votes.groupBy("id", "word").agg(top.alias("b"), F.bool_or("rare").alias("rare")).where("b.support > 0 or not rare").select("id", "word", F.col("b.right").alias("right"))
    return plain.unionByName(decided)


def _recurring(titles: DataFrame, by: str) -> DataFrame:
    """(title): of lines in the shape of a head (title, edge and ``by``) those that stand in two of ``by`` or more.

    Titles with masked figures must stand first or last in their texts, as headings of numbered items don't.
    """
    groups = titles.groupBy("title").agg(F.min(by).alias("a"), F.max(by).alias("b"), F.avg(F.col("edge").cast("double")).alias("at_edge"))
    return cut(groups.where(F.col("a") < F.col("b")).where(~F.col("title").contains("#") | (F.col("at_edge") >= AT_EDGE)).select("title"))


def _rows(readings: DataFrame, key: str, group: str | None, text: str) -> DataFrame:
    return readings.select(F.col(key).alias("key"), F.col(group or key).alias("grp"), F.col(text).alias("text")).where("key is not null and text is not null and text <> ''")


def noise(readings: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key, noise_kind): broken_word, misread, running_head, page_no - each kind of noise that a reading holds.

    A line in the shape of a head that carries no mark of one (a page number, ``continued``) must stand, figures
    masked, in readings of two groups or more. Null keys and null and empty texts have no rows; rows of one key are
    one reading; an empty input gives no row. Texts are read once; words are counted and looked up as tables.
    """
    read = cut(_rows(readings, key, group, text).mapInArrow(_read, _READ).withColumn("id", F.monotonically_increasing_id()))
    heads = read.select("key", "grp", F.explode("heads").alias("h")).select("key", "grp", "h.title", "h.edge")
    running = heads.join(_recurring(heads, "grp"), "title").select("key", F.lit("running_head").alias("noise_kind"))
    plain = read.select("key", F.explode("kinds").alias("noise_kind"))
    wrong = misreadings(read.select("id", "words")).select("id").distinct()
    misread = read.select("id", "key").join(wrong, "id").select("key", F.lit("misread").alias("noise_kind"))
    return plain.unionByName(running).unionByName(misread).distinct().withColumnRenamed("key", key)


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs with the misread words (map of lower-case form to right form) and numbers put right."""

    def number(m: re.Match) -> str:
        whole = m[0]
        return whole if not numbers_misread(m.string[max(0, m.start() - 4) : m.end()]) else whole.translate(_DIGITS)

    for batch in batches:
        texts = []
        for text, pairs in zip(batch.column("text").to_pylist(), batch.column("rights").to_pylist()):
            rights = dict(pairs or ())

            def word(m: re.Match) -> str:
                right = rights.get(m[0].lower())  # noqa: B023 - used at once
                if not right:
                    return m[0]
                return right.upper() if m[0].isupper() and len(m[0]) > 1 else right.capitalize() if m[0][0].isupper() else right

            text = _GLYPHED.sub(number, text)
            texts.append(_WORD.sub(word, text) if rights else text)
        yield pa.record_batch({"key": batch.column("key"), "paragraph": batch.column("paragraph"), "text": pa.array(texts, pa.string())})


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each reading that are neither page number nor marked head; with its title, if one may be a head."""
    for batch in batches:
        keys, places, lines, titles, edges = [], [], [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            own = _lines(text)
            for place, (line, title) in enumerate(zip(own, _titles(own))):
                if line and (page_number(line) or (h := head(line)) and h[2]):
                    continue
                titles.append(title and title[0])
                edges.append(title and title[1])
                keys.append(key)
                places.append(place)
                lines.append(line)
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "place": pa.array(places, pa.int32()), "line": pa.array(lines, pa.string()), "title": pa.array(titles, pa.string()), "edge": pa.array(edges, pa.bool_())})


def repaired(readings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every reading as continuous paragraphs, one per line.

    Page numbers and running heads go (lines in the shape of a head where they carry a mark of one or recur in
    another reading; see ``noise``), words broken over a line end are joined, misread words and digits
    take the form that the corpus supports, and lines are reflowed by SQL windows over each reading's lines:
    a blank line, or the end of a sentence before a line that starts a new item, ends a paragraph. Null keys and
    null and empty texts have no rows; rows of one key are one reading; an empty input gives no row.
    """
    rows = _rows(readings, key, None, text).groupBy("key").agg(F.max("grp").alias("grp"), F.max("text").alias("text"))
    read = cut(rows.mapInArrow(_read, _READ).select("key", "words").withColumn("id", F.monotonically_increasing_id()))
    wrong = misreadings(read.select("id", "words")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("rights"))
    rights = cut(read.select("id", "key").join(wrong, "id").select("key", "rights"))
    w = Window.partitionBy("key").orderBy("place")
    every = cut(rows.mapInArrow(_drop, "key string, place int, line string, title string, edge boolean"))
    doubtful = every.where("title is not null")
    lines = every.where("title is null").unionByName(doubtful.join(_recurring(doubtful, "key"), "title", "left_anti")).drop("title", "edge")
    full = lines.withColumn("blank", F.col("line") == "").withColumn("gap", F.lag("blank", 1, False).over(w)).where("not blank")
    before = F.lag("line").over(w)
    starts = F.col("gap") & before.rlike(r"[.!?:]$|\d$") | (before.rlike(r"[.!?]$|^\S+ (No\. )?\d") & F.col("line").rlike(r"^(?i)(ordinance|resolution|item|ord\.|res\.)\s"))
    ends = F.coalesce(F.length(before) < 40, F.lit(False)) & before.rlike(r"^(?i)(ordinance|resolution|item|ord\.|res\.)\s")
    numbered = full.withColumn("paragraph", F.sum((F.coalesce(starts, F.lit(False)) | ends).cast("int")).over(w))
    joined = numbered.groupBy("key", "paragraph").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    flowed = F.regexp_replace(F.regexp_replace(body, rf"(?<=\p{{L}})[{_HYPHEN}]\n", ""), "\n", " ")
    mended = joined.select("key", "paragraph", flowed.alias("text")).join(rights, "key", "left").mapInArrow(_mend, "key string, paragraph long, text string")
    out = mended.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("p"))
    return out.select(F.col("key").alias(key), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias(text))
