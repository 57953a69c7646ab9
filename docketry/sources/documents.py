"""Reading files into evidence units: plain text, HTML, CSV, workbooks, PDF and OCR behind interfaces."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose text is never shown, and those that end a line (fixed values).
HIDDEN = frozenset(("script", "style", "noscript", "template", "svg"))
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split()
)
#: First bytes of known media, in hexadecimal (fixed values).
MAGIC = (("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, byte_size): whole files; the same bytes are the same artifact."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"))


def sniffed(content: Column) -> Column:
    """Media type by the first bytes; null where they are none of the known."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(F.lit(False), "")
    for bytes_, media in MAGIC:
        out = out.when(head.startswith(bytes_), media)
    text = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), r"^\s+", ""))
    return out.when(text.startswith("<!doctype html") | text.startswith("<html"), "text/html")


def base_media(media: Column) -> Column:
    """The media type without parameters, lower case; empty is null."""
    m = F.lower(F.trim(F.split(media, ";")[0]))
    return F.when(m != "", m)


def reader_of(media: Column, path: Column) -> Column:
    """Which reader a file needs, by media type or else suffix: pdf, html, csv, workbook, text or none."""
    m, suffix = base_media(media), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when((m == "application/pdf") | (suffix == "pdf"), "pdf")
        .when(m.isin("text/html", "application/xhtml+xml") | suffix.isin("html", "htm", "xhtml"), "html")
        .when((m == "text/csv") | (suffix == "csv"), "csv")
        .when(m.contains("spreadsheetml") | suffix.isin("xlsx", "xlsm"), "workbook")
        .when(m.startswith("text/") | m.isin("application/json", "application/xml") | suffix.isin("txt", "md", "json", "xml"), "text")
    )


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in HIDDEN
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str) -> str:
    """The shown text of a page: a line per block, blanks collapsed, no blank lines."""
    p = _Visible()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str, str]] = []
        self.category, self.heading, self.href, self.text, self.in_heading = "", "", None, "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h1", "h2", "h3", "h4"):
            self.heading, self.in_heading = "", True
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), ""

    def handle_data(self, data: str) -> None:
        if self.in_heading:
            self.heading += data
        if self.href is not None:
            self.text += data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h1", "h2", "h3", "h4"):
            self.heading, self.in_heading = " ".join(self.heading.split()), False
            self.category = self.heading if tag in ("h1", "h2") else self.category
        if tag == "a" and self.href is not None:
            self.found.append((self.category, self.heading, self.href, " ".join(self.text.split())))
            self.href = None


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ordinal, category, heading, href, text): links of each page in order, with the heading above them and the last of the upper two levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h in zip(pdf["k"], pdf["h"]):
                p = _Links()
                p.feed(h or "")
                out += [(k, i, *x) for i, x in enumerate(p.found)]
            yield pd.DataFrame(out, columns=[key, "ordinal", "category", "heading", "href", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"{key} {kind}, ordinal int, category string, heading string, href string, text string")


def column_name(index: int) -> str:
    """Spreadsheet column of a 0-based index: A, B, ..., Z, AA."""
    name, index = "", index + 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def row_text(headers: list[str], values: list[str]) -> str:
    """A row as JSON with its fields by header; missing headers are column letters, repeated ones get their column."""
    columns: dict[str, str] = {}
    for i, v in enumerate(values):
        name = (headers[i].strip() if i < len(headers) else "") or column_name(i)
        columns[f"{name}__{column_name(i)}" if name in columns else name] = v
    return json.dumps({"columns": columns, "raw": values}, ensure_ascii=False, sort_keys=True)


def csv_units(content: bytes) -> list[tuple[str, str, str]]:
    """(unit_type, locator, text) of a CSV file: its header, then each row that isn't blank; blank rows count."""
    rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", errors="replace"))))
    if not rows:
        return []
    headers = rows[0]
    out = [("spreadsheet_range", f"sheet:CSV!A1:{column_name(max(len(headers), 1) - 1)}1", json.dumps({"header": headers}, ensure_ascii=False, sort_keys=True))]
    for n, row in enumerate(rows[1:], 2):
        if any(v.strip() for v in row):
            out.append(("spreadsheet_range", f"sheet:CSV!A{n}:{column_name(len(row) - 1)}{n}", row_text(headers, row)))
    return out


def text_units(content: bytes) -> list[tuple[str, str, str]]:
    return [("record", "record:1", content.decode("utf-8", errors="replace"))]


def html_units(content: bytes) -> list[tuple[str, str, str]]:
    return [("record", "record:1", visible_text(content.decode("utf-8", errors="replace")))]


def workbook_units(content: bytes) -> list[tuple[str, str, str]]:
    """Header and row units of every sheet, formulas as they are written; needs openpyxl where it runs."""
    import openpyxl

    out = []
    for sheet in openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=False).worksheets:
        headers: list[str] = []
        for n, cells in enumerate(sheet.iter_rows(values_only=True), 1):
            row = ["" if v is None else str(v) for v in cells]
            at = f"sheet:{sheet.title}!A{n}:{column_name(max(len(row), 1) - 1)}{n}"
            if n == 1:
                headers = row
                out.append(("spreadsheet_range", at, json.dumps({"header": row}, ensure_ascii=False, sort_keys=True)))
            elif any(v.strip() for v in row):
                out.append(("spreadsheet_range", at, row_text(headers, row)))
    return out


READERS: dict[str, Callable[[bytes], list[tuple[str, str, str]]]] = {"text": text_units, "html": html_units, "csv": csv_units, "workbook": workbook_units}


def evidence_units(files: DataFrame, readers: dict[str, Callable] | None = None) -> DataFrame:
    """(artifact_id, unit_type, locator, text, error) of files (artifact_id, reader, content).

    A file that can't be read keeps its row, with the error; further readers, as for PDF or by OCR, are
    passed in by name.
    """
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for artifact, reader, content in zip(pdf["artifact_id"], pdf["reader"], pdf["content"]):
                try:
                    units = known[reader](bytes(content)) if reader in known else []
                    out += [(artifact, *u, None) for u in units]
                    if reader not in known:
                        out.append((artifact, None, None, None, "no reader"))
                except Exception as e:  # one bad file must not end the run
                    out.append((artifact, None, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["artifact_id", "unit_type", "locator", "text", "error"])

    return files.select("artifact_id", "reader", "content").mapInPandas(run, "artifact_id string, unit_type string, locator string, text string, error string")


def escalate(units: DataFrame, preferred: DataFrame, backend: Callable[[str, int], str], threshold: float) -> DataFrame:
    """(evidence_id, text): new readings of pages whose preferred reading is poor, by a backend(artifact_id, page)."""
    poor = units.where("unit_type = 'page'").join(preferred.select("evidence_id", "quality_score"), "evidence_id", "left").where(F.coalesce("quality_score", F.lit(0.0)) < threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [backend(a, int(loc.rsplit(":", 1)[-1])) for a, loc in zip(pdf["artifact_id"], pdf["locator"])]
            yield pd.DataFrame({"evidence_id": pdf["evidence_id"], "text": texts})

    return poor.select("evidence_id", "artifact_id", "locator").mapInPandas(run, "evidence_id string, text string")
