"""Finding resources in listing pages and payloads that were fetched before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a payload says about its published files (a fixed format).
FILES = "publishedFiles array<struct<fileId:string,type:string,name:string,url:string>>"


def embedded_objects(text: str | None, marker: str) -> list[str]:
    """The JSON objects that follow each marker: from a brace to its partner, braces within strings aside."""
    out, at = [], 0
    while text and (at := text.find(marker, at)) >= 0:
        start = text.find("{", at + len(marker))
        if start < 0:
            break
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            ch = text[i]
            if quoted:
                quoted = escaped or ch != '"'
                escaped = ch == "\\" and not escaped
            elif ch == '"':
                quoted, escaped = True, False
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    out.append(text[start : i + 1])
                    break
        at = start + 1 if depth else start + len(out[-1])
    return out


def embedded(html: Column, marker: str) -> Column:
    """Array of the JSON objects after each marker in a page; empty for null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scan(s: pd.Series) -> pd.Series:
        return pd.Series([embedded_objects(t, marker) for t in s])

    return scan(html)


def published_files(pages: DataFrame, key: str, payload: str, uri: str, types: list[str]) -> DataFrame:
    """(key, file_id, type, name, url): files of wanted types that a payload publishes on the host it came from.

    An address must be of the payload's own host, name its file's id in the path and have neither query nor
    fragment; a payload that isn't JSON publishes none.
    """
    one = pages.select(F.col(key).alias("key"), F.col(uri).alias("uri"), F.explode(F.from_json(payload, FILES)["publishedFiles"]).alias("f"))
    url = F.col("f.url")
    part = lambda c, p: F.try_parse_url(c, F.lit(p))
    fit = F.col("f.type").isin(*types) & (part(url, "HOST") == part(F.col("uri"), "HOST")) & part(url, "QUERY").isNull() & part(url, "REF").isNull() & F.contains(part(url, "PATH"), F.concat(F.lit("fileId="), F.col("f.fileId")))
    return one.where(fit).select(F.col("key").alias(key), F.col("f.fileId").alias("file_id"), "f.type", "f.name", "f.url")


def agreed(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row per key; raises where two rows of a key differ in the fields."""
    each = rows.groupBy(key).agg(F.count_distinct(F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields))).alias("_n"), *(F.max(f).alias(f) for f in fields))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("differing rows of "), F.col(key).cast("string")))).otherwise(F.col(key))
    return each.select(checked.alias(key), *fields)


def archived_versions(listings: DataFrame, links: DataFrame) -> DataFrame:
    """(listing, current, archived): archived links of a listing page beside the current one of the same heading.

    ``links`` has listing, heading, href as ``documents.page_links`` gives them; ``listings`` has listing.
    """
    own = links.join(listings.select("listing").distinct(), "listing", "left_semi")
    old = own.where(F.ilike("href", F.lit("%/ArchivedAgenda/%"))).select("listing", "heading", F.col("href").alias("archived"))
    new = own.where(F.ilike("href", F.lit("%/ViewFile/%"))).select("listing", "heading", F.col("href").alias("current"))
    return new.join(old, ["listing", "heading"]).select("listing", "current", "archived")
