"""Addresses as columns: joining, building, and the ordered checks that a link must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import slug
from docketry.sources.links import first_failure

ITEM, FILES, BYTES = "/Meetings/ViewMeetingAgendaItem", "Documents/DownloadFile/", "/DownloadFileBytes/"
#: Query keys of a supporting document (fixed values).
KEYS = ("documentType", "meetingId", "itemId", "publishId", "isSection", "isAttachment")


def part(uri: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(uri, F.lit(name)), F.lit(""))


def origin(uri: Column) -> Column:
    """Scheme, host and port of an address."""
    return F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def resolved(base: Column, href: Column) -> Column:
    """``href`` as it reads on the page ``base``: absolute, of another host, from the root, from the folder, or a query of its own."""
    h = F.trim(href)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/|$))", 1)
    rooted = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    plain = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h)).when(h.startswith("/"), F.concat(origin(base), h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(plain, r"\?.*$", ""), h)).when(h == "", plain).otherwise(F.concat(rooted, h))
    )


def query_values(uri: Column, key: str) -> Column:
    """Every value that a query gives a key, in order."""
    pairs = F.split(F.regexp_extract(uri, r"\?([^#]*)", 1), "&")
    return F.transform(F.filter(pairs, lambda p: p.startswith(f"{key}=")), lambda p: F.substring(p, len(key) + 2, 1 << 20))


def only_value(uri: Column, key: str) -> Column:
    """The value of a key given exactly once and not empty; null otherwise."""
    v = query_values(uri, key)
    return F.when((F.size(v) == 1) & (F.get(v, F.lit(0)) != ""), F.get(v, F.lit(0)))


def eligible(href: Column) -> Column:
    """Whether a link leads to a document at all."""
    h = F.lower(F.trim(href))
    return (h != "") & ~h.startswith("#") & ~h.startswith("javascript:") & ~h.startswith("mailto:") & ~h.startswith("tel:")


def document_reason(parent: Column, href: Column) -> Column:
    """The first of thirteen checks that a supporting document's link on its item's page fails; null if it is accepted."""
    uri = resolved(parent, href)
    path, base = part(uri, "PATH"), part(parent, "PATH")
    root = F.concat(F.regexp_replace(F.regexp_extract(base, rf"^(.*?){ITEM}", 1), "/+$", ""), F.lit("/"))
    keys = F.array_sort(F.array_distinct(F.transform(F.split(F.regexp_extract(uri, r"\?([^#]*)", 1), "&"), lambda p: F.split(p, "=")[0])))
    same = lambda k: only_value(uri, k) == only_value(parent, k)
    is_ = lambda k, v: F.lower(only_value(uri, k)) == v
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return first_failure([
        ("not http or https", no(uri.rlike("^https?://[^/?#]"))), ("leaves the parent's instance", origin(uri) != origin(parent)), ("has a fragment", uri.contains("#")),
        ("not under the download route", ~path.startswith(F.concat(root, F.lit(FILES)))), ("uses the byte route", path.contains(BYTES)), ("not a pdf path", ~F.lower(path).endswith(".pdf")),
        ("other query keys", keys != F.array(*map(F.lit, sorted(KEYS)))), ("documentType is not 1", no(only_value(uri, "documentType") == "1")), ("another meetingId", no(same("meetingId"))), ("another itemId", no(same("itemId"))),
        ("isSection is not false", no(is_("isSection", "false"))), ("isAttachment is not true", no(is_("isAttachment", "true"))), ("publishId is no positive number", no(only_value(uri, "publishId").rlike(r"^\d*[1-9]\d*$"))),
    ])


def instance_root(meetings: Column) -> Column:
    """The root of the instance whose meetings page is given; null for any other address."""
    bare = F.regexp_replace(F.regexp_replace(meetings, r"[?#].*$", ""), "/+$", "")
    return F.when(bare.rlike("(?i)/meetings$"), F.regexp_replace(bare, "(?i)meetings$", ""))


def tree_address(meetings: Column, meeting: Column) -> Column:
    return F.concat(instance_root(meetings), F.lit("Documents/ViewAgenda?meetingId="), meeting, F.lit("&type=agenda&doctype=1"))


def item_address(meetings: Column, meeting: Column, item: Column) -> Column:
    return F.concat(instance_root(meetings), F.lit("Meetings/ViewMeetingAgendaItem?meetingId="), meeting, F.lit("&itemId="), item, F.lit("&isSection=false&type=agenda"))


def instance_slug(meetings: Column) -> Column:
    root = instance_root(meetings)
    return slug(F.concat_ws("-", F.lower(part(root, "HOST")), F.regexp_replace(part(root, "PATH"), "^/+|/+$", "")), "instance")


def meeting_year(label: Column) -> Column:
    """The first year from 1900 to 2099 that a label names."""
    y = F.regexp_extract(label, r"((?:19|20)\d\d)", 1)
    return F.when(y != "", y.cast("int"))


def time_relation(text: Column, observed: Column) -> Column:
    """How a published time with its offset lies to the time of observation: unknown, unparseable, after or not."""
    at = F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(at.isNull(), "unparseable").when(at > observed, "after_observation").otherwise("at_or_before_observation")


def agenda_resources(links: DataFrame, categories: list[str], years: list[int], formats: list[str]) -> DataFrame:
    """(href, category, heading, format): links (category, heading, href, text) of wanted categories, years and formats, each address once."""
    h, t = F.col("href"), F.lower(F.trim("text"))
    kind = (
        F.when((t == "html") | (only_value(h, "html") == "true"), "html").when((t == "packet") | (only_value(h, "packet") == "true"), "packet").when((t == "pdf") & part(h, "PATH").contains("/AgendaCenter/ViewFile/"), "pdf")
        .when((t == "previous versions") & part(h, "PATH").contains("/AgendaCenter/PreviousVersions/"), "versions")
    )
    rows = links.where(F.lower("category").isin([c.lower() for c in categories]) & meeting_year(F.col("heading")).isin(years)).withColumn("format", kind).where(F.col("format").isin(formats))
    return rows.groupBy("href").agg(*(F.max(c).alias(c) for c in ("category", "heading", "format")))


def calendar_events(links: DataFrame, listing: str, text: str) -> DataFrame:
    """(uri, event_id): links (``listing`` address, href, text) that read exactly like an event, on the listing's host, with a numeric id."""
    uri = resolved(F.col(listing), F.col("href"))
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    eid = F.coalesce(F.get(query_values(uri, "EID"), F.lit(0)), F.get(query_values(uri, "eid"), F.lit(0)))
    rows = links.select(uri.alias("uri"), eid.alias("event_id"), (part(uri, "HOST") == part(F.col(listing), "HOST")).alias("own"), plain(F.col("text")).alias("t"))
    return rows.where(F.col("own") & (F.col("t") == " ".join(text.split()).lower()) & F.col("uri").rlike("^https?://") & F.col("event_id").rlike(r"^\d+$")).select("uri", "event_id").distinct()
