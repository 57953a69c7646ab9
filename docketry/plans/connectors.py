"""Queries over pages, payloads, files and responses, each made here from the tables in a known form, so that SQL can say what must be read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import excerpt, slug
from docketry.plans.registry import query
from docketry.sources import addresses, discovery, documents, transport
from docketry.sources.tables import table

_N = "('0x' || substr(sha256(source_uri), 1, 4))::BIGINT"


def _uris(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with a number made from their hash, by which cases are varied."""
    return table(spark, d, "sources", "source_id", "source_uri").where("source_uri is not null").withColumn("n", F.conv(F.substring(F.sha2("source_uri", 256), 1, 4), 16, 10).cast("long"))


#: Changes to a good link, each of which one check finds (made-up cases).
_BREAK = [
    ("not http or https", "ftp://files.example/a.pdf"), ("leaves the parent's instance", "https://else.example/Documents/DownloadFile/a.pdf"), ("has a fragment", "{link}#page=2"), ("not under the download route", "{root}Other/a.pdf{q}"),
    ("uses the byte route", "{root}Documents/DownloadFile/DownloadFileBytes/a.pdf{q}"), ("not a pdf path", "{root}Documents/DownloadFile/a.doc{q}"), ("other query keys", "{link}&more=1"), ("documentType is not 1", "{dt2}"),
    ("another meetingId", "{other}"), ("another itemId", "{item}"), ("isSection is not false", "{section}"), ("isAttachment is not true", "{loose}"), ("publishId is no positive number", "{zero}"),
]


@query(
    f"""WITH p AS (SELECT source_uri || '&isSection=false&type=agenda' parent, {_N} % {len(_BREAK) + 1} n FROM sources WHERE contains(source_uri, '/Meetings/ViewMeetingAgendaItem?meetingId='))
    SELECT parent, CASE n {" ".join("WHEN " + str(i) + " THEN '" + r.replace("'", "''") + "'" for i, (r, _) in enumerate(_BREAK))} END reason FROM p"""
)
def attachment_checks(spark: SparkSession, d: str) -> DataFrame:
    """The first of thirteen checks that a supporting document's link fails."""
    rows = _uris(spark, d).where(F.col("source_uri").contains("/Meetings/ViewMeetingAgendaItem?meetingId=")).withColumn("parent", F.concat("source_uri", F.lit("&isSection=false&type=agenda")))
    m, i = (addresses.only_value(F.col("parent"), k) for k in ("meetingId", "itemId"))
    ask = lambda dt="1", mm=m, ii=i, sec="false", att="true", pub="77": F.concat(F.lit(f"?documentType={dt}&meetingId="), mm, F.lit("&itemId="), ii, F.lit(f"&publishId={pub}&isSection={sec}&isAttachment={att}"))
    root = F.regexp_extract("source_uri", r"^(.*?)Meetings/ViewMeetingAgendaItem", 1)
    good = F.concat(root, F.lit("Documents/DownloadFile/a.pdf"), ask())
    one = lambda c: F.concat(c, F.lit("1"))
    forms = {"{link}": good, "{root}": root, "{q}": ask(), "{dt2}": F.concat(root, F.lit("Documents/DownloadFile/a.pdf"), ask(dt="2"))}
    forms |= {k: F.concat(root, F.lit("Documents/DownloadFile/a.pdf"), q) for k, q in (("{other}", ask(mm=one(m))), ("{item}", ask(ii=one(i))), ("{section}", ask(sec="true")), ("{loose}", ask(att="no")), ("{zero}", ask(pub="0")))}

    def made(pattern: str):
        parts, rest = [], pattern
        while rest:
            at = rest.find("{")
            if at < 0:
                parts.append(F.lit(rest))
                break
            end = rest.index("}") + 1
            parts += [F.lit(rest[:at]), forms[rest[at:end]]]
            rest = rest[end:]
        return F.concat(*parts)

    kind = F.col("n") % (len(_BREAK) + 1)
    href = F.when(kind == len(_BREAK), good)
    for k, (_, pattern) in enumerate(_BREAK):
        href = href.when(kind == k, made(pattern))
    return rows.withColumn("href", href).where(addresses.eligible(F.col("href"))).select("parent", addresses.document_reason(F.col("parent"), F.col("href")).alias("reason"))


@query(
    r"""SELECT source_uri, regexp_extract(source_uri, '^(.*?)Meetings/', 1) || 'Documents/ViewAgenda?meetingId=' || regexp_extract(source_uri, 'meetingId=(\d+)', 1) || '&type=agenda&doctype=1' tree_uri,
    regexp_extract(source_uri, '^(.*?)Meetings/', 1) || 'Meetings/ViewMeetingAgendaItem?meetingId=' || regexp_extract(source_uri, 'meetingId=(\d+)', 1) || '&itemId=' || regexp_extract(source_uri, 'itemId=(\d+)', 1) || '&isSection=false&type=agenda' item_uri,
    trim(regexp_replace(regexp_extract(source_uri, '^https?://([^/]+)', 1), '[^a-z0-9]+', '-', 'g'), '-') slug FROM sources WHERE contains(source_uri, '/Meetings/ViewMeetingAgendaItem?meetingId=')"""
)
def agenda_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of a meeting's agenda and of its items, built from the meetings page."""
    u = F.col("source_uri")
    meetings = F.concat(F.regexp_extract(u, r"^(.*?)/Meetings/", 1), F.lit("/Meetings/"))
    m, i = (addresses.only_value(u, k) for k in ("meetingId", "itemId"))
    rows = _uris(spark, d).where(u.contains("/Meetings/ViewMeetingAgendaItem?meetingId="))
    return rows.select("source_uri", addresses.tree_address(meetings, m).alias("tree_uri"), addresses.item_address(meetings, m, i).alias("item_uri"), addresses.instance_slug(meetings).alias("slug"))


@query(
    f"""WITH s AS (SELECT *, {_N} n FROM sources WHERE contains(source_uri, '/AgendaCenter/ViewFile/'))
    SELECT source_uri AS href, 'Board ' || n % 3 category, 'Meeting of May ' || 2019 + n % 6 heading, CASE n % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'packet' ELSE 'pdf' END format FROM s WHERE n % 3 IN (0, 1) AND n % 6 IN (2, 3, 4) AND n % 4 < 3"""
)
def agenda_resources(spark: SparkSession, d: str) -> DataFrame:
    """Documents of wanted boards, years and formats found in listing pages; a page here holds one meeting."""
    n = F.col("n")
    text = F.when(n % 4 == 0, "HTML").when(n % 4 == 1, "Packet").when(n % 4 == 2, "PDF").otherwise("Video")
    page = F.concat(F.lit("<h2>Board "), (n % 3).cast("string"), F.lit("</h2><h3>Meeting of  May "), (n % 6 + 2019).cast("string"), F.lit('</h3><p><a href="'), "source_uri", F.lit('"> '), text, F.lit(" </a></p>"))
    rows = _uris(spark, d).where(F.col("source_uri").contains("/AgendaCenter/ViewFile/")).withColumn("page", page)
    return addresses.agenda_resources(documents.page_links(rows, "source_id", "page"), ["board 0", "BOARD 1"], [2021, 2022, 2023], ["html", "packet", "pdf"])


@query(f"SELECT regexp_extract(source_uri, '^(https?://[^/]+)', 1) || '/Calendar.aspx?EID=' || {_N} uri, ({_N})::VARCHAR event_id FROM sources WHERE {_N} % 4 = 0")
def calendar_events(spark: SparkSession, d: str) -> DataFrame:
    """Events whose link reads exactly as wanted, on the page's own host and with a numeric id."""
    n = F.col("n")
    href = F.when(n % 4 == 1, F.concat(F.lit("https://else.example/Calendar.aspx?EID="), n.cast("string"))).when(n % 4 == 2, F.lit("/Calendar.aspx?EID=soon")).otherwise(F.concat(F.lit("/Calendar.aspx?EID="), n.cast("string")))
    page = F.concat(F.lit('<a href="'), href, F.lit('">'), F.when(n % 4 == 3, "Other event").otherwise("City  Council"), F.lit("</a>"))
    links = documents.page_links(_uris(spark, d).withColumn("page", page), "source_uri", "page")
    return addresses.calendar_events(links, "source_uri", "city council")


@query(f"SELECT source_id, 'f' || {_N} file_id, 'Agenda' AS \"type\", 'File ' || {_N} \"name\", regexp_extract(source_uri, '^(https?://[^/]+)', 1) || '/GetFile(fileId=f' || {_N} || ')' url FROM sources WHERE {_N} % 3 = 0")
def published_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that a payload publishes on its own host under its own id."""
    n, host = F.col("n"), addresses.origin(F.col("source_uri"))
    url = F.when(F.col("n") % 3 == 1, F.concat(F.lit("https://else.example/GetFile(fileId=f"), n.cast("string"), F.lit(")"))).otherwise(F.concat(host, F.lit("/GetFile(fileId=f"), n.cast("string"), F.lit(")")))
    file = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("f"), n.cast("string")).alias("fileId"), F.when(n % 3 == 2, "Video").otherwise("Agenda").alias("type"), F.concat(F.lit("File "), n.cast("string")).alias("name"), url.alias("url"))).alias("publishedFiles")))
    return discovery.published_files(_uris(spark, d).withColumn("payload", file), "source_id", "payload", "source_uri", ["Agenda", "Minutes"])


_META = "'{\"id\":' || n % 50 || ',\"name\":\"a \\\\\"quoted\\\\\" { brace\",\"slot\":{\"of\":' || n % 50 % 7 || '}}'"


@query(f"WITH s AS (SELECT DISTINCT {_N} n FROM sources) SELECT DISTINCT n % 50 id, n % 50 % 7 slot FROM s")
def embedded_meetings(spark: SparkSession, d: str) -> DataFrame:
    """Meetings embedded as JSON in pages, each told the same way wherever it stands."""
    n = F.col("n") % 50
    text = F.concat(F.lit('<script>var meeting = {"id":'), n.cast("string"), F.lit(',"name":"a \\"quoted\\" { brace","slot":{"of":'), (n % 7).cast("string"), F.lit("}};</script>"))
    found = _uris(spark, d).select(F.explode(discovery.embedded(text, "var meeting =")).alias("j")).select(F.from_json("j", "id long, slot struct<of:long>").alias("m"))
    return discovery.agreed(found.select(F.col("m.id").alias("id"), F.col("m.slot.of").alias("slot")), "id", "slot")


@query(f"SELECT source_uri AS listing, '/AgendaCenter/ViewFile/' || {_N} current, '/AgendaCenter/ArchivedAgenda/' || {_N} archived FROM sources WHERE contains(source_uri, '/PreviousVersions/')")
def archived_versions(spark: SparkSession, d: str) -> DataFrame:
    """Archived versions beside the current one on the listing pages of previous versions."""
    n = F.col("n").cast("string")
    page = F.concat(F.lit('<h3>June</h3><a href="/AgendaCenter/ViewFile/'), n, F.lit('">PDF</a> <a href="/AgendaCenter/ArchivedAgenda/'), n, F.lit('">PDF</a><h3>July</h3><a href="/AgendaCenter/ViewFile/0">PDF</a>'))
    rows = _uris(spark, d).where(F.col("source_uri").contains("/PreviousVersions/")).select(F.col("source_uri").alias("listing"), page.alias("page"))
    return discovery.archived_versions(rows.select("listing"), documents.page_links(rows, "listing", "page"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t\\r\\f\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))) text_md5 FROM documents WHERE text IS NOT NULL""")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """The shown text of pages made of every document: a paragraph for each line, hidden elements around."""
    t = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    page = F.concat(F.lit("<html><style>p { x }</style><script>var a = '<p>';</script><p>"), t, F.lit("</p></html>"))
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("string").alias("artifact_id"), F.lit("html").alias("reader"), F.encode(page, "UTF-8").alias("content"))
    return documents.evidence_units(rows).select(F.col("artifact_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


_CSV = "WITH s AS (SELECT source_uri u, source_name, {n} n FROM sources)".replace("{n}", _N)


@query(
    f"""{_CSV} SELECT u AS source_uri, 'sheet:CSV!A1:C1' locator, '' "value" FROM s UNION ALL SELECT u, 'sheet:CSV!A2:C2', n::VARCHAR FROM s UNION ALL SELECT u, 'sheet:CSV!A4:D4', (n + 1)::VARCHAR FROM s"""
)
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of CSV files, blank ones counted and left out, fields by header; a field without a header goes by its column."""
    n = F.col("n")
    text = F.concat(F.lit("﻿id,name,id\r\n"), n.cast("string"), F.lit(',"a, b",x\r\n,,\r\n'), (n + 1).cast("string"), F.lit(',"line\nbreak",y,more\r\n'))
    rows = _uris(spark, d).select(F.col("source_uri").alias("artifact_id"), F.lit("csv").alias("reader"), F.encode(text, "UTF-8").alias("content"))
    columns = F.from_json("text", "columns map<string,string>")["columns"]
    return documents.evidence_units(rows).select(F.col("artifact_id").alias("source_uri"), "locator", F.coalesce(columns["id"], F.lit("")).alias("value"))


@query(
    """WITH a AS (SELECT artifact_id, nullif(lower(trim(split_part(media_type, ';', 1))), '') m FROM artifacts)
    SELECT artifact_id, m AS media, CASE WHEN m = 'application/pdf' THEN 'pdf' WHEN m IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN m = 'text/csv' THEN 'csv' WHEN contains(m, 'spreadsheetml') THEN 'workbook'
    WHEN starts_with(m, 'text/') OR m IN ('application/json', 'application/xml') THEN 'text' END reader FROM a"""
)
def media_readers(spark: SparkSession, d: str) -> DataFrame:
    """Which reader each artifact needs."""
    rows = table(spark, d, "artifacts", "artifact_id", "media_type", "stored_path")
    return rows.select("artifact_id", documents.base_media(F.col("media_type")).alias("media"), documents.reader_of(F.col("media_type"), F.col("stored_path")).alias("reader"))


@query("""WITH a AS (SELECT artifact_id, lower(trim(split_part(media_type, ';', 1))) m FROM artifacts) SELECT artifact_id, CASE WHEN m IN ('application/pdf', 'text/html') THEN m WHEN m = 'text/csv' THEN 'application/zip' END sniffed FROM a""")
def sniffed_media(spark: SparkSession, d: str) -> DataFrame:
    """Media types by first bytes, of contents made to begin as their type does (a csv here comes zipped)."""
    m = documents.base_media(F.col("media_type"))
    head = F.when(m == "application/pdf", "%PDF-1.7 x").when(m == "text/html", "\n <!DOCTYPE HTML><p>").when(m == "text/csv", "PK\u0003\u0004 x").otherwise("plain")
    return table(spark, d, "artifacts", "artifact_id", "media_type").select("artifact_id", documents.sniffed(F.encode(head, "UTF-8")).alias("sniffed"))


@query(
    """WITH f AS (SELECT DISTINCT 'file:///' || doc_id % 400 uri, text FROM documents WHERE text IS NOT NULL), h AS (SELECT DISTINCT 'source:' || sha256(uri) source_id, sha256(text) sha, octet_length(encode(text)) byte_size FROM f),
    k AS (SELECT DISTINCT sha256(text) sha FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0)
    SELECT source_id, 'artifact:' || sha artifact_id, 'snapshot:' || sha256(source_id || chr(31) || 'artifact:' || sha) snapshot_id, byte_size, 'sha256/' || substr(sha, 1, 2) || '/' || sha stored_path, sha NOT IN (SELECT sha FROM k) new_artifact, true new_snapshot FROM h"""
)
def ingested_files(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts and snapshots of files, and which of them are new, a third of the contents being known."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    files = docs.select(F.concat(F.lit("file:///"), (F.col("doc_id") % 400).cast("string")).alias("source_uri"), F.encode("text", "UTF-8").alias("content"))
    known = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("artifact:"), F.sha2("text", 256)).alias("artifact_id"))
    return transport.ingested(files, known, spark.createDataFrame([], "snapshot_id string")).drop("sha256")


_TRY = """t AS (SELECT user_id || '-' || ts::DATE visit, user_id::VARCHAR source, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) n, event_id,
  CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 503 WHEN 2 THEN 429 ELSE 404 END ELSE 200 END status, CASE WHEN event_id % 11 = 0 THEN 'text/html; charset=x' ELSE 'APPLICATION/PDF' END ct, CASE WHEN event_id % 7 = 0 THEN '3C68' ELSE '255044462D31' END head FROM events)"""


@query(
    f"""WITH {_TRY}, r AS (SELECT *, CASE WHEN status IS NULL THEN 'no answer' WHEN status <> 200 THEN 'HTTP ' || status WHEN event_id % 11 = 0 THEN 'expected media type application/pdf, received text/html' WHEN event_id % 7 = 0 THEN 'missing PDF magic bytes' END error FROM t WHERE n <= 3),
    e AS (SELECT *, min(CASE WHEN error IS NULL OR NOT (status IS NULL OR status = 429 OR status BETWEEN 500 AND 599) THEN n END) OVER (PARTITION BY visit) fin, max(n) OVER (PARTITION BY visit) most FROM r)
    SELECT visit, source, n AS attempts, status, error, CASE WHEN error IS NULL THEN event_id END artifact FROM e WHERE n = coalesce(fin, most)"""
)
def visit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How visits end, with retries where another try is worth it; events of a user's day are the tries."""
    e = F.col("event_id")
    status = F.when(F.col("event_type") != "error", 200).when(e % 4 == 0, None).when(e % 4 == 1, 503).when(e % 4 == 2, 429).otherwise(404)
    rows = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").select(
        F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("visit"), F.col("user_id").cast("string").alias("source"), e.alias("attempt"), status.alias("status"),
        F.when(e % 11 == 0, "text/html; charset=x").otherwise("APPLICATION/PDF").alias("content_type"), F.lit("application/pdf").alias("expected"), F.when(e % 7 == 0, "3C68").otherwise("255044462D31").alias("head"), e.alias("artifact"),
    )
    return transport.visits(rows).withColumn("attempts", F.col("attempts").cast("long"))


@query(
    f"""SELECT source_uri, CASE WHEN {_N} % 5 = 0 THEN 'https://blobs.example/stream/ELM/' || {_N} END uri,
    CASE {_N} % 5 WHEN 1 THEN 'another tenant''s path' WHEN 2 THEN 'host not allowed' WHEN 3 THEN 'no blobUri' WHEN 4 THEN 'not one tenant''s envelope' END reason FROM sources"""
)
def blob_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The files that envelopes point to, or why one is not followed."""
    n = F.col("n")
    at = F.when(n % 5 == 4, "https://a.elm.api.example/files/1").otherwise("https://elm.api.example/files/1")
    blob = F.concat(F.when(n % 5 == 1, "https://blobs.example/stream/OAK/").when(n % 5 == 2, "https://else.example/stream/ELM/").otherwise("https://blobs.example/stream/ELM/"), n.cast("string"))
    payload = F.when(n % 5 == 3, "{}").otherwise(F.to_json(F.struct(blob.alias("blobUri"))))
    found = transport.blob_address(at, payload, ".api.example", "blobs.example")
    return _uris(spark, d).withColumn("f", found).select("source_uri", "f.uri", "f.reason")


@query("SELECT DISTINCT source_name, CASE WHEN regexp_matches(source_name, '(19|20)\\d\\d') THEN regexp_extract(source_name, '((?:19|20)\\d\\d)', 1)::INTEGER END \"year\" FROM sources")
def meeting_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "source_name").distinct().select("source_name", addresses.meeting_year(F.col("source_name")).alias("year"))


@query(
    """WITH p AS (SELECT doc_id, published_at, CASE doc_id % 4 WHEN 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 1 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'soon' ELSE '' END t FROM documents)
    SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN 'unknown' WHEN doc_id % 4 <> 0 THEN 'unparseable' WHEN published_at >= TIMESTAMP '2024-06-01 00:00:01' THEN 'after_observation' ELSE 'at_or_before_observation' END relation FROM p"""
)
def time_relations(spark: SparkSession, d: str) -> DataFrame:
    """How published times, with and without offset, lie to a moment of observation."""
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("doc_id") % 4
    text = F.when(n == 0, F.concat(stamp, F.lit("+00:00"))).when(n == 1, stamp).when(n == 2, "soon").otherwise("")
    return table(spark, d, "documents", "doc_id", "published_at").select("doc_id", addresses.time_relation(text, F.to_timestamp(F.lit("2024-06-01T00:00:00Z"))).alias("relation"))


@query("""SELECT DISTINCT source_name, coalesce(nullif(trim(regexp_replace(lower(source_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') slug FROM sources WHERE source_name IS NOT NULL""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "source_name").where("source_name is not null").distinct().select("source_name", slug("source_name").alias("slug"))


@query(
    """WITH t AS (SELECT DISTINCT segment_id, trim(regexp_replace(raw_text, '[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g')) f FROM evidence_segments WHERE raw_text IS NOT NULL)
    SELECT segment_id, CASE WHEN length(f) > 120 THEN substr(f, 1, 119) || '…' ELSE f END excerpt FROM t"""
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of every segment on one line."""
    return table(spark, d, "evidence_segments", "segment_id", "raw_text").where("raw_text is not null").distinct().select("segment_id", excerpt("raw_text", 120).alias("excerpt"))


@query(
    """WITH s AS (SELECT source_uri u, regexp_extract(source_uri, '^(https?://[^/]+)', 1) o FROM sources), b AS (SELECT *, regexp_extract(u, '^([^?#]*/)', 1) f FROM s)
    SELECT u AS source_uri, o || '/root/a.pdf' rooted, f || 'next?x=1' beside, 'https://else.example/z' absolute, regexp_extract(u, '^(https?:)', 1) || '//cdn.example/y' other_host FROM b"""
)
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """How links of several forms read on each page."""
    u = F.col("source_uri")
    forms = {"rooted": "/root/a.pdf", "beside": "next?x=1", "absolute": "https://else.example/z", "other_host": "//cdn.example/y"}
    return _uris(spark, d).select(u, *(addresses.resolved(u, F.lit(h)).alias(k) for k, h in forms.items()))


@query("""SELECT source_id, '{"source_uri":"' || source_uri || '","native":"n-' || substr(source_id, 8, 6) || '"}' entry FROM sources""")
def manifest_entries(spark: SparkSession, d: str) -> DataFrame:
    """Sources as lines of a manifest in JSON."""
    return table(spark, d, "sources", "source_id", "source_uri").select("source_id", F.to_json(F.struct("source_uri", F.concat(F.lit("n-"), F.substring("source_id", 8, 6)).alias("native"))).alias("entry"))


@query("""WITH f AS (SELECT build_id, 'facts' kind, count(*) n_rows, count(DISTINCT evidence_id) units FROM evidence_facts GROUP BY 1 UNION ALL SELECT build_id, 'segments', count(*), count(DISTINCT evidence_id) FROM evidence_segments GROUP BY 1)
    SELECT *, build_id = max(build_id) OVER (PARTITION BY kind) current FROM f""")
def index_builds(spark: SparkSession, d: str) -> DataFrame:
    """The builds of the indexes with their sizes; the greatest identifier of a kind is current."""
    parts = [table(spark, d, name, "build_id", "evidence_id").groupBy("build_id").agg(F.count("*").alias("n_rows"), F.count_distinct("evidence_id").alias("units")).select("build_id", F.lit(kind).alias("kind"), "n_rows", "units") for kind, name in (("facts", "evidence_facts"), ("segments", "evidence_segments"))]
    every = parts[0].unionByName(parts[1])
    return every.join(every.groupBy("kind").agg(F.max("build_id").alias("last")), "kind").select("build_id", "kind", "n_rows", "units", (F.col("build_id") == F.col("last")).alias("current"))
