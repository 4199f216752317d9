"""Round trips through file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_dir
from ..sources import artifacts as files, collections as D, files as S, trees
from .registry import register, table


@register("""
SELECT doc_id, sha256(text) AS digest, lang, source, n_chars FROM documents
""")
def ndjson_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    path = fresh_dir(spark, "ndjson")
    S.write_ndjson(docs, path, compression="gzip")
    back, _ = S.read_ndjson(spark, path, docs.schema)
    return back.select("doc_id", F.sha2("text", 256).alias("digest"), "lang", "source", "n_chars")


@register("""
SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE event_type END AS kind, count(*) AS n FROM events
WHERE event_type <> 'signup' GROUP BY ALL
""")
def ndjson_quarantine(spark, sf):
    path = fresh_dir(spark, "lines")
    line = (
        F.when(F.col("event_type") == "error", F.lit('{"doc_type": '))
        .when(F.col("event_type") == "signup", F.lit("  "))
        .otherwise(F.concat(F.lit('{"doc_type":"'), "event_type", F.lit('","id":"'), "event_id", F.lit('"}')))
    )
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    good, bad = S.read_documents(spark, path)
    both = good.select(F.col("doc_type").alias("kind")).unionAll(bad.select(F.lit("bad")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@register("""
SELECT c_custkey, nullif(c_name, '') AS name_alias, c_nationkey AS year_s, sha256(CAST(c_custkey AS VARCHAR)) AS id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'none' ELSE c_mktsegment END AS segment FROM customer
""")
def csv_headers(spark, sf):
    path = fresh_dir(spark, "csv")
    table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("URL"),
        F.col("c_name").alias("Name/Alias"),
        F.col("c_nationkey").cast("string").alias("Year (s"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("Ségment"),
    ).write.option("header", True).option("emptyValue", "").csv(path)
    rows = S.read_csv(spark, path, integers=["year_s"])
    return rows.select(
        F.col("url").cast("long").alias("c_custkey"),
        "name_alias",
        F.col("year_s").cast("int").alias("year_s"),
        "id",
        F.coalesce("ségment", F.lit("none")).alias("segment"),
    )


@register("""
SELECT lang AS doc_type, sha256(CAST(doc_id AS VARCHAR)) AS archive_name, sha256(text) AS digest FROM documents
""")
def archive_roundtrip(spark, sf):
    path = fresh_dir(spark, "archive")
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("doc_type"), F.col("doc_id").cast("string").alias("id"), "text"
    )
    S.write_archive(docs, path)
    back = S.read_archive(spark, path, docs.schema)
    return back.select("doc_type", "archive_name", F.sha2("text", 256).alias("digest"))


@register("""
SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE strftime(ts, '%Y%m%d') BETWEEN '20240105' AND '20240120' GROUP BY ALL
""")
def daily_log(spark, sf):
    path = fresh_dir(spark, "daily")
    docs = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    S.append_daily(docs.repartition("event_type"), path, F.col("ts"))
    back = S.read_daily(spark, path, "event_id bigint, value double", "20240105", "20240120")
    return back.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("""
WITH f AS (SELECT 'Event Type' AS doc_type, user_id AS id, 'raw' AS artifact_type,
  event_type || CASE event_type WHEN 'view' THEN '.txt?v=2' WHEN 'click' THEN '.json' ELSE '.bin' END AS filename,
  arg_max(event_id, event_id) AS file_size FROM events GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS id, filename,
  CASE WHEN filename LIKE 'view%' THEN 'text/plain' WHEN filename LIKE 'click%' THEN 'application/json' ELSE 'application/octet-stream' END AS content_type,
  'default/artifacts/Event%20Type/' || id || '/raw/' || url_encode(filename) AS remote_file_path, file_size
FROM f
""")
def artifact_registry(spark, sf):
    kind = F.col("event_type")
    suffix = F.when(kind == "view", ".txt?v=2").when(kind == "click", ".json").otherwise(".bin")
    stored = table(spark, sf, "events").select(
        F.lit("Event Type").alias("doc_type"),
        F.col("user_id").cast("string").alias("id"),
        F.lit("raw").alias("artifact_type"),
        F.concat(kind, suffix).alias("filename"),
        F.col("event_id").alias("file_size"),
        F.col("event_id").alias("seq"),
    )
    return files.registry(stored, "default").select(
        "id", "filename", "content_type", "remote_file_path", "file_size"
    )


@register("""
SELECT DISTINCT user_id, true AS found FROM events WHERE event_type = 'purchase'
""")
def artifact_lookup(spark, sf):
    stored = table(spark, sf, "events").select(
        F.lit("User").alias("doc_type"),
        F.col("user_id").alias("id"),
        F.lit("raw").alias("artifact_type"),
        F.col("event_type").alias("filename"),
        F.col("event_id").alias("file_size"),
        F.col("event_id").alias("seq"),
    )
    docs = stored.select("doc_type", "id").distinct()
    held = files.attach(docs, files.registry(stored, "default"))
    one = files.find(F.col("artifacts"), "raw", F.lit("purchase"))
    return held.select(F.col("id").alias("user_id"), one.isNotNull().alias("found")).filter("found")


@register("""
SELECT lower(event_type) AS type_key, strftime(ts, '%Y%m%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE (event_type LIKE 'c%' AND strftime(ts, '%Y%m%d') LIKE '2024010%')
   OR (event_type = 'view' AND strftime(ts, '%Y%m%d') BETWEEN '20240110' AND '20240114') GROUP BY ALL
""")
def day_collections(spark, sf):
    """Collections by type and day: a wildcard over both, and one type over a range of days."""
    path, schema = fresh_dir(spark, "collections"), "event_id bigint, value double"
    docs = table(spark, sf, "events").withColumn("doc_type", F.initcap("event_type"))
    D.write_collections(docs.select("doc_type", "event_id", "value", "ts"), path, F.col("ts"))
    wild = D.read_collections(spark, path, schema, doc_type="C*", day="2024010*")
    span = D.read_collections(spark, path, schema, doc_type="View", first="20240110", last="20240114")
    both = wild.unionByName(span)
    return both.groupBy("type_key", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def page_files(spark, sf):
    """One or two files of every page."""
    pages = table(spark, sf, "pages").select(F.lit("Web Page").alias("doc_type"), F.col("page_id").cast("string").alias("id"), "url", "html")
    names = F.when(F.col("id").cast("int") % 2 == 0, F.array(F.lit("page one.html"), F.lit("address.txt"))).otherwise(F.array(F.lit("page one.html")))
    stored = pages.select("doc_type", "id", F.lit("raw").alias("artifact_type"), F.explode(names).alias("filename"), "url", "html")
    text = F.when(F.col("filename") == "address.txt", F.col("url")).otherwise(F.col("html"))
    return pages, stored.select("doc_type", "id", "artifact_type", "filename", F.encode(text, "UTF-8").alias("content"))


@register("""
WITH f AS (SELECT page_id, unnest(['doc.json', 'page one.html', 'address.txt']) AS filename, html, url FROM pages)
SELECT page_id::VARCHAR AS id, filename, CASE filename WHEN 'doc.json' THEN sha256(url) WHEN 'page one.html' THEN sha256(html) ELSE sha256(url) END AS digest
FROM f WHERE filename <> 'address.txt' OR page_id % 2 = 0
""")
def archive_tree(spark, sf):
    """Documents with their files as a tree of folders, read back; each file's digest equals its manifest row."""
    root = fresh_dir(spark, "tree")
    pages, stored = page_files(spark, sf)
    manifest = trees.write_document_tree(pages.select("doc_type", "id", "url"), root, stored)
    tree = trees.read_document_tree(spark, root, manifest)
    docs = tree.select("id", F.lit("doc.json").alias("filename"), F.sha2(F.try_variant_get("body", "$.url", "string"), 256).alias("digest"))
    beside = trees.attach_files(tree, spark, root, content=True, listed=manifest).withColumn("sha256", F.sha2("content", 256))
    key = F.concat_ws("/", F.regexp_extract("folder", "([^/]+/[^/]+)$", 1), "artifact_type", "filename")
    proven = beside.withColumn("path", key).join(manifest, ["path", "sha256", "length"], "left_semi")
    return docs.unionByName(proven.select("id", "filename", F.col("sha256").alias("digest")))


@register("""
SELECT 'page-' || page_id || '.html' AS filename, strlen(html)::BIGINT AS file_size FROM pages WHERE page_id % 10 <> 1 AND page_id % 3 <> 0
""")
def artifact_folder(spark, sf):
    """Every plain file of a folder but those whose name matches a skip pattern."""
    root, number = fresh_dir(spark, "folder"), F.col("page_id").cast("string")
    suffix = F.when(F.col("page_id") % 3 == 0, ".tmp").otherwise(".html")
    trees.write_tree(table(spark, sf, "pages").select(F.concat(F.lit("page-"), number, suffix).alias("path"), F.encode("html", "UTF-8").alias("content")), root)
    found = files.scan_folder(spark, f"{root}/page-*", skip=[r".*\.tmp$", r"page-\d*1\."])
    return found.select("filename", "file_size")


@register("""
WITH b AS (SELECT doc_id, source, 'old ' || doc_id AS old, text FROM documents)
SELECT doc_id,
  CASE source WHEN 'src1' THEN 'a.txt=' || sha256(text) || ';b.txt=' || sha256(old) WHEN 'src2' THEN 'picture.png=none;notes.md=' || sha256(text)
    WHEN 'src3' THEN 'none' ELSE 'Body.TXT=' || sha256(CASE WHEN doc_id % 2 = 0 THEN old ELSE text END) END AS blobs,
  CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'none' WHEN doc_id % 2 = 0 THEN sha256(old) ELSE sha256(text) END AS content
FROM b
""")
def artifact_contents(spark, sf):
    """Texts of several files a document, some of them extracted before; one file fills the document's own field."""
    docs = table(spark, sf, "documents").select(F.lit("Doc").alias("doc_type"), F.col("doc_id").cast("string").alias("id"), "doc_id", "source", "text")
    source = F.col("source")
    names = (
        F.when(source == "src1", F.array(F.lit("a.txt"), F.lit("b.txt"))).when(source == "src2", F.array(F.lit("picture.png"), F.lit("notes.md")))
        .when(source != "src3", F.array(F.lit("Body.TXT")))
    )
    stored = docs.select("doc_type", "id", "doc_id", F.explode(names).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    before = (F.col("filename") == "b.txt") | ((F.col("filename") == "Body.TXT") & (F.col("doc_id") % 2 == 0))
    stored = stored.withColumn("text", F.when(before, F.concat(F.lit("old "), "doc_id")))
    out = files.with_contents(docs.select("doc_type", "id", "doc_id"), stored, "content", extensions=[".txt"], patterns=[r"notes\.\w+$"])
    shown = F.transform("blobs", lambda b: F.concat(b["filename"], F.lit("="), F.coalesce(F.sha2(b["content"], 256), F.lit("none"))))
    # names in the order of the table above
    shown = F.when(F.size("blobs") == 2, F.array_join(F.when(F.get("blobs", F.lit(0))["filename"] == "notes.md", F.reverse(shown)).otherwise(shown), ";")).otherwise(F.get(shown, F.lit(0)))
    return out.select("doc_id", F.coalesce(shown, F.lit("none")).alias("blobs"), F.coalesce(F.sha2("content", 256), F.lit("none")).alias("content"))
