"""Scalar helpers applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from .registry import register, table


@register("SELECT page_id, url_encode(url) AS encoded FROM pages")
def percent_encoded(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.percent_encode(F.col("url")).alias("encoded")
    )


@register("""
SELECT doc_id, sha256(coalesce(source, '') || text) AS digest,
       sha256(CASE WHEN n_chars > 500 THEN 'True' ELSE 'False' END || lang) AS mixed
FROM documents
""")
def text_hashes(spark, sf):
    docs = table(spark, sf, "documents").withColumn("long", F.col("n_chars") > 500)
    return docs.select(
        "doc_id",
        X.text_hash(F.col("source"), F.col("text")).alias("digest"),
        X.field_hash(docs, ["long", "lang"]).alias("mixed"),
    )


@register("""
WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'TRUE' WHEN 'click' THEN 'f'
  WHEN 'purchase' THEN '1' WHEN 'error' THEN '0' ELSE 'maybe' END AS word FROM events)
SELECT event_id, CASE WHEN lower(word) IN ('true', 't', '1') THEN 'yes'
  WHEN lower(word) IN ('false', 'f', '0') THEN 'no' ELSE 'bad' END AS answer FROM e
""")
def bool_parse(spark, sf):
    kind = F.col("event_type")
    word = (
        F.when(kind == "view", "TRUE")
        .when(kind == "click", "f")
        .when(kind == "purchase", "1")
        .when(kind == "error", "0")
        .otherwise("maybe")
    )
    events = table(spark, sf, "events").withColumn("word", word)
    value = X.to_bool(F.col("word"))
    return events.select(
        "event_id",
        F.when(X.bad_bool(F.col("word")), "bad").when(value, "yes").otherwise("no").alias("answer"),
    )


@register("""
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
""")
def nested_columns(spark, sf):
    flat = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("doc.id"),
        F.col("c_name").alias("doc.person.name"),
        F.col("c_nationkey").alias("doc.person.home.nation"),
        F.col("c_acctbal").alias("doc.account.balance"),
        F.col("c_mktsegment").alias("other.segment"),
    )
    nested = X.nest_columns(flat, prefix="doc.", strip_prefix=True)
    return nested.select(
        "id",
        F.col("person.name").alias("name"),
        F.col("person.home.nation").alias("nation"),
        F.col("account.balance").alias("balance"),
    )


@register("""
SELECT o_orderkey, 'p2=' || o_orderstatus || ',p10=' || o_orderpriority || ',q1=' || o_custkey AS listed
FROM orders
""")
def natural_lists(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.array_join(
            X.natural_list(
                F.create_map(
                    F.lit("q1"), F.concat(F.lit("q1="), "o_custkey"),
                    F.lit("p10"), F.concat(F.lit("p10="), "o_orderpriority"),
                    F.lit("p2"), F.concat(F.lit("p2="), "o_orderstatus"),
                )
            ),
            ",",
        ).alias("listed"),
    )


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS ref_id, 'Part' AS ref_type, p_name AS label, p_name AS title FROM part
""")
def document_refs(spark, sf):
    ref = X.doc_ref(F.col("p_partkey").cast("string"), F.lit("Part"), F.col("p_name"))
    return table(spark, sf, "part").select(ref.alias("r")).select(
        F.col("r._id").alias("ref_id"),
        F.col("r.doc_type").alias("ref_type"),
        F.col("r.label").alias("label"),
        F.col("r.title").alias("title"),
    )


@register("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'application/x-tar'
  WHEN 'de' THEN 'image/png' ELSE 'none' END AS media_type FROM documents
""")
def media_types(spark, sf):
    suffix = (
        F.when(F.col("lang") == "en", ".txt?version=3.png")
        .when(F.col("lang") == "fr", ".tar.gz")
        .when(F.col("lang") == "de", ".PNG")
        .otherwise(".unknownext")
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        F.coalesce(X.content_type(F.concat("source", suffix)), F.lit("none")).alias("media_type"),
    )
