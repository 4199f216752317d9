"""Ingest, quarantine and merge over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import term
from ..functions.scalars import iso_text
from ..operators import ingest as I, merge as M
from ..session import fresh_dir, spread
from ..store import DocumentStore
from .registry import register, table

CLOCK = "2024-06-01 12:00:00"


def clock():
    """The job's time, one literal for all rows."""
    return F.to_timestamp(F.lit(CLOCK))


@register("""
SELECT doc_id, CASE WHEN lang = 'en' THEN sha256(source || text) WHEN lang = 'fr' THEN 'alt-' || doc_id
  ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents
""")
def assign_id(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        "text",
        F.when(~F.col("lang").isin("en", "fr"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("alt-"), "doc_id")).alias("_id"),
    )
    return I.clean_body(I.fill_id(docs, ["source", "text"])).select("doc_id", "id")


@register("""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'loader,profiler' WHEN event_type = 'click' THEN 'profiler'
    ELSE 'profiler' END AS names,
  CASE WHEN event_type = 'view' THEN 's0,s1' ELSE 's1' END AS sessions, 'update' AS op,
  '2024-06-01T12:00:00' AS updated,
  CASE WHEN event_type = 'error' THEN '2024-06-01T12:00:00'
    ELSE CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END END AS first_seen
FROM events
""")
def provenance(spark, sf):
    kind = F.col("event_type")
    docs = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "view", F.array(F.lit("loader")))
        .when(kind == "click", F.array(F.lit("profiler")))
        .alias("analytic_name"),
        F.when(kind == "view", F.array(F.lit("s0"))).alias("analytic_session_id"),
        F.when(kind != "error", F.col("ts")).cast("timestamp").alias("@timestamp"),
    )
    out = I.stamp(docs, "profiler", "s1", clock(), upsert=True)
    return out.select(
        "event_id",
        F.array_join("analytic_name", ",").alias("names"),
        F.array_join("analytic_session_id", ",").alias("sessions"),
        F.col("_op_type").alias("op"),
        iso_text(F.col("`@updated`")).alias("updated"),
        iso_text(F.col("`@timestamp`")).alias("first_seen"),
    )


@register("""
WITH e AS (
  SELECT CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'signup' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS id,
         CASE WHEN value >= 5 THEN event_type END AS doc_type FROM events),
m AS (SELECT coalesce(id, '') AS id, coalesce(doc_type, '') AS doc_type,
  concat_ws('; ', CASE WHEN coalesce(id, '') = '' THEN 'id missing' END,
                  CASE WHEN coalesce(doc_type, '') = '' THEN 'doc_type missing' END) AS message FROM e)
SELECT CASE WHEN message = '' THEN 'stored' ELSE 'missing_fields' END AS outcome, doc_type, message, count(*) AS n
FROM m GROUP BY ALL
""")
def quarantine_missing(spark, sf):
    kind = F.col("event_type")
    docs = table(spark, sf, "events").select(
        F.when(kind == "error", "")
        .when(kind != "signup", F.col("event_id").cast("string"))
        .alias("id"),
        F.when(F.col("value") >= 5, kind).alias("doc_type"),
    )
    good, bad = I.split_missing_identity(docs)
    both = good.select(
        F.lit("stored").alias("outcome"), "doc_type", F.lit("").alias("message")
    ).unionAll(bad.select("error_type", F.coalesce("doc_type", F.lit("")), "message"))
    return both.groupBy("outcome", "doc_type", "message").agg(F.count("*").alias("n"))


@register("""
WITH e AS (
  SELECT event_id, 'u' || (user_id % 10) AS doc_type, event_type,
    CASE event_type WHEN 'signup' THEN 'object' WHEN 'purchase' THEN 'text' WHEN 'error' THEN 'text'
      WHEN 'view' THEN 'boolean' ELSE 'number' END AS fam FROM events),
f AS (SELECT doc_type, arg_min(fam, event_id) AS first FROM e GROUP BY doc_type)
SELECT CAST(event_id AS VARCHAR) AS id,
  CASE WHEN fam = first OR (first = 'number' AND event_type = 'error')
         OR (first = 'text' AND fam IN ('number', 'boolean')) THEN 'stored' ELSE 'rejected: value' ||
         CASE WHEN fam = 'object' THEN '.x' ELSE '' END END AS outcome
FROM e JOIN f USING (doc_type)
""")
def mapping_conflict(spark, sf):
    text = """'{"value":' || CASE event_type
        WHEN 'signup' THEN '{"x":' || event_id || '}'
        WHEN 'purchase' THEN '"abc' || event_id || '"'
        WHEN 'error' THEN '"' || event_id || '"'
        WHEN 'view' THEN 'true' ELSE CAST(event_id AS STRING) END || '}'"""
    docs = spread(table(spark, sf, "events")).select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("u"), F.col("user_id") % 10).alias("doc_type"),
        F.parse_json(F.expr(text)).alias("body"),
    )
    good, bad = I.split_conflicts(docs)
    return good.select("id", F.lit("stored").alias("outcome")).unionAll(
        bad.select("id", F.concat(F.lit("rejected: "), "message"))
    )


@register("SELECT role AS doc_type, count(*) AS n_docs FROM conversations GROUP BY role")
def ingest_counts(spark, sf):
    return I.ingest_counts(
        table(spark, sf, "conversations").withColumnRenamed("role", "doc_type")
    )


@register("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_totalprice END AS price,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM orders
""")
def normalised_values(spark, sf):
    docs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", float("nan"))
        .otherwise(F.col("o_totalprice"))
        .alias("price"),
        F.col("o_orderdate").alias("day"),
    )
    return I.normalise(docs).fillna({"price": -1.0})


FOLD_SQL = """
WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'index' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
                  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT user_id, arg_max(op, event_id) AS last_op,
             coalesce(max(event_id) FILTER (op IN ('index', 'delete')), -1) AS reset FROM e GROUP BY user_id),
live AS (SELECT e.* FROM e JOIN r USING (user_id) WHERE r.last_op <> 'delete' AND e.event_id >= r.reset)
"""


@register(
    FOLD_SQL
    + """
SELECT user_id, coalesce(arg_max(value, event_id) FILTER (op <> 'delete' AND event_type <> 'view'), -1) AS value,
       coalesce(arg_max(k, event_id) FILTER (op <> 'delete' AND event_type <> 'click'), -1) AS k
FROM live GROUP BY user_id
"""
)
def upsert_fold(spark, sf):
    kind = F.col("event_type")
    log = table(spark, sf, "events").withColumn(
        "op", F.when(kind == "signup", "index").when(kind == "error", "delete").otherwise("update")
    )
    k = F.get_json_object("props", "$.k").cast("long")
    state = M.fold_columns(
        log,
        ["user_id"],
        F.col("event_id"),
        F.col("op"),
        {
            "value": (F.col("value"), kind.isin("signup", "click", "purchase")),
            "k": (k, kind.isin("signup", "view", "purchase")),
        },
    )
    return state.fillna({"value": -1.0, "k": -1})


@register(
    FOLD_SQL
    + """
SELECT user_id,
  coalesce(arg_max(value, event_id) FILTER (event_type = 'click'), -1) AS last_click,
  coalesce(arg_max(value, event_id) FILTER (event_type = 'view'), -1) AS last_view,
  coalesce(arg_max(value, event_id) FILTER (event_type = 'purchase'), -1) AS last_purchase,
  coalesce(arg_max(k, event_id) FILTER (op <> 'delete'), -1) AS k
FROM live GROUP BY user_id
"""
)
def document_fold(spark, sf):
    text = """'{"last":{"' || event_type || '":{"value":' || value || '}},"k":' ||
        get_json_object(props, '$.k') || ',"tags":["' || event_type || '"]}'"""
    kind = F.col("event_type")
    log = table(spark, sf, "events").select(
        F.lit("User").alias("doc_type"),
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "index")
        .when(kind == "error", "delete")
        .otherwise("update")
        .alias("op"),
        F.when(kind != "error", F.parse_json(F.expr(text))).alias("body"),
    )

    def number(path, kind="double"):
        none = F.lit(-1.0 if kind == "double" else -1)
        return F.coalesce(F.try_variant_get("body", path, kind), none)

    return M.fold_documents(log).select(
        F.col("id").alias("user_id"),
        number("$.last.click.value").alias("last_click"),
        number("$.last.view.value").alias("last_view"),
        number("$.last.purchase.value").alias("last_purchase"),
        number("$.k", "bigint").alias("k"),
    )


@register("""
SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN NULL ELSE d.source END, 'none') AS source,
       coalesce(l.quality, -1) AS quality, d.n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def partial_update(spark, sf):
    base = table(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("seq"), F.lit("index").alias("op"), "source",
        F.lit(None).cast("int").alias("quality"), "n_chars",
    )
    changes = table(spark, sf, "labels").select(
        "doc_id", F.lit(1).alias("seq"), F.lit("update").alias("op"),
        F.lit(None).cast("string").alias("source"), F.col("quality").cast("int"),
        F.lit(None).cast("long").alias("n_chars"),
    )
    is_base = F.col("seq") == 0
    state = M.fold_columns(
        base.unionAll(changes),
        ["doc_id"],
        F.col("seq"),
        F.col("op"),
        {
            # an explicit null of a low-quality label overwrites the source
            "source": (F.col("source"), is_base | (F.col("quality") == 0)),
            "quality": (F.col("quality"), ~is_base),
            "n_chars": (F.col("n_chars"), is_base),
        },
    )
    return state.fillna({"source": "none", "quality": -1})


@register("""
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def delete_by_query(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels")
    doomed = labels.filter(term("toxic", 1)(labels))
    return M.live_without(docs, doomed, ["doc_id"])


@register("""
WITH d AS (
  SELECT CASE WHEN d.lang = 'de' THEN 'DE' ELSE d.lang END AS doc_type, d.doc_id, d.source, d.n_chars,
         l.quality, coalesce(l.toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lower(doc_type) AS doc_type, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS good
FROM d WHERE doc_type <> 'es' AND toxic = 0 GROUP BY ALL
""")
def store_lifecycle(spark, sf):
    """Store, update, delete by query, drop a collection, compact, copy, count."""
    store = DocumentStore(spark, fresh_dir(spark, "store"))
    now = clock()
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    kind = F.when(F.col("lang") == "de", "DE").otherwise(F.col("lang"))
    bodies = docs.select(
        kind.alias("doc_type"),
        F.col("doc_id").cast("string").alias("id"),
        F.to_variant_object(F.struct("source", "n_chars")).alias("body"),
    )
    store.put(bodies, now, upsert=False)
    updates = labels.join(docs.select("doc_id", "lang"), "doc_id").select(
        kind.alias("doc_type"),
        F.col("doc_id").cast("string").alias("id"),
        F.to_variant_object(F.struct("quality", "toxic")).alias("body"),
    )
    store.put(updates, now)
    store.delete_by_query("*", {"toxic": "int"}, term("toxic", 1), now)
    store.drop("es")
    store.compact(now)
    copy = DocumentStore(spark, fresh_dir(spark, "copy"))
    store.copy_to(copy, "*", now)
    return (
        copy.current()
        .groupBy(F.lower("doc_type").alias("doc_type"))
        .agg(
            F.count("*").alias("n_docs"),
            F.sum(F.try_variant_get("body", "$.n_chars", "bigint")).alias("chars"),
            F.sum(F.coalesce(F.try_variant_get("body", "$.quality", "bigint"), F.lit(0))).alias("good"),
        )
    )
