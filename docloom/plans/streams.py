"""Topics and Structured Streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..session import TASK_ROWS, fresh_dir
from ..sources import files as S
from ..store import DocumentStore
from ..streaming import ingest as J, topics as T
from .aggregates import RUNS_SQL, run_log
from .registry import register, table


def messages(spark, sf):
    """Events as messages; errors carry an empty payload."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("default/event/"), "event_type", F.lit("/"), "user_id").alias("topic"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("payload"),
        F.when(F.col("value") < 50, F.col("ts")).cast("timestamp").alias("ts"),
        "event_id",
    )


@register(r"""
WITH m AS (SELECT 'default/event/' || event_type || '/' || user_id AS topic FROM events)
SELECT 'default/event/+/7' AS pattern, topic, count(*) AS n FROM m WHERE regexp_full_match(topic, 'default/event/[^/]*/7') GROUP BY topic
UNION ALL SELECT 'default/event/click/#', topic, count(*) FROM m WHERE regexp_full_match(topic, 'default/event/click(/.*)?') GROUP BY topic
""")
def topic_filter(spark, sf):
    out = None
    for pattern in ("default/event/+/7", "default/event/click/#"):
        found = messages(spark, sf).filter(T.topic_matches(F.col("topic"), pattern))
        one = found.groupBy(F.lit(pattern).alias("pattern"), "topic").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


RETAINED_SQL = """
WITH m AS (SELECT 'user/' || user_id AS topic, CASE WHEN event_type = 'error' THEN '' ELSE props END AS payload, event_id FROM events),
l AS (SELECT topic, arg_max(payload, event_id) AS payload FROM m GROUP BY topic)
SELECT topic, payload FROM l WHERE payload <> ''
"""


def user_messages(frame):
    return frame.withColumn("topic", F.concat(F.lit("user/"), F.element_at(F.split("topic", "/"), -1)))


@register(RETAINED_SQL)
def retained_latest(spark, sf):
    return T.retained(user_messages(messages(spark, sf)), F.col("event_id"))


@register(RETAINED_SQL)
def retained_by_stream(spark, sf):
    """The same answer from a file stream whose batches each keep their last value."""
    folder, state = fresh_dir(spark, "messages"), fresh_dir(spark, "retained")
    rows = user_messages(messages(spark, sf))
    rows.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    J.retained_stream(
        stream, state, fresh_dir(spark, "checkpoint"), "event_id", available_now=True
    ).awaitTermination()
    return J.read_retained(spark, state, "event_id")


@register("""
SELECT event_id, 'default/event/' || event_type || '/' || user_id AS topic,
  CASE WHEN value < 50 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '2024-06-01 12:00:00' END AS stamped
FROM events WHERE event_type <> 'error'
""")
def arrival_stamp(spark, sf):
    now = F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    return T.stamp_arrival(messages(spark, sf), now).select(
        "event_id",
        F.col("_topic").alias("topic"),
        F.date_format("`@timestamp`", "yyyy-MM-dd HH:mm:ss").alias("stamped"),
    )


@register("""
SELECT event_type || '/' || user_id AS topic, count(*) AS n FROM events GROUP BY ALL
""")
def event_prefix(spark, sf):
    short = T.without_prefix(F.col("topic"), "default/event")
    return messages(spark, sf).groupBy(short.alias("topic")).agg(F.count("*").alias("n"))


@register("""
WITH e AS (SELECT *, CASE WHEN value < 1 THEN 'missing' WHEN event_type = 'error' AND value > 90 THEN 'rule' ELSE 'stored' END AS state FROM events),
u AS (SELECT event_type, user_id, arg_max(value, event_id) AS value FROM e WHERE state = 'stored' GROUP BY ALL)
SELECT 'stored' AS outcome, event_type AS doc_type, count(*) AS n, round(sum(value), 4) AS total FROM u GROUP BY ALL
UNION ALL SELECT 'missing_fields', '', count(*), 0 FROM e WHERE state = 'missing'
UNION ALL SELECT 'jsonschema', 'error', count(*), 0 FROM e WHERE state = 'rule'
""")
def stream_ingest(spark, sf):
    """Events as NDJSON files through the ingest stream into the store, then counts."""
    inbox = fresh_dir(spark, "inbox")
    kind = F.when(F.col("value") >= 1, F.col("event_type")).otherwise("")
    docs = table(spark, sf, "events").select(
        kind.alias("doc_type"), F.col("user_id").cast("string").alias("id"), "value", "event_id"
    )
    # files arrive in event order, as a producer would write them, none longer than a task's rows
    docs.repartitionByRange(max(8, -(-docs.count() // TASK_ROWS)), "event_id").sortWithinPartitions("event_id").write.json(inbox)
    store = DocumentStore(spark, fresh_dir(spark, "stream-store"))
    schema = {"properties": {"value": {"type": "number", "maximum": 90}}, "required": ["value"]}

    def ordered(batch):
        return batch.withColumn("event_id", F.try_variant_get("body", "$.event_id", "bigint"))

    J.ingest_stream(
        J.document_lines(spark, inbox),
        store,
        fresh_dir(spark, "checkpoint"),
        chain=ordered,
        schemas={"error": schema},
        order="event_id",
        available_now=True,
    ).awaitTermination()
    value = F.try_variant_get("body", "$.value", "double")
    stored = store.current().groupBy("doc_type").agg(
        F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")
    )
    failed = store.errors().groupBy("error_type", F.coalesce("doc_type", F.lit("")).alias("doc_type")).agg(
        F.count("*").alias("n")
    )
    return stored.select(F.lit("stored").alias("outcome"), "doc_type", "n", "total").unionAll(
        failed.select("error_type", "doc_type", "n", F.lit(0.0))
    )


@register(
    RUNS_SQL + "SELECT analytic_name, CAST(count(*) FILTER (finished OR error) AS BIGINT) AS settled, count(*) AS n FROM r GROUP BY ALL"
)
def status_by_stream(spark, sf):
    """Latest run status from a stream of status rows."""
    folder, sink = fresh_dir(spark, "status"), fresh_dir(spark, "status-sink")
    rows = run_log(spark, sf)
    rows.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    J.status_stream(stream, F.col("event_id"), sink, fresh_dir(spark, "checkpoint")).awaitTermination()
    latest = R.latest_status(spark.read.parquet(sink), F.col("event_id"))
    done = F.coalesce("finished", F.lit(False)) | F.coalesce("error", F.lit(False))
    return latest.groupBy("analytic_name").agg(
        F.count_if(done).alias("settled"), F.count("*").alias("n")
    )


@register("""
SELECT 'Customer' AS doc_type, c_mktsegment AS segment, count(*) AS n, 1::BIGINT AS n_days FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment
""")
def stream_daily_log(spark, sf):
    """Documents that a stream has stored, as its log by day has them; rejected ones are not logged."""
    inbox, log = fresh_dir(spark, "inbox"), fresh_dir(spark, "log")
    docs = table(spark, sf, "customer").select(
        F.lit("Customer").alias("doc_type"), F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance")
    )
    docs.repartition(4).write.json(inbox)
    store = DocumentStore(spark, fresh_dir(spark, "stream-store"))
    J.ingest_stream(
        J.document_lines(spark, inbox), store, fresh_dir(spark, "checkpoint"), schemas={"Customer": {"properties": {"balance": {"type": "number", "minimum": 0}}}},
        daily_log=log, available_now=True,
    ).awaitTermination()
    logged = spark.read.parquet(f"{log}/batch=*")
    segment = F.try_variant_get(F.parse_json("body"), "$.segment", "string").alias("segment")
    # a run across midnight writes two days
    days = F.when(F.count_distinct("day") <= 2, F.lit(1)).cast("long").alias("n_days")
    return logged.groupBy("doc_type", segment).agg(F.count("*").alias("n"), days)
