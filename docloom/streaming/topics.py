"""Messages with topics: wildcard filters, arrival stamps, retained values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def topic_regex(pattern: str) -> str:
    """Regex of a topic filter: ``+`` is one level, a final ``#`` any number of levels."""
    out = []
    levels = pattern.split("/")
    for i, level in enumerate(levels):
        if level == "#":
            if i != len(levels) - 1:
                raise ValueError("'#' is only allowed at the end of a topic filter")
            tail = "(/.*)?" if out else ".*"
            return "^" + "/".join(out) + tail + "$"
        out.append("[^/]*" if level == "+" else "\\Q" + level + "\\E")
    return "^" + "/".join(out) + "$"


def topic_matches(topic: Column, pattern: str) -> Column:
    return topic.rlike(topic_regex(pattern))


def without_prefix(topic: Column, prefix: str) -> Column:
    """Topic relative to a prefix such as ``default/events``."""
    lead = prefix.rstrip("/") + "/"
    return F.when(topic.startswith(lead), F.substring(topic, F.lit(len(lead) + 1), F.length(topic))).otherwise(
        topic
    )


def stamp_arrival(messages: DataFrame, now: Column) -> DataFrame:
    """Drop empty payloads, add ``_topic``, and ``@timestamp`` where it is missing.

    Works on batch and streaming frames with ``topic, payload`` and optionally ``ts``.
    """
    out = messages.filter(F.length("payload") > 0).withColumnRenamed("topic", "_topic")
    if "ts" in messages.columns:
        return out.withColumn("ts", F.coalesce("ts", now)).withColumnRenamed("ts", "@timestamp")
    return out.withColumn("@timestamp", now)


def retained(messages: DataFrame, order: Column) -> DataFrame:
    """Last payload per topic; an empty last payload removes the topic.

    One partial aggregate, so a topic with a third of all messages costs one row per task.
    """
    last = messages.groupBy("topic").agg(F.max_by(F.struct("payload"), order).alias("m"))
    return last.select("topic", "m.payload").filter(F.length("payload") > 0)
