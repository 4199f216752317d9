"""Structured Streaming jobs: ingest into the store, retained values, run status."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import latest_status
from ..store import DocumentStore
from .topics import retained


def document_lines(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of open documents from line-delimited JSON files.

    ``files_per_trigger`` is the back-pressure knob: a backlog is taken in bounded bites.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    parsed = F.try_parse_json("value")
    # a broken line has no type and so ends in the store's quarantine, with its text as body
    kept = F.coalesce(parsed, F.parse_json(F.to_json(F.struct(F.col("value").alias("unparsed")))))
    return (
        reader.load(path)
        .filter(F.length(F.trim("value")) > 0)
        .select("value", kept.alias("body"))
        .select(
            F.try_variant_get("body", "$.doc_type", "string").alias("doc_type"),
            # an id that is there but null stays null and fails the identity check
            F.when(F.try_variant_get("body", "$.id", "variant").isNotNull(), F.try_variant_get("body", "$.id", "string"))
            .when(F.try_variant_get("body", "$._id", "variant").isNotNull(), F.try_variant_get("body", "$._id", "string"))
            .otherwise(F.sha2("value", 256))
            .alias("id"),
            "body",
        )
    )


def ingest_stream(
    docs: DataFrame,
    store: DocumentStore,
    checkpoint: str,
    chain: Callable[[DataFrame], DataFrame] | None = None,
    schemas: Mapping[str, Mapping] | None = None,
    daily_log: str | None = None,
    session: str = "stream",
    order: str | None = None,
    available_now: bool = False,
    every: str = "2 seconds",
) -> StreamingQuery:
    """Processing chain, checks and store write per micro-batch.

    The store numbers the batches and remembers which micro-batch of which checkpoint each one came
    from, so a replayed micro-batch is skipped and other writers' batches are left alone. Lines that
    are no JSON are quarantined. Stored documents can be logged by day.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        number = store.batch_of(checkpoint, epoch)
        if number is None:
            number = store.put(
                batch, F.current_timestamp(), analytic="ingest", session=session, chain=chain,
                schemas=schemas, order=order, source=(checkpoint, epoch),
            )
        if daily_log is not None:
            stored = store.changes(after=number - 1).filter(
                (F.col("batch") == number) & (F.col("outcome") == "stored")
            )
            stored.select(
                "doc_type", "id", F.to_json("body").alias("body"),
                F.date_format("ts", "yyyyMMdd").alias("day"),
            ).write.mode("overwrite").parquet(f"{daily_log}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def retained_stream(
    messages: DataFrame, state: str, checkpoint: str, order: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the last payload per topic in a table that grows by one batch per trigger.

    ``messages`` has ``topic, payload`` and an order column. Each batch appends its own last
    value per topic; :func:`read_retained` folds the batches.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("topic").agg(
            F.max_by("payload", order).alias("payload"), F.max(order).alias(order)
        )
        last.write.mode("overwrite").parquet(f"{state}/batch={epoch}")

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "2 seconds"}
    return writer.trigger(**trigger).start()


def read_retained(spark: SparkSession, state: str, order: str) -> DataFrame:
    return retained(spark.read.parquet(state), F.col(order))


def status_stream(log: DataFrame, order: Column, sink: str, checkpoint: str) -> StreamingQuery:
    """Latest status per run, updated as rows arrive; stop it once the run is settled."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest_status(batch, order).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def settled(status: DataFrame) -> bool:
    """True once the observed run finished or failed: the stop condition of a subscriber."""
    done = F.coalesce("finished", F.lit(False)) | F.coalesce("error", F.lit(False))
    return not status.filter(done).isEmpty()
