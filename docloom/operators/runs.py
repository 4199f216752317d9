"""Run records of analytic jobs: bookkeeping and the queries over them.

Status rows are appended (``analytic_name, analytic_session_id, ts, finished, error, message``)
and the latest row of a run wins.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.predicates import must_not, term
from .rules import VariantValue, violations

RUN_KEY = ["analytic_name", "analytic_session_id"]


def latest_status(log: DataFrame, order: Column, fields: list[str] | None = None) -> DataFrame:
    """Latest status row per run; a partial aggregate, safe for runs that report very often."""
    fields = fields or [c for c in log.columns if c not in RUN_KEY]
    packed = F.struct(*fields)
    return (
        log.groupBy(*RUN_KEY).agg(F.max_by(packed, order).alias("s")).select(*RUN_KEY, "s.*")
    )


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("analytic_name").agg(F.count("*").alias("n_runs"))


def active(runs: DataFrame) -> DataFrame:
    """Runs neither finished nor failed; a missing flag counts as not set."""
    return runs.filter(must_not(term("finished", True), term("error", True))(runs))


def sessions(runs: DataFrame, state: str) -> DataFrame:
    """Distinct sessions that are ``active``, ``error`` or ``finished``."""
    if state == "active":
        chosen = active(runs)
    else:
        chosen = runs.filter(F.col({"error": "error", "finished": "finished"}[state]))
    return chosen.select(*RUN_KEY).distinct()


def without_runs(
    runs: DataFrame, analytic: str | None = None, session: str | None = None
) -> DataFrame:
    """Run table after deleting one run, all runs of one analytic, or everything."""
    doomed = F.lit(True)
    if analytic is not None:
        doomed = doomed & (F.col("analytic_name") == analytic)
    if session is not None:
        doomed = doomed & (F.col("analytic_session_id") == session)
    return runs.filter(~F.coalesce(doomed, F.lit(False)))


RUN_SCHEMA = (
    "analytic_name string, analytic_session_id string, ts timestamp, started boolean, "
    "finished boolean, error boolean, message string, parameters string, parent string, "
    "n_out long, seconds double"
)


def run_job(
    spark: SparkSession,
    log_path: str,
    name: str,
    session: str,
    job: Callable[[SparkSession, Mapping], DataFrame],
    parameters: Mapping,
    parameter_schema: Mapping | None = None,
    out_path: str | None = None,
    parent: str | None = None,
) -> DataFrame:
    """Run a job and append started, finished or error rows to the run log.

    The result is written once to ``out_path`` and counted while it is written
    (``DataFrame.observe``), so bookkeeping costs no extra pass.
    """
    import json

    text = json.dumps(parameters, sort_keys=True, default=str)
    begun = time.monotonic()

    def report(**state) -> None:
        row = {
            "analytic_name": name,
            "analytic_session_id": session,
            "ts": datetime.now(timezone.utc),
            "started": True,
            "finished": False,
            "error": False,
            "message": None,
            "parameters": text,
            "parent": parent,
            "n_out": None,
            "seconds": round(time.monotonic() - begun, 3),
            **state,
        }
        spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(log_path)

    report()
    try:
        if parameter_schema is not None:
            checked = spark.range(1).select(
                violations(parameter_schema, VariantValue(F.parse_json(F.lit(text)))).alias("v")
            )
            wrong = checked.first()["v"]
            if wrong:
                raise ValueError("; ".join(wrong))
        result = job(spark, parameters)
        n_out = None
        if out_path is not None:
            from pyspark.sql import Observation

            seen = Observation(f"run-{session}")
            result.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(out_path)
            n_out = seen.get["n"]
            result = spark.read.parquet(out_path)
    except Exception as ex:
        report(finished=True, error=True, message=str(ex))
        raise
    report(finished=True, n_out=n_out)
    return result
