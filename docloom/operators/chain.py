"""Per-type processing chains.

A step computes new columns from a row. The chain of every document type is folded into one
projection (``when doc_type = t``), so the whole chain over all types is a single pass without
a shuffle or a union; a Python step is a stop for Arrow batches in that pass. A failing step is
recorded in the audit array and the document goes on.
"""

from __future__ import annotations

import sys
import time
import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import lenient_timestamp

# the batch runner travels with its step, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AUDIT_TYPE = (
    "array<struct<step_name:string,parameters:string,skipped:boolean,error:boolean,message:string,"
    "start_time:timestamp,finish_time:timestamp,compute_duration_seconds:double>>"
)


@dataclass
class Outcome:
    """What a step wants to happen to a row."""

    columns: dict[str, Column] = field(default_factory=dict)
    error: Column | None = None
    message: Column | None = None
    skipped: Column | None = None
    keep: Column | None = None


Process = Callable[[DataFrame, Mapping[str, Column | object]], Outcome]


@dataclass
class Step:
    name: str
    process: Process
    parameters: Mapping[str, object] = field(default_factory=dict)


@dataclass
class PythonStep:
    """A Python function over batches of documents.

    ``fn(frame, parameters)`` gets a pandas DataFrame of the ``inputs`` columns and returns one with the
    ``outputs`` columns (name to type), rows told by the frame's index: rows left out are dropped, None drops all.
    With ``init``, ``fn(frame, parameters, init(parameters))``; ``init`` runs once per task. A row's
    result must not depend on the other rows, since a failing batch is run again in parts.
    """

    name: str
    fn: Callable
    inputs: Sequence[str]
    outputs: Mapping[str, str]
    parameters: Mapping[str, object] = field(default_factory=dict)
    init: Callable | None = None


def override(df: DataFrame, step: str, name: str, default: object) -> Column:
    """Parameter value: per document if given there, else from the configuration.

    A document carries overrides in a ``parameters`` VARIANT, nested ``{Step: {name: v}}`` or
    flat ``{"Step.name": v}``.
    """
    fallback = F.lit(default)
    if "parameters" not in df.columns:
        return fallback
    kind = {str: "string", bool: "boolean", int: "bigint", float: "double"}[type(default)]
    nested = F.try_variant_get("parameters", f"$['{step}']['{name}']", kind)
    flat = F.try_variant_get("parameters", f"$['{step}.{name}']", kind)
    return F.coalesce(nested, flat, fallback)


def run_chain(
    df: DataFrame, chains: Mapping[str, Sequence[Step | PythonStep]], audit: str = "_pipeline"
) -> DataFrame:
    """Apply the chain of each row's ``doc_type``; other types pass through unchanged.

    Column steps have no times of their own: they are one projection, so start and finish are the job's time.
    """
    out = df.withColumn(audit, F.array().cast(AUDIT_TYPE)).withColumn("__live", F.lit(True))
    for doc_type, steps in chains.items():
        for step in steps:
            if isinstance(step, PythonStep):
                out = run_python(out, doc_type, step, audit)
                continue
            mine = (F.col("doc_type") == doc_type) & F.col("__live")
            got = step.process(out, step.parameters)
            failed = F.coalesce(got.error, F.lit(False)) if got.error is not None else F.lit(False)
            changed = {}
            for name, value in got.columns.items():
                value = F.when(mine & ~failed, value)
                changed[name] = value.otherwise(F.col(name)) if name in out.columns else value
            alive = mine if got.keep is None else mine & F.coalesce(got.keep, F.lit(True))
            record = F.struct(
                F.lit(step.name).alias("step_name"),
                F.lit(_shown(step.parameters)).alias("parameters"),
                _flag(got.skipped).alias("skipped"),
                failed.alias("error"),
                (got.message if got.message is not None else F.lit(None).cast("string")).alias(
                    "message"
                ),
                F.current_timestamp().alias("start_time"),
                F.current_timestamp().alias("finish_time"),
                F.lit(None).cast("double").alias("compute_duration_seconds"),
            )
            changed[audit] = F.when(
                alive, F.concat(F.col(audit), F.array(record).cast(AUDIT_TYPE))
            ).otherwise(F.col(audit))
            if got.keep is not None:
                changed["__live"] = F.when(
                    mine & ~failed, F.coalesce(got.keep, F.lit(True))
                ).otherwise(F.col("__live"))
            out = out.withColumns(changed)
    return out.filter("__live").drop("__live")


def attempted(
    frame: pd.DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame | None], outputs: Sequence[str]
) -> tuple[list[pd.DataFrame], dict[object, str]]:
    """Results of a batch, and the traceback of every row that raises.

    A batch that raises is halved until the raising rows stand alone; all others are computed. Each
    call gets a copy. What a raising row's call had changed in its own copy stays.
    """
    results: list[pd.DataFrame] = []
    raised: dict[object, str] = {}
    waiting = [frame]
    while waiting:
        part = waiting.pop()
        work = part.copy(deep=True)
        try:
            got = call(work)
            got = part.iloc[:0] if got is None else got
            if len(got):
                if not got.index.is_unique or not got.index.isin(part.index).all():
                    raise ValueError("a step must keep the index of the rows it returns")
                got = got[list(outputs)]
            results.append(got)
        except Exception:
            if len(part) > 1:
                half = len(part) // 2
                waiting += [part.iloc[half:], part.iloc[:half]]
            else:
                raised[part.index[0]] = traceback.format_exc()
                results.append(work[[c for c in outputs if c in work.columns]])
    return results, raised


def run_python(df: DataFrame, doc_type: str, step: PythonStep, audit: str = "_pipeline") -> DataFrame:
    """Run a Python step on the live rows of one type; all others pass the batch as they are."""
    for name, kind in step.outputs.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    outputs, inputs = list(step.outputs), list(step.inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            n = batch.num_rows
            mine = np.asarray(batch.column("__mine").to_numpy(zero_copy_only=False), dtype=bool)
            keep, message = np.ones(n, bool), [None] * n
            begun, seconds = time.time(), 0.0
            columns = {c: batch.column(c) for c in batch.schema.names}
            if mine.any():
                if step.init is not None and state is None:
                    state = step.init(step.parameters)
                extra = () if step.init is None else (state,)
                table = pa.table({c: batch.column(c) for c in dict.fromkeys([*inputs, *outputs])})
                frame = table.to_pandas(integer_object_nulls=True)
                results, raised = attempted(frame.loc[mine, inputs], lambda f: step.fn(f, step.parameters, *extra), outputs)
                seconds = time.time() - begun
                returned = np.zeros(n, bool)
                for got in results:
                    returned[got.index.to_numpy(dtype=int)] = True
                for at, text in raised.items():
                    message[at] = text
                keep = ~mine | returned
                for c in outputs:
                    values = list(batch.column(c).to_pylist())
                    for got in results:
                        if c in got.columns:
                            for at, value in zip(got.index, pa.array(got[c], from_pandas=True, type=batch.schema.field(c).type).to_pylist()):
                                values[at] = value
                    columns[c] = pa.array(values, batch.schema.field(c).type)
            columns |= {
                "__keep": pa.array(keep), "__failed": pa.array([m is not None for m in message], pa.bool_()),
                "__message": pa.array(message, pa.string()), "__begun": pa.array(np.full(n, begun)), "__seconds": pa.array(np.full(n, seconds)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    live = F.col("__live") if "__live" in df.columns else F.lit(True)
    marked = df.withColumn("__mine", F.coalesce((F.col("doc_type") == doc_type) & live, F.lit(False)))
    noted = {"__keep": T.BooleanType(), "__failed": T.BooleanType(), "__message": T.StringType(), "__begun": T.DoubleType(), "__seconds": T.DoubleType()}
    done = marked.mapInArrow(run, T.StructType([*marked.schema, *(T.StructField(n, t) for n, t in noted.items())]))
    instant = lambda s: F.timestamp_micros((s * 1e6).cast("long"))
    record = F.struct(
        F.lit(step.name).alias("step_name"), F.lit(_shown(step.parameters)).alias("parameters"), F.lit(False).alias("skipped"),
        F.col("__failed").alias("error"), F.col("__message").alias("message"), instant(F.col("__begun")).alias("start_time"),
        instant(F.col("__begun") + F.col("__seconds")).alias("finish_time"), F.col("__seconds").alias("compute_duration_seconds"),
    )
    longer = F.concat(F.col(audit), F.array(record).cast(AUDIT_TYPE))
    return done.where(F.col("__keep")).withColumn(audit, F.when(F.col("__mine"), longer).otherwise(F.col(audit))).drop("__mine", *noted)


def each_document(fn: Callable[[Mapping, dict], dict | None]) -> Callable:
    """A batch function from ``fn(parameters, document)``, which returns the document or None to drop it."""

    def batch(frame: pd.DataFrame, parameters: Mapping) -> pd.DataFrame | None:
        found = {at: fn(parameters, row) for at, row in zip(frame.index, frame.to_dict("records"))}
        kept = {at: doc for at, doc in found.items() if doc is not None}
        return pd.DataFrame(list(kept.values()), index=list(kept), dtype=object) if kept else None

    return batch


def _flag(c: Column | None) -> Column:
    return F.lit(False) if c is None else F.coalesce(c, F.lit(False))


def _shown(parameters: Mapping) -> str:
    import json

    return json.dumps(parameters, sort_keys=True, default=str)


def content_preview(df: DataFrame, p: Mapping) -> Outcome:
    """First ``size`` characters of a non-empty source; otherwise the target stays."""
    source, target = p["source"], p["target"]
    size = override(df, "ContentPreview", "size", p["size"])
    if source not in df.columns:
        return Outcome()
    c = F.col(source)
    old = F.col(target) if target in df.columns else F.lit(None).cast("string")
    text = F.substring(c, F.lit(1), size.cast("int"))
    return Outcome({target: F.when(F.length(c) > 0, text).otherwise(old)})


def date_normalizer(df: DataFrame, p: Mapping) -> Outcome:
    """Date text to timestamp; unparsable becomes null. ``now`` is what relative phrases count from."""
    if p["source"] not in df.columns:
        return Outcome()
    now = F.lit(p["now"]).cast("timestamp") if p.get("now") else None
    ts = lenient_timestamp(F.col(p["source"]), p.get("date_formats", ()), p.get("fuzzy", True), now)
    return Outcome({p["target"]: ts})


def constant_field(df: DataFrame, p: Mapping) -> Outcome:
    """Set one field to a constant; the smallest possible step."""
    return Outcome({p["target"]: F.lit(p["value"])})


def drop_where(condition: Callable[[DataFrame], Column]) -> Process:
    """A step that drops documents, after which the rest of the chain does not run."""
    return lambda df, p: Outcome(keep=~F.coalesce(condition(df), F.lit(False)))


def cast_field(df: DataFrame, p: Mapping) -> Outcome:
    """A field as another type; a text that is none is an error of the step, null stays null."""
    if p["source"] not in df.columns:
        return Outcome()
    c = F.col(p["source"])
    value = c.try_cast(p["type"])
    text = F.concat(F.lit("cannot cast '"), c.cast("string"), F.lit(f"' to {p['type']}"))
    failed = c.isNotNull() & value.isNull()
    return Outcome({p["target"]: value}, error=failed, message=F.when(failed, text))


def user_step(
    df: DataFrame, doc_type: str, fn: Callable, inputs: Sequence[str], outputs: Mapping[str, str], name: str = "UserStep",
    parameters: Mapping[str, object] | None = None, audit: str = "_pipeline",
) -> DataFrame:
    """Run one Python function over the documents of one type, as a chain of its own with its audit."""
    return run_chain(df, {doc_type: [PythonStep(name, fn, inputs, outputs, parameters or {})]}, audit)
