"""Entity spans: text references with character offsets.

Patterns use Java regex syntax and must not match the empty text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import each
from .chain import Outcome
from .joins import lookup_join

SPAN = "struct<label:string,start_char:int,end_char:int,text:string,source:string,source_path:string>"
BLOCK = 64


def _running(values: Column, start: Column) -> Column:
    """Running totals of an array from a start value."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        values,
        F.struct(start.alias("total"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"), F.array_append(acc["out"], acc["total"] + x).alias("out")
        ),
        lambda acc: acc["out"],
    )


def running_totals(df: DataFrame, values: str, name: str) -> DataFrame:
    """Adds the running totals of an integer array column.

    Appending copies the array, so totals are taken in blocks of fixed size; a text with
    millions of matches then costs a multiple of its length and not the square of it.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")),
        lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)),
    )
    sums = F.transform(
        "__blocks", lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x)
    )
    totals = F.flatten(
        F.transform(
            "__blocks",
            lambda block, b: _running(
                block, F.when(b > 0, F.get("__ends", b - 1)).otherwise(F.lit(0))
            ),
        )
    )
    return (
        df.withColumn("__blocks", blocks)
        .withColumn("__ends", _running(sums, F.lit(0)))
        .withColumn(name, totals)
        .drop("__blocks", "__ends")
    )


def with_spans(df: DataFrame, source: str, label: str, pattern: str, name: str) -> DataFrame:
    """Adds ``array<struct<label,start_char,end_char,text>>`` of all matches in text order.

    Spark returns matches without offsets. The pieces between the matches give them: a match
    ends where the pieces and matches up to it end. No Python is involved.
    """
    cut = df.withColumns(
        {
            "__found": F.regexp_extract_all(source, F.lit(pattern), F.lit(0)),
            "__gaps": F.split(source, pattern, -1),
        }
    )
    sized = cut.withColumn(
        "__sizes", F.zip_with(F.slice("__gaps", F.lit(1), F.size("__found")), "__found",
                              lambda g, m: F.length(g) + F.length(m)),
    )
    spans = F.zip_with(
        "__found",
        "__stops",
        lambda m, stop: F.struct(
            F.lit(label).alias("label"),
            (stop - F.length(m)).alias("start_char"),
            stop.alias("end_char"),
            m.alias("text"),
        ),
    )
    return (
        running_totals(sized, "__sizes", "__stops")
        .withColumn(name, spans)
        .drop("__found", "__gaps", "__sizes", "__stops")
    )


def find_spans(df: DataFrame, source: str, patterns: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """Adds the spans of several labelled patterns, pattern by pattern."""
    out, parts = df, []
    for i, (label, pattern) in enumerate(patterns):
        parts.append(f"__spans{i}")
        out = with_spans(out, source, label, pattern, parts[-1])
    return out.withColumn(name, F.concat(*[F.col(c) for c in parts])).drop(*parts)


def pattern_spans(
    df: DataFrame,
    key: str,
    source: str,
    patterns: Sequence[tuple[str, str]],
    labels: Sequence[str] | None = None,
    tagger: str = "PatternSpans",
) -> DataFrame:
    """One row per span: key and the text-reference fields."""
    used = [p for p in patterns if labels is None or p[0] in labels]
    found = find_spans(df.select(key, source), source, used, "__spans")
    return each(found, [key], F.col("__spans"), "s").select(key, "s.*").withColumns(
        {"source": F.lit(tagger), "source_path": F.lit(source)}
    )


def gazetteer_spans(
    df: DataFrame,
    key: str,
    source: str,
    gazetteer: DataFrame,
    labels: Sequence[str] | None = None,
    token_pattern: str = r"\p{L}+",
    tagger: str = "GazetteerSpans",
) -> DataFrame:
    """Spans of tokens found in a ``(term, label)`` table, compared in lower case.

    Tokens keep their offsets; the join follows the measured size of the gazetteer and salts
    the token side when it is too large to broadcast.
    """
    names = gazetteer.select("term", F.col("label").alias("__label")).distinct()
    if labels is not None:
        names = names.filter(F.col("__label").isin(list(labels)))
    found = with_spans(df.select(key, source), source, "", token_pattern, "__spans")
    spots = each(found, [key], F.col("__spans"), "s").select(key, "s.*")
    tokens = spots.withColumn("term", F.lower("text"))
    return lookup_join(tokens, names, ["term"]).select(
        key,
        F.col("__label").alias("label"),
        "start_char",
        "end_char",
        "text",
        F.lit(tagger).alias("source"),
        F.lit(source).alias("source_path"),
    )


def spans_step(spans_col: str):
    """Chain step: fill ``target`` with found spans unless it is there already.

    Spans come from :func:`find_spans`, computed once for the frame before the chain.
    """

    def process(df: DataFrame, p: Mapping) -> Outcome:
        source, target = p["source"], p["target"]
        labels = p.get("include_labels")
        found = F.col(spans_col)
        if labels is not None:
            found = F.filter(found, lambda s: s["label"].isin(list(labels)))
        found = F.transform(
            found,
            lambda s: F.struct(
                s["label"].alias("label"),
                s["start_char"].alias("start_char"),
                s["end_char"].alias("end_char"),
                s["text"].alias("text"),
                F.lit("PatternSpans").alias("source"),
                F.lit(source).alias("source_path"),
            ),
        )
        present = F.col(target).isNotNull() if target in df.columns else F.lit(False)
        skip = present & F.lit(not p.get("recompute", False))
        old = F.col(target) if target in df.columns else F.lit(None).cast(f"array<{SPAN}>")
        return Outcome(
            {target: F.when(skip | F.col(source).isNull(), old).otherwise(found)},
            skipped=skip,
            message=F.when(skip, F.lit(f"'{target}' property already exists.")),
        )

    return process
