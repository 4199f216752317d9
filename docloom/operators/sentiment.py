"""Lexicon sentiment: mean polarity and subjectivity of the words found in a lexicon."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens
from .chain import Outcome
from .joins import lookup_join


def score(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``key, polarity, subjectivity, n_scored`` for every document, zero without a hit.

    All tokens of a document sit in one task, so after a broadcast join the partial aggregate
    leaves one row per document before anything is shuffled.
    """
    words = df.select(key, F.explode_outer(tokens(F.col(text))).alias("word"))
    scored = lookup_join(
        words, lexicon.select("word", "polarity", "subjectivity"), ["word"], "left"
    )
    return scored.groupBy(key).agg(
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"),
        F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity"),
        F.count("polarity").alias("n_scored"),
    )


def sentiment_documents(
    docs: DataFrame,
    lexicon: DataFrame,
    doc_type: str,
    feature: str,
    analytic: str,
    session: str,
) -> DataFrame:
    """New documents that carry the score and refer back to the analysed one."""
    scores = score(docs.filter(F.col(feature).isNotNull()), "id", feature, lexicon)
    new_id = F.concat_ws(
        "-", F.col("id").cast("string"), F.lit(analytic), F.lit(session), F.lit(doc_type), F.lit(feature)
    )
    return scores.select(
        new_id.alias("_id"),
        new_id.alias("id"),
        F.lit("TextSentiment").alias("doc_type"),
        "polarity",
        "subjectivity",
        F.lit(doc_type).alias("analyzed_doc_type"),
        F.lit(feature).alias("analyzed_feature"),
        F.col("id").cast("string").alias("analyzed_id"),
    )


def sentiment_step(lexicon: Mapping[str, tuple[float, float]]):
    """Chain step for streams: the lexicon is a literal map, so no join and no state."""
    polarity = F.create_map(*[F.lit(x) for w, (p, _) in lexicon.items() for x in (w, float(p))])
    subject = F.create_map(*[F.lit(x) for w, (_, s) in lexicon.items() for x in (w, float(s))])

    def mean(found, table):
        hits = F.array_compact(F.transform(found, lambda t: F.try_element_at(table, t)))
        total = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(hits) > 0, total / F.size(hits)).otherwise(0.0)

    def process(df: DataFrame, p: Mapping) -> Outcome:
        source, target = p["source"], p["target"]
        found = tokens(F.col(source))
        value = F.struct(
            mean(found, polarity).alias("polarity"), mean(found, subject).alias("subjectivity")
        )
        present = F.col(target).isNotNull() if target in df.columns else F.lit(False)
        skip = present & F.lit(not p.get("recompute", False))
        old = F.col(target) if target in df.columns else F.lit(None)
        return Outcome(
            {target: F.when(skip | (F.length(source) == 0), old).otherwise(value)},
            skipped=skip,
            message=F.when(skip, F.lit(f"'{target}' property already exists.")),
        )

    return process
