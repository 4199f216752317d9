"""Topic models on Spark ML: training, inspection, coherence, registry."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rows import each
from ..functions.text import clean_tokens, without_words
from ..session import written
from .onlinelda import ChunkedModel, train_chunks
from .phrases import apply_phrases, scored_pairs

# Training defaults.
NUM_TOPICS, SEED, PASSES, CHUNK = 10, 100, 10, 100
WINDOW = 110
TOP_WORDS = 20
# Chunks of a corpus that Spark's own training is given; it scans the corpus for each, so more are trained by ``onlinelda``.
SCANNED_CHUNKS = 10


def prepared(
    docs: DataFrame,
    key: str,
    text: str,
    stop: Sequence[str],
    phrases: DataFrame | None = None,
) -> DataFrame:
    """``key, words``: cleaned tokens without stop words, optionally with phrases merged."""
    out = docs.filter(F.length(text) > 0).select(
        key, without_words(clean_tokens(F.col(text)), stop).alias("words")
    )
    if phrases is not None:
        out = apply_phrases(out, key, "words", phrases)
    return out.filter(F.size("words") > 0)


def reread(words: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, bool]:
    """``words`` for several readers, and whether they are a written table: those of many chunks are, so texts are cut into words once.

    Spark's draws follow the parts of a table, so a corpus that it trains on stays as it is.
    """
    table = written(words, "topic-words")
    return (table, True) if table.count() > SCANNED_CHUNKS * chunk else (words, False)


def learn_phrases(docs: DataFrame, text: str, **limits) -> DataFrame:
    """Phrases are learnt from tokens that still contain stop words."""
    raw = docs.filter(F.length(text) > 0).select(clean_tokens(F.col(text)).alias("words"))
    return scored_pairs(raw, "words", **limits)


def train(
    words: DataFrame,
    num_topics: int = NUM_TOPICS,
    seed: int = SEED,
    passes: int = PASSES,
    chunk: int = CHUNK,
    vocabulary: int | None = None,
    kept: bool = False,
) -> PipelineModel | ChunkedModel:
    """Online LDA over the whole dictionary with learnt document concentration.

    ``passes`` over the corpus in chunks of ``chunk`` documents. Spark's training scans the corpus for every chunk: up to
    ``SCANNED_CHUNKS`` of them become its sampling rate and number of rounds. A larger corpus is dealt to its chunks once, and a round reads
    one. The model is ``num_topics`` times the vocabulary and lives on the driver; only an explicit ``vocabulary`` keeps just the
    most frequent words. ``kept``: ``words`` read a written table, which a large corpus need not be copied from.
    """
    # every round reads the corpus again: texts are cut into words once
    if not kept or words.count() <= SCANNED_CHUNKS * chunk:
        words = written(words.select("words"), "lda-words")
    n_docs = max(1, words.count())
    if n_docs > SCANNED_CHUNKS * chunk:
        return train_chunks(words.select("words"), num_topics, seed, passes, round(n_docs / chunk), vocabulary)
    size = vocabulary or max(1, each(words, [], F.array_distinct("words"), "word").distinct().count())
    rate = min(1.0, chunk / n_docs)
    return Pipeline(
        stages=[
            CountVectorizer(inputCol="words", outputCol="features", vocabSize=size),
            LDA(
                k=num_topics,
                seed=seed,
                optimizer="online",
                optimizeDocConcentration=True,
                maxIter=max(1, round(passes / rate)),
                subsamplingRate=rate,
            ),
        ]
    ).fit(words)


def topic_words(model: PipelineModel | ChunkedModel, top: int = TOP_WORDS) -> DataFrame:
    """``topic, rank, term, weight`` of the heaviest words per topic; as many rows as topics times ``top``."""
    if isinstance(model, ChunkedModel):
        rows = model.heaviest(top)
    else:
        vectorizer, lda = model.stages
        names = vectorizer.vocabulary
        rows = [
            (r["topic"], rank, names[at], float(weight))
            for r in lda.describeTopics(top).collect()
            for rank, (at, weight) in enumerate(zip(r["termIndices"], r["termWeights"]))
        ]
    return SparkSession.getActiveSession().createDataFrame(rows, "topic int, rank int, term string, weight double")


def perplexity_bound(model: PipelineModel | ChunkedModel, words: DataFrame) -> float:
    """Per-word likelihood bound (negative; higher is better)."""
    if isinstance(model, ChunkedModel):
        return model.bound(words)
    vectorizer, lda = model.stages
    return -lda.logPerplexity(vectorizer.transform(words))


def topics_for(
    model: PipelineModel | ChunkedModel, words: DataFrame, key: str, minimum: float = 0.01
) -> DataFrame:
    """``key, topic, weight`` for topics with at least the minimum weight."""
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, ChunkedModel):
        spread = each(model.shares(words, key, "shares"), [key], F.col("shares"), "weight", at="topic")
    else:
        spread = each(
            model.transform(words), [key], vector_to_array("topicDistribution"), "weight", at="topic"
        )
    return spread.filter(F.col("weight") >= minimum)


def covered_windows(positions: Column, n_tokens: Column, width: int = WINDOW) -> Column:
    """How many sliding windows of a document contain at least one of the sorted positions.

    A window starts at 0..last. Position ``p`` is inside the windows that start at
    ``p-width+1 .. p``; the union of these ranges is measured in one linear pass.
    """
    last = F.greatest(n_tokens - width, F.lit(0))
    step = F.aggregate(
        positions,
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, p: F.struct(
            F.greatest(acc["end"], F.least(p, last)).alias("end"),
            (
                acc["total"]
                + F.greatest(
                    F.least(p, last) - F.greatest(p - (width - 1), acc["end"] + 1) + 1, F.lit(0)
                )
            ).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return step


def window_counts(
    docs: DataFrame, key: str, token_col: str, words: Sequence[str], width: int = WINDOW
) -> DataFrame:
    """Windows that contain a word, or both words of a pair: ``a, b, n_windows``.

    Pairs are limited to the given topic words. Windows themselves are never materialised:
    both-present counts follow from the sizes of unions of position ranges.
    """
    chosen = sorted(set(words))
    # the whole text is gone through once; each word then looks at the places of chosen words alone
    marked = F.array_compact(F.transform(F.col(token_col), lambda t, i: F.when(t.isin(chosen), F.struct(t.alias("w"), i.alias("i")))))
    found = docs.select(key, F.size(token_col).alias("n"), marked.alias("__hits")).filter(F.size("__hits") > 0)
    spots = F.transform(
        F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["w"]))),
        lambda w: F.struct(w.alias("w"), F.transform(F.filter("__hits", lambda h: h["w"] == w), lambda h: h["i"]).alias("at")),
    )
    # only the words that occur in the document take part
    held = found.select(key, "n", spots.alias("held"))
    pairs = F.flatten(
        F.transform(
            "held",
            lambda x: F.transform(
                F.filter("held", lambda y: y["w"] >= x["w"]),
                lambda y: F.struct(
                    x["w"].alias("a"),
                    y["w"].alias("b"),
                    (
                        covered_windows(x["at"], F.col("n"), width)
                        + covered_windows(y["at"], F.col("n"), width)
                        - covered_windows(
                            F.array_sort(F.array_union(x["at"], y["at"])), F.col("n"), width
                        )
                    ).alias("n"),
                ),
            ),
        )
    )
    return (
        each(held, [], pairs, "p")
        .select("p.*")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n_windows"))
        .filter(F.col("n_windows") > 0)
    )


def total_windows(docs: DataFrame, token_col: str, width: int = WINDOW) -> DataFrame:
    per_doc = F.greatest(F.size(token_col) - width, F.lit(0)) + 1
    return docs.filter(F.size(token_col) > 0).agg(F.sum(per_doc).alias("total_windows"))


def coherence(
    docs: DataFrame, key: str, token_col: str, topics: Mapping[int, Sequence[str]], width: int = WINDOW
) -> DataFrame:
    """``topic, coherence``: mean cosine between NPMI vectors of the topic's words."""
    spark = docs.sparkSession
    every = sorted({w for ws in topics.values() for w in ws})
    counts = window_counts(docs, key, token_col, every, width)
    total = F.lit(total_windows(docs, token_col, width).first()["total_windows"] or 0)
    members = spark.createDataFrame(
        [(t, w) for t, ws in topics.items() for w in dict.fromkeys(ws)], "topic int, w string"
    )
    both = counts.union(counts.filter("a <> b").select("b", "a", "n_windows"))
    single = counts.filter("a = b").select(F.col("a").alias("w"), F.col("n_windows").alias("n_w"))
    left = members.select("topic", F.col("w").alias("a"))
    right = members.select("topic", F.col("w").alias("b"))
    grid = (
        left.join(right, "topic")
        .join(both, ["a", "b"], "left")
        .join(single.select(F.col("w").alias("a"), F.col("n_w").alias("n_a")), "a", "left")
        .join(single.select(F.col("w").alias("b"), F.col("n_w").alias("n_b")), "b", "left")
    )
    eps = F.lit(1e-12)
    p_ab = F.coalesce("n_windows", F.lit(0)) / total + eps
    p_a = F.coalesce("n_a", F.lit(0)) / total + eps
    p_b = F.coalesce("n_b", F.lit(0)) / total + eps
    npmi = grid.select("topic", "a", "b", (F.log(p_ab / (p_a * p_b)) / -F.log(p_ab)).alias("m"))
    sums = npmi.groupBy("topic", "b").agg(F.sum("m").alias("s"))
    measured = npmi.join(sums, ["topic", "b"]).groupBy("topic", "a").agg(
        (
            F.sum(F.col("m") * F.col("s"))
            / (F.sqrt(F.sum(F.col("m") ** 2)) * F.sqrt(F.sum(F.col("s") ** 2)))
        ).alias("c")
    )
    return measured.groupBy("topic").agg(F.avg("c").alias("coherence"))


def save_model(model: PipelineModel | ChunkedModel, root: str, name: str, instance: str, now: Column) -> DataFrame:
    """Write the model and return its registry document, ready for an upsert."""
    path = f"{root}/models/{name}/{instance}"
    if isinstance(model, ChunkedModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    ident = hashlib.sha256(f"{name}/{instance}".encode()).hexdigest()
    return spark.range(1).select(
        F.lit("Model").alias("doc_type"),
        F.lit(ident).alias("id"),
        F.lit(name).alias("model_name"),
        F.lit(instance).alias("model_instance_id"),
        F.lit(path).alias("path"),
        now.alias("saved"),
    )


def load_model(root: str, name: str, instance: str) -> PipelineModel | ChunkedModel:
    path, spark = f"{root}/models/{name}/{instance}", SparkSession.getActiveSession()
    if ChunkedModel.stands_in(spark, path):
        return ChunkedModel.load(spark, path)
    return PipelineModel.load(path)
