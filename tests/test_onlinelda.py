"""Training in chunks: the updates are Spark's, the rounds read their own documents, the model is kept as tables."""

import math

import numpy as np
import pytest
from docloom.operators import onlinelda as O, topics as T
from docloom.session import fresh_dir, written
from pyspark.sql import functions as F

ANIMALS, MONEY = "cat dog mouse pet animal zoo".split(), "stock bond market trade price bank".split()


@pytest.fixture(scope="module")
def docs(spark):
    """Two themes, a row without words, keys that repeat or are null."""
    rows = [(None if i == 7 else i // 2, [w for j, w in enumerate(MONEY if i % 3 else ANIMALS) if (i + j) % 4]) for i in range(240)]
    return written(spark.createDataFrame([*rows, (999, [])], "k long, words array<string>"), "docs")


def test_special_functions():
    x = np.array([1e-3, 0.3, 1.0, 2.5, 40.0])
    assert np.allclose(O.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert np.allclose(O.digamma(x), [(math.lgamma(v * 1.0001) - math.lgamma(v * 0.9999)) / (v * 0.0002) for v in x], rtol=1e-6)
    assert np.allclose(O.trigamma(x), (O.digamma(x * 1.0001) - O.digamma(x * 0.9999)) / (x * 0.0002), rtol=1e-6)


def test_shares_and_bound_are_sparks(spark, docs):
    """The weights that Spark has learnt give the same shares and the same bound here."""
    model = T.train(docs, num_topics=3, passes=5)
    names, lda = model.stages[0].vocabulary, model.stages[1]
    table = fresh_dir(spark, "words")
    spark.createDataFrame([(w,) for w in names], "word string").withColumn("hash", F.xxhash64("word")).write.parquet(table)
    at = {r["word"]: r["hash"] for r in spark.read.parquet(table).collect()}
    order = sorted(range(len(names)), key=lambda i: at[names[i]])
    weights = lda.topicsMatrix().toArray()[order].T
    own = O.ChunkedModel(spark, table, np.array([at[names[i]] for i in order]), weights, lda.estimatedDocConcentration().toArray(), 1 / 3, T.SEED)
    shares = [sorted((r["k"] or -1, r["topic"], r["weight"]) for r in T.topics_for(m, docs.where("k IS NOT NULL"), "k", 0.0).collect()) for m in (model, own)]
    assert len(shares[0]) == len(shares[1]) and np.allclose(shares[0], shares[1], atol=5e-3)
    assert math.isclose(T.perplexity_bound(model, docs), T.perplexity_bound(own, docs), rel_tol=1e-3)
    assert [(r["topic"], r["rank"], r["term"]) for r in T.topic_words(model, 3).collect() if r["rank"] == 0] == [x[:3] for x in own.heaviest(3) if x[1] == 0]


def test_a_round_reads_its_chunk(spark, docs, monkeypatch):
    """No round scans the corpus: its tasks open the parts of its chunk, and every pass opens each part once."""
    seen = []
    real = O.task
    monkeypatch.setattr(O, "task", lambda here, ahead, model: seen.append(frozenset(here)) or real(here, ahead, model))
    model = T.train(docs, num_topics=2, passes=3, chunk=20)
    rounds = seen[1:]
    assert isinstance(model, O.ChunkedModel) and len(rounds) == 36
    assert all(sum(map(len, rounds[p : p + 12])) == len(frozenset().union(*rounds[p : p + 12])) for p in (0, 12, 24))
    themes = [{w for t, _, w, _ in model.heaviest(6) if t == n} for n in (0, 1)]
    assert sorted(map(sorted, themes)) == sorted([sorted(ANIMALS), sorted(MONEY)])


def test_a_chunked_model_is_saved(spark, docs):
    model = T.train(docs, num_topics=2, passes=1, chunk=20, kept=True)
    root = fresh_dir(spark, "models")
    T.save_model(model, root, "chunks", "one", F.current_timestamp()).collect()
    again = T.load_model(root, "chunks", "one")
    there, here = (sorted((r["k"] or -1, r["topic"], r["weight"]) for r in T.topics_for(m, docs, "k", 0.0).collect()) for m in (again, model))
    assert there == here and len(here) == 2 * 241 and [x[2] for x in here if x[0] == 999] == [0, 0]
    assert T.perplexity_bound(again, docs) == pytest.approx(T.perplexity_bound(model, docs)) and T.perplexity_bound(model, docs) < 0
    assert T.topic_words(again, 4).count() == 8
    few = T.train(docs, num_topics=2, passes=1, chunk=20, vocabulary=5)
    assert few.weights.shape == (2, 5)


def test_empty_batches(spark, docs):
    model = T.train(docs, num_topics=2, passes=1, chunk=20)
    strange = spark.createDataFrame([(1, ["unheard", "of"]), (2, [])], "k long, words array<string>")
    assert [tuple(r) for r in T.topics_for(model, strange, "k", 0.0).orderBy("k", "topic").collect()] == [(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0)]
    assert T.topics_for(model, strange.where("false"), "k", 0.0).count() == 0
