"""Language identification by character n-grams and naive Bayes, for any number of languages."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import written
from .joins import lookup_join

# the gram counter travels with its job, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
# Fixed value: so many counts go back to Spark at a time.
ROWS = 100_000


def gram_counts(df: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """``keys, gram, n``: how often each text holds each of its character n-grams, lower case, white space squeezed.

    Texts reach Python in Arrow batches of a few MB; characters become numbers, grams numbers of ``n`` digits, and those of a text
    are sorted and counted. Texts shorter than a gram have none.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(4 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            whole = "".join(texts)
            chars, digits = np.unique(np.frombuffer(whole.encode("utf-32-le"), np.uint32), return_inverse=True)
            codes, size, base = digits.astype(np.int64), len(chars), max(len(chars), 1)
            for j in range(1, n):
                if size * base >= 1 << 62:
                    seen, codes = np.unique(codes, return_inverse=True)
                    size = len(seen)
                codes, size = codes[:-1] * base + digits[j : j + max(len(codes) - 1, 0)], size * base
            rows, places, found, begin = [], [], [], 0
            for i, one in enumerate(texts):
                _, at, times = np.unique(codes[begin : begin + max(len(one) - n + 1, 0)], return_index=True, return_counts=True)
                rows.append(np.full(len(at), i))
                places.append(at + begin)
                found.append(times)
                begin += len(one)
            if not texts:
                continue
            rows, places, found = np.concatenate(rows), np.concatenate(places), np.concatenate(found)
            # each gram of the batch is cut from the text once
            _, at, which = np.unique(codes[places], return_index=True, return_inverse=True)
            grams = pa.array([whole[p : p + n] for p in places[at].tolist()], pa.string())
            columns = [batch.column(k).take(pa.array(rows)) for k in range(len(keys))] + [grams.take(pa.array(which)), pa.array(found, pa.int64())]
            for low in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(low, ROWS) for c in columns], [*keys, "gram", "n"])

    squeezed = F.lower(F.regexp_replace(F.col(text), r"\s+", " "))
    flat = df.select(*keys, F.concat(F.lit(" "), squeezed, F.lit(" ")).alias("__text"))
    schema = StructType([*flat.schema.fields[:-1], StructField("gram", StringType()), StructField("n", LongType())])
    return flat.mapInArrow(count, schema)


@dataclass
class Profile:
    """A model: ``gram, languages`` with an array of (label, gain, base), and the label of the greatest base.

    ``base`` is the log-probability of a gram that the label's texts do not hold; ``gain`` is what a gram that they hold
    adds to it. Only held grams are rows, so the table grows with the texts and not with labels times grams.
    """

    table: DataFrame
    floor: tuple[str, float] | None
    n: int


def train(df: DataFrame, label: str, text: str, n: int = 3) -> Profile:
    """Log-probabilities with add-one smoothing from the rows that have a label and a text.

    Grams are counted in their text first; the counts are written and read back for totals and profile.
    """
    labelled = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    bags = gram_counts(labelled, [label], text, n)
    counts = written(bags.groupBy(F.col(label).alias("label"), "gram").agg(F.sum("n").alias("n")), "gram-counts")
    size = F.lit(counts.select("gram").distinct().count())
    bases = written(counts.groupBy("label").agg((-F.log(F.sum("n") + size)).alias("base")), "gram-totals")
    floor = bases.orderBy(F.desc("base"), "label").first()
    gains = lookup_join(counts, bases, ["label"]).select("gram", F.struct("label", F.log(F.col("n") + 1).alias("gain"), "base").alias("l"))
    table = gains.groupBy("gram").agg(F.collect_list("l").alias("languages"))
    return Profile(written(table, "language-profile"), tuple(floor) if floor else None, n)


def detect(df: DataFrame, key: str, text: str, profile: Profile) -> DataFrame:
    """``key, language, probability, scores map`` with softmax over the language scores.

    Scored are the languages that share a gram with the document, and the one likeliest among those that share
    none. Documents without a single known gram are skipped. Distinct grams are counted in the document's text; its hits
    are summed where they are found before one row per language moves.
    """
    bags = gram_counts(df.filter(F.col(text).isNotNull()), [key], text, profile.n)
    met = lookup_join(bags, profile.table, ["gram"]).select(key, "n", F.posexplode("languages").alias("at", "l"))
    # each known gram counts once, with the first of its languages
    sums = met.groupBy(key, F.col("l.label").alias("label"), F.col("l.base").alias("base")).agg(
        F.sum(F.col("n") * F.col("l.gain")).alias("gain"), F.sum(F.when(F.col("at") == 0, F.col("n")).otherwise(0)).alias("known")
    )
    whole = sums.groupBy(key).agg(F.sum("known").alias("known"), F.collect_list(F.struct("label", "gain", "base")).alias("found"))
    costs = F.transform("found", lambda f: F.struct((-(f["gain"] + F.col("known") * f["base"])).alias("cost"), f["label"].alias("lang")))
    if profile.floor is not None:
        label, base = profile.floor
        rest = F.struct((-F.col("known") * F.lit(base)).alias("cost"), F.lit(label).alias("lang"))
        costs = F.when(F.exists("found", lambda f: f["label"] == label), costs).otherwise(F.concat(costs, F.array(rest)))
    best = whole.withColumn("__ranked", F.sort_array(costs)).withColumn("__low", F.get("__ranked", F.lit(0))["cost"])
    weights: Column = F.transform("__ranked", lambda r: F.exp(F.col("__low") - r["cost"]))
    best = best.withColumn("__total", F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x))
    share = lambda r: F.struct(r["lang"].alias("key"), (F.exp(F.col("__low") - r["cost"]) / F.col("__total")).alias("value"))
    return best.select(
        key, F.get("__ranked", F.lit(0))["lang"].alias("language"), (F.lit(1.0) / F.col("__total")).alias("probability"),
        F.map_from_entries(F.transform("__ranked", share)).alias("scores"),
    )
