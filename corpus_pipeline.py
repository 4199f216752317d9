"""From raw documents to encoded training text, in stages that each keep, cut or encode.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and works on all that
the stage before has kept. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard, pieces, quality, queries, repeats
from docloom.session import fresh_dir, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with a hash ``row_key`` of the given columns, nulls included; rows alike in them share it."""
    return docs.withColumn("row_key", F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull()))))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier gives a probability of 0.7 or more.

    Each row is judged by its own text, whether its id is null or repeated.
    """
    rows = keyed(docs, "doc_id", "text")
    scored = quality.quality_scores(rows, queries.table(spark, sf_dir, "labels"), queries.remainder(4) != 2, carry=("row_key",))
    good = scored.where("score >= 0.7").select("row_key").distinct()
    return rows.join(good, "row_key", "left_semi").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the one row with the least id.

    Each row is a document: rows that share an id are linked by their texts alone, a null id comes after
    all others, and of equal rows one stays. Texts without words have no duplicates and stay all.
    """
    rows = keyed(docs, *COLUMNS)
    found = jaccard.jaccard_classes(rows, "row_key").withColumnRenamed("doc", "row_key")
    found = found.groupBy("row_key", "component").agg(F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    named = found.join(rows.select("row_key", "doc_id").distinct(), "row_key")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "n", "copies")).alias("x")
    first = written(named.groupBy("component").agg(least).select("x.row_key", (F.expr("x.n > 0 and x.copies > 1")).alias("repeated")), "first")
    whole = rows.join(first.where("not repeated"), "row_key", "left_semi").select(*COLUMNS)
    one = rows.join(first.where("repeated"), "row_key", "left_semi").dropDuplicates(["row_key"])
    return whole.unionByName(one.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand anywhere else are cut; rows left empty go.

    Each row keeps its own other columns, whether its id is null or repeated.
    """
    rest = repeats.without_repeats(docs, extra=("lang", "source"))
    return rest.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share ten words in a row with a benchmark item go, each judged by its own text."""
    found = decontaminate.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    clean = found.where(F.size("hits") == 0).select(F.col("doc").alias("doc_id"), "row_key")
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return keyed.join(clean.select("row_key").distinct(), "row_key", "left_semi").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encoded(docs, queries.tokenizer("piece_bpe_32k.model"))
    return found.select(F.col("doc").alias("doc_id"), "n_pieces", "ids_crc32", "exact", "ids")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("decontamination", cut_benchmark),
    ("sentencepiece", encode),
]
#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
