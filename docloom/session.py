"""Session helpers: shared scratch space and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession

# Fixed value: rows of a task that sorts or aggregates whole rows, so its memory does not follow the table.
TASK_ROWS = 250_000


def local_session(cores: str = "8", name: str = "docloom") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that outlives executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without
    that setting falls back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="docloom-")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch root."""
    return f"{scratch_root(spark)}/docloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Unlike executor-local caching this survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python in Arrow batches of a few MB; Spark's default of 10,000 rows takes GB of long texts. A value set by the caller stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def spread(scan: DataFrame) -> DataFrame:
    """Let CPU-heavy work on a plain scan use every core.

    A large table is split into more partitions than there are cores and passes through
    unchanged. A small one that arrives in a single row group is redistributed once. Select the
    needed columns first; only the split plan is computed here, no job runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def even(df: DataFrame, *by: str | Column, least: int = 1) -> DataFrame:
    """``df`` in parts of about ``TASK_ROWS`` rows, dealt by a hash, if it has fewer parts than that or than ``least``.

    Splits of a file follow its bytes, and a compressed one holds millions of rows. ``df`` is counted, so it should be cheap to scan.
    Rows equal in ``by`` share a part.
    """
    parts = max(least, -(-df.count() // TASK_ROWS))
    return df.repartition(parts, *by) if parts > df.rdd.getNumPartitions() else df
