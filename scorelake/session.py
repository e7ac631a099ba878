"""Session helpers shared by tests, bench and the checker."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to Python at once where ``small_batches`` holds; a single longer row is a batch of its own.
BATCH_BYTES = 1 << 21


def local_session(cpus: int | None = None, app: str = "scorelake") -> SparkSession:
    """A local session for development; clusters bring their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # One shuffle partition per core already; merging them would only idle cores.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys ahead of grouped Python work, in as many partitions as
    the session shuffles into. Adaptive merging goes by bytes and would put a
    little data with much work into a single task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local
    session without one (tests) gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="scorelake-"))
    return _local_folder[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back. Unlike a checkpoint,
    a written table also has its real size, so later joins are planned by what
    is there and not by estimates that multiply round after round."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile sends rows to Python by their bytes. By their number, ten thousand texts or pairs of them
    make one batch, and a task holds that several times: as Arrow vectors that grow, in the stream, and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
