"""Session set-up, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. A session on one machine that names none gets a temporary one; on a
    cluster this would not be shared, so there it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return jsc.getCheckpointDir().get()


def write_shared(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a parquet table in the shared checkpoint folder, with a folder per value of ``partition_by``."""
    at = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.repartition(*partition_by) if partition_by else df).write.partitionBy(*partition_by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that it outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def count_written(df: DataFrame) -> int:
    """Rows of a checkpointed frame, counted where they lie: one small job and no new plan for the driver to keep."""
    return int(df._jdf.queryExecution().toRdd().count())


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as there are cores: a small table in one file would keep one core busy with
    work that costs far more than moving its rows. Larger tables have more splits than cores and stay as they are.
    Only scans with projections and filters are looked at, so asking for partitions runs nothing; what comes from a
    shuffle is spread already."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
