"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for.  AQE turns small join sides into broadcasts at run time,
# splits skewed join partitions, and (last entry) prefers a hash join over sorting wide text rows
# when every build-side partition is small.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Text rows are wide: bound an Arrow batch by bytes, and by rows for the arrays made from it.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


#: MB of an Arrow batch of texts or word codes; an executor holds several copies of one a core, beside its heap.
BATCH_MB = 8


def bound_batches(spark: SparkSession, most: int = BATCH_MB) -> None:
    """Lower the session's Arrow batches to ``most`` MB: whole documents of one input split are tens of MB otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(name).lower()).groups()
    now = int(number) * 1024 ** "bkmg".index(unit or "b")
    if now <= 0 or now > most << 20:
        spark.conf.set(name, f"{most}m")


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session around."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusflow")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    ``spark.checkpoint.dir`` decides.  Only a local session without that setting gets a
    temporary folder; a cluster session without it is an error, because a folder on one
    machine is lost with that machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpusflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/corpusflow-{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and continue from the table.

    For results that several later steps read: each of them prunes columns and partitions, and none
    repeats the work before.
    """
    path = scratch_path(df.sparkSession, name)
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
