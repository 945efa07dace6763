"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


MEASURED_BROADCAST = "32MB"
ARROW_BATCH = "16MB"


def local_session(cpus: str | int = "*", name: str = "shelfsift", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Broadcast by measured sizes only.

    Before a job runs, Spark takes an exploded table to be as small as the texts it came from, and
    would broadcast it. So plans start without automatic broadcasts, and adaptive execution turns
    joins into broadcasts once the real size of a side is known.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED_BROADCAST)
    # Rows may be whole texts or packed tiles: batches for Python workers are bounded by bytes as well.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if named is None and current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="shelfsift-")
    if current is None:
        sc.setCheckpointDir(named)
    return named or os.path.dirname(current)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package even where it is not installed; once per application."""
    sc = spark.sparkContext
    if not any(str(f).rsplit("/", 1)[-1].startswith("shelfsift-") for f in sc.listFiles):
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="shelfsift-code-")
        archive = shutil.make_archive(f"{folder}/shelfsift-{uuid.uuid4().hex}", "zip", os.path.dirname(root), os.path.basename(root))
        sc.addPyFile(archive)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to all cores when the input has fewer splits than there are cores.

    A table of one small file is otherwise read, and all its texts taken apart, by one task. Inputs
    with splits enough for every core are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    Survives the loss of executors and fixes both the row order inside each partition and the
    partition numbers, which the positional operators rely on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
