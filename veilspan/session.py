"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Inputs below this many bytes may be reshuffled to use all cores; larger ones
# consist of enough row groups to be read in parallel as they are.
SMALL_INPUT_BYTES = 1 << 30


def build_session(app_name: str = "veilspan", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getConf().get("spark.checkpoint.dir")
    if configured is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="veilspan-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path``, asked of their file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def load_table(
    spark: SparkSession, directory: str, name: str, spread: bool = False
) -> DataFrame:
    """Read one parquet table.

    With ``spread``, a small input whose few row groups would leave cores idle
    during heavy per-row work is redistributed.  The size is checked first, so
    a large table is never reshuffled just for that.
    """
    path = f"{directory}/{name}.parquet"
    df = spark.read.parquet(path)
    if spread and input_bytes(spark, path) < SMALL_INPUT_BYTES:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df
