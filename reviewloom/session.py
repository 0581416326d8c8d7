"""Session defaults and staged tables.

Staged tables lie under ``spark.checkpoint.dir``, the folder that all executors
of a cluster share, in a folder of the application. ``drop_staged`` removes
that folder when a run has written its results.
"""

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for the bytes of a batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CHANGING = threading.RLock()


def local_session(cores="*", shuffle_partitions=8, app_name="reviewloom", **conf):
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    conf.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="reviewloom-"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables, models and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without: a machine's own folder would be lost with its executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="reviewloom-")
    sc.setCheckpointDir(root)
    return root


def drop_staged(spark: SparkSession):
    """Remove all that this application has staged. Tables read from there are gone."""
    sc = spark.sparkContext
    drop_table(spark, f"{stage_root(spark)}/{sc.applicationId}")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never one used before."""
    return f"{stage_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, batch_bytes=None):
    """Meanwhile Spark sends little more than ``batch_bytes`` to Python at once; the session's own setting holds if none are given.

    The setting is the session's, so threads that change it wait for each other.
    """
    if not batch_bytes:
        yield
        return
    with _CHANGING:
        before = spark.conf.get(BATCH_BYTES)
        spark.conf.set(BATCH_BYTES, str(batch_bytes))
        try:
            yield
        finally:
            spark.conf.set(BATCH_BYTES, before)


def drop_table(spark: SparkSession, path: str):
    """Remove one staged table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, batch_bytes=None, **options) -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the
    true size of the table, so that it broadcasts only what is really small.
    Meanwhile Spark sends little more than ``batch_bytes`` to Python at once;
    the session's own setting holds if none are given, and again afterwards.
    ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    with batches_of(spark, batch_bytes):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
