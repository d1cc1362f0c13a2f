"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "threadloom") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, because there every task runs on this
    machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="threadloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


#: With it, Spark removes a query's shuffle files as the query ends, rather than when its plan is collected as garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files; for queries whose plan isn't run again, such as writes."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    Used by loops and wherever a plan is read several times and must give the
    same rows each time, also after an executor is lost.  A written table is
    used rather than ``checkpoint()``, which keeps the size *estimate* of the
    old plan: over a loop of joins that number multiplies without end until
    planning takes longer than the work.  A table has its true size, by which
    Spark also chooses the joins.  ``schema`` reads the columns as other types
    that are stored alike, such as structs as vectors.  The shuffle files of the
    old plan are removed at once: loops would fill the disk with them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(schema or df.schema).parquet(path)
    table._cut_at = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` returned and nothing reads again, so that a loop keeps its last round only."""
    for table in tables:
        spark, path = table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._cut_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
