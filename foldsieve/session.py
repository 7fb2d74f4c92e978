"""Session helpers: building a local session, reading tables, shared work tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foldsieve")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_foldsieve_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="foldsieve-")) / "foldsieve.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._foldsieve_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table by name."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh temporary one only where it is unset and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_foldsieve_folder", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context._foldsieve_folder = "file://" + tempfile.mkdtemp(prefix="foldsieve-")
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/foldsieve/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage with a table that every executor can read, so a lost
    executor costs only the tasks that were running on it.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._work_path = path
    return table


def release(spark: SparkSession) -> None:
    """Let the driver forget finished steps, so that their shuffle files go from the executors' disks.

    Spark deletes a shuffle's files once the driver's garbage collector finds
    its plan unreachable; between steps that move the texts we do not wait for
    that to happen by chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(table: DataFrame) -> None:
    """Delete a work table that no later step reads."""
    hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._work_path)
    hadoop.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
