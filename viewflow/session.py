"""Small services around a SparkSession."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def make_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the driver found it."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in have:
        env["PYTHONPATH"] = ":".join([root, *have])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without the setting gets a temporary one, which
    goes when the process ends; any other master is refused, since a machine-local folder is not shared there."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="viewflow-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/viewflow-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the JVM is going away as well; what is left is only a temporary folder
        return


def checkpointed(df: DataFrame) -> DataFrame:
    """The relation's rows in the shared folder: lineage ends there, and what depended on chance or on partitions stays
    as it is."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The relation written to the shared folder as Parquet and read back: like checkpointed(), but only the columns
    that are used are read again, and their sizes are known to the optimizer."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
