"""Small files and folders on any file system that Spark reaches, through Spark's own Hadoop client."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver does."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir; only local sessions without the setting get a folder of their own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to a scratch folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, seconds of the last change) of what lies in a folder; nothing if there is none."""
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    return sorted((x.getPath().getName(), x.getModificationTime() // 1000) for x in files.listStatus(path))


def read_text(spark: SparkSession, name: str) -> str:
    path, files = _path(spark, name)
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, name: str, text: str) -> bool:
    """Writes a small file whole, by a rename; False if there is one of this name, which then stays as it is."""
    path, files = _path(spark, name)
    jvm = spark.sparkContext._jvm
    staged = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
    files.mkdirs(path.getParent())
    stream = files.create(staged, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(staged), files.makeQualified(path), options)
        return True
    except Exception:
        files.delete(staged, False)
        if not files.exists(path):
            raise
        return False


def delete(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)
