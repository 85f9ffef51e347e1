"""Geometry that many plans share, made once: tables in the shared folder, by the digest of the text that makes them."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; only a local session without it gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"/tmp/checkpoints/spheric-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    atexit.register(shutil.rmtree, made, True)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cached(build, spark: SparkSession, folder: str | None, key: str) -> DataFrame:
    """The table under folder/key if a finished write left it there, else build()'s, which is written there. No folder, no cache."""
    if folder is None:
        return build()
    path = f"{folder.rstrip('/')}/{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what builds on it is planned from there."""
    path = f"{folder_of(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def geometry(spark: SparkSession, text: str, build=None) -> DataFrame:
    """The table that text makes, from the store. The text says all that it depends on."""
    key = "geometry-" + hashlib.sha256(text.encode()).hexdigest()[:24]
    return cached(build or (lambda: spark.sql(f"select * from {text} _g")), spark, folder_of(spark), key)
