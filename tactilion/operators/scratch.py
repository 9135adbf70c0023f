"""Tables written to the folder that driver and executors share: cuts lineage, survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where the setting is absent and all runs in one JVM (tests), a temporary folder is made and recorded in the session.
    On a cluster an absent setting is an error: executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tactilion-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
