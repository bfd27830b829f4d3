"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Staging:
    """Tables of one plan, written as Parquet and read back, so that lineage and plans stay short; ``clear`` deletes all but the kept ones."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{work_dir(spark)}/loomline-{uuid.uuid4().hex}"
        self.tables: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.tables)}"
        self.tables[len(self.tables)] = path
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._at = path
        return out

    def clear(self, *kept: DataFrame) -> None:
        hold = {df._at for df in kept}
        with suppress(OSError):
            for path in set(self.tables.values()) - hold:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
