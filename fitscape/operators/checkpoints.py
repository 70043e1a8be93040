"""Tables in the folder of checkpoints, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, to which checkpoint() writes; a temporary one is set on a single machine that names none."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


class Rounds:
    """Tables that an iteration writes once in each round, as Parquet: a round starts from files, and a lost executor costs its tasks only."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n, self.paths = spark, f"{with_checkpoints(spark)}/rounds-{uuid.uuid4().hex}", 0, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write df in place of the table of this name, which may be read for it, and goes then."""
        self.n += 1
        path = f"{self.folder}/{name}-{self.n}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in [self.paths.pop(x) for x in names if x in self.paths]:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
