"""Session settings and cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the settings come from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a session of this machine alone gets a temporary one if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: later steps read the columns they need, and no step is run twice."""
    path = f"{shared_folder(df.sparkSession)}/lodestrata-{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one piece of work in the shared folder, which go when it is done."""

    def __init__(self, spark: SparkSession):
        self._spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written once and read from there: cuts lineage, runs nothing twice, survives lost executors."""
        path = f"{shared_folder(self._spark)}/lodestrata-scratch-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        self.paths.append(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        for name in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.paths = []


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the folder that all executors share, so that what depends on its physical rows is stable."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
