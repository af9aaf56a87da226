"""Session helpers shared by every job: the shared folder, lineage cuts, partition sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``. Only where that is unset and all tasks run on this machine (tests) a temporary folder is
    made; on a cluster, where no machine's own folder would do, the setting is asked for.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage as ``checkpoint()`` does, survives lost executors, and keeps columns compressed.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the path, for loops that drop each round's table when the next is there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dealt(df: DataFrame) -> DataFrame:
    """The right side of a join whose sides both grow with the input: both are shuffled. A broadcast would pass it through the driver,
    once a join, and loops over joins would pass the whole table there many times."""
    return df.hint("merge")


def own_step(df: DataFrame) -> DataFrame:
    """``df`` as a step that Spark does not fuse with the next: of a long chain of projections it makes one Java method, and beyond 8,000
    bytes a method is not compiled by the JVM and runs many times slower."""
    return df.select(F.inline(F.transform(F.array(F.struct(*df.columns)), lambda x: x)))


class Growing:
    """A table that only grows: each part is written to a folder of its own under one path and none is written twice."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema, self.path, self.parts = df.sparkSession, df.schema, fresh_path(df.sparkSession, label), 0
        self.add(df)

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a part; what was written."""
        at = f"{self.path}/part{self.parts}"
        self.parts += 1
        df.select(*self.schema.names).write.parquet(at)
        return self.spark.read.schema(self.schema).parquet(at)

    def rows(self) -> DataFrame:
        """All parts."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`scratch`."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table that one task sorts or groups.
TASK_ROWS = 250_000


def by_size(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt out by ``keys`` over as many tasks as its rows need; left as it is where the session's shuffle partitions do.

    What is sorted or grouped by ``keys`` afterwards stays in these tasks, whose memory then does not grow with the input. The rows
    are counted, so this is for tables that are read from files and not for what is computed.
    """
    parts = -(-df.count() // task_rows)
    return df.repartition(parts, *keys) if parts > shuffle_partitions(df.sparkSession) else df
