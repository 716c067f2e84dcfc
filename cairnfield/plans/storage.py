"""Cutting lineage through the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this session and not yet deleted.
_WRITTEN: dict[str, None] = {}
#: The folder of a local session that names none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if Spark is local, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="cairnfield-")
        _OWN[context.applicationId] = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read it again.

    Cuts lineage so that a lost executor costs at most the stage at hand."""
    path = f"{shared_dir(df.sparkSession)}/cairnfield-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = None
    out = df.sparkSession.read.parquet(path)
    out._written = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, but dealt and sorted by ``key``: later joins on it don't shuffle these rows again."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"cairnfield_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    _WRITTEN[path] = None
    out = spark.table(table)
    out._written, out._table = path, table
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join: the size of rows that are exploded or hold arrays is estimated far too low,
    and a broadcast of them would go through the driver."""
    return df.hint("merge")


def release(*dfs: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these; nothing may read them afterwards."""
    for df in dfs:
        if hasattr(df, "_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        _delete(df.sparkSession, df._written)


def cleanup(spark: SparkSession) -> None:
    """Delete all that this session has written for results that are no longer needed."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
