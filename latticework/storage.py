"""Tables in the shared folder, and broadcast hints behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary
    one is set; on a cluster that is an error, as other machines would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_known: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/latticework/{spark.sparkContext.applicationId}"
    if path not in _known:
        folder, fs = _files(spark, path)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _known.add(path)
    return path


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This ends the lineage: a lost executor costs the tasks that read the table,
    never what made it.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


#: Rows that may come to the driver for a kernel over all elements.
COLLECTED = 5_000_000


def collected(df: DataFrame, most: int = COLLECTED):  # noqa: ANN201
    """``df`` as a pandas table, after its rows are counted and found to be within ``most``."""
    if (n := df.count()) > most:
        raise ValueError(f"{n} rows; the driver takes {most}")
    return df.toPandas()


def sweep(spark: SparkSession) -> None:
    """Delete the tables that this application's ``cut`` has written, once no result that reads them is needed."""
    path = run_dir(spark)
    folder, fs = _files(spark, path)
    fs.delete(folder, True)
    _known.discard(path)
