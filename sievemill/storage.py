"""Tables written on the way to a result, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    In local mode a temporary one is made where none is set; on a cluster that would be a different
    folder on every machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-sievemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and outlives lost executors.

    The table stays until `discard`, as whoever uses the result may still read it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables of `stored`, all if none are named. Results that read them must have been written by then."""
    for path in list(_written if paths is None else paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """`stored` of what ``make`` gives; tables that were stored on the way to it are deleted."""
    first = len(_written)
    result = stored(make(), name)
    discard(spark, _written[first:-1])
    return result
