"""Tables and files that driver and executors share.

Everything goes below ``spark.checkpoint.dir``.  Only where that is unset (unit
tests, a laptop) a local default is used, so a cluster never writes to a
machine-local folder.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SHARED_DIR = "/tmp/checkpoints"
#: After so many staged tables the driver's JVM collects garbage, so that Spark drops what finished steps have left.
COLLECT_EVERY = 12


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as a URI or an absolute path; on a cluster it has to be named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or DEFAULT_SHARED_DIR).rstrip("/")


_roots: set[str] = set()
_staged = itertools.count(1)


def clean(spark: SparkSession, root: str) -> None:
    """Deletes an application's staged tables; results that read them must be written by then."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean_at_exit(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped before
        if spark.sparkContext._jsc is not None:
            clean(spark, root)


def new_dir(spark: SparkSession, tag: str) -> str:
    """A new folder of this application, which is deleted when the driver ends."""
    root = f"{shared_dir(spark)}/stepwell/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_clean_at_exit, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows of whole texts travel to Python in batches of at most ``rows``: both ends hold a batch or two for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stage(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of a table, not the plan
    that made it.
    """
    small_batches(spark)
    path = new_dir(spark, tag)
    df.write.parquet(path)
    if next(_staged) % COLLECT_EVERY == 0:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or an absolute path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
