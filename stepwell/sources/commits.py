"""Outputs of a run as one commit.

A run writes several tables (rows, summary, losses).  Each goes to a folder that
nobody knows yet; then one small manifest, renamed into place, names them all.
Readers follow manifests only, so they see a batch of a run whole or not at all,
whatever failed in between, and a batch that is written again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, folder: str):
    """(Hadoop file system of a folder, path maker)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _manifest(folder: str, run: str, batch: int) -> str:
    return f"{folder}/_manifests/{run}/{batch:010d}.json"


def committed(spark: SparkSession, folder: str, run: str) -> list[dict]:
    """The manifests of a run, by batch."""
    files, path = _files(spark, folder)
    where = path(f"{folder}/_manifests/{run}")
    if not files.exists(where):
        return []
    names = sorted(f.getPath().toString() for f in files.listStatus(where) if f.getPath().getName().endswith(".json"))
    return [json.loads("".join(r["value"] for r in spark.read.text(n, wholetext=True).collect())) for n in names]


def commit(spark: SparkSession, folder: str, run: str, batch: int, parts: dict[str, Callable[[], DataFrame] | DataFrame]) -> bool:
    """Writes the parts of a batch and commits them together; False if the batch is committed already.

    Parts of a failed attempt stay where no manifest names them (``sweep`` deletes them).
    """
    files, path = _files(spark, folder)
    final = path(_manifest(folder, run, batch))
    if files.exists(final):
        return False
    attempt = uuid.uuid4().hex[:12]
    where = {name: f"{folder}/parts/{name}/{run}-{batch:010d}-{attempt}" for name in parts}
    for name, part in parts.items():
        (part() if callable(part) else part).write.parquet(where[name])
    waiting = path(f"{folder}/_manifests/{run}/.{batch:010d}-{attempt}")
    out = files.create(waiting, False)
    out.write(bytearray(json.dumps({"run": run, "batch": batch, "parts": where}).encode()))
    out.close()
    if files.exists(final) or not files.rename(waiting, final):  # another attempt was faster
        files.delete(waiting, False)
        return False
    return True


def read_part(spark: SparkSession, folder: str, run: str, name: str) -> DataFrame:
    """The rows of one part in all committed batches of a run."""
    where = [m["parts"][name] for m in committed(spark, folder, run) if name in m["parts"]]
    if not where:
        raise FileNotFoundError(f"nothing of {name} is committed for run {run}")
    return spark.read.parquet(*where)


def sweep(spark: SparkSession, folder: str) -> int:
    """Deletes the parts that no manifest names; only while nothing is being written.  Returns how many."""
    files, path = _files(spark, folder)
    if not files.exists(path(f"{folder}/parts")):
        return 0
    runs = path(f"{folder}/_manifests")
    named = {path(p).getName() for r in (files.listStatus(runs) if files.exists(runs) else []) for m in committed(spark, folder, r.getPath().getName()) for p in m["parts"].values()}
    gone = [f.getPath() for name in files.listStatus(path(f"{folder}/parts")) for f in files.listStatus(name.getPath()) if f.getPath().getName() not in named]
    for p in gone:
        files.delete(p, True)
    return len(gone)
