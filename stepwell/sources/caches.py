"""Activation caches as bucketed tables.

Every cache is bucketed and sorted by (input_set, layer, stream, sample_id) into the
same number of buckets, whoever wrote it, so comparing conditions with a teacher
joins bucket with bucket: no row of activations is shuffled, only the sums that the
metrics are made of.  A condition whose layers are aligned with a deeper or shallower
teacher is stored under the teacher's layer and keeps its own as ``source_layer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import similarity_by

KEYS = ("input_set", "layer", "stream", "sample_id")
BUCKETS = 16


def write_cache(vectors: DataFrame, table: str, folder: str, alignment: DataFrame | None = None, buckets: int = BUCKETS) -> str:
    """Stores (condition, input_set, layer, stream, sample_id, vec); layers that no alignment has are left out.

    alignment: (source_layer, target_layer), as many rows as the model has layers.
    """
    own = vectors.withColumn("source_layer", F.col("layer"))
    if alignment is not None:
        to = F.broadcast(alignment.select(F.col("source_layer").alias("own_layer"), "target_layer"))
        own = own.join(to, F.col("layer") == F.col("own_layer")).withColumn("layer", F.col("target_layer")).drop("own_layer", "target_layer")
    rows = own.select(*KEYS, *(c for c in ("condition",) if c in vectors.columns), "source_layer", "vec")
    rows.repartition(buckets, *KEYS).write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", folder).mode("errorifexists").saveAsTable(table)
    return table


def compare_cached(spark: SparkSession, students: str, teachers: str, p: int, q: int) -> DataFrame:
    """(condition, input_set, source_layer, target_layer, stream, cka, cosine_distance) of every condition; sets and layers that a side lacks are left out."""
    s = spark.table(students).select(*KEYS, "condition", "source_layer", F.col("vec").alias("x"))
    t = spark.table(teachers).select(*KEYS, F.col("vec").alias("y"))
    both = s.join(t.hint("merge"), list(KEYS)).withColumnRenamed("layer", "target_layer")
    return similarity_by(both, ["condition", "input_set", "source_layer", "target_layer", "stream"], p, q)
