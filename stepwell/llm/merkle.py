"""A Merkle manifest of a dataset, with a proof for every row, by parent preimages.

A row's leaf is the SHA-256 of its fields, each with its length.  The leaves of a
source ascend by id; runs of FAN consecutive nodes become their parent's digest
until one is left, and the sources' last nodes make a tree of their own in the
same way.  Digests are lower-case hex and are concatenated as text.

How it is computed:

1. One pass over the texts makes the leaves (and the leaf of the tampered text).
   Rows are sorted over the cluster by source and id, so a source of any size is
   spread over many tasks; a row's place in its source follows from sums over
   (partition, source), of which there are few.
2. A level stores one row for each parent: its preimage, the concatenated digests
   of its children.  Levels shrink by FAN, and their number is the logarithm of
   the largest source's rows.
3. From the top down a parent's row is joined with its parent's, so each comes to
   hold its path: for each ancestor what stands before and after its own
   64-character slot.  The upper paths are held once for FAN children, not for
   each leaf.
4. A leaf joins its parent's row and excises its own slot: before and after are
   its siblings, so the concatenated path is its proof.  Splicing a digest into
   the slot and hashing, level by level, folds it to a root.

Leaves and parents meet by (source, parent), so no key has more than FAN rows.

Defined cases: a null field is ``-``; an empty text is ``0:``; a null source is a
source of its own and comes first, null ids come first in their source; equal
rows are leaves of their own, next to each other; a very long text is hashed
whole; an empty table has no rows; other columns are not part of a leaf, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import stage

FAN = 16
#: A digest's characters.
SLOT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def lower_cased(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def placed(spark: SparkSession, rows: DataFrame, by: list[str], tag: str) -> DataFrame:
    """``rows`` sorted by ``by`` over all partitions and staged, with ``part`` and ``at``, the place in its partition.

    A running number settles ties, so that many equal rows do not meet in one task.
    """
    numbered = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [*by, "tie"]
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    part = F.shiftright("pos", 33)
    return stage(spark, ordered.select(*rows.columns, part.alias("part"), (F.col("pos") - F.shiftleft(part, 33)).alias("at")), tag)


def numbered_sources(spark: SparkSession, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with g, idx and n: their source's number, their place and how many its source has; sources (g, source, n))."""
    runs = leaves.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    sources = placed(spark, runs.groupBy("source").agg(F.sum("c").alias("n")), ["source"], "sources")
    sizes = sources.groupBy("part").agg(F.count("*").alias("c"))
    start = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", start.alias("start"))  # a row for each partition
    sources = sources.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).alias("g"), "source", "n")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that a source is in
    offsets = runs.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    offsets = stage(spark, offsets.alias("r").join(sources.alias("s"), same).select("r.part", "r.source", "r.first", "r.before", "s.g", "s.n"), "offsets")
    same = (F.col("l.part") == F.col("o.part")) & F.col("l.source").eqNullSafe(F.col("o.source"))
    kept = [f"l.{c}" for c in leaves.columns if c not in ("part", "at", "source")]
    return leaves.alias("l").join(offsets.alias("o"), same).select(*kept, "o.g", (F.col("l.at") - F.col("o.first") + F.col("o.before")).alias("idx"), "o.n"), sources


def levels(spark: SparkSession, nodes: DataFrame, most: int, tag: str) -> list[DataFrame]:
    """Level by level, (g, idx, n, digest, preimage) of the parents of nodes (g, idx, n, digest); ``most`` is the largest n."""
    out = []
    while most > 1:
        parent = F.floor(F.col("idx") / FAN).cast("long")
        run = nodes.where("n > 1").groupBy("g", parent.alias("idx")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        joined = run.select("g", "idx", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.concat_ws("", F.col("run.digest")).alias("preimage"))
        nodes = stage(spark, joined.withColumn("digest", F.sha2("preimage", 256)), f"{tag}-level")
        out.append(nodes)
        most = math.ceil(most / FAN)
    return out


def split_at(preimage: Column, slot: Column) -> Column:
    """What stands before and after a slot of a preimage."""
    slot = slot.cast("int")
    return F.struct(F.substring(preimage, F.lit(1), slot * SLOT).alias("before"), F.substring(preimage, (slot + 1) * SLOT + 1, F.lit(FAN * SLOT)).alias("after"))


def paths(spark: SparkSession, above: list[DataFrame], tops: DataFrame, tag: str) -> DataFrame:
    """(g, idx, preimage, path, subroot, root) of the lowest parents, and of sources of one leaf with a null preimage.

    tops: (g, n, path, subroot, root), the last node of each tree of ``above`` and its path from there on.
    """
    upper = None
    for level in reversed(above):
        own = level.where("n = 1").join(tops.select("g", "path", "subroot", "root"), "g").select("g", "idx", "preimage", "path", "subroot", "root")
        if upper is not None:
            below = level.where("n > 1").withColumn("up", F.floor(F.col("idx") / FAN).cast("long")).alias("c")
            up = (F.col("c.g") == F.col("p.g")) & (F.col("c.up") == F.col("p.idx"))
            entry = split_at(F.col("p.preimage"), F.col("c.idx") % FAN)
            own = own.unionByName(below.join(upper.alias("p"), up).select("c.g", "c.idx", "c.preimage", F.concat(F.array(entry), F.col("p.path")).alias("path"), "p.subroot", "p.root"))
        upper = stage(spark, own, f"{tag}-paths")
    alone = tops.where("n = 1").select("g", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string").alias("preimage"), "path", "subroot", "root")
    return alone if upper is None else upper.unionByName(alone)


def with_paths(nodes: DataFrame, lowest: DataFrame) -> DataFrame:
    """Nodes (g, idx, n, ...) joined with their ancestors' preimages: ``path`` from their own run to the root, ``subroot`` and ``root``."""
    own = nodes.withColumn("up", F.when(F.col("n") > 1, F.floor(F.col("idx") / FAN)).otherwise(0).cast("long")).alias("c")
    entry = F.when(F.col("p.preimage").isNotNull(), F.array(split_at(F.col("p.preimage"), F.col("c.idx") % FAN))).otherwise(F.array().cast(_PATH))
    up = (F.col("c.g") == F.col("p.g")) & (F.col("c.up") == F.col("p.idx"))
    return own.join(lowest.alias("p"), up).select(*(f"c.{c}" for c in nodes.columns), F.concat(entry, F.col("p.path")).alias("path"), "p.subroot", "p.root")


def proof_of(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest has by a path: spliced into each slot in turn."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]), 256))


def leaves_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and changed (the leaf of the tampered text, null where the text is not tampered with), in order."""
    own = [F.col(c) for c in FIELDS]
    changed = F.when(tampered(F.col("doc_id")), leaf_of(*own[:-1], lower_cased(F.col("text"))))
    rows = docs.select("doc_id", "source", leaf_of(*own).alias("leaf"), changed.alias("changed"))
    return placed(spark, rows, ["source", "doc_id"], "leaves")


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the path with its proof, and what the tampered leaf folds to."""
    rows, sources = numbered_sources(spark, leaves_of(spark, docs))
    rows = stage(spark, rows.withColumn("digest", F.col("leaf")), "numbered-leaves")
    most, n_sources = sources.agg(F.max("n"), F.count("*")).first()
    above = levels(spark, rows.select("g", "idx", "n", "digest"), most or 0, "leaf")
    subroots = rows.where("n = 1").select("g", "digest")
    for level in above:
        subroots = subroots.unionByName(level.where("n = 1").select("g", "digest"))
    subroots = stage(spark, subroots.join(sources.select("g", F.col("n").alias("leaves")), "g"), "subroots")
    nodes = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_sources).cast("long").alias("n"), "digest", "leaves")
    tree = levels(spark, nodes.select("g", "idx", "n", "digest"), n_sources, "source")
    root = (tree[-1] if tree else nodes).where("n = 1").select("g", F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    whole = root.select("g", F.lit(n_sources).cast("long").alias("n"), F.array().cast(_PATH).alias("path"), "subroot", "root")
    found = with_paths(nodes, paths(spark, tree, whole, "source"))
    tops = stage(spark, found.select(F.col("idx").alias("g"), F.col("leaves").alias("n"), "path", F.col("digest").alias("subroot"), "root"), "source-paths")
    out = with_paths(rows, paths(spark, above, tops, "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", "path", proof_of(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of a manifest without the paths, and whether the folded root is the root."""
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
