"""Merkle manifest of a dataset by sibling-shift self-joins.

Rows are leaves, numbered within their group in the order of their ids.  At every level
each node is equijoined with the node at its sibling's index (its own with the lowest bit
flipped), and the nodes in slot zero emit the parents.  The roots of the groups are the
leaves of one more tree of the same kind.  Proofs go down again: a child's proof is its
sibling followed by its parent's proof, one equijoin a level.

No step sees a whole group: leaves are numbered by sorted ranges and their counts, and all
joins are on (group, index), which is unique.  Digests travel as 32 bytes; they are hashed
as lowercase hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

#: Levels of proofs that one job adds before its result is written.
STRIDE = 6
PATH = "array<struct<digest:binary,left:boolean>>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def field(col: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; ``-`` for null."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(own: Column, sibling: Column, left: Column) -> Column:
    """Digest of a node's parent; a null sibling is a run of one."""
    other = F.coalesce(_text(sibling), F.lit(""))
    return F.unhex(F.when(left, digest_of(other, _text(own))).otherwise(digest_of(_text(own), other)))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx`` from 0 within ``grp`` in the given order, and ``size``, the group's count.

    Rows are sorted in ranges; a row's number is its place in its range plus the counts of
    its group in the ranges before.  Ranges cut large groups, so that only one row for each
    group and range is brought together.
    """
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged = settle(ranged, "ranges")
    counts = ranged.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "grp", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("grp")).alias("size")
    )
    out = ranged.join(settle(counts, "counts"), ["grp", "_part"])
    return out.withColumn("idx", F.col("_place") - F.col("_first") + F.col("_before")).drop("_part", "_place", "_first", "_before")


def _with_sibling(nodes: DataFrame) -> DataFrame:
    """Nodes of runs still to be joined, each with the digest at its sibling's index."""
    open_ = nodes.where("size > 1")
    shifted = open_.select("grp", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), F.col("digest").alias("sibling"))
    return open_.join(shifted, ["grp", "idx"], "left").withColumn("left", F.col("idx").bitwiseAND(F.lit(1)) == 1)


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from the leaves up, and the roots.

    ``leaves``: grp, idx, size, digest.  Levels hold the nodes that have a parent, with
    their ``sibling`` (null if they end an odd run) and whether it stands ``left``; roots
    hold grp, digest and ``height``.
    """
    levels, roots, nodes = [], [], leaves
    while True:
        roots.append(nodes.where("size = 1").select("grp", "digest", F.lit(len(levels)).alias("height")))
        if nodes.where("size > 1").isEmpty():
            break
        level = settle(_with_sibling(nodes), "level")
        levels.append(level)
        up = level.where("NOT left").select(
            "grp", F.shiftright("idx", 1).alias("idx"), F.shiftright(F.col("size") + 1, 1).alias("size"), _parent(F.col("digest"), F.col("sibling"), F.col("left")).alias("digest")
        )
        nodes = settle(up, "nodes")
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, settle(out, "roots")


def descend(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """Paths of all leaves: siblings from the leaf up, as ``path``.

    ``tops``: grp, height, path of the root and the ``carried`` columns, one row for each
    group.  Returns grp, idx, path and the carried columns.
    """
    above = lambda h: tops.where(F.col("height") == h).select("grp", F.lit(0).cast("bigint").alias("idx"), "path", *carried)
    paths = above(len(levels))
    for h in reversed(range(len(levels))):
        own = levels[h].select("grp", "idx", F.shiftright("idx", 1).alias("_up"), F.struct(F.col("sibling").alias("digest"), "left").alias("_step"))
        parents = paths.withColumnRenamed("idx", "_up")
        paths = own.join(parents, ["grp", "_up"]).select("grp", "idx", F.concat(F.array("_step"), "path").alias("path"), *carried).unionByName(above(h))
        if h and h % STRIDE == 0:
            paths = settle(paths, "paths")
    return paths


def _folded(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda acc, step: _parent(acc, step["digest"], step["left"]))


def manifest(
    docs: DataFrame, tamper: Column, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: str = "n_chars"
) -> DataFrame:
    """One row per row of docs: its id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the ``fields``, each with its length.  Groups are the values of
    ``group_col``, null first; within a group leaves ascend by ``id_col``.  Rows for which
    ``tamper`` (a condition on the columns of docs) holds are checked with 1 added to the
    column ``changed``; all others as they are.

    * Null fields are written ``-`` and differ from empty ones.  Adding 1 to null leaves
      null, so such a row verifies.  A null ``tamper`` counts as false.
    * Null ids come first; rows with equal ids are ordered by their leaves.  Repeated rows
      have equal leaves and each a place of its own, so their proofs may differ, and which
      copy gets which is open.
    * A group of one row has its leaf as subroot; one group alone has its subroot as root.
    * Texts of any length are hashed where they lie and not moved.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    grp = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    leaf = digest_of(*[field(F.col(c)) for c in fields])
    other = digest_of(*[field(F.col(c) + 1 if c == changed else F.col(c)) for c in fields])
    leaves = docs.select(grp.alias("grp"), F.col(id_col).alias("id"), F.unhex(leaf).alias("digest"), F.when(tamper, F.unhex(other)).alias("tampered"))
    leaves = settle(numbered(settle(leaves, "leaves"), ["id", "digest"]), "numbered")
    levels, roots = grow(leaves.select("grp", "idx", "size", "digest"))

    # the tree of the groups' roots is one group
    groups = numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest", "height"), ["member"])
    groups = settle(groups, "groups")
    upper, top = grow(groups.select("grp", "idx", "size", "digest"))
    none = F.array().cast(PATH)
    tops = descend(upper, top.select("grp", "height", none.alias("path"), F.col("digest").alias("root")), ["root"])
    tops = groups.join(tops.drop("grp"), "idx").select(F.col("member").alias("grp"), "height", "path", "root", F.col("digest").alias("subroot"))
    paths = descend(levels, settle(tops, "tops"), ["root", "subroot"])

    out = leaves.select("grp", "idx", "id", F.col("digest").alias("leaf"), F.coalesce("tampered", "digest").alias("claimed")).join(paths, ["grp", "idx"])
    siblings = F.array_join(F.transform(F.filter("path", lambda s: s["digest"].isNotNull()), lambda s: _text(s["digest"])), "")
    out = out.select("id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), _folded(F.col("claimed"), F.col("path")).alias("folded"))
    hexed = [_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return out.select(F.col("id").alias(id_col), *hexed, "proof_sha256", _text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
