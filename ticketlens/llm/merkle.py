"""Merkle manifest of a table, as a persistent path-copying tree.

The rows of a group, in the order of their key, are the leaves of a tree of
arity three: while several nodes remain, every three consecutive ones become
their digest.  The group roots, in group order, form one more tree of the same
kind, whose root stands for the table.

The tree is cut into aligned blocks of ``3 ** BLOCK_LEVELS`` nodes.  Inside a
block it is a persistent tree of immutable nodes: a changed leaf makes a new
version that copies the ancestors of the leaf up to the block's root and shares
every other node (:func:`replaced`).  The roots of the blocks are the leaves of
the blocks above, so a table of n rows has log(n) / log(243) layers of blocks,
each a shuffle of a 243rd of the layer below.  A version goes on above its
block through the digests beside the block's path, one more copied node a
level; those are joined to the block, one row a block, not to the versions.

Scale: a group of any size is numbered by a range sort and the row counts of
its sorted partitions, never by a window over the group.  A task holds one
block at a time (and its neighbours in an Arrow batch).  Versions never leave
the row of their block.

Defined results: equal keys are ordered by leaf and change, null keys come first, so do
rows with a null group (a group like others); repeated rows are leaves of their
own; a null changed leaf means that the leaf is as it was; an empty table has no
rows and no root.  Column names of the input do not matter: only the four
columns passed are used.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, stored
from .ordering import partition_of, sorted_with_id

ARITY = 3
#: Levels of a block: 243 nodes of about 150 bytes are one row.
BLOCK_LEVELS = 5
BLOCK = ARITY ** BLOCK_LEVELS

_PATH = T.ArrayType(T.StructType().add("before", "string").add("after", "string"))
_VERSION = T.StructType().add("proof_sha256", "string").add("folded_root", "string").add("copied", T.IntegerType())


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each ``-`` if null, else its UTF-8
    byte count, ``:`` and the value."""
    def coded(v: Column) -> Column:
        text = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[coded(v) for v in values]).cast("binary"), 256)


# --- the tree inside a block -----------------------------------------------------

#: A node is (digest, children); nodes are never changed.
Node = tuple[str, tuple]


def digest_of(digests) -> str:
    return hashlib.sha256("".join(digests).encode("ascii")).hexdigest()


def _parent(children: tuple) -> Node:
    return digest_of(c[0] for c in children), children


def grown(digests, levels: int) -> Node:
    """The tree over at most ``3 ** levels`` leaves, ``levels`` high."""
    nodes: list[Node] = [(d, ()) for d in digests]
    for _ in range(levels):
        nodes = [_parent(tuple(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)]
    return nodes[0]


def replaced(node: Node, at: int, levels: int, digest: str) -> Node:
    """The version of the tree with another leaf: ``levels`` ancestors are
    new, every other node is the same object as before."""
    if not levels:
        return digest, ()
    child, rest = divmod(at, ARITY ** (levels - 1))
    below = node[1]
    return _parent(below[:child] + (replaced(below[child], rest, levels - 1, digest),) + below[child + 1:])


def beside(node: Node, at: int, levels: int) -> list[tuple[str, str]]:
    """The digests left and right of the path to a leaf, from the leaf up."""
    found = []
    for level in range(levels - 1, -1, -1):
        child, at = divmod(at, ARITY ** level)
        below = node[1]
        found.append(("".join(c[0] for c in below[:child]), "".join(c[0] for c in below[child + 1:])))
        node = below[child]
    return found[::-1]


@F.pandas_udf(T.StringType())
def _block_root(digests: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([grown(d, n)[0] for d, n in zip(digests, levels)], dtype=object)


@F.pandas_udf(T.ArrayType(_PATH))
def _paths_in_block(digests: pd.Series, levels: pd.Series) -> pd.Series:
    out = []
    for d, n in zip(digests, levels):
        tree = grown(d, n)
        out.append([[{"before": a, "after": b} for a, b in beside(tree, i, n)] for i in range(len(d))])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(_VERSION))
def _versions(digests: pd.Series, changed: pd.Series, levels: pd.Series, above: pd.Series) -> pd.Series:
    """One version per leaf of a block, carried on to the root of the table."""
    out = []
    for leaves, others, n, path in zip(digests, changed, levels, above):
        tree = grown(leaves, n)
        upper = [(p["before"], p["after"]) for p in path]
        shared = "".join(a + b for a, b in upper).encode("ascii")
        rows = []
        for i, (leaf, other) in enumerate(zip(leaves, others)):
            version = replaced(tree, i, n, leaf if other is None else other)[0]
            for before, after in upper:
                version = digest_of((before, version, after))
            proof = hashlib.sha256("".join(a + b for a, b in beside(tree, i, n)).encode("ascii"))
            proof.update(shared)
            rows.append({"proof_sha256": proof.hexdigest(), "folded_root": version, "copied": n + len(upper)})
        out.append(rows)
    return pd.Series(out)


def _levels(n: Column) -> Column:
    """Levels of the blocks of a group that has n nodes on their lowest one."""
    out = F.lit(0)
    for level in range(1, BLOCK_LEVELS + 1):
        out = F.when(n > ARITY ** (level - 1), F.lit(level)).otherwise(out)
    return out


# --- the blocks over the table ------------------------------------------------------

def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(group, key, leaf, changed)`` with ``pos``, the number of a row in its
    group by key and leaf, and ``n``, the rows of the group."""
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", "changed"]
    ordered = sorted_with_id(rows, order, scratch, "merkle-sorted")
    part = partition_of()
    runs = ordered.groupBy("group", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # one row per group and sorted partition
    group = Window.partitionBy("group")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.stored(runs.select(
        F.col("group").alias("_group"), "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(group).alias("n")), "merkle-runs")
    return (ordered.withColumn("_part", part)
            .join(runs.withColumnRenamed("_part", "_of"), F.col("group").eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
            .withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_of", "_group", "_shift"))


def _blocks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``group, block, n, levels, items``: runs of BLOCK consecutive rows."""
    grouped = rows.groupBy("group", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("items"))
    return grouped.withColumn("levels", _levels(F.col("n")))


def _roots(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """The block roots as the nodes of the layer above."""
    return scratch.stored(blocks.select(
        "group", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
        _block_root("items.leaf", "levels").alias("leaf")), "merkle-roots")


def _paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``group, pos, path, top`` for the nodes ``group, pos, n, leaf`` of one
    layer: the digests beside the way up to the root of the group, and that."""
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return nodes.select("group", "pos", F.array().cast(_PATH).alias("path"), F.col("leaf").alias("top"))
    blocks = scratch.stored(_blocks(nodes, ["leaf"]), "merkle-blocks")
    above = _paths(_roots(blocks, scratch), scratch)
    above = above.select(F.col("group").alias("_group"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), "top")
    inside = blocks.select("group", "block", F.explode(F.arrays_zip(
        F.col("items.pos").alias("pos"), _paths_in_block("items.leaf", "levels").alias("path"))).alias("p"))
    return scratch.stored(
        inside.join(above, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_pos")))
        .select("group", F.col("p.pos").alias("pos"), F.concat("p.path", "_path").alias("path"), "top"), "merkle-paths")


def manifest(rows: DataFrame, group: str, key: str, leaf: str, changed: str) -> DataFrame:
    """One row per row: ``group, key, leaf, subroot, root`` of the table as it
    was, ``proof_sha256`` (digest of the digests beside the leaf's path, level
    by level from the leaf to the root, left to right), and of the version in
    which this leaf is ``changed``: ``folded_root`` and ``copied``, the number
    of its new nodes above the leaf."""
    scratch = Scratch(rows.sparkSession)
    named = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(leaf).alias("leaf"),
                        F.when(F.col(changed) != F.col(leaf), F.col(changed)).alias("changed"))
    # the sort reads its input twice: the digests, not the texts
    named = scratch.stored(named, "merkle-digests")
    fields = ["key", "leaf", "changed"]
    # the blocks are read again by the result
    blocks = stored(_blocks(_numbered(named, scratch), fields), "merkle-leaves")
    paths = _paths(_roots(blocks, scratch), scratch)

    tops = paths.where("pos = 0").select(F.lit(0).alias("group"), F.col("group").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("changed"))
    tops = _numbered(tops, scratch)
    over = _paths(tops.select("group", "pos", "n", "leaf"), scratch).select("pos", F.col("path").alias("_over"), F.col("top").alias("root"))
    over = tops.select(F.col("key").alias("_group"), "pos").join(over, "pos").drop("pos")
    above = stored(paths.join(over, F.col("group").eqNullSafe(F.col("_group"))).select(
        F.col("group").alias("_group"), F.col("pos").alias("_pos"), F.concat("path", "_over").alias("path"),
        F.col("top").alias("subroot"), "root"), "merkle-above")
    scratch.clear()

    made = blocks.join(above, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_pos")))
    made = made.select("group", "subroot", "root", F.explode(F.arrays_zip(
        F.col("items"), _versions("items.leaf", "items.changed", "levels", "path").alias("version"))).alias("r"))
    return made.select("group", F.col("r.items.key").alias("key"), F.col("r.items.leaf").alias("leaf"), "subroot", "root",
                       "r.version.proof_sha256", "r.version.folded_root", "r.version.copied")
