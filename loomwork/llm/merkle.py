"""Merkle manifest of a table of documents: a root digest, and for every row the proof that it belongs to it.

H(x, ...) is the lowercase hex sha256 of its concatenated inputs. A leaf is H of the columns of a row, each
written as ``-`` if null, else as its UTF-8 byte count, ``:`` and the value. The leaves of a language ascend
by key; every 8 consecutive nodes become their H until one is left, the subroot. The subroots, ordered by
language (null first, then bytewise), become the root in the same way.

Cogrouped subtree exchange: the nodes of a tree are cut into superblocks of 8^4.

1. Up: superblocks reduce to one node each, and those nodes are the next table, until every tree is one
   node. A table is a 4096th of the one below.
2. Down: a superblock is cogrouped with its outer path, one row, in ``applyInPandas``. The function repeats
   the local reduction, joins the siblings inside the superblock with those outside, and hands each
   node its whole path; for leaves it also makes the proof digest and folds the path again.

No function holds more than one superblock, however many rows a language has. Numbers within a language
come from a range partitioning by (language, key, leaf), so no language is sorted in one task.

``verified`` compares the root with the one folded from a second leaf, that of a possibly changed text.

Null keys come first; equal keys are ordered by their leaves; rows that repeat are leaves of their own (their
proofs hold each other's digests). A null text, language or key is a value of its own (``-``), unlike an
empty one. Very long texts are hashed whole by the engine. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import materialize

FAN = 8
#: Levels that a superblock reduces by itself.
LEVELS = 4
#: About as many rows as one task orders.
ROWS_PER_TASK = 200_000

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digests left and right of the path at each level, from the leaf on.
_PATH = "array<struct<left: string, right: string>>"


def _written(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[_written(c) for c in columns]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, _A_TO_Z, _A_TO_Z.lower())


def _parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], whole: int, depth: int) -> list[list[str]]:
    """The levels of a superblock of a tree with ``whole`` nodes, from its nodes to its one top."""
    out = [nodes]
    while len(out) <= depth if whole > FAN**depth else len(out[-1]) > 1:
        last = out[-1]
        out.append([_parent(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return out


def _inside(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The siblings left and right of node ``at`` and its ancestors below the top."""
    path = []
    for level in levels[:-1]:
        run = at // FAN * FAN
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + FAN])))
        at //= FAN
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _parent([left, leaf, right])
    return leaf


def _reduced(nodes: DataFrame, depth: int) -> DataFrame:
    """One row per superblock: tree, place (its number in the tree) and digest."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        digests = rows.sort_values("place")["digest"].tolist()
        return pd.DataFrame({"tree": rows["tree"][:1], "place": rows["block"][:1], "digest": [_levels(digests, int(rows["size"].iloc[0]), depth)[-1][0]]})

    return nodes.groupBy("tree", "block").applyInPandas(top, "tree string, place long, digest string")


def _blocks(nodes: DataFrame, depth: int, label: str) -> DataFrame:
    """Nodes (tree, place, digest) with the size of their tree and their superblock, written once."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    block = F.floor(F.col("place") / FAN**depth).alias("block")
    return materialize(nodes.join(sizes, "tree").select(*nodes.columns, "size", block), label)


def _climb(leaves: DataFrame, depth: int) -> list[DataFrame]:
    """The tables of nodes from the given one to one node per tree; a tree of one node stays as it is."""
    tables = [leaves]
    while True:
        tops = _blocks(_reduced(tables[-1], depth), depth, "merkle-nodes")
        tables.append(tops)
        if not tops.where("size > 1").limit(1).count():
            return tables


def _descend(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """The paths of nodes from those of their superblocks: (tree, block, path, root), one row per node, ``block`` being its place."""

    def paths(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        levels = _levels(rows["digest"].tolist(), int(rows["size"].iloc[0]), depth)
        outside = [(p["left"], p["right"]) for p in above["path"].iloc[0]]
        found = [[{"left": a, "right": b} for a, b in [*_inside(levels, i), *outside]] for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "block": rows["place"], "path": found, "root": above["root"].iloc[0]})

    both = nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return both.applyInPandas(paths, f"tree string, block long, path {_PATH}, root string")


def _all_paths(tables: list[DataFrame], roots: DataFrame, depth: int) -> DataFrame:
    """Paths of the superblocks of the first table; ``roots`` has those of whole trees, which are one superblock in the last table but one."""
    outer = roots
    for nodes in reversed(tables[1:-1]):
        outer = materialize(_descend(nodes, outer, depth), "merkle-paths")
    return outer


def _numbered(rows: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """Rows with their ``place`` in their tree, from 0; ``rows`` are ordered by ranges, never by whole trees."""
    stored = materialize(rows, label)
    tasks = max(1, -(-stored.count() // ROWS_PER_TASK))
    ordered = stored.repartitionByRange(tasks, tree, *order).sortWithinPartitions(tree, *order)
    # The number holds the partition and the row in it, so it rises with the order.
    ordered = materialize(ordered.withColumn("turn", F.monotonically_increasing_id()), label)
    part = F.shiftright("turn", 33)
    heads = ordered.groupBy(tree, part.alias("part")).agg(F.min("turn").alias("head"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(tree, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("head")).alias("shift"))
    return ordered.withColumn("part", part).join(heads, [tree, "part"]).select(*rows.columns, (F.col("turn") + F.col("shift")).alias("place"))


def _prove(depth: int):
    """Cogrouped step on leaves: the proof digest and the folded root of each row of a superblock."""

    def step(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        levels = _levels(rows["digest"].tolist(), int(rows["size"].iloc[0]), depth)
        outside = [(p["left"], p["right"]) for p in above["path"].iloc[0]]
        tail = "".join(a + b for a, b in outside)
        proofs, folded = [], []
        for i, leaf in enumerate(rows["shown"].tolist()):
            inside = _inside(levels, i)
            proofs.append(_parent([*(a + b for a, b in inside), tail]))
            folded.append(fold(leaf, [*inside, *outside]))
        out = rows[["id", "digest"]].rename(columns={"digest": "leaf"})
        return out.assign(subroot=above["subroot"].iloc[0], root=above["root"].iloc[0], proof_sha256=proofs, folded_root=folded)

    return step


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", shown: Column | None = None, text: str = "text", depth: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified, one row per row of ``docs``.

    ``columns`` are those a leaf covers, in order. ``shown`` is the text whose leaf is folded against the
    proofs; by default it is the stored one, so every row is verified. A superblock reduces ``depth`` levels.
    """
    second = [F.col(c) if c != text or shown is None else shown for c in columns]
    # Names of trees sort as the groups do: null first, then bytewise.
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        leaf_digest(second).alias("shown"),
    )
    leaves = _blocks(_numbered(rows, "tree", ["doc_id", "digest", "shown"], "merkle-leaves"), depth, "merkle-leaves")
    trees = _climb(leaves, depth)
    subroots = trees[-1].select(F.col("tree").alias("name"), "digest")
    crown = subroots.select(F.lit("").alias("tree"), "name", "digest")
    crown = _blocks(_numbered(crown, "tree", ["name"], "merkle-crown"), depth, "merkle-crown")
    heights = _climb(crown, depth)
    no_path = F.array().cast(_PATH)
    top = heights[-1].select("tree", F.lit(0).cast("long").alias("block"), no_path.alias("path"), F.col("digest").alias("root"))
    paths = _descend(crown, _all_paths(heights, top, depth), depth)
    named = crown.select("place", "name", F.col("digest").alias("subroot"))
    roots = paths.join(named, F.col("block") == F.col("place")).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "root")
    roots = materialize(roots, "merkle-paths")
    outer = _all_paths(trees, roots, depth).join(named.select(F.col("name").alias("tree"), "subroot"), "tree")
    # Keys pass through pandas as strings, which keep nulls and whole numbers of any size.
    named_leaves = leaves.select("tree", "block", "place", "size", "digest", "shown", F.col("doc_id").cast("string").alias("id"))
    both = named_leaves.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    digests = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    proven = both.applyInPandas(_prove(depth), ", ".join(f"{c} string" for c in ["id", *digests]))
    kind = rows.schema["doc_id"].dataType
    return proven.select(F.col("id").cast(kind).alias(key), *digests, (F.col("folded_root") == F.col("root")).alias("verified"))


def checked(docs: DataFrame, depth: int = LEVELS) -> DataFrame:
    """The manifest of documents, where a third of the rows show a text in lower case instead of their own."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    shown = F.when(tampered, lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], shown=shown, depth=depth)
