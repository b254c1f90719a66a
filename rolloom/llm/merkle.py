"""A Merkle manifest of a table: a tree per group, and one over the groups, by sibling-shift joins.

A node's place tells the places of its siblings: ``place XOR 1`` in a binary tree, otherwise the other
slots of its run, which are the node's slot shifted by 1, 2, ... So every level is joined with itself
once per shift, on computed places, and the rows in slot zero emit the parents. Each level is a
written table, a fraction of the one below. On the way back each child takes over the path of its
parent, so a row's proof is complete after one join per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.row_numbers import with_positions, with_row_number
from rolloom.session import materialize

ARITY = 3
WRITTEN_LEVELS = 3  # one level of paths in so many is written down, which bounds the plan
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_text(node: Column) -> Column:
    """Digests go into other digests as lower-case hex."""
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds what stands left and right of each node in its run; ``nodes`` has (tree, at, digest)."""
    slot = F.col("at") % arity
    out = nodes
    for shift in range(1, arity):
        there = nodes.select(
            F.col("tree").alias(f"_tree{shift}"),
            F.col("at").alias(f"_at{shift}"),
            F.col("digest").alias(f"_d{shift}"),
        )
        place = (
            F.col("at").bitwiseXOR(F.lit(1))
            if arity == 2
            else F.col("at") - slot + (slot + shift) % arity
        )
        out = out.join(
            there,
            (F.col("tree") == F.col(f"_tree{shift}")) & (place == F.col(f"_at{shift}")),
            "left",
        )

    def side(wraps: bool) -> Column:
        """Shifts that wrap around lead to the slots on the left, the others to those on the right."""
        parts = [
            F.when((slot + shift >= arity) == F.lit(wraps), F.col(f"_d{shift}"))
            for shift in range(1, arity)
        ]
        return F.concat(*[F.coalesce(part, F.lit(b"")) for part in parts])

    return out.select(*nodes.columns, side(True).alias("left"), side(False).alias("right"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    made = digest(F.concat(as_text(F.col("digest")), as_text(F.col("right"))))
    return level.filter(F.col("at") % arity == 0).select(
        "tree",
        F.expr(f"at div {arity}").alias("at"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        made.alias("digest"),
    )


def _height(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n = -(-n // arity)
        levels += 1
    return levels


class Trees:
    """The levels of many trees at once, written from the leaves up.

    ``nodes`` has (tree, at, n, digest): the tree's number, the leaf's place in it and the tree's
    number of leaves. Other columns stay with the leaves.
    """

    def __init__(self, nodes: DataFrame, arity: int, name: str):
        self._arity = arity
        self._name = name
        nodes = materialize(nodes, f"{name}-leaves")
        self._leaves = nodes
        self._levels: list[DataFrame] = []
        self._done = [nodes.filter("n = 1")]  # trees that end at each level
        largest = nodes.agg(F.max("n")).first()[0] or 0
        for level in range(_height(largest, arity)):
            table = _with_siblings(nodes.filter("n > 1"), arity)
            table = materialize(table, f"{name}-{level}")
            nodes = _parents(table, arity)
            self._levels.append(table)
            self._done.append(nodes.filter("n = 1"))

    def roots(self) -> DataFrame:
        """(tree, digest): one row per tree."""
        found = self._done[0].select("tree", "digest")
        for done in self._done[1:]:
            found = found.unionByName(done.select("tree", "digest"))
        return found

    def paths(self, crown: DataFrame) -> DataFrame:
        """The leaves with ``steps``, the siblings on the way up, and the other columns of ``crown``.

        ``crown`` (tree, steps, ...) says what follows above each root.
        """
        more = [c for c in crown.columns if c not in ("tree", "steps")]
        above = crown.withColumnRenamed("tree", "_tree")
        extra = [c for c in self._leaves.columns if c not in ("tree", "at", "n", "digest")]

        def ended(level: int, columns: Sequence[str]) -> DataFrame:
            done = self._done[level].join(above, F.col("tree") == F.col("_tree"))
            return done.select("tree", "at", *columns, "steps", *more)

        leaf_columns = ["digest", *extra]
        path = ended(len(self._levels), leaf_columns if not self._levels else [])
        for level in reversed(range(len(self._levels))):
            columns = leaf_columns if level == 0 else []
            up = path.withColumnsRenamed({"tree": "_tree", "at": "_up", "steps": "_steps"})
            step = F.array(F.struct("left", "right"))
            here = self._levels[level].join(
                up,
                (F.col("tree") == F.col("_tree"))
                & (F.expr(f"at div {self._arity}") == F.col("_up")),
            )
            here = here.withColumn("steps", F.concat(step, "_steps"))
            path = here.select("tree", "at", *columns, "steps", *more).unionByName(
                ended(level, columns)
            )
            if level % WRITTEN_LEVELS == 1:  # the lowest one has a row per run of leaves
                path = materialize(path, f"{self._name}-paths-{level}")
        return path


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    listed = F.transform(steps, lambda s: F.concat(as_text(s["left"]), as_text(s["right"])))
    return F.sha2(F.array_join(listed, ""), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root, as hex, that a leaf and its siblings lead to."""
    return F.aggregate(
        steps,
        as_text(start),
        lambda node, s: F.sha2(F.concat(as_text(s["left"]), node, as_text(s["right"])), 256),
    )


def merkle_manifest(
    df: DataFrame,
    columns: Sequence[str] = COLUMNS,
    key: str = "doc_id",
    group: str = "source",
    arity: int = ARITY,
    presented: Sequence[Column] | None = None,
) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, steps, folded_root, verified)`` per row.

    A leaf is the digest of ``columns``; the leaves of a group ascend by ``key``, and its tree's root
    is ``subroot``. The subroots, in the order of their groups, are the leaves of the tree that ends in
    ``root``. ``steps`` are the siblings from leaf to root; ``presented`` are the values of ``columns``
    that somebody claims the row holds (default: those it does), and ``folded_root`` is the root that
    they lead to with the true siblings.

    NULL keys come first in their group and the NULL group first of all; rows that repeat a key are
    ordered by their leaf. No rows give no rows. Numbers are written as Spark casts them to text.
    """
    values = [F.col(f"`{c}`") for c in columns]
    true_leaf = leaf(values)
    leaves = df.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{group}`").alias("group"),
        true_leaf.alias("digest"),
        (true_leaf if presented is None else leaf(presented)).alias("claimed"),
    )
    leaves, row = with_row_number(leaves, "leaves")  # texts are read once
    placed = with_positions(leaves, ["key", "digest", row], ["group"], "leaves-ordered")
    nodes = placed.select(
        F.col("_start").alias("tree"), F.col("_at").alias("at"), F.col("_n").alias("n"),
        "digest", "key", "claimed",
    )
    trees = Trees(nodes, arity, "merkle-rows")

    # trees are numbered by their first row, so they ascend as their groups do
    roots = trees.roots().withColumnRenamed("tree", "of")
    roots = with_positions(roots, ["of"], [], "merkle-roots")
    tops = roots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("_at").alias("at"), F.col("_n").alias("n"),
        "digest", "of",
    )
    top = Trees(tops, arity, "merkle-groups")
    root = top.roots()
    ends = root.select("tree", F.expr(f"CAST(array() AS {_STEPS})").alias("steps"),
                       F.col("digest").alias("root"))
    crown = top.paths(ends).select(
        F.col("of").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"
    )
    crown = materialize(crown, "merkle-crown")  # one row per group
    found = trees.paths(crown)
    root_text = as_text(F.col("root"))
    found = found.select(
        F.col("key").alias(key),
        as_text(F.col("digest")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        root_text.alias("root"),
        proof_digest(F.col("steps")).alias("proof_sha256"),
        "steps",
        fold(F.col("claimed"), F.col("steps")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_feeds(key: str = "doc_id", text: str = "text") -> list[Column]:
    """COLUMNS as presented by somebody who has lost the line feeds of every other text: of those
    whose key, in decimal, has an even CRC32. NULL keys and texts are left as they are."""
    hit = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(hit, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
    return [changed if c == text else F.col(c) for c in COLUMNS]
