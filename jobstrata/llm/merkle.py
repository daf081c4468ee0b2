"""Merkle manifest of a dataset: a tree of digests for each group of rows, one over the groups, and each row's authentication path.

H is the lower-case hex SHA-256 of its inputs, concatenated (digests as hex text). While a group has several nodes, every ARITY
consecutive ones (the last run: fewer, even one) become their H; what remains is the group's subroot, and subroots, ordered by group
(null first, by bytes), become the root in the same way.

A tree is cut into aligned blocks of ARITY ** LEVELS nodes. Upwards, a treehash reads a block as a stream and holds fewer than ARITY nodes
a level. Downwards, Merkle traversal: in each block the nodes of the present run of each level are the authentication path, and one
treehash a level runs one run ahead, a leaf each step, so that the path moves on from leaf to leaf; beside the block's own leaf digests
(a bounded number) memory is logarithmic. Above the block its leaves share the path of the block's node, which comes first in the
block's stream and is appended. Blocks of one hot group are many tasks' work. No text is shuffled, digests alone are.

Nulls: a field that is null counts as `-`; a null group is a group. Repeated rows are leaves each, ties of the key are ordered by leaf.
An empty table gives an empty manifest and no root. Texts of any length are hashed whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import numbered, stored

ARITY = 3
#: 3 ** 7 = 2187 nodes a block.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_of(columns: dict[str, Column]) -> Column:
    """H of the fields: `-` for a null, else its UTF-8 bytes' number, a colon and itself."""
    said = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels between n nodes and the one that remains."""
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


class Treehash:
    """Nodes of one level from leaves that come one by one; fewer than ARITY nodes of each level below are held."""

    def __init__(self, level: int):
        self.level, self.waiting = level, [[] for _ in range(level + 1)]

    def add(self, leaf: str) -> None:
        self.waiting[0].append(leaf)
        level = 0
        while level < self.level and len(self.waiting[level]) == ARITY:
            self._raise(level)
            level += 1

    def _raise(self, level: int) -> None:
        self.waiting[level + 1].append(joined_hash(self.waiting[level]))
        self.waiting[level] = []

    def end(self) -> list[str]:
        """The nodes of the level, the last of which may have fewer leaves."""
        for level in range(self.level):
            if self.waiting[level]:
                self._raise(level)
        return self.waiting[self.level]


def traversal(leaves: list[str], levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf of a block in order: what stands left of its ancestor in the run of each level, and what stands right, as hex text."""
    n, span = len(leaves), [ARITY ** (h + 1) for h in range(levels)]
    runs, ahead = [], []
    for h in range(levels):
        first = Treehash(h)
        for leaf in leaves[: span[h]]:
            first.add(leaf)
        runs.append(first.end())
        ahead.append(Treehash(h))
    for i in range(n):
        lefts, rights = [], []
        for h in range(levels):
            at = i * ARITY // span[h] % ARITY
            lefts.append("".join(runs[h][:at]))
            rights.append("".join(runs[h][at + 1 :]))
        yield lefts, rights
        for h in range(levels):
            if i + span[h] < n:
                ahead[h].add(leaves[i + span[h]])
            if (i + 1) % span[h] == 0:  # the run ends: the one that was hashed meanwhile takes its place
                runs[h], ahead[h] = ahead[h].end(), Treehash(h)


# --- tables ---

NODES = "grp string, position long, n long, hash string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            yield from batch.slice(at, 2000).to_pylist()


def climbed(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes `levels` above (fewer, where one remains before), from those of groups with several: a row a block."""
    size = ARITY**levels

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (grp, block), own in groupby(_rows(batches), key=lambda r: (r["grp"], r["block"])):
            tree = None
            for r in own:
                tree = tree or Treehash(min(levels, depth(r["n"])))
                n = r["n"]
                tree.add(r["hash"])
            out.append((grp, block, max(1, -(-n // size)), tree.end()[0]))
            if len(out) >= 4096:
                yield _nodes(out)
                out = []
        if out:
            yield _nodes(out)

    several = nodes.where("n > 1").select("grp", F.expr(f"position div {size}").alias("block"), "position", "n", "hash")
    return several.repartition("grp", "block").sortWithinPartitions("grp", "block", "position").mapInArrow(climb, NODES)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["grp", "position", "n", "hash"])


@dataclass
class Tree:
    """The levels of the trees of all groups: nodes by group and position, the lowest first, LEVELS apart; subroots as a table."""

    levels: list[DataFrame]
    roots: DataFrame


def grown(nodes: DataFrame, levels: int = LEVELS) -> Tree:
    """The trees over nodes (grp, position, n of the group, hash)."""
    tables = [nodes]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tables.append(stored(climbed(tables[-1], levels), "nodes"))
    roots = [t.where("n = 1").select("grp", "hash", F.lit(k).alias("level")) for k, t in enumerate(tables)]
    every = roots[0]
    for t in roots[1:]:
        every = every.unionByName(t)
    return Tree(tables, every)


def traversed(nodes: DataFrame, above: DataFrame, item: list[str], levels: int = LEVELS) -> DataFrame:
    """The nodes with the columns of `item` and their whole authentication paths: lefts and rights, a text for each level.

    above: grp, block, lefts, rights, root of the node that a block of nodes becomes; it comes first in the block's stream.
    """
    size = ARITY**levels
    kinds = dict(nodes.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in ("grp", "position", "hash", *item)) + ", lefts array<string>, rights array<string>, subroot string"
    arrow = {f.name: to_arrow_type(f.dataType) for f in nodes.select(*item).schema}
    names = ["grp", "position", "hash", *item, "lefts", "rights", "subroot"]

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, own in groupby(_rows(batches), key=lambda r: (r["grp"], r["block"])):
            head = next(own)
            some = list(own)  # a block's own leaves: at most `size`
            if not some:
                continue
            up_left, up_right, root = head["lefts"], head["rights"], head["subroot"]
            for r, (lefts, rights) in zip(some, traversal([r["hash"] for r in some], min(levels, depth(some[0]["n"]))), strict=True):
                out.append((r["grp"], r["position"], r["hash"], *[r[c] for c in item], lefts + up_left, rights + up_right, root))
            if len(out) >= 1024:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), *[arrow[c] for c in item], pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    below = nodes.select("grp", F.expr(f"position div {size}").alias("block"), "position", "n", "hash", *item, F.lit(1).alias("kind"))
    heads = above.select("grp", "block", "lefts", "rights", "subroot", F.lit(0).alias("kind"))
    stream = below.unionByName(heads, allowMissingColumns=True)
    return stream.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "position").mapInArrow(traverse, fields)


def paths(tree: Tree, tops: DataFrame, item: list[str], levels: int = LEVELS) -> DataFrame:
    """The leaves of the trees with their paths, given those of the roots (grp, lefts, rights, subroot): level by level downwards."""
    ends = tree.roots.select(F.col("grp").alias("__g"), "level")
    tops = tops.join(ends, F.col("grp").eqNullSafe(F.col("__g"))).drop("__g")  # a row for each group
    found = None
    for k in range(len(tree.levels) - 1, -1, -1):
        above = tops.where(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("block"), "lefts", "rights", "subroot")
        if found is not None:
            above = above.unionByName(found.select("grp", F.col("position").alias("block"), "lefts", "rights", "subroot"))
        found = traversed(tree.levels[k], above, item if k == 0 else [], levels)
        if k:
            found = stored(found, "paths")
    return found


def leaves(docs: DataFrame, tampered: Column | None = None, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """grp, key, leaf, and other: the leaf of a row as it was found later (`tampered`: its text then), null where it is the same."""
    own = {c: F.col(c) for c in fields}
    other = F.lit(None).cast("string") if tampered is None else leaf_of(own | {"text": tampered})
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(key), leaf_of(own).alias("leaf"), other.alias("other"))
    return rows.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other")))


def manifest(docs: DataFrame, tampered: Column | None = None, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """The rows of the manifest and the root: key, leaf, other, subroot, and the authentication path as lefts and rights."""
    placed = numbered(leaves(docs, tampered, group, key, fields), ["grp"], [key, "leaf", "other"], "leaves")
    nodes = placed.select("grp", "position", F.col("n_group").alias("n"), F.col("leaf").alias("hash"), key, "other")
    tree = grown(nodes, levels)
    subroots = tree.roots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "hash")
    placed = numbered(subroots, ["all"], ["name"], "subroots")
    top = grown(placed.select(F.col("all").alias("grp"), "position", F.col("n_group").alias("n"), "hash", "name"), levels)
    first = top.roots.first()
    root = first["hash"] if first else None
    none = F.array().cast("array<string>")
    start = top.roots.select("grp", none.alias("lefts"), none.alias("rights"), F.col("hash").alias("subroot"))
    tops = paths(top, start, ["name"], levels).select(F.col("name").alias("grp"), "lefts", "rights", F.col("hash").alias("subroot"))
    found = paths(tree, stored(tops, "tops"), [key, "other"], levels)
    return found.select(key, F.col("hash").alias("leaf"), "other", "subroot", "lefts", "rights"), root


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]).cast("binary"), 256))


def verified(rows: DataFrame, root: str | None) -> DataFrame:
    """The manifest's rows with folded_root, from what was found (other, else the leaf), and whether it is the root."""
    rows = rows.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("lefts"), F.col("rights")))
    return rows.withColumns({"root": F.lit(root).cast("string"), "verified": F.col("folded_root") == F.lit(root).cast("string")})


def digest(rows: DataFrame, root: str | None, key: str = "doc_id") -> DataFrame:
    """What the query returns: the path's siblings as one digest."""
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return verified(rows, root).select(key, "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
