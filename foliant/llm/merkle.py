"""A Merkle manifest of a table: a hash tree a group, folded by an associative sparse forest, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import Scratch

ARITY = 8
#: A block of leaves, ARITY to this power, is one task's group.
BLOCK_LEVELS = 3
#: So many nodes of 64 digits are merged to one forest that the driver holds and sends out; more are folded in blocks again.
MAX_BLOCKS = 1 << 16

Path = list[tuple[int, list[bytes]]]


def digest(parts: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Forest:
    """Unresolved nodes of many trees: by tree, parent's level and parent's index, the children present.

    A tree's number of leaves says how many children each parent has, so a run of siblings is known to be complete
    as soon as its last child comes, whichever fragment brings it. Merging is associative and commutative: the
    nodes of a complete run leave the fragment (and are noted in ``runs`` for proofs), their parent enters it.
    """

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.sizes: dict[int, int] = {}
        self.roots: dict[int, bytes] = {}
        self.runs: dict[tuple[int, int, int], list[bytes]] = {}

    def add(self, tree: int, n: int, level: int, index: int, node: bytes) -> Forest:
        self.sizes[tree] = n
        while True:
            width = -(-n // self.arity**level)
            if width == 1:
                self.roots[tree] = node
                return self
            parent, place = divmod(index, self.arity)
            run = self.open.setdefault((tree, level + 1, parent), {})
            run[place] = node
            if len(run) < min(self.arity, width - parent * self.arity):
                return self
            del self.open[tree, level + 1, parent]
            full = [run[k] for k in range(len(run))]
            self.runs[tree, level + 1, parent] = full
            level, index, node = level + 1, parent, digest(full)

    def merge(self, other: Forest) -> Forest:
        self.runs |= other.runs
        self.roots |= other.roots
        self.sizes |= other.sizes
        for (tree, level, parent), run in other.open.items():
            for place, node in run.items():
                self.add(tree, other.sizes[tree], level - 1, parent * self.arity + place, node)
        return self

    def path(self, tree: int, n: int, index: int) -> Path:
        """(own place, the run) at every level up to the root, of a leaf of a resolved tree."""
        out, level = [], 0
        while -(-n // self.arity**level) > 1:
            index, place = divmod(index, self.arity)
            level += 1
            out.append((place, self.runs[tree, level, index]))
        return out


def fold_up(node: bytes, path: Path) -> bytes:
    """The root that a node gives with the siblings of its path."""
    for place, run in path:
        node = digest([*run[:place], node, *run[place + 1 :]])
    return node


def siblings(path: Path) -> bytes:
    return b"".join(b"".join(run[:place] + run[place + 1 :]) for place, run in path)


class Block:
    """An aligned part of a tree's leaves with all levels above them that lie within it."""

    def __init__(self, leaves: list[bytes], n: int, levels: int, arity: int):
        self.arity, self.rows = arity, [leaves]
        while len(self.rows) <= levels and -(-n // arity ** (len(self.rows) - 1)) > 1:
            below = self.rows[-1]
            self.rows.append([digest(below[k : k + arity]) for k in range(0, len(below), arity)])

    @property
    def top(self) -> bytes:
        return self.rows[-1][0]

    def paths(self) -> Iterator[Path]:
        """Each leaf's path within the block. Runs are shared between leaves."""
        for k in range(len(self.rows[0])):
            path = []
            for row in self.rows[:-1]:
                k, place = divmod(k, self.arity)
                path.append((place, row[k * self.arity : (k + 1) * self.arity]))
            yield path


#: Of a node on the way to the root: its place among its siblings, and all of them.
PATH = "array<struct<place:int,run:array<string>>>"


def _to_path(value: list[dict]) -> Path:
    return [(x["place"], [r.encode() for r in x["run"]]) for x in value]


def _from_path(path: Path) -> list[dict]:
    return [{"place": place, "run": [r.decode() for r in run]} for place, run in path]


_PATH = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.list_(pa.string()))]))


class Folded:
    """Trees folded to their roots. ``rows``: tree, idx (from 0, gapless), n (the tree's leaves) and digest (32 bytes).

    Blocks of leaves are closed in tasks of their own. The block nodes of trees with more than one block are folded in
    the same way as long as there are more than MAX_BLOCKS of them; then partitions hold forests that ``treeReduce``
    merges. So the driver and each task get MAX_BLOCKS nodes at most, at any size.
    ``upper``: (tree, block, path above the block, root).
    """

    def __init__(self, rows: DataFrame, scratch: Scratch, name: str, *, arity: int = ARITY, levels: int = BLOCK_LEVELS):
        self.levels, self.arity, size = levels, arity, arity**levels
        self.rows = rows.withColumn("block", F.floor(F.col("idx") / size).cast("long"))

        def close(group: pa.Table) -> pa.Table:
            group = group.sort_by("idx")
            n = group.column("n")[0].as_py()
            leaves = [d.hex().encode() for d in group.column("digest").to_pylist()]
            first = group.slice(0, 1)
            return pa.table({"tree": first.column("tree"), "block": first.column("block"), "n": first.column("n"), "node": pa.array([Block(leaves, n, levels, arity).top.decode()])})

        closed = self.rows.select("tree", "block", "idx", "n", "digest").groupBy("tree", "block").applyInArrow(close, "tree long, block long, n long, node string")
        blocks = scratch.write(closed, f"{name}-blocks")
        alone = blocks.where(F.col("n") <= size).select("tree", "block", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
        many = blocks.where(F.col("n") > size).select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / size).cast("long").alias("n"), "node")
        if many.count() > MAX_BLOCKS:
            over = Folded(many.select("tree", "idx", "n", F.unhex("node").alias("digest")), scratch, f"{name}-over", arity=arity, levels=levels).paths()
        else:
            over = _climbed(many, arity)
        self.upper = scratch.write(alone.unionByName(over.withColumnRenamed("idx", "block")), f"{name}-upper")

    def roots(self) -> DataFrame:
        return self.upper.where("block = 0").select("tree", "root")

    def paths(self) -> DataFrame:
        """(tree, idx, path, root) of every leaf, the path from its own run up to the root."""
        levels, arity = self.levels, self.arity

        def run(rows: pa.Table, above: pa.Table) -> pa.Table:
            rows = rows.sort_by("idx")
            over, root = _to_path(above.column("path")[0].as_py()), above.column("root")[0].as_py()
            block = Block([d.hex().encode() for d in rows.column("digest").to_pylist()], rows.column("n")[0].as_py(), levels, arity)
            paths = [_from_path(p + over) for p in block.paths()]
            return pa.table({"tree": rows.column("tree"), "idx": rows.column("idx"), "path": pa.array(paths, _PATH), "root": pa.array([root] * rows.num_rows)})

        both = self.rows.select("tree", "block", "idx", "n", "digest").groupBy("tree", "block").cogroup(self.upper.groupBy("tree", "block"))
        return both.applyInArrow(run, f"tree long, idx long, path {PATH}, root string")


def _climbed(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, path, root) of at most MAX_BLOCKS leaves of trees, by one forest that all partitions' forests merge to."""

    def fragment(part: Iterator) -> Iterator[Forest]:
        own = Forest(arity)
        for tree, idx, n, node in part:
            own.add(tree, n, 0, idx, node.encode())
        yield own

    fragments = nodes.rdd.mapPartitions(fragment)
    forest = fragments.treeReduce(Forest.merge) if fragments.getNumPartitions() else Forest(arity)
    sent = nodes.sparkSession.sparkContext.broadcast(forest)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, roots = [], []
            for tree, idx, n in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                paths.append(_from_path(sent.value.path(tree, n, idx)))
                roots.append(sent.value.roots[tree].decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, _PATH), pa.array(roots, pa.string())], names=["tree", "idx", "path", "root"])

    return nodes.select("tree", "idx", "n").mapInArrow(climb, f"tree long, idx long, path {PATH}, root string")


def encoded(value: Column) -> Column:
    """'-' for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The 32 bytes of a row's leaf."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256))


def numbered(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Adds tree (the group's rank, null first), idx (the row's place in its group by key) and n (the group's rows).

    Rows are sorted once over range partitions; places follow from each partition's counts by group, so no group and no
    window over rows gathers in one task. ``rows``: key, group, digest, claimed, row (unique, so that rows alike in all else
    can be dealt to several partitions).
    """
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")]
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    laid = scratch.write(laid.select("key", "group", "digest", "claimed", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("ord")), "laid")
    here = scratch.write(laid.groupBy("part", "group").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("here")), "here")
    own = Window.partitionBy("group")
    here = here.withColumn("base", F.sum("here").over(own.orderBy("part")) - F.col("here")).withColumn("n", F.sum("here").over(own)).withColumn("begins", F.min("part").over(own) == F.col("part"))
    begun = here.where("begins").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    a_part = begun.groupBy("part").agg(F.count(F.lit(1)).alias("groups"))
    before = a_part.select("part", (F.sum("groups").over(Window.orderBy("part")) - F.col("groups")).alias("before"))  # a row a partition
    trees = begun.join(before, "part").select(F.col("group").alias("of"), (F.col("before") + F.col("nth") - 1).alias("tree"))
    spans = here.join(trees, F.col("group").eqNullSafe(F.col("of"))).select(F.col("part").alias("in_part"), "of", "first", "base", "n", "tree")
    placed = laid.join(spans, (F.col("part") == F.col("in_part")) & F.col("group").eqNullSafe(F.col("of")))
    placed = scratch.write(placed.select("tree", (F.col("base") + F.col("ord") - F.col("first")).alias("idx"), "n", "key", "digest", "claimed"), "placed")
    n_trees = trees.count()
    for name in ("laid", "here"):
        scratch.drop(name)
    return placed, n_trees


def manifest(docs: DataFrame, *, columns: list[str], key: str = "doc_id", group: str = "lang", now: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The leaf, its group's root, the root of all and a proof for each row; and what the root would be of the rows as they are now.

    A leaf is the SHA-256 of the ``columns``, each '-' or its length and value. In each ``group`` leaves ascend by ``key``;
    every eight neighbours (the last run may be shorter) become the hash of their digits, until one is left, the
    subroot; subroots in order of their groups (null first, bytewise) give the root in the same way. ``now`` replaces columns
    by what they hold today: their leaf is folded up with the siblings of the manifest (``folded``), which must give its root (``verified``).

    Returns key, leaf, subroot, root, proof (siblings of all levels, left to right, as one text), folded and verified.

    * Null values are told from empty ones; null keys come first; a null group is a group.
    * Rows of one key are ordered by their leaves; rows alike in all columns are leaves of their own.
    * A table of one row is its own root, with an empty proof; an empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    was = [F.col(c) for c in columns]
    claimed = leaf([(now or {}).get(c, F.col(c)) for c in columns]) if now else leaf(was)
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf(was).alias("digest"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = scratch.write(rows, "leaves")
    schema = f"key {kind}, leaf string, subroot string, root string, proof string, folded string, verified boolean"
    if not rows.take(1):
        scratch.drop()
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    placed, n_trees = numbered(rows, scratch)
    scratch.drop("leaves")
    trees = Folded(placed.select("tree", "idx", "n", "digest"), scratch, "groups", levels=levels)
    tops = trees.roots().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), F.unhex("root").alias("digest"))
    over = Folded(tops, scratch, "top", levels=levels).paths().select(F.col("idx").alias("tree"), F.col("path").alias("over"), F.col("root").alias("top"))
    above = scratch.write(trees.upper.join(over, "tree").select("tree", "block", F.concat("path", "over").alias("path"), F.col("root").alias("subroot"), "top"), "above")
    arity = trees.arity

    def prove(own: pa.Table, above: pa.Table) -> pa.Table:
        own = own.sort_by("idx")
        over, subroot, root = _to_path(above.column("path")[0].as_py()), above.column("subroot")[0].as_py(), above.column("top")[0].as_py()
        rest = siblings(over)
        leaves = [d.hex().encode() for d in own.column("digest").to_pylist()]
        block = Block(leaves, own.column("n")[0].as_py(), levels, arity)
        proofs, folded = [], []
        for path, claim in zip(block.paths(), own.column("claimed").to_pylist(), strict=True):
            proofs.append((siblings(path) + rest).decode())
            folded.append(fold_up(fold_up(claim.hex().encode(), path), over).decode())
        n = own.num_rows
        return pa.table({
            "key": own.column("key"), "leaf": pa.array([x.decode() for x in leaves]), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
            "proof": pa.array(proofs), "folded": pa.array(folded), "verified": pa.array([f == root for f in folded]),
        })

    rows = placed.withColumn("block", F.floor(F.col("idx") / arity**levels).cast("long"))
    out = rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(prove, schema)
    return out.withColumnRenamed("key", key)
