"""Merkle manifest of a dataset: a root digest, and for each row the siblings that prove it.

The rows of a group (here: a language) are leaves in the order of their identifiers; pairs of neighbours are hashed level by level up to the group's root, and the groups' roots,
in the order of the groups, up to the manifest's. A last node without a neighbour is hashed alone.

Leaves get their places by a range sort and the counts of its partitions, and are cut into aligned blocks of ``2**levels`` places. A task walks the tree over a block
recursively in postorder: a subtree returns its digest, and while unwinding appends each half's digest to the leaves below the other half. The digests of the blocks
are the leaves of another walk of the same kind, spread over tasks likewise, until a group has one node left. Then the siblings found above go down again, a block at a time.
Whole texts are hashed where they are read; only digests are shuffled, and no task holds more than a block.

Defined cases: null columns count as ``-``; null identifiers come first; rows that share an identifier stand in the order of their digests; equal rows are leaves of their own; null groups come first, then
groups by their bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.storage import stage

#: How a sibling stands beside a node.
ALONE, LEFT, RIGHT = 0, 1, 2
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: bytes) -> bytes:
    """The hash of digests, taken as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def leaf_hash(columns: list[Column]) -> Column:
    """Hexadecimal digest of a row: each value with its length in bytes before it, or ``-``."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def walk(leaves: list[bytes], height: int, paths: list[list[tuple[int, bytes]]]) -> bytes:
    """Digest of the subtree of ``height`` over ``leaves``; the steps of each leaf are appended to its own list in ``paths``."""

    def subtree(level: int, start: int) -> bytes:
        if not level:
            return leaves[start]
        half = 1 << (level - 1)
        left = subtree(level - 1, start)
        middle, end = start + half, min(start + 2 * half, len(leaves))
        if middle >= len(leaves):
            for k in range(start, end):
                paths[k].append((ALONE, b""))
            return digest(left)
        right = subtree(level - 1, middle)
        for k in range(start, middle):
            paths[k].append((RIGHT, right))
        for k in range(middle, end):
            paths[k].append((LEFT, left))
        return digest(left, right)

    return subtree(height, 0)


def packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + sibling for side, sibling in path)


def unpacked(path: bytes) -> list[tuple[int, bytes]]:
    out, a = [], 0
    while a < len(path):
        size = 0 if path[a] == ALONE else 32
        out.append((path[a], path[a + 1 : a + 1 + size]))
        a += 1 + size
    return out


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in unpacked(path):
        leaf = digest(leaf) if side == ALONE else digest(sibling, leaf) if side == LEFT else digest(leaf, sibling)
    return leaf


def proof_hash(path: bytes) -> bytes:
    return digest(*[sibling for side, sibling in unpacked(path) if side != ALONE])


def placed(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """rows(grp, ...) with ``pos``, the place in the group's order from 0, and ``total``, the group's number of rows.

    A range sort that also sorts by a running number, so that equal rows can be split; its partitions are numbered where they stand."""
    sort = [F.asc_nulls_first(c) for c in ("grp", *order)]
    # equal in all of the order: any of them may come first, but a task that runs again must give the same number
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange(partitions, *sort, "spread") if partitions else spread.repartitionByRange(*sort, "spread")
    schema = rows.schema

    def number(batches):
        from pyspark import TaskContext

        part, last, at = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            own = []
            for grp in batch["grp"].to_pylist():
                at = at + 1 if (grp,) == last else 0
                last = (grp,)
                own.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(own, pa.int64())], names=[*batch.schema.names, "part", "at"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "part int", "at long"])
    numbered = stage(ranges.sortWithinPartitions(*sort, "spread").drop("spread").mapInArrow(number, kinds), "placed")
    counts = numbered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    joined = numbered.join(offsets, numbered["grp"].eqNullSafe(offsets["g"]) & (numbered["part"] == offsets["p"]))
    return joined.withColumn("pos", F.col("offset") + F.col("at")).select(*schema.names, "pos", "total")


def _height(total: int, levels: int) -> int:
    """Levels that a block of a group of ``total`` nodes climbs: all of them, or up to the group's root."""
    return min(levels, max(0, (total - 1).bit_length()))


def _bytes(column) -> list[bytes]:
    return column.to_pylist()


def climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(grp, pos, total, node) -> the blocks' digests, in the same columns: the nodes of the level above."""

    def run(key, table):
        table = table.sort_by("pos")
        total = table["total"][0].as_py()
        leaves = _bytes(table["node"])
        root = walk(leaves, _height(total, levels), [[] for _ in leaves])
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([-(-total // (1 << levels))], pa.int64()), pa.array([root], pa.binary())], names=["grp", "pos", "total", "node"])

    return nodes.select("grp", F.shiftright("pos", levels).alias("block"), "pos", "total", "node").groupBy("grp", "block").applyInArrow(run, "grp string, pos long, total long, node binary")


def descended(nodes: DataFrame, above: DataFrame, levels: int, finish, schema: str) -> DataFrame:
    """``finish(table, paths)`` of each block of ``nodes`` in order: paths[k] are the packed siblings of row k up to the top, with those that ``above``
    (grp, pos, path) has for the block as a node of its own."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key, left, right):
        if not left.num_rows:
            return pa.table({n: [] for n in names})
        table = left.sort_by("pos")
        leaves = _bytes(table["node"])
        paths: list[list] = [[] for _ in leaves]
        walk(leaves, _height(table["total"][0].as_py(), levels), paths)
        rest = right["path"][0].as_py()
        return finish(table, [packed(p) + rest for p in paths])

    blocks = nodes.withColumn("block", F.shiftright("pos", levels))
    return blocks.groupBy("grp", "block").cogroup(above.select("grp", F.col("pos").alias("block"), "path").groupBy("grp", "block")).applyInArrow(run, schema)


def tree(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes(grp, pos, total, node) -> the levels of blocks above them, lowest first, and the last one: a row for each group with its root."""
    upper = []
    most = nodes.agg(F.max("total")).first()[0] or 0
    level = nodes
    while True:
        level = stage(climbed(level, levels), "tree")
        upper.append(level)
        most = -(-most // (1 << levels))
        if most <= 1:
            return upper, level


def _paths(table: pa.Table, paths: list[bytes]) -> pa.Table:
    return pa.table([table["grp"], table["pos"], pa.array(paths, pa.binary())], names=["grp", "pos", "path"])


def _down(upper: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """(grp, pos, path) of the lowest level in ``upper``, where ``top`` has those of the highest."""
    for level in reversed(upper[:-1]):
        top = stage(descended(level, top, levels, _paths, "grp string, pos long, path binary"), "paths")
    return top


def manifest(docs: DataFrame, *, id: str = "doc_id", group: str = "lang", columns: list[str] | None = None, tampered: Column | None = None, levels: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests in hexadecimal.

    ``tampered``, a digest as :func:`leaf_hash` gives it or null, stands in for a row's leaf where the siblings are folded: what a reader of changed data would find."""
    columns = columns or LEAF_COLUMNS
    leaf = leaf_hash([F.col(c) for c in columns])
    changed = tampered if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(id).cast("long").alias("doc_id"), F.unhex(leaf).alias("node"), F.unhex(changed).alias("changed"))
    leaves = stage(placed(rows, ["doc_id", "node", "changed"]), "leaves")
    upper, subroots = tree(leaves, levels)

    # the groups' roots are the leaves of the manifest's own tree; its one group has no name
    roots = stage(placed(subroots.select(F.lit(None).cast("string").alias("grp"), F.encode(F.col("grp"), "UTF-8").alias("name"), "node"), ["name"]), "subroots")
    higher, root = tree(roots, levels)
    top = root.select("grp", "pos", F.lit(b"").alias("path"))
    named = descended(roots, _down(higher, top, levels), levels, lambda table, paths: pa.table([table["name"], pa.array(paths, pa.binary())], names=["name", "path"]), "name binary, path binary")
    paths = stage(named.select(F.decode("name", "UTF-8").alias("grp"), F.lit(0).cast("long").alias("pos"), "path"), "paths")
    below = _down(upper, paths, levels)
    whole = (root.first() or {"node": b""})["node"]

    def finish(table: pa.Table, paths: list[bytes]) -> pa.Table:
        own, changed = _bytes(table["node"]), _bytes(table["changed"])
        told = [folded(b or a, p) for a, b, p in zip(own, changed, paths, strict=True)]
        return pa.table(
            [table["grp"], table["doc_id"], pa.array([x.hex() for x in own], pa.string()), pa.array([proof_hash(p).hex() for p in paths], pa.string()), pa.array([x.hex() for x in told], pa.string()), pa.array([x == whole for x in told], pa.bool_())],
            names=["grp", "doc_id", "leaf", "proof_sha256", "folded_root", "verified"],
        )

    done = descended(leaves, below, levels, finish, "grp string, doc_id long, leaf string, proof_sha256 string, folded_root string, verified boolean")
    own = subroots.select(F.col("grp").alias("g"), F.lower(F.hex("node")).alias("subroot"))
    return done.join(own, done["grp"].eqNullSafe(own["g"])).select("doc_id", "leaf", "subroot", F.lit(whole.hex()).alias("root"), "proof_sha256", "folded_root", "verified")


def tampered_leaf(columns: list[str] | None = None, *, id: str = "doc_id", number: str = "n_chars", every: int = 7) -> Column:
    """The digest of a row with one added to ``number``, where ``every`` divides the crc32 of its identifier; null elsewhere."""
    columns = columns or LEAF_COLUMNS
    hit = F.crc32(F.col(id).cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf_hash([F.col(c) + 1 if c == number else F.col(c) for c in columns]))
