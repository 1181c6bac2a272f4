"""Exact dedup by Patricia-trie owners.

Two tries in sequence. Each input partition first inserts its own normalised texts into a compressed radix trie, so that
a text reaches the network once per partition however many copies there are. Those local owners are then dealt by length
and content hash, and each partition inserts them into a trie whose terminal nodes hold the smallest identifier, the
number of rows and the local owners. When a trie passes ``memory_bytes`` its largest subtree is spilled, wherever it hangs (texts may all
begin alike): its entries, and later ones under the same prefix, go to a table in the shared folder, and a further round deals them anew.
What a partition holds beside its trie (rows waiting for their owner, owners of one text) counts against the same budget.

Only (row, owner) numbers are joined back, never texts, and a group that holds a third of all rows is spread over as many
local owners as there are input partitions.

Defined cases: null text counts as empty; null ``doc_id`` sorts after every other; of rows of a group that share the smallest
``doc_id`` one row stays (``keep_first_copies``: the one with the smallest raw text, then the smallest other columns); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.storage import discard, stage

SPACE_RUN = r"[\x20\x09-\x0D]+"
LAST = 1 << 63  # sorts after every identifier


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


class Node:
    __slots__ = ("kids", "entry", "spilled")

    def __init__(self) -> None:
        self.kids: dict[int, list] = {}
        self.entry = None
        self.spilled = False


#: Bytes counted for a node, for a row held, for an owner listed at a text.
NODE_BYTES, ROW_BYTES, OWNER_BYTES = 200, 250, 120


class PatriciaTrie:
    """Compressed radix trie over whole byte strings; each edge holds a label of one byte or more."""

    def __init__(self) -> None:
        self.root = Node()
        self.bytes = 0

    def terminal(self, key: bytes) -> Node | None:
        """The node at which ``key`` ends, made if it isn't there; None if the key lies in a subtree that was spilled."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            edge = node.kids.get(key[at])
            if edge is None:
                leaf = Node()
                node.kids[key[at]] = [key[at:], leaf]
                self.bytes += end - at + NODE_BYTES
                return leaf
            label, child = edge
            if child.spilled:
                return None
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), end - at)  # the shared part is at least 1 and under len(label)
            while low < high:
                middle = (low + high + 1) // 2
                if label[:middle] == key[at : at + middle]:
                    low = middle
                else:
                    high = middle - 1
            fork = Node()
            fork.kids[label[low]] = [label[low:], child]
            edge[0], edge[1] = label[:low], fork
            self.bytes += NODE_BYTES
            node, at = fork, at + low
        return node

    def entries(self, prefix: bytes = b"", node: Node | None = None) -> Iterator[tuple[bytes, object]]:
        stack = [(prefix, node or self.root)]
        while stack:
            path, node = stack.pop()
            if node.entry is not None:
                yield path, node.entry
            stack += [(path + label, child) for label, child in node.kids.values()]

    def _sizes(self) -> dict[int, int]:
        """Bytes of the subtree below each node, by the node's id(); spilled ones count nothing."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [child for _, child in node.kids.values()]
        sizes: dict[int, int] = {}
        for node in reversed(order):
            sizes[id(node)] = NODE_BYTES + sum(len(label) + sizes[id(child)] for label, child in node.kids.values() if not child.spilled)
        return sizes

    def spill_largest(self) -> list[tuple[bytes, object]] | None:
        """Cut a large subtree and return its entries; keys with its prefix then end nowhere. None where one text is all there is.

        The way down follows the largest subtree as long as it holds over half of all and branches; so texts that share a long prefix are
        parted below it, and something always stays, so that each round settles part of what it was given."""
        sizes = self._sizes()
        half = sizes[id(self.root)] // 2
        node, path = self.root, b""
        while True:
            live = [(len(label) + sizes[id(child)], first) for first, (label, child) in node.kids.items() if not child.spilled]
            if not live:
                return None
            size, first = max(live)
            label, child = node.kids[first]
            alone = len(live) == 1 and node.entry is None
            inner = any(not kid.spilled for _, kid in child.kids.values())
            if inner and (alone or size > half):
                node, path = child, path + label
                continue
            if alone:
                return None
            out = list(self.entries(path + label, child))
            stub = Node()
            stub.spilled = True
            node.kids[first] = [label[:1], stub]
            self.bytes = max(0, self.bytes - size)
            return out


LOCAL = "owner long, id long, first boolean, rows long, least long, norm string, sha string"


def _local_owners(memory_bytes: int):
    """Rows of one input partition -> rows with their local owner; an owner's first row carries the text and its counts."""

    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 33, 0
        trie, held, owners = PatriciaTrie(), [], []

        def flush():
            best = {o[1] for o in owners}
            columns = {n: [] for n in ("owner", "id", "first", "rows", "least", "norm", "sha")}
            size = 0
            for k, (owner, doc, sha) in enumerate(held):
                top = k in best
                o = owners[owner - owners[0][3]] if top else None
                for n, v in zip(columns, (owner, doc, top, o[2] if top else None, doc if top else None, o[4] if top else None, sha), strict=True):
                    columns[n].append(v)
                size += len(o[4]) if top else 16
                if size > 8 << 20:
                    yield _batch(columns)
                    columns, size = {n: [] for n in columns}, 0
            if columns["owner"]:
                yield _batch(columns)

        for batch in batches:
            for doc, norm, sha in zip(batch["id"].to_pylist(), batch["norm"].to_pylist(), batch["sha"].to_pylist(), strict=True):
                node = trie.terminal(norm.encode())
                rank = LAST if doc is None else doc
                if node.entry is None:
                    node.entry = [rank, len(held), 1, base + made, norm]
                    owners.append(node.entry)
                    made += 1
                else:
                    node.entry[2] += 1
                    if rank < node.entry[0]:
                        node.entry[0], node.entry[1] = rank, len(held)
                held.append((node.entry[3], doc, sha))
                if trie.bytes + ROW_BYTES * len(held) > memory_bytes:
                    yield from flush()
                    trie, held, owners = PatriciaTrie(), [], []
        if held:
            yield from flush()

    return run


_LOCAL_ARROW = pa.schema([("owner", pa.int64()), ("id", pa.int64()), ("first", pa.bool_()), ("rows", pa.int64()), ("least", pa.int64()), ("norm", pa.string()), ("sha", pa.string())])


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=_LOCAL_ARROW)


OWNED = "owner long, keep_owner long, keep_id long, size long, least long, rows long, norm string"
_OWNED_ARROW = pa.schema([("owner", pa.int64()), ("keep_owner", pa.int64()), ("keep_id", pa.int64()), ("size", pa.int64()), ("least", pa.int64()), ("rows", pa.int64()), ("norm", pa.string())])


def _global_owners(memory_bytes: int):
    """Local owners of one length-and-hash partition -> their final owner, or (norm not null) the entries that were spilled."""

    def run(batches):
        trie, splits = PatriciaTrie(), True

        def packed(rows):
            out, size = [], 0
            for row in rows:
                out.append(row)
                size += 64 + len(row[6] or "")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OWNED_ARROW, strict=True)], schema=_OWNED_ARROW)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OWNED_ARROW, strict=True)], schema=_OWNED_ARROW)

        for batch in batches:
            later = []
            for owner, least, rows, norm in zip(*(batch[n].to_pylist() for n in ("owner", "least", "rows", "norm")), strict=True):
                node, rank = trie.terminal(norm.encode()), LAST if least is None else least
                if node is None:
                    later.append((owner, None, None, None, least, rows, norm))
                    continue
                if node.entry is None:
                    node.entry = [(rank, owner), least, 0, []]
                elif (rank, owner) < node.entry[0]:
                    node.entry[0], node.entry[1] = (rank, owner), least
                node.entry[2] += rows
                node.entry[3].append((owner, least, rows))
                trie.bytes += OWNER_BYTES
                while splits and trie.bytes > memory_bytes:
                    cut = trie.spill_largest()
                    splits = cut is not None  # one text alone can't be parted
                    later += [(o, None, None, None, low, n, path.decode()) for path, entry in cut or [] for o, low, n in entry[3]]
                    trie.bytes -= min(trie.bytes, OWNER_BYTES * sum(len(entry[3]) for _, entry in cut or []))
                    yield from packed(later)
                    later = []
                splits = True
            yield from packed(later)
        yield from packed((owner, entry[0][1], entry[1], entry[2], None, None, None) for _, entry in trie.entries() for owner, _, _ in entry[3])

    return run


def exact_groups(docs: DataFrame, *, text: str = "text", id: str = "doc_id", memory_bytes: int = 256 << 20) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, text, id, memory_bytes)[0]


def _groups(docs: DataFrame, text: str, id: str, memory_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The groups, and the staged tables they are read from."""
    source = docs.select(F.col(id).cast("long").alias("id"), normalised(F.col(text)).alias("norm"))
    local = stage(source.withColumn("sha", F.sha2("norm", 256)).mapInArrow(_local_owners(memory_bytes), LOCAL), "exact-local", "zstd")
    todo, owned, round_no, tables = local.filter("first").select("owner", "least", "rows", "norm"), None, 0, [local]
    while True:
        dealt = todo.repartition(F.octet_length("norm"), F.xxhash64("norm", F.lit(round_no)))
        got = stage(dealt.mapInArrow(_global_owners(memory_bytes), OWNED), "exact-owned")
        tables.append(got)
        done = got.filter("norm is null").select("owner", "keep_owner", "keep_id", "size")
        owned = done if owned is None else owned.unionByName(done)
        todo, round_no = got.filter("norm is not null").select("owner", "least", "rows", "norm"), round_no + 1
        if todo.isEmpty():
            break
    groups = local.select("owner", "id", "first", "sha").join(owned, "owner").select(
        F.col("id"),
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("first") & (F.col("owner") == F.col("keep_owner"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return groups, tables


def keep_first_copies(docs: DataFrame, *, text: str = "text", id: str = "doc_id", memory_bytes: int = 256 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in identifier and text one stays."""
    found, tables = _groups(docs, text, id, memory_bytes)
    groups = stage(found.filter("kept").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha")), "exact-kept")
    discard(*tables)
    joined = docs.withColumn("__own", F.sha2(normalised(F.col(text)), 256)).join(groups, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    # a kept text is in one row unless identifiers repeat; only then is another pass needed
    repeated = docs.groupBy(F.col(id).alias("__id")).count().filter("count > 1")
    if not repeated.isEmpty():
        others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
        joined = joined.withColumn("__n", F.row_number().over(Window.partitionBy(id, "__own").orderBy(text, others))).filter("__n = 1").drop("__n")
    return joined.drop("__own")
