"""Training-order materialisation.

Documents become token sequences of one length; a keyed Feistel permutation with cycle-walking gives each of the N sequences a
global slot in 0..N-1, without any table of the permutation and invertible at a slot. Shard s holds the slots
[s * shard_records, (s + 1) * shard_records), each record having the same stride, so that a reader goes from any slot on by arithmetic.

Sequences are numbered by the documents alone, not by how the table is partitioned: documents are dealt to buckets by a hash of identifier and text,
ordered in a bucket by identifier and text hash, their tokens are one stream there, and buckets follow each other by number.

A record is a little-endian unsigned 32-bit token count followed by ``length`` ids, padded with zeros; ids take 2 bytes if the vocabulary allows, else 4.
A shard is one uncompressed file ``shard_id=<s>/part-*``: its records, then one line feed (Spark's text writer ends a row with it; only Spark's own writers
reach every store). So record r of a shard is at byte ``r * stride``.

A finished task's shards are moved to their place at once, so that a run that is broken off leaves whole shards. ``_layout`` beside them holds what
the order depends on (key, lengths, number of sequences, a digest of the input, ...). A later run with the same layout writes the missing shards only,
whatever the partitioning of its input; one with another layout is refused, as is a target whose shards have the wrong size.

Defined cases: null text counts as empty (the end token only); null identifiers come last in their bucket; identifiers may repeat (rows equal in identifier and text are alike in every order);
an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.storage import batches_of, discard, shuffles_dropped, stage

#: Rows that Spark hands to Python at once; whole texts lie in each batch, on both sides.
BATCH_ROWS = 500
ROUNDS = 6
#: Most buckets: their offsets, 16 bytes each, are broadcast. Beyond it buckets grow; they are sorted and streamed, never held.
MOST_BUCKETS = 1_000_000
#: Buckets whose offsets are summed in one task.
CHUNK = 1024
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & ((1 << 64) - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1; values outside are walked along their cycle until they are inside."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.key = n, key
        self.half = max(1, -(-max(1, n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, rounds) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for r in rounds:
            left, right = right, left ^ (_mix(right, self.key * 1_000_003 + r) & self.mask)
        return (right << np.uint64(self.half)) | left  # swapped once more, so that the inverse is the same walk with the rounds reversed

    def _walk(self, x, rounds) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), rounds)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], rounds)
        return x.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, range(ROUNDS))

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, list(reversed(range(ROUNDS))))


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _restored(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def input_digest(docs: DataFrame, *, text: str, id: str) -> dict:
    """Rows, bytes of text, and sums over hashes of (identifier, text) that don't depend on the rows' order."""
    own = docs.select(F.xxhash64(F.col(id).cast("long"), F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
    row = own.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return row.asDict()


def sequences(docs: DataFrame, encode: Callable[[str], list[int]], *, text: str, id: str, length: int, width: int, end_id: int, buckets: int) -> DataFrame:
    """(bucket, nth, record), the record compressed. The tokens of a bucket are one stream, cut every ``length``; only its last record may be short."""
    kind = np.dtype(f"<u{width}")

    def encoded(batches):
        for batch in batches:
            counts, bodies = [], []
            for body in batch["text"]:  # one text at a time, so that a batch's ids never lie in memory together
                ids = np.array([*encode(body.as_py()), end_id], kind)
                counts.append(len(ids))
                bodies.append(_squeezed(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("bucket", "id", "h")), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "id", "h", "n", "ids"])

    def cut(batches):
        at, nth, rest, out = None, 0, np.empty(0, kind), []

        def record(ids):
            nonlocal nth
            out.append((at, nth, _squeezed(np.uint32(len(ids)).astype("<u4").tobytes() + np.pad(ids, (0, length - len(ids))).tobytes())))
            nth += 1

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "nth", "record"])
            out.clear()
            return batch

        for batch in batches:
            for bucket, n, ids in zip(*(batch[c].to_pylist() for c in ("bucket", "n", "ids")), strict=True):
                if bucket != at:
                    if len(rest):
                        record(rest)
                    at, nth, rest = bucket, 0, np.empty(0, kind)
                rest = np.concatenate((rest, np.frombuffer(_restored(ids, n * width), kind)))
                whole = len(rest) // length
                for i in range(whole):
                    record(rest[i * length : (i + 1) * length])
                rest = rest[whole * length :]
                if len(out) >= 2048:
                    yield flush()
        if len(rest):
            record(rest)
        if out:
            yield flush()

    own = docs.select(F.coalesce(F.col(id).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)).cast("int"))
    ready = dealt.select("bucket", "id", "h", "text").mapInArrow(encoded, "bucket int, id long, h long, n long, ids binary")
    return ready.repartition("bucket").sortWithinPartitions("bucket", "id", "h").select("bucket", "n", "ids").mapInArrow(cut, "bucket int, nth long, record binary")


def offsets(counts: DataFrame) -> DataFrame:
    """counts(bucket, n) -> (bucket, base): the number of sequences in the buckets before. Summed by chunks of buckets, then over the chunks."""
    chunked = counts.withColumn("chunk", F.floor(F.col("bucket") / CHUNK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("chunk").orderBy("bucket"))), F.lit(0))
    chunks = chunked.groupBy("chunk").agg(F.sum("n").alias("m"))  # at most MOST_BUCKETS / CHUNK rows
    before = chunks.select("chunk", F.coalesce(F.sum("m").over(earlier(Window.orderBy("chunk"))), F.lit(0)).alias("before"))
    return chunked.withColumn("inside", inside).join(F.broadcast(before), "chunk").select("bucket", (F.col("inside") + F.col("before")).alias("base"))


def _path(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored_layout(spark: SparkSession, target: str) -> dict | None:
    """What ``target`` was written with; None if nothing was."""
    files, path = _path(spark, f"{target}/_layout/_SUCCESS")
    return json.loads(spark.read.text(f"{target}/_layout").first()[0]) if files.exists(path) else None


def shards_at(spark: SparkSession, target: str) -> DataFrame | None:
    """(shard_id, length, content) of the shards at ``target``, or None if there is none. Contents are read only if asked for."""
    files, path = _path(spark, f"{target}/shard_id=*")
    found = files.globStatus(path)
    if found is None or not len(found):
        return None
    return spark.read.format("binaryFile").load(target).select(F.col("shard_id").cast("long").alias("shard_id"), "length", "content")


def _expected(layout: dict):
    """Bytes of a shard's file."""
    records = F.least(F.lit(layout["shard_records"]), F.lit(layout["sequences"]) - F.col("shard_id") * layout["shard_records"])
    return records * layout["stride"] + 1


def materialise(docs: DataFrame, encode: Callable[[str], list[int]], target: str, *, key: int, text: str = "text", id: str = "doc_id", length: int = 1024, vocabulary: int = 50257, end_id: int = 50256, shard_records: int = 2048, bucket_bytes: int = 1 << 20, rounds: int = 2, task_shards: int = 8) -> dict:
    """Write the shards that ``target`` lacks; returns the layout (sequences, stride, ...). ValueError if ``target`` was written with another one.

    The shards are written in ``rounds`` ranges, one job each, so that the records on their way to them take that part of their size on disk only.
    A task gets ``task_shards`` shards on average: the writer sorts whole bodies, so that its memory goes with their number."""
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    digest = input_digest(docs, text=text, id=id)
    old = stored_layout(spark, target)
    buckets = old["buckets"] if old else max(1, min(MOST_BUCKETS, -(-digest["bytes"] // bucket_bytes)))
    layout = {"length": length, "width": width, "stride": 4 + width * length, "end_id": end_id, "shard_records": shard_records, "buckets": buckets, "key_sha256": hashlib.sha256(str(key).encode()).hexdigest(), "encoder": str(getattr(encode, "name", type(encode).__name__)), "input": digest}
    if old:
        differs = [n for n in layout if layout[n] != old.get(n)]
        if differs:
            raise ValueError(f"{target} was written with another {', '.join(differs)}; remove it or choose another folder")
    if not digest["rows"]:
        return {**layout, "sequences": 0, "key": key}
    with batches_of(spark, BATCH_ROWS):
        records = stage(sequences(docs, encode, text=text, id=id, length=length, width=width, end_id=end_id, buckets=buckets), "sequences", "none")
    counts = stage(records.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "sequence-counts")
    total = counts.agg(F.sum("n")).first()[0]
    layout["sequences"] = total
    if old and old["sequences"] != total:
        raise ValueError(f"{target} was written with another number of sequences")
    if not old:
        spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/_layout")
    order = Feistel(total, key)

    @F.pandas_udf("long")
    def slot(sequence):
        import pandas as pd

        return pd.Series(order.slot(sequence.to_numpy()))

    dealt = records.join(F.broadcast(offsets(counts)), "bucket").withColumn("slot", slot(F.col("base") + F.col("nth"))).withColumn("shard_id", F.floor(F.col("slot") / shard_records)).select("shard_id", "slot", "record")
    there = shards_at(spark, target)
    if there is not None:
        odd = there.select("shard_id", "length").groupBy("shard_id").agg(F.count(F.lit(1)).alias("files"), F.max("length").alias("length")).filter((F.col("files") > 1) | (F.col("length") != _expected(layout)))
        if bad := odd.limit(5).collect():
            raise ValueError(f"shards of the wrong size at {target}: {[r['shard_id'] for r in bad]}")
        dealt = dealt.join(there.select("shard_id"), "shard_id", "left_anti")
    stride = layout["stride"]

    def shards(batches):
        at, held = None, []

        def close():
            held.sort()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([b"".join(_restored(r, stride) for _, r in held)], pa.binary())], names=["shard_id", "body"])

        for batch in batches:
            for shard, s, r in zip(*(batch[c].to_pylist() for c in ("shard_id", "slot", "record")), strict=True):
                if shard != at:
                    if held:
                        yield close()
                    at, held = shard, []
                held.append((s, r))
        if held:
            yield close()

    n_shards = -(-total // shard_records)
    for r in range(rounds):
        first, last = n_shards * r // rounds, n_shards * (r + 1) // rounds
        if first == last:
            continue
        own = dealt.filter((F.col("shard_id") >= first) & (F.col("shard_id") < last))
        # whole shards meet in one task: each is a fixed range of slots of bounded size; the number of tasks is named, or compressed records would be put together by their size before they grow
        bodies = own.repartition(-(-(last - first) // task_shards), "shard_id").sortWithinPartitions("shard_id").mapInArrow(shards, "shard_id long, body binary").select("shard_id", F.col("body").cast("string").alias("value"))
        with shuffles_dropped(spark):
            bodies.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("compression", "none").partitionBy("shard_id").text(target)
    discard(records, counts)
    return {**layout, "key": key}


def read_from(spark: SparkSession, target: str, layout: dict, first_slot: int = 0, *, ids: bool = True) -> DataFrame:
    """Records from ``first_slot`` on: shard_id, slot, sequence_id, byte_offset, n_tokens, ids_crc32 and, if asked for, ids. Shards before it aren't read."""
    schema = "shard_id long, slot long, sequence_id long, byte_offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    if not layout["sequences"]:
        return spark.createDataFrame([], schema)
    order, stride, width, size = Feistel(layout["sequences"], layout["key"]), layout["stride"], layout["width"], layout["shard_records"]
    names = [c.split()[0] for c in schema.split(", ")]
    shards = shards_at(spark, target).filter(F.col("shard_id") >= first_slot // size)

    def run(batches):
        for batch in batches:
            for shard, body in zip(batch["shard_id"].to_pylist(), batch["content"], strict=True):
                data = body.as_buffer()
                n = data.size // stride
                slots = np.arange(shard * size, shard * size + n)
                counts, crcs, own_ids = [], [], []
                for k in range(n):
                    count = int(np.frombuffer(data, "<u4", 1, k * stride)[0])
                    own = np.frombuffer(data, f"<u{width}", count, k * stride + 4)
                    counts.append(count)
                    crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
                    own_ids.append(own.astype(np.int32) if ids else None)
                keep = slots >= first_slot
                columns = [pa.array([shard] * n, pa.int64()), pa.array(slots), pa.array(order.sequence(slots)), pa.array(np.arange(n) * stride), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), *([pa.array(own_ids, pa.list_(pa.int32()))] if ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return shards.select("shard_id", "content").mapInArrow(run, schema)
