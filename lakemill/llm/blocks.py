"""Blocks of documents that talk to buckets of keys in few large messages.

Corpus-wide lookups (is this name used in another document? how often does this n-gram occur?) would cost a
shuffled row for each key and document. Here documents are dealt into blocks by a hash of their id. A block works
out its distinct keys, sorts them, and sends each bucket one packed message. A bucket answers each message with one
packed message of as many entries, in the same order. A block works its keys out again, in the same order whatever
the order of its rows, and so needs neither keys nor positions in the answers.

* A key that a third of all documents hold takes one entry for each block, never one for each document.
* Blocks and buckets follow the bytes of the texts (``BLOCK_BYTES``, ``BUCKET_BYTES``), whatever the number of shuffle
  partitions is set to, so that memory for each stays the same at any size.
* Messages number blocks times buckets. Past ``MOST_MESSAGES`` they go over hubs: a sender packs what goes to
  neighbouring buckets into one row, and a hub, which serves some senders and some buckets, packs the rows anew, one
  for each bucket. So rows number about blocks times the root of buckets, and the other way round.
* All is recomputed from shuffle files or the input if an executor is lost; nothing depends on the order of rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from lakemill.llm.memory import frugal
from lakemill.llm.words import SLICE_BYTES

#: Bytes of text for each block and each bucket, and rows of messages of one step that go without hubs.
BLOCK_BYTES, BUCKET_BYTES, MOST_MESSAGES = 6 << 20, 18 << 20, 4_000_000

MESSAGE = "to int, sender int, data binary"
_MESSAGE = pa.schema([("to", pa.int32()), ("sender", pa.int32()), ("data", pa.binary())])


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one pass over one column."""
    with cleaning(docs.sparkSession):
        return docs.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("bigint"))).first()[0] or 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset (tests, a laptop), one in the warehouse.

    On a cluster a folder of one machine would do harm, so there the setting, or a warehouse with a scheme, is demanded.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and urlparse(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_checkpoints"


#: Spark removes a query's shuffle files when it ends; what is needed later is in the written tables.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, so that its lineage is cut and any executor may be lost; and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    with cleaning(spark):
        # mostly hashes and packed values: a codec would save little, and its buffers lie outside the heap
        df.write.option("compression", "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df)[0]


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df``, which is partitioned by ``key`` into as many parts, as a table in the shared folder that keeps this partitioning.

    Steps that group its rows by ``key`` read it without a shuffle, so its rows are on disk once.
    """
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    with cleaning(spark):
        rows = df.write.format("parquet").option("compression", "none").option("path", f"{shared_folder(spark)}/tables/{name}")
        rows.bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        column = batch.column("text")
        packed = []
        for text in column:
            buffer = text.as_buffer()
            packed.append(None if buffer is None else len(buffer).to_bytes(8, "little") + codec.compress(buffer, asbytes=True))
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(packed, pa.binary()))


def unpack(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """From a block's column of compressed texts: row ranges and their texts, a slice of bounded size at a time."""
    codec, texts, size, begin = pa.Codec("zstd"), [], 0, 0
    n = len(column)
    for i, value in enumerate(column):
        buffer = value.as_buffer()
        if buffer is None:
            texts.append(b"")
        else:
            length = int.from_bytes(memoryview(buffer)[:8], "little")
            if texts and size + length > SLICE_BYTES:
                yield begin, i, pa.array(texts, pa.large_binary())
                texts, size, begin = [], 0, i
            texts.append(codec.decompress(buffer.slice(8), length, asbytes=True) if length else b"")
            size += length
    if begin < n:
        yield begin, n, pa.array(texts, pa.large_binary())


def to_blocks(docs: DataFrame, blocks: int, keep: list[str] = ()) -> DataFrame:
    """(block, doc_id, text compressed, the columns to keep), one row for each row of ``docs``.

    Rows with a null doc_id are dealt by their text.
    """
    fields = [T.StructField("block", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType())]
    number = F.col("doc_id").cast("bigint")
    rows = docs.select(
        F.pmod(F.when(number.isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.xxhash64(number)), F.lit(blocks)).cast("int").alias("block"),
        number.alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
        *keep,
    )
    return rows.mapInArrow(frugal(_compress), T.StructType(fields + rows.schema.fields[3:]))


class Outbox:
    """Sorted keys of a block, cut into a message for each bucket; ``bucket_of`` is monotone in the key."""

    def __init__(self, keys: np.ndarray, buckets: int):
        self.keys = keys
        # buckets are equal ranges of the hashed 64-bit keys, so sorted keys need no further sorting
        edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
        self.cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)

    def messages(self, block: int, pack: Callable[[int, int], bytes]) -> pa.Table:
        to = np.flatnonzero(np.diff(self.cuts))
        data = [pack(int(self.cuts[b]), int(self.cuts[b + 1])) for b in to]
        return pa.table([pa.array(to, pa.int32()), pa.array(np.full(len(to), block), pa.int32()), pa.array(data, pa.binary())], schema=_MESSAGE)

    def read(self, answers: pa.Table, kind: type, bits: bool = False) -> np.ndarray:
        """The answers to all keys, in their order; from arrays of ``kind``, or packed bits."""
        out = np.zeros(len(self.keys), bool if bits else kind)
        for sender, data in zip(answers.column("sender").to_pylist(), answers.column("data"), strict=True):
            lo, hi = int(self.cuts[sender]), int(self.cuts[sender + 1])
            raw = np.frombuffer(data.as_buffer(), np.uint8 if bits else kind)
            out[lo:hi] = np.unpackbits(raw, count=hi - lo).view(bool) if bits else raw
        return out


def mail(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    to, sender, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(to, pa.int32()), pa.array(sender, pa.int32()), pa.array(data, pa.binary())], schema=_MESSAGE)


def one(column: pa.ChunkedArray) -> int:
    return column[0].as_py()


def _pack(rows: list[tuple[int, int, bytes]]) -> bytes:
    """Messages in one value: their number, then (to, sender, length) of each, then their data."""
    head = np.array([(to, sender, len(data)) for to, sender, data in rows], np.int64).tobytes()
    return b"".join([len(rows).to_bytes(8, "little"), head, *(data for _, _, data in rows)])


def _unpack(data) -> list[tuple[int, int, bytes]]:
    n = int.from_bytes(memoryview(data)[:8], "little")
    out, at = [], 8 + 24 * n
    for to, sender, length in np.frombuffer(data, np.int64, 3 * n, 8).reshape(n, 3).tolist():
        out.append((to, sender, bytes(memoryview(data)[at : at + length])))
        at += length
    return out


def _opened(table: pa.Table) -> pa.Table:
    """A table of packed messages as a table of messages; other columns are repeated."""
    rows, extra = [], [c for c in table.column_names if c not in ("to", "sender", "data")]
    index = []
    for i, data in enumerate(table.column("data")):
        part = _unpack(data.as_buffer())
        rows += part
        index += [i] * len(part)
    out = mail(rows)
    for c in extra:
        out = out.append_column(c, table.column(c).take(pa.array(index, pa.int64())))
    return out


class Post:
    """How the blocks and buckets of some bytes of text exchange messages."""

    def __init__(self, size: int, per_block: int | None = None):
        self.blocks, self.buckets = max(8, -(-size // (per_block or BLOCK_BYTES))), max(8, -(-size // BUCKET_BYTES))
        self.hubs = self.blocks * self.buckets > MOST_MESSAGES

    def _sent(self, grouped, work: Callable[..., pa.Table], senders: int, receivers: int) -> DataFrame:
        if not self.hubs:
            return grouped.applyInArrow(work, MESSAGE)
        wide, many = max(1, math.isqrt(receivers)), max(1, math.isqrt(senders))

        def packed(table: pa.Table) -> pa.Table:
            """Rows to hubs: hub (in ``to``), and all messages that go over it."""
            by_hub: dict[int, list] = {}
            for to, sender, data in zip(*(table.column(c).to_pylist() for c in ("to", "sender", "data")), strict=True):
                by_hub.setdefault(to // wide * (senders // many + 1) + sender // many if to >= 0 else -1, []).append((to, sender, data))
            return mail([(hub, 0, _pack(rows)) for hub, rows in by_hub.items()])

        def relay(table: pa.Table) -> pa.Table:
            by_receiver: dict[int, list] = {}
            for data in table.column("data"):
                for row in _unpack(data.as_buffer()):
                    by_receiver.setdefault(row[0], []).append(row)
            return mail([(to, 0, _pack(rows)) for to, rows in by_receiver.items()])

        two = isinstance(grouped, PandasCogroupedOps)
        sent = grouped.applyInArrow((lambda a, b: packed(work(a, b))) if two else (lambda a: packed(work(a))), MESSAGE)
        return sent.groupBy("to").applyInArrow(relay, MESSAGE)

    def _open(self, table: pa.Table) -> pa.Table:
        return _opened(table) if self.hubs else table

    def ask(self, blocks: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """Messages that ``work`` makes of each block."""
        return self._sent(blocks.groupBy("block"), work, self.blocks, self.buckets)

    def answer(self, messages: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """Each bucket's messages go to ``work``, whose messages go back to blocks."""
        opened = self._open
        return self._sent(messages.groupBy("to"), lambda table: work(opened(table)), self.buckets, self.blocks)

    def ask_again(self, blocks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        """Messages that ``work`` makes of each block and the answers it got; a block without answers gets an empty table."""
        opened = self._open
        return self._sent(self._cogrouped(blocks, answers), lambda table, got: work(table, opened(got)), self.blocks, self.buckets)

    def follow(self, blocks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """What ``work`` makes of each block and the answers it got."""
        opened = self._open
        return self._cogrouped(blocks, answers).applyInArrow(lambda table, got: work(table, opened(got)), schema)

    def reports(self, answers: DataFrame) -> list[bytes]:
        """What buckets have sent to the driver (to < 0), a value for each bucket."""
        with cleaning(answers.sparkSession):
            rows = [bytes(r.data) for r in answers.where("to < 0").select("data").collect()]
        return [data for r in rows for _, _, data in _unpack(r)] if self.hubs else rows

    @staticmethod
    def _cogrouped(blocks: DataFrame, answers: DataFrame):
        return blocks.groupBy("block").cogroup(answers.withColumnRenamed("to", "block").groupBy("block"))
