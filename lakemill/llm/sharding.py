"""Shards that each hold the whole mixture: proportional stratified interleaving, in DataFrame operations.

Rows are shuffled by a seeded key and ranked within their source. Row r of a source with n rows stands at the
fraction (2 r + 1) / 2 n of the whole; sorting all rows by it spreads each source evenly. Cutting that order into
equal parts gives every shard each source's share, to within a row.

Law ``rows``: counts of shards are at most one apart. Defined cases: a null source is a source of its own; a null
text has size 1 and the CRC of no bytes; equal keys (repeated rows) are ordered by doc_id, size and CRC, so that
only equal rows can change places; no rows give no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.ranks import range_count, range_of_key, ranked, shuffle_key

SHARDS, SEED = 16, 17


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, position (over all shards), shard and slot (gapless from 0) of each row."""
    ranges = range_count(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("key", shuffle_key(seed, "doc_id"))
    rows = rows.withColumn("piece", range_of_key(F.col("key"), ranges))
    rows = ranked(rows, ["stratum"], "piece", ["key", "doc_id", "size", "text_crc32"], "rank", "n").drop("piece", "key")
    rows = rows.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("n")))
    rows = rows.withColumn("piece", F.expr(f"int((2 * rank + 1) * {ranges} div (2 * n))")).drop("rank", "n")
    rows = ranked(rows, [], "piece", ["fraction", "stratum", "doc_id", "size", "text_crc32"], "position", "n")
    rows = rows.withColumn("shard", F.expr(f"int(position * {shards} div n)"))
    slot = F.expr(f"position - (shard * n + {shards - 1}) div {shards}")
    return rows.select("doc_id", "source", "size", "text_crc32", "position", "shard", slot.cast("bigint").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
