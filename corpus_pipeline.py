"""From raw documents to token ids: five stages, each one operator of ``lakemill.llm``.

1. quality rules: documents that the base rules or the learned decision list reject go;
2. MinHash near-dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the least doc_id stays;
3. substring dedup: passages of 50 words and more that an earlier document holds are cut from the texts;
4. mixing: rows are put in the order of a Pfair schedule, each source at the weight of the square root of its rows;
   no row is dropped or repeated, so past the point where a source runs out the others close up;
5. byte-level BPE: token ids of each text, the digests of the ids and of what they decode to, and the text's position
   in the mixture, which is read off the files of stage 4 (a reread alone does not keep their order).

Each stage takes and (but for the last) returns the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import byte_bpe, minhash, mixing, quality_rules, substring_dedup
from lakemill.llm.blocks import cleaning, discard, shared_folder

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.label_rows(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = mixing.positions(docs)
    rows = byte_bpe.round_trip(docs.select("doc_id", "source", "position", "text"), *ranks)
    return rows.select(
        "doc_id",
        "source",
        "position",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("mixing", mixture),
    ("byte-level bpe", tokens),
]

#: No SQL: stages 2, 3 and 5 have none; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages before it are written to the shared folder and read again.

    Tables of the first two stages are deleted once nothing reads them; the result reads the fourth, and the third is
    left as what the mixture was made of.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = stage(spark, docs, sf_dir)
        with cleaning(spark):
            made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    discard(spark, f"{folder}/0", f"{folder}/1")
    return STAGES[-1][1](spark, docs, sf_dir)
