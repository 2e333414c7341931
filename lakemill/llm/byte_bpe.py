"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before a space (U+0020) that follows a character which is not white space. No match of the
splitting pattern holds a space after anything but white space, and none looks behind, so the pieces' matches are
the whole text's. A text without such a place stays whole. Ids are packed as little-endian unsigned 32-bit integers.

A run of white space is one match, but for its last character where something follows, which goes with what follows.
The library's matcher runs out of stack on runs of some hundred thousand; so a run of ``LONG_RUN`` or more is cut out
and its match encoded by the library's call for a single match.

Defined cases: a null text is encoded as an empty one, to no ids; decoding gives the raw bytes, also where ids do
not make up whole characters; null ids decode to no bytes; a column that has the result's name is replaced (the text
or ids column too, if it is named as the result). Other columns pass unchanged.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.llm.memory import frugal
from lakemill.llm.words import plain, slices

#: Characters of a text that are encoded at once.
PIECE = 1 << 16
#: White-space characters in a row that are matched here and not by the library.
LONG_RUN = 4096
_SAFE = re.compile(r"\S(?= )")
#: The characters of Unicode's White_Space property, which is the pattern's \s.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


def load(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut where no match can cross."""
    at = 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most - 1)
        if not found or found.end() >= len(text):
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def encode_text(encoding: tiktoken.Encoding, text: str) -> bytes:
    out, at = [], 0

    def plain_part(end: int) -> None:
        if end > at:
            out.extend(encoding.encode_to_numpy(part, disallowed_special=()).astype("<u4").tobytes() for part in pieces(text[at:end]))

    for run in _LONG.finditer(text):
        plain_part(run.start())
        at = run.end() if run.end() == len(text) else run.end() - 1
        out.append(np.array(encoding._encode_single_piece(text[run.start() : at].encode()), "<u4").tobytes())
    plain_part(len(text))
    return b"".join(out)


def _with(rows: pa.RecordBatch, name: str, made: pa.Array) -> pa.RecordBatch:
    """``rows`` with a last column, in place of one of that name."""
    kept = [i for i, c in enumerate(rows.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), made], names=[*(rows.schema.names[i] for i in kept), name])


def _schema(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(name, T.BinaryType()) for name in names)])


def _packed(encoding: tiktoken.Encoding, texts: pa.Array) -> pa.Array:
    return pa.array([encode_text(encoding, t) for t in texts.to_pylist()], pa.binary())


def _raw(encoding: tiktoken.Encoding, packed: pa.Array) -> pa.Array:
    return pa.array([encoding.decode_bytes(memoryview(x).cast("I").tolist()) if x else b"" for x in packed.to_pylist()], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a binary column of packed ids for the text column. ``path`` must exist on all executors."""

    def work(batches):
        encoding = load(path, pattern)
        for batch in batches:
            texts = plain(batch.column(text))
            for a, b in slices(texts):
                yield _with(batch.slice(a, b - a), ids, _packed(encoding, texts.slice(a, b - a)))

    return df.mapInArrow(frugal(work), _schema(df, ids))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column of the bytes that the packed ids stand for."""

    def work(batches):
        encoding = load(path, pattern)
        for batch in batches:
            packed = plain(batch.column(ids))
            for a, b in slices(packed):
                yield _with(batch.slice(a, b - a), out, _raw(encoding, packed.slice(a, b - a)))

    return df.mapInArrow(frugal(work), _schema(df, out))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the columns of ``encode`` and of ``decode`` of it, and without the text.

    Each slice is encoded and its packed ids decoded by one worker: two steps in a row would take two workers for each
    task, with a rank table each, and hand the ids over through the JVM.
    """

    def work(batches):
        encoding = load(path, pattern)
        for batch in batches:
            texts = plain(batch.column(text))
            rest = batch.drop_columns([text])
            for a, b in slices(texts):
                packed = _packed(encoding, texts.slice(a, b - a))
                yield _with(_with(rest.slice(a, b - a), ids, packed), out, _raw(encoding, packed))

    return df.mapInArrow(frugal(work), _schema(df.drop(text), ids, out))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, for all rows of ``docs``."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    done = round_trip(texts, path, pattern)
    return done.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
