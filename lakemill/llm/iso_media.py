"""Columns of ISO base media files (MP4, MOV): what a table of clips needs without decoding a payload.

``probe`` walks nested boxes, decodes the sample tables of each track, or the runs of its fragments, and gives codec,
duration and the byte ranges of sync samples. ``mux`` writes such a file around bytes that are stored as 8-bit
samples, losslessly.

Defined cases: a null or empty value has no tracks and the error "empty"; a file that ends inside a box, nests boxes
deeper than ``DEPTH``, or whose tables contradict each other or the file's size, gives an error text instead of
failing the job, before anything of a claimed size is allocated; a track without ``stss`` has only sync samples; the
32-bit zero that may end a QuickTime ``udta`` is allowed, and so is its ``meta`` without version. A column that has
the result's name is replaced. Other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.llm.words import plain, slices

UNIT = 192  # bytes of a stored sample
RATE = 8000  # units of time a second; one byte each
PER_CHUNK, KEY_EVERY = 32, 16
DEPTH = 32
#: Boxes that hold boxes, and bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A file with one track of 8-bit mono samples; the payload's length is a positive multiple of ``UNIT``."""
    n, rest = divmod(len(payload), UNIT)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the unit")
    start = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    data = _box(b"mdat", payload)
    at = len(start) + len(data) - len(payload)
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    to_chunk = [(1, min(n, PER_CHUNK), 1)] + ([(chunks, last, 1)] if chunks > 1 and last != PER_CHUNK else [])
    offsets = at + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * UNIT)
    wide = bool(offsets[-1] >> 32)
    keys = np.arange(1, n + 1, KEY_EVERY).astype(">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    length = n * UNIT
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, UNIT)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(to_chunk)), b"".join(struct.pack(">III", *e) for e in to_chunk)),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    version, form = (1, ">QQIQ") if length >> 32 else (0, ">IIII")
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(form, 0, 0, RATE, length), struct.pack(">HH", 0x55C4, 0), version=version),
        _full(b"hdlr", bytes(4), b"soun", bytes(13)),
        _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables),
    )
    form_t = ">QQIIQ" if version else ">IIIII"
    track = _full(b"tkhd", struct.pack(form_t, 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), _MATRIX, bytes(8), version=version, flags=7)
    header = _full(b"mvhd", struct.pack(form, 0, 0, RATE, length), struct.pack(">IH", 0x10000, 256), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=version)
    return start + data + _box(b"moov", header, _box(b"trak", track, media))


def boxes(data: memoryview, at: int, end: int, ended: bool = False):
    """(type, start of the content, end) of each box between two places; ``ended``: a 32-bit zero may come last."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("cut off inside a box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, at + head, at + size
        at += size
    if at != end and not (ended and at + 4 == end and not any(data[at:end])):
        raise ValueError("bytes after the last box")


def tree(data: memoryview, at: int, end: int) -> list:
    """Nested (type, start, end, children), by a list of what is still to be walked."""
    top: list = []
    todo = [(at, end, top, 0, False)]
    while todo:
        at, end, out, depth, ended = todo.pop()
        if depth > DEPTH:
            raise ValueError("boxes are nested too deeply")
        for kind, a, b in boxes(data, at, end, ended):
            children: list = []
            out.append((kind, a, b, children))
            inner = CONTAINERS.get(kind)
            if kind == b"meta" and bytes(data[a + 4 : a + 8]) == b"hdlr":
                inner = 0
            if inner is not None and a + inner <= b:
                todo.append((a + inner, b, children, depth + 1, kind == b"udta"))
    return top


def _find(nodes: list, *path: bytes):
    for kind in path:
        node = next((x for x in nodes if x[0] == kind), None)
        if node is None:
            return None
        nodes = node[3]
    return node


def _table(data: memoryview, node, kind: str, width: int = 1, skip: int = 4) -> np.ndarray:
    """The entries of a table box: after ``skip`` bytes a count, then rows of ``width`` numbers."""
    count = struct.unpack_from(">I", data, node[1] + skip)[0]
    size = np.dtype(kind).itemsize
    if node[1] + skip + 4 + count * width * size > node[2]:
        raise ValueError(f"table {node[0]!r} is cut off")
    return np.frombuffer(data, kind, count * width, node[1] + skip + 4).astype(np.int64).reshape(count, width)


def _times(data: memoryview, node) -> tuple[int, int]:
    if data[node[1]]:
        return struct.unpack_from(">IQ", data, node[1] + 20)
    return struct.unpack_from(">II", data, node[1] + 12)


def _need(node, name: str):
    if node is None:
        raise ValueError(f"no {name} box")
    return node


def _track(data: memoryview, node) -> dict:
    nodes = node[3]
    timescale, duration = _times(data, _need(_find(nodes, b"mdia", b"mdhd"), "mdhd"))
    handler = _need(_find(nodes, b"mdia", b"hdlr"), "hdlr")
    tables = _need(_find(nodes, b"mdia", b"minf", b"stbl"), "stbl")[3]
    described = _need(_find(tables, b"stsd"), "stsd")
    codec = bytes(data[described[1] + 12 : described[1] + 16]).decode("latin-1")
    head = _find(nodes, b"tkhd")
    number = struct.unpack_from(">I", data, head[1] + (20 if data[head[1]] else 12))[0] if head else 0
    sizes_at = _need(_find(tables, b"stsz"), "stsz")
    fixed, count = struct.unpack_from(">II", data, sizes_at[1] + 4)
    if fixed and count * fixed > len(data):
        raise ValueError("samples are larger than the file")
    sizes = np.full(count, fixed, np.int64) if fixed else _table(data, sizes_at, ">u4", skip=8)[:, 0]
    narrow = _find(tables, b"stco")
    chunk_at = (_table(data, narrow, ">u4") if narrow else _table(data, _need(_find(tables, b"co64"), "co64"), ">u8"))[:, 0]
    runs = _table(data, _need(_find(tables, b"stsc"), "stsc"), ">u4", 3)
    spans = np.diff(np.append(runs[:, 0] - 1, len(chunk_at)))
    if len(runs) and (runs[0, 0] != 1 or spans.min() < 0):
        raise ValueError("runs of chunks do not agree")
    per_chunk = np.repeat(runs[:, 1], spans) if len(runs) else np.zeros(0, np.int64)
    if per_chunk.sum() != count or len(per_chunk) != len(chunk_at):
        raise ValueError("samples and chunks do not agree")
    ends = np.cumsum(sizes)
    first = np.cumsum(per_chunk) - per_chunk
    before = np.append(0, ends)[first]
    places = np.repeat(chunk_at - before, per_chunk) + ends - sizes
    steps = _table(data, _need(_find(tables, b"stts"), "stts"), ">u4", 2)
    sync = _find(tables, b"stss")
    keys = _table(data, sync, ">u4")[:, 0] - 1 if sync else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise ValueError("a sync sample is not in the track")
    return {
        "track_id": number,
        "handler": bytes(data[handler[1] + 8 : handler[1] + 12]).decode("latin-1"),
        "codec": codec,
        "timescale": timescale,
        "duration": duration,
        "ticks": int((steps[:, 0] * steps[:, 1]).sum()),
        "places": places,
        "sizes": sizes,
        "keys": keys,
    }


_NOT_SYNC = 0x10000  # of a sample's flags


def _numbers(data: memoryview, at: int, end: int, n: int) -> list[int]:
    if at + 4 * n > end:
        raise ValueError("a fragment is cut off")
    return list(struct.unpack_from(f">{n}I", data, at))


def _fragment(data: memoryview, start: int, node, defaults: dict, tracks: dict) -> None:
    """Adds the runs of one ``traf`` to its track."""
    head = _need(_find(node[3], b"tfhd"), "tfhd")
    flags, number = _numbers(data, head[1], head[2], 2)
    flags &= 0xFFFFFF
    if number not in tracks:
        raise ValueError("a fragment of an unknown track")
    track, at, base = tracks[number], head[1] + 8, start
    length, size, sample_flags = defaults.get(number, (0, 0, 0))
    if flags & 0x1:
        high, low = _numbers(data, at, head[2], 2)
        base, at = high << 32 | low, at + 8
    at += 4 * bool(flags & 0x2)
    if flags & 0x8:
        length, at = _numbers(data, at, head[2], 1)[0], at + 4
    if flags & 0x10:
        size, at = _numbers(data, at, head[2], 1)[0], at + 4
    if flags & 0x20:
        sample_flags = _numbers(data, at, head[2], 1)[0]
    follows = base
    for kind, a, b, _ in node[3]:
        if kind != b"trun":
            continue
        flags, count = _numbers(data, a, b, 2)
        flags, at = flags & 0xFFFFFF, a + 8
        place = follows
        if flags & 0x1:
            offset = struct.unpack_from(">i", data, at)[0] if at + 4 <= b else 0
            place, at = base + offset, at + 4
        first_flags = None
        if flags & 0x4:
            first_flags, at = _numbers(data, at, b, 1)[0], at + 4
        kinds = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
        if kinds and at + 4 * count * len(kinds) > b:
            raise ValueError("a run of samples is cut off")
        seen = len(track["sizes"])
        if not flags & 0x200 and seen + count * max(size, 1) > len(data):
            raise ValueError("samples are larger than the file")
        rows = np.frombuffer(data, ">u4", count * len(kinds), at).astype(np.int64).reshape(count, len(kinds))
        column = lambda f, other: rows[:, kinds.index(f)] if f in kinds else np.full(count, other, np.int64)  # noqa: B023, E731
        sizes, marks = column(0x200, size), column(0x400, sample_flags).copy()
        if first_flags is not None and count:
            marks[0] = first_flags
        ends = place + np.cumsum(sizes)
        track["places"] = np.append(track["places"], ends - sizes)
        track["sizes"] = np.append(track["sizes"], sizes)
        track["keys"] = np.append(track["keys"], seen + np.flatnonzero(marks & _NOT_SYNC == 0))
        track["ticks"] += int(column(0x100, length).sum())
        follows = int(ends[-1]) if count else place


def probe(media: bytes) -> list[dict]:
    """The tracks of a file, with the samples of the movie's tables and of all fragments."""
    data = memoryview(media)
    nodes = tree(data, 0, len(data))
    movie = _need(_find(nodes, b"moov"), "moov")
    tracks = [_track(data, x) for x in movie[3] if x[0] == b"trak"]
    by_number = {t["track_id"]: t for t in tracks}
    extends = _find(movie[3], b"mvex")
    defaults = {}
    for kind, a, b, _ in extends[3] if extends else []:
        if kind == b"trex":
            _, number, _, length, size, flags = _numbers(data, a, b, 6)
            defaults[number] = length, size, flags
    for x in nodes:
        if x[0] == b"moof":
            for part in x[3]:
                if part[0] == b"traf":
                    _fragment(data, x[1] - 8, part, defaults, by_number)
    for t in tracks:
        if len(t["places"]) and (t["places"].min() < 0 or (t["places"] + t["sizes"]).max() > len(data)):
            raise ValueError("a sample lies outside the file")
        if not t["duration"]:  # a fragmented file states none
            t["duration"] = t["ticks"]
    return tracks


def read_samples(media: bytes, track: dict) -> bytes:
    """The stored bytes of a track, in sample order; neighbouring samples are read as one range."""
    places, sizes = track["places"], track["sizes"]
    if not len(places):
        return b""
    new = np.flatnonzero(np.append(True, places[1:] != places[:-1] + sizes[:-1]))
    ends = np.append(new[1:], len(places)) - 1
    return b"".join(media[int(a) : int(b)] for a, b in zip(places[new], places[ends] + sizes[ends], strict=True))


MEDIA = (
    "struct<tracks:array<struct<track_id:bigint,codec:string,handler:string,duration:double,samples:bigint,"
    "keyframes:array<struct<offset:bigint,length:bigint>>>>,error:string>"
)
_ARROW_FACTS = pa.struct(
    [
        (
            "tracks",
            pa.list_(
                pa.struct(
                    [
                        ("track_id", pa.int64()),
                        ("codec", pa.string()),
                        ("handler", pa.string()),
                        ("duration", pa.float64()),
                        ("samples", pa.int64()),
                        ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
                    ]
                )
            ),
        ),
        ("error", pa.string()),
    ]
)


def facts_of(track: dict) -> dict:
    """What a table keeps of a track; ``keyframes`` are (offset, length) of its sync samples."""
    return {
        "track_id": track["track_id"],
        "codec": track["codec"],
        "handler": track["handler"],
        "duration": track["duration"] / track["timescale"] if track["timescale"] else None,
        "samples": len(track["sizes"]),
        "keyframes": list(zip(track["places"][track["keys"]].tolist(), track["sizes"][track["keys"]].tolist(), strict=True)),
    }


def _facts(media: bytes | None) -> dict:
    if not media:
        return {"tracks": None, "error": "empty"}
    try:
        tracks = [facts_of(t) for t in probe(media)]
    except (ValueError, OverflowError, struct.error, IndexError) as e:
        return {"tracks": None, "error": str(e)[:200]}
    for t in tracks:
        t["keyframes"] = [{"offset": a, "length": b} for a, b in t["keyframes"]]
    return {"tracks": tracks, "error": None if tracks else "no track"}


def media_columns(df: DataFrame, column: str = "media", out: str = "facts") -> DataFrame:
    """``df`` with a struct of error and tracks: id, codec, handler, duration (s), samples and keyframe byte ranges of each."""
    kind = T.StructType.fromDDL(f"{out} {MEDIA}")

    def work(batches):
        for batch in batches:
            media = plain(batch.column(column))
            kept = [i for i, c in enumerate(batch.schema.names) if c != out]
            for a, b in slices(media):
                rows = batch.slice(a, b - a)
                facts = pa.array([_facts(m) for m in media.slice(a, b - a).to_pylist()], _ARROW_FACTS)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), facts], names=[*(rows.schema.names[i] for i in kept), out])

    return df.mapInArrow(work, T.StructType([*(f for f in df.schema.fields if f.name != out), *kind.fields]))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the file that holds each text, padded with spaces to a positive multiple of ``UNIT``."""

    def work(batches):
        for batch in batches:
            texts = plain(batch.column("text"))
            for a, b in slices(texts):
                raw = [t.encode() for t in texts.slice(a, b - a).to_pylist()]
                files = [mux(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b" ")) for t in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in raw], pa.int64()), pa.array(files, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id bigint, n_bytes bigint, media binary")


_OUT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _read_back(batches):
    for batch in batches:
        files = batch.column("media")
        for a, b in slices(files):
            rows = []
            for media in files.slice(a, b - a).to_pylist():
                track = probe(media)[0]
                payload = read_samples(media, track)
                feature = json.dumps(facts_of(track) | {"ticks": track["ticks"]}, sort_keys=True, separators=(",", ":"))
                digest = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()
                rows.append((len(payload), *digest, feature))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )


def op9_iso_media(spark, sf_dir: str) -> DataFrame:
    """What is read back from each document's stored form, with codec, duration and keyframe ranges as feature."""
    return store(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(_read_back, _OUT)
