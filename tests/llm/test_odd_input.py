"""Input that is legal and unusual: long runs, deep nesting, surrogates, clashing names, claimed sizes."""

import hashlib
import json
import random
import struct

import numpy as np
import public_tokenizers
import pytest

from lakemill.llm import byte_bpe, iso_media, tool_calls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BIG = 3 << 20  # more than a slice


def test_bpe_of_long_runs(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, " " * 300_000 + "a", "a" + "\t\n" * 200_000 + "b  c", "x" * BIG, "word one " * 400_000, "\x1c" * 9000 + " b", " " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in byte_bpe.digest(df, *RANKS).collect()}
    for i, t in enumerate(texts):
        assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and rows[i].n_tokens > 0
    whole = byte_bpe.load(*RANKS)
    for i in (4, 5, 6, 7):
        ids = np.array(whole.encode_ordinary(texts[i]), "<u4")
        assert rows[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()


def test_bpe_of_long_runs_as_the_library(monkeypatch):
    whole = byte_bpe.load(*RANKS)
    monkeypatch.setattr(byte_bpe, "_LONG", byte_bpe.re.compile(f"[{byte_bpe._WHITE}]{{2,}}"))
    random.seed(4)
    for _ in range(400):
        text = "".join(random.choice(["a", " ", "  ", "\n", "\n\n", "é", "1", "'s", "　", "\x85", "\x1c", "​", " b", "    "]) for _ in range(60))
        ids = np.array(whole.encode_ordinary(text), "<u4").tobytes()
        assert byte_bpe.encode_text(whole, text) == ids


def test_bpe_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b", "old", "older")], "doc_id bigint, text string, ids string, decoded string")
    out = byte_bpe.decode(byte_bpe.encode(df, *RANKS), *RANKS)
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "text"] and bytes(out.first().decoded) == b"a b"


def _fragmented() -> tuple[bytes, bytes]:
    """A movie without samples, a fragment with two of four and six bytes, and what they hold."""
    box, full = iso_media._box, iso_media._full
    entry = box(b"avc1", bytes(78))
    none = struct.pack(">I", 0)
    tables = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", none), full(b"stsc", none), full(b"stsz", none, none), full(b"stco", none))
    media = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 10, 0), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", tables))
    track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60)), media)
    trex = full(b"trex", struct.pack(">IIIII", 7, 1, 5, 0, 0x10000))
    movie = box(b"moov", track, box(b"mvex", trex), box(b"udta", box(b"name", b"x"), bytes(4)))

    def moof(offset):
        run = full(b"trun", struct.pack(">IiIII", 2, offset, 0, 4, 6), flags=0x205)
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run))

    part = moof(len(moof(0)) + 8)
    return box(b"ftyp", b"iso5") + movie + part + box(b"mdat", b"key!delta6"), b"key!delta6"


def test_media_fragments(spark):
    media, held = _fragmented()
    (track,) = iso_media.probe(media)
    assert iso_media.read_samples(media, track) == held
    facts = iso_media.facts_of(track)
    assert facts == {"track_id": 7, "codec": "avc1", "handler": "vide", "duration": 1.0, "samples": 2, "keyframes": [(media.index(b"key!"), 4)]}


def test_media_all_tracks_and_clash(spark):
    media = iso_media.mux(b"a" * 192)
    at = media.index(b"moov") - 4
    track = media[media.index(b"trak") - 4 :]
    two = media[:at] + struct.pack(">I", struct.unpack(">I", media[at : at + 4])[0] + len(track)) + media[at + 4 :] + track
    df = spark.createDataFrame([(bytearray(two), "old")], "media binary, facts string")
    (row,) = iso_media.media_columns(df).collect()
    assert row.facts.error is None and len(row.facts.tracks) == 2 and row.facts.tracks[1].samples == 1


def test_media_damage():
    media = iso_media.mux(bytes(range(192)) * 70)
    deep = b""
    for _ in range(3000):
        deep = iso_media._box(b"moov", deep)
    assert "deep" in iso_media._facts(deep)["error"]
    at = media.index(b"stsz") + 8
    for fixed, count in ((192, 60_000_000), (1, 0xFFFFFFFF), (192, 71), (0, 70)):
        broken = media[:at] + struct.pack(">II", fixed, count) + media[at + 8 :]
        assert iso_media._facts(broken)["error"]
    random.seed(2)
    whole, _ = _fragmented()
    for source in (media, whole):
        for _ in range(1500):
            raw = bytearray(source)
            for _ in range(random.randint(1, 6)):
                raw[random.randrange(len(raw))] = random.choice([0, 1, 255, random.randrange(256)])
            iso_media._facts(bytes(raw[: random.choice([len(raw), random.randrange(1, len(raw))])]))


def test_json_that_is_odd(spark):
    call = lambda a: json.dumps({"tool_calls": [{"id": "x", "name": "f", "arguments": a}]})
    deep = "[" * 2000 + "]" * 2000
    rows = [
        (1, 0, "assistant", call('{"a": "\\ud800"}')),
        (2, 0, "assistant", '{"tool_calls": [{"id": "\\udfff", "name": "f", "arguments": {}}]}'),
        (3, 0, "assistant", call('{"a": %s}' % deep)),
        (4, 0, "assistant", '{"tool_calls": [{"id": 1, "name": "f", "arguments": %s}]}' % deep),
        (5, 0, "assistant", call('{"a": NaN}')),
        (6, 0, "assistant", call('{"a": 1e999}')),
        (7, 0, "tool", '{"tool_call_id": "x", "content": "' + "é" * BIG + '"}'),
        (None, 3, "user", "no conversation"),
        (0, 3, "user", "conversation 0"),
        (-1, 3, "user", "conversation -1"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in tool_calls.link(df, {"f": {"type": "object"}}, implicit=False).collect()}
    assert all(tool_calls.canonical(json.loads(r.message)) == r.message for r in out.values())
    assert out[1].valid and json.loads(out[1].message)["body"] == {"a": "\ud800"} and out[2].call_id == "\\udfff"
    assert [out[i].error for i in (3, 5, 6)] == ["arguments are not JSON"] * 3 and out[4].kind == "plain"
    assert all(out[i].position == 0 for i in (None, 0, -1)) and len(out[7].message) > BIG


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"const": 1}, [1, 1.0], [True, 2]),
        ({"pattern": "^a+$"}, ["aa", 3], ["b"]),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 4], [2]),
        ({"oneOf": [{"type": "number"}, {"minimum": 3}]}, [1], [4]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1], [3]),
        ({"not": {"type": "null"}}, [1], [None]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 2}, [1.5], [1, 2]),
        ({"multipleOf": 0.1}, [0.3, 2], [0.25]),
        ({"uniqueItems": True}, [[1, True, "1"]], [[1, 1.0]]),
        ({"minProperties": 1}, [{"a": 1}], [{}]),
        ({"$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}}}}, "$ref": "#/$defs/n"}, [{"next": {"next": {}}}], [{"next": 1}]),
        ({"items": False}, [[]], [[1]]),
    ],
)
def test_schema_keywords(schema, good, bad):
    tool_calls.check_schema(schema)
    assert not any(tool_calls.violations(x, schema) for x in good) and all(tool_calls.violations(x, schema) for x in bad)


@pytest.mark.parametrize("schema", [{"dependentRequired": {}}, {"properties": {"a": {"type": "text"}}}, {"$ref": "http://elsewhere"}])
def test_schemas_that_cannot_be_checked(schema):
    with pytest.raises(ValueError):
        tool_calls.check_schema(schema)


def _by_hand(rows, schemas):
    """Status, error and order of every event, conversation by conversation, from the rules."""
    out = {}
    for conv in {r[0] for r in rows}:
        events = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            value = json.loads(text)
            if role == "assistant":
                events += [[turn, k, "call", c["id"], c["arguments"]] for k, c in enumerate(value["tool_calls"])]
            else:
                events.append([turn, 0, "result", value["tool_call_id"], None])
        first = {}
        for e in events:
            first.setdefault((e[2], e[3]), e)
        calls = {i: e for (kind, i), e in first.items() if kind == "call"}
        refs = {i: {v["$ref"] for v in e[4].values() if isinstance(v, dict)} for i, e in calls.items()}
        ready, depth, state = {}, {}, {}
        for i, r in refs.items():
            if not r or not r <= set(calls):
                ready[i], depth[i], state[i] = calls[i][0], 0, "unknown reference" if r else ""
        while True:
            new = [i for i, r in refs.items() if i not in ready and r <= set(ready)]
            for i in new:
                after = [max(ready[x], first["result", x][0] if ("result", x) in first else ready[x]) for x in refs[i]]
                ready[i], depth[i], state[i] = max(calls[i][0], *after), 2 + max(depth[x] for x in refs[i]), ""
            if not new:
                break
        for i in set(refs) - set(ready):
            ready[i], depth[i], state[i] = calls[i][0], 0, "cycle"
        keyed = []
        for turn, seq, kind, i, _ in events:
            mine = first[kind, i]
            other = "result" if kind == "call" else "call"
            status = "duplicate" if mine[:2] != [turn, seq] else "linked" if (other, i) in first else "unanswered" if kind == "call" else "orphan"
            keyed.append(((max(turn, ready.get(i, turn)), depth.get(i, 0) + (kind == "result"), turn, seq), status, (conv, turn, seq)))
        for at, (_, status, key) in enumerate(sorted(keyed)):
            out[key] = (status, at)
    return out


@pytest.mark.parametrize("most_calls", [100_000, 3])
def test_generated_conversations(spark, monkeypatch, most_calls):
    random.seed(9)
    rows = []
    for conv in range(300 if most_calls > 3 else 25):
        ids = [f"c{k}" for k in range(random.randint(1, 9))]
        for turn in range(random.randint(1, 14)):
            if random.random() < 0.6:
                args = lambda: {k: {"$ref": random.choice([*ids, *ids, "zz"])} if random.random() < 0.4 else 1 for k in "ab"[: random.randint(1, 2)]}
                text = {"tool_calls": [{"id": random.choice(ids), "name": "f", "arguments": args()} for _ in range(random.randint(1, 3))]}
                rows.append((conv, turn, "assistant", json.dumps(text)))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": random.choice(ids), "content": turn})))
    ordered = tool_calls._ordered
    monkeypatch.setattr(tool_calls, "_ordered", lambda found: ordered(found, most_calls))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn, r.seq): (r.status, r.position) for r in tool_calls.link(df, {"f": True}, implicit=False).collect()}
    assert got == _by_hand(rows, {}) and len(got) > (2000 if most_calls > 3 else 100)


def test_a_long_chain_of_references(spark):
    chain = [(1, k, "assistant", json.dumps({"tool_calls": [{"id": str(k), "name": "f", "arguments": {"a": {"$ref": str(k + 1)}} if k < 1500 else {}}]})) for k in range(1501)]
    df = spark.createDataFrame(chain, "conv_id bigint, turn bigint, role string, text string")
    out = {r.call_id: r.position for r in tool_calls.link(df, {"f": True}, implicit=False).collect()}
    assert [out[str(k)] for k in range(1501)] == list(range(1500, -1, -1))
