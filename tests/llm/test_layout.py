"""Sharding, mixing, chat formatting, the pipeline, and SQL against DuckDB."""

import json
import math
import os
import zlib
from collections import Counter

import duckdb
import pytest

from lakemill.llm import mixing, queries, ranks, sharding, tool_calls
from tests.llm.conftest import ODD, SF


def test_sharding(odd, empty):
    rows = sharding.shard(odd, shards=4).collect()
    assert len(rows) == len(ODD)
    text = {i: (t or "").encode() for i, t, _ in ODD}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
    by = {k: [r for r in rows if r.shard == k] for k in range(4)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    for source in {r.source for r in rows}:
        counts = [sum(r.source == source for r in v) for v in by.values()]
        assert max(counts) - min(counts) <= 2
    assert sharding.shard(empty).count() == 0
    twice = [tuple(r) for r in sharding.shard(odd.repartition(7), shards=4).orderBy("doc_id").collect()]
    assert twice == [tuple(r) for r in sharding.shard(odd, shards=4).orderBy("doc_id").collect()]


def test_ranks_of_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat('s', id % 50), 'hot') as g").withColumn("key", ranks.shuffle_key(1, "doc_id"))
    df = df.withColumn("piece", ranks.range_of_key(df.key, 16))
    rows = ranks.ranked(df, ["g"], "piece", ["key", "doc_id"]).collect()
    for g in {r.g for r in rows}:
        own = sorted((r.key, r["rank"]) for r in rows if r.g == g)
        assert [k for _, k in own] == list(range(len(own))) and {r.total for r in rows if r.g == g} == {len(own)}


@pytest.mark.parametrize(
    "weights",
    [{"a": 1}, {"a": 0.5, "b": 0.5}, {"a": 7, "b": 2, "c": 2.5}, {f"s{i}": 1 + i * i % 37 for i in range(25)}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "d": 0.0001}, {"hot": 0.99, **{f"s{i}": 0.000002 for i in range(500)}}],
)
def test_schedule_stays_within_a_block_of_the_asked_weights(weights):
    slots = 100_000
    total = sum(weights.values())
    whole = mixing.whole_weights(weights)
    plan = mixing.schedule(whole, {s: math.ceil(slots * w / total) + 3 for s, w in weights.items()})
    done = dict.fromkeys(weights, 0)
    for n, (source, j, slot) in enumerate(plan[:slots]):
        done[source] += 1
        assert done[source] == j and slot == n
        # a source's distance only grows while it waits, so it is looked at when it runs, before and after
        share = weights[source] / total
        assert abs(j - share * (slot + 1)) < 1 + 1e-6 and abs(j - 1 - share * slot) < 1 + 1e-6
    assert all(abs(done[s] - slots * w / total) < 1 + 1e-6 for s, w in weights.items())


def test_schedule_of_sources_that_run_out():
    plan = mixing.schedule({"a": 1, "b": 3}, {"a": 5, "b": 3})
    assert [p[:2] for p in plan if p[0] == "a"] == [("a", j) for j in range(1, 6)] and len(plan) == 8
    assert [p[2] for p in plan] == sorted({p[2] for p in plan})
    assert mixing.schedule({}, {}) == []


def test_mixing(spark, odd, empty):
    rows, blocks = mixing.mix(odd, block_rows=1)
    assert rows.count() == blocks == len(ODD) and mixing.mix(empty)[0].count() == 0
    assert mixing.mixed_order(odd).columns == odd.columns
    df = spark.range(900).selectExpr("id as doc_id", "case when id % 9 < 6 then 'big' when id % 9 < 8 then 'mid' end as source")
    rows = mixing.mix(df, {"big": 1, "mid": 3}, block_rows=5)[0].orderBy("_mix_seq", "_mix_rank").collect()
    assert len(rows) == 900 and len({r.doc_id for r in rows}) == 900
    count = {"big": 0, "mid": 0}
    for n, r in enumerate(rows, 1):
        if not r._mix_on_target:
            break
        count[r.source] += 1
        assert abs(count["big"] - n / 4) < 5 and abs(count["mid"] - 3 * n / 4) < 5
    assert n >= 260 and rows[-1].source is None  # no weight: after the others
    assert {r._mix_weight for r in rows} == {0.25, 0.75, 0.0}
    twice = df.unionAll(df.limit(20))  # repeated rows
    assert mixing.mix(twice)[0].count() == 920


def test_mixing_of_many_sources(spark):
    """Sources past the largest share one place in the schedule; each keeps its pace there."""
    df = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 200)) as source")
    rows, blocks = mixing.mix(df, most_sources=2, block_rows=1)
    rows = rows.orderBy("_mix_seq", "_mix_rank").collect()
    assert len(rows) == blocks == 6000 and len({r.doc_id for r in rows}) == 6000
    n = Counter(r.source for r in rows)
    total = sum(math.sqrt(x) for x in n.values())
    seen = Counter()
    for at, r in enumerate(rows, 1):
        if not r._mix_on_target:
            break
        seen[r.source] += 1
        if at % 100 == 0:
            assert abs(seen["hot"] - math.sqrt(n["hot"]) / total * at) < 1.01
            assert all(abs(seen[s] - math.sqrt(n[s]) / total * at) < 4 for s in n if s != "hot")
    assert at > 3000
    half = mixing.mix(df, {"hot": 1.0}, most_sources=2)[0].orderBy("_mix_seq", "_mix_rank").collect()
    assert [r.source for r in half[:2000]] == ["hot"] * 2000 and len(half) == 6000


def test_blocks_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    df = spark.range(1000).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    rows, blocks = mixing.mix(df)
    assert blocks <= 53 and rows.agg({"_mix_block": "max"}).first()[0] < 18


def test_mixed_order_is_the_order(spark):
    df = spark.range(500).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    want = [r.doc_id for r in mixing.mix(df)[0].orderBy("_mix_slot", "_mix_rank").collect()]
    assert [r.doc_id for r in mixing.mixed_order(df).collect()] == want


SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "o": {"enum": ["u", "v"]}}, "additionalProperties": False}}


def test_schemas():
    ok = tool_calls.violations({"x": 1, "o": "u"}, SCHEMAS["f"])
    assert ok == []
    assert tool_calls.violations({"x": -1}, SCHEMAS["f"]) == ["$.x: out of bounds"]
    assert len(tool_calls.violations({"o": "w", "z": True}, SCHEMAS["f"])) == 3
    assert tool_calls.violations([1, "a"], {"type": "array", "items": {"type": ["integer", "null"]}, "maxItems": 1}) == ["$[1]: not ['integer', 'null']", "$: length"]
    assert tool_calls.violations(True, {"type": "integer"}) and not tool_calls.violations(2.0, {"type": "integer"})


def calls(*items):
    return json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": a} for i, a in items]})


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hi é \"q\" \n"),
        (1, 1, "assistant", calls(("a", {"x": 1}), ("b", {"x": {"$ref": "c"}}), ("z", '{"x": "s"}'))),
        (1, 2, "tool", '{"tool_call_id":"a","content":{"b":1,"a":[1,2]}}'),
        (1, 3, "assistant", calls(("c", {"x": 2}), ("p", {"x": {"$ref": "q"}}), ("q", {"x": {"$ref": "p"}}), ("n", {"x": {"$ref": "nope"}}))),
        (1, 4, "tool", '{"tool_call_id":"c","content":5}'),
        (1, 5, "tool", '{"tool_call_id":"b","content":6}'),
        (1, 6, "tool", '{"tool_call_id":"b","content":7}'),
        (1, 7, "tool", '{"tool_call_id":"zz","content":6}'),
        (1, 8, "tool", "{broken"),
        (2, 0, "assistant", calls(("a", {"x": 1}))),  # the same id in another conversation
        (None, 1, "user", None),
        (3, None, None, ""),
        (4, 0, "user", None),
        (4, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = tool_calls.link(df, SCHEMAS, implicit=False).collect()
    assert len(out) == 19
    for r in out:
        assert tool_calls.canonical(json.loads(r.message)) == r.message
    one = {(r.call_id, r.kind, r.turn): r for r in out if r.conv_id == 1}
    status = {k[0] + k[1][0] + str(k[2]): (r.status, r.valid) for k, r in one.items() if k[0]}
    assert status == {
        "ac1": ("linked", True), "ar2": ("linked", True), "bc1": ("linked", True), "br5": ("linked", True), "br6": ("duplicate", True), "cc3": ("linked", True),
        "cr4": ("linked", True), "zc1": ("unanswered", False), "pc3": ("unanswered", False), "qc3": ("unanswered", False), "nc3": ("unanswered", False), "zzr7": ("orphan", True),
    }
    at = {k: r.position for k, r in one.items()}
    assert sorted(at.values()) == list(range(len(at)))
    assert at["c", "call", 3] < at["c", "result", 4] < at["b", "call", 1] < at["b", "result", 5]
    assert next(r for r in out if r.conv_id == 2).status == "unanswered"
    assert tool_calls.link(df.where("false")).count() == 0


def test_plain_conversations(spark):
    out = tool_calls.op10_tool_calls(spark, SF).collect()
    talk = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    assert len(out) == len(talk)
    for r in out:
        body = json.loads(r.message)["body"]
        assert (body["text"] if r.kind == "call" else body) == talk[r.conv_id, r.turn].text
        if r.kind == "result":
            assert (r.status == "linked") == (getattr(talk.get((r.conv_id, r.turn - 1)), "role", None) == "user")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    n = [f.count() for f in frames]
    assert n[0] >= n[1] >= n[2] == n[3] == n[4] == n[5] > 0
    assert len({r.doc_id for r in frames[-1].collect()}) == n[-1]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in frames[-1].collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
