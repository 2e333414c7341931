"""The schedule dealt out to tasks: the same slots as one source and one block after another, for any number of them."""

import math
from collections import Counter

import pytest

from lakemill.llm import mixing, pfair

TABLES = {
    "many sources": "if(id % 4 = 0, 'hot', concat('s', id % 1500))",
    "one row each": "concat('s', id)",
    "equal": "concat('s', id % 1250)",
    "few": "if(id % 10 < 6, 'big', if(id % 10 < 9, 'mid', if(id % 20 = 9, 'small', null)))",
}


def check(docs, weights=None, block_rows=4):
    """All rows of ``mix`` against the plain schedule of every source."""
    rows, blocks = mixing.mix(docs, weights, block_rows)
    rows = rows.collect()
    name = lambda s: "" if s is None else f"s{s}"
    n = Counter(name(r.source) for r in rows)
    known = n if weights is None else {s: k for s, k in n.items() if weights.get(s[1:], 0) > 0 and s}
    whole = {s: math.isqrt(k * 10**12) for s, k in n.items()} if weights is None else mixing.whole_weights({s: weights[s[1:]] for s in known})
    plan = mixing.schedule(whole, {s: -(-n[s] // block_rows) for s in known})
    want = {(s, j - 1): (slot, seq) for seq, (s, j, slot) in enumerate(plan)}
    total = sum(whole.values())
    late = [r for r in rows if name(r.source) not in known]
    for r in rows:
        if name(r.source) in known:
            assert (r._mix_slot, r._mix_seq) == want[name(r.source), r._mix_rank // block_rows]
            assert r._mix_block == r._mix_rank // block_rows and r._mix_weight == whole[name(r.source)] / total
    assert sorted(r._mix_rank for r in late) == list(range(len(late)))
    assert all(r._mix_slot == plan[-1][2] + 1 + r._mix_rank // block_rows and r._mix_weight == 0 for r in late)
    assert blocks == len(plan) + -(-len(late) // block_rows) and len(rows) == docs.count()
    return rows


@pytest.mark.parametrize("kind", TABLES)
def test_each_source_has_its_own_place(spark, monkeypatch, kind):
    monkeypatch.setattr(pfair, "STEP", 150)
    monkeypatch.setattr(mixing, "DRIVER_BLOCKS", 300, raising=False)
    docs = spark.range(5000).selectExpr("id as doc_id", f"{TABLES[kind]} as source")
    rows = check(docs, block_rows=4 if kind != "few" else 1)
    assert len({r.doc_id for r in rows}) == 5000


def test_given_weights(spark, monkeypatch):
    monkeypatch.setattr(pfair, "STEP", 100)
    monkeypatch.setattr(mixing, "DRIVER_BLOCKS", 10, raising=False)
    docs = spark.range(3000).selectExpr("id as doc_id", f"{TABLES['few']} as source")
    check(docs, {"big": 0.1, "mid": 1e-9, "absent": 3.0}, 2)  # small and the null source: after the others
    check(docs, {"small": 1 / 3, "big": 1e12, "mid": 0.0}, 1)


def test_blocks_keep_their_rows(spark):
    """Past 400,000 rows too."""
    docs = spark.range(400_040).selectExpr("id as doc_id", "if(id % 5 < 4, 'a', 'b') as source")
    rows, blocks = mixing.mix(docs)
    most = {r.source: r.b for r in rows.groupBy("source").agg({"_mix_block": "max"}).toDF("source", "b").collect()}
    assert blocks == 100_010 and most == {"a": 80_007, "b": 20_001}


def test_groups_stay_small():
    """Cuts where very many blocks are released or due at once: what a task gets does not grow with the sources."""
    weights, blocks, step = {f"s{i:04}": 1 + i % 2 for i in range(3000)}, 5, 100
    classes = [(1, blocks, 1500), (2, blocks, 1500)]
    starts, marks = pfair.cuts(classes, step)
    names = sorted(weights)[::25]
    work = pfair._released(lambda s, n: weights[s], 4500, 1, step, starts, marks, names)
    batch = pfair._table([(s, blocks, 0) for s in weights], "s string, n bigint, part bigint")
    rows = [r for b in work([batch]) for r in b.to_pylist()]
    assert len(rows) == 15_000
    assert max(Counter(r["piece"] for r in rows if r["kind"] != pfair.START).values(), default=0) <= 2 * step
    assert max(Counter(r["bin"] for r in rows).values()) <= 2 * step
