"""Hot keys, loose clusters and recall of candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.llm import blocks, components, minhash, skew


@pytest.mark.parametrize("how", ["inner", "left"])
def test_keyed_join(spark, how):
    left = spark.range(6000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, 8, id)) as k", "id as v")
    right = spark.range(0, 6000, 2).selectExpr("id as k", "id * 10 as w").where("k != 8")
    key = lambda r: (r.k, r.v)
    got = sorted((tuple(r) for r in skew.keyed_join(left, right.unionAll(spark.createDataFrame([(7, 1)], "k bigint, w bigint")), "k", how=how).collect()), key=str)
    want = sorted((tuple(r) for r in left.join(right.unionAll(spark.createDataFrame([(7, 1)], "k bigint, w bigint")), "k", how).collect()), key=str)
    assert got == want and len(got) >= 2000 and key


def test_hot_keys_take_no_python_workers(spark):
    """Rows of hot keys come from the driver as they are; a list would be an RDD that Python workers make rows of."""
    left = spark.range(3000).selectExpr("if(id < 2000, 7, id) as k", "concat('s', id % 2) as s", "id as v")
    right = spark.range(3000).selectExpr("id as k", "'s1' as s", "id * 10 as w")
    joined = skew.keyed_join(left, right, "k", "s")
    assert "ExistingRDD" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, ["k", "s"]).collect()))


def test_only(spark):
    rows = spark.createDataFrame([(i, "t") for i in (1, 2, None, 4, 4)], "doc_id bigint, text string")
    ids = spark.createDataFrame([(4,), (None,), (4,), (9,)], "x bigint")
    for most in (0, 100):
        assert [r.doc_id for r in skew.only(rows, ids, "doc_id", most=most).collect()] == [4, 4]
        assert {r.doc_id for r in skew.only(rows, ids, "doc_id", "left_anti", most=most).collect()} == {1, 2, None}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 10)
    links = spark.range(3000).selectExpr("id + 1 as a", "0L as b").unionAll(spark.range(3000).selectExpr("id + 10000 as a", "99999L as b"))
    rows = {r.id: r.component for r in components.connected_components(links).collect()}
    assert rows == {**dict.fromkeys(range(3001), 0), **dict.fromkeys([*range(10000, 13000), 99999], 10000)}


def test_the_fingerprint_of_edges_cannot_overflow(spark):
    forged = spark.range(4).selectExpr("9223372036854775807L as h")
    assert forged.agg(F.bit_xor("h")).first()[0] == 0


def _described(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return blocks.checkpointed(df.mapInArrow(minhash._describe, minhash._DESCRIBED))


def test_boilerplate_chains_nothing(spark):
    """Documents that share 60 % of their shingles fill common buckets; they make no clusters, and no more rows."""
    random = np.random.default_rng(8)
    common = " ".join(f"c{i}" for i in range(240))
    doc = lambda i: (i, common + " " + " ".join(f"u{x}" for x in random.integers(0, 10**9, 150)))
    for n in (200, 400):
        reps = _described(spark, [doc(i) for i in range(n)])
        banded = reps.select("doc_id", F.explode("bands").alias("key"))
        assert banded.groupBy("key").count().where("count > 2").count() > 10
        assert minhash.candidate_edges(reps, 85).count() == 0
    copies = [(1000 + i, doc(i // 4)[1] if i % 4 == 0 else None) for i in range(40)]
    copies = [(i, t if t else copies[k - k % 4][1] + f" x{k}") for k, (i, t) in enumerate(copies)]
    clusters = components.connected_components(minhash.candidate_edges(_described(spark, copies), 85))
    assert {r.n for r in clusters.groupBy("component").agg(F.count("*").alias("n")).collect()} == {4} and clusters.count() == 40


@pytest.mark.parametrize("percent", [85, 80])
def test_recall_near_the_limit(spark, percent):
    """Pairs whose similarity is at the limit to 6 % above it: all are candidates."""
    random = np.random.default_rng(percent)
    docs, linked = [], 0
    for pair in range(300):
        n = int(random.integers(30, 400))
        words = [f"p{pair}w{i}" for i in range(n)]
        sets = [" ".join(words)]
        other, want = list(words), percent / 100 + random.random() * 0.06
        while True:
            changed = list(other)
            changed[random.integers(0, n)] = f"e{random.integers(0, 10**9)}"
            a, b = ({tuple(w[k : k + 5]) for k in range(n - 4)} for w in (words, changed))
            if len(a & b) < want * len(a | b):
                break
            other = changed
        if other != words:
            linked += 1
            docs += [(2 * pair, sets[0]), (2 * pair + 1, " ".join(other))]
    edges = {tuple(sorted(r)) for r in minhash.candidate_edges(_described(spark, docs), percent).collect()}
    assert linked > 200 and edges == {(i, i + 1) for i, _ in docs if i % 2 == 0}


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text of some six words"), (3, "short text of some six words")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert len(long) > 2 << 20 and got == [(1, 399_996, 1), (2, 399_997, 1), (3, 2, 3), (3, 2, 3)]


def test_messages_over_hubs(spark, monkeypatch):
    from lakemill.llm import substring_dedup
    from tests.llm.test_dedup import cut, found

    random = np.random.default_rng(5)
    docs = [(int(i), " ".join(random.choice(["a", "b", "c"], random.integers(0, 150)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 700)
    for most in (10**9, 1):
        monkeypatch.setattr(blocks, "MOST_MESSAGES", most)
        assert found(substring_dedup.substring_dedup(df, 7)) == cut(docs, 7)


def test_the_shared_folder_is_demanded_on_a_cluster():
    class Spark:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, other=None: {"spark.sql.warehouse.dir": "/local/warehouse"}.get(key, other))

    with pytest.raises(ValueError):
        blocks.shared_folder(Spark)
    Spark.conf.get = staticmethod(lambda key, other=None: {"spark.checkpoint.dir": "hdfs://x/y/"}.get(key, other))
    assert blocks.shared_folder(Spark) == "hdfs://x/y"
