"""The learned operators against plain re-implementations, the pipeline against a plain run, and odd tables."""

import hashlib
import math
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakemill.llm import byte_bpe, mixing, nbsvm, quality_rules
from tests.llm.conftest import ODD, SF
from tests.llm.test_dedup import components, words
from tests.llm.test_text import brute

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def dense_model(texts, labels):
    """The same model by dense matrices and another solver's steps in the same order."""
    x = np.zeros((len(texts), nbsvm.DIMENSIONS))
    for i, t in enumerate(texts):
        x[i, nbsvm.indicators(pa.array([t]))[0]] = 1
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    p, q = 1 + x[y > 0].sum(axis=0), 1 + x[y < 0].sum(axis=0)
    r = np.log((p / p.sum()) / (q / q.sum()))
    z = x * r
    z /= np.maximum(np.sqrt((z**2).sum(axis=1)), 1e-6)[:, None]
    z = np.hstack([z, np.ones((len(z), 1))])
    top = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    a, w = np.zeros(len(y)), np.zeros(z.shape[1])
    random = np.random.default_rng(nbsvm.SEED)
    for _ in range(nbsvm.EPOCHS):
        for i in random.permutation(len(y)):
            g = y[i] * (w @ z[i]) - 1
            new = np.clip(a[i] - g / (z[i] @ z[i]), 0, top[i])
            w += (new - a[i]) * y[i] * z[i]
            a[i] = new

    def margin(t):
        v = np.zeros(nbsvm.DIMENSIONS)
        v[nbsvm.indicators(pa.array([t]))[0]] = 1
        v *= r
        return w[:-1] @ v / max(np.sqrt(v @ v), 1e-6) + w[-1]

    return margin


def test_nbsvm_by_dense_matrices(spark):
    """Scores of the operator, from the text on, are those of a dense re-implementation."""
    random = np.random.default_rng(1)
    rows = []
    for i in range(18):  # too few for the second fit, so the curve's slope is the default
        good = i % 2
        rows.append((i, " ".join(random.choice(["apple", "pear", "plum"] if good else ["rust", "nail", "iron"], 12)) + f" shared words {i % 3}", good))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = nbsvm.train(df, df.select("doc_id", "label"))
    got = {r.doc_id: r.score for r in nbsvm.score(df, model).collect()}
    packed = sorted((lab, p) for (_, t, lab) in rows for p in [b"i" + nbsvm.indicators(pa.array([t]))[0].tobytes()])
    order = np.random.default_rng(nbsvm.SEED).permutation(len(rows))
    by_pack = {b"i" + nbsvm.indicators(pa.array([t]))[0].tobytes(): t for _, t, _ in rows}
    margin = dense_model([by_pack[packed[k][1]] for k in order], [packed[k][0] for k in order])
    for i, t, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-4.0 * margin(t))), abs=2e-4)


def test_nbsvm_odd_tables(spark, odd, empty):
    random = np.random.default_rng(2)
    huge = "".join(map(chr, random.integers(33, 0x2000, 60_000)))
    numbers, bounds = nbsvm.indicators(pa.array([huge]))
    (packed,) = next(nbsvm._pack([pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([huge])], names=["label", "text"])])).column("numbers").to_pylist()
    assert packed[:1] == b"b" and len(packed) <= nbsvm.DIMENSIONS // 8 + 1 and nbsvm._unpack(packed).tolist() == numbers.tolist()
    labels = odd.selectExpr("doc_id", "cast(doc_id % 2 as int) as label")
    assert nbsvm.score(empty, nbsvm.train(empty, labels)).count() == 0
    twice = odd.unionAll(odd).withColumn("score", F.lit("clash")).withColumn("label", F.lit(7))
    rows = nbsvm.score(twice, nbsvm.train(odd, labels.unionAll(labels.selectExpr("doc_id", "null")))).collect()
    assert len(rows) == 2 * len(ODD) and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


NAMES = list(quality_rules.RATIOS)


def ratios(text):
    n, chars, symbols, dup, repeat, _ = brute(text)
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0A\x0B\x0C\x0D")]
    div = lambda a, b: a / b if b else 0.0
    upper, marks = sum("A" <= c <= "Z" for c in text), sum(c in "!?;:" for c in text)
    return [float(n), div(chars, n), div(symbols, chars), div(dup, len(lines)), div(repeat, n), div(len(set(w)), n), div(upper, chars), div(marks, chars), div(n, len(lines))]


def list_by_hand(rows, held, cuts):
    """Sequential covering over plain rows (ratios, label): rules as lists of (statistic, at least, threshold)."""
    covers = lambda rule, x: all((x[n] >= t) == up for n, up, t in rule)
    left, rules = list(range(len(rows))), []
    while len(rules) < quality_rules.MAX_RULES:
        grow = [rows[i] for i in left if not held[i]]
        rule = []
        while len(rule) < quality_rules.MAX_CONDITIONS:
            own = [r for r in grow if covers(rule, r[0])]
            low = sum(y == 0 for _, y in own)
            if not low or low >= 0.99 * len(own):
                break
            base, best = math.log2(low / len(own)), (0.0, None)
            for n in range(len(NAMES)):
                for t in cuts[n]:
                    for up in (True, False):
                        some = [y for x, y in own if (x[n] >= t) == up]
                        p = sum(y == 0 for y in some)
                        if p >= quality_rules.LEAST_COVER and (gain := p * (math.log2(p / len(some)) - base)) > best[0] + 1e-9:
                            best = gain, (n, up, t)
            if not best[1]:
                break
            rule.append(best[1])
        if not rule:
            break
        test = [rows[i] for i in left if held[i]]
        worth = []
        for k in range(1, len(rule) + 1):
            some = [y for x, y in test if covers(rule[:k], x)]
            worth.append((sum(y == 0 for y in some) / max(1, len(some)), -k, sum(y == 0 for y in some)))
        precision, k, covered = max(worth)
        if precision < quality_rules.LEAST_PRECISION or covered < quality_rules.LEAST_COVER:
            break
        rules.append(rule[:-k])
        left = [i for i in left if not covers(rule[:-k], rows[i][0])]
    return rules, covers


def test_the_learned_list_by_hand(spark):
    """``kept`` of every document, from a plain run of sequential covering over all labelled rows."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = quality_rules.label_rows(spark, SF)
    texts = {r.doc_id: r.text for r in table.collect()}
    seed = {r.doc_id: r.h for r in table.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("h")).collect()}
    marked = [(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in texts]
    rows, held = [(ratios(texts[i]), y) for i, y in marked], [seed[i] for i, _ in marked]
    # up to 1000 values the sketch is exact: the value at ceil(q n)
    at = lambda v, q: sorted(v)[max(math.ceil(q * len(v)) - 1, 0)]
    cuts = []
    for n in range(len(NAMES)):
        every, low = [x[n] for x, _ in rows], [x[n] for x, y in rows if y == 0]
        cuts.append(sorted({at(v, q) for v in (every, low) for q in quality_rules._QUANTILES}))
    rules, covers = list_by_hand(rows, held, cuts)
    got = quality_rules.learn(quality_rules.statistics(table).join(labels, "doc_id"))
    assert [[(NAMES.index(c.statistic), c.at_least, c.threshold) for c in r] for r in got] == [[(n, up, pytest.approx(t)) for n, up, t in r] for r in rules]
    for r in quality_rules.op7_quality_rules(spark, SF).collect():
        assert r.kept == (not r.base_failed and not any(covers(rule, ratios(texts[r.doc_id])) for rule in rules))


def test_rules_bounds_and_odd_rows(spark, odd):
    word = lambda i, k: f"w{i}x{k}" + ("#" if i % 3 == 0 and k < 9 else "!" if i % 5 == 0 and k < 9 else "ab"[k % 2])
    rows = [(i, " ".join(word(i, k) for k in range(20)), 0 if i % 3 == 0 or i % 5 == 0 else 1) for i in range(600)]
    df = quality_rules.statistics(spark.createDataFrame(rows, "doc_id bigint, text string, quality int"))
    assert len(quality_rules.learn(df)) >= 2 and len(quality_rules.learn(df, max_rules=1)) == 1
    assert all(len(r) == 1 for r in quality_rules.learn(df, max_conditions=1))
    long = "word " * 700_000 + "end"
    more = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(None, "no id"), (7, "a " * 300), (90, long)], "doc_id bigint, text string"))
    out = quality_rules.judged(more, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(out) == len(ODD) + 3 and next(r for r in out if r.doc_id == 90).n_repeat_words == 700_000


def plain_pipeline(docs, labels, judged):
    """The five stages over lists, each by its rule."""
    rows = [r for r in docs if r["doc_id"] in judged]
    kept = {i for i, _, _, kept in components([(r["doc_id"], r["text"]) for r in rows], 80) if kept}
    rows = [r for r in rows if r["doc_id"] in kept]
    first = {}
    for r in rows:
        w = words(r["text"])
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    texts = {}
    for r in rows:
        w = words(r["text"])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < r["doc_id"]:
                gone[k : k + 50] = [True] * 50
        texts[r["doc_id"]] = " ".join(x.decode() for x, g in zip(w, gone) if not g) if any(gone) else r["text"] or ""
    return rows, texts


def test_pipeline_by_hand(spark):
    """run()'s rows against a plain run of all five stages; only the learned list is taken as it is (it has its own test)."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    judged = {r.doc_id for r in quality_rules.op7_quality_rules(spark, SF).collect() if r.kept}
    rows, texts = plain_pipeline(docs, None, judged)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    whole = byte_bpe.load(*RANKS)
    for i, t in texts.items():
        assert bytes(got[i].ids) == np.array(whole.encode_ordinary(t), "<u4").tobytes()
    # the mixture: each source's documents in the seeded order, blocks by earliest deadline
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r["doc_id"])
    key = lambda i: (hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), i)
    blocks = {"s" + s: [v[k : k + 4] for v in [sorted(ids, key=key)] for k in range(0, len(v), 4)] for s, ids in by.items()}
    plan = mixing.schedule(mixing.whole_weights({s: mixing.root_weight(sum(map(len, b))) for s, b in blocks.items()}), {s: len(b) for s, b in blocks.items()})
    want = [i for s, j, _ in plan for i in blocks[s][j - 1]]
    assert [r.doc_id for r in sorted(got.values(), key=lambda r: r.position)] == want


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_pipeline_of_odd_tables(spark, tmp_path, kind):
    rows = [] if kind == "empty" else [(None, None, None, None, None), (1, None, "en", None, None), (2, " ".join(f"w{i}" for i in range(90)), None, "a", 9), (2, " ".join(f"w{i}" for i in range(90)), None, "a", 9), (3, "x" * 10, "en", None, 10)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got if r.doc_id] == ([] if kind == "empty" else [2, 2])
    assert sorted(r.position for r in got) == list(range(len(got)))


def test_pipeline_deletes_folders(spark):
    from lakemill.llm.blocks import shared_folder

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    names = lambda: {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    spark.range(1).write.mode("overwrite").parquet(f"{shared_folder(spark)}/tables/made")
    before = names()
    corpus_pipeline.run(spark, SF).count()
    (made,) = names() - before  # the result reads 3
    inside = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{made}")
    assert sorted(f.getPath().getName() for f in inside.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(inside)) == ["2", "3"]

