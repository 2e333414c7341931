"""BPE, media, quality models and rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lakemill.llm import byte_bpe, iso_media, katz, nbsvm, quality_rules
from tests.llm.conftest import ODD, SF, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe(odd, empty):
    rows = {r.doc_id: r for r in byte_bpe.digest(odd, *RANKS).collect()}
    whole = byte_bpe.load(*RANKS)
    for i, text, _ in ODD:
        ids = np.array(whole.encode_ordinary(text or ""), "<u4")
        r = rows[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digest(empty, *RANKS).count() == 0
    assert byte_bpe.encode(odd, *RANKS).columns == [*odd.columns, "ids"]


def test_bpe_round_trip_takes_one_worker(odd):
    """Texts are encoded and decoded in one step, so a task takes one worker with one rank table."""
    took = byte_bpe.digest(odd, *RANKS)
    assert took._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = byte_bpe.decode(byte_bpe.encode(odd, *RANKS), *RANKS).drop("text")
    one = byte_bpe.round_trip(odd, *RANKS)
    assert one.schema == two.schema and one.collect() == two.collect()
    # columns of the results' names are replaced
    named = odd.select("doc_id", "text", odd["source"].alias("decoded"), odd["block"].alias("ids"))
    assert byte_bpe.round_trip(named, *RANKS).collect() == two.select("doc_id", "ids", "decoded").collect()


def test_bpe_pieces_keep_matches():
    whole = byte_bpe.load(*RANKS)
    random.seed(1)
    for _ in range(200):
        text = "".join(random.choice(["a", " ", "  ", "\n", "é", "1", "'s", "!", "　", "\x1c", " b", " "]) for _ in range(150))
        parts = list(byte_bpe.pieces(text, 20))
        assert "".join(parts) == text
        assert [x for p in parts for x in whole.encode_ordinary(p)] == whole.encode_ordinary(text)


def test_bpe_decodes_broken_characters(spark):
    df = spark.createDataFrame([(bytearray(np.array([0, 200, 5], "<u4").tobytes()),), (None,)], "ids binary")
    got = [bytes(r.decoded) for r in byte_bpe.decode(df, *RANKS).collect()]
    assert got[0] == byte_bpe.load(*RANKS).decode_bytes([0, 200, 5]) and got[1] == b""


def test_media_round_trip(spark, odd, empty):
    stored = {r.doc_id: r for r in iso_media.store(odd).collect()}
    for i, text, _ in ODD:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        media = bytes(stored[i].media)
        track = iso_media.probe(media)[0]
        assert stored[i].n_bytes == len(raw) and iso_media.read_samples(media, track) == payload
        assert track["codec"] == "raw " and track["duration"] == len(payload) == track["ticks"]
        for k in track["keys"]:
            at = int(track["places"][k])
            assert media[at : at + 192] == payload[192 * k : 192 * k + 192]
    assert iso_media.store(empty).count() == 0


def test_media_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in iso_media.op9_iso_media(spark, SF).collect():
        raw = docs[r.doc_id]
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        media = iso_media.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())


def test_media_forms_and_damage(spark):
    media = iso_media.mux(bytes(range(192)) * 70)
    # tables in another form: one size for each sample, 64-bit chunk places, a 64-bit box size, no stss
    track = iso_media.probe(media)[0]
    assert len(track["sizes"]) == 70 and len(track["keys"]) == 5
    rows = [(media,), (None,), (b"",), (media[:-7],), (b"\0\0\0\x08free",), (media.replace(b"stsc", b"xxxx"),), (media.replace(b"stss", b"free"),)]
    out = iso_media.media_columns(spark.createDataFrame([(i, bytearray(r[0]) if r[0] is not None else None) for i, r in enumerate(rows)], "i int, media binary"))
    facts = {r.i: r.facts for r in out.collect()}
    assert facts[0].error is None and facts[0].tracks[0].samples == 70 and len(facts[0].tracks[0].keyframes) == 5
    assert facts[1].error == facts[2].error == "empty"
    assert all(facts[i].error for i in (3, 4, 5)) and len(facts[6].tracks[0].keyframes) == 70


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    seen = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    mark = [0] * n
    for i in range(n - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [1] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = sum(mark)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


def test_statistics(odd, empty):
    rows = {r.doc_id: r for r in quality_rules.statistics(odd).collect()}
    for i, text, _ in ODD:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
    assert quality_rules.statistics(empty).count() == 0


def test_rules(spark, odd):
    got = quality_rules.op7_quality_rules(spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.collect():
        assert tuple(r)[1:7] == brute(docs[r.doc_id]) and not (r.base_failed and r.kept)
    labels = odd.selectExpr("doc_id", "cast(1 as int) as quality")
    assert quality_rules.learn(quality_rules.statistics(odd).join(labels, "doc_id")) == []
    assert quality_rules.keep_good(odd, labels).columns == odd.columns


def test_rules_find_a_threshold(spark):
    rows = [(i, ("# " if i % 3 == 0 else "") * 6 + " ".join(f"word{i}x{k}" for k in range(20)), 0 if i % 3 == 0 else 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    rules = quality_rules.learn(quality_rules.statistics(df))
    assert rules and all(c.statistic in quality_rules.RATIOS for r in rules for c in r)
    kept = {r.doc_id for r in quality_rules.keep_good(df, df.select("doc_id", "quality")).collect()}
    assert kept == {i for i, _, q in rows if q}


def test_nbsvm_indicators():
    numbers, bounds = nbsvm.indicators(pa.array(["aa Bb aa Bb", "", None, "aa bb"]).fill_null(""))
    sets = [set(numbers[bounds[i] : bounds[i + 1]].tolist()) for i in range(4)]
    assert not sets[1] and not sets[2] and len(sets[0] & sets[3]) >= 3 and len(sets[0]) == bounds[1]


def test_nbsvm_against_primal():
    """The dual's solution is no worse than many steps of plain subgradient descent."""
    random = np.random.default_rng(2)
    rows = [np.unique(random.integers(0, 50, 8)) for _ in range(80)]
    y = np.array([1.0 if (r < 20).sum() > 3 else -1.0 for r in rows])
    ratio = np.ones(64)
    cost = np.ones(80)
    w, b = nbsvm.descend(rows, y, ratio, cost)
    x = np.zeros((80, 64))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
    loss = lambda w, b: (w @ w + b * b) / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()
    v, c, best = np.zeros(64), 0.0, 1e9
    for t in range(1, 6000):
        hit = y * (x @ v + c) < 1
        v -= (v - (y * hit) @ x) / (t + 50)
        c -= (c - (y * hit).sum()) / (t + 50)
        best = min(best, loss(v, c))
    assert loss(w, b) <= best * 1.03


def test_nbsvm_query(spark, odd):
    rows = nbsvm.op5_nbsvm(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) >= 0.85
    one_kind = nbsvm.train(odd, odd.selectExpr("doc_id", "1 as label"))
    assert {r.score for r in nbsvm.score(odd, one_kind).collect()} == {1.0}
    none = nbsvm.train(odd, odd.selectExpr("doc_id", "1 as label").where("false"))
    assert {r.score for r in nbsvm.score(odd, none).collect()} == {0.5}


def model(train, order):
    """Katz by dictionaries: counts of words, and a function from history (a tuple, begin marks 0) and word to probability."""
    c, grams = Counter(), {}
    for t in train:
        c.update(t)
        for k in range(2, order + 1):
            padded = [0] * (k - 1) + t
            for i, w in enumerate(t):
                grams.setdefault(tuple(padded[i : i + k - 1]), Counter())[w] += 1

    def discounts(values):
        n = Counter(values)
        return katz.discounts([0] + [n[r] for r in range(1, katz.TOP + 2)])

    d = {1: discounts(c.values())} | {k: discounts(x for h, v in grams.items() if len(h) == k - 1 for x in v.values()) for k in range(2, order + 1)}
    low = lambda k, x: (d[k][x] if x <= katz.TOP else 1) * x
    n = sum(c.values())
    total = n if any(x <= katz.TOP for x in c.values()) else n + 1
    unknown = 1 - sum(low(1, x) for x in c.values()) / total if n else 1.0

    def q(h, w):
        if not h:
            return low(1, c[w]) / total if w in c else unknown
        if h not in grams:
            return q(h[1:], w)
        seen, k = grams[h], len(h) + 1
        t = sum(seen.values())
        t = t + 1 if all(x > katz.TOP for x in seen.values()) else t
        if w in seen:
            return low(k, seen[w]) / t
        return (1 - sum(low(k, x) for x in seen.values()) / t) / (1 - sum(q(h[1:], v) for v in seen)) * q(h[1:], w)

    return c, q


@pytest.mark.parametrize("where, order", [("documents", 3), ("odd", 3), ("odd", 2), ("odd", 1), ("hot", 3), ("hot", 4), ("hubs", 3)])
def test_katz(spark, odd, monkeypatch, where, order):
    from pyspark.sql import functions as F

    if where == "documents":
        df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    elif where == "odd":  # rows that share an id, and one without, too
        df = odd.select("doc_id", "text")
        df = df.unionAll(df.where("doc_id in (7, 13)")).unionAll(spark.createDataFrame([(None, "w1 w2 w3 no id")], "doc_id bigint, text string"))
    else:  # one history holds half of all tokens, and goes to several buckets
        df = spark.createDataFrame([(i, " ".join(f"the w{(i * k) % 97}" for k in range(40))) for i in range(60)], "doc_id bigint, text string")
    if where == "hubs":
        monkeypatch.setattr(katz.B, "BLOCK_BYTES", 900)
        monkeypatch.setattr(katz.B, "BUCKET_BYTES", 1200)
        monkeypatch.setattr(katz.B, "MOST_MESSAGES", 1)
    split_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = katz.score(df.withColumn("held", held), "held", order).collect()
    docs = [(r.doc_id, [*words(r.text, lower=True), 1]) for r in df.collect()]
    c, q = model([t for i, t in docs if not split_of(i)], order)
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in docs:
        padded = [0] * (order - 1) + t
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want.append((-1 if i is None else i, split_of(i), len(t), sum(w in c for w in t), n, base, sum(np.log10(q(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(t))))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in rows)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want)]
    for a, b in zip(got, sorted(want)):
        assert a[5:] == (pytest.approx(b[5]), pytest.approx(b[6], rel=1e-9))
    h = tuple([*docs[8][1], *[0] * order][: order - 1])
    assert sum(q(h, w) for w in c) + q(h, object()) == pytest.approx(1)


def test_katz_without_training(spark, empty):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string").withColumn("held", F.lit(True))
    rows = {r.doc_id: r for r in katz.score(df, "held").collect()}
    assert rows[1].score == 0 and rows[1].n_tokens == 3 and rows[2].n_tokens == 1 and rows[1].train_tokens == 0
    assert katz.score(empty.select("doc_id", "text").withColumn("held", F.lit(False)), "held").count() == 0
