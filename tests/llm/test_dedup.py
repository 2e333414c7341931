"""Substring dedup and near-duplicates against brute force."""

import hashlib
import os

import numpy as np
import pytest

from tests.llm.conftest import ODD, SF, words
from lakemill.llm import minhash, substring_dedup
from lakemill.llm.components import connected_components
from lakemill.llm.words import plain, split

import pyarrow as pa


def cut(docs, width=50):
    """{row: (n_words, n_removed, kept)} by dictionaries of whole windows."""
    first = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


def test_substrings_of_odd_texts(odd, empty):
    assert found(substring_dedup.substring_dedup(odd)) == cut([r[:2] for r in ODD])
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert set(substring_dedup.substring_dedup(odd).columns) >= {"doc_id", "kept_text", "block", "rank"}


@pytest.mark.parametrize("width", [2, 7, 20])
def test_substrings_of_random_words(spark, width):
    random = np.random.default_rng(width)
    docs = [(int(i), " ".join(random.choice(["a", "b", "c"], random.integers(0, 120)))) for i in random.permutation(60)]
    docs += [(i, t) for i, t in docs[:5]]  # rows that repeat an id
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(substring_dedup.substring_dedup(df, width)) == cut(docs, width)


def test_substrings_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = substring_dedup.op1_substring_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cut(docs)


def test_cut_repeats_keeps_rows_and_columns(odd):
    out = substring_dedup.cut_repeats(odd)
    assert out.columns == odd.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert len(text) == len(ODD) and text[10] == "" and text[13] == "other" and text[1] is None and text[2] == "" and text[16] == ODD[15][1]


def test_symbols_do_not_depend_on_what_stands_around():
    random = np.random.default_rng(3)
    for words in (40, 2):  # two words: long runs and pairs in many rounds
        core = [f"c{x}" for x in random.integers(0, words, 50)]
        seen = set()
        for k in range(60):
            around = [[f"c{x}" for x in random.integers(0, words, random.integers(0, 30))] for _ in range(2)]
            w = split(plain(pa.array([" ".join([*around[0], *core, *around[1]])])))
            where = substring_dedup._window_starts(w.bounds, 50)
            levels = substring_dedup.parse(w.hashes(), w.bounds, substring_dedup.ROUNDS)
            symbols = substring_dedup.window_symbols(levels, where, 50)
            names = substring_dedup.window_names(levels, where, 50)
            seen.add((int(symbols[len(around[0])]), int(names[len(around[0])])))
        assert len(seen) == 1 and (words == 2 or 0 not in next(iter(seen)))


@pytest.mark.parametrize("words, width", [(2, 9), (3, 20), (50, 50)])
def test_names_tell_windows_apart(words, width):
    """Windows have equal names if and only if their words are equal."""
    random = np.random.default_rng(words)
    texts = [" ".join(f"c{x}" for x in random.integers(0, words, random.integers(0, 200))) for _ in range(60)]
    texts += [t + " c0 c0 c0 c0 " * 9 for t in texts[:20]]
    w = split(plain(pa.array(texts)))
    where = substring_dedup._window_starts(w.bounds, width)
    names = substring_dedup.window_names(substring_dedup.parse(w.hashes(), w.bounds, substring_dedup.ROUNDS), where, width)
    flat = [x for t in texts for x in t.split()]
    by_words = {}
    for i, name in zip(where.tolist(), names.tolist()):
        by_words.setdefault(tuple(flat[i : i + width]), set()).add(name)
    assert all(len(x) == 1 for x in by_words.values()) and len(set(names.tolist())) == len(by_words) < len(where)


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs, percent):
    sets, up = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_of_odd_texts(odd, empty, percent):
    assert got(minhash.near_duplicates(odd, percent)) == components([r[:2] for r in ODD], percent)
    assert minhash.near_duplicates(empty).count() == 0


def near_copies(n, seed):
    """Copies of one text with edits: many pairs lie near the limit, and chains lead from one to the next."""
    random = np.random.default_rng(seed)
    base = [f"b{x}" for x in range(80)]
    docs = []
    for i in range(n):
        if i % 7 == 3:
            base = [*base]
            base[random.integers(0, 80)] = f"n{i}"
        own = [*base]
        for _ in range(random.integers(0, 3)):
            own[random.integers(0, len(own))] = f"e{random.integers(0, 10**6)}"
        docs.append((i, " ".join(own)))
    return docs


@pytest.mark.parametrize("chunk", [512, 9])
def test_links_near_the_limit(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_DOCS", chunk)  # 9: the cluster is dealt into many chunks
    docs = near_copies(90, 1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got(minhash.near_duplicates(df, 85)) == components(docs, 85)


def test_keep_one(odd):
    out = minhash.keep_one_of_each(odd)
    assert out.columns == odd.columns
    gone = {r[0] for r in ODD} - {r.doc_id for r in out.collect()}
    assert gone == {i for i, _, _, kept in components([r[:2] for r in ODD], 80) if not kept}


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f")], "doc_id bigint, text string")
    rows = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert rows == {(None, None, True), (3, 1, False), (1, 1, True)}


def test_components(spark):
    links = [(i, i + 1) for i in range(30) if i % 10] + [(50, 3), (60, 60), (None, 2)]
    rows = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert rows == {**{i: 1 for i in range(1, 11)}, 50: 1, **{i: 11 for i in range(11, 21)}, **{i: 21 for i in range(21, 31)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
