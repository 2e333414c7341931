"""Exact removal of long word sequences that an earlier document holds, by recompression.

Recompression parses a sequence in rounds. A round names each run of one symbol, then deals all symbols to two
sides by a bit of their name and names each pair (left side, right side). A name is a 64-bit function of what it
stands for, so all executors give equal content equal names: names are global without a dictionary that every round
would have to build and join back by a shuffle of all tokens. Each symbol carries the range of words that its parse
depended on. Wherever a window of words contains that whole range, the parse finds the same symbol, whatever stands
around the window.

1. Each window of ``width`` words takes, among the symbols of the last round whose range lies inside it, the one
   with the least hash: equal windows take equal symbols. Blocks ask buckets which of these symbols more than one
   document holds; a few symbols stand for some ten windows each.
2. Only windows with a shared symbol (and those that contain no such range at all, as in long runs of one word) can
   be repeats. Such a window is named by its symbols: those of the last round that lie inside it, the symbols of the
   round before that lie beside them, and so on down to the words at its ends (``window_names``). Equal windows have
   equal symbols in equal places, and the symbols spell out the window. Beside its name goes a check that is made
   from the words by other, independent hashes; two windows are equal if name and check agree.
3. Blocks send names and checks with the least doc_id that has them; buckets answer with one bit: whether another
   block has it in a document with a smaller id. Blocks cut the words that repeated windows cover.

Different words agree in one of the two word hashes with a chance of 2**-56, in both with 2**-112; two different
windows among 10**13 agree in name and check with a chance below 10**-7.

Defined cases: a null text has no words; a text shorter than the window is kept; rows with an equal doc_id count as
one document, so they don't make each other repeats; a null doc_id counts as larger than any other; windows inside
one document that repeat there are kept. Other columns pass unchanged, but for those named as a result column.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.llm import blocks as B
from lakemill.llm.memory import spared
from lakemill.llm.words import GOLDEN, U64, distinct, first_of_runs, mix, pair_name, split, window_hashes

ROUNDS = 4
#: Text for each block: a block's parses are held at once, at some 25 bytes for each byte of text.
BLOCK_BYTES = 3 << 20
_LAST_ID = np.iinfo(np.int64).max


def parse(names: np.ndarray, bounds: np.ndarray, rounds: int) -> list[tuple[np.ndarray, ...]]:
    """For the words and each round: names of symbols, where each begins, and the word range that each depended on.

    A range that reaches over a text's end lies in no window of it.
    """
    n = len(names)
    levels = [(names,)]  # of words all is plain
    at = lows = np.arange(n)  # at: where a symbol begins
    highs = np.arange(1, n + 1)
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True  # begins a text
    for r in range(rounds):
        # runs of one symbol
        m = len(names)
        if m < 2:
            break
        same = np.zeros(m, bool)
        same[1:] = (names[1:] == names[:-1]) & ~first[1:]
        heads = np.flatnonzero(~same)
        lengths = np.diff(np.append(heads, m))
        tails = heads + lengths - 1
        last = np.append(first[1:], True)
        low = np.where(first[heads], at[heads] - 1, lows[np.maximum(heads - 1, 0)])
        past = np.append(at[1:], n)
        high = np.where(last[tails], past[tails] + 1, highs[np.minimum(tails + 1, m - 1)])
        runs = lengths > 1
        names = names[heads]
        if runs.any():
            names = names.copy()
            names[runs] = pair_name(names[runs], lengths[runs].astype(np.uint64), 2 * r + 1)
        first, at, lows, highs = first[heads], at[heads], low, high
        # pairs of a left and a right symbol
        m = len(names)
        right = (mix(names + U64(((2 * r + 1) * int(GOLDEN)) & (2**64 - 1))) >> U64(63)).astype(bool)
        pair = np.zeros(m, bool)  # with the next
        pair[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        last = np.append(first[1:], True)
        low, high = lows.copy(), highs.copy()
        past = np.append(at[1:], n)
        i = np.flatnonzero(right & ~second)
        low[i] = np.where(first[i], at[i] - 1, lows[np.maximum(i - 1, 0)])
        i = np.flatnonzero(~right & ~pair)
        high[i] = np.where(last[i], past[i] + 1, highs[np.minimum(i + 1, m - 1)])
        i = np.flatnonzero(pair)
        high[i] = highs[i + 1]
        names = names.copy()
        names[i] = pair_name(names[i], names[i + 1], 2 * r + 2)
        keep = ~second
        names, lows, highs, first, at = names[keep], low[keep], high[keep], first[keep], at[keep]
        levels.append((names, at.astype(np.int32), lows.astype(np.int32), highs.astype(np.int32)))
    return levels


_STEP = int(GOLDEN) | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, from 0 to n."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 2**64)):
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = U64(base)
        np.multiply.accumulate(powers, out=powers)
        out.append(powers)
    return out[0], out[1]


def _range_names(h: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Names of word ranges, from a prefix sum of word hashes times powers of an odd number."""
    n = len(h)
    powers, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers[:-1], out=sums[1:])
    lows, highs = np.clip(lows, 0, n), np.clip(highs, 0, n)
    return (sums[highs] - sums[lows]) * inverse[lows]


def window_names(levels: list[tuple[np.ndarray, ...]], where: np.ndarray, width: int) -> np.ndarray:
    """A name for each window (starting at ``where``, in order) from the symbols that lie inside it.

    From the last round to the words: symbols whose range lies inside the window and that the rounds after have not
    covered, each times a power of an odd number for its place in the window, are summed.
    """
    n = len(levels[0][0])
    powers, inverse = _powers(n)
    total = np.zeros(len(where), np.uint64)
    where = where.astype(np.int32)
    left = right = where  # the words that symbols cover so far; none yet
    for names, at, lows, highs in reversed(levels[1:]):
        lo, hi = np.searchsorted(lows, where, "left"), np.searchsorted(highs, where + np.int32(width), "right")
        hi = np.maximum(lo, hi)
        ends = np.append(at, np.int32(n))
        sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * powers[at], out=sums[1:])
        none = left == right
        inner = np.where(none, lo, np.searchsorted(at, left))
        outer = np.where(none, lo, np.searchsorted(at, right))
        total += sums[inner] - sums[lo] + sums[hi] - sums[outer]
        some = hi > lo
        left, right = np.where(some, ends[lo], left), np.where(some, ends[hi], right)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(levels[0][0] * powers[:-1], out=sums[1:])
    total += sums[left] - sums[where] + sums[where + width] - sums[right]
    return mix(total * inverse[where])


def window_symbols(levels: list[tuple[np.ndarray, ...]], where: np.ndarray, width: int) -> np.ndarray:
    """For each window (starting at ``where``) the hash of the symbol it takes; 0 if it holds none."""
    n = len(levels[0][0])
    if not len(where):
        return np.zeros(0, np.uint64)
    if len(levels) == 1:
        return np.zeros(len(where), np.uint64)
    names, _, lows, highs = levels[-1]
    keys = mix(names ^ _range_names(levels[0][0], lows, highs)) | U64(1)
    # ranges come in order, so those inside a window are neighbours
    begun = np.zeros(n + 3, np.int64)
    np.cumsum(np.bincount(lows + 2, minlength=n + 3), out=begun)  # begun[i + 1]: ranges with low < i
    ended = np.zeros(n + 3, np.int64)
    np.cumsum(np.bincount(highs, minlength=n + 3), out=ended)  # ended[i]: ranges with high <= i
    lo, hi = begun[where + 1], ended[where + width]
    out = np.zeros(len(where), np.uint64)
    count = hi - lo
    level, table = 0, keys
    while True:
        some = (count >= 1 << level) & (count < 2 << level)
        if some.any():
            a, b = lo[some], hi[some] - (1 << level)
            out[some] = np.minimum(table[a], table[b])
        if not (count >= 2 << level).any():
            return out
        table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
        level += 1


def _window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Where windows of ``width`` words begin that lie inside one text."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    return np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Slice:
    def __init__(self, begin: int, end: int, texts: pa.Array, ids: np.ndarray, width: int, names: bool):
        self.begin, self.end, self.texts, self.width = begin, end, texts, width
        self.words = split(texts)
        h, *self.other = self.words.several_hashes((0, 1) if names else (0,))
        self.where = _window_starts(self.words.bounds, width)
        self.levels = parse(h, self.words.bounds, ROUNDS)
        self.symbols = window_symbols(self.levels, self.where, width)
        doc = self.words.doc_of_word()[self.where] if len(self.where) else np.zeros(0, np.int64)
        self.ids = ids[begin + doc]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of the windows that may be repeats."""
        where = self.where[self.maybe]
        if not len(where):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        checks, _ = window_hashes(self.other[0], np.array([0, self.words.n]), self.width, 1)
        out = window_names(self.levels, where, self.width), checks[where]
        self.levels = self.other = None  # no longer needed
        return out


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(_LAST_ID).to_numpy(zero_copy_only=False)


def _slices(table: pa.Table, width: int, names: bool):
    ids = _ids(table)
    for begin, end, texts in B.unpack(table.column("text")):
        yield _Slice(begin, end, texts, ids, width, names)


def _shared_request(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct symbols, and whether two of its documents hold one."""
    symbols, ids = [], []
    for s in _slices(table, width, False):
        new = first_of_runs(s.symbols) | first_of_runs(s.ids)
        new &= s.symbols != 0
        symbols.append(s.symbols[new])
        ids.append(s.ids[new])
    symbols, ids = np.concatenate(symbols or [np.zeros(0, np.uint64)]), np.concatenate(ids or [np.zeros(0, np.int64)])
    order = np.argsort(symbols)
    symbols, ids = symbols[order], ids[order]
    heads = np.flatnonzero(first_of_runs(symbols))
    if not len(heads):
        return symbols, np.zeros(0, bool)
    return symbols[heads], np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)


def _name_request(table: pa.Table, answers: pa.Table, width: int, buckets: int):
    """The block's distinct names of windows that may be repeats, with the least id that has each; and all slices."""
    kept = []
    symbols = []
    for s in _slices(table, width, True):
        kept.append(s)
        symbols.append(distinct(s.symbols))
    known = distinct(np.concatenate(symbols or [np.zeros(0, np.uint64)]))
    known = known[known != 0]
    shared = B.Outbox(known, buckets).read(answers, np.uint8, bits=True)
    shared = known[shared]
    names, extras, ids = [], [], []
    for s in kept:
        at = np.searchsorted(shared, s.symbols)
        s.maybe = s.symbols == 0
        if len(shared):
            s.maybe |= shared[np.minimum(at, len(shared) - 1)] == s.symbols
        name, check = s.names()
        names.append(name)
        extras.append(check)
        ids.append(s.ids[s.maybe])
        s.symbols = None
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    names, extras, ids = cat(names, np.uint64), cat(extras, np.uint64), cat(ids, np.int64)
    order = np.lexsort((extras, names))
    names, extras = names[order], extras[order]
    heads = np.flatnonzero(first_of_runs(names) | first_of_runs(extras))
    least = np.minimum.reduceat(ids[order], heads) if len(heads) else np.zeros(0, np.int64)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    return names[heads], extras[heads], least, group, ids, kept


def _answer_shared(table: pa.Table) -> pa.Table:
    to, parts = B.one(table.column("to")), []
    for data in table.column("data"):
        raw = np.frombuffer(data.as_buffer(), np.uint8)
        n = int(raw[:8].view(np.int64)[0])
        parts.append((raw[8 : 8 + 8 * n].view(np.uint64), np.unpackbits(raw[8 + 8 * n :], count=n).view(bool)))
    keys, multi = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    heads = first_of_runs(keys[order])
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(heads) - 1
    shared = np.bincount(group, minlength=1) > 1
    shared |= np.bincount(group, weights=multi, minlength=1) > 0
    out, at = [], 0
    for sender, (k, _) in zip(table.column("sender").to_pylist(), parts, strict=True):
        out.append((sender, to, np.packbits(shared[group[at : at + len(k)]]).tobytes()))
        at += len(k)
    return B.mail(out)


def _answer_names(table: pa.Table) -> pa.Table:
    to, parts = B.one(table.column("to")), []
    for data in table.column("data"):
        raw = np.frombuffer(data.as_buffer(), np.uint8)
        n = len(raw) // 24
        parts.append((raw[: 8 * n].view(np.uint64), raw[8 * n : 16 * n].view(np.int64), raw[16 * n :].view(np.uint64)))
    keys, ids, extras = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((extras, keys))
    heads = np.flatnonzero(first_of_runs(keys[order]) | first_of_runs(extras[order]))
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.append(heads, len(keys))))
    earlier = least < ids
    out, at = [], 0
    for sender, (k, _, _) in zip(table.column("sender").to_pylist(), parts, strict=True):
        out.append((sender, to, np.packbits(earlier[at : at + len(k)]).tobytes()))
        at += len(k)
    return B.mail(out)


def substring_dedup(docs: DataFrame, width: int = 50, as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word ranges that went), kept_text and all other columns but the text.

    ``kept_text`` has the words that stay, joined by one space; with ``as_is`` a text that loses nothing stays as it
    is. See the module for the rules.
    """
    post = B.Post(B.text_bytes(docs), BLOCK_BYTES)
    buckets = post.buckets
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "removed", "kept_text")]
    blocks = B.to_blocks(docs, post.blocks, [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else [])

    def symbols(table: pa.Table) -> pa.Table:
        keys, multi = _shared_request(table, width)
        pack = lambda a, b: np.int64(b - a).tobytes() + keys[a:b].tobytes() + np.packbits(multi[a:b]).tobytes()
        return B.Outbox(keys, buckets).messages(B.one(table.column("block")), pack)

    def names(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.mail([])
        keys, extras, least, *_ = _name_request(table, answers, width, buckets)
        pack = lambda a, b: keys[a:b].tobytes() + least[a:b].tobytes() + extras[a:b].tobytes()
        return B.Outbox(keys, buckets).messages(B.one(table.column("block")), pack)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        first = pa.compute.equal(answers.column("round"), 1)
        keys, _, least, group, ids, kept = _name_request(table, answers.filter(first), width, buckets)
        repeat = B.Outbox(keys, buckets).read(answers.filter(pa.compute.invert(first)), np.uint8, bits=True)
        gone = repeat[group] | (ids > least[group])
        n_words, n_removed, spans, texts, at = [], [], [], [], 0
        for s in kept:
            here = gone[at : at + int(s.maybe.sum())]
            at += len(here)
            starts = s.where[s.maybe][here]
            cover = np.bincount(starts, minlength=s.words.n + width) - np.bincount(starts + width, minlength=s.words.n + width)
            removed = np.cumsum(cover)[: s.words.n] > 0
            counts = np.add.reduceat(np.append(removed, False), s.words.bounds[:-1]) if len(s.words.bounds) > 1 else []
            for d, text in enumerate(s.texts):
                a, b = int(s.words.bounds[d]), int(s.words.bounds[d + 1])
                n = int(counts[d]) if b > a else 0
                n_words.append(b - a)
                n_removed.append(n)
                if not n and as_is:
                    spans.append([])
                    texts.append(text.as_py())
                    continue
                words = text.as_py().split()
                if n:
                    mask = removed[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans.append([{"first": int(x), "past": int(y)} for x, y in edges.reshape(-1, 2)])
                    words = list(compress(words, (~mask).tolist()))
                else:
                    spans.append([])
                texts.append(b" ".join(words))
        out = [
            table.column("doc_id"),
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ]
        labels = ["doc_id", "n_words", "n_removed", "removed", "kept_text"]
        if rest:
            out.append(table.column("rest"))
            labels.append("rest")
        return pa.table(out, names=labels)

    shared = post.answer(post.ask(blocks, lambda table: spared(symbols(table))), lambda table: spared(_answer_shared(table)))
    earlier = post.answer(post.ask_again(blocks, shared, lambda table, got: spared(names(table, got))), lambda table: spared(_answer_names(table)))
    answers = shared.withColumn("round", F.lit(1)).unionAll(earlier.withColumn("round", F.lit(2)))
    fields = T.StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<first:bigint,past:bigint>>, kept_text string")
    if rest:
        fields = fields.add("rest", blocks.schema["rest"].dataType)
    out = post.follow(blocks, answers, lambda table, got: spared(cut(table, got)), fields)
    return out.select("doc_id", "n_words", "n_removed", "removed", "kept_text", *[F.col("rest").getField(c).alias(c) for c in rest])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word ranges of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs``, same rows and columns, with repeated passages cut from the texts (and n_chars to match, if there).

    A text that loses nothing, and a null, stays as it is; of a text that loses words, the others are joined by one space.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    out = substring_dedup(docs.select("doc_id", "text", row, F.col("text").isNull().alias("_null")), width, as_is=True)
    made = []
    for c in docs.columns:
        value = F.when(~F.col("_null"), F.col("kept_text")) if c == "text" else F.col("_row").getField(c)
        if c == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(value)
        made.append(value.alias(c))
    return out.select(*made)
