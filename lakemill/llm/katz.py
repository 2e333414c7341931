"""A Katz backoff model of n-grams of all training texts, and the log10 probability it gives every text.

Tokens are words (A-Z lower-cased) and one end for each text; before a text stand begin marks. Counts up to ``TOP``
are discounted by Good-Turing, order by order; what that frees goes to unseen continuations in proportion to the next
lower order, down to unigrams, where all unknown words share one event. P(. | history) sums to 1 over the known tokens
and that event. With h a history, h' the same without its first token:

    P(w | h) = d(c) c(h, w) / c(h)      if c(h, w) > 0
             = alpha(h) P(w | h')       else, alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of seen P(w | h'))
             = P(w | h')                if h was never a history

Where all continuations of a history have counts over ``TOP`` nothing would be free: c(h) + 1 divides instead.
Where Good-Turing gives no discount between 0 and 1 (small or odd data), (r - 0.5) / r is taken for count r.

Counts and what backoff weights are made of are partitioned by history over buckets (see ``blocks``), and each
order's are written as a table in the shared folder before the next order starts. A block of documents sends its
distinct unigrams, then its distinct bigrams of known histories and words, then trigrams whose bigrams are known, and so
on; buckets add up counts and answer, and say which n-grams only one block has. What follows such a history is all
in that block, which counts it by itself: at higher orders most histories need no message. Of an n-gram whose last
n - 1 tokens only one block has, that block sends the counts without the word: they only add to the history's sums.
N-grams of a history lie in one bucket, so its sums are complete there; a history with more than a bucket's share of
all tokens is dealt over several, and its sums are added from theirs (such histories number at most the buckets). The
driver gets only counts of counts and these. A token's probability is then evaluated from the lowest order up, each
order from the one before.

Defined cases: a null or empty text is one end token; without training texts every token is the unknown event, of
probability 1; rows that share a doc_id count each; a null doc_id counts as text '' for the split. Other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm import blocks as B
from lakemill.llm.words import U64, first_of_runs, mix, pair_name, split

TOP, ORDER = 5, 3
#: Blocks for each file of the table of blocks, and bytes of a name on its way.
BLOCKS_PER_PART, SHORT = 4, 6
BEGIN, END = U64(0x6265_6769_6E00_0001), U64(0x656E_6400_0000_0001)


def _squeeze(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    packed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    return len(raw).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed


def _short(names: np.ndarray) -> np.ndarray:
    """The low 48 bits of names.

    Histories are told apart by these and by their bucket, whose number holds other bits of the name, the more the
    larger the corpus; words by these within one history.
    """
    return names & U64((1 << 8 * SHORT) - 1)


def _sent(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()


class _Reader:
    def __init__(self, data):
        self.data, self.at = memoryview(data), 0

    def raw(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def names(self, n: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :SHORT] = self.raw(np.uint8, n * SHORT).reshape(n, SHORT)
        return out.view("<u8").ravel().astype(np.uint64, copy=False)

    def squeezed(self, kind) -> np.ndarray:
        size, packed = (int(x) for x in self.raw(np.int64, 2))
        part = self.data[self.at : self.at + packed]
        self.at += packed
        return np.frombuffer(pa.decompress(pa.py_buffer(part), size, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def discounts(n: list[int]) -> list[float]:
    """d(0), d(1) ... d(TOP) from the counts of counts n[1] ... n[TOP + 1]."""
    out = [1.0]
    cut = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = 0.0
        if n[r] and cut < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Unigrams:
    def __init__(self, stats: np.ndarray):
        """stats: tokens, types, tokens of types with counts over TOP, n[1] ... n[TOP + 1]."""
        self.tokens, self.types, over = (int(x) for x in stats[:3])
        self.d = np.array(discounts([0, *(int(x) for x in stats[3:])]))
        low = [r * int(stats[2 + r]) for r in range(1, TOP + 1)]
        self.total = self.tokens if any(low) else self.tokens + 1
        self.unknown = 1 - (sum(self.d[r] * low[r - 1] for r in range(1, TOP + 1)) + over) / self.total if self.tokens else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, TOP + 1) % (TOP + 1)] * c / self.total, self.unknown)


class _Block:
    """The tokens of a block: distinct keys, and for each token its number. Made once from texts, then kept as one row."""

    def __init__(self, ids: pa.Array, held: pa.Array, bounds: np.ndarray, keys: np.ndarray, word: np.ndarray):
        self.ids, self.held, self.bounds, self.keys, self.word = ids, held, bounds, keys, word
        self.train = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
        self.counts = np.bincount(word[self.train], minlength=len(keys))
        self.heads = bounds[:-1][bounds[:-1] < len(word)]

    @classmethod
    def of_texts(cls, table: pa.Table) -> _Block:
        tokens, bounds = [], [np.zeros(1, np.int64)]
        begun = 0
        for a, b, texts in B.unpack(table.column("text")):
            words = split(texts)
            n = b - a
            own = np.empty(words.n + n, np.uint64)
            ends = words.bounds[1:] + np.arange(n)
            is_end = np.zeros(len(own), bool)
            is_end[ends] = True
            own[ends] = END
            own[~is_end] = words.hashes(lower=True)
            tokens.append(own)
            bounds.append(ends + 1 + begun)
            begun += len(own)
        tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        order = np.argsort(tokens)
        heads = first_of_runs(tokens[order])
        word = np.empty(len(tokens), np.int32)
        word[order] = np.cumsum(heads) - 1
        ids, held = (table.column(c).combine_chunks() for c in ("doc_id", "held"))
        return cls(ids, held, np.concatenate(bounds), tokens[order][heads], word)

    @classmethod
    def kept(cls, table: pa.Table) -> _Block:
        """From the row that ``row`` has made; no row is a block without documents."""
        if not table.num_rows:
            return cls(pa.array([], pa.int64()), pa.array([], pa.bool_()), np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        r = _Reader(table.column("data")[0].as_buffer())
        ids, held = (table.column(c)[0].values for c in ("doc_id", "held"))
        bounds = np.append(0, np.cumsum(r.squeezed(np.int32), dtype=np.int64))
        keys = r.raw(np.uint64, int(r.raw(np.int64, 1)[0]))
        place = np.ascontiguousarray(r.squeezed(np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        order = np.argsort(keys)
        number = np.empty(len(keys), np.int32)
        number[order] = np.arange(len(keys))
        return cls(ids, held, bounds, keys[order], number[place])

    def row(self, block: int) -> pa.Table:
        # keys by how often they stand here and bytes of one weight together: most high bytes are 0, which packs well
        order = np.argsort(-np.bincount(self.word, minlength=len(self.keys)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        planes = np.ascontiguousarray(place[self.word].view(np.uint8).reshape(-1, 4).T)
        data = _squeeze(np.diff(self.bounds).astype(np.int32)) + np.int64(len(self.keys)).tobytes() + self.keys[order].tobytes() + _squeeze(planes)
        lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (self.ids, self.held)]
        return pa.table([pa.array([block], pa.int32()), *lists, pa.array([data], pa.binary())], names=["block", "doc_id", "held", "data"])


_ROW = "block int, doc_id array<bigint>, held array<boolean>, data binary"


def _sums(history: np.ndarray, seen: np.ndarray, m: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of m histories: tokens in continuations seen 1 ... TOP times and oftener, and the p of those seen."""
    sums, some = np.zeros(m * (TOP + 1), np.int64), seen > 0
    h, c = history[some].astype(np.int64), seen[some]
    cell = h * (TOP + 1) + np.minimum(c, TOP + 1) - 1
    low = c <= TOP
    sums += np.bincount(cell[low], minlength=len(sums)) * np.tile(np.append(np.arange(1, TOP + 1), 0), m)
    np.add.at(sums, cell[~low], c[~low])
    return sums.reshape(m, TOP + 1), np.bincount(h, weights=p[some], minlength=m)


def _p_below(k: int, uni: Unigrams, below: _Found | None) -> Callable:
    """The probability by order k - 1 of seen (k - 1)-grams, from their counts and what these are divided by."""
    if k == 2:
        return lambda c, divisor: uni.probability(c)
    return lambda c, divisor: below.d[np.minimum(c, TOP + 1)] * c / np.maximum(divisor, 1)


class _Level:
    """A block's distinct k-grams of known histories whose last k - 1 tokens are known, dealt to buckets.

    ``gram`` is the number of the (k - 1)-gram that ends at each token, -1 if it was not looked up; ``names``,
    ``counts`` and ``only`` are those numbers' names, counts in training texts and whether no other block has them;
    ``divisors`` is what the (k - 1)-gram's count at each token is divided by. Sorted by bucket, history and word; k-grams
    of histories that only this block has come last and are not sent; ``local`` marks those whose last k - 1 tokens only
    this block has, which are sent without the word. ``need`` marks histories that are followed by a
    token whose (k - 1)-gram is not known.
    """

    def __init__(self, block: _Block, k: int, gram, names, counts, only, ends: int, divisors, tokens: int, buckets: int):
        m, begin = len(block.keys), len(names)
        self.mine, self.buckets = np.append(only, False), buckets
        self.names = np.append(names, mix(np.array([BEGIN + U64(k)]))[0])
        self.totals = np.append(counts, ends)
        history = np.empty(len(gram), np.int64)
        history[1:] = gram[:-1]
        history[block.heads] = begin
        lower = np.append(counts, 0)[gram]
        lower_only = np.append(only, False)[gram]
        self.lower, self.divisors, self.k, self.of_history = lower, divisors, k, history
        self.followed = (history >= 0) & (self.totals[history] > 0)
        known = np.flatnonzero(self.followed & (lower > 0))
        code = history[known] * m + block.word[known]
        order = np.argsort(code)
        heads = first_of_runs(code[order])
        group = np.empty(len(code), np.int32)
        group[order] = np.cumsum(heads) - 1
        lead = known[order[heads]]
        code = code[order][heads]
        history, word = np.divmod(code, max(m, 1))
        train = np.bincount(group[block.train[known]], minlength=len(code))
        share = max(1, tokens // buckets)
        parts = 1 + self.totals // share  # buckets that a history is dealt over
        base = self._bucket(self.names[history], buckets)
        bucket = (base + (mix(block.keys[word]) >> U64(33)).astype(np.int64) % parts[history]) % buckets
        bucket[self.mine[history]] = buckets
        deal = np.argsort(bucket.astype(np.int32), kind="stable")
        self.bucket, self.history, self.word, self.train, self.lead = bucket[deal], history[deal], word[deal], train[deal], lead[deal]
        at = np.empty(len(deal), np.int32)
        at[deal] = np.arange(len(deal))
        self.local = lower_only[self.lead]
        self.gram = np.full(len(gram), -1, np.int32)
        self.gram[known] = at[group]
        self.hot = (parts > 1) & ~self.mine
        self.need = np.zeros(begin + 1, bool)
        self.need[self.of_history[self.followed & (lower == 0)]] = True
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))
        # histories that only such tokens follow here; their sums are asked for too
        lonely = self.need & ~self.hot & ~self.mine
        lonely[self.history] = False
        lonely = np.flatnonzero(lonely)
        base = self._bucket(self.names[lonely], buckets)
        deal = np.argsort(base, kind="stable")
        self.lonely = lonely[deal]
        self.lonely_cuts = np.searchsorted(base[deal], np.arange(buckets + 1))
        self.word_keys = block.keys

    @staticmethod
    def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
        return ((mix(names) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)

    def alone(self, b: int) -> np.ndarray:
        return self.lonely[self.lonely_cuts[b] : self.lonely_cuts[b + 1]]

    def part(self, b: int):
        """K-grams of bucket b: their range, and where each history begins."""
        lo, hi = int(self.cuts[b]), int(self.cuts[b + 1])
        heads = np.flatnonzero(first_of_runs(self.history[lo:hi]))
        return lo, hi, heads

    def message(self, b: int, counts: np.ndarray) -> bytes:
        lo, hi, heads = self.part(b)
        own, lead, local = self.history[lo:hi][heads], self.lead[lo:hi], self.local[lo:hi]
        shared = self.word[lo:hi][~local]
        return b"".join(
            [
                counts.tobytes(),
                np.array([len(heads), hi - lo], np.int64).tobytes(),
                _sent(mix(self.names[own])),
                np.array([len(shared)], np.int64).tobytes(),
                _sent(self.word_keys[shared]),
                _squeeze(np.diff(np.append(heads, hi - lo)).astype(np.uint32)),
                _squeeze(np.packbits(self.need[own])),
                _squeeze(np.packbits(self.hot[own])),
                _squeeze(np.packbits(local)),
                _squeeze(self.train[lo:hi].astype(np.uint32)),
                _squeeze(self.lower[lead].astype(np.int64)),
                _squeeze(self.divisors[lead].astype(np.int64) if self.k > 2 else np.zeros(0, np.int64)),
                _squeeze(_short(mix(self.names[self.alone(b)]))),
            ]
        )

    def messages(self, number: int) -> pa.Table:
        """What goes to buckets; one of them also gets the counts of counts of what is counted here."""
        held = np.bincount(np.minimum(self.train[self.cuts[-1] :], TOP + 2), minlength=TOP + 3)[1 : TOP + 2].astype(np.int64)
        some = np.diff(self.cuts) + np.diff(self.lonely_cuts) > 0
        some[number % self.buckets] |= held.any()
        return B.mail([(int(b), number, self.message(int(b), held if b == number % self.buckets else held * 0)) for b in np.flatnonzero(some)])

    def take(self, answers: pa.Table, found: _Found, least_left: float, p_below: Callable) -> None:
        """Counts of the k-grams, and of histories the backoff weights."""
        own_from = int(self.cuts[-1])
        self.seen, self.only = np.zeros(len(self.word), np.int64), np.zeros(len(self.word), bool)
        self.seen[own_from:], self.only[own_from:] = self.train[own_from:], True
        self.saturated = np.zeros(len(self.names), bool)
        self.alpha = np.ones(len(self.names))
        d = self.d = found.d

        def weigh(which: np.ndarray, sums: np.ndarray, mass: np.ndarray) -> None:
            total = self.totals[which]
            full = sums[:, :TOP].sum(axis=1) == 0
            free = np.where(full, 1 / (total + 1), (sums * (1 - d[1:])).sum(axis=1) / np.maximum(total, 1))
            self.alpha[which] = free / np.maximum(1 - mass, least_left)
            self.saturated[which] = full

        for sender, data in zip(answers.column("sender").to_pylist(), answers.column("data"), strict=True):
            r = _Reader(data.as_buffer())
            lo, hi, heads = self.part(sender)
            c, local = self.train[lo:hi].copy(), self.local[lo:hi]
            c[~local] = r.squeezed(np.int64)
            self.seen[lo:hi], self.only[lo:hi] = c, True
            self.only[lo:hi][~local] = np.unpackbits(r.squeezed(np.uint8), count=int((~local).sum())).view(bool)
            own = self.history[lo:hi][heads]
            bits = np.unpackbits(r.squeezed(np.uint8), count=len(own)).view(bool)
            cold = ~self.hot[own]
            self.saturated[own[cold]] = bits[cold]
            full = own[(self.need[own] | (np.add.reduceat(np.append(c == 0, False), heads) > 0)) & cold]
            full = np.append(full, self.alone(sender))
            sums = r.squeezed(np.int64).reshape(TOP + 1, -1).T
            weigh(full, sums, r.raw(np.float64, len(full)))
        if own_from < len(self.word):
            heads = own_from + np.flatnonzero(first_of_runs(self.history[own_from:]))
            number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(self.word))))
            sums, mass = _sums(number, self.seen[own_from:], len(heads), p_below(self.lower[self.lead[own_from:]], self.divisors[self.lead[own_from:]]))
            weigh(self.history[heads], sums, mass)
        spread = np.flatnonzero(self.hot)
        names = _short(mix(self.names[spread])).tolist()
        got = [found.hot[x] for x in names if x in found.hot]
        spread = spread[[x in found.hot for x in names]] if len(spread) else spread
        if len(spread):
            weigh(spread, np.array([g[0] for g in got]), np.array([g[1] for g in got]))

    def probability(self, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token by this order, from that by the order below; and what the k-gram's count is divided by."""
        count = np.append(self.seen, 0)[self.gram]
        divisors = np.maximum(self.totals[self.of_history] + self.saturated[self.of_history], 1)
        direct = self.d[np.minimum(count, TOP + 1)] * count / divisors
        p = np.where(count > 0, direct, np.where(self.followed, self.alpha[self.of_history] * lower, lower))
        return p, divisors

    def gram_names(self) -> np.ndarray:
        return pair_name(self.names[self.history], self.word_keys[self.word], 910 + self.k)


class _Found:
    """What the driver knows of an order: discounts d(0) ... d(TOP), 1, and the sums of histories in several buckets."""

    def __init__(self, reports: list[bytes]):
        n, self.hot = np.zeros(TOP + 1, np.int64), {}
        for data in reports:
            r = _Reader(data)
            n += r.raw(np.int64, TOP + 1)
            k = (len(data) - r.at) // (8 * (TOP + 3))
            for name, sums, mass in zip(r.raw(np.uint64, k), r.raw(np.int64, k * (TOP + 1)).reshape(k, TOP + 1), r.raw(np.float64, k), strict=True):
                have = self.hot.setdefault(int(name), [np.zeros(TOP + 1, np.int64), 0.0])
                have[0] += sums
                have[1] += float(mass)
        self.d = np.array([*discounts([0, *n.tolist()]), 1.0])


def _answer_unigrams(table: pa.Table) -> pa.Table:
    to, keys, counts = B.one(table.column("to")), [], []
    for data in table.column("data"):
        r = _Reader(data.as_buffer())
        keys.append(r.raw(np.uint64, int(r.raw(np.int64, 1)[0])))
        counts.append(r.squeezed(np.uint32))
    all_keys = np.concatenate(keys)
    order = np.argsort(all_keys)
    heads = first_of_runs(all_keys[order])
    group = np.empty(len(all_keys), np.int64)
    group[order] = np.cumsum(heads) - 1
    total = np.zeros(int(heads.sum()), np.int64)
    np.add.at(total, group, np.concatenate(counts).astype(np.int64))
    only = np.bincount(group) == 1
    out, at = [], 0
    for sender, k in zip(table.column("sender").to_pylist(), keys, strict=True):
        own = group[at : at + len(k)]
        out.append((sender, to, _squeeze(total[own]) + _squeeze(np.packbits(only[own]))))
        at += len(k)
    n = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
    ends = total[np.searchsorted(all_keys[order][heads], END)] if (all_keys == END).any() else 0
    stats = np.array([total.sum(), (total > 0).sum(), total[total > TOP].sum(), *n[1 : TOP + 2], ends], np.int64)
    return B.mail([*out, (-1, to, stats.tobytes())])


def _answer_grams(p_below: Callable):
    """The work of a bucket for one order."""

    def work(table: pa.Table) -> pa.Table:
        to, parts, held = B.one(table.column("to")), [], np.zeros(TOP + 1, np.int64)
        for data in table.column("data"):
            r = _Reader(data.as_buffer())
            held += r.raw(np.int64, TOP + 1)
            n_h, n = (int(x) for x in r.raw(np.int64, 2))
            names, words = r.names(n_h), r.names(int(r.raw(np.int64, 1)[0]))
            sizes = r.squeezed(np.uint32).astype(np.int64)
            need, hot = (np.unpackbits(r.squeezed(np.uint8), count=n_h).view(bool) for _ in range(2))
            local = np.unpackbits(r.squeezed(np.uint8), count=n).view(bool)
            parts.append((names, sizes, need, hot, words, r.squeezed(np.uint32), r.squeezed(np.int64), r.squeezed(np.int64), r.squeezed(np.uint64), local))
        names = np.concatenate([p[0] for p in parts])
        by = np.argsort(names)
        heads = first_of_runs(names[by])
        number = np.empty(len(names), np.int32)  # of each listed history
        number[by] = np.cumsum(heads) - 1
        distinct = names[by][heads]
        hot = np.zeros(len(distinct), bool)
        hot[number] = np.concatenate([p[3] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        history = np.repeat(number, sizes)
        train = np.concatenate([p[5] for p in parts]).astype(np.int64)
        shared = np.flatnonzero(~np.concatenate([p[9] for p in parts]))
        grams = pair_name(distinct[history[shared]], np.concatenate([p[4] for p in parts]), 909)
        order = np.argsort(grams)
        new = first_of_runs(grams[order])
        group = np.empty(len(grams), np.int32)
        group[order] = np.cumsum(new) - 1
        first = np.ones(len(train), bool)  # one listing of each k-gram
        first[shared] = False
        first[shared[order[new]]] = True
        del order, grams
        # what only its sender has counts as it is
        total = np.bincount(group, weights=train[shared], minlength=int(new.sum())).astype(np.int64)
        only = np.bincount(group, minlength=len(total)) == 1
        seen = train
        seen[shared] = total[group]
        m, lower, lead = len(distinct), np.concatenate([p[6] for p in parts]), np.flatnonzero(first)
        divisors = np.concatenate([p[7] for p in parts])
        lower = lower[lead]
        sums, mass = _sums(history[lead], seen[lead], m, p_below(lower, divisors[lead] if len(divisors) else lower))
        out, at, w_at, h_at = [], 0, 0, 0
        for sender, (own, size, need, _, w, _, _, _, alone, local) in zip(table.column("sender").to_pylist(), parts, strict=True):
            c = seen[at : at + len(local)]
            h = number[h_at : h_at + len(own)]
            unseen = np.add.reduceat(np.append(c == 0, False), np.cumsum(size) - size) > 0 if len(own) else np.zeros(0, bool)
            full = (need | unseen) & ~hot[h]
            saturated = sums[h, :TOP].sum(axis=1) == 0
            asked = np.append(h[full], np.searchsorted(distinct, alone))
            bits = _squeeze(np.packbits(only[group[w_at : w_at + len(w)]]))
            out.append((sender, to, _squeeze(c[~local]) + bits + _squeeze(np.packbits(saturated)) + _squeeze(sums[asked].T.copy()) + mass[asked].tobytes()))
            at, w_at, h_at = at + len(local), w_at + len(w), h_at + len(own)
        n = held + np.bincount(np.minimum(seen[lead], TOP + 2), minlength=TOP + 3)[1 : TOP + 2]
        stats = n.astype(np.int64).tobytes() + distinct[hot].tobytes() + sums[hot].tobytes() + mass[hot].tobytes()
        return B.mail([*out, (-1, to, stats)])

    return work


def _unigram_counts(block: _Block, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's keys in training texts, and whether only this block has them."""
    box = B.Outbox(block.keys, buckets)
    out, only = np.zeros(len(block.keys), np.int64), np.zeros(len(block.keys), bool)
    for sender, data in zip(answers.column("sender").to_pylist(), answers.column("data"), strict=True):
        r, lo, hi = _Reader(data.as_buffer()), int(box.cuts[sender]), int(box.cuts[sender + 1])
        out[lo:hi] = r.squeezed(np.int64)
        only[lo:hi] = np.unpackbits(r.squeezed(np.uint8), count=hi - lo).view(bool)
    return out, only


def score(docs: DataFrame, held: str, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    ``docs`` has doc_id, text and a boolean column ``held`` of rows that the model must not learn from; n-grams have
    up to ``order`` tokens.
    """
    post = B.Post(B.text_bytes(docs))
    buckets = post.buckets
    texts = B.to_blocks(docs, post.blocks, [F.coalesce(F.col(held), F.lit(False)).alias("held")])
    # later steps need the numbers of the tokens only: texts are split, hashed and sorted once
    parts = max(8, -(-post.blocks // BLOCKS_PER_PART))
    rows = texts.repartition(parts, "block").groupBy("block")
    rows = B.bucketed(rows.applyInArrow(lambda table: _Block.of_texts(table).row(B.one(table.column("block"))), _ROW), "block", parts)

    def unigrams(table: pa.Table) -> pa.Table:
        block = _Block.kept(table)
        pack = lambda a, b: np.int64(b - a).tobytes() + block.keys[a:b].tobytes() + _squeeze(block.counts[a:b].astype(np.uint32))
        return B.Outbox(block.keys, buckets).messages(B.one(table.column("block")), pack)

    first = B.checkpointed(post.answer(post.ask(rows, unigrams), _answer_unigrams))
    stats = [np.frombuffer(r, np.int64) for r in post.reports(first)]
    stats = np.sum(stats, axis=0) if stats else np.zeros(TOP + 5, np.int64)
    uni, ends = Unigrams(stats[:-1]), int(stats[-1])
    found: list[_Found] = []
    answers = first.where("to >= 0").withColumn("round", F.lit(1))

    def evaluate(table: pa.Table, got: pa.Table, known: list[_Found]) -> tuple:
        """The block, unigram counts of its tokens, their probability by the orders known, and the next order's k-grams."""
        of = lambda k: got.filter(pa.compute.equal(got.column("round"), k))
        block = _Block.kept(table)
        counts, only = _unigram_counts(block, of(1), buckets)
        gram, names, own, divisors = block.word, block.keys, counts, np.zeros(len(block.word), np.int64)
        p = uni.probability(counts[block.word])
        for k in range(2, len(known) + 3):
            if k > order:
                return block, counts, p, None
            level = _Level(block, k, gram, names, own, only, ends, divisors, uni.tokens, buckets)
            if k > len(known) + 1:
                return block, counts, p, level
            # by the order below at least the unknown event is left over; higher up only rounding could take it all
            level.take(of(k), known[k - 2], uni.unknown if k == 2 else 1e-15, _p_below(k, uni, known[k - 3] if k > 2 else None))
            p, divisors = level.probability(p)
            gram, names, own, only = level.gram, level.gram_names(), level.seen, level.only
        return block, counts, p, None

    for k in range(2, order + 1):

        def grams(table: pa.Table, got: pa.Table, known: list[_Found] = [*found]) -> pa.Table:  # noqa: B006
            return evaluate(table, got, known)[3].messages(B.one(table.column("block"))) if table.num_rows else B.mail([])

        ask = lambda table, got, grams=grams: grams(table, got)
        table = B.checkpointed(post.answer(post.ask_again(rows, answers, ask), _answer_grams(_p_below(k, uni, found[-1] if found else None))))
        found.append(_Found(post.reports(table)))
        answers = answers.unionAll(table.where("to >= 0").withColumn("round", F.lit(k)))

    def work(table: pa.Table, got: pa.Table) -> pa.Table:
        block, counts, p, _ = evaluate(table, got, found)
        c_word = counts[block.word]
        base = np.log10((c_word + 1) / (uni.tokens + uni.types + 1))
        heads = block.bounds[:-1]
        return pa.table(
            {
                "doc_id": block.ids,
                "held_out": block.held,
                "n_tokens": pa.array(np.diff(block.bounds), pa.int64()),
                "n_known": pa.array(np.add.reduceat((c_word > 0).astype(np.int64), heads), pa.int64()),
                "train_tokens": pa.array(np.full(len(heads), uni.tokens), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, heads)),
                "score": pa.array(np.add.reduceat(np.log10(p), heads)),
            }
        )

    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return post.follow(rows, answers, work, kind)


def op4_katz(spark, sf_dir: str) -> DataFrame:
    """Token counts, base_score and score of every document; documents with crc32(doc_id) mod 7 = 2 are held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held.alias("held")), "held")
