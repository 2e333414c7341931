"""Earliest deadline first over any number of sources and blocks, with the work dealt to tasks by pieces of time.

Block j (from 1) of a source with share w may run from slot floor((j - 1) / w) and must have run by slot ceil(j / w); in
each slot, of the blocks released, the one with the earliest deadline runs (ties: by source). ``run`` does that one
slot after another. ``plan`` gives the same slots from tasks that each see a bounded number of blocks:

1. Time is cut into pieces. What a piece's own blocks do in it if nothing waits at its start is found for each piece by
   itself: each is done or left over. Whatever waits at the start can use any slot, so with it the first blocks, by
   deadline, of those waiting and those done run, as many as there are slots; the others wait, with those left over.
   (Sets that fit the piece are a matroid: the own blocks' one beside the free one of the waiting, cut to its slots.)
2. So a number of blocks is all that a piece takes from those that wait. Blocks that may wait past their piece go into
   ranges of deadlines; the driver only counts, for each piece and range, how many run there. Blocks that are due in
   the piece that releases them always run there, as every deadline is met.
3. Inside each range the counted number of first blocks is given to each piece, and each piece puts what it got into
   its slots.

Pieces and ranges end at about each ``STEP`` blocks, wherever sources have many blocks released or due in the same slot
(such blocks count as waiting at the start of a piece, and a range of one deadline is cut by names of sources). Where
they end has no influence on the slots. The driver gets counts: of sources of equal weight and rows, and of step 2.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks between two cuts of time or of deadlines.
STEP = 50_000
#: How a block stands in the piece that releases it.
START, DONE, LEFT, SETTLED = range(4)

_BLOCKS = "s string, j bigint, release bigint, deadline bigint, share double, piece bigint, kind int, bin bigint"
_SLOTS = "s string, block bigint, slot bigint, seq bigint, share double"


def release(j: int, weight: int, total: int) -> int:
    return (j - 1) * total // weight


def deadline(j: int, weight: int, total: int) -> int:
    return -(-j * total // weight)


def run(jobs: list[tuple], end: float = math.inf) -> Iterator[tuple[int, tuple]]:
    """(slot, job) of jobs (release, deadline, source, ...) by earliest deadline first, in the slots before ``end``."""
    jobs = sorted(jobs)
    ready: list[tuple] = []
    at = slot = 0
    while at < len(jobs) or ready:
        if not ready:
            slot = max(slot, jobs[at][0])
        if slot >= end:
            return
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, (*jobs[at][1:], jobs[at][0]))
            at += 1
        *job, since = heapq.heappop(ready)
        yield slot, (since, *job)
        slot += 1


def _reached(count: Callable[[int], float], step: int, blocks: int, last: int) -> list[int]:
    """The first times at which a rising count has reached each multiple of the step."""
    out, low = [], 0
    for goal in range(step, blocks + step, step):
        high = last
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if count(middle) >= min(goal, blocks) else (middle + 1, high)
        out.append(low)
    return sorted(set(out))


def cuts(classes: list[tuple[int, int, int]], step: int) -> tuple[list[int], list[int]]:
    """Starts of the pieces of time, and the deadlines that bound ranges, for (weight, blocks, sources with both).

    The counts are in floating point: an error moves a cut, which changes no slot.
    """
    total = sum(w * k for w, _, k in classes)
    period = np.array([total / w for w, _, _ in classes])
    blocks, sources = (np.array(x, float) for x in ([b for _, b, _ in classes], [k for _, _, k in classes]))
    n, last = sum(b * k for _, b, k in classes), max(deadline(b, w, total) for w, b, _ in classes) + 1
    released = lambda t: float((np.minimum(blocks, np.ceil(t / period * (1 - 1e-15))) * sources).sum())
    due = lambda t: float((np.minimum(blocks, np.floor(t / period * (1 + 1e-15))) * sources).sum())
    ends = set(_reached(released, step, n, last))
    # many at once: they come first in their piece
    ends |= {t - 1 for t in ends if released(t) - released(t - 1) > step}
    ends = [0, *sorted(ends - {0})]
    starts, waiting = [], 0.0
    for a, b in zip(ends, [*ends[1:], math.inf], strict=True):
        to = n if b == math.inf else released(b)
        coming, inside = to - released(a), to - released(a + 1)
        # also a cut at each step of the slots that what waits can take
        starts += [a, *range(a + step, int(min(b, a + waiting + coming + 1)), step)]
        waiting = max(waiting + coming - (b - a), inside)
    return starts, _reached(due, step, n, last)


def quotas(counts: list[tuple[int, int, int, int]], starts: list[int]) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """From (piece, kind, range, blocks): for each range the (piece, blocks) that run there, and the blocks that run before each piece."""
    of: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for piece, kind, bin_, n in counts:
        of[piece, kind].append((bin_, n))
    given: dict[int, list[tuple[int, int]]] = defaultdict(list)
    waiting: Counter = Counter()
    order: list[int] = []
    before, ran = [], 0

    def add(more: list[tuple[int, int]]) -> None:
        for bin_, n in more:
            if not waiting[bin_]:
                heapq.heappush(order, bin_)
            waiting[bin_] += n

    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], math.inf], strict=True)):
        before.append(ran)
        add(of[piece, START])
        add(of[piece, DONE])
        settled = sum(n for _, n in of[piece, SETTLED])
        ran, free = ran + settled, b - a - settled
        while free and order:
            n = min(waiting[order[0]], free)
            given[order[0]].append((piece, n))
            waiting[order[0]] -= n
            ran, free = ran + n, free - n
            if not waiting[order[0]]:
                heapq.heappop(order)
        add(of[piece, LEFT])
    return dict(given), before


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table({f: pa.array(c, kinds[k]) for (f, k), c in zip(fields, columns, strict=True)})


def _rows(table, *names: str) -> list[tuple]:
    return list(zip(*[table.column(n).to_pylist() for n in names], strict=True))


def _released(weight: Callable[[str, int], int], total: int, per_block: int, step: int, starts: list[int], marks: list[int], names: list[str]):
    """All blocks, with their piece and range; ``kind`` says if they come with the first slot of the piece."""

    def work(batches):
        out = []
        for batch in batches:
            for s, n, part in _rows(batch, "s", "n", "part"):
                w = weight(s, n)
                for j in range(part * step + 1, min(-(-n // per_block), (part + 1) * step) + 1):
                    r, d = release(j, w, total), deadline(j, w, total)
                    piece = bisect_right(starts, r) - 1
                    at = bisect_left(marks, d)
                    exact = at < len(marks) and marks[at] == d
                    bin_ = (2 * at + exact) * (len(names) + 1) + (bisect_right(names, s) if exact else 0)
                    out.append((s, j, r, d, w / total, piece, START if starts[piece] == r else LEFT, bin_))
                    if len(out) == 10_000:
                        yield from _table(out, _BLOCKS).to_batches()
                        out = []
        yield from _table(out, _BLOCKS).to_batches()

    return work


def _alone(starts: list[int]):
    """What a piece's own blocks do if none wait at its start."""

    def work(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        end = starts[piece + 1] if piece + 1 < len(starts) else math.inf
        jobs = _rows(table, "release", "deadline", "s", "j", "share", "bin")
        ran = {(s, j) for _, (_, _, s, j, _, _) in run(jobs, end)}
        out = [(s, j, r, d, share, piece, SETTLED if d <= end else DONE if (s, j) in ran else LEFT, bin_) for r, d, s, j, share, bin_ in jobs]
        return _table(out, _BLOCKS)

    return work


def _given(given: dict[int, list[tuple[int, int]]], starts: list[int]):
    """The blocks of a range with the piece that each runs in, where it waits at the start or is released."""

    def work(table: pa.Table) -> pa.Table:
        bin_ = table.column("bin")[0].as_py()
        jobs = sorted((piece + (kind == LEFT), d, s, j, r, share) for piece, kind, d, s, j, r, share in _rows(table, "piece", "kind", "deadline", "s", "j", "release", "share"))
        out, ready, at = [], [], 0
        for piece, n in given[bin_]:
            while at < len(jobs) and jobs[at][0] <= piece:
                heapq.heappush(ready, jobs[at][1:])
                at += 1
            for _ in range(n):
                d, s, j, r, share = heapq.heappop(ready)
                out.append((s, j, max(r, starts[piece]), d, share, piece, DONE, bin_))
        return _table(out, _BLOCKS)

    return work


def _placed(before: list[int]):
    def work(table: pa.Table) -> pa.Table:
        first = before[table.column("piece")[0].as_py()]
        done = run(_rows(table, "release", "deadline", "s", "j", "share"))
        return _table([(s, j - 1, slot, first + i, share) for i, (slot, (_, _, s, j, share)) in enumerate(done)], _SLOTS)

    return work


def plan(sources: DataFrame, classes: list[tuple[int, int, int]], weight: Callable[[str, int], int], per_block: int) -> DataFrame:
    """(s, block from 0, slot, seq, share) of all blocks of ``sources`` (s, n: name, not null, and number of rows).

    ``weight`` gives a source's weight by name and rows; ``classes`` counts the sources by weight and blocks.
    """
    step, total = STEP, sum(w * k for w, _, k in classes)
    starts, marks = cuts(classes, step)
    names: list[str] = []
    if sum(k for _, _, k in classes) > step:  # blocks of one deadline are at most one of each source
        names = sorted(r.s for r in sources.where(F.pmod(F.xxhash64("s"), F.lit(max(1, step // 4))) == 0).select("s").collect())
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"((n + {per_block - 1}) div {per_block} - 1) div {step}")))
    # a given number, so that few rows are not put into one task: each stands for up to so many blocks
    blocks = sources.select("s", "n", parts.alias("part")).repartition(sum(b * k for _, b, k in classes) // step + 1, "s", "part")
    blocks = blocks.mapInArrow(_released(weight, total, per_block, step, starts, marks, names), _BLOCKS)
    alone = blocks.where(F.col("kind") != START).groupBy("piece").applyInArrow(_alone(starts), _BLOCKS)
    waiting = blocks.where(F.col("kind") == START).unionAll(alone.where(F.col("kind") != SETTLED))
    bin_ = F.when(F.col("kind") == SETTLED, -1).otherwise(F.col("bin")).alias("bin")
    counts = blocks.where(F.col("kind") == START).unionAll(alone).groupBy("piece", "kind", bin_).count().collect()
    given, before = quotas([tuple(r) for r in counts], starts)
    dealt = waiting.groupBy("bin").applyInArrow(_given(given, starts), _BLOCKS)
    return alone.where(F.col("kind") == SETTLED).unionAll(dealt).groupBy("piece").applyInArrow(_placed(before), _SLOTS)
