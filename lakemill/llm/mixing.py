"""Interleaving sources to target weights by Pfair scheduling, in DataFrame operations.

With w a source's share of all weights, its block j (from 1) may run from slot floor((j - 1) / w) and must have run
by slot ceil(j / w). In each slot, of the blocks released, the one with the earliest deadline runs (ties: by source).
All deadlines are met, so after any number of slots each source is less than one block from its share of the weights
as they were asked for: shares are compared as whole numbers, nothing is rounded.

Every source is scheduled by itself, in blocks of ``block_rows`` rows. Up to ``DRIVER_BLOCKS`` blocks of at most
``MOST_SOURCES`` sources the driver works the schedule out; more are scheduled by tasks, with the same slots (see
``pfair``). ``MOST_BLOCKS``, if set, makes the blocks of larger inputs larger instead, so that there are about so many.

A source that has run out leaves its slots free and the others close up: no row is dropped or repeated. Up to the
first slot that may be free (``on_target``) the mixture holds; past it each remaining source keeps its own pace.

Defined cases: a null source is a source of its own; sources without a given weight follow after the others, spread
evenly; equal keys are ordered by doc_id, so only rows with an equal doc_id can change places; no rows give no rows.
Columns of the rows pass unchanged; names that begin with ``_mix_`` are taken.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm import pfair
from lakemill.llm.ranks import range_count, range_of_key, ranked, shuffle_key

BLOCK_ROWS, SEED = 4, 23
DRIVER_BLOCKS, MOST_SOURCES = 100_000, 1000
#: None: blocks keep their rows, however many there are.
MOST_BLOCKS: int | None = None


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights; sources without a weight are left out."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(1, *(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def schedule(weights: dict[str, int], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block from 1, slot from 0) of all blocks by earliest deadline first; slots without a block are free."""
    total = sum(weights.values())
    release = lambda s, j: (j - 1) * total // weights[s]
    deadline = lambda s, j: -(-j * total // weights[s])
    coming = [(0, s, 1) for s in sorted(weights) if blocks[s]]
    ready: list[tuple[int, str, int]] = []
    out, slot = [], 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (deadline(s, j), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j < blocks[s]:
            heapq.heappush(coming, (release(s, j + 1), s, j + 1))
        slot += 1
    return out


def _literal(spark, rows: list[tuple], ddl: str) -> DataFrame:
    names = [x.split()[0] for x in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kinds = ", ".join(f"{a}: {b}" for a, b in (x.split() for x in ddl.split(", ")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


def root_weight(n: int) -> float:
    """The square root of a number of rows, to six decimals."""
    return math.isqrt(n * 10**12) / 10**6


def _in_source(rows: DataFrame, groups: list[str], seed: int, ranges: int) -> DataFrame:
    """Rank (_mix_rank) and number of rows (_mix_n) in the seeded order of each group."""
    rows = rows.withColumn("_mix_key", shuffle_key(seed, "doc_id"))
    rows = rows.withColumn("_mix_piece", range_of_key(F.col("_mix_key"), ranges))
    return ranked(rows, groups, "_mix_piece", ["_mix_key", "doc_id"], "_mix_rank", "_mix_n").drop("_mix_piece", "_mix_key")


def _spread(rows: DataFrame, ranges: int) -> DataFrame:
    """New ranks of rows that have been ranked in their source: over all of them, each source spread evenly."""
    offset = (F.pmod(F.xxhash64("_mix_s"), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))
    rows = rows.withColumn("_mix_time", (F.col("_mix_rank") + offset) / F.col("_mix_n")).drop("_mix_n")
    rows = rows.withColumn("_mix_piece", F.floor(F.least(F.col("_mix_time"), F.lit(1.0)) * ranges).cast("int"))
    rows = rows.withColumnRenamed("_mix_rank", "_mix_own")
    return ranked(rows, [], "_mix_piece", ["_mix_time", "_mix_s", "_mix_own", "doc_id"], "_mix_rank", "_mix_n")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED, most_sources: int | None = None) -> tuple[DataFrame, int]:
    """``docs`` with _mix_slot, _mix_seq (place of the block), _mix_rank, _mix_block, _mix_weight (the share asked for)
    and _mix_on_target; and the number of blocks.

    Without ``weights`` each source's weight is the square root of its rows (to six decimals). More than
    ``most_sources`` sources are scheduled by tasks.
    """
    spark, most = docs.sparkSession, MOST_SOURCES if most_sources is None else most_sources
    ranges = range_count(docs)
    # '' stands for the null source
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    counts = docs.groupBy(stratum.alias("s")).agg(F.count("*").alias("n"))
    if weights is not None:  # as many as the caller gave
        given = _literal(spark, [(f"s{s}", float(w)) for s, w in weights.items() if w > 0], "s string, w double")
        unweighted = counts.join(F.broadcast(given), "s", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counts = counts.join(F.broadcast(given), "s")
        top = counts.collect()
        whole = whole_weights({r.s: r.w for r in top})
        weight_of = lambda s, n: whole[s]
        alike = Counter((whole[r.s], r.n) for r in top)
    else:
        unweighted = 0
        weight_of = lambda s, n: math.isqrt(n * 10**12)
        # sources of the same number of rows: there are fewer such numbers than the root of twice all rows
        alike = Counter({(weight_of("", r.n), r.n): r["count"] for r in counts.groupBy("n").count().collect()})
    per_block = max(block_rows, -(-(sum(n * k for (_, n), k in alike.items()) + unweighted) // MOST_BLOCKS)) if MOST_BLOCKS else block_rows
    classes = [(w, -(-n // per_block), k) for (w, n), k in alike.items()]
    total = sum(w * k for w, _, k in classes)
    blocks = sum(b * k for _, b, k in classes)
    gap = min((b * total // w for w, b, _ in classes), default=0)

    own_columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = _in_source(docs.withColumn("_mix_s", stratum), ["_mix_s"], seed, ranges)
    block = F.expr(f"_mix_rank div {per_block}")
    late = None
    if unweighted:
        known = F.broadcast(given.select(F.col("s").alias("_mix_s")))
        late = _spread(rows.join(known, "_mix_s", "left_anti"), ranges).withColumn("_mix_block", block)
        rows = rows.join(known, "_mix_s", "left_semi")
    rows = rows.withColumn("_mix_block", block)
    if blocks <= DRIVER_BLOCKS and sum(k for _, _, k in classes) <= most:
        sources = {r.s: r.n for r in (counts.collect() if weights is None else top)}
        rows, end = _driver_slots(rows, {s: weight_of(s, n) for s, n in sources.items()}, {s: -(-n // per_block) for s, n in sources.items()})
    else:
        plan = pfair.plan(counts.select("s", "n"), classes, weight_of, per_block)
        end = plan.agg(F.max("slot") + 1).first()[0] if unweighted else None
        plan = plan.toDF("_mix_s", "_mix_block", "_mix_slot", "_mix_seq", "_mix_weight")
        rows = rows.join(plan, ["_mix_s", "_mix_block"])
    new = ["_mix_rank", "_mix_block", "_mix_slot", "_mix_seq", "_mix_weight"]
    rows = rows.select(*own_columns, *new)
    if unweighted:
        after = {"_mix_slot": F.col("_mix_block") + end, "_mix_seq": F.col("_mix_block") + blocks, "_mix_weight": F.lit(0.0)}
        rows = rows.unionAll(late.withColumns(after).select(*own_columns, *new))
    return rows.withColumn("_mix_on_target", F.col("_mix_slot") < gap), blocks + -(-unweighted // per_block)


def _driver_slots(rows: DataFrame, weights: dict[str, int], blocks: dict[str, int]) -> tuple[DataFrame, int]:
    """``rows`` with _mix_slot, _mix_seq and _mix_weight by the driver's schedule, and the first slot after it."""
    plan, total = schedule(weights, blocks), sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    seqs: dict[str, list[int]] = {s: [] for s in weights}
    for seq, (s, _, slot) in enumerate(plan):
        slots[s].append(slot)
        seqs[s].append(seq)
    # a row for each source, two numbers for each block
    table = [(s, weights[s] / total, slots[s], seqs[s]) for s in weights]
    table = _literal(rows.sparkSession, table, "_mix_s string, _mix_weight double, _mix_slots array<bigint>, _mix_seqs array<bigint>")
    at = F.col("_mix_block").cast("int")
    rows = rows.join(F.broadcast(table), "_mix_s").withColumns({"_mix_slot": F.get("_mix_slots", at), "_mix_seq": F.get("_mix_seqs", at)})
    return rows, plan[-1][2] + 1 if plan else 0


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """The rows and columns of ``docs`` in the mixture's order: partition after partition, and inside each."""
    rows, blocks = mix(docs, **how)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(parts, piece_of(blocks, parts)).sortWithinPartitions("_mix_seq", "_mix_rank")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def piece_of(blocks: int, pieces: int) -> Column:
    """Which of so many nearly equal parts of the mixture's order a row of ``mix`` lies in."""
    return F.expr(f"int(_mix_seq * {pieces} div {max(1, blocks)})")


def positions(docs: DataFrame, position: str = "position") -> DataFrame:
    """``docs`` with each row's place from 0 (bigint) in the order that ``mixed_order`` has left them in.

    A folder that was written in that order is read back in another: Spark packs files and parts of files by size. So
    the place comes from the number of the part file and the row's index in it. Any other frame (a cached one, say)
    has its rows in order, partition after partition. Only the counts, one for each file or partition, are summed in order.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        path = F.col("_metadata.file_path")
        # the task's number, and of the files of one task the file's; numbers outgrow their leading zeros
        order = [F.regexp_extract(F.element_at(F.split("_mix_part", "/"), -1), f"{before}(\\d+)", 1).cast("int") for before in ("^part-", "-c")]
        part, index = path, F.col("_metadata.row_index")
    else:
        part, order = F.spark_partition_id(), []
        index = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    counts = docs.select(part.alias("_mix_part")).groupBy("_mix_part").agg(F.count("*").alias("_mix_n"))
    before = F.sum("_mix_n").over(Window.orderBy(*order, "_mix_part")) - F.col("_mix_n")
    counts = counts.select("_mix_part", before.alias("_mix_before"))
    rows = docs.select("*", part.alias("_mix_part"), index.alias("_mix_index")).join(F.broadcast(counts), "_mix_part")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("_mix_before") + F.col("_mix_index")).cast("bigint").alias(position))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, target_weight, block, slot, position and on_target of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    rows, blocks = mix(docs)
    rows = rows.withColumn("_mix_piece", piece_of(blocks, range_count(docs)))
    rows = ranked(rows, [], "_mix_piece", ["_mix_seq", "_mix_rank"], "position", "_mix_n")
    return rows.select(
        "doc_id",
        "source",
        F.col("_mix_weight").alias("target_weight"),
        F.col("_mix_block").alias("block"),
        F.col("_mix_slot").alias("slot"),
        "position",
        F.col("_mix_on_target").alias("on_target"),
    )
