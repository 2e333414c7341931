"""Near-duplicate documents: MinHash candidates, links confirmed on full shingle sets, connected components.

1. One pass over the texts: each document's shingles are hashed and sorted; the leading bits of a hash name one of
   ``SLOTS`` bins and the least hash of a bin is its value (one permutation). An empty bin borrows from another by
   a fixed random sequence of bins until a full one is met (optimal densification). ``ROWS`` slots make a band.
2. Documents with equal sets form a class; only its least doc_id goes on.
3. Classes that share a band bucket are joined by star-shaped edges to the bucket's least id, so a bucket of n
   gives n - 1 edges. An edge counts if enough slots of both signatures agree: five standard deviations below the
   limit (``least_agreement``), so that boilerplate, which fills buckets with documents of a low similarity, chains
   nothing. In a bucket whose members are still apart, signatures (a byte for each slot) are compared in groups of
   bounded size: whoever stands outside the largest component is a pivot that all others are counted against.
4. Components of the edges that count are the candidate clusters. No pair that shares a bucket and whose signatures
   agree enough is split by them. Each cluster's full sets are compared in the same way, in chunks of bounded size:
   members that join the chunk's largest component need no turn as pivot, so a tight cluster takes few turns. No pairs
   are emitted, only the links that join components.
5. A cluster of several chunks shows hubs of each chunk's components to all chunks first. What still stands outside
   the cluster's largest component is then compared with every chunk, so no link between different sets is lost to a
   cluster's size. Chunks hold ``CHUNK_SHINGLES`` numbers, so a loose cluster of n sets is copied n / ``CHUNK_DOCS``
   times at most, and only for members that no hub is linked with.

At the default 48 bands of 7 rows a pair at similarity 0.85 shares no bucket with a chance of 1e-8; at 0.80, 1e-5.
Keys that many rows share (a class, bucket, cluster or hub) are joined by ``skew.keyed_join``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm import blocks as B
from lakemill.llm.components import connected_components
from lakemill.llm.memory import frugal, spared
from lakemill.llm.skew import keyed_join, only
from lakemill.llm.words import GOLDEN, U64, first_of_runs, mix, pair_name, plain, slices, split, window_hashes

SHINGLE = 5
ROWS, BANDS = 7, 48
SLOTS = ROWS * BANDS
#: A chunk of a cluster holds about so many documents and shingles at most; a task gets chunks of so many shingles.
CHUNK_DOCS, CHUNK_SHINGLES, TASK_SHINGLES = 4096, 1 << 21, 1 << 20
#: Signatures of a bucket that are compared at once, and that a task gets.
GROUP_MARKS, TASK_MARKS = 1024, 4096
#: Hubs that each chunk of a large cluster shows to all others.
HUBS = 8


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Shorter texts have one shingle: all their words."""
    words = split(texts)
    h = words.hashes(lower=True)
    names, where = window_hashes(h, words.bounds, width)
    at = np.searchsorted(where, words.bounds)
    out = []
    for i in range(len(texts)):
        a, b = int(words.bounds[i]), int(words.bounds[i + 1])
        if 0 < b - a < width:
            name = np.array([b - a], np.uint64)
            for x in range(a, b):
                name = pair_name(name, h[x : x + 1], 900)
            out.append(name)
        else:
            own = np.sort(names[at[i] : at[i + 1]])
            out.append(own[first_of_runs(own)])
    return out


_DONORS: dict[int, np.ndarray] = {}


def _donor(attempt: int) -> np.ndarray:
    if attempt not in _DONORS:
        _DONORS[attempt] = (mix(np.arange(SLOTS, dtype=np.uint64) + U64(attempt * SLOTS * int(GOLDEN) & (2**64 - 1))) % U64(SLOTS)).astype(np.int64)
    return _DONORS[attempt]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SLOTS`` values for each set; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    slot = ((values >> U64(32)) * U64(SLOTS) >> U64(32)).astype(np.int64)
    cell = doc * SLOTS + slot
    first = first_of_runs(cell)  # sets are sorted, so a bin's first value is its least
    out = np.zeros(len(sets) * SLOTS, np.uint64)
    full = np.zeros(len(sets) * SLOTS, bool)
    out[cell[first]] = values[first]
    full[cell[first]] = True
    empty = np.flatnonzero(~full)
    attempt = 1
    while len(empty):
        source = empty - empty % SLOTS + _donor(attempt)[empty % SLOTS]
        found = full[source]
        out[empty[found]] = out[source[found]]
        empty = empty[~found]
        attempt += 1
    return out.reshape(len(sets), SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = pair_name(key, rows[:, :, r], 901)
    return key


def least_agreement(percent: int, sizes: np.ndarray) -> np.ndarray:
    """Slots that must agree for a pair to be looked at, by the larger set's size.

    A set of n shingles fills about ``SLOTS`` (1 - exp(-n / ``SLOTS``)) slots of its own; so many independent trials
    have agreed. A pair at the limit falls short with a chance of 3e-7.
    """
    t = percent / 100
    trials = SLOTS * -np.expm1(-sizes / SLOTS)
    return SLOTS * (t - 5 * np.sqrt(t * (1 - t) / np.maximum(trials, 1)))


def _describe(batches):
    """doc_id, text -> doc_id, n, set name (two numbers), band keys, the low byte of each slot."""
    for batch in batches:
        texts = plain(batch.column("text"))
        ids = batch.column("doc_id")
        for a, b in slices(texts):
            sets = shingle_sets(texts.slice(a, b - a))
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            high, low = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            counts = np.zeros(b - a, np.int64)
            keys, marks = np.zeros(0, np.int64), [b""] * (b - a)
            if len(some):
                full = [sets[i] for i in some]
                heads = np.cumsum(sizes[some]) - sizes[some]
                values = np.concatenate(full)
                high[some] = np.add.reduceat(mix(values + GOLDEN), heads)
                low[some] = np.bitwise_xor.reduceat(mix(values ^ GOLDEN), heads)
                found = signatures(full)
                keys = band_keys(found).reshape(-1).view(np.int64)
                counts[some] = BANDS
                for i, row in zip(some, found.astype(np.uint8), strict=True):
                    marks[i] = row.tobytes()
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [pa.array(sizes), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns, pa.array(marks, pa.binary())], names=[x.split()[0] for x in _DESCRIBED.split(", ")])


_DESCRIBED = "doc_id bigint, n_shingles bigint, high bigint, low bigint, bands array<bigint>, marks binary"


def _rows_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _agree(percent: int):
    def work(batches):
        """Candidate edges whose signatures agree enough."""
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.maximum(batch.column("n_shingles").to_numpy(), batch.column("n_b").to_numpy())
            same = (_rows_of(batch.column("marks")) == _rows_of(batch.column("marks_b"))).sum(axis=1)
            keep = pa.array(same >= least_agreement(percent, sizes))
            yield batch.select(["a", "b"]).filter(keep)

    return work


def _sets(batches):
    """Rows with texts -> the same rows with packed shingle sets in their place."""
    for batch in batches:
        texts = plain(batch.column("text"))
        for a, b in slices(texts):
            packed = pa.array([s.tobytes() for s in shingle_sets(texts.slice(a, b - a))], pa.binary())
            part = batch.slice(a, b - a)
            yield part.set_column(part.schema.get_field_index("text"), "text", packed)


class _Group:
    """Some sets that are compared with one another; labels say which are known to be connected."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.sizes = np.array([len(s) for s in sets])
        self.heads = np.cumsum(self.sizes) - self.sizes
        values = np.concatenate(sets)
        order = np.argsort(values)
        codes = np.empty(len(values), np.int32)
        codes[order] = np.cumsum(first_of_runs(values[order])) - 1
        self.codes, self.flags = codes, np.zeros(len(values), np.int32)
        self.labels = np.unique(labels, return_inverse=True)[1]
        self.percent = percent

    def linked(self, i: int) -> np.ndarray:
        own = self.codes[self.heads[i] : self.heads[i] + self.sizes[i]]
        self.flags[own] = 1
        common = np.add.reduceat(self.flags[self.codes], self.heads)
        self.flags[own] = 0
        return np.flatnonzero(100 * common >= self.percent * (self.sizes + self.sizes[i] - common))

    def join(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Merges what is linked; the links that merged something."""
        out = []
        for j in others[self.labels[others] != self.labels[i]]:
            if self.labels[j] != self.labels[i]:
                self.labels[self.labels == self.labels[j]] = self.labels[i]
                out.append((i, int(j)))
        return out

    def all_links(self) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links that connect whatever is connected; and how many links each member was seen to have."""
        n, out, turned, seen = len(self.sizes), [], np.zeros(len(self.sizes), bool), np.zeros(len(self.sizes), np.int64)
        i = 0
        while True:
            turned[i] = True
            found = self.linked(i)
            seen[i] = len(found)
            seen[found] += 1
            out += self.join(i, found)
            counts = np.bincount(self.labels, minlength=n)
            waiting = np.flatnonzero((self.labels != counts.argmax()) & ~turned)
            if not len(waiting):
                return out, seen
            i = int(waiting[0])


class _Marks(_Group):
    """The same by signatures: links are pairs that agree enough."""

    def __init__(self, marks: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int):
        self.marks, self.sizes, self.percent = marks, sizes, percent
        self.labels = np.unique(labels, return_inverse=True)[1]

    def linked(self, i: int) -> np.ndarray:
        same = (self.marks == self.marks[i]).sum(axis=1)
        return np.flatnonzero(same >= least_agreement(self.percent, np.maximum(self.sizes, self.sizes[i])))


def _subgroups(table: pa.Table, columns: list[str]):
    keys = [table.column(c).to_numpy() for c in columns]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    edges = np.append(np.flatnonzero(new), len(order))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield order[a:b]


def _sets_of(table: pa.Table, rows: np.ndarray) -> list[np.ndarray]:
    sets = table.column("text")
    return [np.frombuffer(sets[int(r)].as_buffer(), np.uint64) for r in rows]


def _apart(percent: int):
    def work(table: pa.Table) -> pa.Table:
        """Edges that join what is apart in each (key, chunk, part) of buckets; only pivots (turn = true) are compared."""
        ids, label, sizes, turn = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "label", "n_shingles", "turn"))
        marks, out = table.column("marks"), []
        for rows in _subgroups(table, ["key", "chunk", "part"]):
            if not turn[rows].any() or (label[rows] == label[rows[0]]).all():
                continue
            own = np.frombuffer(b"".join(marks[int(r)].as_py() for r in rows), np.uint8).reshape(-1, SLOTS)
            group = _Marks(own, sizes[rows], label[rows], percent)
            for i in np.flatnonzero(turn[rows]):
                out += [(int(ids[rows[i]]), int(ids[rows[j]])) for i, j in group.join(int(i), group.linked(int(i)))]
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return work


#: rank 0: a link; above: one of its chunk's hubs; below: a member of a large cluster, with its set
_LINKS = "a bigint, b bigint, cluster bigint, chunk int, rank int, text binary"


def _links(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "cluster", "chunk", "rank", "text"])


def _within(percent: int):
    def work(table: pa.Table) -> pa.Table:
        """Links inside each (cluster, chunk); from chunks of large clusters also hubs and all sets."""
        ids, cluster, chunk = (table.column(c).to_numpy() for c in ("doc_id", "cluster", "chunk"))
        out = []
        for rows in _subgroups(table, ["cluster", "chunk"]):
            if len(rows) < 2 and table.column("chunks")[int(rows[0])].as_py() == 1:
                continue
            sets = _sets_of(table, rows)
            group = _Group(sets, np.arange(len(rows)), percent)
            found, seen = group.all_links()
            c, k = int(cluster[rows[0]]), int(chunk[rows[0]])
            out += [(int(ids[rows[i]]), int(ids[rows[j]]), c, k, 0, None) for i, j in found]
            if table.column("chunks")[int(rows[0])].as_py() > 1:
                best, rank = {}, np.argsort(-seen, kind="stable")
                for i in rank:
                    best.setdefault(int(group.labels[i]), int(i))
                    if len(best) == HUBS:
                        break
                out += [(int(ids[rows[i]]), int(ids[rows[i]]), c, k, r + 1, None) for r, i in enumerate(best.values())]
                out += [(int(ids[r]), int(ids[r]), c, k, -1, s.tobytes()) for r, s in zip(rows, sets, strict=True)]
        return _links(out)

    return work


def _across(percent: int):
    def work(table: pa.Table) -> pa.Table:
        """Links between pivots (turn = true) and the others of each (cluster, chunk, part)."""
        ids, cluster, label, turn = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "cluster", "label", "turn"))
        out = []
        for rows in _subgroups(table, ["cluster", "chunk", "part"]):
            if not turn[rows].any() or turn[rows].all():
                continue
            group = _Group(_sets_of(table, rows), label[rows], percent)
            for i in np.flatnonzero(turn[rows]):
                out += [(int(ids[rows[i]]), int(ids[rows[j]]), int(cluster[rows[i]]), 0, 0, None) for i, j in group.join(int(i), group.linked(int(i)))]
        return _links(out)

    return work


def candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) between ids of ``reps`` (doc_id, n_shingles, bands, marks), so that any two of them that share a bucket
    and whose signatures agree enough are connected."""
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = B.checkpointed(banded.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("b < last"))
    if shared.isEmpty():
        return reps.sparkSession.createDataFrame([], "a bigint, b bigint")
    members = B.checkpointed(keyed_join(banded, shared.select("key", "b", "n"), "key"))
    stars = B.checkpointed(members.where("doc_id != b").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("n")))
    marks = reps.select("doc_id", "n_shingles", "marks")

    def agreeing(pairs: DataFrame) -> DataFrame:
        facing = B.checkpointed(pairs.join(marks.withColumnRenamed("doc_id", "a"), "a"))
        return B.checkpointed(keyed_join(facing, marks.toDF("b", "n_b", "marks_b"), "b").mapInArrow(frugal(_agree(percent)), "a bigint, b bigint"))

    # first each document's most frequent star; others only where that left both ends apart
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    edges = agreeing(best)
    label = connected_components(edges)
    ends = stars.select("a", "b").join(label.toDF("a", "label_a"), "a", "left").join(label.toDF("b", "label_b"), "b", "left")
    rest = ends.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = B.checkpointed(rest)
    if not rest.isEmpty():
        edges = edges.unionAll(agreeing(rest))
        label = connected_components(edges)

    # buckets whose members are still apart (with two members there was no other pair)
    label = label.toDF("doc_id", "label")
    labelled = members.where("n > 2").join(label, "doc_id", "left").select("doc_id", "key", F.coalesce("label", "doc_id").alias("label"))
    labelled = B.checkpointed(labelled)
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"))
    apart = B.checkpointed(
        apart.where("labels > 1").select("key", "main", F.ceil(F.col("n") / GROUP_MARKS).cast("int").alias("chunks"), F.lit(0).alias("zero"))
    )
    if apart.isEmpty():
        return edges
    rows = keyed_join(labelled, apart, "key").withColumn("outside", F.col("label") != F.col("main"))
    outside = rows.where("outside").groupBy("key").agg(F.ceil(F.count("*") / GROUP_MARKS).cast("int").alias("parts"))
    rows = keyed_join(rows, outside, "key").withColumn("home", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int"))
    until = lambda c: F.sequence(F.col("zero"), F.col(c) - 1)
    kept = ["doc_id", "key", "label"]
    # a member meets every part of the pivots in its chunk, a pivot its part in every chunk; in one chunk, once
    still = rows.select(*kept, F.col("home").alias("chunk"), F.explode(until("parts")).alias("part"), ((F.col("chunks") == 1) & F.col("outside") & (F.col("own") == F.col("part"))).alias("turn"))
    moving = rows.where("outside and chunks > 1").select(*kept, F.explode(until("chunks")).alias("chunk"), F.col("own").alias("part"), F.lit(True).alias("turn"))
    found = still.unionAll(moving).join(marks, "doc_id")
    with B.cleaning(reps.sparkSession):
        signatures_held = rows.agg(F.sum("parts")).first()[0] or 0
    bins = max(8, -(-signatures_held // TASK_MARKS))
    found = found.withColumn("bin", F.pmod(F.xxhash64("key", "chunk", "part"), F.lit(bins)).cast("int"))
    work = _apart(percent)
    return edges.unionAll(B.checkpointed(found.groupBy("bin").applyInArrow(lambda table: spared(work(table)), "a bigint, b bigint")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * common >= percent * union of their sets of 5-word shingles (A-Z lower-cased).
    Defined cases: a text without words (null, empty, blanks) has the empty set, is linked with nothing and kept;
    rows that share a doc_id count as one document in links; a row with a null doc_id gets a null component and is
    kept. Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full, full_at = B.written(docs.mapInArrow(frugal(_describe), _DESCRIBED))
    described = B.checkpointed(full.select("doc_id", "n_shingles", "high", "low"))
    sized = described.where("n_shingles > 0 and doc_id is not null")
    name = ["n_shingles", "high", "low"]
    classes = B.checkpointed(sized.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    alone = classes.select(F.col("rep").alias("doc_id"))
    reps = full.where("n_shingles > 0 and doc_id is not null").join(alone, "doc_id", "left_semi")

    # clusters dealt into chunks of bounded size
    reps, path = B.written(reps.select("doc_id", "n_shingles", "bands", "marks"))
    clusters = connected_components(candidate_edges(reps, percent)).toDF("doc_id", "cluster")
    member = B.checkpointed(clusters.join(reps.select("doc_id", "n_shingles").dropDuplicates(["doc_id"]), "doc_id"))
    size = member.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    )
    member = B.checkpointed(
        keyed_join(member, size, "cluster").select("doc_id", "n_shingles", "cluster", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"))
    )

    def compare(rows: DataFrame, keys: list[str], work, shingles: DataFrame) -> DataFrame:
        with B.cleaning(docs.sparkSession):
            bins = max(8, -(-(shingles.agg(F.sum("n_shingles")).first()[0] or 0) // TASK_SHINGLES))
        binned = rows.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(bins)).cast("int"))
        return B.checkpointed(binned.groupBy("bin").applyInArrow(lambda table: spared(work(table)), _LINKS))

    B.discard(docs.sparkSession, full_at, path)
    # only members' texts are read again into sets
    rows = only(docs, member, "doc_id").join(member.drop("n_shingles"), "doc_id")
    links = compare(rows.withColumn("text", F.col("text").cast("binary")).transform(lambda r: r.mapInArrow(frugal(_sets), r.schema)), ["cluster", "chunk"], _within(percent), member)
    sets = links.where("rank < 0").select(F.col("a").alias("doc_id"), "text")
    # clusters of several chunks
    large = member.where("chunks > 1")
    if not large.isEmpty():
        hubs = links.where("rank > 0").select(F.col("a").alias("doc_id"), "cluster", F.col("chunk").alias("home"))
        each = large.select("cluster", "chunks").distinct()
        turns = hubs.join(each, "cluster").select("doc_id", "cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "home")
        own = large.select("doc_id", "cluster", "chunk", F.lit(0).alias("part"), F.col("doc_id").alias("label"), F.lit(False).alias("turn"))
        roles = own.unionAll(turns.where("chunk != home").select("doc_id", "cluster", "chunk", F.lit(0), "doc_id", F.lit(True)))
        met = compare(keyed_join(roles, sets, "doc_id"), ["cluster", "chunk", "part"], _across(percent), large)
        links = links.where("rank >= 0").unionAll(met)
        found = connected_components(keyed_join(links.select("a", "b", "cluster"), each, "cluster").select("a", "b"))
        labelled = large.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
            "doc_id", "n_shingles", "cluster", "chunk", "chunks", F.coalesce("component", "doc_id").alias("label")
        )
        labelled = B.checkpointed(labelled)
        counts = labelled.groupBy("cluster", "label").count()
        main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
        outside = B.checkpointed(keyed_join(labelled, main, "cluster").where("label != main"))
        if not outside.isEmpty():
            parts = outside.groupBy("cluster").agg(F.ceil(F.count("*") / CHUNK_DOCS).cast("int").alias("parts"))
            everywhere = keyed_join(labelled, parts, "cluster").select(
                "doc_id", "cluster", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "label", F.lit(False).alias("turn"), "n_shingles"
            )
            turns = keyed_join(outside, parts, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int"))
            turns = turns.select(
                "doc_id", "cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "part", "label", F.lit(True).alias("turn"), "n_shingles"
            )
            roles = everywhere.unionAll(turns)
            rows = keyed_join(roles.drop("n_shingles"), sets, "doc_id")
            links = links.unionAll(compare(rows, ["cluster", "chunk", "part"], _across(percent), roles))
    components = connected_components(links.where("a != b").select("a", "b")).toDF("rep", "component")

    of_class = classes.join(components, "rep", "left").where("copies > 1 or component is not null").drop("copies")
    out = keyed_join(described.select("doc_id", *name), B.checkpointed(of_class), *name, how="left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, linked at a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that the least doc_id of their group of near-duplicates stands for."""
    return only(docs, near_duplicates(docs, percent).where("not kept"), "doc_id", "left_anti")
