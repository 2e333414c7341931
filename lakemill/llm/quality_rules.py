"""Quality rules: a decision list learned from labelled statistics, as one ordered Spark expression.

The statistics of a text are array and string functions inside its row; nothing is shuffled for them. Sequential
covering learns rules for label 0 from counts: the labelled rows' statistics are cut at thresholds (exact quantiles of
all labelled rows and of those with label 0), counted by cell, and each step of growing a rule is one aggregation of the
cells by (statistic, bin, label), a few hundred rows whatever the input. A rule adds the threshold condition with
the largest information gain, is pruned on rows held out from growing, and is kept if it is precise enough there.
Rows that a rule covers leave; the list ends when no precise rule is left, or at ``max_rules`` rules of
``max_conditions`` conditions each: the bounds that keep it readable, both parameters. All labelled rows count.

Defined cases: a null or empty text has no words and fails the base rules; statistics that divide by no words are 0;
null labels and labelled ids without a document are left out; without labels of both kinds the list is empty and
keeps all; rows that share a doc_id are counted each. Columns that clash with the statistics' names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.blocks import checkpointed
from lakemill.llm.skew import only

_SPACE = "\\x20\\x09-\\x0D"
MAX_RULES, MAX_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 8, 4, 0.9, 3
#: Digits after the first at which values are told apart, step by step; 17 in all tell any two doubles apart.
_DIGITS = (2, 5, 8, 11, 16)
_QUANTILES = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98]

#: Statistics that rules may use, from the base statistics.
RATIOS = {
    "words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbol_rate": "n_symbols / word_chars",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
    "distinct_rate": "n_distinct / n_words",
    "upper_rate": "n_upper / word_chars",
    "mark_rate": "n_marks / word_chars",
    "line_words": "n_words / n_lines",
}


def _kept_chars(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("bigint")


def _repeat_words(windows: Column) -> Column:
    """Words in windows that the array holds twice or more."""
    by_name = F.transform(F.array(F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))), lambda s: (
        F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["v"] == b["v"], F.array(a["i"], b["i"])))
    ))[0]
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(by_name, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-9).alias("last"))
    count = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper, n_marks, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != ""))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_two", F.zip_with("_hashes", F.slice("_hashes", 2, F.size("_hashes")), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("_four", F.zip_with("_two", F.slice("_two", 3, F.size("_two")), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn(
        "_five",
        F.slice(F.zip_with("_four", F.slice("_hashes", 5, F.size("_hashes")), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("_hashes") - 4, F.lit(0))),
    )
    out = out.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{_SPACE}]")))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": _kept_chars(text, "#*$%&|<>"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": _repeat_words(F.col("_five")),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_distinct": F.size(F.array_distinct("_hashes")).cast("bigint"),
            "n_upper": _kept_chars(text, "A-Z"),
            "n_marks": _kept_chars(text, "!?;:"),
        }
    ).drop("_words", "_hashes", "_two", "_four", "_five", "_lines")
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = _ratio(self.statistic)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:g}"


def _ratio(name: str) -> Column:
    parts = RATIOS[name].split(" / ")
    value = F.col(parts[0]).cast("double")
    return F.when(F.col(parts[1]) > 0, value / F.col(parts[1])).otherwise(0.0) if len(parts) > 1 else value


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule holds; the rules in their order."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def _test(rule: list[tuple[str, bool, int]]) -> Column:
    """A rule over bins: (statistic, at least, number of the threshold from 1)."""
    out = F.lit(True)
    for name, at_least, k in rule:
        out = out & ((F.col(name) >= k) if at_least else (F.col(name) < k))
    return out


def _thresholds(rows: DataFrame, totals: dict[str, int]) -> dict[str, list[float]]:
    """Of each statistic its quantiles (the value at place ceil(q n)) over all rows and over those with label 0, exactly.

    Values are counted; the driver gets counts of values rounded to three digits, then, inside the few of these that
    hold a quantile, of values with three digits more, and so on. A sketch would be one pass, but its answer depends
    on the order in which partitions are merged, so that a rerun could learn other rules.
    """
    pairs = [(n, k, F.col(n) if k == "all" else F.when(F.col("y") == 0, F.col(n))) for n in RATIOS for k in totals]
    structs = [F.struct(F.lit(f"{n} {k}").alias("of"), v.alias("v")) for n, k, v in pairs]
    values = checkpointed(rows.select(F.inline(F.array(*structs))).where("v is not null").groupBy("of", "v").agg(F.count("*").alias("n")))
    cut: dict[str, set[float]] = {n: set() for n in RATIOS}
    # by the cell to look into: the places wanted there, from 1
    wanted = {f"{n} {k}": {max(ceil(q * totals[k]), 1) for q in _QUANTILES} for n, k, _ in pairs}
    cell = F.col("of")
    for digits in _DIGITS:
        inner = F.concat_ws(" ", "of", F.format_string(f"%.{digits}e", F.col("v")))
        found = values.where(cell.isin(*wanted)).groupBy(cell.alias("cell"), inner.alias("inner"))
        found = found.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        before, deeper = dict.fromkeys(wanted, 0), {}
        for r in sorted(found, key=lambda r: r.low):
            for place in wanted[r.cell]:
                if before[r.cell] < place <= before[r.cell] + r.n:
                    if r.low == r.high:
                        cut[r.inner.split(" ")[0]].add(r.low)
                    else:
                        deeper.setdefault(r.inner, set()).add(place - before[r.cell])
            before[r.cell] += r.n
        if not deeper:
            break
        wanted, cell = deeper, inner
    return {n: sorted(v) for n, v in cut.items()}


def learn(labelled: DataFrame, label: str = "quality", max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[list[Condition]]:
    """The decision list for label 0 from rows with the statistics and a label of 0 or 1."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(label).alias("y"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *[_ratio(n).alias(n) for n in RATIOS]
    )
    of = rows.agg(F.count_if(F.col("y") == 0).alias("low"), F.count_if(F.col("y") == 1).alias("high")).first()
    if not of["low"] or not of["high"]:
        return []
    cut = _thresholds(rows, {"all": of["low"] + of["high"], "low": of["low"]})
    bins = [sum((F.col(n) >= t).cast("int") for t in cut[n]).alias(n) for n in RATIOS]
    cells = checkpointed(rows.select("y", "held", *bins).groupBy("y", "held", *RATIOS).agg(F.count("*").alias("n")))
    left = F.lit(True)
    rules: list[list[tuple[str, bool, int]]] = []
    while len(rules) < max_rules:
        rule = _grow(cells.where(left & ~F.col("held")), cut, max_conditions)
        if not rule:
            break
        rule, precision, covered = _prune(cells.where(left & F.col("held")), rule)
        if precision < LEAST_PRECISION or covered < LEAST_COVER:
            break
        rules.append(rule)
        left = left & ~_test(rule)
    return [[Condition(n, up, cut[n][k - 1]) for n, up, k in rule] for rule in rules]


def _grow(cells: DataFrame, cut: dict[str, list[float]], max_conditions: int) -> list[tuple[str, bool, int]]:
    rule: list[tuple[str, bool, int]] = []
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("bin")) for n in RATIOS]))
    while len(rule) < max_conditions:
        counts = {(r.statistic, r.bin): (r.low, r.high) for r in (
            cells.where(_test(rule)).select("y", "n", pairs).groupBy("statistic", "bin")
            .agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("high"))
            .collect()
        )}
        first = next(iter(RATIOS))
        low = sum(v[0] for (s, _), v in counts.items() if s == first)
        high = sum(v[1] for (s, _), v in counts.items() if s == first)
        if not low or low >= 0.99 * (low + high):
            break
        base, best = log2(low / (low + high)), (0.0, None)
        for n in RATIOS:
            for k in range(1, len(cut[n]) + 1):
                for up in (True, False):
                    p = sum(v[0] for (s, b), v in counts.items() if s == n and (b >= k) == up)
                    q = sum(v[1] for (s, b), v in counts.items() if s == n and (b >= k) == up)
                    if p >= LEAST_COVER and (gain := p * (log2(p / (p + q)) - base)) > best[0] + 1e-9:
                        best = gain, (n, up, k)
        if not best[1]:
            break
        rule.append(best[1])
    return rule


def _prune(cells: DataFrame, rule: list[tuple[str, bool, int]]) -> tuple[list[tuple[str, bool, int]], float, int]:
    """The start of the rule with the best (low - high) / (low + high) on held-out cells, its precision and cover."""
    sums = []
    for k in range(1, len(rule) + 1):
        for y in (0, 1):
            sums.append(F.sum(F.when(_test(rule[:k]) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"s{k}_{y}"))
    got = cells.agg(*sums).first()
    worth = lambda k: ((got[f"s{k}_0"] or 0) + 0.0) / max(1, (got[f"s{k}_0"] or 0) + (got[f"s{k}_1"] or 0))
    k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
    return rule[:k], worth(k), got[f"s{k}_0"] or 0


def label_rows(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row of ``docs``."""
    stats = checkpointed(statistics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text"))
    rules = learn(stats.join(labels, "doc_id"))
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose doc_id the base rules or the learned list reject.

    Rows that share a doc_id go if one of them is rejected; rows with a null doc_id stay.
    """
    return only(docs, judged(docs, labels).where("not kept").select("doc_id"), "doc_id", "left_anti")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every document."""
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), label_rows(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
