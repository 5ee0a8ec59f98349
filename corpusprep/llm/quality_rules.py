"""Quality rules: a decision list learned from labelled statistics.

Every text gets a row of interpretable statistics. Sequential covering learns
rules that reject: a rule grows by adding the threshold that gains most
information on two thirds of the labelled rows, is pruned back on the other
third, and the rows it covers leave before the next rule grows. The ordered
rules become one conditional expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import least_hashes, let, words

SYMBOLS = "#*$%&|<>"
#: The base rule: fewer words fail, and more than this percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Labelled rows that the rules are learned from, those of the smallest hashes.
LABELLED_ROWS = 20_000
#: Candidate thresholds of each statistic, at even quantiles.
THRESHOLDS = 32
#: Rules in a list, and conditions in a rule.
MOST_RULES, MOST_CONDITIONS = 12, 4
#: Share of the pruning rows that a rule covers which must be of low quality.
LEAST_PRECISION = 0.9

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that rules may test, from the counts above and those of _counts.
FEATURES = {
    "word_length": lambda: F.try_divide("word_chars", "n_words"),
    "symbols_per_word": lambda: F.try_divide("n_symbols", "n_words"),
    "duplicate_lines": lambda: F.try_divide("n_dup_lines", "n_lines"),
    "repeated_words": lambda: F.try_divide("n_repeat_words", "n_words"),
    "distinct_words": lambda: F.try_divide("n_distinct", "n_words"),
    "capitals": lambda: F.try_divide("n_capitals", "word_chars"),
    "words": lambda: F.col("n_words").cast("double"),
}


def repeated_words(found: Column) -> Column:
    """How many words stand in a window of WINDOW words found twice or more.

    Windows are compared by hash. Only a text with equal windows is looked at
    further: sorted by (hash, place), equal windows are neighbours, and their
    places, sorted, cover words from left to right. Sorting bounds the work of
    very long texts."""
    windows = F.when(F.size(found) >= WINDOW,
                     F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)),
                                 lambda i: F.xxhash64(F.slice(found, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<long>"))

    def covered(grams):
        def flagged(s):
            return F.filter(s, lambda p, i: F.get(s, i - 1)["g"].eqNullSafe(p["g"]) | F.get(s, i + 1)["g"].eqNullSafe(p["g"]))
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        places = F.sort_array(F.transform(let(placed, flagged), lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda s, p: F.struct(
            (s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n"), (p + WINDOW).alias("end")))["n"]

    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus the counts of every whole text, all long.

    Null and empty texts count 0 everywhere. A column of ``docs`` that has the
    name of a count is replaced."""
    counts = [*BASE, "n_lines", "n_distinct", "n_capitals"]
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*counts, text_col.lower()}]
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(*others, words(text_col).alias("_words"),
                        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    joined = split.withColumn("_letters", F.array_join("_words", ""))
    without = lambda chars: F.length("_letters") - F.length(F.translate(F.col("_letters"), chars, ""))
    found = {"n_words": F.size("_words"), "word_chars": F.length("_letters"), "n_symbols": without(SYMBOLS),
             "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
             "n_repeat_words": repeated_words(F.col("_words")), "n_lines": F.size("_lines"),
             "n_distinct": F.size(F.array_distinct("_words")),
             "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    return joined.select(*[c for c in others], *[found[c].cast("long").alias(c) for c in counts])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _feature(name: str) -> Column:
    return F.coalesce(FEATURES[name]().cast("double"), F.lit(0.0))  # 0 of nothing is 0


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = _feature(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects."""

    rules: list[list[Condition]] = field(default_factory=list)

    def matches(self, rule: list[Condition]) -> Column:
        both = F.lit(True)
        for c in rule:
            both = both & c.column()
        return both

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            verdict = F.when(self.matches(rule), F.lit(False)) if verdict is None else verdict.when(self.matches(rule), F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def __str__(self):
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) covered rows to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, label: str = "quality") -> DecisionList:
    """A decision list from rows of statistics with a 0/1 label (1 is good).

    Rows without a label are left out (any value but 0 counts as 1), as are those that the base rule fails.
    Each step is one aggregation of the rows into counts by (statistic,
    threshold bin, label); only those counts reach the driver. No rows, or
    rows of one label only, give an empty list, which keeps everything."""
    names = list(FEATURES)
    # the statistics are written before any filter: Spark would push a filter on
    # them below the projection that computes them, and compute them again there
    rows = checkpoint(labelled.select(
        (F.col(label) == 0).cast("int").alias("bad"), *[_feature(n).alias(n) for n in names], base_failed().alias("failed"),
        (F.pmod(F.xxhash64(*BASE, "doc_id"), F.lit(3)) < 2).alias("grows"))).where("bad IS NOT NULL AND NOT failed")
    levels = [i / THRESHOLDS for i in range(1, THRESHOLDS)]
    got = rows.agg(*[F.percentile_approx(n, levels, 10_000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(got[n] or [])) for n in names}

    def histogram(where: Column) -> dict[str, list[list[int]]]:
        """For each statistic, (bad, good) rows by the number of thresholds below the value."""
        bins = F.array(*[F.struct(F.lit(n).alias("f"), F.size(F.filter(F.array(*map(F.lit, cuts[n])).cast("array<double>"), lambda c: F.col(n) > c)).alias("b"))  # noqa: B023
                         for n in names])
        counts = (rows.where(where).select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b")
                  .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())
        out = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
        for r in counts:
            out[r.f][r.b] = [r.p, r.n]
        return out

    def best(hist, p0: int, n0: int) -> tuple[float, Condition | None]:
        found: tuple[float, Condition | None] = (1e-9, None)
        for name in names:
            p = n = 0
            for cut, (a, b) in zip(cuts[name], hist[name], strict=False):
                p, n = p + a, n + b
                for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if (g := _gain(x, y, p0, n0)) > found[0]:
                        found = (g, Condition(name, above, cut))
        return found

    learned = DecisionList()
    open_ = F.lit(True)
    for _ in range(MOST_RULES):
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            hist = histogram(F.col("grows") & open_ & _all(rule))
            p0, n0 = map(sum, zip(*hist[names[0]], strict=True))
            if not p0 or not n0:
                break
            _, condition = best(hist, p0, n0)
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        prefixes = [_all(rule[:k]) for k in range(1, len(rule) + 1)]
        tried = rows.where(~F.col("grows") & open_).agg(
            *[F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(f"{w}{k}")
              for k, c in enumerate(prefixes) for w, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((p - n) / (p + n) if p + n else -1.0, p, -k) for k in range(len(rule)) for p, n in [(tried[f"p{k}"], tried[f"n{k}"])]]
        value, covered, k = max(worth)
        if not covered or (value + 1) / 2 < LEAST_PRECISION:
            break
        rule = rule[:1 - k]
        learned.rules.append(rule)
        open_ = open_ & ~_all(rule)
    return learned


def _all(rule: list[Condition]) -> Column:
    """The rule over rows that already have the statistics as columns."""
    both = F.lit(True)
    for c in rule:
        both = both & (F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold)
    return both


def apply_rules(docs: DataFrame, labels: DataFrame, *, label: str = "quality", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document.

    Rules are learned from at most ``labelled_rows`` labelled ids (those of
    the smallest hashes). Null texts have no words and fail the base rule;
    null ids keep a row each; repeated rows repeat. Without labels only the
    base rule decides."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("_label"))
    examples = least_hashes(known, labelled_rows, "doc_id", "_label")
    plain = docs.select("doc_id", "text")
    seen = statistics(plain.join(F.broadcast(examples), "doc_id"))  # bounded by labelled_rows
    rules = learn(seen, "_label")
    return (statistics(plain).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & rules.kept())
            .select("doc_id", *BASE, "base_failed", "kept"))
