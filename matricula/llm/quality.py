"""Quality rules: a learned decision list over text statistics.

Everything here is DataFrame expressions. ``text_stats`` counts words, symbols, repeated lines and
repeated 3-word windows of whole texts. ``learn`` runs sequential covering on labelled rows: grow a
conjunction of thresholds by information gain on one part of the rows, prune it on the other, keep
it if it is precise, drop the rows that it covers, go on. Spark counts; the driver sees one count
per statistic and bin. ``verdict`` turns the rules into one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import cut, fence, only

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Statistics that rules may use.
FEATURES = (
    "n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "mark_rate", "pipe_rate",
)


def _without(text: Column, characters: str, instead: str = "") -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def _count(text: Column, characters: str) -> Column:
    """Occurrences of any of some one-byte characters."""
    return (F.octet_length(text) - F.octet_length(_without(text, characters))).cast("long")


def _covered(h: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in text order: equal
    hashes are neighbours once sorted, and each repeated start covers up to the next one."""
    windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:
        twice = F.transform(
            s, lambda x, k: F.when((x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]), x["i"])
        )
        return F.sort_array(F.array_compact(twice))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    # transform over a one-element array binds a value once for the expressions that use it
    bound = F.transform(F.array(F.sort_array(windows)), lambda s: F.transform(F.array(starts(s)), total)[0])
    return bound[0]


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, stats): each input row as a struct, so no column can clash, and a struct of its base counts
    (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) and ``features``
    (see ``FEATURES``). Null text: no words. Rates of a text without words are zero."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # One column per step: each is used more than once further on and is worked out only once.
    step = docs.select(F.struct(*docs.columns).alias("row"), t.alias("t"))
    step = step.withColumns({
        "w": F.array_remove(F.split(_without(F.col("t"), _BLANKS[1:], " "), " "), ""),
        "lines": F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""),
        "word_chars": F.char_length(_without(F.col("t"), _BLANKS)).cast("long"),
        "n_symbols": _count(F.col("t"), _SYMBOLS), "marks": _count(F.col("t"), "!?"), "pipes": _count(F.col("t"), "|"),
    })
    step = step.withColumns({
        "n_words": F.size("w").cast("long"), "distinct": F.size(F.array_distinct("w")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "h": F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
        ),
    })
    step = step.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    step = step.withColumn("n_repeat_words", F.when(F.col("again"), _covered(F.col("h"))).otherwise(F.lit(0).cast("long")))

    def rate(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    n, r = F.col("n_words"), F.col("n_repeat_words")
    return step.select("row", F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 50) | (100 * r > 50 * n)).alias("base_failed"),
        F.struct(
            n.cast("double").alias("n_words"), rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "word_chars").alias("symbol_rate"),
            rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("distinct", "n_words").alias("distinct_rate"),
            rate("marks", "word_chars").alias("mark_rate"), rate("pipes", "word_chars").alias("pipe_rate"),
        ).alias("features"),
    ).alias("stats"))


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` (above) or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self, features: str) -> Column:
        f = F.col(f"{features}.{self.feature}")
        return f > self.threshold if self.above else f <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; ``hits`` and ``misses`` are the labelled bad and good rows that reached and met it."""

    conditions: tuple[Condition, ...]
    hits: int
    misses: int

    def column(self, features: str) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(features)
        return out


def verdict(rules: list[Rule], features: str = "stats.features") -> Column:
    """The ordered rules as one conditional expression: number of the first rule met, else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule.column(features)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(
    labelled: DataFrame, max_rules: int = 16, max_conditions: int = 4, bins: int = 64, min_precision: float = 0.9, min_hits: int = 8
) -> list[Rule]:
    """Decision list from rows (doc_id, features, bad): ``bad`` is 1 for a row to reject, 0 for one to keep.

    All rows count. Thresholds are the quantiles of each statistic over all bad rows and over all good rows (``bins``
    each); two thirds of the rows grow rules, one third prunes them, by crc32 of the id. A rule is kept
    if at least ``min_precision`` of the rows that it covers are bad and it covers ``min_hits`` of them.
    Rows with a null label or id are left out; without bad or good rows there are no rules.
    """
    rows = labelled.where("bad is not null and doc_id is not null").select("doc_id", "features", F.col("bad").cast("int").alias("bad"))
    at = [i / bins for i in range(bins + 1)]
    found = rows.groupBy("bad").agg(
        *[F.percentile_approx(f"features.{f}", at, 2000).alias(f) for f in FEATURES]
    ).collect()
    grid = {f: sorted({float(x) for row in found for x in (row[f] or ())}) for f in FEATURES}
    if len(found) < 2:
        return []

    def binned(f: str) -> Column:  # number of thresholds below the value
        steps = F.array(*[F.lit(x) for x in grid[f]])
        return F.size(F.filter(steps, lambda x: F.col(f"features.{f}") > x))

    left = cut(rows.select(
        "features", "bad", (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("prunes"),
        F.array(*[binned(f) for f in FEATURES]).alias("bin"),
    ))
    rules: list[Rule] = []

    def counts(df: DataFrame) -> dict[tuple[int, int, bool], tuple[int, int]]:
        per = df.select("bad", "prunes", F.posexplode("bin").alias("f", "b")).groupBy("f", "b", "prunes").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
        )
        return {(r.f, r.b, r.prunes): (r.p, r.n) for r in per.collect()}

    def met(df: DataFrame, conditions: list[Condition]) -> DataFrame:
        for c in conditions:
            df = df.where(c.column("features"))
        return df

    while len(rules) < max_rules:
        grown: list[Condition] = []
        history: list[tuple[tuple[int, int], tuple[int, int]]] = []  # per length: (p, n) on the growing, on the pruning rows
        while True:
            table = counts(met(left, grown))
            totals = {s: tuple(sum(v[i] for (f, _, q), v in table.items() if f == 0 and q == s) for i in (0, 1)) for s in (False, True)}
            history.append((totals[False], totals[True]))
            (p0, n0), best = totals[False], (0.0, None)
            if not p0 or not n0 or len(grown) >= max_conditions:
                break
            for f, name in enumerate(FEATURES):
                p = n = 0
                for b in range(len(grid[name])):  # rows in bins up to b are <= threshold b
                    x = table.get((f, b, False), (0, 0))
                    p, n = p + x[0], n + x[1]
                    for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if nn < n0 and (g := _gain(pp, nn, p0, n0)) > best[0] + 1e-9:
                            best = (g, Condition(name, above, grid[name][b]))
            if best[1] is None:
                break
            grown.append(best[1])
        scored = [((p - n) / max(1, p + n), -k) for k, (_, (p, n)) in enumerate(history) if k]
        if not scored:
            break
        keep = -max(scored)[1]
        (p, n), (pp, pn) = history[keep]
        if p + pp < min_hits or p + pp < min_precision * (p + pp + n + pn):
            break
        rules.append(Rule(tuple(grown[:keep]), p + pp, n + pn))
        left = left.where(~rules[-1].column("features"))
    return rules


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, features, bad) for ``learn``: statistics (doc_id, stats) with their labels (quality 0: bad)."""
    own = labels.where("quality is not null").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return stats.select("doc_id", "stats.features").join(own, F.col("doc_id") == F.col("id")).select("doc_id", "features", "bad")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of every row.

    ``rule`` is the number of the first learned rule met, 0 for none; ``kept`` is false if the base
    rules fail or a rule is met. Rows without an id are judged like any other, but do not train."""
    stats = cut(text_stats(docs.select("doc_id", "text")).select("row.doc_id", "stats"))
    rules = learn(labelled_stats(stats, labels))
    s = stats.withColumn("rule", verdict(rules))
    return s.select(
        "doc_id", *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        (~F.col("stats.base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the learned rules, all columns unchanged.

    Statistics of the labelled rows train the rules; the rows are then judged where they are
    read, without a join, so repeated rows and rows without an id are each judged by their text."""
    marked = labels.where("quality is not null").select("doc_id").distinct()
    own = only(docs.select("doc_id", "text"), marked, ["doc_id"])
    rules = learn(labelled_stats(cut(text_stats(own).select("row.doc_id", "stats")), labels))
    return fence(text_stats(docs)).where(~F.col("stats.base_failed") & (verdict(rules) == 0)).select("row.*")
