"""Learned quality rules: a decision list of threshold conjunctions, as one Spark conditional expression.

Statistics of whole texts are native column expressions. Sequential covering then learns rules for "reject" from labelled
statistics: a rule grows by the threshold with the largest FOIL gain on two thirds of the labelled rows, loses its last
thresholds while that helps on the other third, and is kept if it is precise enough there; the rows it covers go, and the
next rule is learned from the rest. Each step is one aggregation to a few hundred counts (features x thresholds), whatever
the number of labelled rows, and no row reaches the driver.

Defined results: a null text has no words (every statistic is 0) and, like any text of under 50 words, fails the base
rules. With no usable labels the list is empty and the base rules alone decide. Labels other than 0 and 1 and repeated
labels of an id (the smallest counts) are no error. Repeated rows give a row each. A very long text is counted within its row;
words in repeated windows are found by sorting hashes, not by comparing windows. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.llm.common import SPACE, checkpointed, let

SYMBOLS = "#*$%&|<>"
#: Features that thresholds may use, as expressions over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more: sorted windows, then the union of the repeated ones' spans."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def repeats(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))

    def among_few(h: Column, twice: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def among_many(h: Column) -> Column:
        met = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: F.filter(s, lambda x, j: F.coalesce(x["x"] == F.get(s, j - 1)["x"], F.lit(False)) | F.coalesce(x["x"] == F.get(s, j + 1)["x"], F.lit(False))))
        return F.sort_array(F.transform(met, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    counted = let(hashes, lambda h: let(repeats(h), lambda twice: F.when(F.size(twice) == 0, 0).otherwise(let(F.when(F.size(twice) <= 8, among_few(h, twice)).otherwise(among_many(h)), covered))))
    return F.when(F.size(words) >= 4, counted).otherwise(0).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count_of(text, "0123456789").alias("n_digits"),
        let(F.filter(F.split(text, SPACE), lambda x: x != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
    )
    return base.select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"), "n_upper", "n_digits")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= self.threshold if self.above else x < self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rejects(self) -> Column:
        """An ordered conditional: the first rule that fits rejects, a text that none fits stays."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), True) if out is None else out.when(rule.column(), True)
        return F.lit(False) if out is None else out.otherwise(False)


def learn_rules(labelled: DataFrame, *, max_rules: int = 8, max_conditions: int = 4, cuts: int = 24, min_precision: float = 0.8, min_covered: int = 3) -> DecisionList:
    """labelled: the statistics and bad (boolean: reject). All labelled rows take part in every count."""
    cut_at = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = labelled.groupBy("bad").agg(*[F.percentile_approx(F.expr(x), cut_at, 2000).alias(f) for f, x in FEATURES.items()]).collect()
    marks = {f: sorted({float(v) for row in found for v in (row[f] or ())}) for f in FEATURES}
    marks = {f: v for f, v in marks.items() if v}
    if len(found) < 2:
        return DecisionList()

    def place(f: str) -> Column:
        """How many of the feature's marks the value has reached."""
        x = F.expr(FEATURES[f])
        return F.size(F.filter(F.array(*[F.lit(m) for m in marks[f]]), lambda m: m <= x))

    bins = [place(f).alias(f"b_{f}") for f in marks]
    rows = checkpointed(labelled.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *bins))
    names = list(marks)

    def met(c: Condition) -> Column:
        at = marks[c.feature].index(c.threshold)
        return F.col(f"b_{c.feature}") > at if c.above else F.col(f"b_{c.feature}") <= at

    def all_met(conditions: tuple[Condition, ...]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & met(c)
        return out

    def counts(df: DataFrame) -> dict[str, list[list[int]]]:
        """Per feature and bin: rows to keep and to reject."""
        long = df.select("bad", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{f}").alias("b")) for i, f in enumerate(names)])).alias("x"))
        out = {f: [[0, 0] for _ in range(len(marks[f]) + 1)] for f in names}
        for f, b, bad, n in long.groupBy("x.f", "x.b", "bad").count().collect():
            out[names[f]][b][bool(bad)] += n
        return out

    def best(df: DataFrame, used: tuple[Condition, ...]) -> tuple[Condition | None, int, int]:
        table = counts(df)
        p0 = sum(x[1] for x in table[names[0]])
        n0 = sum(x[0] for x in table[names[0]])
        top, choice, good = 0.0, None, (p0, n0)
        if not p0 or not n0:
            return None, p0, n0
        prior = math.log2(p0 / (p0 + n0))
        for f in names:
            below_p = below_n = 0
            for at, mark in enumerate(marks[f]):
                below_p, below_n = below_p + table[f][at][1], below_n + table[f][at][0]
                for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                    c = Condition(f, above, mark)
                    gain = p * (math.log2(p / (p + n)) - prior) if p >= min_covered else 0.0
                    if gain > top + 1e-9 and c not in used:
                        top, choice, good = gain, c, (p, n)
        return choice, *good

    rules: list[Rule] = []
    left = rows
    for _ in range(max_rules):
        grow, conditions, p, n = left.filter(~F.col("held")), (), 0, 1
        while len(conditions) < max_conditions and n:
            c, p, n = best(grow.filter(all_met(conditions)), conditions)
            if c is None:
                break
            conditions += (c,)
        if not conditions:
            break
        heads = [conditions[:k] for k in range(1, len(conditions) + 1)]
        tally = left.agg(*[F.count(F.when(all_met(h) & (F.col("bad") == bad) & (F.col("held") == held), 1)).alias(f"c{k}{int(bad)}{int(held)}") for k, h in enumerate(heads) for bad in (True, False) for held in (True, False)]).collect()[0]
        worth = lambda k: (tally[f"c{k}11"] - tally[f"c{k}01"]) / max(1, tally[f"c{k}11"] + tally[f"c{k}01"])
        k = max(range(len(heads)), key=lambda k: (worth(k), -k))
        p, n = (tally[f"c{k}11"] + tally[f"c{k}10"]), (tally[f"c{k}01"] + tally[f"c{k}00"])
        held_p, held_n = tally[f"c{k}11"], tally[f"c{k}01"]
        if p < min_covered or p < min_precision * (p + n) or held_p < min_precision * (held_p + held_n):
            break
        rules.append(Rule(heads[k]))
        left = left.filter(~all_met(heads[k]))
    return DecisionList(rules)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed and kept of every row; labels: the id and quality (0 rejects, 1 keeps)."""
    stats = checkpointed(text_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()))
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg((F.min("quality") == 0).alias("bad"))
    learned = learn_rules(stats.filter(~F.col("base_failed")).join(marked, "doc_id"))
    return stats.withColumn("kept", ~F.col("base_failed") & ~learned.rejects())
