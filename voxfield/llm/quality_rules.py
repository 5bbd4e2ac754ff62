"""Quality rules: a learned decision list over text statistics, applied as ordered Spark conditions.

Sequential covering: a conjunction of thresholds is grown on one part of the labelled rows by information gain, cut back
on the other part to the prefix that is most often right, and kept while it is right more often than wrong there; the
rows it covers are set aside and the next rule is grown. The rules reject; what none of them covers is kept. The list
becomes one ``CASE WHEN`` expression, so applying it needs no Python.

The statistics are counts over whole texts (see ``statistics``). Ratios are by words; a text without words has 0.

Defined results: a null text has no words and fails the base rule; without labels of both kinds there are no rules;
labels that contradict each other for one id count as the worst of them; repeated rows get a row each; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.store import materialize
from .common import map_batches, uniform

LEAST_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Labelled rows that the rules are learned from, at most.
MOST_ROWS = 20_000
PRUNE_SHARE = 1 / 3
MOST_RULES = 12
MOST_CONDITIONS = 4
CUTS = 48
#: A rule must be right this often on the rows it is pruned with, and cover this many wrong texts there.
PRECISION = 0.7
LEAST_COVER = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts, inside = Counter(grams), bytearray(len(words))
        for k, gram in enumerate(grams):
            if counts[gram] > 1:
                inside[k:k + 3] = b"\x01\x01\x01"
        repeated = sum(inside)
    return (len(words), len(text or "") - sum(map(raw.count, BLANKS)), sum(map(raw.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the five counts of every text."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [count_statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                                          names=["doc_id", *COUNTS])
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {ids}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def features() -> dict[str, Column]:
    """What the conditions compare, as expressions over the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words,
            "symbols_by_word": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines").cast("double"),
            "dup_lines_by_word": F.col("n_dup_lines") / words, "repeated_share": F.col("n_repeat_words") / words}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return columns[self.feature] > self.cut if self.above else columns[self.feature] <= self.cut

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, columns: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(columns) for c in rule))


def grow(columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until only bad texts are covered."""
    rule, inside = [], np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and not bad[inside].all():
        share, best = math.log2(bad[inside].mean()), (1e-9, None)
        for name, values in columns.items():
            own, target = values[inside], bad[inside]
            for cut in np.unique(np.quantile(own, np.linspace(0, 1, CUTS), method="inverted_cdf")).tolist():
                over = own > cut
                for above, hit in ((True, over), (False, ~over)):
                    p = int(target[hit].sum())
                    if p >= LEAST_COVER:
                        gain = p * (math.log2(p / int(hit.sum())) - share)
                        if gain > best[0]:
                            best = gain, Condition(name, above, cut)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(columns)
    return tuple(rule)


def prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, float]:
    """The prefix of the rule with the best (right - wrong) / covered, how many bad texts it covers, and how often it
    is right."""
    best: tuple = (-2.0, 0, (), 0, 0.0)
    for size in range(1, len(rule) + 1):
        hit = covers(rule[:size], columns)
        n, p = int(hit.sum()), int(bad[hit].sum())
        if n:
            best = max(best, ((2 * p - n) / n, p, rule[:size], p, p / n), key=lambda x: x[:2])
    return best[2], best[3], best[4]


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3) -> list[Rule]:
    """The ordered rules that reject."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and bad.sum() >= 2 * LEAST_COVER and not bad.all():
        aside = rng.random(len(bad)) < PRUNE_SHARE
        if bad[~aside].sum() < LEAST_COVER or not bad[aside].any():
            break
        rule = grow({k: v[~aside] for k, v in columns.items()}, bad[~aside])
        if not rule:
            break
        rule, right, precision = prune(rule, {k: v[aside] for k, v in columns.items()}, bad[aside])
        if right < LEAST_COVER or precision < PRECISION:
            break
        rules.append(rule)
        rest = ~covers(rule, columns)
        columns, bad = {k: v[rest] for k, v in columns.items()}, bad[rest]
    return rules


def train(counted: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> list[Rule]:
    """Learn from the statistics of labelled texts (quality 0 or 1) that the base rule passes."""
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    known = counted.filter(~base_failed()).join(marked, "doc_id")
    rate = min(1.0, most_rows / max(1, known.count()))
    names = list(features())
    rows = known.filter(uniform("doc_id", seed=9) < rate).select(
        "doc_id", *[v.alias(k) for k, v in features().items()], "_quality").collect()
    rows.sort(key=lambda r: tuple(r))
    columns = {k: np.array([r[k] for r in rows], dtype=float) for k in names}
    return learn(columns, np.array([r["_quality"] == 0 for r in rows], dtype=bool))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, counted from 1; null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of every document, base_failed, kept and the number of the rule that rejected it."""
    counted = materialize(statistics(docs), "text-statistics")
    rule = first_rule(train(counted, labels))
    return counted.select("doc_id", *COUNTS, base_failed().alias("base_failed"),
                          (~base_failed() & rule.isNull()).alias("kept"), rule.alias("rule"))
