"""Quality rules: statistics of each text, and a decision list learned from labelled ones.

The list is learned by sequential covering.  A rule is a conjunction of
thresholds on statistics; it grows condition by condition by information gain on
two thirds of the rows, is pruned from its end on the other third, and is
kept while it is precise there and chance would hardly do as well: among few bad
rows three are enough where nearly all others are good.  The rows it covers leave, and the
next rule is sought.  The rules stay in order and become one conditional expression.

Cases: a NULL text has no words and fails the base rule; NULL labels are not
learned from; repeated rows get equal results; without labelled rows, or with
one class only, no rule is learned and the base rule decides; a very long text is measured whole, in
memory in proportion to it; columns besides id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.textkernel import as_bytes, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
WINDOW = 3
# At most about so many labelled rows are learned from, chosen by hash.
TRAIN_ROWS = 20_000
MOST_RULES = 12
MOST_CONDITIONS = 3
CUTS = 48
LEAST_COVER = 3
LEAST_PRECISION = 0.9
# A rule as precise on the rows held back would be as rare by chance.
MOST_CHANCE = 0.001

STATISTICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long,"
    " n_digits long, n_marks long, n_distinct long"
)


def features() -> dict[str, Column]:
    """The statistics that rules compare with thresholds."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "words_per_line": F.col("n_words") / lines,
        "upper_case": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "distinct_words": F.col("n_distinct") / words,
    }


def _without(text: bytes, characters: bytes) -> int:
    return len(text.translate(None, characters))


def repeated_words(words: np.ndarray, n: int = WINDOW) -> int:
    """Words lying in an n-word window that occurs at least twice."""
    if len(words) < n:
        return 0
    grams = windows(words, n)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return len(lines), len(lines) - len(set(lines))


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        texts = as_bytes(rows["_text"])
        out = []
        for text, given, words in zip(texts, rows["_text"], word_hashes(texts, lower=False)):
            white = len(text) - _without(text, WHITE)
            n_lines, n_dup = _repeated_lines(text)
            out.append((
                len(words), len(given or "") - white, len(text) - _without(text, SYMBOLS), n_dup, repeated_words(words), n_lines,
                len(text) - _without(text, UPPER), len(text) - _without(text, DIGITS), len(text) - _without(text, b"!?"),
                len(np.unique(words))))
        names = [c.split()[0] for c in STATISTICS.split(", ")]
        yield pd.concat([rows.drop(columns="_text"), pd.DataFrame(out, columns=names, index=rows.index)], axis=1)


def statistics(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``id_column`` and the statistics of each whole text."""
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text")).mapInPandas(
        _measure, f"_id {kind}, {STATISTICS}").withColumnRenamed("_id", id_column)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.cut if self.above else table[self.feature] <= self.cut

    def column(self) -> Column:
        feature = features()[self.feature]
        return feature > self.cut if self.above else feature <= self.cut


Rule = tuple[Condition, ...]


def _covered(rule: Rule, table: dict[str, np.ndarray], size: int) -> np.ndarray:
    hit = np.ones(size, dtype=bool)
    for condition in rule:
        hit &= condition.holds(table)
    return hit


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -np.inf


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    hit = np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~bad & hit).any():
        p0, n0 = (bad & hit).sum(), (~bad & hit).sum()
        best, gain = None, 0.0
        for name, values in table.items():
            own, marks = values[hit], bad[hit]
            for cut in np.unique(np.quantile(own, np.linspace(0, 1, CUTS))):
                for above in (True, False):
                    inside = own > cut if above else own <= cut
                    p = (inside & marks).sum()
                    got = _gain(p, inside.sum() - p, p0, n0)
                    if p >= LEAST_COVER and got > gain + 1e-9:
                        best, gain = Condition(name, above, float(cut)), got
        if best is None:
            break
        # half way between the nearest values on both sides
        own = table[best.feature][hit]
        best = Condition(best.feature, best.above, float((own[own <= best.cut].max() + own[own > best.cut].min()) / 2))
        rule = (*rule, best)
        hit &= best.holds(table)
    return rule


def _precision(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    hit = _covered(rule, table, len(bad))
    p = int((hit & bad).sum())
    return (p + 1) / (hit.sum() + 2), p


def by_chance(p: int, n: int, share: float) -> float:
    """Probability of at least p bad rows among n drawn from rows of which that share is bad."""
    if share in (0.0, 1.0):
        return float(p == 0 or share == 1.0)
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share))
               for i in range(p, n + 1))


def _holds_up(rule: Rule, shown: dict[str, np.ndarray], bad: np.ndarray) -> bool:
    """Precise on rows it was not grown on, and not by chance."""
    hit = _covered(rule, shown, len(bad))
    p, n = int((hit & bad).sum()), int(hit.sum())
    return p > 0 and p >= LEAST_PRECISION * n and by_chance(p, n, float(bad.mean())) <= MOST_CHANCE


def learn(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows."""
    test = np.where(bad, np.cumsum(bad), np.cumsum(~bad)) % 3 == 2  # a third of either class
    left = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and (left & bad).sum() >= LEAST_COVER:
        grow, prune = left & ~test, left & test
        rule = _grow({k: v[grow] for k, v in table.items()}, bad[grow])
        shown = {k: v[prune] for k, v in table.items()}
        while len(rule) > 1 and _precision(rule[:-1], shown, bad[prune])[0] >= _precision(rule, shown, bad[prune])[0]:
            rule = rule[:-1]
        if not rule or not _holds_up(rule, shown, bad[prune]):
            break
        rules.append(rule)
        left &= ~_covered(rule, table, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule covers."""
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        hit = rule[0].column()
        for condition in rule[1:]:
            hit = hit & condition.column()
        chain = F.when(hit, False) if chain is None else chain.when(hit, False)
    return chain.otherwise(True)


def learn_rules(measured: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality",
                train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules for label 0 from the statistics of labelled rows that pass the base rule."""
    marked = labels.filter(F.col(label_column).isNotNull()).select(id_column, (F.col(label_column) == 0).alias("_bad"))
    joined = measured.filter(~base_failed()).join(marked, id_column)
    n = joined.count()
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("rules")), F.lit(1_000_000)) / 1e6
    rows = (joined if n <= train_rows else joined.filter(draw < train_rows / n)).select(
        F.xxhash64(id_column).alias("_order"), "_bad", *[c.alias(name) for name, c in features().items()]).toPandas()
    if not len(rows) or rows["_bad"].nunique() < 2:
        return []
    rows = rows.sort_values(["_order", *features()], kind="stable")
    return learn({name: rows[name].to_numpy(dtype=np.float64) for name in features()}, rows["_bad"].to_numpy(dtype=bool))
