"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Boosted trees of depth three are grown on the statistics of a bounded sample of labelled rows. Every path from
a root to a node becomes a conjunctive rule; lasso logistic regression gives most rules no weight. The rules
left are one Spark expression over the statistics, evaluated by generated code. Statistics are taken in one
scan of whole texts; nothing is shuffled.

Defined results: null counts as the empty text, whose statistics are all 0. Null labels teach nothing. Without
labels the score is 0.5; with one class only, its share (0.0 or 1.0). Rows are judged one by one, so repeated rows
score alike, and other columns, whatever their names, have no part in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, blobs
from corvane.llm.labelled import labelled_sample

#: Labelled rows of each class that the rules may be fitted on.
SAMPLE = 4000
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 48
PENALTY = 0.002

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "punctuation", "exclaimed", "pipes", "commas",
    "ends", "symbols", "distinct_words", "top_word", "repeated_pairs", "log_lines", "words_a_line", "repeated_lines", "short_lines", "empty_lines",
)


def statistics(text: bytes) -> list[float]:
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda chars, of: float(count[np.frombuffer(chars, np.uint8)].sum()) / of
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    m = len(words)
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = text.split(b"\n")
    full = [line for line in lines if line.strip()]
    return [
        float(np.log1p(n)), float(np.log1p(m)), sum(map(len, words)) / m, sum(len(w) > 20 for w in words) / m,
        upper / max(upper + lower, 1), float(count[48:58].sum()) / n, share(b".,;:!?'\"()-", n), share(b"!", m), share(b"|", m), share(b",", m),
        share(b".?!", m), share(b"#$%&*+/<=>@[\\]^_`{}~", n), len(tally) / m, max(tally.values()) / m, 1 - pairs / max(m - 1, 1) if m > 1 else 0.0,
        float(np.log1p(len(lines))), m / len(lines), 1 - len(set(full)) / len(full), sum(len(x) < 30 for x in full) / len(full), 1 - len(full) / len(lines),
    ]


def text_statistics(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the columns named in more, and the statistics of each whole text."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"row_id {kinds[id_col]}", *(f"{c} {kinds[c]}" for c in more), *(f"{s} double" for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t) for t in blobs(batch.column(batch.num_columns - 1))], float).reshape(-1, len(STATISTICS))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(values[:, k]) for k in range(values.shape[1])]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", *more, *STATISTICS])

    chosen = [f"`{id_col}` AS row_id", *(f"`{c}`" for c in more), f"cast(`{text_col}` AS string) AS text"]
    return docs.selectExpr(*chosen).mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    statistic: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.statistic] > self.cut if self.above else x[:, self.statistic] <= self.cut

    def column(self) -> Column:
        c = F.col(STATISTICS[self.statistic])
        return c > self.cut if self.above else c <= self.cut


Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, rule: Rule, depth: int, least: int, rules: list[Rule], fit: np.ndarray) -> None:
    """Splits rows where the residual's squared error falls most; notes each path and the leaves' means."""
    best = (1e-9, None)
    r = residual[rows]
    if depth and len(rows) >= 2 * least:
        total, n = r.sum(), len(rows)
        for j, edges in enumerate(cuts):
            size = np.bincount(bins[rows, j], minlength=len(edges) + 1).cumsum()[:-1]
            part = np.bincount(bins[rows, j], weights=r, minlength=len(edges) + 1).cumsum()[:-1]
            fair = (size >= least) & (n - size >= least)
            if fair.any():
                gain = np.where(fair, part**2 / np.maximum(size, 1) + (total - part) ** 2 / np.maximum(n - size, 1) - total**2 / n, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k))
    if best[1] is None:
        fit[rows] = r.mean()
        return
    j, k = best[1]
    left = bins[rows, j] <= k
    for side, above in ((rows[left], False), (rows[~left], True)):
        path = (*rule, Condition(j, above, float(cuts[j][k])))
        rules.append(path)
        _grow(x, bins, cuts, residual, side, path, depth - 1, least, rules, fit)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    rules: list[Rule] = []
    z = np.zeros(len(y))
    for _ in range(TREES):
        fit = np.zeros(len(y))
        _grow(x, bins, cuts, weight * (y - 1 / (1 + np.exp(-z))), np.arange(len(y)), (), DEPTH, max(5, len(y) // 400), rules, fit)
        z = z + RATE * 4 * fit
    return list(dict.fromkeys(rules))


def lasso_logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the columns of a, by accelerated proximal gradient steps."""
    n, p = a.shape
    scale = np.maximum(a.std(0), 1e-9)
    a = (a - a.mean(0)) / scale
    mean = a.mean(0)
    share = weight / weight.sum()
    step = 4.0 / (1 + np.linalg.norm(a * np.sqrt(share)[:, None], 2) ** 2)
    theta, bias = np.zeros(p), 0.0
    ahead, ahead_bias, t = theta, bias, 1.0
    for _ in range(rounds):
        gap = share * (1 / (1 + np.exp(-np.clip(a @ ahead + ahead_bias, -40, 40))) - y)
        new = ahead - step * (a.T @ gap)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = ahead_bias - step * gap.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - theta), new_bias + (t - 1) / t_new * (new_bias - bias)
        theta, bias, t = new, new_bias, t_new
    return float(bias), theta / scale


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[Rule, float]]
    constant: float | None = None

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        if self.constant is not None:
            return F.lit(self.constant)
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = rule[0].column()
            for condition in rule[1:]:
                holds = holds & condition.column()
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same outside Spark."""
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z = z + weight * np.logical_and.reduce([c.holds(x) for c in rule])
        return 1 / (1 + np.exp(-z)) if self.constant is None else np.full(len(x), self.constant)


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    if len(set(y.tolist())) < 2:
        return RuleEnsemble(0.0, [], float(y[0]) if len(y) else 0.5)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    rules = tree_rules(x, y, weight)
    if not rules:
        return RuleEnsemble(0.0, [], float(y.mean()))
    a = np.stack([np.logical_and.reduce([c.holds(x) for c in rule]) for rule in rules], 1).astype(float)
    bias, theta = lasso_logistic(a, y, weight, penalty)
    kept = [(rule, float(w)) for rule, w in zip(rules, theta) if abs(w) > 1e-6]
    return RuleEnsemble(bias - float((a.mean(0) * theta).sum()), kept)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    space = Workspace(spark, "quality")
    part = lambda f: F.when(f != 0, "fit")
    rows = labelled_sample(docs, labels, label, part, sample, id_col, text_col).select("row_id", "y", "text")
    found = space.save(text_statistics(rows, "row_id", "text", ("y",)), "statistics").orderBy("row_id", "y", *STATISTICS).toArrow()
    space.close()
    x = np.stack([np.array(found.column(s).to_pylist(), float) for s in STATISTICS], 1)
    return fit_rules(x, np.array(found.column("y").to_pylist(), float))


def score_quality(docs: DataFrame, rules: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, score) of every row."""
    return text_statistics(docs, id_col, text_col).select("row_id", rules.column().alias("score"))
