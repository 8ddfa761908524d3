"""Quality classifier: a sparse ensemble of rules.

Statistics of the text are Spark columns. Shallow trees are grown on bootstrap samples of labelled rows; every path
from a root is a rule, a conjunction of comparisons of statistics. A lasso logistic fit keeps few of the rules, and
these, with their weights, are compiled into one column expression, so scoring runs in the JVM within the scan.

The fit uses at most SAMPLE labelled rows, those with the least hash of the id; of several texts of one id it takes the
first. Trees and weights are fitted on the driver, whose work is bounded by SAMPLE, TREES and MOST_RULES.

Defined results: a null text is scored as an empty one, whose statistics are all 0; without labels every score is
0.5, and with one class only it is that class's smoothed share; several labels of a document are all learned from;
repeated documents are scored one by one; an empty table gives an empty result; extra columns are ignored; a text of
any length is read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import held_out, table, written

SAMPLE = 8000
TREES, DEPTH, MOST_RULES = 40, 3, 160
LASSO = 0.001
THRESHOLD = 0.7
SEED = 11

STATISTICS = ("chars", "words", "word_length", "upper", "symbols", "digits", "distinct", "wide", "lines", "distinct_lines", "short")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a column stat_<name> for each of STATISTICS."""
    t = F.coalesce(F.col("text"), F.lit(""))
    per = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    docs = docs.withColumn("_words", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")).withColumn("_lines", F.split(t, "\n")).withColumn("_chars", F.length(t))
    n, words, lines = F.col("_chars"), F.size("_words"), F.size("_lines")
    without = lambda pattern: per((n - F.length(F.regexp_replace(t, pattern, ""))).cast("double"), n)
    stats = {
        "chars": F.log1p(n.cast("double")), "words": F.log1p(words.cast("double")), "word_length": per(n.cast("double"), words),
        "upper": without(r"\p{Lu}+"), "symbols": without(r"[^\p{L}\p{N}\s]+"), "digits": without("[0-9]+"),
        "distinct": per(F.size(F.array_distinct("_words")).cast("double"), words), "wide": per((F.octet_length(t) - n).cast("double"), n),
        "lines": F.log1p((lines - 1).cast("double")), "distinct_lines": per(F.size(F.array_distinct("_lines")).cast("double"), lines),
        "short": per(F.size(F.filter("_words", lambda x: F.length(x) <= 3)).cast("double"), words),
    }
    docs = docs.withColumns({f"stat_{k}": v for k, v in stats.items()})
    return docs.drop("_words", "_lines", "_chars")


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, t in rule:
        out &= (x[:, i] > t) if above else (x[:, i] <= t)
    return out


def tree_paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, path: Rule = ()) -> list[Rule]:
    """The paths of a tree grown by Gini gain on a random part of the statistics at each node."""
    n, p = len(y), y.mean() if len(y) else 0
    if depth == 0 or n < 20 or p in (0, 1):
        return []
    best = (1e-9, None)
    for i in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
        values = np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, 33)))
        if len(values) < 2:
            continue
        order = np.argsort(x[:, i], kind="stable")
        ones = np.r_[0, np.cumsum(y[order])]
        left = np.searchsorted(x[order, i], values, side="right")
        for t, a in zip(values, left):
            if 5 <= a <= n - 5:
                q, r = ones[a] / a, (ones[-1] - ones[a]) / (n - a)
                gain = p * (1 - p) - (a * q * (1 - q) + (n - a) * r * (1 - r)) / n
                if gain > best[0]:
                    best = (gain, (int(i), float(t)))
    if best[1] is None:
        return []
    i, t = best[1]
    low, high = (*path, (i, False, t)), (*path, (i, True, t))
    side = x[:, i] <= t
    return [low, high, *tree_paths(x[side], y[side], rng, depth - 1, low), *tree_paths(x[~side], y[~side], rng, depth - 1, high)]


def lasso_logistic(z: np.ndarray, y: np.ndarray, strength: float = LASSO, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, m = z.shape
    a = np.column_stack([np.ones(n), z])
    step = 4 * n / (np.linalg.norm(a, 2) ** 2)
    base = min(max(y.mean(), 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    w = np.zeros(m + 1)
    w[0] = math.log(base / (1 - base))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        gradient = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -40, 40))) - y) / n
        new = v - step * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score of a row that has the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            all_hold = None
            for i, above, t in rule:
                stat = F.col(f"stat_{STATISTICS[i]}")
                test = stat > t if above else stat <= t
                all_hold = test if all_hold is None else all_hold & test
            total = total + F.when(all_hold, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Model:
    n, ones = len(y), float(y.sum()) if len(y) else 0.0
    if ones in (0.0, float(n)):
        p = (ones + 1) / (n + 2)
        return Model(math.log(p / (1 - p)), ())
    rng = np.random.default_rng(seed)
    found: dict[bytes, Rule] = {}
    for _ in range(TREES):
        rows = rng.integers(0, n, n)
        for rule in tree_paths(x[rows], y[rows], rng):
            hold = holds(rule, x)
            if 0.002 <= hold.mean() <= 0.998:
                key = np.packbits(hold).tobytes()
                if key not in found or len(rule) < len(found[key]):
                    found[key] = rule
    rules = list(found.values())
    if len(rules) > MOST_RULES:  # the ones that tell most on their own
        z = np.column_stack([holds(r, x) for r in rules]).astype(float)
        tell = np.abs((z - z.mean(axis=0)).T @ (y - y.mean())) / np.maximum(z.std(axis=0), 1e-9)
        rules = [rules[i] for i in np.argsort(-tell, kind="stable")[:MOST_RULES]]
    if not rules:
        return Model(math.log(ones / (n - ones)), ())
    z = np.column_stack([holds(r, x) for r in rules]).astype(float)
    intercept, weights = lasso_logistic(z, y)
    return Model(intercept, tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.quality, from at most sample labelled rows that aren't held out."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    chosen = written(chosen.distinct().orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "quality").limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows
    rows = with_statistics(texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    rows = rows.select("doc_id", "quality", *[f"stat_{k}" for k in STATISTICS]).toPandas()  # a row a chosen one, at most
    rows = rows.sort_values(list(rows.columns))
    return fit_rules(rows[[f"stat_{k}" for k in STATISTICS]].to_numpy(float).reshape(-1, len(STATISTICS)), (rows["quality"] == 1).to_numpy(float))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    return with_statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
