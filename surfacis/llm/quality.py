"""Quality classifier: an ensemble of sparse rules, compiled into column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stage

#: Labelled rows to fit on at most (the ones with the smallest hash), trees, their depth, and the lasso's strength and steps.
SAMPLE, TREES, DEPTH, LASSO, STEPS = 20_000, 24, 3, 0.001, 1_500
FEATURES = ["words", "word_length", "symbols", "upper", "digits", "bangs", "bars", "stops", "distinct", "short", "lines", "line_repeats", "marked"]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column __f of the FEATURES of the whole text; all zero for null or empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumns({"__t": text, "__w": F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")})
    n, w = F.greatest(F.length("__t"), F.lit(1)).cast("double"), F.greatest(F.size("__w"), F.lit(1)).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace("__t", pattern, ""))) / n
    lines = F.split("__t", "\n", -1)
    values = {
        "words": F.size("__w").cast("double"),
        "word_length": F.length(F.regexp_replace("__t", f"[{SPACE}]+", "")) / w,
        "symbols": share(r"[#*$%&|<>{}=~^_\\@+\[\]]+"),
        "upper": share(r"\p{Lu}+"),
        "digits": share("[0-9]+"),
        "bangs": share("!+"),
        "bars": share(r"\|+"),
        "stops": share("[.]+"),
        "distinct": F.size(F.array_distinct("__w")) / w,
        "short": F.size(F.filter("__w", lambda x: F.length(x) <= 3)) / w,
        "lines": F.size(lines).cast("double") / w,
        "line_repeats": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "marked": F.size(F.filter("__w", lambda x: x.rlike(r"[^\p{L}\p{N}]{2}$|^\|$"))) / w,
    }
    return base.withColumn("__f", F.struct(*[values[k].alias(k) for k in FEATURES])).drop("__t", "__w")


@dataclass
class RuleEnsemble:
    """rules: conjunctions of (feature, "<=" or ">", bound); weights: theirs, none of them 0; intercept."""

    rules: list[tuple[tuple[str, str, float], ...]]
    weights: list[float]
    intercept: float

    def score(self, stats: str = "__f") -> Column:
        """Probability of label 1 as a column expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(holds(rule, stats), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule, stats: str) -> Column:
    out = F.lit(True)
    for name, op, bound in rule:
        x = F.col(stats)[name]
        out = out & ((x <= bound) if op == "<=" else (x > bound))
    return out


def paths(tree: str) -> list[tuple[tuple[str, str, float], ...]]:
    """The path to every node of a fitted tree (given as its debug string) but the root, as a conjunctive rule."""
    out, open_ = [], []
    for line in tree.splitlines():
        if m := re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            depth = len(m[1])
            open_ = [x for x in open_ if x[0] < depth] + [(depth, (FEATURES[int(m[3])], m[4], float(m[5])))]
            out.append(tuple(x[1] for x in open_))
    return out


def lasso_weights(x: np.ndarray, y: np.ndarray, strength: float, steps: int = STEPS) -> np.ndarray:
    """Weights of the columns of x (0 or 1) and, last, the intercept, which alone isn't penalised: the least mean logistic loss plus strength times the weights' absolute sum, by accelerated proximal gradient steps that start anew when they turn back."""
    rows, count = np.unique(np.column_stack([y, x]).astype(np.uint8), axis=0, return_counts=True)
    y, x, count = rows[:, 0].astype(float), np.column_stack([rows[:, 1:], np.ones(len(rows), np.uint8)]).astype(float), count / count.sum()
    step = 4 / np.linalg.eigvalsh(x.T @ (x * count[:, None]))[-1]
    least = np.append(np.full(x.shape[1] - 1, strength * step), 0.0)
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        moved = ahead - step * (x.T @ (count * (1 / (1 + np.exp(-(x @ ahead))) - y)))
        new = np.sign(moved) * np.maximum(np.abs(moved) - least, 0)
        if (ahead - new) @ (new - w) > 0:
            t = 1.0
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, ahead, t = new, new + (t - 1) / later * (new - w), later
    return w


def _solved(strength: float):
    """The weights for all rows of a partition."""

    def run(batches):
        table = pa.Table.from_batches(batches)
        y = table["label"].to_numpy()
        x = table["a"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        yield pa.RecordBatch.from_arrays([pa.array([lasso_weights(x, y, strength)], pa.list_(pa.float64()))], ["w"])

    return run


def fit(labelled: DataFrame, label_col: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 11) -> RuleEnsemble:
    """Fit on rows with __f and label_col (0 or 1): shallow trees propose rules, a lasso logistic regression weighs them and drops most, in one task, as the labelled rows are bounded by the caller."""
    rows = stage(labelled.select(F.array(*[F.col("__f")[k] for k in FEATURES]).alias("a"), "__f", F.col(label_col).cast("double").alias("label")), "quality-sample")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:  # nothing to tell apart
        only = next(iter(counts), 1.0)
        return RuleEnsemble([], [], 4.0 if only else -4.0)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(rows.select(array_to_vector("a").alias("features"), "label"))
    rules = list(dict.fromkeys(r for t in forest.trees for r in paths(t.toDebugString)))
    if not rules:
        return RuleEnsemble([], [], math.log(counts[1.0] / counts[0.0]))
    known = rows.select(F.array(*[F.when(holds(r, "__f"), 1).otherwise(0).cast("tinyint") for r in rules]).alias("a"), "label")
    *weights, intercept = known.repartition(1).mapInArrow(_solved(lasso), "w array<double>").first()["w"]
    used = [(r, w) for r, w in zip(rules, weights) if w]
    return RuleEnsemble([r for r, _ in used], [w for _, w in used], intercept)


def learned(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit to the labels of docs: of the labelled rows the sample ones with the smallest hash of their id. Rows without a label, id or text are passed over."""
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(some), id_col)  # sample rows at most
    return fit(statistics(rows, text_col).select("__f", F.col("__label").alias("label")))


def classify(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts are scored as texts without words; existing columns of these names are replaced."""
    return statistics(docs.drop("score", "predicted"), text_col).withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("__f")
