"""Quality classifier: rules from tree paths, lasso logistic weights, scored as Spark columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .langid import fold

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeated_neighbour", "upper", "digits", "symbols",
    "non_ascii", "lines", "repeated_lines", "symbol_words", "title_words",
)
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"]


def statistics_of(text: bytes | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``; all 0 without text."""
    if not text:
        return [0.0] * len(STATISTICS)
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, words, lines = len(text), text.split(), text.split(b"\n")
    m = max(len(words), 1)
    counts, line_counts = Counter(words), Counter(lines)
    letters = max(1, int(bytes_of[_UPPER].sum() + bytes_of[_LOWER].sum()))
    symbolic = sum(c for w, c in counts.items() if w[-1] in _ENDS)
    titled = sum(c for w, c in counts.items() if w[:1].isupper() and not w.isupper())
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / m, len(counts) / m,
        max(counts.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, float(bytes_of[_UPPER].sum()) / letters,
        float(bytes_of[48:58].sum()) / n, float(bytes_of[_SYMBOLS].sum()) / n, float(bytes_of[128:].sum()) / n,
        len(lines) / m, 1 - len(line_counts) / len(lines), symbolic / m, titled / m,
    ]


_ENDS = frozenset(_SYMBOLS)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics_of(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(rows.shape[1]))],
            ["row", *STATISTICS])


def measured(docs: DataFrame, *kept: str, text_col: str = "text") -> DataFrame:
    """The ``kept`` columns and the statistics of every whole text; no shuffle."""
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.DoubleType()) for c in STATISTICS)])
    return rows.mapInArrow(_measured, schema).select("row.*", *STATISTICS)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds on statistics: (name, over, at most)."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        tests = [F.col(n) > low for n, low, _ in self.bounds if low > -np.inf]
        tests += [F.col(n) <= high for n, _, high in self.bounds if high < np.inf]
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def path_rules(forest: str) -> list[Rule]:
    """Every path from a root to a node, as distinct rules, read from a forest's description."""
    found, path = [], []
    for line in forest.splitlines():
        test = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if line.lstrip().startswith("Tree "):
            path = []
        elif test:
            depth = len(test[1])
            path = [p for p in path if p[0] < depth] + [(depth, STATISTICS[int(test[2])], test[3], float(test[4]))]
            bounds = {}
            for _, name, sign, at in path:
                low, high = bounds.get(name, (-np.inf, np.inf))
                bounds[name] = (max(low, at), high) if sign == ">" else (low, min(high, at))
            found.append(Rule(tuple(sorted((n, *b) for n, b in bounds.items()))))
    return list(dict.fromkeys(found))


def fit(sample: DataFrame, *, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> Ensemble:
    """Rules and weights from (``label`` 0 or 1, statistics); without both labels, their share alone.

    Small random trees propose rules, L1-penalised logistic regression keeps few.
    """
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return Ensemble([], [], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    vectors = sample.select(F.col("label").cast("double"), array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64)
    rules = path_rules(forest.fit(vectors).toDebugString)
    if not rules:
        share = n[1] / (n[0] + n[1])
        return Ensemble([], [], float(np.log(share / (1 - share))))
    on = sample.select(F.col("label").cast("double"), array_to_vector(F.array(
        *[r.column().cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(maxIter=50, regParam=penalty, elasticNetParam=1.0).fit(on)
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients, strict=True) if w != 0]
    return Ensemble([r for r, _ in kept], [w for _, w in kept], float(model.intercept))


def training_sample(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> DataFrame:
    """Statistics and label of labelled rows outside fold 1 of 3, about ``most_rows`` of them by hash of id.

    The bound is on expected rows: the share is ``most_rows`` in all usable labels.
    Null ids and labels teach nothing.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1)).select(
        F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    cells = 1 << 30
    share = min(cells, most_rows * cells // max(usable.count(), 1))
    chosen = written(usable.filter(F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(cells)) < share), "labelled")
    joined = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    return written(measured(joined, "label"), "statistics")


def score_quality(docs: DataFrame, ensemble: Ensemble, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (likelihood of label 1) and predicted for every whole text.

    Null and empty texts have all statistics 0 and are scored by the rules those meet.
    Row by row: repeated rows are scored alike, other columns are ignored, an empty table gives no rows.
    """
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    scored = rows.select("doc_id", ensemble.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
