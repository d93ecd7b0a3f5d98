"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled covariance and towards a multiple of the
identity. A score is the logistic of the difference of the two log densities plus the log prior; Mahalanobis
distances come from Cholesky factors that are inverted once.

Edge cases: a null text counts as empty and is scored as such; labels of null or of neither class are left out, and
repeated label rows count once; if a class has no labelled rows the score is the share of the other class (0.5 without
any labels). Scores use the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import SPACE_BYTES, raw_texts, with_text_columns

FEATURES = (
    "log_words", "log_word_bytes", "log_distinct", "symbols", "bangs", "bars", "capitals", "digits", "marks", "repeats", "repeated_lines", "short_words",
)
#: Features are multiples of 1 / GRID and at most 16, so that sums of their products are exact in any order.
GRID = 1024

_SYMBOLS = b"#*$%&<>@^~=+\\{}[]_"
_MARKS = b".,;:?\"'()-"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"


def document_statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text: logarithms of sizes, square roots of ratios."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = lambda chars: len(text) - len(text.translate(None, chars))
    solid = len(text) - count(SPACE_BYTES)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE_BYTES)]
    return [
        np.log1p(n),
        np.log(solid / n),
        np.log1p(len(set(words))) / np.log1p(n),
        np.sqrt(count(_SYMBOLS) / n),
        np.sqrt(text.count(b"!") / n),
        np.sqrt(text.count(b"|") / n),
        np.sqrt(count(_CAPITALS) / solid),
        np.sqrt(count(_DIGITS) / solid),
        np.sqrt(count(_MARKS) / n),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.sqrt(sum(len(w) <= 3 for w in words) / n),
    ]


def feature_matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = [document_statistics(t or b"") for t in raw_texts(batch)]
    return np.round(np.clip(np.array(rows).reshape(-1, len(FEATURES)), -16, 16) * GRID) / GRID


@dataclass(frozen=True)
class QualityModel:
    """For class 0 and 1: mean, inverse of the Cholesky factor, log density at the mean plus log prior."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    offsets: tuple[float, ...]
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def class_moments(docs: DataFrame, labels: DataFrame, usable: Column) -> dict[int, np.ndarray]:
    """For each class the sum over its rows of (1, x) (1, x)': a fixed number of figures, summed by Spark."""
    known = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    d = len(FEATURES) + 1
    # texts become a few figures before the join, so that no text is shuffled
    kind = [T.StructField("x", T.ArrayType(T.DoubleType()))]
    made = with_text_columns(docs.where(usable).select("doc_id", "text"), kind, lambda b: [pa.array(list(feature_matrix(b)), pa.list_(pa.float64()))])
    rows = made.join(known, F.col("doc_id") == F.col("labelled_id")).select("x", "quality")
    # one Python step a task: the sums are Spark's own
    one_x = [F.lit(1.0), *(F.get("x", F.lit(i)) for i in range(d - 1))]
    places = [(i, j) for i in range(d) for j in range(i, d)]
    summed = rows.groupBy("quality").agg(*(F.sum(one_x[i] * one_x[j]).alias(f"m{i}_{j}") for i, j in places))
    out = np.zeros((2, d, d))
    for r in summed.collect():  # a row per class
        for i, j in places:
            out[r["quality"], i, j] = out[r["quality"], j, i] = r[f"m{i}_{j}"]
    return dict(enumerate(out))


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, towards_pooled: float = 0.1, towards_identity: float = 0.02) -> QualityModel:
    """Fitted on all labelled rows where ``usable`` holds."""
    moments = class_moments(docs, labels, usable)
    n = np.array([moments[c][0, 0] for c in (0, 1)])
    if n.min() < 2:
        return QualityModel((), (), (), float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [moments[c][0, 1:] / n[c] for c in (0, 1)]
    scatter = [moments[c][1:, 1:] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - towards_pooled) * scatter[c] / n[c] + towards_pooled * pooled
        cov = (1 - towards_identity) * cov + (towards_identity * np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum()))
    return QualityModel(tuple(means), tuple(factors), tuple(offsets))


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The score of each row's whole text, 0 to 1."""
    return with_text_columns(docs, [T.StructField(name, T.DoubleType())], lambda b: [pa.array(model.scores(feature_matrix(b)))], keep)
