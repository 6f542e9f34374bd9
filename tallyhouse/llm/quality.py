"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed document statistics. Each class has
a mean and a covariance shrunk towards the pooled one and towards its diagonal;
the score is the logistic of the difference of the two log densities plus the
log prior odds, each density from a cached Cholesky factor.

The statistics of every labelled row are used: they are gathered as sums and
sums of products (a fixed number of numbers), not as rows.

Defined cases: null and empty texts have the vector of an empty text; very long
texts are measured whole; without labels of both kinds every score is the share
of label 1 (0.5 without labels); a document labelled twice counts twice.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, utf8

SHRINK_POOLED = 0.10
SHRINK_DIAGONAL = 0.05
FLOOR = 1e-2
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#$%&*<>{}[]@^~=+\\/_"
ENDS = b".?!"
NAMES = (
    "length", "word_length", "upper", "symbols", "exclaim", "pipes", "digits", "ends", "distinct",
    "echo", "top_word", "dup_lines", "upper_lines", "symbol_lines", "pipe_lines", "echo_lines",
)


def rate(part: float, whole: float) -> float:
    """Log odds of a share, pulled to about one in two hundred for short texts."""
    return math.log((part + 0.05) / (max(whole - part, 0.0) + 10.0))


def count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes) -> list[float]:
    """The vector of ``NAMES`` for a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    upper, lower, chars = count(text, UPPER), count(text, LOWER), sum(map(len, words))
    symbols, exclaim, pipes = count(text, SYMBOLS), text.count(b"!"), text.count(b"|")
    echo = sum(map(eq, words, words[1:]))
    bag = Counter(words)
    in_upper = in_symbol = in_pipe = in_echo = dup = lines = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        own = line.split()
        k = len(own)
        if not k:
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if upper and 2 * (u := count(line, UPPER)) > u + count(line, LOWER):
            in_upper += k
        if symbols and 2 * count(line, SYMBOLS) > k:
            in_symbol += k
        if pipes and 4 * line.count(b"|") > k:
            in_pipe += k
        if echo and 4 * sum(map(eq, own, own[1:])) > k:
            in_echo += k
    return [
        math.log1p(n), math.log(chars / n), rate(upper + 2, upper + lower + 2), rate(symbols, chars), rate(exclaim, n),
        rate(pipes, n), rate(count(text, DIGITS), chars), rate(min(n, sum(text.count(ENDS[i : i + 1]) for i in range(3))), n),
        math.log((len(bag) + 5) / (n**0.85 + 5)), rate(echo, n), rate(max(bag.values()), n), rate(dup, lines),
        rate(in_upper, n), rate(in_symbol, n), rate(in_pipe, n), rate(in_echo, n),
    ]


class Moments:
    """Count, sum and sum of outer products of the vectors of one class."""

    def __init__(self, n: float, total: np.ndarray, outer: np.ndarray):
        self.n, self.mean = n, total / max(n, 1)
        self.cov = outer / max(n, 1) - np.outer(self.mean, self.mean)


class Model:
    def __init__(self, means, factors, log_dets, log_prior, constant):
        self.means, self.factors, self.log_dets = means, factors, log_dets
        self.log_prior, self.constant = log_prior, constant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        density = []
        for mean, inverse, log_det in zip(self.means, self.factors, self.log_dets):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + log_det))
        odds = density[1] - density[0] + self.log_prior
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(zero: Moments, one: Moments) -> Model:
    """Shrink the class covariances and cache their inverse Cholesky factors."""
    n = zero.n + one.n
    if not zero.n or not one.n:
        return Model(None, None, None, 0.0, one.n / n if n else 0.5)
    pooled = (zero.n * zero.cov + one.n * one.cov) / n
    factors, log_dets = [], []
    for m in (zero, one):
        few = len(pooled) / (len(pooled) + m.n)
        a = max(SHRINK_POOLED, few)
        cov = (1 - a) * m.cov + a * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    return Model([zero.mean, one.mean], factors, log_dets, math.log(one.n / zero.n), 0.5)


def measure(docs: DataFrame, text_col: str = "text", out: str = "quality_stats") -> DataFrame:
    """``docs`` without its text, with the vector of statistics."""
    kept = [c for c in docs.columns if c != text_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [statistics(t) for t in utf8(batch.column(0))]
        return pa.record_batch([*batch.columns[1:], pa.array(vectors, pa.list_(pa.float64()))], [*kept, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return map_batches(docs.select(text_col, *kept), run, f"{schema}, {out} array<double>")


def train(measured: DataFrame, label_col: str = "label", vector_col: str = "quality_stats") -> Model:
    """Fit from every row with a label of 0 or 1; two rows reach the driver."""
    d = len(NAMES)
    x = F.col(vector_col)
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    prods = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = measured.where(F.col(label_col).isin(0, 1)).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), *sums, *prods)
    got = {0: Moments(0, np.zeros(d), np.zeros((d, d))), 1: Moments(0, np.zeros(d), np.zeros((d, d)))}
    for r in rows.collect():
        outer = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                outer[i, j] = outer[j, i] = r[f"p{i}_{j}"]
        got[int(r[label_col])] = Moments(r["n"], np.array([r[f"s{i}"] for i in range(d)]), outer)
    return fit(got[0], got[1])


def score(measured: DataFrame, model: Model, vector_col: str = "quality_stats", out: str = "score") -> DataFrame:
    """Replace the vector by the score of label 1."""
    kept = [c for c in measured.columns if c != vector_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(0).to_pylist(), float)
        return pa.record_batch([*batch.columns[1:], pa.array(model.score(x), pa.float64())], [*kept, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema if f.name != vector_col)
    return map_batches(measured.select(vector_col, *kept), run, f"{schema}, {out} double")


def classify(
    docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Ids of ``docs`` with the score; labels count where ``learn_from`` (a
    condition on the id column) holds."""
    measured = stage(measure(docs.select(id_col, text_col), text_col), "quality")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1))
    joined = measured.where(learn_from).join(known, F.col(id_col) == F.col("_id"))
    return score(measured, train(joined))
