"""Toxicity by weak supervision.

1. Voters are mined from labelled rows: whole words (lexicon) and the beginnings
   and ends of words (patterns) that stand in toxic texts far more often than in
   clean ones, by a likelihood-ratio bound that allows for how many were tried.
   Of voters that fire on nearly the same texts the strongest stays. A voter
   says toxic or abstains; the silence of all of them is a voter for clean, and
   the given label is one more voter.
2. A generative label model estimates by expectation-maximisation, together with
   the hidden class, how accurate each voter is and how voters correlate beyond
   what the class explains; those that do share their say.
3. A linear (logistic) classifier over the same features is trained on the label
   model's posteriors and scores every whole text.

Learning uses about ``SAMPLE_PER_CLASS`` labelled texts of each class (the bound
of the sample, whole texts).

Defined cases: null and empty texts get the score of a text without features;
without toxic labels nothing is mined and the score is the share of toxic labels
(0.0 without labels); very long texts are read whole; repeated rows score alike.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, stage, utf8
from .decontam import words
from .neardup import shingles

SAMPLE_PER_CLASS = 3000
MAX_VOTERS = 600
EDGES = (4, 5, 6, 7)
EM_STEPS = 25
ALIKE = 0.7
MIN_SHARE = 0.8
MARGIN = 2.0
MINIMA = (np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
CACHE_WORDS = 400_000


def features(word: bytes) -> list[bytes]:
    """The word itself, its beginnings and its ends."""
    out = [word]
    for n in EDGES:
        if len(word) > n:
            out += [word[:n] + b"*", b"*" + word[-n:]]
    return out


def document_features(text: bytes) -> set[bytes]:
    out: set[bytes] = set()
    for w in set(words(text)):
        out.update(features(w))
    return out


def unlike(sample: DataFrame) -> DataFrame:
    """One text of each group of copies, so that the rare words of a copied
    text do not look like evidence: texts that agree in two of three minimum
    hashes of their shingles count once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = []
        for text in utf8(batch.column(0)):
            s = shingles(text)
            least.append([int(x) for x in np.array([(s * m).min() for m in MINIMA] if len(s) else [0] * len(MINIMA), np.uint64).view(np.int64)])
        return pa.record_batch([*batch.columns, *[pa.array([x[i] for x in least], pa.int64()) for i in range(len(MINIMA))]], ["text", "label", *names])

    names = [f"_m{i}" for i in range(len(MINIMA))]
    out = map_batches(sample, run, "text string, label int, " + ", ".join(f"{n} long" for n in names))
    for pair in combinations(names, 2):
        first = out.groupBy("label", *pair).agg(F.min_by(F.struct("text", *names), F.xxhash64("text")).alias("r"))
        out = first.select("label", "r.*")
    return out.select("text", "label")


def mine(sample: DataFrame) -> tuple[list[bytes], int, int]:
    """Voters by strength, and the numbers of toxic and clean texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: dict[bytes, list[int]] = {}
        toxic = batch.column(1).to_pylist()
        for text, y in zip(utf8(batch.column(0)), toxic):
            for f in document_features(text):
                count.setdefault(f, [0, 0])[y] += 1
        keys = list(count)
        return pa.record_batch(
            [pa.array(keys, pa.binary()), pa.array([count[k][1] for k in keys], pa.int64()), pa.array([count[k][0] for k in keys], pa.int64())],
            ["feature", "pos", "neg"],
        )

    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], toxic, clean
    counts = map_batches(sample.select("text", "label"), run, "feature binary, pos long, neg long")
    counts = stage(counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 1"), "voters")
    p = toxic / (toxic + clean)
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = F.col("pos") * F.log(share / p) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - p))).otherwise(0.0)
    tried = max(2, counts.count())
    strong = counts.withColumn("gain", gain).where((share >= MIN_SHARE) & (F.col("gain") >= math.log(tried) + MARGIN))
    top = strong.orderBy(F.desc("gain"), "feature").limit(MAX_VOTERS)
    return [bytes(r["feature"]) for r in top.collect()], toxic, clean


def distinct_voters(votes: np.ndarray, alike: float = ALIKE) -> list[int]:
    """Voters in order of strength less those that fire on nearly the same
    texts as a stronger one (nested patterns)."""
    both = votes.T @ votes
    size = np.diag(both)
    kept: list[int] = []
    for v in range(votes.shape[1]):
        k = np.array(kept, int)
        if not kept or (both[v, k] < alike * (size[v] + size[k] - both[v, k])).all():
            kept.append(v)
    return kept


class LabelModel:
    """Accuracies of voters that say toxic or abstain, of the silence voter
    (clean when no other voter speaks) and of the given labels, estimated
    together with the hidden class; voters that move together given the class
    share their say."""

    def __init__(self, votes: np.ndarray, given: np.ndarray, prior: float):
        self.prior_odds = math.log(prior / (1 - prior))
        fired = votes.sum(0)
        silence = ~votes.any(1)
        self.share = np.ones(votes.shape[1])
        q = np.where(silence, 0.05, 0.9) * 0.5 + given * 0.5
        for step in range(EM_STEPS):
            self.accuracy = (votes.T @ q + 1.0) / (fired + 1.5)
            self.silence = (silence @ (1 - q) + 1.0) / (silence.sum() + 1.5)
            self.label_right = np.array([((1 - given) @ (1 - q) + 1) / ((1 - q).sum() + 1.5), (given @ q + 1) / (q.sum() + 1.5)])
            if step >= 5:
                # what is left of the votes once the class is known
                left = votes - np.outer(q, votes.T @ q / max(q.sum(), 1e-9)) - np.outer(1 - q, votes.T @ (1 - q) / max((1 - q).sum(), 1e-9))
                cov = left.T @ left
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = cov / np.outer(sd, sd)
                self.share = 1 / np.maximum(1.0, np.where(corr >= 0.5, corr, 0).sum(1))
            q = self.posterior(votes, given)

    def posterior(self, votes: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        odds = np.log(self.accuracy / (1 - self.accuracy)) - self.prior_odds
        total = self.prior_odds + votes @ (self.share * np.maximum(odds, 0))
        total = total - ~votes.any(1) * max(0.0, math.log(self.silence / (1 - self.silence)) + self.prior_odds)
        zero, one = self.label_right
        if given is not None:
            total = total + np.where(given > 0, math.log(one / max(1e-3, 1 - zero)), -math.log(zero / max(1e-3, 1 - one)))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Model:
    def __init__(self, names: list[bytes], weights: np.ndarray, bias: float):
        self.names, self.bias = names, float(bias)
        self.weight = {n: float(w) for n, w in zip(names, weights)}
        self._cache: dict[bytes, tuple[bytes, ...]] = {}

    def __getstate__(self):
        return self.names, self.weight, self.bias

    def __setstate__(self, state):
        self.names, self.weight, self.bias = state
        self._cache = {}

    def hits(self, text: bytes) -> set[bytes]:
        cache, out = self._cache, set()
        own = set(words(text))
        if len(cache) + len(own) > CACHE_WORDS:
            cache.clear()
        for w in own.difference(cache):
            cache[w] = tuple(f for f in features(w) if f in self.weight)
        for found in filter(None, map(cache.__getitem__, own)):
            out.update(found)
        return out

    def score(self, text: bytes) -> float:
        odds = self.bias + sum(map(self.weight.__getitem__, sorted(self.hits(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit(votes: np.ndarray, given: np.ndarray, names: list[bytes], prior: float, penalty: float = 0.05) -> Model:
    """Label model on the distinct voters, then logistic regression (Newton
    steps) on its posteriors, over the same features."""
    kept = distinct_voters(votes)
    x = votes[:, kept].astype(float)
    model = LabelModel(x, given, prior)
    # each voter alone is a case too: rare in the sample, but to be scored
    alone = np.eye(len(kept))
    target = np.concatenate([model.posterior(x, given), model.posterior(alone)])
    x = np.vstack([x, alone])
    design = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * len(kept) + [1e-6])
    w = np.zeros(len(kept) + 1)
    w[-1] = math.log(prior / (1 - prior))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge
        step = np.linalg.solve(h, design.T @ (target - p) - ridge @ w)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model([names[k] for k in kept], w[:-1], w[-1])


def train(
    docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    known = known.where(learn_from(F.col("_id")))
    chosen = bounded_sample(known, "label", "_id", per_class)
    # about 2 * per_class rows, whatever the size of the input
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
    rows = stage(unlike(rows.select("text", "label")), "labelled")
    names, toxic, clean = mine(rows)
    if not names:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        odds = math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0)
        return Model([], np.zeros(0), odds)
    at = {n: i for i, n in enumerate(names)}

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(at[f] for f in document_features(t) if f in at) for t in utf8(batch.column(0))]
        return pa.record_batch([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["label", "found"])

    got = map_batches(rows.select("text", "label"), gather, "label int, found array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["found"]))
    votes = np.zeros((len(got), len(names)))
    for i, r in enumerate(got):
        votes[i, r["found"]] = 1
    return fit(votes, np.array([r["label"] for r in got], float), names, toxic / (toxic + clean))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_hits of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        return pa.record_batch(
            [batch.column(0), pa.array([model.score(t) for t in texts], pa.float64()), pa.array([len(model.hits(t)) for t in texts], pa.int64())],
            [id_col, "score", "n_hits"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, n_hits long")
