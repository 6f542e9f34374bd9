"""Language identification with error-correcting output codes.

Every language gets a codeword of plus and minus ones; one linear classifier
over hashed byte n-grams learns each bit; decoding adds up each bit's logistic
loss, weighted by how reliable that bit was in training, and takes the nearest
codeword. A small lead over the runner-up flags the text as ambiguous.

Defined cases: null text, or text without a letter, is ``und`` with score 0.0;
very long texts are counted whole, in blocks; rows with a null language or id
are never learnt from; without any labelled row every text is ``und``; repeated
rows are scored alike; other columns are not looked at, and columns that already
have the names of the results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_bucket, map_batches, utf8

BUCKETS = 4096
ORDERS = (1, 2, 3, 4)
SAMPLE_PER_LANGUAGE = 500
#: Languages learnt at most (the most frequent), and texts learnt from at most.
MAX_LANGUAGES = 2000
SAMPLE_TEXTS = 20_000
AMBIGUOUS_LEAD = 0.10
BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text (A-Z lower-cased)."""
    out = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    overlap = max(ORDERS) - 1
    for start in range(0, max(1, len(text)), BLOCK):
        raw = np.frombuffer(text, np.uint8, min(len(text) - start, BLOCK + overlap), start).astype(np.uint32)
        code = np.zeros(0, np.uint32)
        for n in ORDERS:
            if len(raw) < n:
                break
            code = raw if n == 1 else code[: len(raw) - n + 1] * np.uint32(0x9E3779B1) + raw[n - 1 :]
            own = code[:BLOCK]
            own = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            out += np.bincount(own >> np.uint32(20), minlength=BUCKETS)
    return out


def features(texts: list[bytes]) -> np.ndarray:
    x = np.empty((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        np.sqrt(ngram_counts(text), out=x[i], casting="unsafe")
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.maximum(norm, 1.0)[:, None]
    return x


def codewords(k: int) -> np.ndarray:
    """``k`` rows of +-1: every split of the languages while there are few of
    them, else random columns, the best of some draws by row distance."""
    if k <= 5:
        bits = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 1 << (k - 1))] or [[1] * k]
        return np.array(bits, np.float32).T
    n, rng, best, least = int(np.ceil(10 * np.log2(k))), np.random.default_rng(7), None, -1
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.float32), (k, n))
        if (np.abs(m.sum(0)) == k).any():
            continue
        gram = m @ m.T
        np.fill_diagonal(gram, -n)
        if (d := (n - gram.max()) / 2) > least:
            best, least = m, d
    return best


class Model:
    """Languages, code matrix, weights by bucket and bit, weight of each bit."""

    def __init__(self, languages, code, weights, bias, trust):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language index, its share of the decoded mass, lead over the next."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(1) for row in self.code], 1)
        loss -= loss.min(1, keepdims=True)
        p = np.exp(-loss)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        lead = order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0.0)
        return p.argmax(1), p.max(1), lead


def fit(x: np.ndarray, languages: list[str], steps: int = 150, penalty: float = 1e-4) -> Model:
    """All bit classifiers at once: logistic loss, accelerated gradient steps."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    code = codewords(len(names))
    target = code[y]
    weight = (1.0 / np.bincount(y, minlength=len(names)))[y][:, None].astype(np.float32)
    weight /= weight.mean()
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    v, b, vb = w.copy(), np.zeros(code.shape[1], np.float32), np.zeros(code.shape[1], np.float32)
    rate = 8.0
    for t in range(steps):
        m = x @ v + vb
        g = -target * weight / (1 + np.exp(np.clip(target * m, -30, 30))) / len(x)
        nw, nb = v - rate * (x.T @ g + penalty * v), vb - rate * g.sum(0)
        push = t / (t + 3)
        v, vb, w, b = nw + push * (nw - w), nb + push * (nb - b), nw, nb
    right = ((x @ w + b) * target > 0).mean(0)
    right = np.clip(right, 0.5, 1 - 1 / (len(x) + 2))
    trust = np.log(right / (1 - right))
    trust = trust / trust.mean() if trust.sum() > 0 else np.ones_like(trust)
    return Model(names, code, w, b, trust.astype(np.float32))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> Model | None:
    """Fit on about ``per_language`` whole texts of each language (the bound of
    the sample), never on rows of the held-out fold."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(
        ~id_bucket(id_col, 4).isin(2, -1)
    )
    sample = bounded_sample(rows.select(id_col, text_col, lang_col), lang_col, id_col, per_language, MAX_LANGUAGES, SAMPLE_TEXTS)

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(utf8(batch.column(0)))
        packed = [np.concatenate([np.flatnonzero(r).astype(np.float32), r[r > 0]]).tobytes() for r in x]
        return pa.record_batch([batch.column(1), pa.array(packed, pa.binary())], ["lang", "x"])

    got = map_batches(sample.select(text_col, lang_col), gather, "lang string, x binary").toArrow()
    langs, packed = got.column("lang").to_pylist(), got.column("x").to_pylist()
    if not langs:
        return None
    x = np.zeros((len(langs), BUCKETS), np.float32)
    for i, raw in enumerate(packed):
        a = np.frombuffer(raw, np.float32)
        x[i, a[: len(a) // 2].astype(np.int64)] = a[len(a) // 2 :]
    order = sorted(range(len(langs)), key=lambda i: (langs[i], packed[i]))
    return fit(x[order], [langs[i] for i in order])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_ambiguous`` added."""
    made = ("lang_pred", "lang_score", "lang_ambiguous")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(at))
        lang, score, flag = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = [i for i, t in enumerate(texts) if model and _LETTER.search(t.decode("utf-8", "replace"))]
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            best, share, lead = model.decode(features([texts[i] for i in part]))
            for i, c, s, d in zip(part, best, share, lead):
                lang[i], score[i], flag[i] = model.languages[c], float(s), bool(d < AMBIGUOUS_LEAD)
        cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())]
        return pa.record_batch(cols, [*names, *made])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{kept}, lang_pred string, lang_score double, lang_ambiguous boolean")
