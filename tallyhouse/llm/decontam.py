"""Benchmark decontamination: BM25 index of test items, block-max WAND.

Test items are cut into units of at most ``UNIT_WORDS`` words, so that one
passage can hold a whole unit; the inverted index keeps each term's BM25 impact
on each unit divided by the unit's own full score. A threshold then reads as
"this share of the unit's weight" for long and short items alike. Every window
of ``PASSAGE_WORDS`` words of every text, half overlapping, is a query: a cheap
upper bound from each term's largest impact drops most windows, block-max WAND
scores the rest and returns every unit at or above the threshold. For each item
found, the share of its question's and of its answer's five-word shingles
that the whole text holds decides. An item's answer is what follows the last
``Answer:`` or, without one, its last sentence; one sentence is both.

The index grows with the test set, not with the corpus. Document frequencies,
the number of units and their mean length are counted over the whole test set
first; an index holds at most ``MAX_INDEX_WORDS`` words (its checked bound, for
what is broadcast), and a larger test set is gone through in parts, one pass over
the corpus each, that share these counts: every score is the same wherever the
parts are cut.

Defined cases: null and empty texts or items match nothing; repeated items are
each reported; repeated rows are reported once for each row; an item of
fewer than five words has one shingle, all its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

PASSAGE_WORDS = 64
UNIT_WORDS = 48
WIDTH = 5
K1, B = 1.2, 0.75
THRESHOLD = 0.4
QUESTION_ALONE = 0.8
BOTH = 0.5
MAX_BLOCKS = 128
MAX_INDEX_WORDS = 500_000
EPS = 1e-5
_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_ANSWER = re.compile(r"answer\s*:", re.I)


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII, A-Z lower-cased."""
    return text.translate(_SPACE).split()


def parts(item: str) -> tuple[str, str]:
    """Question and answer of a test item."""
    marks = list(_ANSWER.finditer(item))
    if marks and item[: marks[-1].start()].strip() and item[marks[-1].end() :].strip():
        return item[: marks[-1].start()], item[marks[-1].end() :]
    said = [s for s in _SENTENCE.split(item.strip()) if words(s.encode())]
    return (" ".join(said[:-1]), said[-1]) if len(said) > 1 else (item, item)


def grams(tokens: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(WIDTH, len(tokens))
    return {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)} if k else set()


def cut_units(tokens: list[bytes]) -> list[Counter]:
    """An item's words in units of about equal size."""
    pieces = max(1, math.ceil(len(tokens) / UNIT_WORDS))
    size = max(1, math.ceil(len(tokens) / pieces))
    return [Counter(tokens[i : i + size]) for i in range(0, len(tokens), size)]


class Weights:
    """What BM25 needs to know of a whole test set."""

    def __init__(self, texts: Iterable[str | None]):
        self.units, total, df = 0, 0, Counter()
        for text in texts:
            for unit in cut_units(words((text or "").encode())):
                self.units += 1
                total += unit.total()
                df.update(unit.keys())
        self.mean = total / max(1, self.units)
        self.idf = {t: math.log(1 + (self.units - d + 0.5) / (d + 0.5)) for t, d in df.items()}

    def impacts(self, unit: Counter) -> dict[bytes, float]:
        """Each term's share of the unit's own full score."""
        length = K1 * (1 - B + B * unit.total() / self.mean)
        own = {t: self.idf[t] * f * (K1 + 1) / (f + length) for t, f in unit.items()}
        whole = sum(own.values())
        return {t: x / whole for t, x in own.items()}


class Index:
    """Postings with normalised impacts, largest impact by term and block, of
    some items; ``weights`` are those of the whole test set."""

    def __init__(self, items: list[tuple[int, str]], weights: Weights | None = None):
        self.items = items
        weights = weights or Weights(t for _, t in items)
        self.halves = [tuple(grams(words(p.encode())) for p in parts(t or "")) for _, t in items]
        self.unit_item, units = [], []
        for n, (_, text) in enumerate(items):
            own = cut_units(words((text or "").encode()))
            self.unit_item += [n] * len(own)
            units += own
        self.vocabulary = {t: i + 1 for i, t in enumerate(sorted({t for u in units for t in u}))}
        self.postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for u, bag in enumerate(units):
            for t, x in weights.impacts(bag).items():
                self.postings[self.vocabulary[t]].append((u, x))
        self.block = max(2, math.ceil(len(units) / MAX_BLOCKS))
        self.blocks = np.zeros((len(self.vocabulary) + 1, max(1, math.ceil(len(units) / self.block))), np.float32)
        for t, rows in self.postings.items():
            for u, x in rows:
                self.blocks[t, u // self.block] = max(self.blocks[t, u // self.block], x)
        self.most = self.blocks.max(1)

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Units scoring at least ``threshold`` for the distinct ``terms``:
        block-max WAND over the postings in unit order."""
        lists = [(self.postings[t], t) for t in terms]
        at = [0] * len(lists)
        out, slack = [], threshold - EPS
        while True:
            live = sorted((rows[at[i]][0], i) for i, (rows, _) in enumerate(lists) if at[i] < len(rows))
            bound, pivot = 0.0, None
            for k, (unit, i) in enumerate(live):
                bound += self.most[lists[i][1]]
                if bound >= slack:
                    pivot = k
                    break
            if pivot is None:
                return out
            unit = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == unit:
                pivot += 1
            here = unit // self.block
            if sum(self.blocks[lists[i][1], here] for _, i in live[: pivot + 1]) < slack:
                # no unit of this block up to the next cursor can reach the threshold
                goal = (here + 1) * self.block
                if pivot + 1 < len(live):
                    goal = min(goal, live[pivot + 1][0])
                goal = max(goal, unit + 1)
            elif live[0][0] == unit:
                score = sum(lists[i][0][at[i]][1] for _, i in live[: pivot + 1])
                if score >= slack:
                    out.append((unit, score))
                goal = unit + 1
            else:
                goal = unit
            for _, i in live[: pivot + 1]:
                rows = lists[i][0]
                while at[i] < len(rows) and rows[at[i]][0] < goal:
                    at[i] += 1

    def matches(self, texts: list[bytes], threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question share, answer share) above the threshold."""
        half = PASSAGE_WORDS // 2
        tokens = [words(t) for t in texts]
        halves, owner = [], []
        for n, t in enumerate(tokens):
            if t:
                rows = -(-len(t) // half)
                own = np.zeros(rows * half, np.int32)
                own[: len(t)] = np.fromiter(map(self.vocabulary.get, t, repeat(0)), np.int32, len(t))
                halves.append(own.reshape(rows, half))
                owner.append(np.full(rows, n))
        if not halves:
            return []
        both, owner = np.concatenate(halves), np.concatenate(owner)
        follow = np.zeros_like(both)
        follow[:-1] = np.where((owner[1:] == owner[:-1])[:, None], both[1:], 0)
        # a text's last half window is a query of its own only if it is the first too
        asked = np.ones(len(owner), bool)
        asked[1:] = (owner[1:] != owner[:-1]) | np.append(owner[2:] == owner[1:-1], False)
        terms = np.hstack([both, follow])[asked]
        owner = owner[asked]
        terms.sort(axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = 0
        found: dict[tuple[int, int], float] = {}
        for i in range(0, len(terms), 512):
            bound = self.blocks[terms[i : i + 512]].sum(1).max(1)
            for k in i + np.flatnonzero(bound >= threshold - EPS):
                for unit, score in self.search([int(t) for t in terms[k] if t], threshold):
                    pair = int(owner[k]), self.unit_item[unit]
                    found[pair] = max(found.get(pair, 0.0), score)
        held: dict[tuple[int, int], set] = {}
        out = []
        for (n, item), score in sorted(found.items()):
            shares = []
            for half_set in self.halves[item]:
                width = len(next(iter(half_set))) if half_set else 0
                if width and (n, width) not in held:
                    t = tokens[n]
                    held[n, width] = set(zip(*[t[i:] for i in range(width)]))
                shares.append(len(half_set & held[n, width]) / len(half_set) if width else 0.0)
            out.append((n, item, score, *shares))
        return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """id, item, score, question_overlap, answer_overlap, contaminated: every
    pair above the BM25 threshold, with the decision."""
    out = None
    spark = docs.sparkSession
    for one in indexes(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(one)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index = shared.value
            rows = index.matches(utf8(batch.column(1)), threshold)
            q, a = [r[3] for r in rows], [r[4] for r in rows]
            bad = [x >= QUESTION_ALONE or (x >= BOTH and y >= BOTH) for x, y in zip(q, a)]
            return pa.record_batch(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.items[r[1]][0] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64()), pa.array(bad, pa.bool_()),
                ],
                [id_col, item_col, "score", "question_overlap", "answer_overlap", "contaminated"],
            )

        kind = docs.schema[id_col].dataType.simpleString()
        got = map_batches(
            docs.select(id_col, text_col), run,
            f"`{id_col}` {kind}, `{item_col}` long, score double, question_overlap double, answer_overlap double, contaminated boolean",
        )
        out = got if out is None else out.union(got)
    if out is None:
        out = docs.select(
            id_col, F.lit(None).cast("long").alias(item_col),
            *[F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap")], F.lit(False).alias("contaminated"),
        ).where(F.lit(False))
    return out


def indexes(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Index]:
    """The test set as indexes of at most ``MAX_INDEX_WORDS`` words each (one item
    at least), with the same weights."""
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(item_text)).where(F.length(F.trim(item_text)) > 0)
    rows = rows.orderBy(F.col(item_col).asc_nulls_last(), item_text)
    weights = Weights(r[1] for r in rows.toLocalIterator())
    part, size = [], 0
    for item, text in rows.toLocalIterator():
        n = len(words(text.encode()))
        if part and size + n > MAX_INDEX_WORDS:
            yield Index(part, weights)
            part, size = [], 0
        part.append((item, text))
        size += n
    if part:
        yield Index(part, weights)
