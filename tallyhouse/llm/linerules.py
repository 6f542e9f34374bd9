"""Line-first cleaning rules.

Every line with a word is judged by itself; a line fails when it

* is navigation: at least a quarter of its words are separators (``|``, ``>``,
  ``»``, ``•``), or it is ``MENU_WORDS`` words at most without an end mark;
* lacks an end mark though it is longer (punctuation rule);
* is boilerplate: a legal or site phrase in a line of ``BOILERPLATE_WORDS``
  words at most, or the same line came before in the text;
* is noise: more than half of its ASCII letters are capitals in a line of five
  words or more, half of its words carry symbols, or a quarter repeat the word
  before them.

Failing lines are removed; a text that loses more than ``MAX_LOST`` percent of
its words is rejected. Counts of words, symbols, repeated lines and repeated
three-word windows are measured on the whole text, and a text with too few
words or too many repeated ones is rejected whatever its lines say.

Defined cases: null and empty texts have no words and are rejected; very long
texts are judged whole; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import keeps, map_batches, utf8

MENU_WORDS = 4
BOILERPLATE_WORDS = 25
MAX_LOST = 50
MIN_WORDS = 50
MAX_REPEATED = 50
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode(), "。".encode())
SEPARATORS = {b"|", b">", "»".encode(), "•".encode(), "·".encode()}
BOILERPLATE = re.compile(
    rb"all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie policy|"
    rb"accept (?:all )?cookies|subscribe to|sign up for|log ?in to|click here|share this|follow us|copyright \(c\)|"
    rb"\xc2\xa9 ?\d{4}|enable javascript|back to top|read more",
    re.I,
)
CACHE_WORDS = 1 << 18
RULES = ("navigation", "punctuation", "boilerplate", "noise")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()
keeps(__name__, _words.clear)


def count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    key = h[:-2] * np.uint64(0x9E3779B97F4A7C15)
    key ^= (h[1:-1] ^ (key >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= (h[2:] ^ (key >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    covered = np.zeros(n, bool)
    covered[:-2] = twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def judge(line: bytes, words: list[bytes], again: bool) -> str | None:
    """The rule a line with words fails, or None."""
    n = len(words)
    if 4 * sum(w in SEPARATORS for w in words) >= n and (n > 1 or words[0] in SEPARATORS):
        return "navigation"
    if again or (n <= BOILERPLATE_WORDS and BOILERPLATE.search(line)):
        return "boilerplate"
    if n >= 5:
        upper = count(line, UPPER)
        if 2 * upper > upper + count(line, LOWER) and upper:
            return "noise"
        if 2 * count(line, SYMBOLS) >= n and 2 * sum(count(w, SYMBOLS) > 0 for w in words) >= n:
            return "noise"
        if 4 * sum(map(eq, words, words[1:])) >= n:
            return "noise"
    if not line.rstrip().endswith(ENDS):
        return "navigation" if n <= MENU_WORDS else "punctuation"
    return None


def clean(text: bytes) -> dict:
    """Measures, verdict and the kept lines of a text."""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    kept, dup, lost = [], 0, dict.fromkeys(RULES, 0)
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if rule := judge(line, own, again):
            lost[rule] += len(own)
        else:
            kept.append(line)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    gone = sum(lost.values())
    chars = len(text.decode("utf-8", "replace"))
    return {
        "n_words": n, "word_chars": chars - count(text, SPACE), "n_symbols": count(text, SYMBOLS), "n_dup_lines": dup,
        "n_repeat_words": repeated, "base_failed": failed, "kept": not failed and 100 * gone <= MAX_LOST * n, "lost_words": gone,
        "cleaned": b"\n".join(kept).decode("utf-8", "replace"), **{f"lost_{r}": v for r, v in lost.items()},
    }


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row for each row of ``docs``: its id, measures, verdict, the words
    each rule removed and, unless told otherwise, the cleaned text."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    flags, more = ["base_failed", "kept"], ["lost_words", *[f"lost_{r}" for r in RULES]]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [clean(t) for t in utf8(batch.column(1))]
        cols = [batch.column(0), *[pa.array([r[c] for r in rows], pa.bool_() if c in flags else pa.int64()) for c in [*longs, *flags, *more]]]
        names = [id_col, *longs, *flags, *more]
        if keep_text:
            cols, names = [*cols, pa.array([r["cleaned"] for r in rows], pa.string())], [*names, "cleaned"]
        return pa.record_batch(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = [f"`{id_col}` {kind}", *[f"{c} {'boolean' if c in flags else 'long'}" for c in [*longs, *flags, *more]]]
    return map_batches(docs.select(id_col, text_col), run, ", ".join(schema + ["cleaned string"] * keep_text))
