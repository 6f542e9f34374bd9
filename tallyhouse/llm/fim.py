"""Fill-in-the-middle: a text cut at two units and put in another order.

A pandas UDF over Arrow batches: ``finditer`` of the ``regex`` library collects
the end offset of each unit in a compact array, two look-ups in it slice the text,
``hashlib`` gives the seeds and the digests. Nothing is shuffled or gathered; the
largest thing held is one batch of ``common.CHUNK_BYTES`` and its offsets.

Defined cases: a null text counts as empty; an empty text, and one that contains
a sentinel, stays plain; a null id seeds as an empty number; rows with the same id
get the same draws; columns that the result names are replaced, others are left
out. ``restore`` gives back the exact text, whatever it holds: no sentinel can
arise across a seam, as its first character stands nowhere else in a sentinel.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINTS = r"(?s:.)"
WORDS = r"\S*\s*"
RESULT = "form string, n_units long, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Rule:
    """How texts are cut: the unit, and the shares of 100 that are transformed
    and, of those, that begin with the suffix."""

    unit: str = CODE_POINTS
    transformed: int = 90
    suffix_first: int = 20
    salt: str = "1:"

    def __post_init__(self):
        marks = (PREFIX, SUFFIX, MIDDLE)
        if any(m[0] in m[1:] or m[0] in other[1:] for m in marks for other in marks):
            raise ValueError("a sentinel's first character may stand in no sentinel's rest")


def draws(rule: Rule, key: object) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{rule.salt}{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def ends(unit: regex.Pattern, text: str) -> array:
    """End offset of each unit; empty matches are none, and what no unit covers
    belongs to the unit that follows, or to the last one."""
    out = array("Q", (m.end() for m in unit.finditer(text) if m.end() > m.start()))
    if text and (not out or out[-1] < len(text)):
        if out:
            out[-1] = len(text)
        else:
            out.append(len(text))
    return out


def cut(rule: Rule, unit: regex.Pattern, key: object, text: str) -> tuple:
    at = ends(unit, text)
    n = len(at)
    h1, h2, h3, h4 = draws(rule, key)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rule.transformed:
        return "plain", n, None, None, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (at[i - 1] if i else 0 for i in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < rule.suffix_first:
        return "spm", n, low, high - low, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", n, low, high - low, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def joined(form: str, output: str) -> str:
    """The text that ``cut`` was given."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, n_units, prefix_units, middle_units, prefix_chars,
    middle_chars, output, output_sha256) for each row."""

    @F.pandas_udf(RESULT)
    def transformed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit, names = regex.compile(rule.unit), [x.split()[0] for x in RESULT.split(", ")]
        for keys, texts in batches:
            rows = [cut(rule, unit, k, t) for k, t in zip(keys, texts)]
            out = pd.DataFrame([(*r, _digest(r[-1])) for r in rows], columns=names)
            yield out.astype({x: "Int64" for x in names if x.endswith(("_units", "_chars"))})

    bound_batches(docs.sparkSession)
    made = transformed(F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key), made.alias("made")).select(key, "made.*")


def restore(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The exact text, rebuilt from the output and its form alone."""

    @F.pandas_udf("string")
    def rebuilt(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for forms, outputs in batches:
            yield pd.Series([joined(f, x) for f, x in zip(forms, outputs)], dtype=object)

    return rebuilt(form, output)
