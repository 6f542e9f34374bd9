"""What a text must hold for a pattern to match, read off the pattern itself.

A pattern of many words tries each of them at each place of a text. Most texts hold
none of them, which a plain search for literals tells at a fraction of the cost: the
pattern then decides only where one of its literals is there.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_constants as _c
    import sre_parse as _parser

#: Stands for any digit among literals; no text has it.
DIGIT = "\ue000"
#: Most spellings of one stretch of a pattern, and the most letters that make a literal better.
MAX_SPELLINGS, LONG = 48, 8
#: Letters beyond ASCII that equal an ASCII letter where case is ignored
#: and that a lower-cased text would not show so (the Kelvin sign does).
ODD, PLAIN = "İıſ", "iis"


def folded(x: Column | str) -> Column:
    """``x`` as literals are searched in it: lower case, odd letters as the patterns' flag reads them."""
    x = F.col(x) if isinstance(x, str) else x
    return F.lower(F.when(x.rlike(f"[{ODD}]"), F.translate(x, ODD, PLAIN)).otherwise(x))


def _fewest(words: set) -> frozenset:
    return frozenset(w for w in words if not any(v != w and v in w for v in words))


def _worth(words: frozenset) -> tuple:
    return min(2 if w == DIGIT else min(len(w), LONG) for w in words), -len(words)


def _item(op, arg):
    """(spellings or None, literals one of which is in each match or None) of one item."""
    if op is _c.LITERAL:
        return {chr(arg).lower()}, None
    if op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
        return {""}, None
    if op is _c.IN:
        if arg == [(_c.CATEGORY, _c.CATEGORY_DIGIT)] or arg == [(_c.RANGE, (48, 57))]:
            return None, frozenset({DIGIT})
        if len(arg) <= 4 and all(o is _c.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}, None
        return None, None
    if op is _c.SUBPATTERN:
        return _sequence(arg[3])
    if op is _c.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        spelt = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        need = frozenset().union(*(p[1] for p in parts)) if all(p[1] is not None for p in parts) else None
        return (spelt if spelt is None or len(spelt) <= MAX_SPELLINGS else None), need
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        least, most, inner = arg
        spelt, need = _sequence(inner)
        if least == 0:
            return (spelt | {""} if most == 1 and spelt is not None else None), None
        return (spelt if least == most == 1 else None), need
    return None, None


def _sequence(items):
    run, whole, best = {""}, True, None

    def offer(words):
        nonlocal best
        if words and "" not in words:
            words = _fewest(words)
            best = words if best is None or _worth(words) > _worth(best) else best

    for op, arg in items:
        spelt, need = _item(op, arg)
        offer(need)
        if spelt is not None and len(run) * len(spelt) <= MAX_SPELLINGS:
            run = {a + b for a in run for b in spelt}
        else:
            offer(run)
            run, whole = spelt if spelt is not None else {""}, False
    offer(run)
    return (run if whole else None), best


@functools.cache
def literals(pattern: str) -> frozenset | None:
    """Lower-case literals one of which is in each match of a pattern that ignores
    case; null where none can be read off it."""
    try:
        return _sequence(_parser.parse(pattern))[1]
    except Exception:  # a form that only the JVM knows
        return None


def may(low: str, *patterns: str) -> Column:
    """Whether any of the patterns can match a text whose folded form is the column
    ``low``; false for certain where they cannot."""
    found: set = set()
    for pattern in patterns:
        words = literals(pattern)
        if words is None:
            return F.lit(True)
        found |= words
    words = sorted(_fewest(found), key=lambda w: (w != DIGIT, w))
    quoted = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return F.expr(" OR ".join(f"{low} RLIKE '[0-9]'" if w == DIGIT else f"contains({low}, {quoted(w)})" for w in words))


def has(name: str, pattern: str) -> Column:
    """Whether the column ``name``, with its folded form beside it as name_low, holds
    the pattern, case ignored."""
    return F.coalesce(may(f"{name}_low", pattern) & F.col(name).rlike("(?iu)" + pattern), F.lit(False))
