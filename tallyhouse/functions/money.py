"""Numbers and money as Column expressions.

Dirty text never raises: it becomes null (``try_cast``). Money is decimal; the
direction of rounding is part of each function's meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,6)"
WIDE = "decimal(28,10)"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_float(x, thousands: bool = False) -> Column:
    """Double or null; empty text is null. ``thousands`` drops commas."""
    text = F.trim(_col(x).cast("string"))
    if thousands:
        text = F.replace(text, F.lit(","), F.lit(""))
    return F.nullif(text, F.lit("")).try_cast("double")


def strict_money(x) -> Column:
    """Double of a plain amount such as ``1,234.50``; anything else is null."""
    text = F.replace(F.trim(_col(x).cast("string")), F.lit(","), F.lit(""))
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))


def dec(x) -> Column:
    """Decimal or null."""
    return F.trim(_col(x).cast("string")).try_cast(AMOUNT)


def cents_half_up(x) -> Column:
    """Two places, halves away from zero."""
    return F.round(_col(x).cast(WIDE), 2).cast("decimal(18,2)")


def cents_half_even(x) -> Column:
    return F.bround(_col(x).cast(WIDE), 2).cast("decimal(18,2)")


def cents_up(x) -> Column:
    """Ceiling to cents: prices and target ratios are never understated."""
    return F.ceil(_col(x).cast(WIDE), F.lit(2)).cast("decimal(18,2)")


def cents_down(x) -> Column:
    """Floor to cents: a limit on spending is never overstated."""
    return F.floor(_col(x).cast(WIDE), F.lit(2)).cast("decimal(18,2)")


def quantize(x, places: int, mode: str = "half_up") -> Column:
    """Decimal to ``places`` by mode half_up, half_even, up or down."""
    wide, n = _col(x).cast(WIDE), F.lit(places)
    by = {"half_up": lambda: F.round(wide, places), "half_even": lambda: F.bround(wide, places), "up": lambda: F.ceil(wide, n), "down": lambda: F.floor(wide, n)}
    return by[mode]().cast(f"decimal(28,{max(places, 0)})")


def money_text(x) -> Column:
    """Canonical two-place amount as text; not a finite number: null."""
    return cents_half_up(F.trim(_col(x).cast("string")).try_cast(WIDE)).cast("string")


def money_text_even(x) -> Column:
    return cents_half_even(x).cast("string")


def _fixed2(x: Column) -> Column:
    return F.replace(F.call_function("format_number", x.cast("double"), F.lit("0.00")), F.lit(","), F.lit(""))


def round2(x) -> Column:
    """Two places of a double as its shortest text would round (half even on
    the exact binary value)."""
    return _fixed2(_col(x)).cast("double")


def pct_change(before, after) -> Column:
    """Change in percent, two places; null without a usable base."""
    b, a = _col(before).cast(AMOUNT), _col(after).cast(AMOUNT)
    return round2(F.when(b != 0, ((a - b) / b * 100)))


def depth_pct(price, compare_at) -> Column:
    """Discount in percent where the compare-at price is above the price."""
    p, c = _col(price).cast(AMOUNT), _col(compare_at).cast(AMOUNT)
    return round2(F.when((c > 0) & (c > p), (1 - p / c) * 100))


def percent1(fraction) -> Column:
    """Fraction as percent with one place, halves up."""
    return F.round(_col(fraction).cast(WIDE) * 100, 1).cast("decimal(18,1)")


def ceil_int(x) -> Column:
    return F.ceil(_col(x).cast(WIDE)).cast("long")


def plain(x) -> Column:
    """Decimal as text without trailing zeros."""
    text = _col(x).cast(WIDE).cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def charm_price(x) -> Column:
    """Smallest amount ending in .99 that is not below x."""
    d = _col(x).cast(WIDE)
    low = F.floor(d).cast(WIDE) + F.lit("0.99").cast(WIDE)
    return F.when(low >= d, low).otherwise(low + 1).cast("decimal(18,2)")


def percent_text(x) -> Column:
    """Up to four places, zeros trimmed, with a percent sign."""
    return F.concat(plain(F.round(_col(x).cast(WIDE), 4)), F.lit("%"))


def number_text(x) -> Column:
    """Whole numbers without places, others with two."""
    d = _col(x).cast(WIDE)
    return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(cents_half_up(d).cast("string"))


#: Currency signs and words that may stand at a number.
CURRENCY_MARKS = {
    "US$": "USD", "CA$": "CAD", "A$": "AUD", "$": "USD", "€": "EUR", "£": "GBP", "￥": "CNY", "¥": "CNY", "usd": "USD", "cad": "CAD",
    "aud": "AUD", "eur": "EUR", "gbp": "GBP", "cny": "CNY", "rmb": "CNY", "元": "CNY",
}


def parse_number(text) -> Column:
    """struct(value, currency, percent, ok) of an amount with a currency mark,
    a percent sign or thousands separators around it."""
    t = F.lower(F.trim(_col(text).cast("string")))
    currency = F.lit(None).cast("string")
    bare = t
    for mark, code in sorted(CURRENCY_MARKS.items(), key=lambda kv: len(kv[0])):
        currency = F.when(F.contains(t, F.lit(mark.lower())), F.lit(code)).otherwise(currency)
    for mark in sorted(CURRENCY_MARKS, key=len, reverse=True):
        bare = F.replace(bare, F.lit(mark.lower()), F.lit(""))
    percent = t.rlike("[%％]$")
    bare = F.trim(F.regexp_replace(bare, "[%％,，\\s]", ""))
    value = F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?$"), bare.try_cast(AMOUNT))
    return F.struct(value.alias("value"), currency.alias("currency"), F.coalesce(percent, F.lit(False)).alias("percent"), value.isNotNull().alias("ok"))


def backoff_seconds(attempt, cap: float = 60.0) -> Column:
    """Wait before the n-th retry: 1.5 s doubling up to the cap."""
    return F.least(F.lit(1.5) * F.pow(F.lit(2.0), _col(attempt) - 1), F.lit(cap))


def csv_safe(x) -> Column:
    """Neutralise a cell that a spreadsheet would read as a formula; plain
    numbers stay."""
    c = F.coalesce(_col(x).cast("string"), F.lit(""))
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[+-]?\d+(\.\d+)?$"), F.concat(F.lit("'"), c)).otherwise(c)


def cell_text(x) -> Column:
    return F.coalesce(_col(x).cast("string"), F.lit(""))


def tsv_cell(x, is_number: bool = False) -> Column:
    """Null is empty, numbers lose trailing zeros beyond two places, tabs and
    line ends are blanks."""
    if is_number:
        text = _fixed2(_col(x))
        return F.coalesce(F.regexp_replace(text, r"\.?0+$", ""), F.lit(""))
    return F.coalesce(F.regexp_replace(_col(x).cast("string"), r"[\t\r\n]+", " "), F.lit(""))
