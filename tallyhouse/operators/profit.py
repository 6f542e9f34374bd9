"""Unit economics in exact decimals: order components, price roots, scenarios,
sensitivity, break-even, start-up cash. All are Column expressions on the input
columns named in ``INPUTS``; missing inputs count as zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents_down, cents_half_up, cents_up, charm_price, percent1

D = "decimal(28,10)"
#: name, kind: money in sale currency (or in CNY where NAME_cny is true),
#: percent in percent, plain numbers; in display order.
INPUTS = (
    ("price", "money"), ("discount_pct", "pct"), ("shipping_charged", "money"), ("vat_pct", "pct"), ("units_per_order", "number"),
    ("product_cost", "money"), ("packaging", "money"), ("first_mile_per_unit", "money"), ("duty_rate_pct", "pct"),
    ("duty_fixed_per_order", "money"), ("fulfil_per_order", "money"), ("storage_per_unit", "money"), ("last_mile_per_order", "money"),
    ("return_rate_pct", "pct"), ("resale_pct", "pct"), ("return_ship_per_return", "money"), ("payment_pct", "pct"),
    ("payment_fixed", "money"), ("third_party_txn_pct", "pct"), ("cross_border_pct", "pct"), ("fx_conversion_pct", "pct"),
    ("other_variable_per_order", "money"), ("cpa", "money"), ("roas", "number"), ("target_margin_pct", "pct"),
)
#: metric: how it is shown; limits on spending are rounded down, targets up.
SHOWN = {
    "G": cents_half_up, "vat": cents_half_up, "N": cents_half_up, "V": cents_half_up, "first_mile": cents_half_up, "duty": cents_half_up,
    "L": cents_half_up, "refund": cents_half_up, "goods": cents_half_up, "ful": cents_half_up, "last": cents_half_up,
    "ret_ship": cents_half_up, "replacement": cents_half_up, "pay": cents_half_up, "other": cents_half_up, "cm0": cents_half_up,
    "cm0_pct_n": percent1, "cm0_pct_g": percent1, "roas_be": cents_up, "max_cpa": cents_down, "cpa": cents_half_up, "cm1": cents_half_up,
    "target_cpa": cents_down, "target_roas": cents_up,
}


def _d(c: Column) -> Column:
    return c.cast(D)


def number(columns: list[str], name: str, scale: dict | None = None, add: dict | None = None) -> Column:
    """An input as the model uses it: sale currency, fractions for percents."""
    kind = dict(INPUTS)[name]
    raw = F.col(name) if name in columns else F.lit(None)
    v = _d(raw.cast("decimal(18,6)"))
    if scale and name in scale:
        v = _d(v * scale[name])
    if add and name in add:
        v = _d(F.coalesce(v, F.lit(0).cast(D)) + add[name])
    if kind == "money" and f"{name}_cny" in columns:
        rate = F.col("fx_cny_per_unit").cast("decimal(18,6)")
        if scale and "fx_cny_per_unit" in scale:
            rate = rate * scale["fx_cny_per_unit"]
        v = F.when(F.coalesce(F.col(f"{name}_cny"), F.lit(False)), _d(v.cast("decimal(18,6)") / rate.cast("decimal(18,6)"))).otherwise(v)
    if kind == "pct":
        v = _d(v / 100)
    return F.coalesce(v, F.lit(1 if name == "units_per_order" else 0).cast(D))


def order_economics(columns: list[str], price: Column | None = None, scale: dict | None = None, add: dict | None = None) -> dict[str, Column]:
    """Components of one order: G takings, N net of tax, V goods, L landed, ...,
    cm0 margin before and cm1 after advertising."""
    x = lambda name: number(columns, name, scale, add)
    mul = lambda *cs: reduce(lambda a, b: _d(a.cast("decimal(18,8)") * b.cast("decimal(18,8)")), cs)
    div = lambda a, b: F.when(b != 0, _d(a.cast("decimal(18,6)") / b.cast("decimal(18,6)")))
    one = F.lit(1).cast(D)
    p = _d(price) if price is not None else x("price")
    choice = lambda name, value: (F.col(name) == value) if name in columns else F.lit(False)
    u = x("units_per_order")
    g = mul(p, one - x("discount_pct")) + x("shipping_charged")
    n = div(g, one + x("vat_pct"))
    v = mul(u, x("product_cost") + x("packaging"))
    first = mul(u, x("first_mile_per_unit"))
    duty = mul(F.when(F.coalesce(choice("duty_basis", "price"), F.lit(False)), n).otherwise(v), x("duty_rate_pct")) + x("duty_fixed_per_order")
    landed = v + first + duty
    ful = x("fulfil_per_order") + mul(u, x("storage_per_unit"))
    last, r, k = x("last_mile_per_order"), x("return_rate_pct"), x("resale_pct")
    ship = mul(r, x("return_ship_per_return"))
    pay = mul(g, x("payment_pct") + x("third_party_txn_pct") + x("cross_border_pct") + x("fx_conversion_pct")) + x("payment_fixed")
    replace = F.coalesce(choice("return_mode", "replace"), F.lit(False))
    zero = F.lit(0).cast(D)
    refund = F.when(replace, zero).otherwise(mul(n, r))
    goods = F.when(replace, landed).otherwise(mul(landed, one - mul(r, k)))
    again = F.when(replace, mul(r, mul(one - k, landed) + ful + last)).otherwise(zero)
    other = x("other_variable_per_order")
    cm0 = _d(n - refund - goods - ful - last - ship - again - pay - other)
    has = lambda name: F.col(name).isNotNull() if name in columns else F.lit(False)
    cpa = F.when(has("cpa"), x("cpa")).when(has("roas"), div(g, x("roas")))
    target = _d(cm0 - mul(x("target_margin_pct"), n))
    return {
        "G": g, "vat": g - n, "N": n, "V": v, "first_mile": first, "duty": duty, "L": landed, "refund": refund, "goods": goods, "ful": ful,
        "last": last, "ret_ship": ship, "replacement": again, "pay": pay, "other": other, "cm0": cm0, "cm0_pct_n": div(cm0, n),
        "cm0_pct_g": div(cm0, g), "roas_be": F.when(cm0 > 0, div(g, cm0)), "max_cpa": cm0, "cpa": cpa,
        "cm1": _d(cm0 - F.coalesce(cpa, zero)), "target_cpa": target, "target_roas": F.when(target > 0, div(g, target)),
    }


def economics(inputs: DataFrame, raw: bool = False) -> DataFrame:
    """``inputs`` with every metric as it is shown (or raw)."""
    parts = order_economics(inputs.columns)
    return inputs.withColumns({f"m_{k}": (_d(c) if raw else SHOWN[k](c)) for k, c in parts.items()})


def scenario_rows(inputs: DataFrame, keys: tuple[str, ...], scenarios: tuple[str, ...] = ("base", "cons", "opt")) -> DataFrame:
    """Long form of inputs given as NAME, NAME_cons, NAME_opt: one row for each
    scenario, a missing scenario value falls back to the base."""
    fields = [n for n, _ in INPUTS if n in inputs.columns]
    pick = lambda s: F.struct(F.lit(s).alias("scenario"), *[(F.coalesce(F.col(f"{n}_{s}"), F.col(n)) if f"{n}_{s}" in inputs.columns else F.col(n)).alias(n) for n in fields])
    kept = [c for c in inputs.columns if c not in fields and not c.endswith(("_cons", "_opt"))]
    rows = inputs.select(*dict.fromkeys([*keys, *kept]), F.explode(F.array(*[pick(s) for s in scenarios])).alias("_s"))
    return rows.select(*[c for c in rows.columns if c != "_s"], "_s.*")


def metric_rows(results: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, metric, value: the metric columns of ``economics`` as rows."""
    names = [c for c in results.columns if c.startswith("m_")]
    pairs = F.array(*[F.struct(F.lit(c[2:]).alias("metric"), F.col(c).cast("decimal(28,6)").alias("value")) for c in names])
    return results.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def scenario_differences(inputs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Inputs whose value in a scenario differs from the base."""
    cells = [
        F.struct(F.lit(s).alias("scenario"), F.lit(n).alias("field"), F.col(f"{n}_{s}").cast("decimal(18,6)").alias("value"), F.col(n).cast("decimal(18,6)").alias("base"))
        for n, _ in INPUTS for s in ("cons", "opt") if f"{n}_{s}" in inputs.columns
    ]
    if not cells:
        cells = [F.struct(F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("decimal(18,6)").alias("value"), F.lit(None).cast("decimal(18,6)").alias("base"))]
    return inputs.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*").where("value <> base")


def price_block(inputs: DataFrame) -> DataFrame:
    """Lowest price that loses nothing, price of the target margin, the charm
    price above it, and the distance of the present price to the floor.

    The model is linear in price: the margins at two prices, for which the formula
    stands once, give both roots; null when a higher price does not help or the
    root is not positive."""

    def at(price: Column) -> Column:
        e = order_economics(inputs.columns, price)
        return F.struct(_d(e["cm1"]).alias("cm1"), _d(e["N"]).alias("n"))

    def root(margin: Column) -> Column:
        left = lambda i: _d(F.col("_at")[i]["cm1"] - _d(margin.cast("decimal(18,8)") * F.col("_at")[i]["n"].cast("decimal(18,8)")))
        slope = _d((left(1) - left(0)).cast("decimal(18,8)") / F.lit(90).cast("decimal(18,8)"))
        found = _d(F.lit(10).cast(D) - F.when(slope > 0, _d(left(0).cast("decimal(18,8)") / slope.cast("decimal(18,8)"))))
        return F.when((slope > 0) & (found > 0), found)

    two = inputs.withColumn("_at", F.transform(F.array(F.lit(10).cast(D), F.lit(100).cast(D)), at))
    roots = two.withColumns({"floor_raw": root(F.lit(0).cast(D)), "_target": root(number(inputs.columns, "target_margin_pct"))})
    return roots.withColumns({
        "floor": cents_up("floor_raw"), "target": cents_up("_target"), "target_display": charm_price(cents_up("_target")),
        "gap_to_floor": cents_half_up(number(inputs.columns, "price") - cents_up("floor_raw")),
    }).drop("_at", "_target")


def sensitivity(inputs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every numeric input up and down by a tenth, the others as they are:
    change of cm1, ranked by its larger side, then by field order.

    Each trial is a row, so the formula stands once and is compiled once; the rows
    of a key, two for each input and one for the base, meet once."""
    names = [(i, n) for i, (n, _) in enumerate(INPUTS) if n in inputs.columns]
    trial = lambda n, i, x: F.struct(F.lit(n).cast("string").alias("field"), F.lit(i).alias("ord"), F.lit(x).cast("decimal(4,2)").alias("factor"))
    tried = [F.when(F.coalesce(F.col(n).cast("decimal(18,6)"), F.lit(0)) != 0, trial(n, i, x)) for i, n in names for x in ("1.1", "0.9")]
    rows = inputs.withColumn("_t", F.explode(F.array_compact(F.array(trial(None, -1, "1"), *tried))))
    scale = {n: F.when(F.col("_t.field") == n, F.col("_t.factor")).otherwise(F.lit("1").cast("decimal(4,2)")) for _, n in names}
    rows = rows.select(*keys, "_t.*", _d(order_economics(inputs.columns, scale=scale)["cm1"]).alias("cm1"))
    base = F.max(F.when(F.col("field").isNull(), F.col("cm1"))).over(Window.partitionBy(*keys))
    change = lambda x: F.max(F.when(F.col("factor") == F.lit(x).cast("decimal(4,2)"), F.col("change")))
    sides = rows.withColumn("change", F.col("cm1") - base).where("field is not null").groupBy(*keys, "field", "ord").agg(change("1.1").alias("up"), change("0.9").alias("down"))
    sides = sides.withColumn("impact", F.greatest(F.abs("up"), F.abs("down"))).where("impact <> 0")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("impact"), "ord"))
    return sides.select(*keys, n.alias("rank"), "field", cents_half_up("up").alias("delta_up"), cents_half_up("down").alias("delta_down"), cents_half_up("impact").alias("impact"))


def duty_effect(inputs: DataFrame) -> DataFrame:
    """Change of cm1 when the duty rate rises by ten points."""
    more = order_economics(inputs.columns, add={"duty_rate_pct": F.lit(10).cast(D)})["cm1"]
    return inputs.withColumn("duty_delta", cents_half_up(more - order_economics(inputs.columns)["cm1"]))


def break_even(inputs: DataFrame, keys: tuple[str, ...], fixed_total: str = "fixed_total") -> DataFrame:
    """Units that cover the fixed costs, by advertising cost per order: the
    given one, none, half and all of the margin."""
    e = order_economics(inputs.columns)
    cm0, total = _d(e["cm0"]), F.col(fixed_total).cast(D)
    tier = lambda name, cpa, cond=None: F.when(cond if cond is not None else F.lit(True), F.struct(F.lit(name).alias("tier"), _d(cpa).alias("cpa")))
    zero = F.lit(0).cast(D)
    tiers = F.array(tier("user", e["cpa"], e["cpa"].isNotNull()), tier("zero", zero), tier("half", cm0 / 2, cm0 > 0), tier("full", cm0, cm0 > 0))
    rows = inputs.select(*keys, cm0.alias("cm0"), total.alias("total"), F.explode(F.filter(tiers, lambda t: t.isNotNull())).alias("t"))
    cm1 = F.col("cm0") - F.col("t.cpa")
    units = F.when((cm1 > 0) & (F.col("total") > 0), F.ceil(F.col("total").cast("decimal(18,6)") / cm1.cast("decimal(18,6)"))).when(cm1 > 0, F.lit(0))
    return rows.select(*keys, "t.tier", cents_half_up("t.cpa").alias("cpa"), cents_half_up(cm1).alias("cm1"), units.cast("long").alias("units"))


def startup_cash(items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sum of the start-up items (route, key, value) of each route."""
    return items.groupBy(*keys, "route").agg(cents_half_up(F.sum(F.col("value").cast("decimal(18,6)"))).alias("total"), F.count("value").alias("items"), F.count_if(F.col("value").isNull()).alias("unknown"))


def cash_cycle(inputs: DataFrame) -> DataFrame:
    """Days stock + days receivable - days payable; null where one is unknown."""
    d = lambda c: F.col(c).cast("decimal(18,6)")
    return inputs.withColumn("cash_cycle_days", F.round(d("days_stock") + d("days_receivable") - d("days_payable"), 1))


def metric_evidence(inputs_long: DataFrame, depends: DataFrame, keys: tuple[str, ...] = ("product",)) -> DataFrame:
    """Weakest badge, assumption ids and inputs of each metric: ``inputs_long``
    has key, source, badge, assumption; ``depends`` has metric, key."""
    from ..functions.evidence import weakest

    used = inputs_long.where("source not in ('na') and not (source = 'missing' and key <> 'duty_rate_pct')")
    badge = F.when((F.col("key") == "duty_rate_pct") & (F.col("source") == "missing"), "inferred").otherwise(F.col("badge"))
    rows = used.withColumn("badge", badge).join(F.broadcast(depends), "key")
    ids = F.array_sort(F.collect_set("assumption"), lambda a, b: F.substring(a, 2, 9).cast("int") - F.substring(b, 2, 9).cast("int"))
    return rows.groupBy(*keys, "metric").agg(F.coalesce(weakest("badge"), F.lit("user_input")).alias("badge"), ids.alias("assumptions"), F.array_sort(F.collect_set("key")).alias("depends_on"))


def last_value_wins(rows: DataFrame, keys: tuple[str, ...] = ("product", "key"), line: str = "line") -> tuple[DataFrame, DataFrame]:
    """The last row of each product and key, and the rows it replaces."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(line)))
    ranked = rows.withColumn("_n", n)
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def range_issues(rows: DataFrame) -> DataFrame:
    """Issues of typed inputs (key, kind, value): percents within 0 to 100,
    money and numbers not negative, counts whole."""
    v = F.col("value").try_cast("decimal(18,6)")
    issue = (
        F.when(F.col("value").isNotNull() & v.isNull(), "not_a_number").when(F.col("kind").isin("pct", "share") & ((v < 0) | (v > 100)), "percent_range")
        .when(F.col("kind").isin("money", "number", "count") & (v < 0), "negative").when((F.col("kind") == "count") & (v != F.floor(v)), "not_whole")
    )
    return rows.withColumn("issue", issue).where("issue is not null")


def with_defaults(rows: DataFrame, table_defaults: DataFrame, trial_defaults: DataFrame, keys: tuple[str, ...] = ("product", "key")) -> DataFrame:
    """value, source and assumption number: the user's, else the fee table's,
    else a trial value; a default is an assumption and numbered."""
    joined = rows.join(F.broadcast(table_defaults.select("key", F.col("value").alias("_t"))), "key", "left").join(F.broadcast(trial_defaults.select("key", F.col("value").alias("_d"))), "key", "left")
    source = F.when(F.col("value").isNotNull(), "user").when(F.col("_t").isNotNull(), "table").when(F.col("_d").isNotNull(), "default").otherwise("missing")
    out = joined.withColumns({"source": source, "value": F.coalesce("value", "_t", "_d")}).drop("_t", "_d")
    assumed = out.where("source in ('table', 'default')").select(*keys)
    n = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:]))
    return out.join(assumed.withColumn("assumption", F.concat(F.lit("A"), n.cast("string"))), list(keys), "left")
