"""Look-ups in a table of published fees: the most specific entry that was known
on a day, whether it may fill a gap, and how far it can be trusted.

An entry holds for a market (``US``), a group of markets (``EU-*``) or all (``*``), and
for a plan or all. Of the entries of a kind and a provider that cover what is
asked, the one of the closest market counts, then that of the closest plan, then
the one retrieved last, but not after the day asked for. The choice comes first:
an entry that may not be used (unverified, other currency) gives nothing, and no
more general one takes its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates

#: Id, kind, provider, market, plan (basic? also covers unknown plans),
#: percent, fixed amount, currency, status, day of retrieval.
FEES = """
shopify-plan-us-basic plan - US basic - 39 USD verified 2026-10-27
shopify-plan-us-grow plan - US grow - 105 USD verified 2026-10-27
shopify-plan-us-advanced plan - US advanced - 399 USD verified 2026-10-27
shopify-plan-us-plus plan - US plus - 2300 USD verified 2026-10-27
shopify-3p-fee-basic third_party - * basic 2 - - verified 2026-10-27
shopify-3p-fee-grow third_party - * grow 1 - - verified 2026-10-27
shopify-3p-fee-advanced third_party - * advanced 0.6 - - verified 2026-10-27
shopify-3p-fee-plus third_party - * plus 0.2 - - verified 2026-10-27
shopify-payments-us-online-standard-basic payment shopify_payments US basic? 2.9 0.3 USD verified 2026-10-27
shopify-payments-us-online-standard-grow payment shopify_payments US grow 2.7 0.3 USD verified 2026-10-27
shopify-payments-us-online-standard-advanced payment shopify_payments US advanced 2.5 0.3 USD verified 2026-10-27
shopify-payments-us-online-standard-plus payment shopify_payments US plus 2.25 0.3 USD verified 2026-10-27
shopify-payments-cn-rates payment shopify_payments CN * - - - unverified 2026-10-27
stripe-us-domestic payment stripe US * 2.9 0.3 USD verified 2026-10-27
stripe-ie-standard-eea payment stripe EU-* * 1.5 0.25 EUR verified 2026-10-27
paypal-us-checkout payment paypal_us US * 3.49 0.49 USD verified 2026-10-27
paypal-cn-cross-border payment paypal_cn * * 4.4 0.3 USD verified 2026-10-27
paypal-de-checkout payment paypal_eu EU-* * 2.99 0.39 EUR verified 2026-10-27
shopify-payments-us-international-surcharge hint_international shopify_payments * * 1 - - verified 2026-10-27
shopify-payments-fx-us hint_fx shopify_payments US * 1.5 - - verified 2026-10-27
shopify-payments-fx-other hint_fx shopify_payments * * 2 - - verified 2026-10-27
stripe-us-international hint_international stripe US * 1.5 - - verified 2026-10-27
stripe-us-fx hint_fx stripe US * 1 - - verified 2026-10-27
paypal-us-international hint_international paypal_us * * 1.5 - - verified 2026-10-27
paypal-us-fx hint_fx paypal_us * * 3 - - verified 2026-10-27
paypal-cn-fx hint_fx paypal_cn * * 3.5 - - verified 2026-10-27
refund-shopify-payments-card-fee refund shopify_payments * * - - - verified 2026-10-27
refund-stripe-fee refund stripe * * - - - verified 2026-10-27
refund-paypal-us-fee refund paypal_us * * - - - verified 2026-10-27
"""
PLANS = ("basic", "grow", "advanced", "plus")
USABLE = ("verified", "conflict")


def fee_table(spark: SparkSession, text: str = FEES) -> DataFrame:
    """The entries as rows; a ``?`` behind a plan lets it stand for unknown plans."""
    rows = []
    for line in text.strip().splitlines():
        entry, kind, provider, market, plan, pct, fixed, currency, status, day = (None if x == "-" else x for x in line.split())
        rows.append((entry, kind, provider or "-", market, plan.rstrip("?"), plan.endswith("?"), pct, fixed, currency, status, day))
    shape = "entry string, kind string, provider string, market_scope string, plan_scope string, fills boolean, pct string, fixed string, fee_currency string, status string, retrieved string"
    df = spark.createDataFrame(rows, shape)
    return df.withColumns({"pct": F.col("pct").cast("decimal(9,4)"), "fixed": F.col("fixed").cast("decimal(12,2)"), "retrieved": F.to_date("retrieved")})


def look_up(asked: DataFrame, table: DataFrame, kinds: tuple[str, ...], keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, kind, entry, pct, fixed, fee_currency, usable, badge, stale of what
    ``asked`` (keys, provider, market, plan, day; one row for each key) is answered
    by; kinds without any covering entry give no row. The table is of some dozens
    of entries, each with its versions: that bounds what is broadcast."""
    fees = F.broadcast(table.where(F.col("kind").isin(*kinds)).withColumnRenamed("provider", "_provider"))
    market, scope, plan = F.col("market"), F.col("market_scope"), F.col("plan_scope")
    near = F.when(scope == market, 0).when(F.endswith(scope, F.lit("-*")) & F.startswith(market, F.substring_index(scope, "*", 1)), 1).when(scope == "*", 2)
    known = F.col("plan").isin(*PLANS)
    close = F.when(plan == F.col("plan"), 0).when(plan == "*", 1).when(F.col("fills") & ~F.coalesce(known, F.lit(False)), 2)
    # an entry of no provider ("-") is for all
    asks = asked.select(*keys, F.explode(F.array(F.lit("-"), F.col("provider"))).alias("_provider"), "market", "plan", "day")
    covering = asks.join(fees, "_provider")
    covering = covering.withColumns({"_near": near, "_close": close}).where("_near is not null and _close is not null and retrieved <= day")
    value = F.struct("entry", "pct", "fixed", "fee_currency", "status", "retrieved", "day")
    rank = F.struct("_near", "_close", (-F.unix_date("retrieved")).alias("_late"), "entry")
    best = covering.groupBy(*keys, "kind").agg(F.min_by(value, rank).alias("v")).select(*keys, "kind", "v.*")
    stale = dates.stale_level("retrieved", "day")
    badge = F.when(F.col("status") == "conflict", "conflicting").when((F.col("status") != "verified") | (stale == "downgrade"), "inferred").otherwise("verified")
    return best.select(*keys, "kind", "entry", "pct", "fixed", "fee_currency", F.col("status").isin(*USABLE).alias("usable"), badge.alias("badge"), stale.alias("stale"))


def payment_fees(asked: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, entry, pct, fixed, badge, stale: the standard online rate, where it may
    be used and is in the currency of the sale (``asked`` has ``currency``)."""
    found = look_up(asked, table, ("payment",), keys).where("usable").join(asked.select(*keys, "currency"), list(keys))
    return found.where("fee_currency = currency").select(*keys, "entry", "pct", "fixed", "badge", "stale")


def plan_fees(asked: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, monthly, plan_currency, third_party_pct of a plan."""
    found = look_up(asked, table, ("plan", "third_party"), keys).where("usable")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return found.groupBy(*keys).agg(of("plan", "fixed").alias("monthly"), of("plan", "fee_currency").alias("plan_currency"), of("third_party", "pct").alias("third_party_pct"))


def surcharge_hints(asked: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, hint (international, fx), entry, pct: surcharges that default to 0."""
    found = look_up(asked, table, ("hint_international", "hint_fx"), keys)
    return found.select(*keys, F.replace("kind", F.lit("hint_"), F.lit("")).alias("hint"), "entry", "pct")


def refund_rules(asked: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, rule: the entry that says whether a provider gives its fee back."""
    return look_up(asked, table, ("refund",), keys).select(*keys, F.col("entry").alias("rule"))
