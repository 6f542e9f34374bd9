"""Payment costs of a setup: processing, surcharges, withdrawals, disputes, platform
fee and payout conversion, in exact decimals; what is not known stays null and is
counted, never guessed.

Rates are a dimension of a few dozen rows, broadcast. A questionnaire has one row for
each site; its routes are exploded, all items of a route are built in one
projection, and the rest is one aggregate by site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rate, percent, fixed amount, currency (- for none).
RATES = """
shopify-3p-fee-basic 2 - -
shopify-3p-fee-grow 1 - -
shopify-3p-fee-advanced 0.6 - -
shopify-3p-fee-plus 0.2 - -
shopify-payments-us-online-standard-basic 2.9 0.3 USD
shopify-payments-us-online-standard-grow 2.7 0.3 USD
shopify-payments-us-online-standard-advanced 2.5 0.3 USD
shopify-payments-us-online-standard-plus 2.25 0.3 USD
shopify-payments-us-international-surcharge 1 - -
shopify-payments-ca-online-standard-basic 2.8 0.3 CAD
shopify-payments-ca-online-amex-intl-basic 3.5 0.3 CAD
shopify-payments-ca-online-standard-grow 2.6 0.3 CAD
shopify-payments-ca-online-amex-intl-grow 3.4 0.3 CAD
shopify-payments-ca-online-standard-advanced 2.4 0.3 CAD
shopify-payments-ca-online-amex-intl-advanced 3.3 0.3 CAD
shopify-payments-ca-online-standard-plus 2.15 0.3 CAD
shopify-payments-ca-online-amex-intl-plus 3.15 0.3 CAD
shopify-payments-fx-us 1.5 - -
shopify-payments-fx-other 2 - -
stripe-us-domestic 2.9 0.3 USD
stripe-us-international 1.5 - -
stripe-us-fx 1 - -
stripe-us-dispute - 15 USD
stripe-managed-payments 3.5 - -
stripe-ca-domestic 2.9 0.3 CAD
stripe-ca-international 0.8 - -
stripe-ca-fx 2 - -
paypal-us-checkout 3.49 0.49 USD
paypal-us-international 1.5 - -
paypal-us-fx 3 - -
paypal-us-chargeback - 20 USD
paypal-cn-cross-border 4.4 0.3 USD
paypal-cn-withdrawal - 35 USD
paypal-cn-chargeback - 10 USD
"""
#: Provider, region, plan (* for any), its rate, the rates of
#: international cards and of conversion, the dispute fee.
ROUTES = """
paypal CN * paypal-cn-cross-border - - paypal-cn-chargeback
paypal US * paypal-us-checkout paypal-us-international paypal-us-fx paypal-us-chargeback
stripe US * stripe-us-domestic stripe-us-international stripe-us-fx stripe-us-dispute
stripe CA * stripe-ca-domestic stripe-ca-international stripe-ca-fx -
shopify_payments US {plan} shopify-payments-us-online-standard-{plan} shopify-payments-us-international-surcharge shopify-payments-fx-us -
shopify_payments CA {plan} shopify-payments-ca-online-standard-{plan} shopify-payments-ca-online-amex-intl-{plan} shopify-payments-fx-other -
"""
#: Plans, regions with rates, payout accounts without a verified fee.
PLANS = ("basic", "grow", "advanced", "plus")
REGIONS = ("CN", "HK", "US", "CA", "UK")
UNVERIFIED_PAYOUT = ("worldfirst", "payoneer", "pingpong", "lianlian", "airwallex")
#: Monthly price of a plan by region.
PLAN_FEES = {"US": {"basic": 39, "grow": 105, "advanced": 399, "plus": 2300}, "CA": {"basic": 49, "grow": 132, "advanced": 517, "plus": 3400}}
EXACT, MONEY = "decimal(18,6)", "decimal(18,2)"


def rate_table() -> dict[str, tuple[str | None, str | None, str | None]]:
    return {x[0]: tuple(None if v == "-" else v for v in x[1:]) for x in (line.split() for line in RATES.strip().splitlines())}


def route_rates(spark: SparkSession) -> DataFrame:
    """One row for each provider, region and plan with a published rate. Where
    international cards have a rate of their own, the surcharge is the difference."""
    rates, rows = rate_table(), []
    for line in ROUTES.strip().splitlines():
        for plan in PLANS if "{plan}" in line else ("*",):
            provider, region, _, base, intl, fx, dispute = line.replace("{plan}", plan).split()
            pct, fixed, currency = rates[base]
            extra = rates[intl][0] if intl != "-" else None
            own = extra is not None and rates[intl][1] is not None
            rows.append((provider, region, plan, base, pct, fixed, currency, None if intl == "-" else intl, extra, own, None if fx == "-" else fx, rates[fx][0] if fx != "-" else None,
                         None if dispute == "-" else dispute, rates[dispute][1] if dispute != "-" else None, rates[dispute][2] if dispute != "-" else None))
    df = spark.createDataFrame(rows, "provider string, region string, rate_plan string, rate_id string, rate_pct string, rate_fixed string, rate_currency string, intl_id string, intl_pct string, intl_own boolean, fx_id string, fx_pct string, dispute_id string, dispute_fee string, dispute_currency string")
    for c in ("rate_pct", "rate_fixed", "intl_pct", "fx_pct", "dispute_fee"):
        df = df.withColumn(c, F.col(c).cast(EXACT))
    return df.withColumn("intl_pct", F.when(F.col("intl_own"), (F.col("intl_pct") - F.col("rate_pct")).cast(EXACT)).otherwise(F.col("intl_pct")))


def is_platform_store(plan: Column, identity: Column) -> Column:
    """True, false or null: by the plan, else by what the pages showed."""
    return F.when(plan == "none", False).when(plan.isNotNull(), True).when(identity.isin("confirmed", "probable"), True).when(identity == "not_shopify", False)


def route_shares(gateways: Column) -> Column:
    """Shares in percent that add up to 100; null when one is missing or all are
    zero. A single route without a share takes all."""
    zero = F.lit(0).cast(EXACT)
    total = F.aggregate(gateways, zero, lambda n, g: (n + F.coalesce(g["share"], zero)).cast(EXACT))
    alone = (F.size(gateways) == 1) & F.element_at(gateways, 1)["share"].isNull()
    lost = F.exists(gateways, lambda g: g["share"].isNull())
    scaled = F.transform(gateways, lambda g: F.when(total == 100, g["share"]).otherwise((g["share"] / F.nullif(total, zero) * 100).cast(EXACT)))
    return F.when(alone, F.array(F.lit(100).cast(EXACT))).when(~lost & (total > 0), scaled)


def intl_share(given: Column, mix: Column, home: Column) -> Column:
    """struct(share, status): as answered, else what of the market mix is not
    the home region, to a tenth of a percent (half even)."""
    known = F.map_filter(F.coalesce(mix, F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull())
    total = F.aggregate(F.map_values(known), F.lit(0.0), lambda n, v: n + v)
    own = F.coalesce(F.try_element_at(known, home), F.lit(0.0))
    seen = F.bround(((total - own) / F.nullif(total, F.lit(0.0)) * 100).cast(EXACT), 1).cast(EXACT)
    return F.when(given.isNotNull(), F.struct(given.cast(EXACT).alias("share"), F.lit("user").alias("status"))).when(
        home.isNotNull() & (total > 0), F.struct(seen.alias("share"), F.lit("inferred").alias("status"))
    ).otherwise(F.struct(F.lit(None).cast(EXACT).alias("share"), F.lit("unknown").alias("status")))


def fx_share(given: Column, settle: Column, shown: Column) -> Column:
    return F.when(given.isNotNull(), F.struct(given.cast(EXACT).alias("share"), F.lit("user").alias("status"))).when(
        settle == shown, F.struct(F.lit(0).cast(EXACT).alias("share"), F.lit("inferred").alias("status"))
    ).otherwise(F.struct(F.lit(None).cast(EXACT).alias("share"), F.lit("unknown").alias("status")))


def missing_answers(q: DataFrame) -> Column:
    """What keeps a questionnaire from being computed."""
    lacks = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
    none = F.coalesce(F.size("gateways"), F.lit(0)) <= 0
    return F.array_compact(F.array(F.when(lacks("aov"), F.lit("aov")), F.when(lacks("monthly_orders"), F.lit("monthly_orders")), F.when(none, F.lit("gateways")),
                                   F.when(~none & route_shares(F.col("gateways")).isNull(), F.lit("gateway_shares"))))


def _item(name: str, monthly: Column, status: Column, source: Column, note: Column, pct: Column | None = None, share: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(name).alias("item"), (pct if pct is not None else null).cast(EXACT).alias("pct"), (share if share is not None else null).cast(EXACT).alias("share"),
        F.round(monthly, 2).cast(MONEY).alias("monthly"), status.cast("string").alias("status"), source.cast("string").alias("source_id"), note.cast("string").alias("note"),
    )


def fee_items(q: DataFrame) -> DataFrame:
    """site, route, item, pct, share, monthly (null: unknown), status, source_id,
    note of every cost of every questionnaire that can be computed.

    ``q``: site, entity_country, shopify_plan, identity, aov, aov_currency,
    monthly_orders, intl_card_share, fx_share, market_mix, mor, payout_account,
    payout_currency, payout_fx_pct, withdrawals_per_month, dispute_rate, gateways.
    """
    c = F.col
    q = q.where(F.size(missing_answers(q)) == 0).withColumns({
        "region": F.when(c("entity_country").isin(*REGIONS), c("entity_country")), "money": F.coalesce("aov_currency", F.lit("USD")), "value": c("aov").cast(EXACT), "total": c("monthly_orders").cast(EXACT),
        "shares": route_shares(c("gateways")), "own_cards": F.exists("gateways", lambda g: g["provider"] == "shopify_payments"), "on_platform": is_platform_store(c("shopify_plan"), c("identity")),
    })
    g = q.select("*", F.posexplode("gateways").alias("pos", "g")).withColumns({
        "route": c("g.provider"), "part": F.element_at("shares", c("pos") + 1).cast(EXACT),
    }).withColumn("n", (c("total") * c("part") * F.lit("0.01").cast("decimal(3,2)")).cast(EXACT))
    rates = F.broadcast(route_rates(q.sparkSession))
    plan = F.when(c("g.provider") == "shopify_payments", c("shopify_plan")).otherwise(F.lit("*"))
    g = g.join(rates, (c("route") == rates["provider"]) & g["region"].eqNullSafe(rates["region"]) & (plan == rates["rate_plan"]), "left").drop(rates["provider"]).drop(rates["region"])
    user = c("g.pct").isNotNull()
    pct, fixed = F.coalesce("g.pct", "rate_pct"), F.when(user, F.coalesce("g.fixed", F.lit(0).cast(EXACT))).otherwise(c("rate_fixed"))
    coin = F.when(~user, c("rate_currency"))
    fits = coin.isNull() | (coin == c("money"))
    note = (
        F.when(pct.isNotNull() & ~fits, "currency").when(user, "user_rate").when((c("route") == "shopify_payments") & (c("region") == "CN"), "unverified")
        .when((c("route") == "shopify_payments") & c("region").isin("US", "CA") & ~F.coalesce(c("shopify_plan").isin(*PLANS), F.lit(False)), "plan_unknown")
        .when(pct.isNull() & (c("route") == "stripe") & (c("region") == "CN"), "stripe_cn").when(pct.isNull(), "no_rate")
    )
    unit = (c("value") * pct * F.lit("0.01").cast("decimal(3,2)") + fixed).cast(EXACT)
    known = pct.isNotNull() & fits
    status = F.when(known, F.when(user, "user").otherwise("verified")).otherwise("unknown")
    items = [_item("processing", F.when(known, (c("n") * unit)), status, F.when(user, "user").otherwise(c("rate_id")), note, pct, c("part"))]
    settle = F.coalesce(coin, c("money"))
    home = F.when(settle == "USD", "US").when(settle == "CAD", "CA")
    sales = lambda rate, share: (c("n") * (c("value") * rate * F.lit("0.01").cast("decimal(3,2)")).cast(EXACT)).cast(EXACT) * share * F.lit("0.01").cast("decimal(3,2)")
    official = ~user & c("rate_id").isNotNull() & fits
    for name, rate, source, told in (
        ("intl", c("intl_pct"), c("intl_id"), intl_share(c("intl_card_share"), c("market_mix"), home)), ("fx", c("fx_pct"), c("fx_id"), fx_share(c("fx_share"), settle, c("money"))),
    ):
        share, how = told["share"], told["status"]
        here = official & rate.isNotNull() & ~F.coalesce(share == 0, F.lit(False))
        items.append(F.when(here, _item(name, sales(rate, share), F.when(how == "user", "verified").otherwise(how), source, F.when(how == "inferred", "inferred").when(how == "unknown", "no_share"), rate, share)))
    mor = F.lit(rate_table()["stripe-managed-payments"][0]).cast(EXACT)
    whole = F.lit(100).cast(EXACT)
    items.append(F.when(official & (c("route") == "stripe") & (c("mor") == "stripe_managed_payments"), _item("mor", sales(mor, whole), F.lit("verified"), F.lit("stripe-managed-payments"), F.lit(None), mor, whole)))
    published = (c("route") == "paypal") & (c("region") == "CN") & c("g.withdraw_fee").isNull()
    fee = F.when(published, F.lit(rate_table()["paypal-cn-withdrawal"][1]).cast(EXACT)).otherwise(c("g.withdraw_fee"))
    times = c("withdrawals_per_month").cast(EXACT)
    paid = F.when(~published | (c("money") == "USD"), (fee * times))
    why = F.when(times.isNull(), "no_withdrawals").when(published & (c("money") != "USD"), "currency")
    items.append(F.when(fee.isNotNull(), _item("withdrawal", paid, F.when(paid.isNull(), "unknown").when(published, "verified").otherwise("user"), F.when(published, "paypal-cn-withdrawal").otherwise("user"), why, None, times)))
    lost = F.when(c("dispute_currency") == c("money"), ((c("n") * c("dispute_rate").cast(EXACT)).cast(EXACT) * c("dispute_fee") * F.lit("0.01").cast("decimal(3,2)")))
    items.append(F.when(c("dispute_rate").isNotNull(), _item("dispute", lost, F.when(lost.isNull(), "unknown").otherwise("verified"), c("dispute_id"), F.when(lost.isNull(), "dispute_unknown"), None, c("dispute_rate"))))
    by_route = g.select("site", "route", F.explode(F.array_compact(F.array(*items))).alias("i")).select("site", "route", "i.*")

    exempt = c("g.provider").isin("shopify_payments", "manual") | ((c("g.provider") == "paypal") & c("own_cards"))
    fee_pct = F.lit(None).cast(EXACT)
    for p in PLANS:
        fee_pct = F.when(c("shopify_plan") == p, F.lit(rate_table()[f"shopify-3p-fee-{p}"][0]).cast(EXACT)).otherwise(fee_pct)
    outside = F.aggregate(F.filter(F.zip_with("gateways", "shares", lambda x, s: F.struct(x["provider"].alias("p"), s.alias("s"))), lambda x: ~(x["p"].isin("shopify_payments", "manual") | ((x["p"] == "paypal") & c("own_cards")))),
                          F.lit(0).cast(EXACT), lambda n, x: (n + x["s"]).cast(EXACT))
    amount = (c("total") * c("value")).cast("decimal(20,6)")
    charged = (outside > 0) & F.coalesce(c("on_platform"), c("shopify_plan").isNotNull())
    cny = ((c("region") == "CN") | (c("payout_currency") == "CNY") | (c("payout_account") == "cn_bank")) & (c("money") != "CNY")
    conversion = c("payout_fx_pct").cast(EXACT)
    one = [
        F.when(charged, F.struct(F.lit("platform").alias("route"), _item("platform_fee", (amount * outside * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(24,8)") * fee_pct * F.lit("0.01").cast("decimal(3,2)"),
               F.when(fee_pct.isNull(), "unknown").otherwise("verified"), F.when(fee_pct.isNotNull(), F.concat(F.lit("shopify-3p-fee-"), c("shopify_plan"))), F.when(fee_pct.isNull(), "plan_unknown"), fee_pct, outside).alias("i"))),
        F.when(c("payout_account").isin(*UNVERIFIED_PAYOUT), F.struct(F.lit("payout").alias("route"), _item("payout_account", F.lit(None).cast(EXACT), F.lit("unknown"), F.lit(None), F.lit("payout_account")).alias("i"))),
        F.when(F.coalesce(cny, F.lit(False)), F.struct(F.lit("payout").alias("route"), _item("payout_fx", amount * conversion * F.lit("0.01").cast("decimal(3,2)"), F.when(conversion.isNull(), "unknown").otherwise("user"), F.when(conversion.isNotNull(), "user"), F.when(conversion.isNull(), "payout_fx"), conversion, whole).alias("i"))),
    ]
    by_site = q.select("site", F.explode(F.array_compact(F.array(*one))).alias("r")).select("site", "r.route", "r.i.*")
    return by_route.unionByName(by_site)


def fee_totals(q: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each questionnaire: status (not_computed, partial, computed), what
    is missing, monthly and yearly totals of what is known, their share of sales,
    the number of unknown items, the plan's own price for reference."""
    known = items.groupBy("site").agg(F.coalesce(F.sum("monthly"), F.lit(0)).cast(MONEY).alias("monthly_total"), F.count_if(F.col("monthly").isNull()).alias("n_unknown"))
    lacks = missing_answers(q)
    sales = (F.col("aov").cast(EXACT) * F.col("monthly_orders").cast(EXACT)).cast(MONEY)
    table = {f"{r}:{p}": str(x) for r, own in PLAN_FEES.items() for p, x in own.items()}
    prices = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    rows = q.select("site", lacks.alias("missing"), F.when(F.size(lacks) == 0, sales).alias("monthly_sales"), F.try_element_at(prices, F.concat_ws(":", "entity_country", "shopify_plan")).cast(MONEY).alias("plan_fee")).join(known, "site", "left")
    done = F.size("missing") == 0
    total = F.when(done, F.coalesce("monthly_total", F.lit(0).cast(MONEY)))
    unknown = F.coalesce("n_unknown", F.lit(0))
    return rows.select(
        "site", F.when(~done, "not_computed").when(unknown > 0, "partial").otherwise("computed").alias("status"), F.array_join("missing", ",").alias("missing"), "monthly_sales", total.alias("monthly_total"),
        (total * 12).cast(MONEY).alias("yearly_total"), F.round((total * 100).cast("decimal(20,2)") / F.nullif(F.col("monthly_sales"), F.lit(0).cast(MONEY)), 2).cast(MONEY).alias("pct_of_sales"),
        F.when(done, unknown).alias("n_unknown"), F.when(done, F.col("plan_fee")).alias("plan_fee"),
    )
