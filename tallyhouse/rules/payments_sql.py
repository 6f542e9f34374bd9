"""DuckDB SQL for payment findings and fees of the made-up stores, worked out on
their pieces."""

from __future__ import annotations

from ..operators import fees as FE
from . import cases, payments as P
from .launch_sql import missing, rx

ENTITY = "CASE entity_country WHEN 'China' THEN 'CN' WHEN 'CN' THEN 'CN' WHEN 'us llc' THEN 'US' WHEN 'hong kong' THEN 'HK' WHEN 'UK' THEN 'UK' WHEN 'Canada' THEN 'CA' END"
PAYOUT = "CASE payout_account WHEN 'bank' THEN 'cn_bank' WHEN 'Payoneer' THEN 'payoneer' WHEN 'us bank' THEN 'us_bank' WHEN 'unknown' THEN NULL WHEN '' THEN NULL ELSE payout_account END"
ROUTES = """CASE routes WHEN 'sp:60;paypal:40' THEN ['shopify_payments', 'paypal'] WHEN 'stripe:70;paypal:30' THEN ['stripe', 'paypal'] WHEN 'card:100:3.5+0.30:35' THEN ['card_other']
 WHEN 'stripe:50;paypal:50;manual:100' THEN ['stripe', 'paypal', 'manual'] WHEN 'shopify:100' THEN ['shopify_payments'] WHEN '' THEN []::VARCHAR[] ELSE ['paypal'] END"""
MIX = "CASE mix WHEN 'US:70,CA:30' THEN ['US', 'CA'] WHEN 'DE:50,UK:50' THEN ['DE', 'UK'] WHEN 'US:100' THEN ['US'] WHEN 'US:60,GB:40' THEN ['US', 'UK'] WHEN 'AU' THEN ['AU'] ELSE []::VARCHAR[] END"


def _list(*pairs: tuple[str, str]) -> str:
    """List of the names whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


POLICY = {"refund-policy": "refund", "shipping-policy": "shipping", "privacy-policy": "privacy", "terms-of-service": "terms", "contact-information": "information"}


def facts_sql() -> str:
    ok = {n: f"({p} <> ''{' AND NOT terms_drawn' if p == 'terms' else ''})" for n, p in POLICY.items()}
    gone = [(n, f"({p} = ''{' AND NOT terms_drawn' if p == 'terms' else ''}{' AND NOT covered' if p == 'information' else ''})") for n, p in POLICY.items()]
    return f"""w AS ({cases.pay_pieces_sql()}),
 w1 AS (SELECT *, run <> 'offline' AS online, home_result = 'ok' AS usable, CASE WHEN answered THEN {ENTITY} END AS entity, CASE WHEN answered THEN {PAYOUT} END AS payout, CASE WHEN answered THEN nullif(payout_currency, '') END AS payout_money,
  CASE WHEN answered THEN {ROUTES} ELSE []::VARCHAR[] END AS gw, CASE WHEN answered THEN {MIX} ELSE []::VARCHAR[] END AS sold_in, CASE WHEN ships_to <> '' THEN string_split(ships_to, ',') END AS ships,
  CASE WHEN home_result = 'ok' THEN home_said ELSE '' END AS home_text, CASE WHEN home_result = 'ok' THEN nullif(shown, '') END AS seen_money, nullif(base_currency, '') AS base_money,
  (SELECT 1) AS one FROM w),
 w2 AS (SELECT *, CASE WHEN NOT online THEN 'unknown' WHEN usable AND n_markers = 2 THEN 'confirmed' WHEN usable AND n_markers = 1 THEN 'probable' WHEN usable THEN 'not_shopify' ELSE 'unconfirmed' END AS ident,
  CASE WHEN usable THEN {_list(('american-express', rx('icons', 'pi-american')), ('paypal', rx('icons', 'pi-paypal')), ('shopify-pay', rx('icons', 'pi-shopify')), ('visa', rx('icons', 'pi-visa')))} ELSE []::VARCHAR[] END AS icon_list,
  CASE WHEN usable THEN {_list(('Klarna', 'klarna_js'), ('Stripe', 'stripe_js'))} ELSE []::VARCHAR[] END AS services, {_list(*[(n, c) for n, c in ok.items()])} AS ok_list FROM w1),
 f AS (SELECT *, covered_list.* EXCLUDE (s2) FROM w2 JOIN (SELECT site AS s2, contact <> '' OR ident = 'not_shopify' AS covered FROM w2) covered_list ON s2 = site),
 p AS (SELECT *, {_list(*gone)} AS gone, try_cast(regexp_extract(refund, 'within ([0-9]+) days of', 1) AS INT) AS main,
  list_sort(list_distinct(list_filter([CASE WHEN {rx('home_text', '30-day returns')} THEN 30 END, CASE WHEN {rx('product', '14-day money back')} THEN 14 END, CASE WHEN {rx('faq', 'within 45 days')} THEN 45 END], lambda x: x IS NOT NULL))) AS claimed,
  {rx('refund', 'customer is responsible')} AND {rx('home_text', 'free returns')} AS free_clash, usable AND recharge_js AS plans, {rx('product', 'pre-order')} AS early FROM f)"""


def rules() -> list[tuple[str, list[tuple[str, str, str, str, str]]]]:
    lit = lambda x: f"'{x}'" if x else "NULL"
    text = lambda xs: f"array_to_string({xs}, ',')"
    holds = lambda x, *v: f"list_has_any({x}, {list(v)})"
    known = "ident IN ('confirmed', 'probable')"
    clash = {
        "card": f"NOT ({holds('icon_list', 'visa', 'american-express')} AND NOT {holds('gw', *P.CARD_ROUTES)})", "paypal": f"NOT ({holds('icon_list', 'paypal')} AND NOT {holds('gw', 'paypal')})",
        "shop_pay": f"NOT ({holds('icon_list', 'shopify-pay')} AND NOT {holds('gw', 'shopify_payments')})",
        "amex": f"NOT (coalesce(entity = 'CN', false) AND {holds('icon_list', 'american-express')} AND NOT {holds('gw', 'card_other', 'manual', 'airwallex')})",
        "instalments": f"NOT ({holds('services', 'Klarna')} AND NOT {holds('gw', 'stripe', 'shopify_payments', 'airwallex')})",
    }
    seen = "(len(icon_list) > 0 OR len(services) > 0)"
    read = "list_has_any(ok_list, ['privacy-policy', 'terms-of-service'])"
    lost = "CASE WHEN terms_drawn THEN []::VARCHAR[] ELSE gone END"
    unclear = "CASE WHEN terms_drawn THEN list_sort(list_concat(['terms-of-service'], gone)) ELSE []::VARCHAR[] END"
    short = "list_sort(" + _list(*[(n, f"{p} <> '' AND length(trim({p})) < 200{' AND NOT terms_drawn' if p == 'terms' else ''}") for n, p in POLICY.items()]) + ")"
    stub = rx("refund", "insert your company")
    stubs = f"CASE WHEN {stub} THEN 'refund-policy' ELSE '' END"
    refund = {"days": "true", **{k: rx("refund", v) for k, v in P.REFUND_ITEMS.items()}}
    shipping = {k: rx("shipping", v) for k, v in P.SHIPPING_ITEMS.items()}
    worldwide = f"({rx('shipping', P.WORLDWIDE)} AND len(ships) = 1)"
    other = "list_filter(claimed, lambda x: x <> main)"
    wants_plan, wants_early = "(plans OR (answered AND subscription = 'yes'))", "(early OR (answered AND preorder = '是'))"
    terms = {"cancel": f"(NOT {wants_plan} OR (NOT terms_drawn AND {rx('terms', 'cancel')}))", "preorder": f"NOT {wants_early}"}
    wants = f"online AND ({wants_plan} OR {wants_early})"
    names = f"({rx('refund', 'acme trading ltd')} OR {rx('information', 'acme trading ltd')})"
    dollars = f"list_sort(list_filter(list_distinct(list_concat(sold_in, coalesce(ships, []::VARCHAR[]))), lambda x: list_contains({list(P.DOLLAR_MARKETS)}, x)))"
    bare = "(contains(product, '$ 20') AND NOT contains(product, 'USD'))"
    steps = "((CASE WHEN seen_money <> base_money THEN 1 ELSE 0 END) + (CASE WHEN payout_money <> base_money THEN 1 ELSE 0 END))::VARCHAR"
    reached = "list_concat(ships, CASE WHEN list_contains(ships, 'GB') THEN ['UK'] ELSE []::VARCHAR[] END)"
    gap = f"list_sort(list_filter(sold_in, lambda x: NOT list_contains({reached}, x)))"
    ways = _list(("email", f"({rx('home_text', 'help@acme')} OR {rx('contact', 'hello@acme')})"), ("phone", rx("home_text", "phone [+]1")), ("chat", "usable AND chat_js"))
    firms = _list(("acme trading", names), ("zeta goods", rx("contact", "zeta goods ltd")))
    place = {"name": f"len({firms}) > 0", "address": rx("information", "12 high street")}
    same = "(entity = nullif(meta_country, '') OR (entity = 'UK' AND meta_country = 'GB'))"
    both = "entity IS NOT NULL AND meta_country <> ''"
    kinds = "list_distinct(list_filter(gw, lambda x: x <> 'manual'))"
    european = f"list_sort(list_filter(sold_in, lambda x: list_contains({list(P.EU_UK)}, x)))"
    sp, category = holds("gw", "shopify_payments"), "nullif(category, '')"
    return [
        ("S01", [("NOT online", "P0", "unknown", "not_found", lit("offline")), ("usable AND scheme = 'https'", "P0", "ok", "verified", "NULL"), ("usable", "P0", "issue", "verified", lit("not_https")), ("note <> ''", "P0", "issue", "verified", lit("certificate")), ("true", "P0", "unknown", "not_found", "home_result")]),
        ("S02", [("ident = 'confirmed'", "info", "ok", "verified", "ident"), ("ident = 'probable'", "info", "ok", "on_page", "ident"), ("ident = 'not_shopify'", "info", "ok", "inferred", "ident"), ("true", "info", "unknown", "not_found", "NULL")]),
        ("S03", [("cart_result = 'ok' AND contains(cart_html, 'checkout')", "P1", "ok", "on_page", "NULL"), ("cart_result = 'ok' AND contains(cart_html, 'empty')", "P1", "unknown", "not_found", lit("empty_cart")), ("cart_result = 'ok'", "P1", "unknown", "not_found", lit("no_button")),
                 (f"cart_result = 'not_found' AND usable AND n_markers = 2 AND {known}", "P1", "issue", "not_found", lit("cart_404")), ("true", "P1", "unknown", "not_found", lit("not_fetched"))]),
        ("S04", [("len(icon_list) > 0", "info", "ok", "on_page", text("icon_list")), ("usable", "info", "unknown", "not_found", "NULL")]), ("S05", [("len(services) > 0", "info", "ok", "on_page", text("services")), ("usable", "info", "ok", "not_found", "NULL")]),
        ("S06", [(f"{seen} AND len(gw) = 0", "P1", "unknown", "not_found", lit("no_routes")), (f"{seen} AND {missing(clash)} <> ''", "P1", "issue", "conflicting", missing(clash)), (seen, "P1", "ok", "user_input", "NULL")]),
        ("S07", [("product <> '' AND express", "info", "ok", "on_page", lit("1")), ("product <> ''", "info", "ok", "not_found", "NULL")]), ("S08", [("list_contains(services, 'Klarna') AND len(sold_in) <> 1", "P2", "issue", "inferred", lit("Klarna")), ("list_contains(services, 'Klarna')", "P2", "ok", "on_page", "NULL")]),
        ("S09", [(f"{read} AND {rx('privacy', 'payment details')}", "P3", "ok", "verified", "NULL"), (read, "P3", "issue", "not_found", "NULL")]),
        ("P01", [("NOT online", "P0", "unknown", "not_found", lit("offline")), (f"list_has_any({lost}, ['refund-policy', 'shipping-policy'])", "P0", "issue", "not_found", text(lost)), (f"len({lost}) > 0", "P1", "issue", "not_found", text(lost)), (f"len({unclear}) = 0", "P0", "ok", "verified", "NULL")]),
        ("P01", [(f"online AND len({unclear}) > 0", "P1", "unknown", "not_found", text(unclear))]),
        ("P02", [(f"online AND (len({short}) > 0 OR {stub})", "P1", "issue", "verified", f"{text(short)} || ';' || {stubs}"), ("online AND len(ok_list) > 0", "P1", "ok", "verified", "NULL")]),
        ("P03", [(f"online AND refund <> '' AND {missing(refund)} <> ''", "P2", "issue", "verified", missing(refund)), ("online AND refund <> ''", "P1", "ok", "verified", "main::VARCHAR")]),
        ("P04", [(f"online AND shipping <> '' AND {worldwide}", "P1", "issue", "conflicting", lit("one_country")), (f"online AND shipping <> '' AND {missing(shipping)} <> ''", "P1", "issue", "verified", missing(shipping)), ("online AND shipping <> ''", "P1", "ok", "verified", "NULL")]),
        ("P05", [(f"online AND refund <> '' AND (len({other}) > 0 OR free_clash)", "P1", "issue", "conflicting", f"{text(other)} || CASE WHEN free_clash THEN ';free' ELSE '' END"), ("online AND refund <> ''", "P1", "ok", "verified", "main::VARCHAR")]),
        ("P06", [(f"{wants} AND {missing(terms)} <> ''", "P1", "issue", "not_found", missing(terms)), (f"{wants} AND (plans OR early)", "P1", "ok", "on_page", "NULL"), (wants, "P1", "ok", "user_input", "NULL")]),
        ("P07", [(f"online AND {rx('faq', 'appears on your statement')}", "P2", "ok", "verified", "NULL"), ("online AND (len(ok_list) > 0 OR faq <> '')", "P2", "issue", "inferred", f"CASE WHEN usable AND brand = 'Zeta' AND {names} THEN 'name_differs' END")]),
        ("P08", [(f"online AND {rx('home_text', '20% off')} AND {rx('home_text', 'terms apply')}", "P3", "ok", "verified", "NULL"), (f"online AND {rx('home_text', '20% off')}", "P3", "issue", "inferred", "NULL")]),
        ("M01", [(f"online AND product <> '' AND {bare} AND len({dollars}) > 1", "P2", "issue", "verified", text(dollars)), (f"online AND product <> '' AND {bare}", "P2", "ok", "verified", lit("one_market")), ("online AND product <> ''", "P2", "ok", "verified", "NULL")]),
        ("M02", [("online AND coalesce(base_money, seen_money) IS NOT NULL AND payout_money IS NOT NULL", "info", "ok", "user_input", steps), ("online AND coalesce(base_money, seen_money) IS NOT NULL", "info", "ok", "verified", steps)]),
        ("M03", [("online AND usable AND converter_js", "P1", "issue", "on_page", "NULL"), ("online AND usable AND selector", "P1", "ok", "on_page", lit("0"))]),
        ("M04", [(f"online AND len(sold_in) > 0 AND ships IS NOT NULL AND len({gap}) > 0", "P2", "issue", "conflicting", text(gap)), ("online AND len(sold_in) > 0 AND ships IS NOT NULL", "P2", "ok", "verified", "NULL")]),
        ("T01", [(f"online AND len({ways}) >= 2", "P1", "ok", "verified", text(ways)), (f"online AND len({ways}) = 1", "P2", "issue", "not_found", text(ways)), ("online AND usable", "P0", "issue", "not_found", "NULL")]),
        ("T02", [(f"online AND len({firms}) > 1", "P2", "issue", "conflicting", text(firms)), (f"online AND {missing(place)} = ''", "P2", "ok", "verified", "NULL"), ("online AND len(ok_list) > 0", "P2", "issue", "not_found", missing(place))]),
        ("T03", [(f"online AND {both} AND {same}", "P2", "ok", "verified", "NULL"), (f"online AND {both}", "P2", "issue", "conflicting", "meta_country || ',' || entity")]),
        ("T04", [("online AND (description = 80 OR images = 1)", "P2", "issue", "verified", "NULL"), ("online", "P2", "ok", "verified", "NULL")]), ("T05", [(f"online AND {rx('home_text', 'secure checkout')}", "info", "ok", "self_claim", "NULL")]),
        ("E00", [("NOT answered", "info", "unknown", "not_found", "NULL")]), ("E01", [(f"entity = 'CN' AND {sp}", "P1", "issue", "inferred", "NULL")]), ("E02", [("entity = 'CN' AND list_contains(gw, 'stripe')", "P1", "issue", "conflicting", "NULL")]), ("E03", [("payout = 'mercury'", "P2", "issue", "inferred", "NULL")]),
        ("E04", [(f"entity = 'CN' AND {sp} AND payout <> 'worldfirst'", "P0", "issue", "conflicting", "payout"), ("len(gw) > 0 AND payout = 'none'", "P0", "issue", "user_input", "NULL"), ("len(gw) > 0 AND payout IS NOT NULL", "P0", "ok", "user_input", "payout"), ("len(gw) > 0", "P0", "unknown", "not_found", "NULL")]),
        ("E05", [(f"len(gw) > 0 AND len({kinds}) <= 1", "P1", "issue", "inferred", text(kinds)), ("len(gw) > 0", "P1", "ok", "user_input", text(f"list_sort({kinds})"))]),
        ("E06", [(f"answered AND {rx('category', 'cbd|knives')}", "P1", "issue", "inferred", "category"), (f"answered AND {category} IS NOT NULL", "P1", "ok", "inferred", "category")]),
        ("E07", [(f"answered AND len({european}) > 0 AND coalesce(nullif(mor, ''), 'no') = 'no'", "P2", "issue", "inferred", text(european))]),
    ]


def findings_sql() -> str:
    made = []
    for rid, cases_ in rules():
        one = " ".join(f"WHEN coalesce({cond}, false) THEN {{'rule_id': '{rid}', 'severity': '{sev if result == 'issue' else 'info'}', 'result': '{result}', 'badge': '{badge}', 'note': {note}}}" for cond, sev, result, badge, note in cases_)
        made.append(f"CASE {one} END")
    return f"""WITH {facts_sql()}, x AS (SELECT site, unnest([{', '.join(made)}]) AS v FROM p),
 findings AS (SELECT site, v.rule_id AS rule_id, v.severity AS severity, v.result AS result, v.badge AS badge, v.note AS note FROM x WHERE v IS NOT NULL)"""


def fees_sql() -> str:
    rates = FE.rate_table()
    d = lambda x: f"{x}::DECIMAL(18,6)"
    table = []
    for line in FE.ROUTES.strip().splitlines():
        for plan in FE.PLANS if "{plan}" in line else ("*",):
            provider, region, _, base, intl, _, dispute = line.replace("{plan}", plan).split()
            pct, fixed, money = rates[base]
            extra = "NULL" if intl == "-" else f"{rates[intl][0]}::DECIMAL(18,6) - {pct}::DECIMAL(18,6)" if rates[intl][1] else d(rates[intl][0])
            fx = line.replace("{plan}", plan).split()[5]
            fee = "NULL" if dispute == "-" else d(rates[dispute][1])
            table.append(f"('{provider}', '{region}', '{plan}', '{base}', {d(pct)}, {d(fixed)}, '{money}', {'NULL' if intl == '-' else repr(intl)}, {extra}, {'NULL' if fx == '-' else repr(fx)}, {'NULL' if fx == '-' else d(rates[fx][0])}, {'NULL' if dispute == '-' else repr(dispute)}, {fee}, {'NULL' if dispute == '-' else repr(rates[dispute][2])})")
    pct1 = "0.01::DECIMAL(3,2)"
    cents = lambda x: f"round({x}, 2)::DECIMAL(18,2)"
    exact = lambda x: f"({x})::DECIMAL(18,6)"
    sold = lambda rate, share: cents(f"{exact(f'n * {exact(f'aov * {rate} * {pct1}')}')} * {share} * {pct1}")
    item = lambda name, cond, monthly, status, source, note, pct="NULL", share="NULL", route="provider": f"SELECT site, {route} AS route, '{name}' AS item, {pct}::DECIMAL(18,6) AS pct, {share}::DECIMAL(18,6) AS share, {monthly} AS monthly, {status} AS status, {source} AS source_id, {note} AS note FROM {'r' if route == 'provider' else 'q'} WHERE {cond}"
    parsed = """CASE routes WHEN 'paypal:100' THEN [{'provider': 'paypal', 'share': 100, 'upct': NULL::DECIMAL(18,6), 'wd': NULL::DECIMAL(18,6)}] WHEN 'sp:60;paypal:40' THEN [{'provider': 'shopify_payments', 'share': 60, 'upct': NULL, 'wd': NULL}, {'provider': 'paypal', 'share': 40, 'upct': NULL, 'wd': NULL}]
   WHEN 'stripe:70;paypal:30' THEN [{'provider': 'stripe', 'share': 70, 'upct': NULL, 'wd': NULL}, {'provider': 'paypal', 'share': 30, 'upct': NULL, 'wd': NULL}] WHEN 'card:100:3.5+0.30:35' THEN [{'provider': 'card_other', 'share': 100, 'upct': 3.5, 'wd': 35}]
   WHEN 'stripe:50;paypal:50;manual:100' THEN [{'provider': 'stripe', 'share': 25, 'upct': NULL, 'wd': NULL}, {'provider': 'paypal', 'share': 25, 'upct': NULL, 'wd': NULL}, {'provider': 'manual', 'share': 50, 'upct': NULL, 'wd': NULL}]
   WHEN 'shopify:100' THEN [{'provider': 'shopify_payments', 'share': 100, 'upct': NULL, 'wd': NULL}] WHEN 'paypal:100:4.0' THEN [{'provider': 'paypal', 'share': 100, 'upct': 4.0, 'wd': NULL}] END"""
    home_share = "CASE settle WHEN 'USD' THEN CASE mix WHEN 'US:70,CA:30' THEN 30 WHEN 'DE:50,UK:50' THEN 100 WHEN 'US:100' THEN 0 WHEN 'US:60,GB:40' THEN 40 WHEN 'AU' THEN 100 END WHEN 'CAD' THEN CASE mix WHEN 'US:70,CA:30' THEN 70 WHEN '' THEN NULL ELSE 100 END END"
    outside = "CASE routes WHEN 'sp:60;paypal:40' THEN 0 WHEN 'shopify:100' THEN 0 WHEN 'stripe:50;paypal:50;manual:100' THEN 50 ELSE 100 END"
    plan_pct = "CASE plan WHEN 'basic' THEN 2 WHEN 'Shopify' THEN 1 WHEN 'advanced' THEN 0.6 WHEN 'plus' THEN 0.2 END"
    published = "(provider = 'paypal' AND region = 'CN' AND wd IS NULL)"
    fee = f"CASE WHEN {published} THEN 35::DECIMAL(18,6) ELSE wd END"
    paid = f"CASE WHEN NOT {published} OR money = 'USD' THEN {cents(f'{fee} * withdrawals::DECIMAL(18,6)')} END"
    lost = f"CASE WHEN d_money = money THEN {cents(f'{exact('n * dispute::DECIMAL(18,6)')} * d_fee * {pct1}')} END"
    cny = "coalesce(region = 'CN' OR payout_currency = 'CNY' OR payout = 'cn_bank', false)"
    amount = "(orders::DECIMAL(18,6) * aov)::DECIMAL(20,6)"
    return f"""WITH {facts_sql()},
 rates(provider, region, rate_plan, rate_id, r_pct, r_fixed, r_money, i_id, i_pct, x_id, x_pct, d_id, d_fee, d_money) AS (VALUES {', '.join(table)}),
 q AS (SELECT site, routes, mix, plan, aov::DECIMAL(18,6) AS aov, orders, intl, fx, withdrawals, dispute, payout_fx, payout, payout_currency, nullif(mor, '') AS mor, CASE WHEN entity IN ('CN', 'HK', 'US', 'CA', 'UK') THEN entity END AS region, ident,
  coalesce(nullif(aov_currency, ''), 'USD') AS money, CASE plan WHEN 'Shopify' THEN 'grow' WHEN '' THEN NULL ELSE plan END AS own_plan FROM p WHERE answered AND aov <> 0 AND orders IS NOT NULL AND routes <> ''),
 g AS (SELECT *, unnest({parsed}) AS u FROM q), h AS (SELECT *, u.provider AS provider, u.share::DECIMAL(18,6) AS share, u.upct::DECIMAL(18,6) AS upct, u.wd::DECIMAL(18,6) AS wd, (orders::DECIMAL(18,6) * u.share::DECIMAL(18,6) * {pct1})::DECIMAL(18,6) AS n FROM g),
 j AS (SELECT h.*, rate_id, r_pct, r_fixed, r_money, i_id, i_pct, x_id, x_pct, d_id, d_fee, d_money, coalesce(upct, r_pct) AS pct, CASE WHEN upct IS NOT NULL THEN CASE WHEN routes = 'card:100:3.5+0.30:35' THEN 0.3 ELSE 0 END ELSE r_fixed END::DECIMAL(18,6) AS fixed,
  CASE WHEN upct IS NULL THEN r_money END AS coin FROM h LEFT JOIN rates ON rates.provider = h.provider AND rates.region = h.region AND rates.rate_plan = CASE WHEN h.provider = 'shopify_payments' THEN own_plan ELSE '*' END),
 r0 AS (SELECT *, coin IS NULL OR coin = money AS fits, coalesce(coin, money) AS settle FROM j), r AS (SELECT *, pct IS NOT NULL AND fits AS known, upct IS NULL AND rate_id IS NOT NULL AND fits AS official,
  CASE WHEN intl <> '' THEN 30 ELSE {home_share} END::DECIMAL(18,6) AS i_share, CASE WHEN intl <> '' THEN 'verified' WHEN ({home_share}) IS NULL THEN 'unknown' ELSE 'inferred' END AS i_status FROM r0),
 items AS ({item('processing', 'true', f"CASE WHEN known THEN {cents(f'n * {exact(f'aov * pct * {pct1} + fixed')}')} END", "CASE WHEN NOT known THEN 'unknown' WHEN upct IS NOT NULL THEN 'user' ELSE 'verified' END", "CASE WHEN upct IS NOT NULL THEN 'user' ELSE rate_id END",
   "CASE WHEN pct IS NOT NULL AND NOT fits THEN 'currency' WHEN upct IS NOT NULL THEN 'user_rate' WHEN provider = 'shopify_payments' AND region = 'CN' THEN 'unverified' WHEN provider = 'shopify_payments' AND region IN ('US', 'CA') AND coalesce(own_plan NOT IN ('basic', 'grow', 'advanced', 'plus'), true) THEN 'plan_unknown' WHEN pct IS NULL AND provider = 'stripe' AND region = 'CN' THEN 'stripe_cn' WHEN pct IS NULL THEN 'no_rate' END", 'pct', 'share')}
  UNION ALL {item('intl', 'official AND i_pct IS NOT NULL AND coalesce(i_share <> 0, true)', sold('i_pct', 'i_share'), 'i_status', 'i_id', "CASE i_status WHEN 'inferred' THEN 'inferred' WHEN 'unknown' THEN 'no_share' END", 'i_pct', 'i_share')}
  UNION ALL {item('fx', "official AND x_pct IS NOT NULL AND fx <> ''", sold('x_pct', '12::DECIMAL(18,6)'), "'verified'", 'x_id', 'NULL', 'x_pct', '12')}
  UNION ALL {item('mor', "official AND provider = 'stripe' AND mor = 'stripe_managed_payments'", sold('3.5::DECIMAL(18,6)', '100::DECIMAL(18,6)'), "'verified'", "'stripe-managed-payments'", 'NULL', '3.5', '100')}
  UNION ALL {item('withdrawal', f'({fee}) IS NOT NULL', paid, f"CASE WHEN ({paid}) IS NULL THEN 'unknown' WHEN {published} THEN 'verified' ELSE 'user' END", f"CASE WHEN {published} THEN 'paypal-cn-withdrawal' ELSE 'user' END", f"CASE WHEN withdrawals IS NULL THEN 'no_withdrawals' WHEN {published} AND money <> 'USD' THEN 'currency' END", 'NULL', 'withdrawals')}
  UNION ALL {item('dispute', 'dispute IS NOT NULL', lost, f"CASE WHEN ({lost}) IS NULL THEN 'unknown' ELSE 'verified' END", 'd_id', f"CASE WHEN ({lost}) IS NULL THEN 'dispute_unknown' END", 'NULL', 'dispute')}
  UNION ALL {item('platform_fee', f"({outside}) > 0 AND (own_plan IS NOT NULL AND own_plan <> 'none' OR own_plan IS NULL AND ident IN ('confirmed', 'probable'))", cents(f'({amount} * ({outside})::DECIMAL(18,6) * {pct1})::DECIMAL(24,8) * ({plan_pct})::DECIMAL(6,3) * {pct1}'), f"CASE WHEN ({plan_pct}) IS NULL THEN 'unknown' ELSE 'verified' END", f"CASE WHEN ({plan_pct}) IS NOT NULL THEN 'shopify-3p-fee-' || own_plan END", f"CASE WHEN ({plan_pct}) IS NULL THEN 'plan_unknown' END", f'({plan_pct})', f'({outside})', "'platform'")}
  UNION ALL {item('payout_account', f"payout IN {FE.UNVERIFIED_PAYOUT}", 'NULL::DECIMAL(18,2)', "'unknown'", 'NULL', "'payout_account'", route="'payout'")}
  UNION ALL {item('payout_fx', f"{cny} AND money <> 'CNY'", cents(f'{amount} * payout_fx::DECIMAL(6,3) * {pct1}'), "CASE WHEN payout_fx IS NULL THEN 'unknown' ELSE 'user' END", "CASE WHEN payout_fx IS NOT NULL THEN 'user' END", "CASE WHEN payout_fx IS NULL THEN 'payout_fx' END", 'payout_fx', '100', "'payout'")})"""
