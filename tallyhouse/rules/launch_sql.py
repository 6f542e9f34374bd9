"""DuckDB SQL for the findings of the made-up stores, worked out on their pieces."""

from __future__ import annotations

from . import cases, launch as L


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def target(*tokens: str) -> str:
    return f"list_has_any(tokens, {list(tokens)})"


def missing(items: dict[str, str]) -> str:
    """Comma-joined names of what does not hold."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN NULL ELSE '{k}' END" for k, c in items.items()) + ")"


def ok(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'pass' ELSE 'fail' END"


VISIBLE = ("refund", "shipping", "privacy", "terms", "legal", "subscription", "contact", "faq", "pdp", "home_text")
LEGAL = ("refund", "terms", "legal", "faq")
DUTY_PAGES = ("refund", "shipping", "terms", "faq", "pdp", "foot")


def facts_sql() -> str:
    number = lambda piece: f"try_cast(regexp_extract({piece}, 'within ([0-9]+) days of', 1) AS INT)"
    refunded = lambda piece: f"try_cast(regexp_extract({piece}, 'processed within ([0-9]+) days', 1) AS INT)"
    link = {n: f"contains(foot_links, '{mark}')" for n, mark in {"refund": "refund-policy", "shipping": "shipping-policy", "privacy": "privacy-policy", "terms": "terms-of-service", "impressum": "impressum", "contact": "pages/contact"}.items()}
    return f"""w AS ({cases.pieces_sql()}),
 w1 AS (SELECT *, home AND NOT drawn AS live, mode = 'paste' AS paste, mode <> 'paste' AND home AS online, home OR mode = 'paste' AS read_any, mode = 'online' AND NOT home AS failed, password AND mode <> 'paste' AS locked,
  CASE WHEN NOT home THEN 'unknown' WHEN marker AND NOT drawn THEN 'shopify' ELSE 'other' END AS platform FROM w),
 w2 AS (SELECT *, CASE WHEN live THEN footer_links ELSE '' END AS foot_links, CASE WHEN live THEN footer_said ELSE '' END AS foot, CASE WHEN live THEN bar || ' ' || footer_said || ' ' || home_said ELSE '' END AS home_text,
  live AND alternates AS has_pairs, CASE WHEN live AND alternates THEN CASE alternate_code WHEN 'de-DE' THEN ['DE'] WHEN 'en-UK' THEN ['GB'] WHEN 'fr-FR' THEN ['FR'] ELSE []::VARCHAR[] END ELSE []::VARCHAR[] END AS seen FROM w1),
 w3 AS (SELECT *, CASE user_markets WHEN 'US' THEN ['US'] WHEN 'US, UK, de' THEN ['US', 'GB', 'DE'] WHEN 'EU' THEN ['EU'] WHEN 'AU and Canada' THEN ['AU', 'CA'] WHEN 'France' THEN ['FR'] WHEN 'UK' THEN ['GB'] WHEN 'CA/DE' THEN ['CA', 'DE']
  ELSE list_distinct(list_concat(seen, ['US'])) END AS countries FROM w2),
 w4 AS (SELECT *, list_distinct(list_concat(list_transform(countries, lambda x: CASE WHEN x = 'GB' THEN 'UK' ELSE x END), CASE WHEN list_has_any(countries, ['DE', 'FR']) THEN ['EU'] ELSE []::VARCHAR[] END)) AS tokens,
  list_concat([CASE WHEN live THEN string_split(lower(lang), '-')[1] ELSE 'en' END], CASE WHEN has_pairs THEN ['en', string_split(lower(alternate_code), '-')[1]] ELSE []::VARCHAR[] END) AS langs FROM w3),
 f AS (SELECT *, len(countries) > 1 OR market_code <> '' AS multi, {', '.join(f"{c} AS link_{n}" for n, c in link.items())},
  list_filter(countries, lambda x: NOT list_has_any(CASE x WHEN 'DE' THEN ['de'] WHEN 'EU' THEN ['de'] WHEN 'FR' THEN ['fr'] WHEN 'CA' THEN ['en', 'fr'] ELSE ['en'] END, langs)) AS gaps,
  len(list_distinct(list_transform(countries, lambda x: CASE x WHEN 'DE' THEN 'de' WHEN 'EU' THEN 'de' WHEN 'FR' THEN 'fr' ELSE 'en' END))) > 1 AS foreign_langs,
  list_filter(list_concat(regexp_extract_all(legal || contact || foot, '[a-z]+@[a-z]+[.]com')), lambda x: true) AS mails,
  list_concat(regexp_extract_all(contact, '[+]86 755 1234 5678'), regexp_extract_all(foot, '[+]49 30 1234 5678|0800 555 1234')) AS phones,
  {any_of(*[rx(p, L.ADDRESS) for p in VISIBLE if p != 'home_text'], rx("CASE WHEN live THEN bar || ' ' || footer_said ELSE '' END", L.ADDRESS))} AS address,
  {any_of(*[rx(p, L.HOURS) for p in VISIBLE])} AS hours, {any_of(*[rx(p, L.TEMPLATE_INFO) for p in VISIBLE])} AS template,
  {any_of(*[f"({p} <> '' AND (length({p}) < 200 OR {rx(p, L.PLACEHOLDER)}))" for p in ('refund', 'shipping', 'privacy', 'terms', 'legal', 'subscription')])} AS unfilled,
  (has_product AND plan) OR {rx('pdp', L.PAGE_SUBSCRIPTION)} AS subscribes, {rx('refund', 'of purchase')} AS purchase, {rx('refund', 'customer is responsible')} AS buyer, {rx('refund', '15% restocking')} AS fee, {rx('faq', 'free returns')} AS seller,
  {number('refund')} AS days_refund, {number('faq')} AS days_faq, {refunded('refund')} AS back_refund, {refunded('faq')} AS back_faq,
  {any_of(*[f"{p} <> ''" for p in LEGAL])} AS legal_items, {any_of(*[rx(p, L.WITHDRAW_14) for p in LEGAL])} AS withdraw, {any_of(*[rx(p, L.FORM) for p in LEGAL])} AS form, {any_of(*[rx(p, L.UNOPENED) for p in LEGAL])} AS unopened,
  {any_of(*[rx(p, L.FAULTY) for p in LEGAL])} AS faulty, ({rx('refund', 'all sales are final')} AND NOT {rx('refund', L.FAULTY)}) OR {rx('terms', 'no refunds')} AS final_sale,
  {any_of(*[rx(p, L.DUTY) for p in DUTY_PAGES])} AS duty, {rx('refund', 'acme trading ltd')} AND {rx('contact', 'zeta goods ltd')} AS two_names FROM w4)"""


def results() -> dict[str, tuple[str, str]]:
    """(result, note) of each rule over f, before gates."""
    out: dict[str, tuple[str, str]] = {}

    def presence(piece):
        hidden = f"({piece} <> '' AND online AND NOT link_{piece})"
        return (
            f"CASE WHEN {hidden} THEN 'fail' WHEN {piece} <> '' THEN 'pass' WHEN paste THEN 'manual' WHEN NOT home THEN 'unknown' WHEN link_{piece} THEN 'unknown' ELSE 'fail' END",
            f"CASE WHEN {hidden} THEN 'exists_not_in_footer' WHEN {piece} <> '' THEN NULL WHEN paste THEN 'not_in_pasted_text' WHEN NOT home THEN 'homepage_unavailable' WHEN link_{piece} THEN 'footer_link_not_read' ELSE 'no_page_no_footer_link' END",
        )

    for rid, piece in (("POL-01", "refund"), ("POL-02", "shipping"), ("POL-03", "privacy"), ("POL-04", "terms")):
        out[rid] = presence(piece)

    def listed(piece, gate, items, absent):
        gone = f"CASE WHEN paste OR ({out[gate][0]}) = 'fail' THEN 'skip' ELSE 'unknown' END"
        return f"CASE WHEN {piece} = '' THEN {gone} WHEN {missing(items)} = '' THEN 'pass' ELSE 'fail' END", f"CASE WHEN {piece} = '' THEN '{absent}' ELSE nullif({missing(items)}, '') END"

    reach = "(contact <> '' OR len(mails) > 0 OR (online AND link_contact))"
    out["POL-05"] = f"CASE WHEN {reach} THEN 'pass' WHEN NOT read_any THEN 'unknown' ELSE 'fail' END", "NULL"
    notice = {"email": rx("legal", "@acme"), "address": rx("legal", r"\b\d{4,5}\b"), "footer_link": "(NOT online OR link_impressum)"}
    out["POL-06"] = (
        f"CASE WHEN NOT {target('DE', 'AT')} THEN 'skip' WHEN legal = '' THEN CASE WHEN read_any THEN 'fail' ELSE 'unknown' END WHEN {missing(notice)} = '' THEN 'pass' ELSE 'fail' END",
        f"CASE WHEN NOT {target('DE', 'AT')} THEN NULL WHEN legal = '' THEN 'no_legal_notice' ELSE nullif({missing(notice)}, '') END",
    )
    out["POL-07"] = ok("NOT unfilled"), "NULL"
    out["POL-08"] = "CASE WHEN NOT subscribes THEN 'skip' WHEN subscription <> '' THEN 'pass' ELSE 'fail' END", "CASE WHEN NOT subscribes THEN 'no_subscription_seen' WHEN subscription = '' THEN 'subscription_products_no_policy' END"
    out["CON-01"] = listed("refund", "POL-01", {"window": "true", "start": "true", **{k: rx("refund", L.REFUND_ITEMS[k]) for k in ("condition", "how", "refund_time")}}, "no_refund_policy")
    out["CON-02"] = "CASE WHEN purchase THEN 'fail' WHEN refund <> '' THEN 'pass' ELSE 'unknown' END", "NULL"
    out["CON-03"] = listed("shipping", "POL-02", {k: rx("shipping", v) for k, v in L.SHIPPING_ITEMS.items()}, "no_shipping_policy")
    out["CON-04"] = f"CASE WHEN NOT (fee OR buyer) THEN 'pass' WHEN pdp <> '' AND NOT paste THEN {ok(rx('pdp', 'restocking|return'))} ELSE 'unknown' END", "NULL"
    out["CON-05"] = ok("NOT fee"), "NULL"
    out["CON-06"] = ok("NOT final_sale"), "NULL"
    out["CON-07"] = f"CASE WHEN {rx('refund', 'shenzhen')} AND NOT buyer THEN 'fail' WHEN refund <> '' THEN 'pass' ELSE 'unknown' END", "NULL"
    out["CNS-01"] = ok("coalesce(days_refund = days_faq, true)"), "NULL"
    out["CNS-02"] = "'pass'", "NULL"
    out["CNS-03"] = ok("NOT (buyer AND seller)"), "NULL"
    out["CNS-04"] = ok(f"NOT (live AND {rx('bar', '75')} AND {rx('shipping', 'free shipping')})"), "NULL"
    out["CNS-05"] = ok(f"NOT (fee AND {rx('faq', 'no restocking fee')})"), "NULL"
    out["CNS-06"] = ok(f"NOT ({rx('refund', 'in rmb')} AND currency <> 'CNY')"), "NULL"
    out["CNS-07"] = ok("coalesce(back_refund = back_faq, true)"), "NULL"
    out["CNS-08"] = ok("NOT two_names"), "NULL"
    out["GMC-01"] = f"CASE WHEN online THEN {ok(any_of('link_contact', rx('foot', 'help@acme')))} ELSE 'unknown' END", "CASE WHEN NOT online THEN 'needs_live_site' END"
    out["GMC-02"] = f"CASE WHEN online AND https_redirect IS NOT NULL THEN {ok('https_redirect')} ELSE 'unknown' END", "NULL"
    sold = "pdp <> '' AND NOT paste"
    out["GMC-03"] = f"CASE WHEN {sold} THEN {ok(rx('pdp', 'tax included'))} ELSE 'unknown' END", f"CASE WHEN NOT ({sold}) THEN 'no_product_page' END"
    out["GMC-04"] = f"CASE WHEN home THEN {ok('len(gaps) = 0')} ELSE 'unknown' END", "NULL"
    out["GMC-05"] = f"CASE WHEN {sold} THEN {ok('cart AND NOT (has_product AND NOT stocked)')} ELSE 'unknown' END", f"CASE WHEN NOT ({sold}) THEN 'no_product_page' END"
    out["GMC-06"] = "CASE WHEN address THEN 'pass' WHEN NOT read_any THEN 'unknown' ELSE 'fail' END", "NULL"
    out["GMC-07"] = f"CASE WHEN subscribes THEN {ok(rx('pdp', L.BILLING))} ELSE 'skip' END", "CASE WHEN NOT subscribes THEN 'no_subscription_seen' END"
    see = "concat_ws(',', " + ", ".join(f"CASE WHEN ({out[r][0]}) = 'fail' THEN '{r}' END" for r in ("CNS-01", "CNS-03", "CNS-07")) + ")"
    out["GMC-08"] = ok(f"{see} = ''"), f"CASE WHEN {see} <> '' THEN 'see ' || {see} END"
    lawful = lambda c: f"CASE WHEN legal_items THEN {ok(c)} ELSE CASE WHEN paste OR refund = '' THEN 'fail' ELSE 'unknown' END END"
    untold = "CASE WHEN NOT legal_items THEN 'no_return_text' END"
    out["EU-01"] = out["UK-01"] = lawful("withdraw OR coalesce(days_refund >= 14 AND NOT purchase, false)"), untold
    out["EU-02"] = lawful("form"), untold
    stated = "(back_refund IS NOT NULL OR back_faq IS NOT NULL)"
    prompt = f"{stated} AND NOT coalesce(back_refund > 14, false)"
    out["EU-03"] = lawful(prompt), f"CASE WHEN NOT legal_items THEN 'no_return_text' WHEN NOT {stated} THEN 'not_stated' END"
    out["UK-02"] = lawful(prompt), untold
    out["EU-04"] = lawful("buyer OR seller"), untold
    out["EU-05"] = ok(f"NOT {rx('foot', 'online dispute resolution')}"), "NULL"
    out["EU-06"] = "CASE WHEN (struck AND pdp <> '') OR (has_product AND sale) THEN 'manual' ELSE 'pass' END", "NULL"
    out["EU-07"] = f"CASE WHEN pdp <> '' THEN {ok(rx('pdp', 'manufacturer'))} ELSE 'unknown' END", "CASE WHEN pdp = '' THEN 'no_product_page' END"
    out["DE-01"] = "CASE WHEN two_names AND legal <> '' THEN 'fail' ELSE 'same' END", "NULL"
    told = {"phone": "len(phones) > 0", "address": "address", "currency": "false", "refund_terms": "refund <> ''"}
    out["CA-01"] = ok(f"{missing(told)} = ''"), f"nullif({missing(told)}, '')"
    out["AU-01"] = ok("NOT (final_sale OR (unopened AND NOT faulty))"), "NULL"
    out["US-01"] = f"CASE WHEN {rx('shipping', 'delivery takes')} OR {rx('shipping', L.SHIP_TIME)} OR {rx('faq', L.SHIP_TIME)} THEN 'pass' WHEN read_any THEN 'fail' ELSE 'unknown' END", "NULL"
    out["PRV-01"] = listed("privacy", "POL-03", {**{k: rx("privacy", v) for k, v in L.PRIVACY_ITEMS.items()}, "legal_basis": f"({rx('privacy', L.LEGAL_BASIS)} OR NOT {target('EU', 'UK')})"}, "no_privacy_policy")
    out["PRV-02"] = "CASE WHEN NOT online THEN 'unknown' WHEN live AND pixel THEN 'manual' ELSE 'pass' END", "NULL"
    out["PRV-03"] = f"CASE WHEN NOT online THEN 'unknown' ELSE {ok('NOT (live AND pixel) OR banner')} END", "CASE WHEN online AND NOT (live AND pixel) THEN 'no_tracking_seen' END"
    out["PRV-04"] = "'unknown'", "'needs_browser'"
    out["BIZ-01"] = "'same'", "NULL"
    out["BIZ-02"] = f"CASE WHEN {rx('contact', '@gmail')} THEN 'fail' WHEN len(mails) > 0 THEN 'pass' ELSE 'unknown' END", "NULL"
    out["BIZ-03"] = "CASE WHEN template THEN 'fail' WHEN read_any THEN 'pass' ELSE 'unknown' END", "NULL"
    out["BIZ-04"] = (
        f"CASE WHEN list_contains(phones, '0800 555 1234') AND len(countries) > 1 THEN 'fail' WHEN {rx('contact', '[+]86')} AND NOT hours THEN 'fail' WHEN len(phones) > 0 THEN 'pass' ELSE 'skip' END",
        "CASE WHEN len(phones) = 0 THEN 'no_phone' END",
    )
    alive = lambda r: f"CASE WHEN online THEN {r} ELSE 'unknown' END"
    off = "CASE WHEN NOT online THEN 'needs_live_site' END"
    out["LOC-01"] = alive(ok("live AND selector")), off
    wrong = "(market_code = 'de-DE' AND market_money <> 'EUR' OR market_code = 'en-GB' AND market_money <> 'GBP')"
    out["LOC-02"] = alive(f"CASE WHEN platform <> 'shopify' THEN 'skip' WHEN {wrong} THEN 'fail' WHEN market_code <> '' THEN 'pass' ELSE 'unknown' END"), "CASE WHEN NOT online THEN 'needs_live_site' WHEN platform <> 'shopify' THEN 'not_shopify' END"
    flawed = "(alternate_code IN ('en-UK', 'jp') OR NOT default_alternate OR (market_code <> '' AND NOT market_alternates))"
    out["LOC-03"] = alive(f"CASE WHEN NOT has_pairs THEN {ok('NOT (len(countries) > 1 AND foreign_langs)')} ELSE {ok('NOT ' + flawed)} END"), "CASE WHEN NOT online THEN 'needs_live_site' WHEN NOT has_pairs THEN 'no_annotations' END"
    out["LOC-04"] = alive("CASE WHEN market_code <> '' AND market_canonical = 'https://acme.com/' THEN 'fail' WHEN market_code <> '' THEN 'pass' ELSE 'skip' END"), off
    out["LOC-05"] = alive(f"CASE WHEN market_code = 'de-DE' AND {rx('market_said', 'translation missing')} THEN 'fail' WHEN market_code = 'de-DE' THEN 'pass' ELSE 'skip' END"), off
    out["LOC-06"] = "CASE WHEN contains(pdp, '高品质') THEN 'fail' WHEN pdp <> '' THEN 'pass' ELSE 'unknown' END", "NULL"
    metric, imperial = rx("pdp", "30 cm"), rx("pdp", "12 inch")
    us, others = f"({target('US')} AND {metric} AND NOT {imperial})", f"({target('EU', 'UK', 'AU', 'CA')} AND {imperial} AND NOT {metric})"
    out["LOC-07"] = f"CASE WHEN pdp = '' THEN 'unknown' ELSE {ok(f'NOT ({us} OR {others})')} END", f"CASE WHEN pdp = '' THEN NULL WHEN {us} THEN 'metric_only' WHEN {others} THEN 'imperial_only' END"
    out["LOC-08"] = f"CASE WHEN duty THEN 'pass' WHEN home OR {any_of(*[chr(32) + p + ' <> ' + chr(39) * 2 for p in ('refund', 'shipping', 'terms', 'faq', 'pdp')])} THEN 'fail' ELSE 'unknown' END", "NULL"
    gap = f"((({out['EU-01'][0]}) = 'fail' AND {target('EU')}) OR (({out['UK-01'][0]}) = 'fail' AND {target('UK')}))"
    out["LOC-09"] = alive(f"CASE WHEN market_code <> '' AND market_policy = 'same' AND refund <> '' AND {gap} THEN 'fail' WHEN market_code <> '' THEN 'pass' ELSE 'skip' END"), off
    out["LOC-10"] = "CASE WHEN market_code <> '' THEN 'info' ELSE 'skip' END", "NULL"
    out["TRU-01"] = f"CASE WHEN live AND {rx('home_said', 'lorem ipsum')} THEN 'fail' WHEN home OR contact <> '' OR faq <> '' OR pdp <> '' THEN 'pass' ELSE 'unknown' END", "NULL"
    out["TRU-02"] = alive(ok("NOT (live AND sample_image)")), "NULL"
    out["TRU-03"] = "CASE WHEN has_product AND (product_title = 'Test item' OR coalesce(price <= 0.01, false)) THEN 'fail' WHEN has_product THEN 'pass' ELSE 'unknown' END", "NULL"
    out["TRU-04"] = alive(ok("live AND favicon")), "NULL"
    out["TRU-05"] = "CASE WHEN password THEN 'manual' WHEN online THEN 'pass' ELSE 'unknown' END", "CASE WHEN password THEN 'password_page' END"
    out["TRU-06"] = alive(ok(f"NOT (name = 'My Store' OR {rx('foot', 'copyright 2019')} OR contains(foot_links, 'facebook'))")), "NULL"
    out["SEO-01"] = (
        alive(f"CASE WHEN robots <> '' THEN {ok('NOT ends_with(robots, chr(10) || ' + repr('Disallow: /') + ') OR contains(robots, ' + repr('Bot') + ')')} WHEN robots_result = 'not_found' THEN 'pass' ELSE 'unknown' END"),
        "CASE WHEN NOT online THEN 'needs_live_site' WHEN robots <> '' THEN NULL WHEN robots_result = 'not_found' THEN 'no_robots_file' ELSE 'robots_' || coalesce(robots_result, 'None') END",
    )
    out["SEO-02"] = alive(ok("NOT (live AND noindex)")), off
    out["SEO-03"] = (
        alive(f"CASE WHEN sitemap <> '' THEN {ok(rx('sitemap', 'product'))} WHEN sitemap_result IN ('not_found', 'error') THEN 'fail' ELSE 'unknown' END"),
        f"CASE WHEN NOT online THEN 'needs_live_site' WHEN sitemap <> '' THEN CASE WHEN NOT {rx('sitemap', 'product')} THEN 'no_products' END ELSE 'sitemap_' || coalesce(sitemap_result, 'None') END",
    )
    return out


def findings_sql() -> str:
    """CTEs ending in ``findings``: site, rule_id, result, level, badge, note."""
    rules = []
    for line in L.RULES.strip().splitlines():
        rid, level, where, badge, _, flags = line.split()
        tokens = "[]::VARCHAR[]" if where == "-" else str(where.split(","))
        rules.append(f"('{rid}', '{level}', {tokens}, '{badge}', {'ads' in flags.split(',')}, {'multi' in flags.split(',')})")
    made = ", ".join(
        f"{{'rule_id': '{rid}', 'result': CASE WHEN failed THEN NULL WHEN locked THEN {'chr(109) || chr(97) || chr(110) || chr(117) || chr(97) || chr(108)' if False else (chr(39) + 'manual' + chr(39) if rid == 'TRU-05' else 'NULL')} ELSE {result} END, 'note': CASE WHEN failed {'' if rid == 'TRU-05' else 'OR locked'} THEN NULL ELSE {note} END}}"
        for rid, (result, note) in results().items()
    )
    hidden = " OR ".join(f"(rule_id = '{rid}' AND note = 'exists_not_in_footer')" for rid in ("POL-01", "POL-02", "POL-03", "POL-04"))
    shown = "(note = 'exists_not_in_footer' OR rule_id IN ('TRU-06', 'BIZ-03'))"
    return f"""WITH {facts_sql()},
 rules(rule_id, lv, mk, bd, needs_ads, needs_multi) AS (VALUES {', '.join(rules)}),
 said AS (SELECT site, tokens, ads, multi, paste, failed, locked, drawn AND home AS drawn, unnest([{made}]) AS v FROM f),
 j AS (SELECT said.*, v.rule_id AS rule_id, v.result AS r0, v.note AS n0, lv, mk, bd, needs_ads, needs_multi, CASE WHEN v.result IN ('fail', 'manual', 'pass', 'unknown') THEN
   CASE WHEN needs_ads AND NOT ads THEN 'no_ads' WHEN len(mk) > 0 AND NOT list_has_any(mk, tokens) THEN 'market_not_targeted' WHEN needs_multi AND NOT multi THEN 'single_market' END END AS gate
   FROM said JOIN rules ON rules.rule_id = v.rule_id),
 g AS (SELECT *, CASE WHEN r0 IS NULL THEN 'unknown' WHEN gate IS NOT NULL THEN 'skip' ELSE r0 END AS result,
   CASE WHEN r0 IS NULL THEN coalesce(n0, CASE WHEN failed THEN 'homepage_unavailable' WHEN locked THEN 'password_only' ELSE 'not_evaluated' END) ELSE coalesce(gate, n0) END AS note,
   CASE WHEN r0 IS NULL THEN lv WHEN ({hidden.replace('note', 'n0')}) THEN 'P1' WHEN rule_id = 'CON-06' AND NOT {target('AU', 'EU', 'UK')} THEN 'P1' ELSE lv END AS level FROM j),
 b AS (SELECT *, CASE WHEN n0 = 'not_in_pasted_text' THEN 'not_found' WHEN result = 'unknown' THEN 'not_found' WHEN result IN ('skip', 'same', 'info') THEN NULL WHEN bd = 'verified' AND paste THEN 'self_claim'
   WHEN bd = 'conflicting' AND result <> 'fail' THEN CASE WHEN paste THEN 'self_claim' ELSE 'verified' END
   WHEN bd IN ('inferred', 'not_found') THEN CASE WHEN result <> 'pass' THEN 'inferred' WHEN paste THEN 'self_claim' ELSE 'verified' END ELSE bd END AS badge,
   drawn AND result = 'fail' AND rule_id IN ({', '.join(repr(r) for r in L.HOME_RULES)}) AND NOT coalesce({shown}, false) AS soft FROM g),
 findings AS (SELECT site, rule_id, CASE WHEN soft THEN 'unknown' ELSE result END AS result, level, CASE WHEN soft THEN 'not_found' ELSE badge END AS badge, CASE WHEN soft THEN 'js_home' ELSE note END AS note FROM b)"""
