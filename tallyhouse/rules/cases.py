"""Made-up stores on the driver's tables, for the registered queries.

Each piece of a store (a policy, a header, a price list) is an SQL expression over
``customer`` that Spark and DuckDB read alike; pages are put together from the
pieces. The engine gets the pages, the SQL of the queries works on the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = "c_custkey"


def when(multiplier: int, modulus: int, below: int, yes: str, no: str = "''") -> str:
    """``yes`` for a share below/modulus of the stores, spread by the multiplier."""
    return f"CASE WHEN ({K} * {multiplier}) % {modulus} < {below} THEN {yes} ELSE {no} END"


def pick(modulus: int, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {K} % {modulus} {cases} ELSE {values[-1]} END"


def join(*parts: str) -> str:
    return " || ".join(f"({p})" for p in parts)


FILLER = "'" + "Please read this page with care before you place an order in this store. " * 4 + "'"

PIECES = {
    "site": K,
    "mode": pick(11, "'paste'", "'manual'", "'online'"),
    "password": f"{K} % 29 = 0",
    "https_redirect": pick(7, "false", "NULL", "true"),
    "user_markets": pick(9, "'US'", "'US, UK, de'", "'EU'", "NULL", "'AU and Canada'", "'France'", "'UK'", "'CA/DE'", "NULL"),
    "ads": f"{K} % 9 <> 0",
    "currency": pick(3, "'USD'", "'EUR'", "'CNY'"),
    "name": pick(13, "'My Store'", f"'Acme ' || CAST({K} AS VARCHAR(20))"),
    # home page
    "home": f"{K} % 31 <> 0",
    "lang": pick(5, "'de'", "'en-US'", "'en'", "'fr'", "'en'"),
    "title": pick(13, "'My Store'", "'Acme lamps'"),
    "favicon": f"{K} % 4 <> 0",
    "noindex": f"{K} % 17 = 0",
    "marker": f"{K} % 6 <> 0",
    "pixel": f"({K} * 3) % 5 < 3",
    "banner": f"({K} * 7) % 4 < 2",
    "selector": f"({K} * 5) % 3 = 0",
    "sample_image": f"{K} % 14 = 0",
    "drawn": f"{K} % 37 = 0",
    "alternates": f"{K} % 3 <> 0",
    "alternate_code": pick(4, "'de-DE'", "'en-UK'", "'jp'", "'fr-FR'"),
    "default_alternate": f"{K} % 5 <> 0",
    "bar": when(3, 7, 3, join("'Free shipping on orders over $'", pick(3, "'50'", "'75'", "'75'"), "'. '")),
    "home_said": join("'Warm lamps for the living room and the kitchen, made by hand and sent to you. Every lamp is checked twice before it leaves our small workshop by the sea. '", when(11, 13, 1, "'Lorem ipsum dolor. '"), when(5, 19, 2, "'Visit our shop at www.example.com today. '")),
    "footer_links": join(
        when(1, 5, 4, """'<a href="/policies/refund-policy">Refund policy</a> '"""), when(3, 7, 6, """'<a href="/policies/shipping-policy">Shipping</a> '"""),
        when(5, 8, 7, """'<a href="/policies/privacy-policy">Privacy</a> '"""), when(7, 9, 8, """'<a href="/policies/terms-of-service">Terms</a> '"""),
        when(11, 6, 3, """'<a href="/pages/impressum">Impressum</a> '"""), when(13, 5, 3, """'<a href="/pages/contact">Contact</a> '"""), when(17, 9, 1, """'<a href="https://www.facebook.com/">Follow</a> '"""),
    ),
    "footer_said": join(pick(6, "'Copyright 2019 Acme. '", "'Copyright 2026 Acme. '"), when(7, 11, 3, "'Write to help@acme.com or call +49 30 1234 5678. '"), when(9, 10, 2, "'Call 0800 555 1234 5. '"), when(5, 12, 1, "'We support online dispute resolution. '")),
    # policies
    "refund": f"CASE WHEN {K} % 10 = 0 THEN '' ELSE " + join(
        "'You can return items within '", pick(4, "'30'", "'14'", "'60'", "'30'"), pick(6, "' days of purchase. '", "' days of delivery. '"), when(3, 5, 3, "'Items must be unused and in original packaging. '"),
        when(7, 5, 4, "'Contact us by message to start the process. '"), when(11, 5, 3, join("'Refunds are processed within '", pick(3, "'20'", "'10'", "'10'"), "' days. '")), when(13, 7, 1, "'All sales are final. '"),
        when(17, 5, 1, "'Damaged goods are always covered. '"), when(19, 4, 1, "'The customer is responsible for return shipping. '"), when(23, 6, 1, "'A 15% restocking fee applies. '"), when(29, 9, 2, "'Send the goods to our warehouse in Shenzhen. '"),
        when(31, 8, 1, "'[Insert your company] '"), when(37, 5, 2, "'A model withdrawal form is attached. '"), when(41, 6, 2, FILLER), when(43, 7, 2, "'Amounts are in RMB. '"), when(47, 9, 1, "'Only unopened boxes count. '"), when(53, 8, 2, "'Sold by Acme Trading Ltd. '"),
    ) + " END",
    "shipping": f"CASE WHEN {K} % 9 = 0 THEN '' ELSE " + join(
        when(3, 5, 4, "'Orders are prepared in our warehouse. '"), when(7, 4, 3, join("'Delivery takes '", pick(3, "'5-8'", "'10-20'", "'5-8'"), "' days. '")), when(11, 5, 4, "'The rate is shown at the end. '"), when(13, 3, 2, "'You get a tracking number. '"),
        when(17, 2, 1, "'Free shipping on orders over $50. '"), when(19, 4, 1, "'Customs and taxes are on you. '"), FILLER,
    ) + " END",
    "privacy": f"CASE WHEN {K} % 8 = 0 THEN '' ELSE " + join(
        "'Questions go to our contact form. '", when(3, 4, 3, "'The purpose is to send your order. '"), when(7, 5, 4, "'We share it with carriers. '"), when(11, 6, 5, "'It may leave for other countries. '"), when(13, 5, 4, "'We retain it for two years. '"),
        when(17, 5, 4, "'You have the right to see it. '"), when(19, 3, 2, "'The legal basis is our order. '"), FILLER,
    ) + " END",
    "terms": f"CASE WHEN {K} % 7 = 0 THEN '' ELSE " + join("'These words hold for every order. '", when(3, 11, 1, "'No refunds. '"), FILLER) + " END",
    "legal": f"CASE WHEN {K} % 5 = 0 THEN " + join("'Acme, Lange Gasse in '", when(3, 4, 3, "'10115 '"), "'Berlin. '", when(7, 3, 2, "'mail@acme.com '"), FILLER) + " ELSE '' END",
    "subscription": f"CASE WHEN {K} % 28 = 0 THEN 'We bill once a month. ' ELSE '' END",
    "robots": pick(8, "'User-agent: *' || chr(10) || 'Disallow: /'", "'User-agent: Bot' || chr(10) || 'Disallow: /'", "'User-agent: *' || chr(10) || 'Disallow: /cart'", "''"),
    "robots_result": pick(8, "'ok'", "'ok'", "'ok'", "'not_found'", "'blocked'", "NULL", "'not_found'"),
    "sitemap": pick(6, "'<loc>https://a.com/products/lamp</loc>'", "'<loc>https://a.com/pages/about</loc>'", "''"),
    "sitemap_result": pick(6, "'ok'", "'ok'", "'not_found'", "'blocked'", "NULL"),
    # other pages
    "contact": f"CASE WHEN {K} % 6 = 1 THEN '' ELSE " + join("'Reach us any day. '", pick(5, "'lamp@gmail.com '", "'hello@acme.com '", "''", "'hello@acme.com '", "''"), pick(4, "'12 High Street '", "''"), when(3, 8, 2, "'Phone +86 755 1234 5678. '"), when(5, 6, 1, "'Office hours are nine to five. '"), when(53, 16, 1, "'Sold by Zeta Goods Ltd. '")) + " END",
    "faq": f"CASE WHEN {K} % 10 = 3 THEN '' ELSE " + join("'You can return items within '", pick(12, "'30'", "'14'", "'60'", "'30'", "'30'", "'14'", "'90'", "'30'", "'30'", "'14'", "'60'", "'45'"), "' days of delivery. '", when(7, 6, 1, "'Free returns. '"), when(11, 9, 1, "'There is no restocking fee. '"), when(13, 8, 1, "'Refunds are processed within 10 days. '")) + " END",
    "pdp": f"CASE WHEN {K} % 12 = 5 THEN '' ELSE " + join("'A lamp of oak. '", when(3, 4, 2, "'Tax included. '"), when(7, 5, 2, "'Height 30 cm. '"), when(11, 7, 2, "'Width 12 inch. '"), when(13, 6, 1, "'The manufacturer is Acme. '"), when(17, 9, 1, "'高品质台灯 '"), when(19, 15, 1, "'Subscribe and save. '"), when(23, 3, 1, "'Billed monthly. '"), when(29, 4, 1, "'Returns are simple. '")) + " END",
    "cart": f"{K} % 8 <> 3",
    "struck": f"{K} % 7 = 2",
    # a market version
    "market_code": pick(5, "'de-DE'", "'en-GB'", "''"),
    "market_money": pick(3, "'EUR'", "'USD'", "'GBP'"),
    "market_said": join("'Warme Lampen aus Eiche. '", when(3, 10, 2, "'Translation missing: de.cart. '")),
    "market_canonical": pick(7, "'https://acme.com/'", "''", "'https://acme.com/m/'"),
    "market_alternates": f"{K} % 10 < 7",
    "market_policy": pick(4, "'same'", "'Eigene Regeln.'", "''", "'same'"),
    # products
    "product_title": pick(12, "'Test item'", "'Lamp'"),
    "price": f"CASE WHEN {K} % 15 = 0 THEN 0.0 WHEN {K} % 4 = 0 THEN NULL ELSE 20.0 END",
    "stocked": f"{K} % 5 <> 0",
    "plan": f"{K} % 14 = 0",
    "sale": f"{K} % 3 = 0",
    "has_product": f"{K} % 4 <> 2",
}


def pieces(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(*[f"{sql.replace('VARCHAR(20)', 'STRING')} AS {name}" for name, sql in PIECES.items()])


def pieces_sql() -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in PIECES.items()) + " FROM customer"


HOME_URL = "https://acme.com/"


def home_html() -> str:
    alternate = f"""'<link rel="alternate" hreflang="en" href="{HOME_URL}"><link rel="alternate" hreflang="' || alternate_code || '" href="{HOME_URL}m/">' ||
      CASE WHEN default_alternate THEN '<link rel="alternate" hreflang="x-default" href="{HOME_URL}">' ELSE '' END"""
    head = f"""'<html lang="' || lang || '"><head><title>' || title || '</title>' || CASE WHEN favicon THEN '<link rel="icon" href="/f.png">' ELSE '' END ||
      CASE WHEN noindex THEN '<meta name="robots" content="noindex">' ELSE '' END || CASE WHEN marker THEN '<script src="//cdn.shopify.com/a.js"></script>' ELSE '' END ||
      CASE WHEN pixel THEN '<script>fbq(1)</script>' ELSE '' END || CASE WHEN banner THEN '<script src="onetrust.js"></script>' ELSE '' END ||
      CASE WHEN alternates THEN {alternate} ELSE '' END || '</head><body>'"""
    body = """'<header>' || CASE WHEN bar <> '' THEN '<div class="announcement">' || bar || '</div>' ELSE '' END || CASE WHEN selector THEN '<div class="country-selector"></div>' ELSE '' END || '</header><main><p>' ||
      home_said || '</p>' || CASE WHEN sample_image THEN '<img src="/placeholder.png">' ELSE '' END || '</main><footer>' || footer_links || '<p>' || footer_said || '</p></footer></body></html>'"""
    shell = """'<html><head><script></script><script></script><script></script></head><body><div id="root"></div></body></html>'"""
    return f"CASE WHEN NOT home THEN NULL WHEN drawn THEN {shell} ELSE {head} || {body} END"


def stores(customer: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sites, pages, products of the made-up stores."""
    p = pieces(customer).selectExpr("*", f"{home_html()} AS home_html")
    sites = p.selectExpr("site", "mode", "CAST(NULL AS STRING) AS platform", "password", "https_redirect", "user_markets", "ads", "currency", "name", "DATE '2026-11-01' AS today")
    page = lambda role, name, url, text="NULL", html="NULL", result="'ok'": (
        f"struct('{role}' AS role, {name} AS name, {url} AS url, CAST({result} AS STRING) AS result, CAST({html} AS STRING) AS html, CAST({text} AS STRING) AS text)"
    )
    policy = lambda n, piece: page("policy", f"'{n}'", f"'{HOME_URL}policies/{n}'", f"nullif({piece}, '')", result=f"CASE WHEN {piece} = '' THEN 'not_found' ELSE 'ok' END")
    pdp = """'<html lang="en"><body><main><p>' || pdp || '</p>' || CASE WHEN struck THEN '<s class="was-price">9</s>' ELSE '' END || CASE WHEN cart THEN '<button name="add">Go</button>' ELSE '' END || '</main></body></html>'"""
    market = f"""'<html><head>' || CASE WHEN market_canonical <> '' THEN '<link rel="canonical" href="' || market_canonical || '">' ELSE '' END ||
      CASE WHEN market_alternates THEN '<link rel="alternate" hreflang="de" href="{HOME_URL}m/"><link rel="alternate" hreflang="x-default" href="{HOME_URL}">' ELSE '' END ||
      '<script>Shopify.currency = {{"active":"' || market_money || '"}};</script></head><body><main>' || market_said || '</main></body></html>'"""
    made = [
        page("home", "'home'", f"'{HOME_URL}'", html="home_html"), policy("refund-policy", "refund"), policy("shipping-policy", "shipping"), policy("privacy-policy", "privacy"), policy("terms-of-service", "terms"),
        policy("legal-notice", "legal"), policy("subscription-policy", "subscription"), page("page", "'contact'", f"'{HOME_URL}pages/contact'", "nullif(contact, '')"), page("page", "'faq'", f"'{HOME_URL}pages/faq'", "nullif(faq, '')"),
        page("pdp", "'lamp'", f"'{HOME_URL}products/lamp'", html=f"CASE WHEN pdp <> '' THEN {pdp} END"), page("robots", "'robots'", f"'{HOME_URL}robots.txt'", "nullif(robots, '')", result="robots_result"),
        page("sitemap", "'sitemap'", f"'{HOME_URL}sitemap.xml'", "nullif(sitemap, '')", result="sitemap_result"), page("market_home", "market_code", f"'{HOME_URL}m/'", html=f"CASE WHEN market_code <> '' THEN {market} END"),
        page("market_policy", "market_code", f"'{HOME_URL}m/policies/refund-policy'", "CASE WHEN market_code <> '' THEN nullif(CASE WHEN market_policy = 'same' THEN refund ELSE market_policy END, '') END"),
    ]
    pages = p.selectExpr("site", f"posexplode(array({', '.join(made)})) AS (pos, x)").select("site", "pos", "x.*").where("html is not null or text is not null or role in ('policy', 'robots', 'sitemap')")
    products = p.where("has_product").selectExpr("site", "'lamp' AS handle", "product_title AS title", "'Lighting' AS product_type", "'' AS tags", "CAST(price AS DOUBLE) AS price", "stocked AS in_stock", "false AS virtual", "plan AS has_plan", "sale AS on_sale")
    return sites, pages, products.withColumn("price", F.col("price"))


# -- payments: pages and answers ----------------------------------------------

PAY_PIECES = {
    "site": K,
    "run": pick(23, "'offline'", "'online'"),
    "home_result": pick(19, "'blocked'", "'error'", "'ok'"),
    "scheme": pick(8, "'http'", "'https'"),
    "note": pick(19, "''", "'certificate verify failed'", "''"),
    "n_markers": pick(5, "0", "1", "2"),
    "icons": join(when(3, 4, 2, "'<svg id=\"pi-visa\"></svg>'"), when(5, 3, 1, "'<svg id=\"pi-paypal\"></svg>'"), when(7, 6, 1, "'<svg id=\"pi-shopify_pay\"></svg>'"), when(11, 7, 1, "'<svg id=\"pi-american_express\"></svg>'")),
    "stripe_js": f"({K} * 7) % 5 < 2",
    "klarna_js": f"({K} * 11) % 6 < 2",
    "chat_js": f"({K} * 13) % 4 = 0",
    "recharge_js": f"({K} * 17) % 7 = 0",
    "converter_js": f"({K} * 19) % 9 = 0",
    "selector": f"({K} * 3) % 4 = 0",
    "shown": pick(4, "'EUR'", "'USD'", "''"),
    "home_said": join("'Lamps of oak, made with care. '", when(5, 4, 2, "'20% off with code SUN. '"), when(7, 6, 2, "'Terms apply. '"), when(3, 7, 2, "'Secure checkout. '"), when(11, 5, 1, "'30-day returns. '"), when(13, 6, 1, "'Free returns. '"), when(17, 8, 3, "'help@acme.com '"), when(19, 6, 1, "'Phone +1 212 555 0199 '")),
    "brand": pick(3, "'Acme'", "'Zeta'", "'Acme'"),
    "cart_result": pick(7, "'not_found'", "'blocked'", "'ok'"),
    "cart_html": pick(3, "'<form action=\"/checkout\"></form>'", "'<p>Your cart is empty</p>'", "'<p>Hello</p>'"),
    "refund": PIECES["refund"].replace("' days of delivery. '", "' days of delivery for a full return. '"),
    "shipping": PIECES["shipping"].replace("'You get a tracking number. '", "'We ship to all countries. '").replace("'Delivery takes '", "'Transit takes '"),
    "privacy": PIECES["privacy"].replace("'We share it with carriers. '", "'Payment details go to the payment processor. '"),
    "terms": PIECES["terms"].replace("'No refunds. '", "'You may cancel. '"),
    "terms_drawn": f"{K} % 41 = 1",
    "information": f"CASE WHEN {K} % 6 = 0 THEN '' ELSE " + join(when(5, 3, 2, "'Acme Trading Ltd. '"), when(7, 4, 2, "'12 High Street '"), FILLER) + " END",
    "contact": f"CASE WHEN {K} % 5 = 2 THEN '' ELSE " + join("'Say hello. '", when(3, 7, 2, "'Zeta Goods Ltd. '"), when(11, 4, 1, "'hello@acme.com '")) + " END",
    "faq": f"CASE WHEN {K} % 4 = 3 THEN '' ELSE " + join("'Questions and answers. '", when(5, 6, 1, "'It appears on your statement as ACME. '"), when(3, 5, 1, "'Returns within 45 days. '")) + " END",
    "product": f"CASE WHEN {K} % 9 = 4 THEN '' ELSE " + join("'A lamp. '", when(3, 4, 3, "'$ 20 '"), when(5, 3, 1, "'USD '"), when(7, 8, 1, "'Pre-order now. '"), when(11, 9, 1, "'14-day money back. '")) + " END",
    "express": f"({K} * 5) % 4 = 1",
    "ships_to": pick(5, "'US'", "'US,CA,AU'", "''", "'US,GB'", "''"),
    "base_currency": pick(4, "'USD'", "'EUR'", "'USD'", "''"),
    "meta_country": pick(4, "'US'", "'CN'", "'GB'", "''"),
    "description": pick(6, "80", "400"),
    "images": pick(5, "1", "4"),
    # answers
    "answered": f"{K} % 12 <> 7",
    "entity_country": pick(7, "'China'", "'us llc'", "'hong kong'", "'UK'", "''", "'CN'", "'Canada'"),
    "payout_account": pick(9, "'worldfirst'", "'mercury'", "'none'", "''", "'bank'", "'Payoneer'", "'us bank'", "'unknown'", "'mercury'"),
    "payout_currency": pick(5, "'USD'", "'CNY'", "''"),
    "routes": pick(8, "'paypal:100'", "'sp:60;paypal:40'", "'stripe:70;paypal:30'", "'card:100:3.5+0.30:35'", "''", "'stripe:50;paypal:50;manual:100'", "'shopify:100'", "'paypal:100:4.0'"),
    "mix": pick(6, "'US:70,CA:30'", "'DE:50,UK:50'", "''", "'US:100'", "'US:60,GB:40'", "'AU'"),
    "category": pick(6, "'lamps'", "'CBD oil'", "''", "'kitchen knives'"),
    "mor": pick(4, "'no'", "''", "'stripe_managed_payments'"),
    "subscription": pick(8, "'yes'", "''"),
    "preorder": pick(10, "'是'", "'no'", "''"),
    "plan": pick(6, "'basic'", "'Shopify'", "'advanced'", "''", "'none'", "'plus'"),
    "aov": pick(9, "0", "45.50", "80.00", "120.25"),
    "aov_currency": pick(5, "'CAD'", "'USD'", "''"),
    "orders": pick(11, "NULL", "100", "2400", "350"),
    "intl": pick(4, "'30%'", "''"),
    "fx": pick(6, "'12'", "''"),
    "withdrawals": pick(3, "2", "NULL"),
    "dispute": pick(5, "0.5", "NULL"),
    "payout_fx": pick(4, "1.2", "NULL"),
}


def pay_pieces(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(*[f"{sql.replace('VARCHAR(20)', 'STRING')} AS {name}" for name, sql in PAY_PIECES.items()])


def pay_pieces_sql() -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in PAY_PIECES.items()) + " FROM customer"


def pay_stores(customer: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """stores, pages, products and raw answers of the made-up stores."""
    p = pay_pieces(customer)
    script = lambda flag, url: f"CASE WHEN {flag} THEN '<script src=\"{url}\"></script>' ELSE '' END"
    home = f"""'<html><head><title>Lamps | ' || brand || '</title>' || CASE WHEN n_markers > 0 THEN '<link href="//cdn.shopify.com/x">' ELSE '' END || CASE WHEN n_markers > 1 THEN '<script>Shopify.theme = 1</script>' ELSE '' END ||
      {script('stripe_js', 'https://js.stripe.com/v3')} || {script('klarna_js', 'https://x.klarna.com/a.js')} || {script('chat_js', 'https://code.tidio.co/a.js')} || {script('recharge_js', 'https://rechargecdn.com/a.js')} ||
      {script('converter_js', 'https://mlveda.com/a.js')} || CASE WHEN shown <> '' THEN '<script>Shopify.currency = {{"active":"' || shown || '"}};</script>' ELSE '' END || '</head><body>' ||
      CASE WHEN selector THEN '<form id="localization_form"></form>' ELSE '' END || '<p>' || home_said || '</p>' || icons || '</body></html>'"""
    stores = p.selectExpr(
        "site", "run AS mode", "home_result", "scheme || '://acme.com/' AS home_url", "note AS home_note", "'ok' AS meta_result", "'ok' AS products_result", "CAST(NULL AS STRING) AS meta_name", "nullif(meta_country, '') AS meta_country",
        "nullif(base_currency, '') AS base_currency", "CASE WHEN ships_to <> '' THEN split(ships_to, ',') END AS ships_to",
    )
    page = lambda role, name, text, result, html="NULL": f"struct('{role}' AS role, '{name}' AS name, CAST({result} AS STRING) AS result, CAST({html} AS STRING) AS html, CAST({text} AS STRING) AS text)"
    policy = lambda n, piece: page("policy", n, f"nullif({piece}, '')", f"CASE WHEN {piece} = '' THEN 'not_found' ELSE 'ok' END")
    drawn = page("policy", "terms-of-service", "CASE WHEN terms_drawn THEN NULL ELSE nullif(terms, '') END", "CASE WHEN terms_drawn THEN 'js_rendered' WHEN terms = '' THEN 'not_found' ELSE 'ok' END")
    made = [
        page("home", "home", "NULL", "home_result", f"CASE WHEN home_result = 'ok' THEN {home} END"), page("cart", "cart", "NULL", "cart_result", "CASE WHEN cart_result = 'ok' THEN cart_html END"), policy("refund-policy", "refund"), policy("shipping-policy", "shipping"),
        policy("privacy-policy", "privacy"), drawn, policy("contact-information", "information"), page("contact", "contact", "nullif(contact, '')", "'ok'"), page("faq", "faq", "nullif(faq, '')", "'ok'"),
        page("product", "lamp", "NULL", "'ok'", "CASE WHEN product <> '' THEN '<html><body><main>' || product || '</main>' || CASE WHEN express THEN '<div class=\"shopify-payment-button\"></div>' ELSE '' END || '</body></html>' END"),
    ]
    pages = p.selectExpr("site", f"posexplode(array({', '.join(made)})) AS (pos, x)").select("site", "pos", "x.*").where("html is not null or text is not null or role in ('home', 'cart', 'policy')")
    products = p.selectExpr("site", "explode(array(1, 2, 3)) AS k", "description", "images").selectExpr("site", "description + k AS desc_chars", "images AS n_images")
    answers = p.selectExpr("site", *[c for c in PAY_PIECES if c in ("answered", "entity_country", "payout_account", "payout_currency", "routes", "mix", "category", "mor", "subscription", "preorder", "plan", "aov", "aov_currency", "orders", "intl", "fx", "withdrawals", "dispute", "payout_fx")])
    return stores, pages, products, answers


def questionnaire(raw: DataFrame) -> DataFrame:
    """Typed answers of the made-up stores."""
    from ..functions import answers as A

    c = F.col
    asked = raw.where("answered").drop("answered")
    routes = F.array_compact(F.transform(F.split("routes", ";"), A.route))
    text = lambda name: F.when(~A.blank(c(name)), F.trim(c(name)))
    return asked.select(
        "site", A.choice("entity_country", c("entity_country")).alias("entity_country"), A.choice("payout_account", c("payout_account")).alias("payout_account"), text("payout_currency").alias("payout_currency"),
        routes.alias("gateways"), A.market_mix(c("mix")).alias("market_mix"), text("category").alias("category"), A.choice("mor", c("mor")).alias("mor"), A.yes_no(c("subscription")).alias("subscription"),
        A.yes_no(c("preorder")).alias("preorder"), A.choice("shopify_plan", c("plan")).alias("shopify_plan"), c("aov").cast("decimal(18,6)").alias("aov"), text("aov_currency").alias("aov_currency"), c("orders").cast("decimal(18,6)").alias("monthly_orders"),
        A.number("intl_card_share", c("intl")).alias("intl_card_share"), A.number("fx_share", c("fx")).alias("fx_share"), c("withdrawals").alias("withdrawals_per_month"), c("dispute").cast("decimal(18,6)").alias("dispute_rate"),
        c("payout_fx").cast("decimal(18,6)").alias("payout_fx_pct"),
    )


# -- tracking: pages, containers and proofs -------------------------------------

TAG_PIECES = {
    "site": K,
    "mode": pick(3, "'own'", "'other'", "'own'"),
    "home": f"{K} % 23 <> 0",
    "home_result": pick(17, "'blocked'", "'ok'"),
    "marks": pick(5, "0", "1", "2"),
    "wordpress": f"{K} % 10 = 5",
    "lang": pick(6, "'de'", "'en-us'", "'fr-ca'", "'en'", "'en'", "'ja'"),
    "money": pick(4, "'USD'", "'EUR'", "'CAD'", "''"),
    "meta_call": f"({K} * 3) % 5 < 2",
    "meta_id": pick(9, "'YOUR_PIXEL_ID'", "'12345'", "'10000000001'"),
    "meta_again": f"({K} * 7) % 6 = 0",
    "ga_script": f"({K} * 7) % 4 < 2",
    "ads_call": f"({K} * 11) % 5 = 0",
    "gtm": f"({K} * 13) % 4 = 1",
    "gtm_two": f"{K} % 7 = 3",
    "tiktok_list": f"({K} * 17) % 6 < 2",
    "klaviyo": f"({K} * 5) % 7 < 2",
    "pixel_list": f"{K} % 4 <> 3",
    "app_meta": f"({K} * 3) % 7 < 3",
    "app_google": f"({K} * 5) % 9 < 3",
    "custom_meta": f"({K} * 11) % 8 < 2",
    "legacy": f"{K} % 12 = 4",
    "container": f"({K} * 7) % 5 < 2",
    "consent": pick(5, "0", "1", "2", "0"),
    "banner": f"({K} * 3) % 8 < 2",
    "opt_out": f"({K} * 7) % 3 = 0",
    "has_product": f"{K} % 8 <> 2",
    "privacy": f"CASE WHEN {K} % 6 = 1 THEN '' ELSE " + join("'We care. '", when(3, 4, 3, "'Google and Facebook get data. '"), when(5, 3, 1, "'TikTok too. '"), when(7, 5, 3, "'For advertising; you may opt-out. '")) + " END",
    "ads": pick(5, "NULL", "'meta,tiktok'", "'google_ads'", "''", "'snap,meta'"),
    "uses_klaviyo": f"{K} % 2 = 0",
    "proof_a": pick(7, "'screenshot:true'", "'said:false'", "'said:'", "''"),
    "proof_c": pick(6, "'screenshot:true'", "''", "'said:true'", "''", "'screenshot:false'"),
    "proof_g": pick(4, "'said:true'", "''"),
}
META, GA, GT, ADS = "10000000001", "G-ABCD1234", "GT-XYZ98765", "AW-123456789"


def tag_pieces(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(*[f"{sql} AS {name}" for name, sql in TAG_PIECES.items()])


def tag_pieces_sql() -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in TAG_PIECES.items()) + " FROM customer"


def tag_stores(customer: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """sites, pages, containers, answers, proofs of the made-up stores."""
    p = tag_pieces(customer)
    entry = lambda flag, text: f"CASE WHEN {flag} THEN '{text},' ELSE '' END"
    listed = " || ".join([
        entry("app_meta", f'{{"configuration":"{{\\\\"pixel_id\\\\":\\\\"{META}\\\\",\\\\"pixel_type\\\\":\\\\"facebook_pixel\\\\"}}","type":"APP","apiClientId":2329312}}'),
        entry("app_google", f'{{"configuration":"{{\\\\"config\\\\":\\\\"{GA},{ADS},MC-ABCD12\\\\"}}","type":"APP","apiClientId":1780363}}'), entry("custom_meta", '{"name":"Facebook extra","type":"CUSTOM"}'),
    ])
    home = f"""'<html lang="' || lang || '"><head>' || CASE WHEN marks > 0 THEN '<link href="//cdn.shopify.com/x">' ELSE '' END || CASE WHEN marks > 1 THEN '<script>Shopify.theme = 1</script>' ELSE '' END || CASE WHEN wordpress THEN '<link href="/wp-content/a">' ELSE '' END ||
      CASE WHEN money <> '' THEN '<script>Shopify.currency = {{"active":"' || money || '"}};</script>' ELSE '' END ||
      CASE WHEN meta_call THEN '<script>fbq("init", "' || meta_id || '");</script>' || CASE WHEN meta_again THEN '<script>fbq("init", "' || meta_id || '");</script>' ELSE '' END ELSE '' END ||
      CASE WHEN ga_script THEN '<script src="https://www.googletagmanager.com/gtag/js?id={GA}"></script>' ELSE '' END || CASE WHEN ads_call THEN '<script>gtag("config", "{GT}");</script>' ELSE '' END ||
      CASE WHEN gtm THEN '<script>(window,document,"script","dataLayer","GTM-AAAA11");</script>' ELSE '' END || CASE WHEN gtm AND gtm_two THEN '<script src="https://www.googletagmanager.com/gtm.js?id=GTM-BBBB22"></script>' ELSE '' END ||
      CASE WHEN tiktok_list THEN '<p>{{"Tag":"https://analytics.tiktok.com/i18n/pixel/events.js"}}</p>' ELSE '' END ||
      CASE WHEN klaviyo THEN '<script async src="https://static.klaviyo.com/onsite/js/AbCd12/klaviyo.js?company_id=AbCd12"></script>' ELSE '' END ||
      CASE WHEN pixel_list THEN '<script>webPixelsConfigList: [' || {listed} || '{{"type":"APP","apiClientId":"shopify-pixel"}}]</script>' ELSE '' END || CASE WHEN legacy THEN '<script>ga("create", "UA-12345-1")</script>' ELSE '' END ||
      CASE WHEN consent = 1 THEN '<script>gtag("consent", "default", 1)</script>' WHEN consent = 2 THEN '<script>gtag("consent", "default", {{ad_user_data: 1}})</script>' ELSE '' END || CASE WHEN banner THEN '<script src="https://cdn.cookielaw.org/a.js"></script>' ELSE '' END ||
      CASE WHEN opt_out THEN '<a href="/x">Do not sell</a>' ELSE '' END || '</head><body>Lamps</body></html>'"""
    page = lambda key, text, result="'ok'": f"struct('{key}' AS key, CAST({result} AS STRING) AS result, CAST({text} AS STRING) AS html)"
    made = [page("homepage", f"CASE WHEN home THEN {home} END", "CASE WHEN home THEN home_result ELSE 'error' END"), page("product", "CASE WHEN has_product THEN '<html><body>A lamp</body></html>' END"), page("privacy", "CASE WHEN privacy <> '' THEN '<p>' || privacy || '</p>' END")]
    pages = p.selectExpr("site", f"explode(array({', '.join(made)})) AS x").select("site", "x.*")
    containers = p.where("container").selectExpr("site", "'GTM-AAAA11' AS container", f"'var a=[\"{GA}\"]; fbq(1);' AS text")
    answers = p.selectExpr("site", "CASE WHEN ads IS NOT NULL THEN filter(split(ads, ','), x -> x <> '') END AS ad_platforms", "uses_klaviyo")
    ids = f"CASE WHEN {{0}} LIKE 'screenshot%' THEN map('meta', array('{META}')) END"
    proof = lambda item, c: f"struct('{item}' AS item, nullif(split({c}, ':')[0], '') AS source, CASE WHEN {c} LIKE '%:true' THEN true WHEN {c} LIKE '%:false' THEN false END AS ok, {ids.format(c) if item == 'U1-c' else 'CAST(NULL AS map<string,array<string>>)'} AS ids)"
    proofs = p.selectExpr("site", f"explode(array({proof('U1-a', 'proof_a')}, {proof('U1-c', 'proof_c')}, {proof('U1-g', 'proof_g')})) AS x").select("site", "x.*").where("source is not null")
    return p.select("site", "mode"), pages, containers, answers, proofs
