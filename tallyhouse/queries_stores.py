"""Registered queries over made-up product pages, sources and store files.

As in ``rules.cases``: each piece is an SQL expression over a given table that Spark
and DuckDB read alike; the engine gets pages, the SQL works on the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalogue, fee_table, input_fields, links, product_pages, store_signals
from .queries import _t, dealt, query
from .sources import pasted

# -- product pages --------------------------------------------------------------

_N, _P, _H = "'Lamp ' || CAST(p_partkey AS VARCHAR(20))", "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR(20))", "'h' || CAST(p_partkey AS VARCHAR(20))"
_UP = lambda n: f"CAST(CAST(p_retailprice AS DECIMAL(12,2)) + {n} AS VARCHAR(20))"


def _sql(template: str) -> str:
    """A template with {name}, {price}, {handle}, {price+N} as an SQL text."""
    out = "'" + template.replace("'", "''") + "'"
    for mark, sql in (("{name}", _N), ("{price}", _P), ("{handle}", _H), *((f"{{price+{n}}}", _UP(n)) for n in (5, 7, 10, 20, 50))):
        out = out.replace(mark, f"' || ({sql}) || '")
    return out


def _ld(*documents: str) -> str:
    return "".join(f'<script type="application/ld+json">{d}</script>' for d in documents)


_ESCAPED = '{"@type":"Product","name":"{name}","offers":{"price":"{price}","availability":"LimitedAvailability"}}'.replace('"', "&quot;")
#: Pages by the part's number modulo their count.
PRODUCT_PAGES = (
    _ld('{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","name":"x"}]}', '{"@type":"Product","name":"{name}","offers":{"@type":"Offer","price":"{price}","priceCurrency":"usd","availability":"https://schema.org/InStock"}}'),
    _ld('{"@type":["Thing","http://schema.org/Product"],"name":"{name}","offers":{"@type":"AggregateOffer","lowPrice":{price},"highPrice":{price+10},"offers":[{"@type":"Offer","price":{price+20},"priceCurrency":"EUR","availability":"SoldOut"},{"price":"1,500.50","priceCurrency":"EUR"}]}}'),
    _ld('{"@graph":[{"@type":"ProductGroup","name":"{name}","url":"/products/{handle}","hasVariant":[{"@type":"Product","offers":{"price":{price}}},[{"@type":"Product","offers":{"price":{price+5},"priceSpecification":[{"priceType":"https://schema.org/StrikethroughPrice","price":{price+50}}]}}]]},{"@type":"Product","name":"other","offers":{"price":1}}]}'),
    _ld('{"@graph":[{"@type":"ProductGroup","@id":"#g","name":" {name} ","hasVariant":[{"@id":"#a"},{"@id":" #b "}]},{"@type":"Product","@id":"#a","offers":{"price":{price},"availability":"OutOfStock"}}]}', '[[{"@type":"Product","@id":"#b"}],{"@type":"Product","@id":"#b","offers":[{"price":{price+7},"availability":"PreOrder"}]}]'),
    _ld('[{"@type":"Product","name":"A","offers":{"price":1}},{"mainEntity":{"@type":"Product","name":"{name}","offers":{"@type":"Offer","priceSpecification":{"price":"{price}"},"url":"https://x.com/products/{handle}?variant=1","priceCurrency":" gbp "}}}]'),
    '<title>Shop &amp; {name}</title><meta property="og:price:amount" content="{price}"><meta property="og:price:currency" content="cad">' + _ld('[{"@type":"Product","name":"A","offers":{"price":1}},{"@type":"Product","name":"B"}]'),
    '<meta property="og:title" content="{name}"><meta name="product:price:amount" content="{price}">' + _ld('{"@type":"Product",'),
    "<title>{name}</title>" + _ld('{"@type":"Product","offers":{"price":true}}'),
    "<title>{name}</title>" + _ld(_ESCAPED),
)


def _product_pages(spark: SparkSession, d: str) -> DataFrame:
    n = len(PRODUCT_PAGES)
    html = "CASE p_partkey % " + str(n) + " " + " ".join(f"WHEN {i} THEN {_sql(page)}" for i, page in enumerate(PRODUCT_PAGES)) + " END"
    return dealt(spark, d, "part", "p_partkey").selectExpr("p_partkey AS page", f"{_H} AS handle", f"{html.replace('VARCHAR(20)', 'STRING')} AS html")


_PAGE_FACTS = f"""WITH b AS (SELECT p_partkey AS page, p_partkey % {len(PRODUCT_PAGES)} AS shape, {_H} AS handle, {_N} AS name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS p FROM part),
 f AS (SELECT page, handle, CASE shape WHEN 5 THEN 'Shop & ' || name ELSE name END AS title, CASE shape WHEN 1 THEN least(p, 1500.5) ELSE p END AS price,
 CASE shape WHEN 1 THEN greatest(p + 20, 1500.5) WHEN 2 THEN p + 5 WHEN 3 THEN p + 7 ELSE p END AS price_max, CASE shape WHEN 2 THEN p + 50 END AS compare_at,
 CASE shape WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 4 THEN 'GBP' WHEN 5 THEN 'CAD' END AS currency, CASE WHEN shape IN (0, 3, 8) THEN true WHEN shape = 1 THEN false END AS available,
 CASE WHEN shape IN (5, 6) THEN 'meta' ELSE 'json_ld' END AS price_from FROM b WHERE shape <> 7)"""


@query(_PAGE_FACTS + " SELECT * FROM f")
def q65_product_page_facts(spark, d):
    """Title, prices, currency and availability that every product page states."""
    return product_pages.product_facts(_product_pages(spark, d))


@query(_PAGE_FACTS + """ SELECT price_from, currency, count(*)::BIGINT AS n, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS p75,
 count(*) FILTER (available)::BIGINT AS available, count(*) FILTER (compare_at > price)::BIGINT AS on_sale FROM f WHERE price >= 5 GROUP BY 1, 2""")
def q66_sampled_page_prices(spark, d):
    """Price quartiles of the sampled pages, by the rules of the catalogue."""
    sampled = product_pages.sampled_variants(product_pages.product_facts(_product_pages(spark, d)))
    real = sampled.where(catalogue.is_real(F.col("title"), F.col("handle"), F.lit(""), F.col("price")))
    q = lambda p: F.percentile(F.col("price").cast("double"), F.lit(p))
    return real.groupBy("price_from", "currency").agg(
        F.count(F.lit(1)).alias("n"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.count_if("available").alias("available"),
        F.count_if(F.col("compare_at_price") > F.col("price")).alias("on_sale"),
    )


# -- store signals ----------------------------------------------------------------

#: (piece of source, page it stands on, condition over a customer's number).
_SHOWN = (
    ("<script src=\"//cdn.JudgeMe.example\"></script>", "home", "c_custkey % 3 = 0"), ("<a href=\"https://judge.me/x\">", "product", "c_custkey % 4 = 0"), ("loyalty.yotpo.com", "home", "c_custkey % 5 = 1"),
    ("https://static.klaviyo.com/onsite/js/klaviyo.js", "product", "c_custkey % 2 = 0"), ("fbq(1)", "home", "c_custkey % 6 = 0"), ("<div id=\"__NEXT_DATA__\">", "home", "c_custkey % 7 = 0"),
    ("<form action=\"/de/localization\">", "home", "c_custkey % 4 = 1"), ("bc-sf-filter and GTM-X1", "product", "c_custkey % 9 = 2"),
)


def _signal_pages(spark: SparkSession, d: str) -> DataFrame:
    def page(name: str) -> str:
        return " || ".join(["'<html>'", *(f"CASE WHEN {cond} THEN '{text}' ELSE '' END" for text, where, cond in _SHOWN if where == name)])

    made = f"array(struct(0 AS pos, 'home' AS source, {page('home')} AS html), struct(1 AS pos, 'product' AS source, {page('product')} AS html), struct(2 AS pos, 'cart' AS source, CAST(NULL AS STRING) AS html))"
    return _t(spark, d, "customer").selectExpr("c_custkey AS site", f"explode({made}) AS p").select("site", "p.*")


@query("""WITH c AS (SELECT c_custkey AS site, c_custkey AS k FROM customer), s AS (
 SELECT site, 'app' AS kind, 'Judge.me' AS name, CASE WHEN k % 3 = 0 THEN 'judgeme' ELSE 'judge.me' END AS pattern, CASE WHEN k % 3 = 0 THEN 'home' ELSE 'product' END AS source, CASE WHEN k % 3 = 0 THEN 0 ELSE 100 END AS o FROM c WHERE k % 3 = 0 OR k % 4 = 0
 UNION ALL SELECT site, 'app', 'Yotpo', 'yotpo.com', 'home', 1 FROM c WHERE k % 5 = 1 UNION ALL SELECT site, 'app', 'Yotpo Loyalty (Swell)', 'loyalty.yotpo.com', 'home', 24 FROM c WHERE k % 5 = 1
 UNION ALL SELECT site, 'app', 'Klaviyo', 'klaviyo.com', 'product', 107 FROM c WHERE k % 2 = 0 UNION ALL SELECT site, 'tracking', 'klaviyo', 'static.klaviyo.com', 'product', 107 FROM c WHERE k % 2 = 0
 UNION ALL SELECT site, 'tracking', 'meta_pixel', 'fbq(', 'home', 0 FROM c WHERE k % 6 = 0 UNION ALL SELECT site, 'framework', 'next.js', '__next_data__', 'home', 0 FROM c WHERE k % 7 = 0
 UNION ALL SELECT site, 'app', 'Boost Commerce', 'bc-sf-filter', 'product', 136 FROM c WHERE k % 9 = 2 UNION ALL SELECT site, 'tracking', 'gtm', 'gtm-', 'product', 104 FROM c WHERE k % 9 = 2)
 SELECT site, kind, name, pattern, source, (row_number() OVER (PARTITION BY site, kind ORDER BY o))::INT AS ord FROM s""")
def q67_store_signals(spark, d):
    """Apps, tags and frameworks that every store's pages show, by first sight."""
    return store_signals.store_signals(_signal_pages(spark, d))


_THEME = """CASE c_custkey % 4 WHEN 0 THEN '<script>Shopify.theme = {"name":"Dawn","schema_name":"Dawn","schema_version":"15.0","theme_store_id":887,"role":"main","id":' || CAST(c_custkey AS VARCHAR(20)) || '};</script>'
 WHEN 1 THEN '<script>Shopify.theme = {name: "Own", "role": "main", theme_store_id: null, id: ' || CAST(c_custkey AS VARCHAR(20)) || '};</script>' WHEN 2 THEN '<p>none</p>' END"""
_META = """CASE WHEN c_custkey % 3 = 0 THEN '{"id":' || CAST(c_custkey AS VARCHAR(20)) || ',"name":"Shop","currency":"EUR","country":"","ships_to_countries":["DE","FR"],"published_products_count":12}' END"""
_SHOP = """'Shopify.shop = "s' || CAST(c_custkey AS VARCHAR(20)) || '.myshopify.com"; Shopify.country = "CA"; Shopify.currency = {"active":"CAD","rate":"1.0"};'"""


@query("""WITH c AS (SELECT c_custkey AS site, c_custkey % 4 AS t, c_custkey % 3 = 0 AS m, c_custkey % 4 <> 3 AS home FROM customer)
 SELECT site, CASE t WHEN 0 THEN 'Dawn' WHEN 1 THEN 'Own' END AS theme_name, CASE WHEN t = 0 THEN '15.0' END AS schema_version, CASE WHEN t = 0 THEN 887 END::BIGINT AS theme_store_id, CASE WHEN t < 2 THEN site END AS theme_id,
 CASE WHEN t < 2 THEN 'Shopify.theme' ELSE 'not_observed' END AS theme_source, CASE WHEN m THEN 'Shop' END AS shop_name, CASE WHEN home THEN 's' || site || '.myshopify.com' END AS domain, CASE WHEN m THEN 'EUR' WHEN home THEN 'CAD' END AS currency,
 CASE WHEN home THEN 'CA' END AS country, CASE WHEN m THEN 2 END::INT AS ships_to_count, CASE WHEN m THEN 'meta.json' WHEN home THEN 'homepage' END AS shop_source, CASE WHEN NOT m AND home THEN 'homepage_Shopify.currency (may be localized)' END AS currency_source FROM c""")
def q68_store_identity(spark, d):
    """Theme and shop facts of every store, with where each comes from."""
    home = f"{_THEME} || {_SHOP}".replace("VARCHAR(20)", "STRING")
    rows = _t(spark, d, "customer").selectExpr("c_custkey AS site", f"{home} AS home", f"{_META.replace('VARCHAR(20)', 'STRING')} AS meta")
    read = rows.select("site", store_signals.theme(F.col("home")).alias("t"), store_signals.shop(F.col("meta"), F.col("home")).alias("s"))
    return read.select(
        "site", F.col("t.name").alias("theme_name"), "t.schema_version", "t.theme_store_id", F.col("t.id").alias("theme_id"), F.col("t.source").alias("theme_source"), F.col("s.name").alias("shop_name"),
        F.col("s.myshopify_domain").alias("domain"), "s.currency", "s.country", "s.ships_to_count", F.col("s.source").alias("shop_source"), "s.currency_source",
    )


@query("""WITH r AS (SELECT c_custkey AS site, (2000 + c_custkey % 20) || '-03-01' AS registered, CASE WHEN c_custkey % 2 = 0 THEN '2030-01-01' END AS expires, 'Names Inc' AS registrar FROM customer WHERE c_custkey % 3 <> 0),
 a AS (SELECT o_custkey AS site, strftime(o_orderdate, '%Y%m%d') AS stamp FROM orders), y AS (SELECT site, stamp[1:4] AS year, count(*) AS n, min(stamp) AS first FROM a GROUP BY 1, 2),
 w AS (SELECT site, min(first)[1:4] || '-' || min(first)[5:6] AS first_capture, string_agg(year || ':' || n, ',' ORDER BY year) AS by_year FROM y GROUP BY 1)
 SELECT coalesce(r.site, w.site) AS site, registered, expires, registrar, first_capture, by_year, first_capture < registered[1:7] AS conflict FROM r FULL JOIN w ON r.site = w.site""")
def q69_offsite(spark, d):
    """What a registry and an archive say of every store, and where they clash."""
    json = """concat('{"events":[{"eventAction":"Registration","eventDate":"', 2000 + c_custkey % 20, '-03-01T00:00:00Z"}', if(c_custkey % 2 = 0, ',{"eventAction":"expiration","eventDate":"2030-01-01"}', ''),
      '],"entities":[{"roles":["abuse"]},{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Names Inc"]]]}]}')"""
    rdap = _t(spark, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS site", f"{json} AS content")
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.to_json(F.array(F.array(F.lit("timestamp")), F.array(stamp, F.lit("200")))).alias("content"))
    found = store_signals.offsite(rdap, rows)
    by_year = F.array_join(F.transform(F.map_entries("captures_by_year"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.select("site", "registered", "expires", "registrar", "first_capture", by_year.alias("by_year"), "conflict")


# -- published fees -----------------------------------------------------------------

_ASKS = {
    "key": "c_custkey", "provider": "CASE c_custkey % 6 WHEN 0 THEN 'shopify_payments' WHEN 1 THEN 'stripe' WHEN 2 THEN 'paypal_us' WHEN 3 THEN 'paypal_cn' WHEN 4 THEN 'paypal_eu' ELSE 'other' END",
    "market": "CASE c_custkey % 5 WHEN 0 THEN 'EU-DE' WHEN 1 THEN 'CN' WHEN 2 THEN 'CA' ELSE 'US' END", "plan": "CASE c_custkey % 7 WHEN 0 THEN 'basic' WHEN 1 THEN 'grow' WHEN 2 THEN 'advanced' WHEN 3 THEN 'plus' WHEN 4 THEN 'custom' END",
    "currency": "CASE WHEN c_custkey % 4 = 0 THEN 'EUR' ELSE 'USD' END", "days": "c_custkey % 300",
}
_ASKED = ", ".join(f"{sql} AS {name}" for name, sql in _ASKS.items())


def _asked(spark: SparkSession, d: str) -> DataFrame:
    asks = _t(spark, d, "customer").selectExpr(*[f"{sql} AS {name}" for name, sql in _ASKS.items()])
    return asks.withColumn("day", F.expr("date_add(date'2026-10-20', int(days))"))


@query(f"""WITH a AS (SELECT {_ASKED} FROM customer), b AS (SELECT *, days - 7 AS age, CASE WHEN plan IN ('grow', 'advanced', 'plus') THEN plan ELSE 'basic' END AS tier FROM a),
 e AS (SELECT *, CASE WHEN days < 7 THEN NULL WHEN provider = 'shopify_payments' AND market = 'US' THEN 'shopify-payments-us-online-standard-' || tier WHEN provider = 'stripe' AND market = 'US' THEN 'stripe-us-domestic' WHEN provider = 'stripe' AND market = 'EU-DE' THEN 'stripe-ie-standard-eea'
  WHEN provider = 'paypal_us' AND market = 'US' THEN 'paypal-us-checkout' WHEN provider = 'paypal_cn' THEN 'paypal-cn-cross-border' WHEN provider = 'paypal_eu' AND market = 'EU-DE' THEN 'paypal-de-checkout' END AS entry FROM b)
 SELECT key, entry, (CASE provider WHEN 'shopify_payments' THEN CASE tier WHEN 'basic' THEN 2.9 WHEN 'grow' THEN 2.7 WHEN 'advanced' THEN 2.5 ELSE 2.25 END WHEN 'stripe' THEN CASE market WHEN 'US' THEN 2.9 ELSE 1.5 END WHEN 'paypal_us' THEN 3.49 WHEN 'paypal_cn' THEN 4.4 ELSE 2.99 END)::DECIMAL(9,4) AS pct,
 (CASE entry WHEN 'stripe-ie-standard-eea' THEN 0.25 WHEN 'paypal-us-checkout' THEN 0.49 WHEN 'paypal-de-checkout' THEN 0.39 ELSE 0.3 END)::DECIMAL(12,2) AS fixed, CASE WHEN age > 180 THEN 'inferred' ELSE 'verified' END AS badge, CASE WHEN age > 180 THEN 'downgrade' WHEN age > 90 THEN 'warn' END AS stale
 FROM e WHERE entry IS NOT NULL AND currency = CASE WHEN entry IN ('stripe-ie-standard-eea', 'paypal-de-checkout') THEN 'EUR' ELSE 'USD' END""")
def q70_payment_fee_lookups(spark, d):
    """The payment fee of every asked-for provider, market and plan on its day."""
    return fee_table.payment_fees(_asked(spark, d), fee_table.fee_table(spark))


@query(f"""WITH a AS (SELECT {_ASKED} FROM customer), p AS (SELECT key, (CASE WHEN market = 'US' THEN CASE plan WHEN 'basic' THEN 39 WHEN 'grow' THEN 105 WHEN 'advanced' THEN 399 WHEN 'plus' THEN 2300 END END)::DECIMAL(12,2) AS monthly,
  (CASE plan WHEN 'basic' THEN 2 WHEN 'grow' THEN 1 WHEN 'advanced' THEN 0.6 WHEN 'plus' THEN 0.2 END)::DECIMAL(9,4) AS third_party_pct FROM a WHERE days >= 7 AND plan IN ('basic', 'grow', 'advanced', 'plus')),
 h AS (SELECT key, CASE WHEN provider = 'shopify_payments' THEN 'fx:' || CASE market WHEN 'US' THEN '1.5' ELSE '2.0' END || ',international:1.0' WHEN provider = 'stripe' AND market = 'US' THEN 'fx:1.0,international:1.5' WHEN provider = 'paypal_us' THEN 'fx:3.0,international:1.5' WHEN provider = 'paypal_cn' THEN 'fx:3.5' END AS hints,
  CASE provider WHEN 'shopify_payments' THEN 'refund-shopify-payments-card-fee' WHEN 'stripe' THEN 'refund-stripe-fee' WHEN 'paypal_us' THEN 'refund-paypal-us-fee' END AS rule FROM a WHERE days >= 7)
 SELECT a.key, monthly, CASE WHEN monthly IS NOT NULL THEN 'USD' END AS plan_currency, third_party_pct, hints, rule FROM a LEFT JOIN p USING (key) LEFT JOIN h USING (key)""")
def q71_plan_fees_and_hints(spark, d):
    """Plan and third-party fees, surcharge hints and refund rules of every setup."""
    asked, table = _asked(spark, d), fee_table.fee_table(spark)
    said = F.concat_ws(":", "hint", F.format_string("%.1f", F.col("pct").cast("double")))
    hints = fee_table.surcharge_hints(asked, table).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(said)), ",").alias("hints"))
    out = asked.select("key")
    for part in (fee_table.plan_fees(asked, table), hints, fee_table.refund_rules(asked, table)):
        out = out.join(part, "key", "left")
    return out


# -- links and input sheets ---------------------------------------------------------

_ANCHORS = (
    ('<a href="https://www.shop.example/pages/returns">Returns &amp; conditions</a>', "k % 2 = 0"), ('<a href="/policies/terms">Terms</a>', "k % 3 = 0"), ('<a href="https://other.example/privacy">Privacy</a>', "k % 2 = 1"),
    ('<a href="/legal#p">Our privacy</a>', "k % 5 = 0"), ('<a href="mailto:contact@shop.example">Contact</a>', "k % 2 = 1"), ('<a class="x" href="\\/help-center\\/">Questions</a>', "k % 4 = 1"), ("<a href='//shop.example/contact'>Write us</a>", "k % 7 = 0"),
)


@query("""WITH c AS (SELECT c_custkey AS site, c_custkey AS k FROM customer), l AS (SELECT site, 'refund-policy' AS name, 'https://www.shop.example/pages/returns' AS href FROM c WHERE k % 2 = 0
 UNION ALL SELECT site, 'terms-of-service', '/policies/terms' FROM c WHERE k % 3 = 0 UNION ALL SELECT site, 'privacy-policy', '/legal#p' FROM c WHERE k % 5 = 0
 UNION ALL SELECT site, 'faq', '/help-center/' FROM c WHERE k % 4 = 1 UNION ALL SELECT site, 'contact', 'https://shop.example/contact' FROM c WHERE k % 7 = 0) SELECT * FROM l""")
def q72_discovered_links(spark, d):
    """Where every store's home page links to its policies, contact and help."""
    source = " || ".join("CASE WHEN " + cond + " THEN '" + text.replace("\\", "\\\\").replace("'", "\\'") + "' ELSE '' END" for text, cond in _ANCHORS)
    pages = dealt(spark, d, "customer", "c_custkey").selectExpr("c_custkey AS site", "c_custkey AS k").selectExpr("site", f"{source} AS html")
    return pages.select("site", F.explode(links.discovered(F.col("html"), F.lit("shop.example"))).alias("l")).select("site", "l.*")


@query("""WITH RECURSIVE p AS (SELECT p_partkey % 20 AS site, p_partkey // 20 AS i FROM part), e AS (SELECT site, i, 2 * i + 1 AS j FROM p UNION SELECT site, i, 3 * i + 2 FROM p),
 w(site, i, d) AS (SELECT site, 0::BIGINT, 0 FROM p WHERE i = 0 UNION SELECT w.site, e.j, d + 1 FROM w JOIN e ON e.site = w.site AND e.i = w.i WHERE d < 6)
 SELECT site, '/p/' || i AS path, min(d)::INT AS depth FROM w GROUP BY ALL""")
def q73_crawl_depths(spark, d):
    """What is reached from every site's first page within six links."""
    at = "CAST(p_partkey div 20 AS STRING)"
    link = lambda sql: f"'<a href=\"' || {sql} || '\">x</a>'"
    made = f"concat({link(chr(39) + '/p/' + chr(39) + ' || CAST(2 * (p_partkey div 20) + 1 AS STRING)')}, {link(chr(39) + 'https://www.s.example/p/' + chr(39) + ' || CAST(3 * (p_partkey div 20) + 2 AS STRING) || ' + chr(39) + '?x=1#y' + chr(39))})"
    pages = dealt(spark, d, "part", "p_partkey").selectExpr("p_partkey % 20 AS site", f"'https://s.example/p/' || {at} AS url", f"{made} AS html")
    graph = links.link_graph(pages)
    seeds = pages.where("url = 'https://s.example/p/0'").select("site", F.lit("/p/0").alias("path"))
    return links.reached(graph, seeds, 6)


_FIELDS = (
    ("price", "money", "price"), ("price", "money", "Selling price"), ("price", "money", "售价"), ("refund_pct", "pct", "Refund rate (%)"), ("refund_pct", "pct", "refund-rate%"), ("units", "count", "Units"), ("market", "market", "Market"),
    ("currency", "currency", "Currency"), ("plan", "choice", "Plan"), ("note", "text", "Note"), ("units", "count", "price"),
)
_CHOICES = (("market", "US", "us"), ("market", "US", "United States"), ("market", "UK", "GB"), ("currency", "USD", "usd"), ("currency", "USD", "US dollar"), ("plan", "grow", "grow"), ("plan", "grow", "Shopify (middle)"))
#: item, value, key, kind, number, choice, issue: one case for each remainder of the row's number.
_CASES = (
    ("Selling  Price", "1,234.50", "price", "money", "1234.50", None, None), ("售价：", "-3", "price", "money", "-3", None, "negative"), ("REFUND_RATE %", "120", "refund_pct", "pct", "120", None, "percent_range"), ("units", "2.5", "units", "count", "2.5", None, "not_whole"),
    ("Market", "united states", "market", "market", None, "US", None), ("market", "eu-de", "market", "market", None, "EU-DE", None), ("Market", "Mars", "market", "market", None, None, "unknown_value"), ("Currency", "US-Dollar", "currency", "currency", None, "USD", None),
    ("Plan", "shopify middle", "plan", "choice", None, "grow", None), ("Plan", None, "plan", "choice", None, None, None), ("Colour", "red", None, None, None, None, "unknown_field"), (None, "1", None, None, None, None, "unknown_field"), ("price", "many", "price", "money", None, None, "not_a_number"),
    ("Note", "any text", "note", "text", None, None, None),
)


def _case(column: int, kind: str) -> str:
    shown = lambda v: "NULL" if v is None else v if kind == "DECIMAL(18,6)" else "'" + v + "'"
    return f"CAST(CASE l_orderkey % {len(_CASES)} " + " ".join(f"WHEN {i} THEN {shown(c[column])}" for i, c in enumerate(_CASES)) + f" END AS {kind})"


@query("SELECT issue, key, kind, choice, number, count(*)::BIGINT AS n FROM (SELECT " + ", ".join(f"{_case(i, k)} AS {n}" for i, k, n in ((2, "VARCHAR", "key"), (3, "VARCHAR", "kind"), (4, "DECIMAL(18,6)", "number"), (5, "VARCHAR", "choice"), (6, "VARCHAR", "issue"))) + " FROM lineitem) GROUP BY ALL")
def q74_input_fields(spark, d):
    """Rows of input sheets by field, typed value and issue."""
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey AS product", "l_linenumber AS line", f"{_case(0, 'STRING')} AS item", f"{_case(1, 'STRING')} AS value")
    fields = spark.createDataFrame([(*f, i) for i, f in enumerate(_FIELDS)], "key string, kind string, name string, ord int")
    choices = spark.createDataFrame([(*c, i) for i, c in enumerate(_CHOICES)], "field string, choice string, name string, ord int")
    read = input_fields.read_fields(rows, fields, choices)
    return read.groupBy("issue", "key", "kind", "choice", F.col("number").cast("decimal(18,6)").alias("number")).agg(F.count(F.lit(1)).alias("n"))


# -- pasted files and page roles ------------------------------------------------------

#: name, text, role, handle; the file is there for customers whose number leaves no remainder by the last value.
_PASTED = (
    ("Our Refunds.txt", "Send it back", "policy", "refund-policy", 1), ("returns-old.md", "Send it back", "page", "other", 2), ("notes.txt", "We keep your personal data safe", "policy", "privacy-policy", 3), ("a.html", "<p>Delivery takes 5 business days</p>", "policy", "shipping-policy", 2),
    ("export.csv", "Handle,Title,Variant Price", "products", None, 5), ("other.csv", "a,b", "skipped", None, 4), ("photo.png", "x", "skipped", None, 3), ("start-home.txt", "Welcome", "home", None, 1), ("hours.txt", "Open daily", "page", "other", 7), (".hidden.txt", "refund", None, None, 1),
    ("faq.text", "Ask", "page", "faq", 6),
)


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT c_custkey AS site, '{n}' AS name, {'NULL' if r is None else repr(r)} AS role, {'NULL' if h is None else repr(h)} AS handle, {len(t)} AS n FROM customer WHERE c_custkey % {m} = 0" for n, t, r, h, m in _PASTED) + """)
 SELECT site, name, role, handle, CASE role WHEN 'policy' THEN 'policy:' || handle WHEN 'home' THEN 'homepage' WHEN 'page' THEN 'page:' || name ELSE role END AS key, CASE WHEN role = 'skipped' THEN 'skipped' ELSE 'ok' END AS result,
 CASE WHEN role NOT IN ('products', 'skipped') THEN n END::BIGINT AS chars FROM f WHERE role IS NOT NULL""")
def q75_pasted_files(spark, d):
    """What every file that was pasted for a store is."""
    made = ", ".join(f"CASE WHEN c_custkey % {m} = 0 THEN struct('{n}' AS name, encode('{t}', 'UTF-8') AS content) END" for n, t, _, _, m in _PASTED)
    files = _t(spark, d, "customer").selectExpr("c_custkey AS site", f"explode(filter(array({made}), x -> x IS NOT NULL)) AS f").select("site", "f.*")
    return pasted.pasted_files(files).select("site", "name", "role", "handle", "key", "result", F.length("text").cast("long").alias("chars"))


_KEPT = (
    ("policies/refund-policy.html", 10, 2), ("policies/refund-policy.page.html", 20, 3), ("pages/retour.html", 30, 1), ("pages/datenschutz.txt", 5, 4), ("policies/privacy-policy.txt", 0, 5), ("pages/agb.html", 0, 1), ("markets/de/policy.html", 9, 1), ("pages.json", 9, 1), ("_status.json", 9, 1),
    ("homepage.html", 9, 1), ("pages/impressum.html", 7, 6),
)


@query("""WITH c AS (SELECT c_custkey AS site, c_custkey AS k FROM customer)
 SELECT site, 'refund-policy' AS policy, CASE WHEN k % 3 = 0 THEN 'policies/refund-policy.page.html' WHEN k % 2 = 0 THEN 'policies/refund-policy.html' ELSE 'pages/retour.html' END AS path, CASE WHEN k % 3 = 0 THEN 20 WHEN k % 2 = 0 THEN 10 ELSE 30 END::BIGINT AS chars FROM c
 UNION ALL SELECT site, 'privacy-policy', CASE WHEN k % 4 = 0 THEN 'pages/datenschutz.txt' ELSE 'policies/privacy-policy.txt' END, CASE WHEN k % 4 = 0 THEN 5 ELSE 0 END FROM c WHERE k % 4 = 0 OR k % 5 = 0
 UNION ALL SELECT site, 'legal-notice', 'pages/impressum.html', 7 FROM c WHERE k % 6 = 0""")
def q76_page_roles(spark, d):
    """The file that stands for each policy of every store kept without an index."""
    made = ", ".join(f"CASE WHEN c_custkey % {m} = 0 THEN struct('{p}' AS path, repeat('x', {n}) AS text) END" for p, n, m in _KEPT)
    files = _t(spark, d, "customer").selectExpr("c_custkey AS site", f"explode(filter(array({made}), x -> x IS NOT NULL)) AS f").select("site", "f.*")
    index = files.withColumn("r", pasted.file_role(F.col("path"))).where("r is not null").select("site", "path", "text", "r.*")
    return pasted.assigned(index)
