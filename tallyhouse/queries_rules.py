"""Registered queries of the rule engines over made-up stores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fees, markets, sampling, tags
from .functions import html, text
from .plans.staging import cut
from .queries import _t, dealt, query
from .rules import cases, engine, launch, launch_sql, payments, payments_sql, tracking, tracking_sql


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """The customers, each of which becomes a store of many pages."""
    return dealt(spark, d, "customer", "c_custkey")


def launch_facts(spark: SparkSession, d: str) -> DataFrame:
    return launch.site_facts(*cases.stores(_customers(spark, d)))


@query(launch_sql.findings_sql() + " SELECT site, rule_id, result, level, badge, note FROM findings")
def q50_launch_findings(spark, d):
    """All 71 launch rules for every store."""
    return launch.audit(launch_facts(spark, d)).select("site", "rule_id", "result", "level", "badge", "note")


@query(launch_sql.findings_sql() + """, s AS (SELECT site, CASE WHEN failed THEN 'failed' WHEN mode <> 'online' OR password THEN 'partial' WHEN platform <> 'shopify' OR (drawn AND home) THEN 'partial' ELSE 'complete' END AS status FROM f),
 r AS (SELECT site, rule_id, CASE WHEN rule_id IN ('CON-01', 'POL-07') AND result IN ('fail', 'manual') THEN 'pass' ELSE result END AS result, level FROM findings),
 c AS (SELECT site, count(*) FILTER (result IN ('fail', 'manual') AND level = 'P0')::BIGINT AS n_p0, count(*) FILTER (result IN ('fail', 'manual') AND level = 'P1')::BIGINT AS n_p1,
  count(*) FILTER (result IN ('fail', 'manual') AND level = 'P2')::BIGINT AS n_p2, count(*) FILTER (result IN ('fail', 'manual') AND level = 'P3')::BIGINT AS n_p3, count(*) FILTER (result = 'fail' AND level = 'P0') AS p0,
  count(*) FILTER (result = 'fail') AS fails, bool_or(rule_id = 'TRU-05' AND result = 'manual') AS locked,
  arg_min(rule_id, level || lpad((list_position([{places}], rule_id))::VARCHAR, 3, '0')) FILTER (result IN ('fail', 'manual')) AS first_fix FROM r GROUP BY 1)
 SELECT site, status, n_p0, n_p1, n_p2, n_p3, CASE WHEN status = 'failed' OR (locked AND fails = 0) THEN NULL WHEN p0 = 0 THEN 'go' WHEN p0 <= 2 THEN 'fix_p0' ELSE 'hold' END AS verdict, first_fix FROM s JOIN c USING (site)
""".replace("{places}", ", ".join(repr(x.split()[0]) for x in launch.RULES.strip().splitlines())))
def q51_launch_verdicts(spark, d):
    """Counts, verdict and first fix of every store once two findings were reviewed."""
    facts = launch_facts(spark, d)
    found = cut(launch.audit(facts).select("site", "place", "rule_id", "result", "level", "note"), "found")
    dropped = found.where("rule_id in ('CON-01', 'POL-07')").select("site", "rule_id")
    kept = cut(engine.reviewed(found, dropped), "reviewed")
    first = engine.fix_list(kept).groupBy("site").agg(F.min_by("rule_id", "ord").alias("first_fix"))
    return engine.verdict(kept, launch.status(facts)).join(first, "site", "left")


_PAIRS = "CASE WHEN home AND NOT drawn AND alternates"


@query(f"""WITH w AS ({cases.pieces_sql()}), h AS (SELECT * FROM w WHERE home AND NOT drawn AND alternates), m AS (SELECT * FROM h WHERE market_code <> '')
 SELECT site, 'invalid_code' AS kind, '{cases.HOME_URL}' AS page, alternate_code AS code, CASE alternate_code WHEN 'en-UK' THEN 'bad_region:uk->gb' ELSE 'bad_language:jp->ja' END AS detail FROM h WHERE alternate_code IN ('en-UK', 'jp')
 UNION ALL SELECT site, 'no_x_default', '{cases.HOME_URL}', NULL, '' FROM h WHERE NOT default_alternate
 UNION ALL SELECT site, 'missing_on_version', '{cases.HOME_URL}m/', NULL, '' FROM m WHERE NOT market_alternates""")
def q52_hreflang_problems(spark, d):
    """What is wrong with the language annotations of every store's versions."""
    _, pages, _ = cases.stores(_customers(spark, d))
    home = F.col("role") == "home"
    versions = pages.where("role in ('home', 'market_home') and html is not null").select("site", F.when(home, 0).otherwise(F.col("pos") + 1).alias("pos"), "url", html.hreflang("html").alias("pairs"))
    return markets.hreflang_problems(versions).select("site", "kind", "page", "code", "detail")


@query("WITH " + launch_sql.facts_sql() + """ SELECT site, list_sort(countries) AS countries, list_sort(tokens) AS tokens, list_sort(gaps) AS gaps, CASE market_code WHEN 'de-DE' THEN 'DE' WHEN 'en-GB' THEN 'GB' END AS region,
 CASE market_code WHEN 'de-DE' THEN 'EUR' WHEN 'en-GB' THEN 'GBP' END AS currency FROM f""")
def q53_target_markets(spark, d):
    """Targeted countries, rule groups and missing languages of every store."""
    p = cases.pieces(_customers(spark, d)).selectExpr("*", f"{cases.home_html()} AS html")
    pairs = F.coalesce(html.hreflang("html"), F.array().cast("array<struct<code:string,href:string>>"))
    p = p.withColumns({"pairs": pairs, "chosen": markets.default_markets(F.col("user_markets"), markets.offered("html"))})
    wanted = markets.language_markets(F.col("chosen"), markets.hreflang_countries(F.col("pairs")))
    region = markets.region_of(F.col("market_code"))
    return p.select(
        "site", F.array_sort("chosen.countries").alias("countries"), F.array_sort(markets.groups(F.col("chosen.countries"))).alias("tokens"),
        F.array_sort(markets.language_gaps(wanted, html.html_lang("html"), F.col("pairs"))).alias("gaps"), region.alias("region"), markets.currency(region).alias("currency"),
    )


# -- payments -------------------------------------------------------------------


def payment_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stores, pages, products, raw = cases.pay_stores(_customers(spark, d))
    answers = cases.questionnaire(raw)
    return payments.facts(stores, pages, products, answers), answers


def payment_setups(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the site's identity, all that costs ask of a store's pages,
    written once: what is asked of the answers would else run before the customers
    are dealt, in the one task of a small file."""
    stores, pages, _, raw = cases.pay_stores(_customers(spark, d))
    return cut(cases.questionnaire(raw).join(payments.identities(stores, pages), "site"), "pay-setups")


@query(payments_sql.findings_sql() + " SELECT * FROM findings")
def q54_payment_findings(spark, d):
    """All payment rules for every store."""
    return payments.findings(payment_facts(spark, d)[0])


@query(payments_sql.findings_sql() + """, c AS (SELECT site, count(*) FILTER (result = 'issue' AND severity = 'P0')::BIGINT AS n_p0, count(*) FILTER (result = 'issue' AND severity = 'P1')::BIGINT AS n_p1, count(*) FILTER (result = 'issue' AND severity = 'P2')::BIGINT AS n_p2,
 count(*) FILTER (result = 'issue' AND severity = 'P3')::BIGINT AS n_p3, count(*) FILTER (result = 'unknown')::BIGINT AS n_unknown, arg_min(rule_id, severity || rule_id) FILTER (result = 'issue') AS first_fix FROM findings GROUP BY 1)
 SELECT c.*, CASE WHEN NOT online THEN 'partial' WHEN NOT usable AND len(ok_list) > 0 THEN 'partial' WHEN NOT usable THEN 'failed' WHEN cart_result = 'blocked' OR terms_drawn OR ident IN ('not_shopify', 'unconfirmed') THEN 'partial' ELSE 'complete' END AS status FROM c JOIN p USING (site)""")
def q55_payment_counts(spark, d):
    """Issues by severity, what to fix first, and how complete each run was."""
    facts, _ = payment_facts(spark, d)
    return payments.counts(payments.findings(facts)).join(payments.run_status(facts), "site")


@query(payments_sql.fees_sql() + " SELECT * FROM items")
def q56_fee_items(spark, d):
    """Every cost of every store's payment setup."""
    return fees.fee_items(payment_setups(spark, d))


@query(payments_sql.fees_sql() + """, m AS (SELECT site, plan, entity, aov, orders, concat_ws(',', CASE WHEN aov = 0 THEN 'aov' END, CASE WHEN orders IS NULL THEN 'monthly_orders' END, CASE WHEN routes = '' THEN 'gateways' END) AS missing FROM p WHERE answered),
 t AS (SELECT site, coalesce(sum(monthly), 0)::DECIMAL(18,2) AS total, count(*) FILTER (monthly IS NULL)::BIGINT AS n_unknown FROM items GROUP BY 1),
 z AS (SELECT m.*, CASE WHEN missing = '' THEN coalesce(total, 0) END::DECIMAL(18,2) AS monthly_total, CASE WHEN missing = '' THEN round(aov::DECIMAL(18,6) * orders::DECIMAL(18,6), 2) END::DECIMAL(18,2) AS monthly_sales, CASE WHEN missing = '' THEN coalesce(n_unknown, 0) END AS n_unknown FROM m LEFT JOIN t USING (site))
 SELECT site, CASE WHEN missing <> '' THEN 'not_computed' WHEN n_unknown > 0 THEN 'partial' ELSE 'computed' END AS status, missing, monthly_sales, monthly_total, (monthly_total * 12)::DECIMAL(18,2) AS yearly_total,
 floor((monthly_total * 100)::DECIMAL(20,2) * 100 / monthly_sales + 0.5) / 100 AS pct_of_sales, n_unknown,
 CASE WHEN missing = '' THEN CASE entity WHEN 'US' THEN CASE plan WHEN 'basic' THEN 39 WHEN 'Shopify' THEN 105 WHEN 'advanced' THEN 399 WHEN 'plus' THEN 2300 END WHEN 'CA' THEN CASE plan WHEN 'basic' THEN 49 WHEN 'Shopify' THEN 132 WHEN 'advanced' THEN 517 WHEN 'plus' THEN 3400 END END END::DECIMAL(18,2) AS plan_fee FROM z""")
def q57_fee_totals(spark, d):
    """Monthly and yearly cost of every setup, as far as it is known."""
    q = payment_setups(spark, d)
    return fees.fee_totals(q, fees.fee_items(q)).withColumn("pct_of_sales", F.col("pct_of_sales").cast("double"))


# -- tracking -------------------------------------------------------------------


@query(tracking_sql.findings_sql() + " SELECT * FROM findings")
def q58_tracking_findings(spark, d):
    """All tracking checks for every store."""
    return tracking.findings(tracking.facts(*cases.tag_stores(_customers(spark, d))))


@query("WITH " + tracking_sql.facts_sql() + f""", t AS (SELECT site, 'ga4' AS platform, '{cases.GA}' AS id, list_filter([CASE WHEN app_g THEN 'app_pixel' END, CASE WHEN container THEN 'gtm_container' END, CASE WHEN home AND ga_script THEN 'theme_code' END], lambda x: x IS NOT NULL) AS install_via, 'on_page' AS badge FROM f WHERE s_ga4
 UNION ALL SELECT site, 'google_ads', '{cases.ADS}', ['app_pixel'], 'on_page' FROM f WHERE app_g UNION ALL SELECT site, 'google_tag', '{cases.GT}', ['theme_code'], 'inferred' FROM f WHERE s_gt
 UNION ALL SELECT site, 'gtm', 'GTM-AAAA11', ['theme_code'], 'on_page' FROM f WHERE s_gtm UNION ALL SELECT site, 'gtm', 'GTM-BBBB22', ['theme_code'], 'on_page' FROM f WHERE s_gtm AND gtm_two
 UNION ALL SELECT site, 'klaviyo', 'AbCd12', ['theme_code'], 'on_page' FROM f WHERE s_klaviyo UNION ALL SELECT site, 'meta', '{cases.META}', list_filter([CASE WHEN app_m THEN 'app_pixel' END, CASE WHEN call_ok THEN 'theme_code' END], lambda x: x IS NOT NULL), CASE WHEN app_m THEN 'on_page' ELSE 'inferred' END FROM f WHERE app_m OR call_ok
 UNION ALL SELECT site, 'meta', NULL, list_filter([CASE WHEN cust_m THEN 'custom_pixel' END, CASE WHEN container THEN 'gtm_container' END], lambda x: x IS NOT NULL), 'inferred' FROM f WHERE cust_m OR container) SELECT * FROM t""")
def q59_tags(spark, d):
    """Every tag of every store: platform, id, install paths, badge."""
    _, pages, containers, _, _ = cases.tag_stores(_customers(spark, d))
    return tags.merge(tracking.hits_of(pages, containers)).select("site", "platform", "id", "install_via", "badge")


# -- policy wording, names, snapshot ids ----------------------------------------


@query(f"""WITH w AS ({cases.pieces_sql()}), t AS (SELECT site, refund || shipping || faq AS said FROM w) SELECT site, nullif(regexp_extract(said, 'return items within ([0-9]+) days', 1), '') AS return_days,
 CASE WHEN contains(said, 'orders over $50') THEN '50.00' END AS free_shipping_over, CASE WHEN contains(said, '15% restocking') THEN '15' END AS restocking_fee_pct,
 CASE WHEN contains(said, 'customer is responsible') THEN 'customer' WHEN contains(said, 'Free returns') THEN 'store' END AS return_shipping_paid_by FROM t""")
def q60_policy_terms(spark, d):
    """The terms that matter in every store's policies."""
    p = cases.pieces(_customers(spark, d)).selectExpr("site", "refund || shipping || faq AS said")
    terms = p.select("site", text.key_terms(text.long_sentences("said")).alias("t"))
    return terms.select("site", *[F.try_element_at("t", F.lit(k)).alias(k) for k in ("return_days", "free_shipping_over", "restocking_fee_pct", "return_shipping_paid_by")])


_DATED = "'Last updated: 2026-01-02' || chr(10) || '  ' || refund || '  as of 2026-03-04 ' || chr(10) || chr(10) || shipping || chr(10) || 'Updated on 1/2/2026'"


@query(rf"""WITH w AS ({cases.pieces_sql()}), l AS (SELECT site, list_transform(string_split({_DATED}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS ls FROM w),
 k AS (SELECT site, list_filter(list_transform(list_filter(ls, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(last updated|updated on)')), lambda x: trim(replace(x, '2026-03-04', ''))), lambda x: x <> '') AS ks FROM l)
 SELECT site, sha256(array_to_string(ks, chr(10))) AS sha256 FROM k""")
def q61_policy_digests(spark, d):
    """Digest of each policy without dates and formatting."""
    p = cases.pieces(_customers(spark, d)).selectExpr("site", f"{_DATED} AS said")
    return p.select("site", text.sha_text(text.policy_text("said")).alias("sha256"))


@query(f"""WITH w AS ({cases.pieces_sql()}) SELECT site, array_to_string(list_concat(regexp_extract_all(refund, 'Acme Trading Ltd'), regexp_extract_all(contact, 'Zeta Goods Ltd')), ';') AS names,
 array_to_string(list_concat(CASE WHEN contains(refund, 'Acme Trading Ltd') THEN ['acme trading'] ELSE []::VARCHAR[] END, CASE WHEN contains(contact, 'Zeta Goods') THEN ['zeta goods'] ELSE []::VARCHAR[] END), ';') AS plain FROM w""")
def q62_company_names(spark, d):
    """Company names in every store's texts, as written and for comparison."""
    p = cases.pieces(_customers(spark, d)).selectExpr("site", "refund || contact AS said").withColumn("n", text.legal_names("said"))
    return p.select("site", F.array_join("n", ";").alias("names"), F.array_join(F.transform("n", lambda n: text.norm_legal(n)), ";").alias("plain"))


@query("""WITH d AS (SELECT o_custkey AS site, o_orderkey % 4 AS n FROM orders), u AS (SELECT site, list_distinct(list(CASE n WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END)) AS used FROM d GROUP BY 1),
 f AS (SELECT site, list_min(list_filter([1, 2, 3, 4, 5], lambda x: NOT list_contains(used, x))) AS n FROM u) SELECT site, CASE n WHEN 1 THEN '2026-11-01' ELSE '2026-11-01_' || n END AS next_id FROM f""")
def q63_next_snapshot_ids(spark, d):
    """The first free snapshot id of a day for every customer."""
    n = F.col("o_orderkey") % 4
    name = F.when(n == 0, "2026-11-01").when(n == 1, "2026-11-01_2").when(n == 2, "2026-11-01_4").otherwise("2026-11-01_7-archive")
    return sampling.next_snapshot_id(_t(spark, d, "orders").select(F.col("o_custkey").alias("site"), name.alias("snapshot_id")), "2026-11-01")


@query(f"""WITH w AS ({cases.pay_pieces_sql()}), m AS (SELECT site, main, list_filter([CASE WHEN contains(home_said, '30-day returns') THEN 30 END, CASE WHEN contains(faq, 'within 45 days') THEN 45 END], lambda x: x IS NOT NULL) AS claimed
 FROM (SELECT *, try_cast(regexp_extract(refund, 'within ([0-9]+) days of', 1) AS INT) AS main FROM w)) SELECT site, main AS days, claimed FROM m""")
def q64_return_windows(spark, d):
    """The return window each policy states and those its pages promise."""
    p = cases.pay_pieces(_customers(spark, d))
    claimed = F.concat(text.page_return_claims("home_said"), text.page_return_claims("faq"))
    return p.select("site", F.try_element_at(text.return_windows("refund"), F.lit(1)).alias("days"), claimed.alias("claimed"))
