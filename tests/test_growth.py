"""Work that must not grow faster than the input: what plans hold, on tiny rows."""

from pyspark.sql import functions as F

from tallyhouse import queries, queries_rules
from tallyhouse.functions import html, wording
from tallyhouse.operators import claims, links, markets, product_pages, tags
from tallyhouse.plans import staging
from tallyhouse.rules import cases, launch, payments, tracking


def expression(spark, column):
    return spark.range(1).select(F.lit("<a href='/x'>y</a>").alias("html")).select(column.alias("c"))._jdf.queryExecution().analyzed().toString()


def test_links_are_read_once_for_all_hints(spark):
    plan = expression(spark, links.discovered(F.col("html"), F.lit("s.example")))
    assert plan.count("<a\\b") == 2


def test_attributes_are_read_once(spark):
    assert expression(spark, html.attributes(F.col("html"))).count("[a-zA-Z_:\\-]+") == 4


def test_a_walk_reads_pages_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(links, "cut", lambda df, name: written.append(name) or df)
    graph = spark.createDataFrame([(1, "/a", "/b"), (1, "/b", "/c")], "site int, path string, target string")
    seeds = spark.createDataFrame([(1, "/a")], "site int, path string")
    assert sorted(r.depth for r in links.reached(graph, seeds, 3).collect()) == [0, 1, 2]
    assert written.count("graph") == 1


def test_versions_are_made_once_for_all_problems(spark, monkeypatch):
    written = []
    monkeypatch.setattr(markets, "cut", lambda df, name: written.append(name) or df, raising=False)
    rows = spark.createDataFrame([(1, 0, "https://a.com/", [("jp", "https://a.com/")])], "site int, pos int, url string, pairs array<struct<code:string,href:string>>")
    assert {r.kind for r in markets.hreflang_problems(rows).collect()} == {"invalid_code", "no_x_default"}
    assert written == ["versions"]


def test_facts_of_product_pages_are_never_broadcast(spark, monkeypatch):
    plans = []

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staging.cut(df, name)

    monkeypatch.setattr(product_pages, "cut", recorded)
    ld = '<script type="application/ld+json">{"@type":"Product","name":"A","offers":{"price":"5"}}</script>'
    found = product_pages.structured_facts(spark.createDataFrame([(1, "a", ld)], "page int, handle string, html string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [r.price for r in found.collect()] == [5.0]
    assert not [p for p in plans if "Broadcast" in p]


def test_a_sentence_is_searched_once_for_its_words(spark):
    plan = expression(spark, claims.sentence_claims(F.col("html")))
    assert plan.count("(?i)warrant") == 1 and plan.count("no restocking fee") == 1


def test_payment_patterns_search_only_the_pages_that_count(spark):
    text = "You may cancel. We \u017fhip to Canada, \u017fecure checkout, dispatch in 2 days of delivery. Write to a@b.com"
    rows = [(1, i, role, name, "ok", None, text) for i, (role, name) in enumerate([("home", "home"), ("faq", "faq"), ("policy", "terms-of-service"), ("policy", "shipping-policy"), ("contact", "contact")])]
    pages = spark.createDataFrame(rows, "site int, pos int, role string, name string, result string, html string, text string")
    got = {r["name"]: r for r in payments.page_flags(pages).collect()}
    kinds = ("home", "faq", "terms-of-service", "shipping-policy", "contact")
    assert [got[k].cancel for k in kinds] == [None, None, True, True, None]
    assert [got[k].shipping_destinations for k in kinds] == [None, None, None, True, None]
    assert [got[k].trust for k in kinds] == [True, None, None, None, None]
    assert [got[k].mails for k in kinds] == [["a@b.com"], None, ["a@b.com"], None, ["a@b.com"]]


def test_parts_of_pages(spark):
    rows = [("policy", "<body><div class='shopify-policy__body'>A<div>b</div></div>c</body>"), ("product", "<main>x</main><p>y</p>"), ("home", "<main>x</main><p>y</p>"), ("faq", " a  b ")]
    got = payments.main_text(spark.createDataFrame(rows, "role string, src string")).collect()
    assert [" ".join((r.said or "").split()) if r.role != "faq" else r.said for r in got] == ["A b", "x", "x y", "a  b"]
    assert [r.plain and r.plain.split() for r in got] == [None, ["x", "y"], None, None]


def test_costs_ask_home_pages_alone(spark, monkeypatch, tmp_path):
    written = []

    def recorded(df, name):
        written.append(name)
        return staging.cut(df, name)

    monkeypatch.setattr(payments, "cut", recorded)
    monkeypatch.setattr(queries_rules, "cut", recorded, raising=False)
    spark.range(1, 60).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert queries_rules.q57_fee_totals(spark, str(tmp_path)).count() == 54
    assert queries_rules.q56_fee_items(spark, str(tmp_path)).count() > 0
    assert written == ["pay-identity", "pay-setups"] * 2


def test_overlaps_cost_two_rows_for_an_interval(spark, tmp_path):
    rows = [(1, 1, 1, "2026-01-01"), (1, 1, 1, "2026-01-02"), (1, 1, 1, "2026-02-01"), (1, 2, 3, "2026-01-02"), (1, 2, 4, "2026-01-02"), (1, 3, 1, "2026-01-06"), (2, 1, 1, "2026-01-01"), (2, 1, 1, "2026-01-02"), (3, 9, 2, None), (3, 9, 3, "2026-01-01")]
    df = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, day string").withColumn("l_shipdate", F.to_timestamp("day")).drop("day")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = queries.q22_interval_overlap(spark, str(tmp_path))
    # of supplier 1: two of its first id meet both longer ones, these each other, one the last
    assert [(r.l_suppkey, r.n) for r in found.collect()] == [(1, 6)]
    assert "sequence(" not in found._jdf.queryExecution().analyzed().toString()


def test_parts_are_dealt_before_they_become_trials(spark, tmp_path):
    spark.createDataFrame([(1, 100.0, 4), (2, 50.0, 2)], "p_partkey long, p_retailprice double, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = queries.q41_sensitivity(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_a_page_is_scanned_once_for_tags(spark):
    pages = spark.createDataFrame([(1, "homepage", "ok", "<p>x</p>")], "site long, key string, result string, html string")
    plan = tags.scanned(pages)._jdf.queryExecution().optimizedPlan().toString()
    # the source with its list blanked out, the list, its entries and their settings
    assert plan.count("repeat(") == 1 and plan.count("from_json(") == 3


def test_tracking_facts_write_scans_without_sources(spark, monkeypatch):
    written = {}

    def recorded(df, name):
        written[name] = df.columns
        return staging.cut(df, name)

    monkeypatch.setattr(tracking, "cut", recorded)
    stores = cases.tag_stores(spark.range(1, 60).withColumnRenamed("id", "c_custkey"))
    facts = tracking.facts(*stores)
    assert list(written) == ["scans", "tag-facts"] and "html" not in written["scans"]
    assert facts.count() == 59
    plan = tracking.findings(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(coalesce(tags#") == len(tracking.PER_PLATFORM)


def test_words_before_patterns_change_no_match(spark):
    said = ["KetchCDN DO NOT SELL", "\u212aetchcdn do not \u017fell", "cdn.cookielaw.org otsdkstub", "cdnXcookielaw.org", "", "gtag('consent', 'default') ad_personalization 'UA-12345-1'"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, html string").select("i", tags.consent_marks(F.col("html")).alias("m")).orderBy("i").collect()
    assert [r.m.tools for r in rows] == [["Ketch"], [], ["OneTrust"], [], [], []]
    assert [r.m.opt_out for r in rows] == [True, False, False, False, False, False]
    assert [(r.m.consent_default, r.m.consent_v2, r.m.legacy) for r in rows] == [(False, False, False)] * 5 + [(True, True, True)]
    link = "<LINK REL='alternate' HREFLANG='de' href='/d'><link rel=alternate title=hreflang href=/e>"
    assert [tuple(p) for p in spark.createDataFrame([(link,)], "h string").select(html.hreflang("h")).first()[0]] == [("de", "/d")]


def test_literals_of_a_pattern_are_in_each_match(spark):
    found = {p: wording.literals(p) for p in (r"refunds?\b|\bno (?:returns?|way)", r"(?s)(ab|c).{0,9}withdraw", r"a*", r"x?", r"\x{4E00}", r"\b\d{5}\s", r"id=[\"']root")}
    assert found == {
        r"refunds?\b|\bno (?:returns?|way)": {"refund", "no return", "no way"}, r"(?s)(ab|c).{0,9}withdraw": {"withdraw"}, r"a*": None, r"x?": None, r"\x{4E00}": None,
        r"\b\d{5}\s": {wording.DIGIT}, r"id=[\"']root": {"id='root", 'id="root'},
    }
    said = ["WE SHIP WITHIN 3", "ſhİps wıthin 9 days", "\u212aLARO", "", None, "cookie-bot", "10115 Berlin", "lorem", "[INSERT name]", "'quoted' \\ back"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, x string").withColumn("x_low", wording.folded("x"))
    patterns = [launch.SHIP_TIME, launch.CONSENT, launch.ADDRESS, launch.PLACEHOLDER, "'quoted' \\\\ b", launch.TAX]
    got = rows.select(*[(wording.has("x", p) == launch.has(F.col("x"), p)).alias(f"c{i}") for i, p in enumerate(patterns)], wording.has("x", launch.SHIP_TIME).alias("s"), wording.has("x", launch.CONSENT).alias("k")).collect()
    assert all(all(r[f"c{i}"] for i in range(len(patterns))) for r in got)
    assert [r.s for r in got[:3]] == [True, True, False] and [r.k for r in got[:3]] == [False, False, True]


def test_only_sentences_with_a_topic_are_searched_for_claims(spark, monkeypatch):
    said = ["Return items within thirty days of delivery. Nothing here. No restocking fee.", "We sell lamps. Write to seven@acme.com", "Prices in RMB", "Sold by Acme Trading Ltd. Free returns.", "深圳市灯具有限公司", "退货 30天", None]
    texts = spark.createDataFrame([(i, "home", "u", x) for i, x in enumerate(said)], "site int, source string, url string, text string")
    read = lambda: sorted((r.site, r.sp, r.cp, r.topic, r.value) for r in claims.extract(texts).collect())
    got = read()
    plan = claims.extract(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Contains" in plan
    monkeypatch.setattr(claims.W, "may", lambda low, *patterns: F.lit(True))
    assert got == read() and {r[3] for r in got} == {"return_days", "return_start", "restocking_fee", "email", "currency_word", "entity", "return_payer"}


def test_launch_findings_are_softened_without_a_join(spark):
    plans = []
    facts = launch.site_facts(*cases.stores(spark.range(1, 75).withColumnRenamed("id", "c_custkey")))
    found = launch.audit(facts)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert plans[0].count("Join") == 1  # the rules, broadcast
    assert found.count() == 74 * 71 and found.where("note = 'js_home'").count() > 0
    # shapes the made-up stores lack: two texts for one policy, sold out, a drawn product page
    rows = [
        (1, 0, "home", "home", "u", "ok", "<html><body><main>x</main><footer><p>A &amp; B a&#64;b.com</p></footer></body></html>", None), (1, 1, "policy", "refund-policy", "u1", "ok", None, "No refunds."),
        (1, 2, "policy", "refund-policy", "u2", "ok", None, "Return within 30 days of delivery, contact us. " * 9), (1, 3, "pdp", "a", "u3", "ok", "<main>lamp</main>", None),
        (1, 4, "pdp", "b", "u4", "ok", "<body><script></script><div id='root'></div></body>", None),
    ]
    pages = spark.createDataFrame(rows, "site long, pos int, role string, name string, url string, result string, html string, text string")
    sites = spark.range(1, 2).selectExpr("id AS site", "'online' AS mode", "cast(null as string) AS platform", "false AS password", "true AS https_redirect", "'US' AS user_markets", "true AS ads", "'USD' AS currency", "'A' AS name", "date'2026-11-01' AS today")
    products = spark.createDataFrame([(1, "a", "t", "y", "", 1.0, False, False, False, False), (1, "b", "t", "y", "", 1.0, False, False, False, False)], "site long, handle string, title string, product_type string, tags string, price double, in_stock boolean, virtual boolean, has_plan boolean, on_sale boolean")
    f = launch.site_facts(sites, pages, products).first()
    assert (f["url_refund-policy"], f.n_sold_out, f.n_pdp, f.n_live_pdp, f.visible_contact, f.refund_final) == ("u2", 1, 1, 1, True, False)
