"""Product pages, store signals, links, fees, input sheets and pasted files on literals."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import fee_table, input_fields, links, product_pages, store_signals
from tallyhouse.sources import pasted


def ld(*documents):
    return "".join(f'<script type="application/ld+json">{json.dumps(d)}</script>' for d in documents)


def test_product_pages(spark):
    product = {"@type": "Product", "name": "Lamp", "offers": {"price": "10.50", "priceCurrency": "eur"}}
    pages = {
        "none": (None, None), "empty": ("h", ""), "one": ("h", ld(product)), "twice": ("h", ld(product, product)), "not json": ("h", '<script type="application/ld+json">{</script>'),
        "deep": ("h", ld({"a": {"b": [{"c": [[product]]}]}})), "too deep": ("h", ld(json.loads('{"a":' * 13 + json.dumps(product) + "}" * 13))),
        "matched twice": ("h", ld({"@type": "Product", "url": "/products/h", "offers": [{"price": 5, "priceCurrency": "USD"}, {"price": 4, "priceCurrency": "EUR"}, {"price": 9, "priceCurrency": "EUR", "availability": "OutOfStock"}]}, {"@type": "Product", "url": "/products/h#x", "name": "Second", "offers": {"price": 20, "availability": "InStock"}})),
        "bad price": ("h", '<meta property="og:price:amount" content="x"><meta property="product:price:amount" content="1,000">'), "negative": ("h", ld({"@type": "Product", "offers": {"price": -1}})),
    }
    rows = spark.createDataFrame([(k, *v) for k, v in pages.items()], "page string, handle string, html string")
    got = {r["page"]: r for r in product_pages.product_facts(rows).collect()}
    assert set(got) == {"one", "deep", "matched twice", "bad price", "negative"}
    assert (got["one"]["price"], got["one"]["currency"], got["one"]["title"], got["one"]["available"]) == (10.5, "EUR", "Lamp", None)
    both = got["matched twice"]
    assert (both["title"], both["price"], both["price_max"], both["currency"], both["available"]) == ("Second", 4, 20, "EUR", True)
    assert (got["bad price"]["price"], got["bad price"]["price_from"]) == (1000, "meta") and got["negative"]["price"] == -1
    assert product_pages.product_facts(rows.where("false")).count() == 0


def test_literals_that_overlap_and_tied_pages(spark):
    pages = spark.createDataFrame([(1, 0, "a", "KLAVIYO.com"), (1, 1, "b", "klaviyo"), (2, 0, "a", None), (1, 0, "a", "KLAVIYO.com")], "site long, pos int, source string, html string")
    assert [tuple(r) for r in store_signals.store_signals(pages).collect()] == [(1, "app", "Klaviyo", "klaviyo.com", "a", 1)]
    assert store_signals.store_signals(pages.where("false")).count() == 0


def test_links_stay_on_the_site(spark):
    html = '<a href="#x">a</a><a href="//www.s.example/a">b</a><a href="http://S.example:80/b?x">c</a><a href="https://s.example.org/">d</a><a href="javascript:0">e</a><a href="c">f <b>g</b></a>'
    found = spark.range(1).select(links.page_links(F.lit(html), F.lit("s.example")).alias("l")).first()["l"]
    assert [(a["href"], a["text"]) for a in found] == [("https://www.s.example/a", "b"), ("http://S.example:80/b?x", "c"), ("c", "f g")]


def test_a_walk_ends_and_keeps_the_shortest_way(spark):
    edges = [("s", "/a", "/b"), ("s", "/b", "/c"), ("s", "/c", "/a"), ("s", "/a", "/c"), ("t", "/a", "/z")]
    graph = spark.createDataFrame(edges, "site string, path string, target string")
    seeds = spark.createDataFrame([("s", "/a"), ("s", "/a")], "site string, path string")
    assert sorted(map(tuple, links.reached(graph, seeds).collect())) == [("s", "/a", 0), ("s", "/b", 1), ("s", "/c", 1)]
    assert links.reached(graph, seeds.where("false")).count() == 0


def test_fees_as_of_a_day(spark):
    text = """old payment p US * 1 0.1 USD verified 2026-01-01
        new payment p US * 2 0.2 USD conflict 2026-03-01
        draft payment p EU-* * 3 0.3 EUR unverified 2026-01-01
        all payment p * * 4 0.4 USD verified 2026-01-01"""
    table = fee_table.fee_table(spark, text)
    day = datetime.date
    asks = [(1, "p", "US", None, "USD", day(2026, 2, 1)), (2, "p", "US", "basic", "USD", day(2026, 3, 1)), (3, "p", "EU-DE", "basic", "EUR", day(2026, 3, 1)), (4, "p", "JP", "x", "USD", day(2026, 12, 1)), (5, "p", "US", None, "EUR", day(2026, 2, 1)), (6, "p", "US", None, "USD", day(2025, 1, 1)), (7, None, None, None, None, None)]
    asked = spark.createDataFrame(asks, "key int, provider string, market string, plan string, currency string, day date")
    got = {r["key"]: (r["entry"], r["badge"], r["stale"]) for r in fee_table.payment_fees(asked, table).collect()}
    assert got == {1: ("old", "verified", None), 2: ("new", "conflicting", None), 4: ("all", "inferred", "downgrade")}


@pytest.mark.parametrize("item, value, want", [
    ("PRICE (x)", "5", ("price", 5.0, None, None)), ("price x", "-5", ("price", -5.0, None, "negative")), ("nothing", "5", (None, None, None, "unknown_field")), ("Market", "eu-fr", ("market", None, "EU-FR", None)), ("market", " ", ("market", None, None, None)), (None, None, (None, None, None, "unknown_field")),
])
def test_input_fields(spark, item, value, want):
    fields = spark.createDataFrame([("price", "money", "Price_X", 1), ("other", "text", "price x", 2), ("market", "market", "market", 3)], "key string, kind string, name string, ord int")
    choices = spark.createDataFrame([("market", "US", "us", 1)], "field string, choice string, name string, ord int")
    rows = spark.createDataFrame([(1, 1, item, value)], "product int, line int, item string, value string")
    r = input_fields.read_fields(rows, fields, choices).first()
    assert (r["key"], r["number"] and float(r["number"]), r["choice"], r["issue"]) == want


def test_pasted_files_and_roles(spark):
    rows = [("s", "b-refund.txt", b"x"), ("s", "a-returns.txt", "退货".encode("gb18030")), ("s", "x.txt", None), ("s", "y.pdf", b"%PDF")]
    got = {r["name"]: (r["key"], r["result"]) for r in pasted.pasted_files(spark.createDataFrame(rows, "site string, name string, content binary")).collect()}
    assert got == {"a-returns.txt": ("policy:refund-policy", "ok"), "b-refund.txt": ("page:b-refund.txt", "ok"), "x.txt": ("page:x.txt", "error"), "y.pdf": ("skipped", "skipped")}
    paths = ["homepage.html", "policies/x.page.html", "markets/de/product.js", "robots.txt", "pages/hilfe.html", "z.html", "_status.json"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i")
    roles = [r[0] and tuple(r[0]) for r in df.select(pasted.file_role(F.col("p"))).collect()]
    assert roles == [("home", None, None, None), ("policy", "x", None, None), ("market_product", None, None, "de"), ("robots", None, None, None), ("page", None, "faq", None), ("page", None, "other", None), None]
