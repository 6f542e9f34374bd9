"""Scalar functions on literals."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import dates, evidence, html, money, text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def of(spark, function, given, *more, kind="string"):
    return value(spark, function(F.lit(given).cast(kind), *more))


@pytest.mark.parametrize(
    "function, given, want",
    [
        (money.cents_half_up, "2.345", Decimal("2.35")), (money.cents_half_up, "-2.345", Decimal("-2.35")), (money.cents_half_even, "2.345", Decimal("2.34")),
        (money.cents_up, "2.341", Decimal("2.35")), (money.cents_down, "2.349", Decimal("2.34")), (money.charm_price, "20.00", Decimal("20.99")),
        (money.cents_half_up, None, None), (money.ceil_int, "3.01", 4),
    ],
)
def test_rounding_direction(spark, function, given, want):
    assert of(spark, function, given) == want


def test_amounts_from_text(spark):
    assert of(spark, money.strict_money, "1,234.50") == 1234.5
    assert of(spark, money.strict_money, "about 5") is None
    assert of(spark, money.to_float, "") is None and of(spark, money.to_float, "12.5") == 12.5
    assert of(spark, money.csv_safe, "=1+1").startswith("'") and of(spark, money.csv_safe, "plain") == "plain"


def test_dates(spark):
    assert of(spark, dates.month_key, "2024-03-31T23:59:59-05:00") == "2024-03"
    assert of(spark, dates.month_add, "2024-11", 3) == "2025-02"
    assert value(spark, dates.iso_week(F.to_timestamp(F.lit("2021-01-03")))) == "2020-W53"
    assert of(spark, dates.parse_time, "not a time") is None
    assert value(spark, dates.stale(F.lit(None).cast("string"), F.current_date())) is None


def test_urls(spark):
    assert of(spark, urls.host_of, "https://User@Shop.Example.com:8443/a?b") == "shop.example.com"
    assert of(spark, urls.product_handle, "https://x.example/collections/all/products/blue-mug?variant=1") == "blue-mug"
    assert of(spark, urls.registrable_domain, "www.shop.example.co.uk") == "example.co.uk"
    assert of(spark, urls.norm_url, "https://www.x.example/a/#top") == of(spark, urls.norm_url, "http://x.example/a")
    assert of(spark, urls.query_param, "https://x.example/?a=1&page=3", "page") == "3"
    assert of(spark, urls.host_of, "no url") is None


PAGE = """<!doctype html><html lang="en-GB"><head><title> A  &amp; B </title><meta name="robots" content="noindex"><link rel="canonical" href="/c">
<link rel="alternate" hreflang="fr" href="/fr"><script type="application/ld+json">{"@type": "Product", "name": "Mug", "offers": [{"@type": "Offer", "price": "5"}]}</script>
</head><body><nav><a href="/n">News</a></nav><main><p>Hello <b>there</b></p><script>var no = 1;</script></main><footer>Foot</footer></body></html>"""


def test_html(spark):
    assert of(spark, html.html_lang, PAGE) == "en-GB" and of(spark, html.canonical, PAGE) == "/c"
    assert of(spark, html.noindex, PAGE) == "noindex" and of(spark, html.noindex, "<p>") is None and of(spark, html.is_html, PAGE) is True
    assert [(x.href, x.text) for x in of(spark, html.links, PAGE)] == [("/n", "News")]
    assert [(x.code, x.href) for x in of(spark, html.hreflang, PAGE)] == [("fr", "/fr")]
    said = of(spark, html.to_text, PAGE)
    assert "Hello there" in said and "var no" not in said
    assert of(spark, html.title, None) is None and of(spark, html.links, None) == []


def test_text(spark):
    assert of(spark, text.clean_line, "  a  \t b\n") == "a b"
    assert of(spark, text.emails, "Write to Me@Shop.example or me@shop.example, not icon@2x.png") == ["me@shop.example"]
    assert of(spark, text.sentences, "One. Two! Three?\nFour") == ["One.", "Two!", "Three?", "Four"]
    assert of(spark, text.norm_title, "  Blue--Mug! ") == "blue mug"
    assert of(spark, text.day_counts, "30 days, 30 days or 14 days, 999 days") == [30, 14]
    assert of(spark, text.english_share, "short") is None
    assert of(spark, text.read_utf8, b"\xef\xbb\xbfok", kind="binary") == "ok"


def test_evidence_is_as_strong_as_its_weakest_input(spark):
    names = [r[0] for r in evidence.badge_dimension(spark).select("badge").collect()]
    df = spark.createDataFrame([(b,) for b in names], "b string")
    ranks = {r.b: r.k for r in df.select("b", evidence.badge_rank("b").alias("k")).collect()}
    for a in names:
        for b in names:
            got = value(spark, evidence.weakest_of(F.array(F.lit(a), F.lit(b))))
            assert got == min((a, b), key=ranks.get)
    assert df.limit(0).agg(evidence.weakest("b").alias("w")).first().w is None
    states = lambda *s: spark.createDataFrame([(x,) for x in s], "s string").agg(evidence.combine_status("s").alias("w")).first().w
    assert (states("failed", "failed"), states("complete", "complete"), states("complete", "failed")) == ("failed", "complete", "partial")
