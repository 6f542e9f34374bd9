"""Rules, market and wording operators on literals; sinks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallyhouse import sinks
from tallyhouse.functions import answers, text
from tallyhouse.operators import markets, report_lint, sampling, tags
from tallyhouse.rules import engine, launch


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_markets(spark):
    assert value(spark, markets.parse_markets(F.lit("US, UK, de 和 澳洲; xyz"))) == ["US", "GB", "DE", "AU"]
    assert sorted(value(spark, markets.groups(F.array(F.lit("DE"), F.lit("GB"), F.lit("US"))))) == ["DE", "EU", "UK", "US"]
    assert [value(spark, markets.region_of(F.lit(x))) for x in ("en-gb", "de-DE", "es", "x-default", "en-UK")] == ["GB", "DE", None, None, "GB"]
    assert [value(spark, markets.code_problem(F.lit(x))) for x in ("de-DE", "jp", "en-uk", "x-default", "e")] == [None, "bad_language:jp->ja", "bad_region:uk->gb", None, "bad_format"]


def test_policy_wording(spark):
    said = F.array(F.lit("We offer 30 day returns."), F.lit("A restocking fee of 15% applies."), F.lit("You are responsible for return shipping."), F.lit("Orders ship in 2-3 business days."))
    assert value(spark, text.key_terms(said)) == {"return_days": "30", "restocking_fee_pct": "15", "return_shipping_paid_by": "customer", "processing_days": "2-3"}
    a, b = "Last updated 2026-01-01\n\n Returns   within 30 days. ", "Returns within 30 days."
    assert value(spark, text.policy_text(F.lit(a))) == value(spark, text.policy_text(F.lit(b)))
    assert value(spark, text.legal_names(F.lit("mail addressed to AB Dnam, LLC or by The Big Lamp Co., Ltd. today; 深圳市灯具有限公司"))) == ["AB Dnam, LLC", "Big Lamp Co., Ltd", "深圳市灯具有限公司"]
    assert value(spark, text.norm_legal(F.lit("AB Dnam, LLC"))) == "ab dnam"
    assert value(spark, text.return_windows(F.lit("Return it within 30 days. Exchange: 30 days or 14 days. " + "x " * 40 + "Refunds are processed in 10 days."))) == [30, 14]


def test_next_snapshot_id_is_free(spark):
    df = spark.createDataFrame([("s", x) for x in ("2026-01-01", "2026-01-01_3", "2026-01-011", "2026-01-02_2")], "site string, snapshot_id string")
    assert sampling.next_snapshot_id(df, "2026-01-01").first().next_id == "2026-01-01_2"
    assert sampling.next_snapshot_id(df, "2026-01-01", "-archive").first().next_id == "2026-01-01-archive"


def test_answers(spark):
    r = value(spark, answers.route(F.lit("card:60:3.5+0.30:35")))
    assert (r.provider, float(r.share), float(r.pct), float(r.fixed), float(r.withdraw_fee)) == ("card_other", 60, 3.5, 0.3, 35)
    assert value(spark, answers.route(F.lit("nonsense"))) is None and value(spark, answers.choice("entity_country", F.lit("中国大陆"))) == "CN"
    assert value(spark, answers.market_mix(F.lit("US:70, GB:30"))) == {"US": 70.0, "UK": 30.0}
    s = value(spark, answers.scenario(F.lit("Grow=paypal:40;stripe:60;plan=shopify")))
    assert (s.name, [g.provider for g in s.gateways], s.shopify_plan) == ("Grow", ["paypal", "stripe"], "grow")
    assert value(spark, answers.number("dispute_rate", F.lit("120"))) is None and value(spark, answers.yes_no(F.lit("是"))) is True


def scan(spark, *sources):
    return tags.scanned(spark.createDataFrame([(i, "homepage", s) for i, s in enumerate(sources)], "site long, key string, html string"))


def test_tags_need_code_around_them(spark):
    sources = [
        '<p>{"Tag":"https://s.pinimg.com/ct/core.js"}</p>', '<script src="https://s.pinimg.com/ct/core.js"></script>', '<script>block = "fbq|https://s.pinimg.com/ct/core.js|x"</script>',
        'webPixelsConfigList: [{"configuration":"{\\"pixel_id\\":\\"12345678901\\",\\"pixel_type\\":\\"facebook_pixel\\"}", oops', None,
        '<script>(function(){ var u = "https:\\/\\/connect.facebook.net\\/en_US\\/fbevents.js"; s.src = u; fbq("init", "123456789012"); fbq("init", "123456789012") })()</script>',
    ]
    seen = {r["site"]: r for r in scan(spark, *sources).collect()}
    names = {k: [(h["platform"], h["id"], h["kind"]) for h in r["hits"]] for k, r in seen.items()}
    assert names[0] == [] and names[1] == [("pinterest", None, "script_src")] and names[2] == [] and names[4] == []
    assert seen[3]["list"] == "undecodable" and names[3] == [("meta", "12345678901", "shopify_app_pixel")]
    assert names[5] == [("meta", "123456789012", "inline_call")] * 2 + [("meta", None, "script_src")]
    counted = {(r["site"], r["kind"]): r["n"] for r in tags.page_hits(scan(spark, *sources)).collect()}
    assert counted[(5, "inline_call")] == 2


def test_registered_pixels(spark):
    entries = [
        {"type": "APP", "apiClientId": 1780363, "configuration": json.dumps({"config": "G-AAAA1111,AW-12345678,MC-ABCD12"})}, {"type": "APP", "apiClientId": "4383523", "configuration": {"pixelCode": "C" * 20}},
        {"type": "APP", "apiClientId": 77, "configuration": json.dumps({"ti": "555"})}, {"type": "CUSTOM", "name": " Our TikTok pixel "}, {"type": "APP", "apiClientId": "shopify-pixel"}, 7, {"type": "APP", "apiClientId": 2329312, "configuration": "{}"},
    ]
    row = scan(spark, "<script>webPixelsConfigList: " + json.dumps(entries) + "; gtag('config', 'G-BBBB2222'); gtag('config', 'UA-1-1')</script><p>dataLayer GTM-ABCD12</p>").first()
    assert row["list"] == "present" and [p["platform"] for p in row["pixels"]] == ["google", "tiktok", "microsoft", "tiktok", "shopify", "meta"]
    assert [(h["platform"], h["id"], h["via"]) for h in row["hits"]] == [
        ("google_ads", "AW-12345678", "app_pixel"), ("ga4", "G-AAAA1111", "app_pixel"), ("tiktok", "C" * 20, "app_pixel"), ("microsoft", "555", "app_pixel"), ("tiktok", None, "custom_pixel"), ("meta", None, "app_pixel"),
        ("ga4", "G-BBBB2222", "theme_code"), ("gtm", "GTM-ABCD12", "theme_code"),
    ]


def test_forms_of_ids(spark):
    df = spark.createDataFrame([("meta", "YOUR_PIXEL_ID"), ("ga4", "G-1"), ("gtm", None), ("gtm", "GTM-ABCD12"), ("google_tag", "GT-XXXX"), ("reddit", "t2_a")], "p string, i string")
    assert [r[0] for r in df.select(tags.problem(F.col("p"), F.col("i"))).collect()] == ["placeholder", "bad_format", None, None, None, None]


def test_places_of_a_pattern(spark):
    said = "a1b22 a3 b444"
    got = spark.range(1).select(text.places(F.lit(said), r"\d+").alias("p")).first()["p"]
    assert [(p["at"] - 1, p["found"]) for p in got] == [(m.start(), m[0]) for m in re.finditer(r"\d+", said)]
    assert spark.range(1).select(text.places(F.lit("none"), r"\d+").alias("p")).first()["p"] == []


@pytest.mark.parametrize("said, names", [
    ("Sold by Acme Trading Ltd. and Bolt & Sons, Inc. today", ["Acme Trading Ltd", "Bolt & Sons, Inc"]), ("the Limited", []), ("A Very Long Name Of Six Words GmbH", ["Long Name Of Six Words GmbH"]), ("深圳市某某有限公司 x", ["深圳市某某有限公司"]),
    ("by The Company Limited", []), (None, []),
])
def test_company_names(spark, said, names):
    assert spark.range(1).select(text.legal_names(F.lit(said).cast("string")).alias("n")).first()["n"] == names


@pytest.mark.parametrize("said, days", [
    ("Return items within 30 days. Refunds within 30 days, exchanges 14 days.", [30, 14]), ("We process orders in 2 business days", []), ("return it in 400 days", []), ("lamps last 90 days", []), (None, []),
])
def test_return_windows(spark, said, days):
    assert spark.range(1).select(text.return_windows(F.lit(said).cast("string")).alias("n")).first()["n"] == days


@pytest.mark.parametrize("sources, flags, level", [("S1", "-", "P0"), ("S9", "-", "P1"), ("-", "exp", "P1"), ("-", "exp,p0_ok", "P0")])
def test_gravest_level_needs_verified_sources(spark, sources, flags, level):
    rules = engine.dimension(spark, f"R-1 P0 - verified {sources} {flags}", {"S1": True, "S9": False})
    facts = spark.createDataFrame([("s",)], "site string").select("site", F.array(F.lit("US")).alias("tokens"), F.lit(True).alias("ads"), F.lit(False).alias("multi"), F.lit(False).alias("paste"), F.lit(None).cast("string").alias("unread"))
    row = engine.evaluate(facts, {"R-1": engine.Verdict(F.lit("fail"))}, rules).first()
    assert (row.level, row.result, row.badge) == (level, "fail", "verified")


def test_launch_rules_on_empty_tables(spark):
    sites = spark.createDataFrame([], "site long, mode string, platform string, password boolean, https_redirect boolean, user_markets string, ads boolean, currency string, name string, today date")
    pages = spark.createDataFrame([], "site long, pos int, role string, name string, url string, result string, html string, text string")
    products = spark.createDataFrame([], "site long, handle string, title string, product_type string, tags string, price double, in_stock boolean, virtual boolean, has_plan boolean, on_sale boolean")
    assert launch.audit(launch.site_facts(sites, pages, products)).count() == 0


def test_report_structure_and_labels(spark):
    report = "# T\n## Summary\nStatus: complete\nSells 132 lamps [Verified]\nProbably good [Inferred]\nUses a JSON endpoint，ok\n## Appendix\nJSON"
    lines = report_lint.report_lines(spark.createDataFrame([("r", report), ("q", "nothing")], "report_id string, markdown string"))
    profile = report_lint.Profile(fixed_ending="The end", tech_terms=((r"JSON", "say data"),), judgment="best|great", verified="verified")
    got = {(r.report_id, r.kind) for r in report_lint.check_text(lines, profile).collect()}
    assert got == {("r", "no_ending"), ("r", "guess_no_basis"), ("r", "tech_term"), ("r", "fullwidth"), ("q", "no_summary"), ("q", "no_appendix"), ("q", "no_ending"), ("q", "no_status")}
    said = report_lint.claim_segments(lines.where("report_id = 'r'")).collect()
    assert [(r.badge, r.claim) for r in sorted(said, key=lambda r: r.ln)] == [("verified", "Sells 132 lamps"), ("inferred", "Probably good")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "=1+1", None), (1, "plain", True)], "a int, b string, c boolean")
    assert sinks.write_csvs({"one": df, "none": None}, str(tmp_path)) == ["one"]
    first = next((tmp_path / "one").glob("part-*")).read_bytes()
    assert first.startswith("﻿a,b,c".encode()) and b"'=1+1" in b"".join(p.read_bytes() for p in (tmp_path / "one").glob("part-*"))
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    events = spark.createDataFrame([("price_up",), ("sold_out",), ("theme_changed",)], "type string")
    assert {k: t.count() for k, t in sinks.event_tables(events).items()} == {"products": 1, "prices": 1, "other": 1}
