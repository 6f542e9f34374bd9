"""What page sources tell of a store: apps, tags, frameworks, theme, shop facts,
and what registries outside it say.

All literals of all signatures are found in one pass over each source, by one
automaton for each worker; the number of signatures does not change the number of
passes. Which signature a literal belongs to, and which source and literal count
first, are joins and aggregates on the few literals found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html

#: Signatures (kind, name, literals in lower case), in their order.
SIGNATURES = """
app|Judge.me|judge.me|judgeme
app|Yotpo|staticw2.yotpo.com|cdn-widgetsrepository.yotpo.com|yotpo.com
app|Okendo|okendo.io|okendo-reviews
app|Loox|loox.io|loox-rating
app|Stamped.io|stamped.io
app|Reviews.io|reviews.io|reviewsio
app|Junip|junip.co
app|Klaviyo|klaviyo.com|klaviyo
app|Omnisend|omnisnippet|omnisend.com
app|Attentive|attn.tv|attentivemobile
app|Postscript|postscript.io
app|Privy|privy.com|widget.privy
app|Gorgias|gorgias.chat|gorgias.io|gorgias
app|Tidio|tidio.co|tidiochat
app|Zendesk|zdassets.com|zendesk.com
app|Intercom|widget.intercom.io|intercomcdn
app|Rebuy|rebuyengine.com
app|ReCharge|rechargecdn.com|rechargepayments.com|rechargeapps.com
app|Afterpay|afterpay.com|afterpay-placement|static.afterpay
app|Klarna|klarna.com|klarnaservices.com|klarna-placement
app|Shop Pay Installments|shopify-payment-terms|shop_pay_installments
app|Affirm|affirm.com/js|cdn1.affirm.com
app|Smile.io|smile.io|smile-ui
app|LoyaltyLion|loyaltylion
app|Yotpo Loyalty (Swell)|swellrewards|loyalty.yotpo.com
app|PageFly|pagefly
app|GemPages|gempages|gem-page
app|Shogun|getshogun.com|shogun-frontend
app|Weglot|weglot.com|cdn.weglot
app|Langify|langify
app|Bold|boldcommerce.com|boldapps.net
app|Hotjar|static.hotjar.com
app|Lucky Orange|luckyorange
app|Elevar|getelevar.com
app|Triple Whale|triplewhale|triple-pixel
app|Searchanise|searchanise
app|Boost Commerce|boostcommerce|bc-sf-filter
app|Globo / Geolocation apps|globo.io
app|Route|routeapp.io|route-widget
tracking|meta_pixel|connect.facebook.net|fbq(
tracking|tiktok_pixel|analytics.tiktok.com
tracking|ga4|gtag/js?id=g-|gtag('config', 'g-|gtag("config", "g-
tracking|google_ads|gtag/js?id=aw-|'aw-|"aw-
tracking|gtm|googletagmanager.com/gtm.js|gtm-
tracking|pinterest_tag|s.pinimg.com/ct/core.js|pintrk(
tracking|snap_pixel|sc-static.net/scevent|snaptr(
tracking|klaviyo|static.klaviyo.com|klaviyo.js
tracking|microsoft_uet|bat.bing.com
tracking|reddit_pixel|redditstatic.com/ads|rdt(
framework|next.js|__next_data__|/_next/static/
framework|hydrogen|@shopify/hydrogen|hydrogen-|oxygen-v2
framework|remix|__remixcontext|window.__remix
framework|nuxt|__nuxt__|/_nuxt/
framework|gatsby|___gatsby
"""
LOCALIZATION = r"id=[\"']localization_form|action=[\"'][^\"']*/localization[\"']"
THEME_FIELDS, THEME_NUMBERS = ("name", "schema_name", "schema_version", "role"), ("theme_store_id", "id")


def signature_rows(text: str = SIGNATURES) -> list[tuple[str, str, int, str, int]]:
    """(kind, name, place of the signature, literal, place of the literal)."""
    lines = [line.split("|") for line in text.strip().splitlines()]
    return [(kind, name, i, literal, j) for i, (kind, name, *literals) in enumerate(lines) for j, literal in enumerate(literals)]


_automata: dict[tuple, object] = {}


def found_literals(source: Column, literals: list[str]) -> Column:
    """Distinct literals that lower-cased source holds, overlapping ones too."""
    wanted = tuple(sorted(set(literals)))

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if wanted not in _automata:
            import ahocorasick

            made = ahocorasick.Automaton()
            for literal in wanted:
                made.add_word(literal, literal)
            made.make_automaton()
            _automata.clear()
            _automata[wanted] = made
        walk = _automata[wanted].iter
        for texts in batches:
            yield pd.Series([sorted({literal for _, literal in walk(t.lower())}) if t else [] for t in texts], dtype=object)

    return find(source)


def store_signals(pages: DataFrame, signatures: str = SIGNATURES) -> DataFrame:
    """site, kind, name, pattern, source, ord: each signature that any of a site's
    ``pages`` (site, pos, source, html) shows, with the first page that does and
    the first literal found there; ``ord`` ranks those of a kind by first sight.

    The table of literals is a parameter of some hundreds of rows at most, which
    bounds what is broadcast; empty pages and unknown literals give no rows.
    """
    rows = signature_rows(signatures)
    known = F.broadcast(pages.sparkSession.createDataFrame(rows, "kind string, name string, place int, literal string, at int"))
    seen = pages.select("site", "pos", "source", F.explode(found_literals(F.col("html"), [r[3] for r in rows])).alias("literal"))
    first = seen.join(known, "literal").groupBy("site", "kind", "name").agg(F.min(F.struct("pos", "place", "at", F.col("literal").alias("pattern"), "source")).alias("f"))
    ranked = first.withColumn("rank", F.struct("f.pos", "f.place"))
    # a site has at most as many rows as there are signatures
    order = F.row_number().over(Window.partitionBy("site", "kind").orderBy("rank"))
    return ranked.select("site", "kind", "name", "f.pattern", "f.source", order.alias("ord"))


def localization_selector(pages: DataFrame) -> DataFrame:
    """site, localization_selector: present or not_observed."""
    shown = F.bool_or(F.lower(F.coalesce("html", F.lit(""))).rlike(LOCALIZATION))
    return pages.groupBy("site").agg(F.when(shown, "present").otherwise("not_observed").alias("localization_selector"))


def theme(source: Column) -> Column:
    """struct(name, schema_name, schema_version, theme_store_id, role, id, source)
    of the theme a home page names: its object where that is valid JSON, else its
    members by their wording; without one the source is not_observed."""
    src = F.coalesce(source, F.lit(""))
    block = F.regexp_extract(src, r"(?s)Shopify\.theme\s*=\s*\{(.*?)\};", 1)
    parsed = html.json_after(src, F.lit(r"Shopify\.theme\s*=\s*(?=\{)"))
    worded = {k: F.regexp_extract(block, rf'"?\b{k}"?\s*:\s*"([^"]*)"', 1) for k in THEME_FIELDS} | {k: F.regexp_extract(block, rf'"?\b{k}"?\s*:\s*(\d+)', 1) for k in THEME_NUMBERS}

    def member(k: str) -> Column:
        value = F.when(parsed.isNotNull(), F.get_json_object(parsed, f"$.{k}")).otherwise(F.nullif(worded[k], F.lit("")))
        return (value.try_cast("long") if k in THEME_NUMBERS else value).alias(k)

    named = F.when(parsed.isNotNull() | (block != ""), "Shopify.theme").otherwise("not_observed")
    return F.struct(*[member(k) for k in ("name", "schema_name", "schema_version", "theme_store_id", "role", "id")], named.alias("source"))


def shop(meta: Column, home: Column) -> Column:
    """struct of shop facts: the store's own meta file (JSON text), and where it is
    silent its home page; every fact from the page says that it may be local to
    the visitor."""
    said = lambda k: F.nullif(F.get_json_object(meta, f"$.{k}"), F.lit(""))
    src = F.coalesce(home, F.lit(""))
    page = lambda p: F.nullif(F.regexp_extract(src, p, 1), F.lit(""))
    domain, country = page(r'Shopify\.shop\s*=\s*"([^"]+)"'), page(r'Shopify\.country\s*=\s*"([A-Z]{2})"')
    currency = F.nullif(F.get_json_object(html.json_after(src, F.lit(r"Shopify\.currency\s*=\s*(?=\{)")), "$.active"), F.lit(""))
    own = F.get_json_object(meta, "$").isNotNull()
    number = lambda k: said(k).try_cast("long")
    return F.struct(
        said("name").alias("name"), said("id").alias("shop_id"), F.coalesce(said("myshopify_domain"), domain).alias("myshopify_domain"), F.coalesce(said("currency"), currency).alias("currency"),
        F.coalesce(said("country"), country).alias("country"), F.size(F.from_json(F.get_json_object(meta, "$.ships_to_countries"), "array<string>")).alias("ships_to_count"),
        number("published_products_count").alias("published_products_count"), number("published_collections_count").alias("published_collections_count"),
        F.when(own, "meta.json").when(domain.isNotNull(), "homepage").alias("source"),
        F.when(said("currency").isNull() & currency.isNotNull(), "homepage_Shopify.currency (may be localized)").alias("currency_source"),
        F.when(said("country").isNull() & country.isNotNull(), "homepage_Shopify.country (visitor market)").alias("country_source"),
    )


def registration(rdap: Column) -> Column:
    """struct(registered, expires, registrar) of a registry's answer (JSON text);
    the last event of a kind counts."""
    v = F.try_parse_json(rdap)
    events = F.coalesce(F.try_variant_get(v, "$.events", "array<struct<eventAction:string,eventDate:string>>"), F.array().cast("array<struct<eventAction:string,eventDate:string>>"))
    dated = lambda kind: F.nullif(F.substring(F.try_element_at(F.filter(events, lambda e: F.lower(e["eventAction"]) == kind), F.lit(-1))["eventDate"], 1, 10), F.lit(""))
    entities = F.coalesce(F.try_variant_get(v, "$.entities", "array<variant>"), F.array().cast("array<variant>"))
    is_registrar = lambda e: F.array_contains(F.try_variant_get(e, "$.roles", "array<string>"), "registrar")
    cards = F.flatten(F.transform(F.filter(entities, is_registrar), lambda e: F.coalesce(F.try_variant_get(e, "$.vcardArray[1]", "array<variant>"), F.array().cast("array<variant>"))))
    names = F.filter(cards, lambda c: F.try_variant_get(c, "$[0]", "string") == "fn")
    return F.struct(dated("registration").alias("registered"), dated("expiration").alias("expires"), F.try_variant_get(F.try_element_at(names, F.lit(-1)), "$[3]", "string").alias("registrar"))


def captures(archive: DataFrame) -> DataFrame:
    """site, first_capture (year-month), captures_by_year of an archive's index:
    ``archive`` (site, content: JSON rows that begin with a time stamp). Rows without
    a stamp, such as the header, count for nothing."""
    rows = F.from_json("content", "array<array<string>>")
    stamps = archive.select("site", F.explode(F.transform(rows, lambda r: F.get(r, F.lit(0)))).alias("stamp")).where(F.col("stamp").rlike(r"^\d{8,14}$"))
    years = stamps.groupBy("site", F.substring("stamp", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("stamp").alias("first"))
    first = F.min("first")
    return years.groupBy("site").agg(F.concat_ws("-", F.substring(first, 1, 4), F.substring(first, 5, 2)).alias("first_capture"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "n")))).alias("captures_by_year"))


def offsite(rdap: DataFrame, archive: DataFrame) -> DataFrame:
    """One row for each site either registry knows: registered, expires, registrar,
    first_capture, captures_by_year, and ``conflict`` where the archive saw the
    site before its registration (the name had an earlier owner)."""
    known = rdap.select("site", registration(F.col("content")).alias("r")).select("site", "r.*").groupBy("site").agg(*[F.max(c).alias(c) for c in ("registered", "expires", "registrar")])
    both = known.join(captures(archive), "site", "full")
    early = F.col("first_capture") < F.substring("registered", 1, 7)
    return both.withColumn("conflict", F.when(F.col("first_capture").isNotNull() & F.col("registered").isNotNull(), early))
