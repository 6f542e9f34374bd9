"""Tracking audit: platform tags, duplicates, purchase and server events, privacy
hints of a store's pages, tag containers and what its owner told.

Inputs: ``sites`` (site, mode: own or other), ``pages`` (site, key: homepage,
collection, product, cart, privacy; result, html), ``containers`` (site,
container, text), ``answers`` (site, ad_platforms array or null, uses_klaviyo)
and ``proofs`` (site, item, source: screenshot or said, ok, ids map or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import tags as T
from ..plans.staging import cut
from .engine import choose

#: The check of each platform's tag, those that weigh high when
#: the platform is advertised on, the proofs that settle a check.
TAG_CHECKS = {"T01": "meta", "T02": "ga4", "T04": "google_ads", "T05": "tiktok", "T06": "pinterest", "T07": "snap", "T08": "klaviyo"}
HIGH = ("T01", "T04", "T05", "T06")
PURCHASE_PROOF = {"ga4": "U1-d", "meta": "U1-c", "tiktok": "U1-f"}
PROOF = {"D05": "U1-g", "D06": "U1-a", "C02": "U1-a", "S01": "U1-b", "S02": "U1-c", "S03": "U1-f", "S04": "U1-e", "S05": "U1-i"}
SERVER = (
    ("C02", ("meta", "ga4", "google_ads", "tiktok"), "medium", "all"), ("S01", ("meta",), "high", "meta"), ("S02", ("meta",), "high", "meta"), ("S03", ("tiktok",), "high", "tiktok"),
    ("S04", ("google_ads", "google_tag"), "medium", "google_ads"), ("S05", ("pinterest", "snap"), "medium", "all"),
)
MULTI = ("meta", "ga4", "google_ads", "tiktok", "pinterest", "snap", "gtm")
NAMED = ("meta", "ga4", "google_ads", "tiktok", "pinterest", "snap", "klaviyo", "microsoft", "reddit")


KEYS = ("homepage", "collection", "product", "cart", "privacy")
ADVERTISING, OPT_OUT_SAID = r"(?i)advertis|interest-based|targeted ads|remarketing", r"(?i)opt[- ]?out|do not sell|your privacy choices"


def hits_of(pages: DataFrame, containers: DataFrame) -> DataFrame:
    """All hits of pages and containers, each page scanned once (written to the
    shared folder)."""
    seen = cut(T.scanned(pages).select("site", "key", "hits"), "scans")
    return T.page_hits(seen).unionByName(T.container_hits(containers))


def page_flags(pages: DataFrame) -> DataFrame:
    """One row for each page with its hits and what the checks ask of its source,
    each pattern searched only in the pages that count for it; the source itself
    goes no further."""
    key, src = F.col("key"), F.coalesce("html", F.lit(""))
    home, private = key == "homepage", key == "privacy"
    rows = T.scanned(pages).withColumn("_plain", html.strip_tags(F.when(private, src)))
    said = lambda p: F.col("_plain").rlike(p)
    markers = F.array_compact(F.array(*[F.when(F.contains(src, F.lit(m)), F.lit(m)) for m in T.MARKERS]))
    named = F.array_compact(F.array(*[F.when(said(p), F.lit(n)) for n, p in T.PLATFORM_WORDS.items()]))
    return rows.select(
        "site", "key", "result", "hits", "pixels", "list", (src != "").alias("filled"), F.when(home, T.blocked(src)).alias("home_blocked"), F.when(home, markers).alias("markers"), F.when(home, T.other_platform(src)).alias("other"), F.when(home, T.regions(src)).alias("regions"),
        F.when(private, said(ADVERTISING)).alias("advertising"), F.when(private, said(OPT_OUT_SAID)).alias("opt_out_said"), F.when(private, named).alias("named"), T.consent_marks(src).alias("marks"),
    )


def by_id(hits: DataFrame) -> DataFrame:
    """One row for each site, platform, id and problem: install paths, confirmed,
    badge, whether it is ``doubled`` (a good id that is loaded by two paths, or twice
    by calls in one page), whether a container holds it."""
    counted = F.when(~((F.col("via") == "google_tag_script") | ((F.col("platform") == "klaviyo") & (F.col("via") == "app_pixel"))), F.col("via"))
    twice = (F.col("n") > 1) & (F.col("via") == "theme_code") & F.col("kind").isin("inline_call", "inline_snippet")
    out = hits.groupBy("site", "platform", "id", "problem").agg(
        F.array_sort(F.collect_set("via")).alias("install_via"), F.bool_or("calibrated").alias("calibrated"), F.collect_set(counted).alias("vias"), F.bool_or(twice).alias("repeated"),
        F.max(F.col("via").isin("gtm_container", "google_tag_script")).alias("inside"),
    )
    good = F.col("problem").isNull() & F.col("id").isNotNull() & (F.col("platform") != "gtm")
    return out.select("*", F.when(F.col("calibrated"), "on_page").otherwise("inferred").alias("badge"), (good & ((F.size("vias") >= 2) | F.col("repeated"))).alias("doubled"))


def facts(sites: DataFrame, pages: DataFrame, containers: DataFrame, answers: DataFrame, proofs: DataFrame) -> DataFrame:
    """One row for each site with what the checks ask for, written once."""
    seen = cut(page_flags(pages), "scans")
    key, result = F.col("key"), F.col("result")
    home = key == "homepage"
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    inside = containers.select("site", T.consent_marks(F.coalesce("text", F.lit(""))).alias("marks"))
    marked = ("consent_default", "consent_v2", "opt_out", "legacy")
    by_site = seen.drop("hits").unionByName(inside, allowMissingColumns=True).groupBy("site").agg(
        any_(home & F.col("filled")).alias("has_home"), any_(F.col("home_blocked")).alias("home_blocked"), F.first("markers", ignorenulls=True).alias("markers"),
        F.max("other").alias("other"), F.array_sort(F.collect_set(F.when(result == "blocked", key))).alias("blocked"), F.first("regions", ignorenulls=True).alias("regions"),
        any_((key == "privacy") & F.col("filled")).alias("has_privacy"), any_((key == "product") & F.col("filled")).alias("has_product"), F.max(F.when(home, result)).alias("home_result"),
        any_(F.col("advertising")).alias("advertising"), any_(F.col("opt_out_said")).alias("opt_out_said"), F.flatten(F.collect_list("named")).alias("named"),
        F.min_by("pixels", F.when(F.size("pixels") > 0, F.array_position(F.array(*[F.lit(k) for k in KEYS]), key))).alias("pixels"), any_(F.col("list") != "not_observed").alias("pixel_list"),
        *[any_(F.col(f"marks.{m}")).alias(m) for m in marked], F.array_distinct(F.flatten(F.collect_list("marks.tools"))).alias("tools"),
    )
    good = F.col("problem").isNull()
    twice = (F.col("platform") == "ga4") & F.array_contains("install_via", "gtm_container") & F.arrays_overlap("install_via", F.array(*[F.lit(v) for v in ("theme_code", "app_pixel", "google_tag_script")]))
    per_tag = by_id(T.page_hits(seen).unionByName(T.container_hits(containers))).groupBy("site").agg(
        F.collect_list(F.when(good, F.struct("platform", "id", "install_via", "calibrated", "badge"))).alias("tags"), any_(good & twice).alias("ga4_twice"),
        F.array_sort(F.collect_list(F.when(F.col("doubled"), F.concat_ws(":", "platform", "id")))).alias("doubled"), F.collect_list(F.when(~good, F.struct("platform", "id", "problem", "inside"))).alias("malformed"),
    )
    told = proofs.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct("source", "ok", "ids")))).alias("proofs"))
    out = sites
    for part in (by_site, per_tag, answers, told):
        out = out.join(part, "site", "left")
    flags = [f.name for f in out.schema if f.dataType.simpleString() == "boolean"]
    return cut(out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags}), "tag-facts")


def _row(cid: str, cond: Column, result, badge, severity, platform="all", note=None) -> Column:
    lit = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    made = F.struct(lit(cid).alias("check"), lit(platform).alias("platform"), lit(result).alias("result"), lit(badge).alias("badge"), lit(severity).alias("severity"), lit(note).alias("note"))
    return F.when(F.coalesce(cond, F.lit(False)), made)


NONE = "array<string>"
PER_PLATFORM = tuple(dict.fromkeys((*TAG_CHECKS.values(), *MULTI)))
PROOF_ITEMS = tuple(dict.fromkeys((*PROOF.values(), *PURCHASE_PROOF.values())))


def _shared(c) -> Column:
    """What many checks ask of a site's facts, as one struct, worked out once."""
    none = F.array().cast(NONE)
    tags = F.coalesce("tags", F.array().cast("array<struct<platform:string,id:string,install_via:array<string>,calibrated:boolean,badge:string>>"))
    seen = F.array_distinct(F.transform(tags, lambda t: t["platform"]))
    markers = F.size(F.coalesce("markers", none))
    ident = choose((~c("has_home") | c("home_blocked"), "unknown"), (markers >= 2, "confirmed"), (markers == 1, "probable"), otherwise="not_shopify")
    pixels = F.filter(F.coalesce("pixels", F.array().cast("array<struct<type:string,app:string,name:string,platform:string>>")), lambda x: ~x["platform"].eqNullSafe(F.lit("shopify")))

    def own(t: Column) -> Column:
        ids = F.array_compact(F.transform(t, lambda x: x["id"]))
        return F.struct((F.size(t) > 0).alias("found"), F.exists(t, lambda x: x["calibrated"]).alias("sure"), F.forall(t, lambda x: x["calibrated"]).alias("all_sure"), ids.alias("ids"))

    of = [text.let(F.filter(tags, lambda t: t["platform"] == p), own).alias(p) for p in PER_PLATFORM]  # noqa: B023
    proof = [F.try_element_at("proofs", F.lit(i)).alias(i) for i in PROOF_ITEMS]
    return F.struct(
        seen.alias("seen"), F.array_union(seen, F.coalesce("ad_platforms", none)).alias("named"), ident.alias("ident"), pixels.alias("pixels"), F.struct(*of).alias("of"), F.struct(*proof).alias("proof"),
    )


def findings(f: DataFrame) -> DataFrame:
    """site, check, platform, result, badge, severity, note."""
    # every site has at least the row of G02; an inner explode would work all of them out twice, to drop sites without
    return f.select("site", F.explode_outer(text.let(_shared(F.col), _findings)).alias("x")).select("site", "x.*")


def _findings(v: Column) -> Column:
    """The array of a site's findings, by its facts and what is shared of them."""
    c, true = F.col, F.lit(True)
    none = F.array().cast(NONE)
    seen, ident, pixels = v["seen"], v["ident"], v["pixels"]
    of = lambda p: v["of"][p]
    has = lambda *p: F.arrays_overlap(seen, F.array(*[F.lit(x) for x in p]))
    ads = c("ad_platforms")
    asked = ads.isNotNull()
    store = ident.isin("confirmed", "probable")
    own = c("mode") == "own"
    proof = lambda item: v["proof"][item]

    def told(item, platform=None):
        """(given, result, badge) of a proof; ids of a screenshot that none of the
        page's ids equals make it conflicting."""
        p = proof(item)
        given = own & p["source"].isin("screenshot", "said")
        result = F.when(p["ok"], "pass").when(~p["ok"], "issue").otherwise("needs_input")
        clash = F.lit(False)
        if platform:
            shown = F.coalesce(F.flatten(F.map_values(p["ids"])), none)
            mine = of(platform)["ids"]
            clash = (F.size(shown) > 0) & (F.size(mine) > 0) & ~F.arrays_overlap(shown, mine)
        return given, result, F.when(p["source"] == "said", "self_claim").when(clash, "conflicting").otherwise("verified")

    rows = [
        _row("G01", ident == "unknown", "needs_input", "not_found", "none", note=ident), _row("G01", ident != "unknown", "pass", F.when(ident == "confirmed", "on_page").otherwise("inferred"), "none", note=F.when(store, ident).otherwise(F.coalesce("other", ident))),
        _row("G02", true, F.when(F.size(F.coalesce("blocked", none)) > 0, "issue").otherwise("pass"), F.when(F.size(F.coalesce("blocked", none)) > 0, "not_found").otherwise("on_page"), F.when(F.size(F.coalesce("blocked", none)) > 0, "medium").otherwise("none"), note=F.nullif(F.array_join(F.coalesce("blocked", none), ","), F.lit(""))),
    ]
    for cid, p in TAG_CHECKS.items():
        found = of(p)["found"]
        by_google = has("google_tag") if p in ("ga4", "google_ads") else F.lit(False)
        # a screenshot that shows this platform's ids settles the badge
        shows = lambda k: (F.try_element_at("proofs", k)["source"] == "screenshot") & (F.size(F.coalesce(F.try_element_at(F.try_element_at("proofs", k)["ids"], F.lit(p)), none)) > 0)  # noqa: B023, E731
        shot = F.try_element_at("proofs", F.try_element_at(F.array_sort(F.filter(F.coalesce(F.map_keys("proofs"), none), shows)), F.lit(1)))
        mine = of(p)["ids"]
        unlike = lambda t, mine=mine: (F.size(mine) > 0) & ~F.arrays_overlap(F.flatten(F.map_values(t["ids"])), mine)
        badge = text.let(shot, lambda t: F.when(t.isNotNull(), F.when(unlike(t), "conflicting").otherwise("verified")).when(of(p)["sure"], "on_page").otherwise("inferred"))  # noqa: B023
        advertised = F.array_contains(ads, p)
        weight = choose((F.lit(p == "klaviyo") & asked & c("uses_klaviyo"), "medium"), (~asked, "low" if cid in HIGH else "none"), (advertised, "high" if cid in HIGH else "medium"), otherwise="none")
        rows += [_row(cid, found, "pass", badge, "none", p), _row(cid, ~found & by_google, "pass", "inferred", "none", p, "google_tag"), _row(cid, ~found & ~by_google, "not_seen", "not_found", weight, p)]
    n_gtm = F.size(of("gtm")["ids"])
    count = lambda kind: F.size(F.filter(pixels, lambda x: x["type"] == kind)).cast("string")
    given_a, result_a, badge_a = told("U1-a")
    shown_a = F.coalesce(proof("U1-a")["source"].isin("screenshot", "said"), F.lit(False))
    rows += [
        _row("T03", ~of("gtm")["found"], "not_seen", "not_found", "none", "gtm"), _row("T03", of("gtm")["found"], F.when(n_gtm > 1, "issue").otherwise("pass"), "on_page", F.when(n_gtm > 1, "low").otherwise("none"), "gtm", n_gtm),
        _row("T09", ~store, "na", None, "none", "shopify"), _row("T09", store & ~c("pixel_list"), "not_seen", "not_found", "none", "shopify"), _row("T09", store & c("pixel_list"), "pass", F.when(shown_a, badge_a).otherwise("on_page"), "none", "shopify", F.concat_ws("+", count("APP"), count("CUSTOM"))),
    ]
    malformed = F.coalesce("malformed", F.array().cast("array<struct<platform:string,id:string,problem:string,inside:boolean>>"))
    reached = F.when(has("google_tag"), F.array_union(seen, F.array(F.lit("google_ads"), F.lit("ga4")))).otherwise(seen)
    gap = F.filter(ads, lambda p: p.isin(*T.AD_PLATFORMS) & ~F.array_contains(reached, p))
    doubled = F.coalesce("doubled", none)
    rows += [
        _row("T10", F.size(malformed) == 0, "pass", "on_page", "none"),
        _row("T11", ~asked & own, "needs_input", "not_found", "none"), _row("T11", asked & (F.size(gap) > 0), "issue", "inferred", "high", note=F.array_join(F.array_sort(gap), ",")), _row("T11", asked & (F.size(gap) == 0), "pass", "inferred", "none"),
        _row("D01", F.size(doubled) == 0, "pass", "on_page", "none"),
    ]
    several = [(p, F.size(F.array_distinct(of(p)["ids"]))) for p in MULTI]
    rows += [_row("D02", n >= 2, "issue", F.when(of(p)["all_sure"], "on_page").otherwise("inferred"), "medium", p, n) for p, n in several]
    given_g, result_g, badge_g = told("U1-g")
    apps = F.array_compact(F.transform(F.filter(pixels, lambda x: x["type"] == "APP"), lambda x: x["platform"]))
    overlap = F.filter(pixels, lambda x: (x["type"] == "CUSTOM") & (x["platform"] != "klaviyo") & F.array_contains(apps, x["platform"]))
    settled = given_a & (result_a != "needs_input")
    rows += [
        _row("D02", ~F.exists(F.array(*[n >= 2 for _, n in several]), lambda x: x), "pass", "on_page", "none"), _row("D03", true, F.when(c("ga4_twice"), "issue").otherwise("pass"), F.when(c("ga4_twice"), "inferred").otherwise("on_page"), F.when(c("ga4_twice"), "medium").otherwise("none"), "ga4"),
        _row("D04", true, F.when(c("legacy"), "issue").otherwise("pass"), F.when(c("legacy"), "verified").otherwise("on_page"), F.when(c("legacy"), "low").otherwise("none"), "ga4"),
        _row("D05", store & given_g, result_g, badge_g, F.when(result_g == "issue", "high").otherwise("none")), _row("D05", store & own & ~F.coalesce(given_g, F.lit(False)), "needs_input", "not_found", "high"),
        _row("D06", store & settled, result_a, badge_a, F.when(result_a == "issue", "high").otherwise("none")), _row("D06", store & ~F.coalesce(settled, F.lit(False)) & (F.size(overlap) > 0), "issue", "inferred", "high"),
        _row("D06", store & own & ~F.coalesce(settled, F.lit(False)) & (F.size(overlap) == 0), "needs_input", "not_found", "none"),
    ]
    relevant = lambda *p: F.arrays_overlap(v["named"], F.array(*[F.lit(x) for x in p]))
    for p, item in PURCHASE_PROOF.items():
        given, result, badge = told(item, p)
        here = relevant(p, "google_ads", "google_tag") if p == "ga4" else relevant(p)
        rows += [_row("C01", here & given, result, badge, F.when(result == "pass", "none").otherwise("high"), p), _row("C01", here & ~F.coalesce(given, F.lit(False)), "needs_input", "not_found", "high", p)]
    for cid, platforms, weight, p in SERVER:
        given, result, badge = told(PROOF[cid])
        rows += [_row(cid, relevant(*platforms) & given, result, badge, F.when(result == "pass", "none").otherwise(weight), p), _row(cid, relevant(*platforms) & ~F.coalesce(given, F.lit(False)), "needs_input", "not_found", weight, p)]
    where = lambda r: F.array_contains(F.coalesce("regions", none), r)
    asks = (F.size(F.coalesce("tools", none)) > 0) | c("consent_default")
    used = F.filter(F.array(*[F.lit(p) for p in NAMED]), lambda p: F.array_contains(seen, p))
    unnamed = F.array_except(used, F.coalesce("named", none))
    rows += [
        _row("P01", ~where("eu_uk"), "na", None, "none"), _row("P01", where("eu_uk") & asks, "pass", "inferred", "info"), _row("P01", where("eu_uk") & ~asks, "issue", "not_found", "info"),
        _row("P02", c("consent_default"), F.when(c("consent_v2"), "pass").otherwise("issue"), "on_page", "info"), _row("P02", ~c("consent_default") & has("ga4", "google_ads", "google_tag", "gtm"), "not_seen", "not_found", "info"), _row("P02", ~c("consent_default") & ~has("ga4", "google_ads", "google_tag", "gtm"), "na", None, "none"),
        _row("P04", ~where("us"), "na", None, "none"), _row("P04", where("us"), F.when(c("opt_out"), "pass").otherwise("issue"), F.when(c("opt_out"), "on_page").otherwise("not_found"), "info"),
        _row("P05", ~where("ca"), "na", None, "none"), _row("P05", where("ca") & ~c("has_privacy"), "needs_input", "not_found", "info"), _row("P05", where("ca") & c("has_privacy"), F.when(c("advertising") & c("opt_out_said"), "pass").otherwise("issue"), "on_page", "info"),
        _row("P06", ~c("has_privacy"), "not_seen", "not_found", "info"), _row("P06", c("has_privacy") & (F.size(used) == 0), "na", None, "none"),
        _row("P06", c("has_privacy") & (F.size(unnamed) > 0), "issue", "on_page", "info", note=F.array_join(F.array_sort(unnamed), ",")), _row("P06", c("has_privacy") & (F.size(used) > 0) & (F.size(unnamed) == 0), "pass", "on_page", "info"),
    ]
    return F.concat(
        F.array_compact(F.array(*rows)),
        F.transform(malformed, lambda m: F.struct(F.lit("T10").alias("check"), m["platform"].alias("platform"), F.lit("issue").alias("result"), F.lit("verified").alias("badge"), F.when(m["inside"], "medium").otherwise("high").alias("severity"), m["problem"].alias("note"))),
        F.transform(doubled, lambda d: F.struct(F.lit("D01").alias("check"), F.substring_index(d, ":", 1).alias("platform"), F.lit("issue").alias("result"), F.lit("inferred").alias("badge"), F.lit("high").alias("severity"), F.lit(None).cast("string").alias("note"))),
    )


def run_status(f: DataFrame) -> DataFrame:
    """site, status: failed without a home page; partial with pages blocked or
    missing, or one platform mark alone."""
    none = F.array().cast("array<string>")
    lacks = (F.size(F.coalesce("blocked", none)) > 0) | F.coalesce(F.col("home_result") != "ok", F.lit(False)) | ~F.col("has_product") | ~F.col("has_privacy") | ((F.size(F.coalesce("markers", none)) == 1) & ~F.col("home_blocked"))
    return f.select("site", choose((~F.col("has_home"), "failed"), (lacks, "partial"), otherwise="complete").alias("status"))
