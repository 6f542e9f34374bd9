"""Normalised snapshots, one-to-one matching and change events.

Every function works on many sites at once: keys are (site, product_key) and so
on, the two snapshots are two DataFrames with one snapshot of each site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import days_between, iso_week, parse_time
from ..functions.money import cents_half_even, dec, depth_pct, pct_change, round2
from ..plans.staging import cut
from .catalogue import is_real, lowest_price

#: Event types in rank order with their severity.
EVENT_TYPES = (
    ("store_status_changed", "high"), ("currency_changed", "high"), ("price_sitewide_shift", "high"), ("product_added", "high"),
    ("product_removed", "high"), ("price_down", "medium"), ("price_up", "medium"), ("promo_started", "high"), ("promo_ended", "high"),
    ("discount_deeper", "medium"), ("discount_shallower", "medium"), ("compare_at_raised", "medium"), ("sold_out", "medium"),
    ("restocked", "medium"), ("variant_added", "medium"), ("variant_removed", "medium"), ("policy_changed", "medium"),
    ("policy_added", "medium"), ("policy_removed", "medium"), ("theme_changed", "high"), ("theme_updated", "low"),
    ("app_signal_added", "medium"), ("app_signal_removed", "medium"), ("tracking_added", "medium"), ("tracking_removed", "medium"),
    ("markets_changed", "medium"), ("homepage_promo_changed", "medium"), ("homepage_text_changed", "low"), ("collection_added", "medium"),
    ("collection_removed", "medium"), ("collection_renamed", "low"), ("product_republished", "low"), ("product_handle_changed", "low"),
    ("product_relisted", "low"), ("product_surfaced", "low"), ("product_missing_unconfirmed", "low"),
)
SEVERITIES = ("high", "medium", "low")
#: Thresholds of the comparison.
THRESHOLDS = {
    "price_summary_pct": 5.0, "discount_pp": 5.0, "mass_removal_ratio": 0.30, "mass_added_ratio": 0.50, "homepage_text_lines": 5,
    "interval_short_hours": 20.0, "interval_long_days": 45.0, "sitewide_share": 0.50, "sitewide_spread_pp": 0.50,
    "policy_ignore_similarity": 0.98,
}
BAD = ("blocked", "not_shopify")
LIVE = ("live", "teardown_import")
EVENT_COLS = (
    "type", "severity", "product_id", "handle", "title", "variant_id", "variant", "field", "before", "after", "delta_pct", "currency",
    "virtual",
)


# -- building snapshots ------------------------------------------------------


def normalize_products(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Product and variant tables of a snapshot from parsed products."""
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("handle:"), "handle"))
    virtual = ~is_real(F.col("title"), F.col("handle"), F.col("product_type"), F.greatest(lowest_price(), F.lit(5.0)), F.col("variants"))
    base = products.withColumn("product_key", key)
    rows = base.select(
        "site", "snapshot_id", "product_key", F.coalesce("handle", F.lit("")).alias("handle"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("vendor", F.lit("")).alias("vendor"), F.coalesce("product_type", F.lit("")).alias("product_type"),
        F.array_sort(F.array_distinct("tags")).alias("tags"), "created_at", "published_at", virtual.alias("virtual"),
    )
    v = base.select("site", "snapshot_id", "product_key", F.posexplode("variants").alias("pos", "v"))
    options = F.filter(F.array("v.option1", "v.option2", "v.option3"), lambda o: o.isNotNull() & (o != "") & (o != "Default Title"))
    variants = v.select(
        "site", "snapshot_id", "product_key", F.coalesce(F.col("v.id").cast("string"), F.concat(F.lit("idx-"), F.col("pos").cast("string"))).alias("variant_key"),
        "pos", F.coalesce("v.title", F.lit("")).alias("title"), F.coalesce("v.sku", F.lit("")).alias("sku"), options.alias("options"),
        dec("v.price").alias("price"), dec("v.compare_at_price").alias("compare_at_price"), F.col("v.available").alias("available"),
    )
    return rows, variants


def snapshot_status(identity: Column, products: Column, homepage: Column, n_products: Column) -> Column:
    """not_shopify, blocked, complete or partial."""
    return (
        F.when(identity == "not_shopify", "not_shopify").when((products == "blocked") & (homepage != "ok"), "blocked")
        .when((products == "ok") & (homepage == "ok") & (n_products > 0), "complete").otherwise("partial")
    )


def fetch_error(requests: DataFrame) -> DataFrame:
    """network when no request of a run reached a server, unreachable when the
    home page did not and nothing else answered, else null."""
    got = F.col("http_status").isNotNull()
    agg = requests.groupBy("site", "snapshot_id").agg(
        F.bool_and(~got).alias("none"), F.bool_or((F.col("key") == "homepage") & ~got).alias("home"),
        F.bool_or((F.col("key") != "homepage") & got).alias("other"),
    )
    return agg.select("site", "snapshot_id", F.when(F.col("none"), "network").when(F.col("home") & ~F.col("other"), "unreachable").alias("fetch_error"))


def policy_rows(policies: DataFrame, text_col: str = "text") -> DataFrame:
    """Digest, sentences and terms of policy texts."""
    rows = policies.withColumn("_t", T.policy_text(text_col)).withColumn("_s", T.long_sentences("_t"))
    return rows.select(*[c for c in policies.columns if c != text_col], T.sha_text("_t").alias("text_sha256"), F.col("_s").alias("sentences"), T.key_terms("_s").alias("key_terms"))


def line_rows(pages: DataFrame, text_col: str = "text") -> DataFrame:
    both = T.homepage_lines(text_col)
    cut = lambda kind: pages.select("site", "snapshot_id", F.lit(kind).alias("kind"), F.explode(both[kind]).alias("line"))
    return cut("promo").unionByName(cut("other"))


# -- matching ----------------------------------------------------------------


def unique_match(a: DataFrame, b: DataFrame, on: list[str], how: Column) -> DataFrame:
    """site, key_a, key_b, how where the key stands once on either side."""
    once = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("site", *on))).where("_n = 1").drop("_n")
    return once(a).join(once(b).withColumnRenamed("key_a", "key_b"), ["site", *on]).select("site", "key_a", "key_b", how.alias("how"))


def match_products(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, only in a, only in b): one to one by id, then by a handle that
    is unique among the rest on both sides, then, where a side lacks ids, by
    unique vendor and title."""
    cols = ["site", F.col("product_key").alias("key_a"), "handle", F.lower("vendor").alias("vendor"), T.norm_title("title").alias("title")]
    left, right = a.select(*cols), b.select(*cols)
    left, right = cut(left), cut(right)
    ids = lambda df: df.where("not startswith(key_a, 'handle:')")
    pairs = cut(ids(left).select("site", "key_a").join(ids(right).select("site", "key_a"), ["site", "key_a"]).select("site", "key_a", F.col("key_a").alias("key_b"), F.lit("id").alias("how")))
    rest = lambda df, p, side: df.join(p.select("site", F.col(side).alias("key_a")), ["site", "key_a"], "left_anti")
    la, rb = cut(rest(left, pairs, "key_a")), cut(rest(right, pairs, "key_b"))
    both_ids = ~F.startswith("key_a", F.lit("handle:")) & ~F.startswith("key_b", F.lit("handle:"))
    by_handle = cut(unique_match(la.where("handle <> ''"), rb.where("handle <> ''"), ["handle"], F.when(both_ids, "relisted").otherwise("handle")))
    la, rb = cut(rest(la, by_handle, "key_a")), cut(rest(rb, by_handle, "key_b"))
    lacks = la.union(rb).where("startswith(key_a, 'handle:')").select("site").distinct()
    by_title = cut(unique_match(la.join(lacks, "site", "left_semi"), rb.join(lacks, "site", "left_semi"), ["vendor", "title"], F.lit("title")))
    return cut(pairs.unionByName(by_handle).unionByName(by_title)), rest(la, by_title, "key_a"), rest(rb, by_title, "key_b")


def ambiguous_titles(only_a: DataFrame, only_b: DataFrame) -> DataFrame:
    """Sites where vendor and title would match but not one to one."""
    n = lambda df, c: df.groupBy("site", "vendor", "title").agg(F.count(F.lit(1)).alias(c))
    return n(only_a, "na").join(n(only_b, "nb"), ["site", "vendor", "title"]).where("na > 1 or nb > 1").select("site").distinct()


def match_variants(pairs: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants of matched products by id, then unique sku, then unique options;
    result rows carry the keys of the product pair."""
    side = lambda df, k: df.join(pairs.select("site", "key_a", "key_b", F.col(k).alias("product_key")), ["site", "product_key"]).select(
        "site", "key_a", "key_b", F.col("variant_key").alias("v"), "sku", "options"
    )
    la, rb = cut(side(a, "key_a")), cut(side(b, "key_b"))
    pk = ["site", "key_a", "key_b"]
    real = "not startswith(v, 'idx-')"
    out = la.where(real).select(*pk, "v").join(rb.where(real).select(*pk, "v"), [*pk, "v"]).select(*pk, F.col("v").alias("va"), F.col("v").alias("vb"))
    out = cut(out)
    rest = lambda df, p, c: df.join(p.select(*pk, F.col(c).alias("v")), [*pk, "v"], "left_anti")
    once = lambda df, on: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*pk, on))).where("_n = 1").drop("_n")
    for on, good in (("sku", "sku <> ''"), ("options", "size(options) > 0")):
        la, rb = cut(rest(la, out, "va")), cut(rest(rb, out, "vb"))
        more = once(la.where(good), on).select(*pk, on, F.col("v").alias("va")).join(once(rb.where(good), on).select(*pk, on, F.col("v").alias("vb")), [*pk, on])
        out = cut(out.unionByName(more.select(*pk, "va", "vb")))
    return out, rest(la, out, "va"), rest(rb, out, "vb")


# -- events ------------------------------------------------------------------


def _event(kind: str, **fields) -> Column:
    """Struct of one event; unset fields are null."""
    kinds = dict.fromkeys(EVENT_COLS, "string") | {"delta_pct": "double", "virtual": "boolean"}
    given = {"type": F.lit(kind), "severity": F.lit(dict(EVENT_TYPES)[kind])} | fields
    return F.struct(*[(given[c].cast(kinds[c]) if c in given else F.lit(None).cast(kinds[c])).alias(c) for c in EVENT_COLS])


def _explode(rows: DataFrame, *events: Column) -> DataFrame:
    kept = F.filter(F.array(*events), lambda e: e.isNotNull())
    return rows.select("site", F.explode(kept).alias("e")).select("site", "e.*")


def _shown(key: str) -> Column:
    return F.when(~F.startswith(F.col(key), F.lit("handle:")) & ~F.startswith(F.col(key), F.lit("idx-")), F.col(key))


def _label(options: Column, title: Column) -> Column:
    return F.when(F.size(options) > 0, F.array_join(options, " / ")).otherwise(title)


def product_facts(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Least price, best discount and availability of each product."""
    facts = variants.groupBy("site", "product_key").agg(
        F.min("price").alias("lowest"), F.max(depth_pct("price", "compare_at_price")).alias("depth"), F.bool_or("available").alias("avail")
    )
    return products.join(facts, ["site", "product_key"], "left")


def product_events(a: DataFrame, b: DataFrame, va: DataFrame, vb: DataFrame, snaps: DataFrame, t: dict | None = None) -> DataFrame:
    """Events of products and variants. ``snaps`` has one row for each site:
    t_from, removals_ok, prices_ok, currency."""
    t = THRESHOLDS | (t or {})
    pairs, only_a, only_b = match_products(a, b)
    fa, fb = cut(product_facts(a, va)), cut(product_facts(b, vb))
    ident = lambda key, p="": {"product_id": _shown(key), "handle": F.col(f"{p}handle"), "title": F.col(f"{p}title"), "virtual": F.col(f"{p}virtual")}
    cents = lambda c: cents_half_even(F.col(c)).cast("string")

    new = fb.join(only_b.select("site", F.col("key_a").alias("product_key")), ["site", "product_key"], "left_semi").join(snaps, "site")
    when = F.coalesce(parse_time("published_at"), parse_time("created_at"))
    is_new = F.coalesce(when >= F.col("t_from"), F.lit(False))
    fields = ident("product_key") | {"after": cents("lowest"), "currency": F.col("currency")}
    added = _explode(new, F.when(is_new, _event("product_added", **fields)).otherwise(_event("product_surfaced", **fields)))

    real_a = a.groupBy("site").agg(F.count_if(~F.col("virtual")).alias("_real"), F.count(F.lit(1)).alias("_all"))
    gone = fa.join(only_a.select("site", F.col("key_a").alias("product_key")), ["site", "product_key"], "left_semi").join(snaps, "site")
    lost = gone.groupBy("site").agg(F.count_if(~F.col("virtual")).alias("_lost")).join(real_a, "site")
    mass = F.col("_lost") > t["mass_removal_ratio"] * F.when(F.col("_real") > 0, F.col("_real")).otherwise(F.col("_all"))
    gone = gone.join(lost.select("site", mass.alias("_mass")), "site", "left")
    sure = F.col("removals_ok") & ~F.coalesce("_mass", F.lit(False))
    fields = ident("product_key") | {"before": cents("lowest"), "currency": F.col("currency")}
    removed = _explode(gone, F.when(sure, _event("product_removed", **fields)).otherwise(_event("product_missing_unconfirmed", **fields)))

    pick = lambda df, p: df.select("site", F.col("product_key").alias(f"key_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("handle", "title", "virtual", "published_at", "lowest", "depth", "avail")])
    both = pairs.join(pick(fa, "a"), ["site", "key_a"]).join(pick(fb, "b"), ["site", "key_b"]).join(snaps, "site")
    both = cut(both)
    me = ident("key_b", "b_")
    ta, tb = parse_time("a_published_at"), parse_time("b_published_at")
    d1, d2 = F.col("a_depth"), F.col("b_depth")
    text = lambda c: c.cast("string")
    ok = F.col("prices_ok")
    moved = d1.isNotNull() & d2.isNotNull() & (F.abs(d2 - d1) >= t["discount_pp"])
    base = _explode(
        both,
        F.when(F.col("how") == "relisted", _event("product_relisted", field=F.lit("product_id"), before=F.col("key_a"), after=F.col("key_b"), **me)),
        F.when((F.col("a_handle") != "") & (F.col("b_handle") != "") & (F.col("a_handle") != F.col("b_handle")),
               _event("product_handle_changed", field=F.lit("handle"), before=F.col("a_handle"), after=F.col("b_handle"), **me)),
        F.when(tb > ta, _event("product_republished", field=F.lit("published_at"), before=F.col("a_published_at"), after=F.col("b_published_at"), **me)),
        F.when(F.col("a_avail") & ~F.col("b_avail"), _event("sold_out", before=F.lit("available"), after=F.lit("sold_out"), **me)),
        F.when(~F.col("a_avail") & F.col("b_avail"), _event("restocked", before=F.lit("sold_out"), after=F.lit("available"), **me)),
        F.when(ok & d1.isNull() & d2.isNotNull(), _event("promo_started", after=text(d2), **me)),
        F.when(ok & d1.isNotNull() & d2.isNull(), _event("promo_ended", before=text(d1), **me)),
        F.when(ok & moved & (d2 > d1), _event("discount_deeper", before=text(d1), after=text(d2), **me)),
        F.when(ok & moved & (d2 < d1), _event("discount_shallower", before=text(d1), after=text(d2), **me)),
    )

    vpairs, v_only_a, v_only_b = match_variants(pairs, va, vb)
    names = both.select("site", "key_a", "key_b", "b_handle", "b_title", "b_virtual", "prices_ok", "currency")
    vcols = lambda df, p: df.select("site", F.col("product_key").alias(f"key_{p}"), F.col("variant_key").alias(f"v{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("price", "compare_at_price", "sku")], _label(F.col("options"), F.col("title")).alias(f"{p}_label"))
    joined = vpairs.join(vcols(va, "a"), ["site", "key_a", "va"]).join(vcols(vb, "b"), ["site", "key_b", "vb"]).join(names, ["site", "key_a", "key_b"])
    change = pct_change("a_price", "b_price")
    level = F.when(F.abs(F.coalesce(change, F.lit(0.0))) >= t["price_summary_pct"], "high").otherwise("medium")
    line = me | {"variant_id": _shown("vb"), "variant": F.col("b_label"), "before": cents("a_price"), "after": cents("b_price"), "delta_pct": change, "severity": level, "currency": F.col("currency")}
    prices = _explode(
        joined.where(ok & (F.col("a_price") != F.col("b_price"))),
        F.when(F.col("b_price") < F.col("a_price"), _event("price_down", **line)).otherwise(_event("price_up", **line)),
    )
    raised = joined.where(ok & F.col("a_price").eqNullSafe(F.col("b_price")) & (F.col("b_compare_at_price") > F.col("a_compare_at_price")))
    raised = _explode(raised.dropDuplicates(["site", "key_b"]), _event("compare_at_raised", **me))
    vnew = v_only_b.withColumnRenamed("v", "vb").join(vcols(vb, "b"), ["site", "key_b", "vb"]).join(names, ["site", "key_a", "key_b"])
    vold = v_only_a.withColumnRenamed("v", "va").join(vcols(va, "a"), ["site", "key_a", "va"]).join(names, ["site", "key_a", "key_b"])
    vnew = _explode(vnew, _event("variant_added", variant_id=_shown("vb"), variant=F.col("b_label"), after=cents("b_price"), currency=F.col("currency"), **me))
    vold = _explode(vold, _event("variant_removed", variant_id=_shown("va"), variant=F.col("a_label"), before=cents("a_price"), currency=F.col("currency"), **me))
    shift = sitewide_shift(fa, fb, snaps, t)
    return reduce(DataFrame.unionByName, [added, removed, base, prices, raised, vnew, vold, shift])


def sitewide_shift(fa: DataFrame, fb: DataFrame, snaps: DataFrame, t: dict | None = None) -> DataFrame:
    """One event where half of the comparable products moved the same way by
    nearly the same share; its size is the upper middle element."""
    t = THRESHOLDS | (t or {})
    moves = fb.where("not virtual").select("site", "product_key", F.col("lowest").alias("l2")).join(fa.select("site", "product_key", F.col("lowest").alias("l1")), ["site", "product_key"])
    moves = moves.where("l1 > 0 and l2 is not null").withColumn("m", (F.col("l2") - F.col("l1")).cast("double") / F.col("l1").cast("double") * 100)
    total = moves.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    same = moves.where("m <> 0").withColumn("sign", F.signum("m")).withColumn("_r", F.row_number().over(Window.partitionBy("site", "sign").orderBy("m", "product_key")) - 1)
    size = same.groupBy("site", "sign").agg(F.count(F.lit(1)).alias("n"), (F.max("m") - F.min("m")).alias("spread"))
    good = size.join(total, "site").where((F.col("n") >= 2) & (F.col("n") >= t["sitewide_share"] * F.col("total")) & (F.col("spread") <= t["sitewide_spread_pp"]))
    first = good.groupBy("site").agg(F.min("sign").alias("sign"), F.min_by("n", "sign").alias("n"))
    mid = same.join(first, ["site", "sign"]).where(F.col("_r") == F.floor(F.col("n") / 2)).join(snaps.where("prices_ok"), "site")
    return _explode(mid, _event("price_sitewide_shift", delta_pct=round2("m"), currency=F.col("currency")))


def snapshot_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events of the store rows: status, currency, markets, theme."""
    cols = [c for c in a.columns if c != "site"]
    both = a.select("site", *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select("site", *[F.col(c).alias(f"b_{c}") for c in cols]), "site")
    bad = F.col("a_status").isin(*BAD) | F.col("b_status").isin(*BAD)
    home = F.col("a_cov_homepage") & F.col("b_cov_homepage")
    differ = lambda c: F.col(f"a_{c}") != F.col(f"b_{c}")
    said = lambda c: F.col(c).cast("string")
    meta = (F.col("a_currency_source") == "meta") & (F.col("b_currency_source") == "meta")
    same_market = F.coalesce(~differ("visitor_country"), F.lit(True))
    keys = ("theme_name", "theme_schema_name", "theme_schema_version", "theme_store_id")
    known = lambda p: reduce(lambda x, y: x | y, [F.coalesce(F.col(f"{p}_{k}") != "", F.lit(False)) for k in keys])
    changed = [~F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    names = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k.removeprefix("theme_"))) for c, k in zip(changed, keys)])), ",")
    version_only = changed[2] & ~changed[0] & ~changed[1] & ~changed[3]
    theme = home & same_market & known("a") & known("b")
    told = lambda p: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", f"{p}_theme_schema_name", f"{p}_theme_schema_version")), F.lit("")), F.col(f"{p}_theme_name"))
    gate = ~F.coalesce(bad, F.lit(False))
    return _explode(
        both,
        F.when(bad & differ("status"), _event("store_status_changed", field=F.lit("status"), before=said("a_status"), after=said("b_status"))),
        F.when(gate & differ("currency") & meta, _event("currency_changed", field=F.lit("currency"), before=said("a_currency"), after=said("b_currency"))),
        F.when(gate & differ("ships_to_count"), _event("markets_changed", field=F.lit("ships_to_count"), before=said("a_ships_to_count"), after=said("b_ships_to_count"))),
        F.when(gate & home & differ("localization_form"), _event("markets_changed", field=F.lit("localization_form"), before=said("a_localization_form"), after=said("b_localization_form"))),
        F.when(gate & theme & version_only, _event("theme_updated", field=F.lit("schema_version"), before=said("a_theme_schema_version"), after=said("b_theme_schema_version"))),
        F.when(gate & theme & (names != "") & ~version_only, _event("theme_changed", field=names, before=told("a"), after=told("b"))),
    )


def collection_events(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("site", "handle", F.col("title").alias("ta")).join(b.select("site", "handle", F.col("title").alias("tb")), ["site", "handle"], "full_outer")
    h = F.col("handle")
    return _explode(
        both,
        F.when(F.col("ta").isNull(), _event("collection_added", field=h, after=F.col("tb"))),
        F.when(F.col("tb").isNull(), _event("collection_removed", field=h, before=F.col("ta"))),
        F.when(F.col("ta") != F.col("tb"), _event("collection_renamed", field=h, before=F.col("ta"), after=F.col("tb"))),
    )


def signal_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """Apps, tags and language versions that came or went."""
    tag = lambda df, c: df.where("kind in ('app', 'tracking')").select("site", "kind", "name").distinct().withColumn(c, F.lit(True))
    both = tag(a, "ina").join(tag(b, "inb"), ["site", "kind", "name"], "full_outer")
    out = []
    for kind, add, drop in (("app", "app_signal_added", "app_signal_removed"), ("tracking", "tracking_added", "tracking_removed")):
        mine, n = F.col("kind") == kind, F.col("name")
        out += [F.when(mine & F.col("ina").isNull(), _event(add, field=n, after=n)), F.when(mine & F.col("inb").isNull(), _event(drop, field=n, before=n))]
    codes = lambda df, c: df.where("kind = 'hreflang'").groupBy("site").agg(F.array_sort(F.collect_set("name")).alias(c))
    langs = codes(a, "ha").join(codes(b, "hb"), "site", "full_outer")
    text = lambda c: F.nullif(F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", "), F.lit(""))
    moved = langs.where(~F.col("ha").eqNullSafe(F.col("hb")))
    return _explode(both, *out).unionByName(_explode(moved, _event("markets_changed", field=F.lit("hreflang"), before=text("ha"), after=text("hb"))))


def homepage_events(a: DataFrame, b: DataFrame, t: dict | None = None) -> DataFrame:
    """Promotion lines that differ; other lines once enough of them do."""
    t = THRESHOLDS | (t or {})
    key = ["site", "kind", "line"]
    gone = a.select(*key).distinct().join(b.select(*key), key, "left_anti").withColumn("side", F.lit("gone"))
    come = b.select(*key).distinct().join(a.select(*key), key, "left_anti").withColumn("side", F.lit("come"))
    agg = gone.unionByName(come).groupBy("site", "kind").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "gone", F.col("line")))).alias("gone"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "come", F.col("line")))).alias("come"),
    )
    text = lambda c: F.nullif(F.array_join(c, " | "), F.lit(""))
    n = lambda c: F.size(c).cast("string")
    return _explode(
        agg,
        F.when(F.col("kind") == "promo", _event("homepage_promo_changed", before=text("gone"), after=text("come"))),
        F.when((F.col("kind") != "promo") & (F.size("gone") + F.size("come") >= t["homepage_text_lines"]), _event("homepage_text_changed", before=n("gone"), after=n("come"))),
    )


def policy_events(a: DataFrame, b: DataFrame, t: dict | None = None) -> DataFrame:
    """Policies that came, went or changed: terms first (high), then wording.
    Only pairs whose digest differs reach the sentence comparison."""
    t = THRESHOLDS | (t or {})
    cols = ("checked_result", "text_sha256", "sentences", "key_terms")
    side = lambda df, p: df.select("site", "name", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = side(a, "a").join(side(b, "b"), ["site", "name"], "full_outer")
    has = lambda p: F.col(f"{p}_text_sha256").isNotNull()
    n = F.col("name")
    edges = _explode(
        both,
        F.when(~has("a") & has("b") & (F.col("a_checked_result") == "not_found"), _event("policy_added", field=n)),
        F.when(has("a") & ~has("b") & (F.col("b_checked_result") == "not_found"), _event("policy_removed", field=n)),
    )
    moved = both.where(has("a") & has("b") & (F.col("a_text_sha256") != F.col("b_text_sha256")))
    empty = F.create_map().cast("map<string,string>")
    ka, kb = F.coalesce("a_key_terms", empty), F.coalesce("b_key_terms", empty)
    rows = moved.withColumn("k", F.explode_outer(F.array_union(F.map_keys(ka), F.map_keys(kb))))
    va, vb = F.try_element_at(ka, F.col("k")), F.try_element_at(kb, F.col("k"))
    terms = rows.where(F.col("k").isNotNull() & ~va.eqNullSafe(vb))
    term_events = _explode(terms, _event("policy_changed", severity=F.lit("high"), title=n, field=F.col("k"), before=va, after=vb))
    count = terms.groupBy("site", "name").agg(F.count(F.lit(1)).alias("_terms"))
    diff = moved.withColumn("d", T.sentence_diff("a_sentences", "b_sentences")).join(count, ["site", "name"], "left")
    size = lambda op: F.size(F.filter("d", lambda x: x["op"] == op))
    chars = lambda c: F.aggregate(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit(0), lambda x, s: x + F.length(s))
    touched = F.aggregate("d", F.lit(0), lambda x, e: x + F.greatest(F.length(F.coalesce(e["old"], F.lit(""))), F.length(F.coalesce(e["new"], F.lit("")))))
    likeness = round2(F.greatest(F.lit(0.0), 1.0 - touched / F.greatest(chars("a_sentences"), chars("b_sentences"), F.lit(1))))
    few = F.coalesce("_terms", F.lit(0)) == 0
    shown = diff.where((F.size("d") > 0) & ~((likeness >= t["policy_ignore_similarity"]) & few))
    total = lambda x: (size(x) + size("rewritten")).cast("string")
    wording = _explode(shown, _event("policy_changed", severity=F.when(few, "medium").otherwise("low"), title=n, field=F.lit("text"), before=total("removed"), after=total("added")))
    return edges.unionByName(term_events).unionByName(wording)


def diff_gates(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each site with what may be compared, and warnings."""
    side = lambda df, p: df.select("site", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "site"])
    both = side(a, "a").join(side(b, "b"), "site")
    archive = (F.col("a_source") == "archive") | (F.col("b_source") == "archive")
    bad = F.col("a_status").isin(*BAD) | F.col("b_status").isin(*BAD)
    ta, tb = parse_time("a_captured_at_utc"), parse_time("b_captured_at_utc")
    days = round2(days_between(ta, tb))
    moved = (F.col("a_currency") != F.col("b_currency")) & (F.col("a_currency_source") == "meta") & (F.col("b_currency_source") == "meta")
    market = F.col("a_visitor_country") != F.col("b_visitor_country")
    products = ~bad & (F.col("a_cov_products") != "none") & (F.col("b_cov_products") != "none")
    warn = lambda cond, name: F.when(cond, F.lit(name))
    t = THRESHOLDS
    warnings = F.array_compact(F.array(
        warn(days < 0, "snapshots_out_of_order"), warn((days >= 0) & (days * 24 < t["interval_short_hours"]), "interval_short"),
        warn(days > t["interval_long_days"], "interval_long"), warn(archive, "archive_baseline"), warn(moved, "prices_skipped_currency_changed"),
        warn((F.col("a_currency") != F.col("b_currency")) & ~moved, "currency_source_mismatch"), warn(market, "market_mismatch"),
    ))
    yes = lambda c: F.coalesce(c, F.lit(False))
    live = F.col("a_source").isin(*LIVE) & F.col("b_source").isin(*LIVE)
    return both.select(
        "site", ta.alias("t_from"), days.alias("interval_days"), yes(bad).alias("stopped"), yes(market).alias("market_mismatch"),
        yes(products).alias("products_ok"), (~yes(moved)).alias("prices_ok"),
        yes(F.col("b_pagination_complete") & (F.col("b_cov_products") == "full") & ~archive).alias("removals_ok"),
        yes(F.col("a_cov_homepage") & F.col("b_cov_homepage")).alias("homepage_ok"), yes(F.col("a_cov_collections") & F.col("b_cov_collections")).alias("collections_ok"),
        F.coalesce("b_currency", "a_currency").alias("currency"), yes(live).alias("live"), warnings.alias("warnings"),
    )


def diff(a: dict[str, DataFrame], b: dict[str, DataFrame], t: dict | None = None) -> DataFrame:
    """All change events of two snapshots (dicts of the snapshot tables: snap,
    product, variant, collection, policy, line, signal) in their total order,
    numbered R001 ... within each site."""
    gates = diff_gates(a["snap"], b["snap"])
    open_ = lambda df, cond: df.join(gates.where(cond).select("site"), "site", "left_semi")
    only = lambda key, cond: (open_(a[key], cond), open_(b[key], cond))
    go = "not stopped and products_ok"
    context = gates.where(go).select("site", "t_from", "removals_ok", "prices_ok", "currency")
    pages = "not stopped and homepage_ok and not market_mismatch"
    parts = [
        (snapshot_events(a["snap"], b["snap"]), "page"),
        (product_events(*only("product", go), *only("variant", go), context, t), "data"),
        (collection_events(*only("collection", "not stopped and collections_ok")), "data"),
        (homepage_events(*only("line", pages), t), "page"),
        (signal_events(*only("signal", pages)), "page"),
        (policy_events(*only("policy", "not stopped and not market_mismatch"), t), "policy"),
    ]
    events = reduce(DataFrame.unionByName, [e.withColumn("kind", F.lit(k)) for e, k in parts])
    badge = F.when(F.col("kind") == "policy", "self_claim").when((F.col("kind") == "data") & F.col("live"), "verified").otherwise("on_page")
    events = events.join(gates.select("site", "live"), "site").withColumn("badge", badge)
    return number_events(events.withColumn("virtual", F.coalesce("virtual", F.lit(False))).drop("live", "kind"))


def event_order() -> list[Column]:
    """Severity, type, numeric ids before text ids, then the texts."""
    rank = reduce(lambda c, kv: F.when(F.col("type") == kv[1], F.lit(kv[0])).otherwise(c), enumerate([x for x, _ in EVENT_TYPES]), F.lit(999))
    level = reduce(lambda c, kv: F.when(F.col("severity") == kv[1], F.lit(kv[0])).otherwise(c), enumerate(SEVERITIES), F.lit(9))
    ident = lambda c: [F.when(F.col(c).rlike(r"^\d+$"), 0).otherwise(1), F.col(c).try_cast("decimal(38,0)"), F.coalesce(c, F.lit(""))]
    return [level, rank, *ident("product_id"), *ident("variant_id"), *[F.coalesce(c, F.lit("")) for c in ("field", "handle", "before", "after")]]


def number_events(events: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("site").orderBy(*event_order()))
    return events.withColumn("event_id", F.format_string("R%03d", n))


def event_counts(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Counts of every event type, zeros included; virtual products not counted."""
    spine = sites.select("site").distinct().withColumn("type", F.explode(F.array(*[F.lit(x) for x, _ in EVENT_TYPES])))
    n = events.where("not coalesce(virtual, false)").groupBy("site", "type").agg(F.count(F.lit(1)).alias("count"))
    return spine.join(n, ["site", "type"], "left").select("site", "type", F.coalesce("count", F.lit(0)).alias("count"))


def diff_status(gates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("site", F.col("status").alias("sa"), F.col("source").alias("oa")).join(b.select("site", F.col("status").alias("sb"), F.col("source").alias("ob")), "site").join(gates, "site")
    good = (F.col("sa") == "complete") & (F.col("sb") == "complete") & F.col("products_ok") & ~F.array_contains("warnings", "archive_baseline")
    return both.select("site", F.when(F.col("sa").isin(*BAD) & F.col("sb").isin(*BAD), "failed").when(good, "complete").otherwise("partial").alias("status"))


def on_sale_share(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Percent of real products with a discount."""
    facts = product_facts(products, variants).where("not virtual")
    return facts.groupBy("site").agg(round2(100.0 * F.count("depth") / F.count(F.lit(1))).alias("on_sale_share"))


def cadence(events: DataFrame, products_b: DataFrame, gates: DataFrame) -> DataFrame:
    """Added products, the rate per week and a histogram by ISO week."""
    added = events.where("type = 'product_added' and not virtual").select("site", F.col("product_id").alias("product_key"))
    when = F.coalesce(parse_time("published_at"), parse_time("created_at"))
    weeks = added.join(products_b, ["site", "product_key"]).groupBy("site", iso_week(when).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    hist = weeks.groupBy("site").agg(F.sum("n").alias("added"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("week", "n")))).alias("by_week"))
    rate = F.when(F.col("interval_days") >= 1, round2(F.col("added") / F.col("interval_days") * 7))
    return gates.select("site", "interval_days").join(hist, "site", "left").select("site", F.coalesce("added", F.lit(0)).alias("added"), rate.alias("added_per_week"), "by_week")


def baseline(products: DataFrame, variants: DataFrame, ref: Column) -> DataFrame:
    """Facts of a single snapshot: new in 30 and 90 days, share on sale."""
    facts = product_facts(products, variants).where("not virtual")
    age = days_between(parse_time("published_at"), ref)
    return facts.groupBy("site").agg(
        F.count(F.lit(1)).alias("products"), F.count_if(age.between(0, 30)).alias("new_30d"), F.count_if(age.between(0, 90)).alias("new_90d"),
        round2(100.0 * F.count("depth") / F.count(F.lit(1))).alias("on_sale_share"), F.max("published_at").alias("latest"),
    )


def top_changes(events: DataFrame, limit: int = 10) -> DataFrame:
    """The changes to lead with: status, added, removed, large price moves,
    promotions, strong policy changes, theme and home page."""
    order = (
        (F.col("type") == "store_status_changed"), F.col("type") == "product_added", F.col("type") == "product_removed",
        F.col("type").isin("price_down", "price_up") & (F.col("severity") == "high"), F.col("type").isin("promo_started", "promo_ended"),
        (F.col("type") == "policy_changed") & (F.col("severity") == "high"), F.col("type").isin("theme_changed", "homepage_promo_changed"),
    )
    rank = reduce(lambda c, kv: F.when(kv[1], F.lit(kv[0])).otherwise(c), reversed(list(enumerate(order))), F.lit(None).cast("int"))
    ranked = events.withColumn("category", rank).where("category is not null")
    n = F.row_number().over(Window.partitionBy("site").orderBy("category", *event_order()))
    return ranked.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")
