"""Catalogue statistics: prices, discounts, availability, top values, months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import to_float

#: Lower edges of the price bands, half open, the last unbounded.
PRICE_EDGES = (0, 10, 25, 50, 100, 200, 500, 1000, 2000, 5000)
MIN_REAL_PRICE = 5.0
#: Add-ons that are not merchandise.
NOT_A_PRODUCT = (
    r"(?i)protect|insurance|guarantee|gift[\s-]*card|e-?gift|warranty|shipping|\broute\b|donation|\btips?\b|运费|保障|保险|退货险|礼品卡"
)
TEST_PRODUCT = r"(?i)\b(?:test|demo|sample product|example product|do not buy)\b"
TEXT_SHORT, SAMPLE_SMALL = 100, 8


def _prices(variants: Column) -> Column:
    return F.filter(F.transform(variants, lambda v: to_float(v["price"])), lambda x: x.isNotNull())


def lowest_price(variants="variants") -> Column:
    """Least variant price that reads as a number."""
    return F.array_min(_prices(F.col(variants)))


def highest_price(variants="variants") -> Column:
    return F.array_max(_prices(F.col(variants)))


def depth(price: Column, compare_at: Column) -> Column:
    """Discount as a fraction where the compare-at price is higher."""
    return F.when((compare_at > price) & (compare_at > 0), 1 - price / compare_at)


def best_depth(variants="variants") -> Column:
    return F.array_max(F.transform(F.col(variants), lambda v: depth(to_float(v["price"]), to_float(v["compare_at_price"]))))


def is_real(title: Column, handle: Column, kind: Column, price: Column, variants: Column | None = None) -> Column:
    """Merchandise: a real price, no add-on wording, not a product whose every
    variant says that it needs no shipping (missing is not false)."""
    named = lambda c: F.coalesce(c, F.lit("")).rlike(NOT_A_PRODUCT)
    real = (F.coalesce(price, F.lit(-1.0)) >= MIN_REAL_PRICE) & ~named(title) & ~named(handle) & ~named(kind)
    if variants is not None:
        virtual = (F.size(variants) > 0) & F.forall(variants, lambda v: v["requires_shipping"].eqNullSafe(F.lit(False)))
        real = real & ~virtual
    return real


def in_stock(variants: Column) -> Column:
    """Some variant is not marked unavailable."""
    return F.exists(variants, lambda v: ~v["available"].eqNullSafe(F.lit(False)))


def availability(variants: Column) -> Column:
    """True, false or null when no variant says."""
    said = F.filter(F.transform(variants, lambda v: v["available"]), lambda a: a.isNotNull())
    return F.when(F.size(said) > 0, F.array_contains(said, True))


def test_products(products: DataFrame) -> DataFrame:
    """Products that look like tests, with the reason."""
    price = lowest_price()
    why = F.when(F.col("title").rlike(TEST_PRODUCT), "title").when(F.col("handle").rlike(TEST_PRODUCT), "handle").when(price <= 0.01, "price")
    return products.withColumn("why", why).where("why is not null")


def has_subscription(products: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    said = r"(?i)subscri(?:be|ption)|auto-?renew|订阅"
    out = products.groupBy("site").agg(F.bool_or(F.coalesce(F.col("title").rlike(said), F.lit(False))).alias("s"))
    if texts is not None:
        out = out.union(texts.groupBy("site").agg(F.bool_or(F.coalesce(F.col("text").rlike(said), F.lit(False)))))
    return out.groupBy("site").agg(F.bool_or("s").alias("subscription"))


def band(price: Column) -> Column:
    """Lower edge of the price's band."""
    out = F.lit(None).cast("int")
    for edge in PRICE_EDGES:
        out = F.when(price >= edge, F.lit(edge)).otherwise(out)
    return out


def band_top(edge: Column) -> Column:
    out = F.lit(None).cast("int")
    for low, high in zip(PRICE_EDGES, PRICE_EDGES[1:]):
        out = F.when(edge == low, F.lit(high)).otherwise(out)
    return out


def quartiles(price: Column | str, places: int = 2) -> list[Column]:
    """min, p25, median, p75, max as named aggregates (exact percentiles)."""
    p = F.col(price) if isinstance(price, str) else price
    named = {"price_min": F.min(p), "price_p25": F.percentile(p, 0.25), "price_median": F.percentile(p, 0.5), "price_p75": F.percentile(p, 0.75), "price_max": F.max(p)}
    return [F.round(c, places).alias(k) for k, c in named.items()]


def product_rows(products: DataFrame, currency: Column | None = None, base: Column | None = None) -> DataFrame:
    """One flat row for each product (the 17 columns of the product file) and
    the measures the statistics need."""
    shown = F.filter("options", lambda o: (o["name"] != "") & ~((o["name"] == "Title") & ((F.size(o["values"]) <= 0) | (F.array_join(o["values"], "|") == "Default Title"))))
    v = F.coalesce(F.col("variants"), F.array().cast(products.schema["variants"].dataType))
    rows = products.withColumn("variants", v)
    flags = availability(F.col("variants"))
    return rows.select(
        *[c for c in ("site", "snapshot_id") if c in products.columns],
        "id", F.coalesce("handle", F.lit("")).alias("handle"),
        F.when(F.coalesce("handle", F.lit("")) != "", F.concat(base if base is not None else F.lit(""), F.lit("/products/"), "handle")).otherwise("").alias("url"),
        "title", F.trim(F.coalesce("product_type", F.lit(""))).alias("product_type"), F.trim(F.coalesce("vendor", F.lit(""))).alias("vendor"),
        F.array_join("tags", ", ").alias("tags"), lowest_price().alias("price_min"), highest_price().alias("price_max"),
        F.array_max(F.transform("variants", lambda x: to_float(x["compare_at_price"]))).alias("compare_at_max"),
        F.coalesce(currency if currency is not None else F.lit(""), F.lit("")).alias("currency"), F.size("variants").alias("variant_count"),
        F.array_join(F.transform(F.coalesce(shown, F.array().cast(products.schema["options"].dataType)), lambda o: o["name"]), "/").alias("options"),
        flags.cast("string").alias("available"), "created_at", "published_at", F.lit("products_json").alias("source"),
        best_depth().alias("depth"), is_real(F.col("title"), F.col("handle"), F.col("product_type"), lowest_price(), F.col("variants")).alias("is_real"),
        in_stock(F.col("variants")).alias("in_stock"),
    )


def catalogue_stats(rows: DataFrame, keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    """The one-row summary of each catalogue from its product rows."""
    p, real = F.col("price_min"), F.col("is_real") & F.col("price_min").isNotNull()
    stocked = real & F.col("in_stock")
    named = lambda head, cond: [F.round(c, 2).alias(f"{head}_{k}") for k, c in (
        ("count", F.count(F.when(cond, p)).cast("double")), ("min", F.min(F.when(cond, p))), ("p25", F.percentile(F.when(cond, p), 0.25)),
        ("median", F.percentile(F.when(cond, p), 0.5)), ("p75", F.percentile(F.when(cond, p), 0.75)), ("max", F.max(F.when(cond, p))),
    )]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), *named("price", p.isNotNull()), *named("real", real), *named("stock", stocked),
        F.round(F.count("depth") / F.count(F.lit(1)), 4).alias("on_sale_share"), F.round(F.median("depth"), 4).alias("discount_depth_median"),
        F.median("variant_count").alias("variants_median"), F.max("variant_count").alias("variants_max"),
        F.round(F.count_if(F.col("variant_count") > 1) / F.count(F.lit(1)), 4).alias("multi_variant_share"),
        F.min(F.substring("created_at", 1, 10)).alias("created_first"), F.max(F.substring("created_at", 1, 10)).alias("created_last"),
        F.count_if(F.col("available") == "true").alias("available"), F.count_if(F.col("available") == "false").alias("sold_out"),
        F.count_if(F.col("available").isNull()).alias("availability_unknown"),
    )


def sample_stats(rows: DataFrame, population: Column | None = None, keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    """Price statistics of sampled pages; what a sample cannot tell is null."""
    n = F.count("price_min")
    return rows.groupBy(*keys).agg(
        n.alias("sample_size"), *quartiles("price_min"), F.max(population if population is not None else F.lit(None).cast("long")).alias("population"),
        (n < SAMPLE_SMALL).alias("small_sample"), F.lit(None).cast("double").alias("on_sale_share"), F.lit(None).cast("long").alias("available"),
    )


def price_bands(rows: DataFrame, price: str = "price_min", keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    """Counts of products by price band; empty bands do not appear."""
    edged = rows.withColumn("band_from", band(F.col(price))).where("band_from is not null")
    return edged.groupBy(*keys, "band_from").agg(F.count(F.lit(1)).alias("count")).withColumn("band_to", band_top(F.col("band_from")))


def top_n(rows: DataFrame, value: str, order: list, n: int = 10, keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    """Most frequent values; ties go to the value seen first by ``order``."""
    counts = rows.where((F.col(value) != "") & F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct(*order)).alias("_first")
    )
    ranked = Window.partitionBy(*keys).orderBy(F.desc("count"), "_first", value) if keys else Window.orderBy(F.desc("count"), "_first", value)
    if not keys:
        return counts.orderBy(F.desc("count"), "_first", value).limit(n).drop("_first")
    return counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n).drop("_first")


def published_by_month(rows: DataFrame, col: str = "published_at", keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    month = F.substring(col, 1, 7)
    return rows.where(F.length(month) == 7).groupBy(*keys, month.alias("month")).agg(F.count(F.lit(1)).alias("count"))


def months_zero_filled(rows: DataFrame, ref_month: Column, col: str = "published_at", months: int = 6, keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    """The last ``months`` months up to the reference, zero where none."""
    last = F.to_date(F.concat(ref_month, F.lit("-01")))
    spine = rows.select(*keys, F.explode(F.sequence(F.add_months(last, -(months - 1)), last, F.expr("interval 1 month"))).alias("_d")).distinct()
    spine = spine.select(*keys, F.date_format("_d", "yyyy-MM").alias("month"))
    return spine.join(published_by_month(rows, col, keys), [*keys, "month"], "left").select(*keys, "month", F.coalesce("count", F.lit(0)).alias("count"))


def coverage(info: DataFrame, endpoints: DataFrame) -> DataFrame:
    """How complete a run is: state of the product feed, limited endpoints."""
    limited = endpoints.where("result in ('blocked', 'error') or truncated").groupBy("site", "snapshot_id").agg(
        F.array_sort(F.collect_set("file")).alias("limited_endpoints"), F.bool_or(F.col("http_status") == 429).alias("rate_limited")
    )
    both = info.join(limited, ["site", "snapshot_id"], "left")
    state = (
        F.when(F.coalesce("rate_limited", F.lit(False)), "rate_limited").when(F.col("result") != "ok", F.col("result"))
        .when(F.col("pagination_complete"), "ok").otherwise("partial")
    )
    return both.select("site", "snapshot_id", "pages", state.alias("products_json"), F.coalesce("limited_endpoints", F.array().cast("array<string>")).alias("limited_endpoints"))


def identity_status(signals: DataFrame, endpoints: DataFrame) -> DataFrame:
    """confirmed, probable, not_shopify or unconfirmed by the number of signals
    and the state of the core endpoints."""
    n = signals.groupBy("site").agg(F.countDistinct("name").alias("n"))
    core = endpoints.where("key in ('meta_json', 'products_json', 'homepage', 'sitemap')").groupBy("site").agg(
        F.count_if(~F.col("result").isin("ok", "not_found")).alias("bad"), F.bool_or("truncated").alias("cut"),
        F.bool_or((F.col("key") == "homepage") & (F.col("result") == "ok")).alias("home"), F.countDistinct("key").alias("seen"),
    )
    both = core.join(n, "site", "full_outer")
    clean = F.col("home") & ~F.col("cut") & (F.col("bad") == 0) & (F.col("seen") == 4)
    status = F.when(F.col("n") >= 2, "confirmed").when(F.col("n") == 1, "probable").when(F.coalesce(clean, F.lit(False)), "not_shopify").otherwise("unconfirmed")
    return both.select("site", status.alias("identity_status"))


def count_mismatch(counted: Column, stated: Column, share: float) -> Column:
    """Two counts differ by more than the share of the stated one."""
    return F.when(stated > 0, F.abs(counted - stated) / stated > share)


def description_stats(products: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Median description length and number of short descriptions."""
    length = F.length(F.trim(F.regexp_replace(F.coalesce("body_html", F.lit("")), r"(?s)<[^>]+>", " ")))
    return products.groupBy(*keys).agg(F.median(length).alias("description_median"), F.count_if(length < TEXT_SHORT).alias("short_descriptions"))


def rows_from_variants(products: DataFrame, variants: DataFrame, key: str = "product_key") -> DataFrame:
    """Product rows from a flat variant table (key, price, compare_at_price,
    available): one shuffle on the key, partial sums on the map side."""
    facts = variants.groupBy(key).agg(
        F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.max("compare_at_price").alias("compare_at_max"),
        F.max(depth(F.col("price"), F.col("compare_at_price"))).alias("depth"), F.count(F.lit(1)).alias("variant_count"),
        F.bool_or("available").alias("_avail"), F.bool_or(~F.col("available").eqNullSafe(F.lit(False))).alias("in_stock"),
    )
    rows = products.join(facts, key, "left")
    return rows.withColumns({
        "variant_count": F.coalesce("variant_count", F.lit(0)), "available": F.col("_avail").cast("string"), "in_stock": F.coalesce("in_stock", F.lit(False)),
        "is_real": is_real(F.col("title"), F.col("handle"), F.col("product_type"), F.col("price_min")),
    }).drop("_avail")
