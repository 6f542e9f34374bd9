"""Price facts of product pages: structured data first, then meta tags.

JSON-LD documents are walked as VARIANT values, level by level, inside one
projection: no row moves until every object of a page is a row of its own. What
belongs together (offers to products, variants to their group, references to the
node they name) is then joined within the page.

Bounds, as values of the data model: an object deeper than ``MAX_DEPTH`` counts for
nothing, and of a document with over ``MAX_NODES`` objects those nearest its root
count. Keys of an object are walked by name, as VARIANT keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..plans.staging import cut

MAX_DEPTH, MAX_NODES = 12, 5000
LD_SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script"
#: Kinds, words of availability, marks of a price that was struck out.
PRODUCT_KINDS, OFFER_KINDS = ("Product", "ProductGroup"), ("Offer", "AggregateOffer")
IN_STOCK, OUT_OF_STOCK, STRUCK = "instock|limitedavailability|preorder", "outofstock|soldout|discontinued", "Strikethrough|ListPrice"
META_PRICES, META_CURRENCIES = ("og:price:amount", "product:price:amount"), ("og:price:currency", "product:price:currency")

_ITEM = "struct<path:string,offers_of:string,variant_of:string,v:variant>"


def _get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def _text(v: Column, key: str) -> Column:
    """A string member; numbers and objects are none."""
    return F.when(F.schema_of_variant(_get(v, key, "variant")) == "STRING", _get(v, key))


def money(v: Column, key: str) -> Column:
    """A number, or text of digits with thousands separators; else null."""
    kind, said = F.schema_of_variant(_get(v, key, "variant")), F.replace(F.trim(_get(v, key)), F.lit(","), F.lit(""))
    return F.when(kind == "STRING", F.when(said.rlike(r"^\d+(\.\d+)?$"), said.try_cast("double"))).when(kind != "BOOLEAN", said.try_cast("double"))


def types(v: Column) -> Column:
    """Last path segments of @type, which is a text or a list."""
    listed = F.coalesce(_get(v, "@type", "array<string>"), F.array_compact(F.array(_text(v, "@type"))))
    return F.transform(listed, lambda t: F.substring_index(t, "/", -1))


def _is(v: Column, kinds: tuple[str, ...]) -> Column:
    return F.arrays_overlap(types(v), F.array(*[F.lit(k) for k in kinds]))


def _offer_like(v: Column) -> Column:
    return _is(v, OFFER_KINDS) | _get(v, "price", "variant").isNotNull() | _get(v, "lowPrice", "variant").isNotNull()


def _objects(v: Column) -> Column:
    """The objects of a value that is one object or a list of them."""
    one = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), one, F.array().cast("array<variant>"))


def _below(item: Column) -> Column:
    """The objects and lists right below an object or list, each with the object
    whose offer or variant it is (through lists, and offers of offers)."""
    v = item["v"]
    members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    owner = F.when(item["offers_of"].isNotNull() & _offer_like(v), item["offers_of"]).otherwise(item["path"])
    group = F.when(_is(v, PRODUCT_KINDS), item["path"])

    def member(e: Column) -> Column:
        return F.struct(
            F.concat(item["path"], F.lit("/"), e["key"]).alias("path"), F.when(e["key"] == "offers", owner).alias("offers_of"),
            F.when(e["key"] == "hasVariant", group).alias("variant_of"), e["value"].alias("v"),
        )

    def element(x: Column, i: Column) -> Column:
        return F.struct(F.concat(item["path"], F.lit("/"), i.cast("string")).alias("path"), item["offers_of"].alias("offers_of"), item["variant_of"].alias("variant_of"), x.alias("v"))

    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), element)
    both = F.coalesce(F.transform(members, member), listed, F.array().cast(f"array<{_ITEM}>"))
    return F.filter(both, lambda e: F.schema_of_variant(e["v"]).rlike("^(OBJECT|ARRAY)"))


def nodes(pages: DataFrame) -> DataFrame:
    """(page, doc, pos, node, ...) for every object of the JSON-LD of ``pages``
    (page, html). A document that is no valid JSON is read once more with its
    character references decoded, and else left out."""
    docs = pages.select("page", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LD_SCRIPT), F.lit(1))).alias("doc", "raw"))
    decoded = F.when(F.try_parse_json("raw").isNull(), F.try_parse_json(html.unescape("raw")))
    rows = docs.withColumn("v", F.coalesce(F.try_parse_json("raw"), decoded)).where("v is not null").select("page", "doc", "v")
    none = F.lit(None).cast("string")
    root = F.array(F.struct(F.lit("").alias("path"), none.alias("offers_of"), none.alias("variant_of"), F.col("v")))
    rows = rows.select("page", "doc", F.array().cast(f"array<{_ITEM}>").alias("above"), root.alias("level"))
    above, level = F.concat("above", "level").alias("above"), F.flatten(F.transform("level", _below)).alias("level")
    for _ in range(MAX_DEPTH):
        rows = rows.select("page", "doc", above, level)
    objects = F.filter(F.concat("above", "level"), lambda e: F.schema_of_variant(e["v"]).startswith("OBJECT"))
    each = rows.select("page", "doc", F.posexplode(F.slice(objects, 1, MAX_NODES)).alias("pos", "e")).select("page", "doc", "pos", "e.*")
    v, at = F.col("v"), lambda c: F.concat(F.col("doc").cast("string"), F.lit(":"), c)
    prices = F.transform(_objects(_get(v, "priceSpecification", "variant")), lambda s: F.struct(F.coalesce(_get(s, "priceType"), F.lit("")).rlike(STRUCK).alias("struck"), money(s, "price").alias("price")))
    stock = F.lower(_get(v, "availability"))
    return each.select(
        "page", F.struct("doc", "pos").alias("pos"), at(F.col("path")).alias("node"), at(F.col("offers_of")).alias("offers_of"), at(F.col("variant_of")).alias("variant_of"),
        F.nullif(F.trim(_text(v, "@id")), F.lit("")).alias("ref"), _is(v, PRODUCT_KINDS).alias("is_product"), _offer_like(v).alias("is_offer"),
        _get(v, "offers", "variant").isNotNull().alias("has_offers"), F.nullif(F.trim(_text(v, "name")), F.lit("")).alias("title"),
        F.array_compact(F.array(_text(v, "url"), _text(v, "@id"))).alias("urls"), money(v, "price").alias("price"), money(v, "lowPrice").alias("low"), money(v, "highPrice").alias("high"),
        F.nullif(F.upper(F.trim(_text(v, "priceCurrency"))), F.lit("")).alias("currency"), F.when(stock.rlike(IN_STOCK), True).when(stock.rlike(OUT_OF_STOCK), False).alias("available"),
        F.filter(prices, lambda s: s["price"].isNotNull()).alias("stated"),
    )


def _most_frequent(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, currency: the most frequent one, the first of equally frequent ones."""
    counted = df.where("currency is not null").groupBy(*keys, "currency").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counted.groupBy(*keys).agg(F.min_by("currency", F.struct(-F.col("n"), "first")).alias("currency"))


def structured_facts(pages: DataFrame) -> DataFrame:
    """page, title, price, price_max, compare_at, currency, available of the
    page's own product.

    Variants belong to their group. Products whose address, or that of an offer or
    a variant, is the page's ``handle`` are its own; without one, a page that
    describes exactly one product, with a price, is about that product; else the
    page has no structured price.
    """
    every = cut(nodes(pages), "nodes")
    products = every.where("is_product")
    # a reference names the first node with offers, else the last that bears it
    order = F.struct(~F.col("has_offers"), F.when(F.col("has_offers"), F.col("pos.doc")).otherwise(-F.col("pos.doc")), F.when(F.col("has_offers"), F.col("pos.pos")).otherwise(-F.col("pos.pos")))
    named = products.where("ref is not null").groupBy("page", "ref").agg(F.min_by("node", order).alias("target"))
    variants = every.where("variant_of is not null").join(named, ["page", "ref"], "left").select(
        "page", F.col("variant_of").alias("owner"), "node", "ref", F.when(F.col("has_offers"), F.col("node")).otherwise(F.coalesce("target", "node")).alias("source")
    )
    variants = cut(variants, "variants")
    own = products.join(variants.select("page", "node").distinct(), ["page", "node"], "left_anti")
    own = own.join(variants.where("ref is not null").select("page", "ref").distinct(), ["page", "ref"], "left_anti")
    own = cut(own.select("page", F.col("node").alias("owner"), "pos", "title", "urls", "has_offers"), "products")

    direct = own.where("has_offers").select("page", "owner", F.col("owner").alias("source"))
    through = own.where("not has_offers").select("page", "owner").join(variants, ["page", "owner"]).select("page", "owner", "source")
    offers = every.where("offers_of is not null and is_offer").withColumnRenamed("offers_of", "source")
    sold = direct.union(through).join(offers, ["page", "source"])
    plain = F.filter("stated", lambda s: ~s["struck"])
    sold = cut(sold.select("page", "owner", "pos", "low", "high", "currency", "available", "urls", F.coalesce("price", F.try_element_at(plain, F.lit(1))["price"]).alias("price"), F.array_max(F.transform(F.filter("stated", lambda s: s["struck"]), lambda s: s["price"])).alias("struck")), "offers")
    facts = sold.groupBy("page", "owner").agg(
        F.min(F.least("price", "low")).alias("price"), F.max(F.greatest("price", "high")).alias("price_max"), F.max("struck").alias("compare_at"), F.max("available").alias("available")
    ).where("price is not null").withColumn("price_max", F.coalesce("price_max", "price"))
    facts = facts.join(_most_frequent(sold, ["page", "owner"]), ["page", "owner"], "left")

    variant_urls = own.select("page", "owner").join(variants, ["page", "owner"]).join(every.select("page", F.col("node").alias("source"), "urls"), ["page", "source"]).select("page", "owner", "urls")
    seen = own.select("page", "owner", "urls").union(sold.select("page", "owner", "urls")).union(variant_urls)
    want = urls.handle_key("handle")
    hits = seen.join(pages.select("page", "handle").hint("merge"), "page").where((want != "") & F.exists("urls", lambda u: urls.handle_key(urls.product_handle(u)) == want))
    priced = own.select("page", "owner", "pos", "title").join(facts, ["page", "owner"]).join(hits.select("page", "owner").distinct().withColumn("hit", F.lit(True)), ["page", "owner"], "left")
    counts = own.groupBy("page").agg(F.count(F.lit(1)).alias("n_products"))
    each = priced.groupBy("page").agg(F.count(F.lit(1)).alias("n_priced"), F.count("hit").alias("n_hits")).join(counts, "page")
    chosen = priced.join(each, "page").where("hit or (n_hits = 0 and n_products = 1 and n_priced = 1)")
    merged = chosen.groupBy("page").agg(
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("pos"))).alias("title"), F.min("price").alias("price"), F.max("price_max").alias("price_max"), F.max("compare_at").alias("compare_at"), F.max("available").alias("available")
    )
    return merged.join(_most_frequent(chosen, ["page"]), "page", "left")


def product_facts(pages: DataFrame) -> DataFrame:
    """page, handle, title, price, price_max, compare_at, currency, available,
    price_from (json_ld or meta) of each of ``pages`` (page, handle, html) that
    states a price. A price that was struck out is taken from structured data
    only; a missing title comes from the page."""
    meta = html.meta("html")
    of = lambda keys: F.coalesce(*[F.try_element_at("meta", F.lit(k)) for k in keys])
    digits = lambda k: F.replace(F.trim(F.try_element_at("meta", F.lit(k))), F.lit(","), F.lit(""))
    number = F.coalesce(*[F.when(digits(k).rlike(r"^\d+(\.\d+)?$"), digits(k).try_cast("double")) for k in META_PRICES])
    tagged = pages.withColumn("meta", meta).select(
        "page", "handle", number.alias("meta_price"), F.nullif(F.upper(F.trim(of(META_CURRENCIES))), F.lit("")).alias("meta_currency"),
        F.coalesce(F.nullif(F.try_element_at("meta", F.lit("og:title")), F.lit("")), html.unescape(html.title("html"))).alias("page_title"),
    )
    found = structured_facts(pages).withColumn("price_from", F.lit("json_ld"))
    rows = tagged.join(found, "page", "left").where("price is not null or meta_price is not null")
    stated = F.col("price").isNotNull()
    return rows.select(
        "page", "handle", F.coalesce("title", "page_title").alias("title"), F.coalesce("price", "meta_price").alias("price"), F.when(stated, F.col("price_max")).otherwise(F.col("meta_price")).alias("price_max"), "compare_at",
        F.when(stated, F.col("currency")).otherwise(F.col("meta_currency")).alias("currency"), "available", F.coalesce("price_from", F.lit("meta")).alias("price_from"),
    )


def sampled_variants(facts: DataFrame) -> DataFrame:
    """``facts`` with the columns of a catalogue's variants, so that its rules of
    prices apply: a title for every page, price and compare_at_price in cents."""
    cents = lambda c: F.round(F.col(c), 2).cast("decimal(18,2)")
    return facts.withColumns({"title": F.coalesce("title", "handle"), "price": cents("price"), "compare_at_price": cents("compare_at")})
