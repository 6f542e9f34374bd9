"""Reading captured runs: files, request logs, product pages, sitemaps, robots,
exports, rates. Collection itself (network) is not part of an engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..functions import urls as U
from . import lenient_json

PAGE_SIZES = (30, 50, 250)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """site, snapshot_id, file, content of files laid out as
    ``path/site=.../snapshot_id=.../FILE`` (or ``path/FILE``)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.nullif(F.regexp_extract("path", rf"/{k}=([^/]+)/", 1), F.lit(""))
    return raw.select(
        F.coalesce(part("site"), F.lit("")).alias("site"), F.coalesce(part("snapshot_id"), F.lit("")).alias("snapshot_id"),
        name.alias("file"), T.read_utf8("content").alias("content"),
    )


def requests_of(files: DataFrame) -> DataFrame:
    """Request log rows of the ``_status.json`` files."""
    kind = f"struct<requests:array<struct<{schemas.REQUEST.replace(' ', ':').replace(',:', ',')}>>>"
    log = files.where("file = '_status.json'").select("site", "snapshot_id", F.from_json("content", kind).alias("s"))
    return log.select("site", "snapshot_id", F.explode("s.requests").alias("r")).select("site", "snapshot_id", "r.*")


def endpoint_states(files: DataFrame, requests: DataFrame, salvage_key: str = "products") -> DataFrame:
    """State of each endpoint from the file and the request log: ok, ok with
    truncated, blocked, error, not_found, not_checked."""
    parsed = lenient_json.states(files.where("file like '%.json'"), salvage_key=salvage_key).select("site", "snapshot_id", "file", "state")
    others = files.where("file not like '%.json'").select(
        "site", "snapshot_id", "file", F.when(T.looks_blocked("content"), "blocked").when(F.trim("content") == "", "error").otherwise("ok").alias("state")
    )
    log = requests.select("site", "snapshot_id", "file", "key", "url", "http_status", "result", "note")
    both = log.join(parsed.unionByName(others), ["site", "snapshot_id", "file"], "full_outer")
    state = (
        F.when(F.col("state").isin("ok", "extracted", "salvaged"), "ok").when(F.col("state").isNotNull() & (F.coalesce("result", F.lit("ok")) == "ok"), F.col("state"))
        .when(F.col("result").isNotNull() & (F.col("result") != "ok"), F.col("result")).when(F.col("state").isNotNull(), F.col("state")).otherwise("not_checked")
    )
    return both.select("site", "snapshot_id", "file", "key", "url", "http_status", state.alias("result"), (F.coalesce("state", F.lit("")) == "salvaged").alias("truncated"), "note")


def numbered(file_col: str, prefix: str, suffix: str) -> Column:
    """Page number of PREFIXnSUFFIX, null for other names."""
    return F.regexp_extract(F.col(file_col), rf"^{prefix}(\d+)\.{suffix}$", 1).try_cast("int")


def load_products(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products of all pages (first of each id or handle stays, rows with
    neither all stay) and the completeness of each run's pagination."""
    pages = files.withColumn("page", numbered("file", "products-", "json")).where("page is not null")
    parsed = lenient_json.states(pages, salvage_key="products")
    fields = schemas.PRODUCT.replace("tags array<string>", "tags string")
    kind = "struct<products:array<struct<" + ",".join(_colon(f) for f in _split(fields)) + ">>>"
    read = parsed.withColumn("_p", F.from_json("json", kind, {"mode": "PERMISSIVE"})["products"])
    length = F.when(F.col("_p").isNotNull(), F.size("_p"))
    last = F.max_by(length, F.col("page"))
    info = read.groupBy("site", "snapshot_id").agg(
        F.count(F.lit(1)).alias("pages"), F.bool_or(F.col("state") == "salvaged").alias("truncated"),
        last.alias("_last"), F.max(length).alias("_most"), F.count(length).alias("_known"),
        F.when(F.bool_or(F.col("state").isin("ok", "extracted", "salvaged")), "ok").when(F.bool_or(F.col("state") == "blocked"), "blocked").otherwise("error").alias("result"),
    )
    whole = (F.col("_last") == 0) | (F.col("_last") < F.col("_most")) | ((F.col("_known") == 1) & ~F.col("_last").isin(*PAGE_SIZES))
    info = info.select("site", "snapshot_id", "pages", "result", "truncated", (F.coalesce(whole, F.lit(False)) & ~F.col("truncated")).alias("pagination_complete"))
    rows = read.select("site", "snapshot_id", "page", F.posexplode("_p").alias("pos", "p"))
    key = F.coalesce(F.col("p.id").cast("string"), F.col("p.handle"))
    first = Window.partitionBy("site", "snapshot_id", "_key").orderBy("page", "pos")
    rows = rows.withColumn("_key", key).withColumn("_n", F.when(F.col("_key").isNull(), 1).otherwise(F.row_number().over(first))).where("_n = 1")
    # tags come as an array or as one text with commas
    raw = F.regexp_replace(F.col("p.tags"), r'^\[|\]$|"', "")
    tags = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    return rows.select("site", "snapshot_id", "page", "pos", "p.*").withColumn("tags", F.coalesce(tags, F.array().cast("array<string>"))), info


def _split(fields: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def _colon(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}:{kind}"


def sitemap_products(files: DataFrame) -> DataFrame:
    """handle, lastmod of the product entries of sitemaps; a page without
    ``<url>`` blocks is read by its bare ``<loc>`` entries."""
    maps = files.where("file like 'sitemap%.xml'")
    entries = F.regexp_extract_all("content", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    bare = F.regexp_extract_all("content", F.lit(r"(?is)(<loc>.*?</loc>)"), F.lit(1))
    rows = maps.select("site", "snapshot_id", "file", F.posexplode(F.when(F.size(entries) > 0, entries).otherwise(bare)).alias("pos", "e"))
    loc = F.trim(F.regexp_extract("e", r"(?is)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>", 1))
    mod = F.nullif(F.trim(F.regexp_extract("e", r"(?is)<lastmod>(.*?)</lastmod>", 1)), F.lit(""))
    return rows.select("site", "snapshot_id", "file", "pos", U.product_handle(loc).alias("handle"), mod.alias("lastmod")).where("handle is not null")


def robots_rules(files: DataFrame, text_col: str = "content", keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    """Disallow prefixes that hold for every agent: a running group number over
    the lines ties each rule to the user-agent lines above it."""
    rows = files.select(*keys, F.posexplode(F.split(text_col, "\r?\n")).alias("ln", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    name, value = F.lower(F.trim(F.substring_index(bare, ":", 1))), F.trim(F.regexp_replace(bare, "^[^:]*:", ""))
    rows = rows.withColumns({"name": name, "value": value}).where("name in ('user-agent', 'disallow', 'allow')")
    order = Window.partitionBy(*keys).orderBy("ln")
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("grp", F.sum(starts.cast("int")).over(order))
    every = rows.where("name = 'user-agent' and value = '*'").select(*keys, "grp").distinct()
    return rows.where("name = 'disallow' and value <> ''").join(every, [*keys, "grp"], "left_semi").select(*keys, F.col("value").alias("prefix")).distinct()


def blocks_all(rules: DataFrame, keys: tuple[str, ...] = ("site", "snapshot_id")) -> DataFrame:
    return rules.groupBy(*keys).agg(F.bool_or(F.col("prefix") == "/").alias("blocks_all"))


def allowed(links: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("site", "snapshot_id"), url_col: str = "url") -> DataFrame:
    """Links whose path stands under no disallowed prefix."""
    banned = rules.groupBy(*keys).agg(F.collect_set("prefix").alias("_banned"))
    joined = links.join(banned, list(keys), "left")
    path = U.path_of(url_col)
    return joined.where(~F.coalesce(F.exists("_banned", lambda p: F.startswith(path, p)), F.lit(False))).drop("_banned")


def export_products(rows: DataFrame) -> DataFrame:
    """Flat product export (one row for each variant) to nested products: first
    title of a handle, variants only where a price stands. Needs ``line``."""
    c = lambda n: F.col(f"`{n}`")
    variant = F.struct(
        F.col("line").alias("line"), c("Variant Price").alias("price"), c("Variant Compare At Price").alias("compare_at_price"),
        (F.lower(c("Variant Requires Shipping")) != "false").alias("requires_shipping"),
    )
    named = lambda n: F.min_by(F.nullif(F.trim(c(n)), F.lit("")), F.when(F.trim(c(n)) != "", F.col("line")))
    out = rows.where(F.trim(c("Handle")) != "").groupBy(F.trim(c("Handle")).alias("handle")).agg(
        F.min("line").alias("line"), named("Title").alias("title"), named("Vendor").alias("vendor"), named("Type").alias("product_type"),
        F.array_sort(F.collect_list(F.when(F.trim(c("Variant Price")) != "", variant))).alias("variants"),
    )
    return out


def read_sheet(spark: SparkSession, path: str, aliases: dict[str, str]) -> DataFrame:
    """Input sheet: separator by its first 2,000 characters, header row found by
    alias, comment and blank rows skipped, line numbers kept. A sheet is read
    as one file on one executor; its size is that of a form, not of a table."""
    text = spark.read.format("binaryFile").load(path).select(T.decode_any("content").alias("t"))
    head = F.substring("t", 1, 2000)
    sep = F.when(F.regexp_count(head, F.lit("\t")) > F.regexp_count(head, F.lit(",")), "\t").otherwise(",")
    rows = text.select(sep.alias("sep"), F.posexplode(F.split("t", "\r?\n")).alias("ln", "raw"))
    rows = rows.where("trim(raw) <> '' and not startswith(trim(raw), '#')")
    kind = "c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string, c7 string"
    cells = F.when(F.col("sep") == ",", F.from_csv("raw", kind)).otherwise(F.from_csv("raw", kind, {"sep": "\t"}))
    rows = rows.select("ln", cells.alias("c")).select("ln", F.array(*[f"c.c{i}" for i in range(8)]).alias("cells"))
    known = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)])
    named = F.transform("cells", lambda x: F.try_element_at(known, F.lower(F.trim(x))))
    heads = rows.withColumn("names", named).withColumn("hits", F.size(F.filter("names", lambda n: n.isNotNull()))).where("hits >= 2")
    first = heads.agg(F.min_by(F.struct("ln", "names"), F.col("ln")).alias("h")).select("h.*").withColumnRenamed("ln", "head_ln")
    body = rows.crossJoin(F.broadcast(first)).where("ln > head_ln")
    pairs = F.map_from_entries(F.filter(F.zip_with("names", "cells", lambda n, x: F.struct(n.alias("key"), F.trim(x).alias("value"))), lambda e: e["key"].isNotNull()))
    return body.select((F.col("ln") + 1).alias("line"), pairs.alias("row"))


def euro_rates(spark: SparkSession, xml_rows: DataFrame, base: str = "CNY") -> DataFrame:
    """currency, per_unit: ``base`` units for one unit of each currency, from
    daily euro rates (currency, rate); four places, half even."""
    cny = xml_rows.where(F.col("currency") == base).select(F.col("rate").cast("decimal(18,6)").alias("_b"))
    euro = spark.createDataFrame([("EUR", "1")], "currency string, rate string")
    rates = xml_rows.select("currency", F.col("rate").cast("string").alias("rate")).union(euro).where(F.col("currency") != base)
    return rates.crossJoin(F.broadcast(cny)).select("currency", F.bround(F.col("_b") / F.col("rate").cast("decimal(18,6)"), 4).cast("decimal(18,4)").alias("per_unit"))


def archive_captures(rows: DataFrame, json_col: str = "content") -> DataFrame:
    """timestamp, original of an archive index (an array of rows, header first)."""
    from ..functions.dates import archive_stamp

    out = rows.select(F.posexplode(F.from_json(json_col, "array<array<string>>")).alias("i", "r")).where("i > 0")
    return out.select(F.col("r")[0].alias("stamp"), F.col("r")[1].alias("original"), archive_stamp(F.col("r")[0]).alias("captured"))


def crawl(links: DataFrame, start: DataFrame, depth: int = 2, prefer: str = r"polic|refund|return|shipping|privacy|terms|contact") -> DataFrame:
    """url, depth of pages reached from the start pages: breadth first by one
    join for each level, each page at its least depth; policy-like links first."""
    seen = start.select("url").distinct().withColumn("depth", F.lit(0))
    edge = links.select(F.col("src").alias("url"), "dst").distinct()
    front = seen
    for d in range(1, depth + 1):
        step = front.select("url").join(edge, "url").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = step.withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen.withColumn("priority", F.when(F.col("url").rlike(f"(?i){prefer}"), 0).otherwise(1))
