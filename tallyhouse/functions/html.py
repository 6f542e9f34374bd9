"""HTML operators. Patterns run in the JVM; the three things regular expressions
cannot do (character references, balanced tags, JSON-LD walks) are Arrow
functions."""

from __future__ import annotations

import html as _html
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .text import _col, clean_line, let

#: Marks of the store platform in page source (lower case).
PLATFORM_MARKERS = ("cdn.shopify.com", "shopify.theme", "shopify-section", ".myshopify.com", "window.shopify", "shopify-digital-wallet")
ATTRIBUTE = r"([a-zA-Z_:\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded by the full table."""
    return text.map(lambda t: None if t is None else _html.unescape(t) if "&" in t else t)


def _src(x) -> Column:
    return F.coalesce(_col(x), F.lit(""))


def drop_blocks(src, tags) -> Column:
    """Source without the blocks of the given tags."""
    names = "|".join(tags)
    return F.regexp_replace(_src(src), rf"(?is)<({names})\b.*?</\1\s*>", " ")


def to_text(src) -> Column:
    """Visible text: no scripts or styles, block ends are line ends."""
    t = drop_blocks(src, ("script", "style", "noscript", "svg", "template"))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</li>|</h\d>|</div>|</tr>|</td>|</dt>|</dd>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    # only what may hold a reference goes through Python
    coded = F.contains(_src(src), F.lit("&"))
    t = F.when(coded, unescape(F.when(coded, t).otherwise(""))).otherwise(t)
    t = F.regexp_replace(t, r"[ \t\r\f\x0B\x{A0}]+", " ")
    t = F.trim(F.regexp_replace(t, r" *\n[ \n]*", "\n"), F.lit(" \n"))
    plain = F.trim(F.regexp_replace(_src(src), r"[ \t\r\f\x0B]+", " "))
    return F.when(F.contains(_src(src), F.lit("<")), t).otherwise(plain)


def strip_tags(src) -> Column:
    return clean_line(unescape(F.regexp_replace(drop_blocks(src, ("script", "style")), r"(?s)<[^>]+>", " ")))


def is_html(text) -> Column:
    return F.lower(F.substring(_src(text), 1, 2000)).rlike("<html|<!doctype html|<body")


def tag_blocks(src, tag: str) -> Column:
    """Inner source of each (not nested) block of a tag."""
    return F.regexp_extract_all(_src(src), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def title(src) -> Column:
    return F.nullif(clean_line(F.regexp_extract(_src(src), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def attributes(tag) -> Column:
    """Map of a tag's attributes, names in lower case; the last one wins."""
    t = _src(tag)
    names = F.transform(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.zip_with(
        F.zip_with(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(2)), F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(3)), lambda a, b: F.concat(a, b)),
        F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(4)), lambda a, b: F.concat(a, b),
    )
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(let(F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), last))


def start_tags(src, tag: str) -> Column:
    """Array of the sources of each start tag."""
    return F.regexp_extract_all(_src(src), F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))


def tags(src, tag: str) -> Column:
    """Array of attribute maps of each start tag."""
    return F.transform(start_tags(src, tag), attributes)


def html_lang(src) -> Column:
    return F.nullif(F.trim(F.regexp_extract(_src(src), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)), F.lit(""))


def _rels(a) -> Column:
    return F.split(F.lower(F.coalesce(F.try_element_at(a, F.lit("rel")), F.lit(""))), r"\s+")


def hreflang(src) -> Column:
    """Array of struct(code, href) of alternate links in order, distinct. Attributes
    are read of links alone that name the one asked for."""
    named = F.filter(start_tags(src, "link"), lambda t: t.rlike("(?i)hreflang"))
    found = F.filter(F.transform(named, attributes), lambda a: F.array_contains(_rels(a), "alternate") & F.try_element_at(a, F.lit("hreflang")).isNotNull())
    pair = lambda a: F.struct(F.trim(F.try_element_at(a, F.lit("hreflang"))).alias("code"), F.trim(F.coalesce(F.try_element_at(a, F.lit("href")), F.lit(""))).alias("href"))
    return F.array_distinct(F.transform(found, pair))


def canonical(src) -> Column:
    found = F.filter(tags(src, "link"), lambda a: F.array_contains(_rels(a), "canonical"))
    return F.nullif(F.trim(F.try_element_at(F.try_element_at(found, F.lit(1)), F.lit("href"))), F.lit(""))


def has_favicon(src) -> Column:
    return F.exists(tags(src, "link"), lambda a: F.array_contains(_rels(a), "icon") | F.array_contains(_rels(a), "apple-touch-icon"))


def meta(src) -> Column:
    """Map of meta property or name (lower case) to content, first wins."""
    key = lambda a: F.lower(F.coalesce(F.try_element_at(a, F.lit("property")), F.try_element_at(a, F.lit("name"))))
    pairs = F.transform(tags(src, "meta"), lambda a: F.struct(key(a).alias("key"), F.try_element_at(a, F.lit("content")).alias("value")))
    named = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    first = lambda named: F.filter(named, lambda p, i: ~F.exists(F.slice(named, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(let(named, first))


def noindex(src) -> Column:
    told = F.filter(tags(src, "meta"), lambda a: F.lower(F.try_element_at(a, F.lit("name"))).isin("robots", "googlebot"))
    said = F.filter(F.transform(told, lambda a: F.try_element_at(a, F.lit("content"))), lambda c: F.contains(F.lower(c), F.lit("noindex")))
    return F.try_element_at(said, F.lit(1))


def links(src) -> Column:
    """Array of struct(href, text) of anchors in page order."""
    pattern = F.lit(r"(?is)<a\b([^>]*)>(.*?)</a\s*>")
    heads = F.regexp_extract_all(_src(src), pattern, F.lit(1))
    bodies = F.regexp_extract_all(_src(src), pattern, F.lit(2))
    href = lambda h: F.coalesce(F.try_element_at(attributes(h), F.lit("href")), F.lit(""))
    said = lambda b: clean_line(F.regexp_replace(b, r"(?s)<[^>]+>", " "))
    both = F.zip_with(heads, bodies, lambda h, b: F.struct(F.trim(href(h)).alias("href"), said(b).alias("text")))
    return F.filter(both, lambda x: x["href"] != "")


def footer(src) -> Column:
    """Footer blocks, else the last quarter of the page."""
    own = F.concat_ws("\n", tag_blocks(src, "footer"))
    n = F.length(_src(src))
    return F.when(own != "", own).otherwise(_src(src).substr((n * 0.75).cast("int") + 1, n))


def header(src) -> Column:
    return F.concat_ws("\n", F.concat(tag_blocks(src, "header"), tag_blocks(src, "nav")))


def announcement(src) -> Column:
    """Text of announcement bars, by the names their blocks carry."""
    found = F.regexp_extract_all(
        _src(src), F.lit(r"(?is)<(?:div|section|aside|p)\b[^>]*(?:announcement|promo-bar|top-bar|topbar)[^>]*>(.{0,3000})"), F.lit(1)
    )
    return F.concat_ws("\n", F.transform(found, lambda x: F.substring(clean_line(F.regexp_replace(x, r"(?s)<[^>]+>", " ")), 1, 400)))


def main_block(src) -> Column:
    """Longest main block, else the body without header, footer and menus."""
    longest = F.try_element_at(F.array_sort(F.transform(tag_blocks(src, "main"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(1))["x"]
    body = F.coalesce(F.try_element_at(tag_blocks(src, "body"), F.lit(1)), _src(src))
    return F.coalesce(longest, drop_blocks(body, ("header", "footer", "nav")))


def main_part(src) -> Column:
    """Source of a page's own text: the platform's policy block, else the main block."""
    marked = F.when(F.contains(_src(src), F.lit("shopify-policy__body")), _src(src)).otherwise("")
    return F.coalesce(balanced_div(marked, F.lit("shopify-policy__body")), main_block(src))


def page_text(src) -> Column:
    return to_text(main_part(src))


def is_platform(text) -> Column:
    return F.size(platform_markers(text)) >= 1


def platform_markers(text) -> Column:
    low = F.lower(_src(text))
    return F.filter(F.array(*[F.lit(m) for m in PLATFORM_MARKERS]), lambda m: F.contains(low, m))


def is_password_page(src, final_url) -> Column:
    low = F.lower(F.substring(_src(src), 1, 200000))
    path = F.coalesce(F.regexp_extract(_col(final_url), r"^https?://[^/]+([^?#]*)", 1), F.lit(""))
    form = low.rlike(r"<form[^>]+action=[\"'][^\"']*/password[\"']")
    return path.rlike("/password/?$") | form | F.contains(low, F.lit("template-password")) | F.contains(low, F.lit('id="password-page'))


def scripted(src) -> Column:
    """The source of a page that scripts may draw, null of any other."""
    scripts = F.regexp_count(_src(src), F.lit(r"(?i)<script\b"))
    root = _src(src).rlike(r"(?i)id=[\"'](?:app|root|__next|__nuxt)[\"']")
    return F.when((scripts >= 3) | ((scripts >= 1) & root), _src(src))


def js_rendered(drawn) -> Column:
    """Almost no text without scripts, of a source by ``scripted``."""
    words = F.size(F.filter(F.split(to_text(drawn), r"\s+"), lambda w: w != ""))
    return _col(drawn).isNotNull() & (words < 25)


@F.pandas_udf(StringType())
def balanced_div(src: pd.Series, marker: pd.Series) -> pd.Series:
    """Inner source of the first div whose start tag holds the marker, with
    nested divs counted; null without one."""
    import re

    edge = re.compile(r"<(/?)div\b[^>]*>", re.I)

    def one(page, mark):
        if not page or not mark or mark not in page:
            return None
        depth, start = 0, None
        for m in edge.finditer(page):
            if start is None:
                if not m[1] and mark in m[0]:
                    start, depth = m.end(), 1
            else:
                depth += -1 if m[1] else 1
                if not depth:
                    return page[start : m.start()]
        return page[start:] if start is not None else None

    return pd.Series([one(p, m) for p, m in zip(src, marker)], dtype=object)


_LD_FIELDS = {
    "pos": IntegerType(), "depth": IntegerType(), "types": ArrayType(StringType()), "ref": StringType(), "name": StringType(), "url": StringType(),
    "price": DoubleType(), "low": DoubleType(), "high": DoubleType(), "compare_at": DoubleType(), "currency": StringType(),
    "available": BooleanType(), "parent": StringType(),
}
LD_TYPE = ArrayType(StructType([StructField(k, v) for k, v in _LD_FIELDS.items()]))
MAX_DEPTH, MAX_NODES = 12, 5000


@F.pandas_udf(LD_TYPE)
def json_ld(src: pd.Series) -> pd.Series:
    """Nodes of a page's JSON-LD in pre-order, at most 12 deep and 5,000 in all:
    types, id, url, prices of the node's own offers, availability."""
    import re

    script = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script", re.I | re.S)

    def number(x):
        if isinstance(x, bool):
            return None
        text = str(x).replace(",", "").strip()
        return float(text) if re.fullmatch(r"\d+(\.\d+)?", text) else None

    def listed(x):
        return x if isinstance(x, list) else [] if x is None else [x]

    def offer(node):
        out = {"price": number(node.get("price")), "low": number(node.get("lowPrice")), "high": number(node.get("highPrice"))}
        out["currency"] = node.get("priceCurrency") if isinstance(node.get("priceCurrency"), str) else None
        said = str(node.get("availability") or "").rsplit("/", 1)[-1]
        out["available"] = True if said in ("InStock", "LimitedAvailability", "PreOrder") else False if said in ("OutOfStock", "SoldOut") else None
        for spec in listed(node.get("priceSpecification")):
            if isinstance(spec, dict) and re.search("Strikethrough|ListPrice", str(spec.get("priceType"))):
                out["compare_at"] = number(spec.get("price"))
        return out

    def walk(node, depth, parent, out):
        if depth > MAX_DEPTH or len(out) >= MAX_NODES:
            return
        if isinstance(node, list):
            for x in node:
                walk(x, depth, parent, out)
        elif isinstance(node, dict):
            ref = str(node["@id"]).strip() if node.get("@id") else None
            types = [str(t).rsplit("/", 1)[-1] for t in listed(node.get("@type"))]
            row = {"pos": len(out), "depth": depth, "types": types, "ref": ref, "parent": parent}
            row |= {k: node[k] if isinstance(node.get(k), str) else None for k in ("name", "url")} | offer(node)
            out.append(row)
            for x in node.values():
                if isinstance(x, (dict, list)):
                    walk(x, depth + 1, ref or parent, out)

    def one(page):
        out: list = []
        for text in script.findall(page or ""):
            try:
                walk(json.loads(text), 0, None, out)
            except ValueError:
                continue
        keys = ("pos", "depth", "types", "ref", "name", "url", "price", "low", "high", "compare_at", "currency", "available", "parent")
        return [{k: row.get(k) for k in keys} for row in out]

    return pd.Series([one(p) for p in src], dtype=object)


@F.pandas_udf(StringType())
def json_after(src: pd.Series, pattern: pd.Series) -> pd.Series:
    """The JSON object literal that follows a pattern in page source."""
    import re

    def one(page, p):
        m = re.search(p, page or "")
        at = page.find("{", m.end()) if m else -1
        if at < 0 or at - m.end() > 200:
            return None
        try:
            value, _ = json.JSONDecoder().raw_decode(page[at:])
            return json.dumps(value, ensure_ascii=False)
        except ValueError:
            return None

    return pd.Series([one(s, p) for s, p in zip(src, pattern)], dtype=object)


@F.pandas_udf(StringType())
def json_value_at(src: pd.Series, at: pd.Series) -> pd.Series:
    """The source of the JSON value that begins at a place (from 1); null where
    there is none or it is not valid."""
    read = json.JSONDecoder().raw_decode

    def one(page, start):
        try:
            return page[int(start) - 1 : read(page, int(start) - 1)[1]]
        except (TypeError, ValueError, RecursionError):
            return None

    return pd.Series([one(p, a) for p, a in zip(src, at)], dtype=object)
