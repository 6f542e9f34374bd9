"""Links of pages: those that stay on the site, the ones that lead to policies and
help, and what a walk along them reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..plans.staging import cut

#: What a link's address or text says of where it leads, in order.
LINK_HINTS = (
    ("refund-policy", r"refund|return"), ("shipping-policy", r"shipping|delivery"), ("privacy-policy", r"privacy"), ("terms-of-service", r"terms|conditions"),
    ("contact", r"contact"), ("faq", r"\bfaqs?\b|frequently|help-?center|/help\b"),
)
NOT_PAGES, MAX_TEXT = r"(?i)^(#|mailto:|tel:|javascript:)", 80


def page_links(source: Column, host: Column) -> Column:
    """Array of struct(href, text) of the links that stay on the site: relative
    ones and those to the same host, with or without www. Addresses inside escaped
    source lose their backslashes and quotes."""
    bare = lambda h: F.trim(F.replace(h, F.lit("\\/"), F.lit("/")), F.lit("\\\"' "))
    whole = lambda h: F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).otherwise(h)
    seen = F.transform(html.links(source), lambda a: F.struct(whole(bare(a["href"])).alias("href"), F.substring(a["text"], 1, MAX_TEXT).alias("text")))
    away = lambda h: h.rlike("(?i)^http") & (F.coalesce(host, F.lit("")) != "") & (urls.strip_www(F.lower(urls.host_of(h))) != urls.strip_www(F.lower(host)))
    return F.filter(seen, lambda a: (a["href"] != "") & ~a["href"].rlike(NOT_PAGES) & ~F.coalesce(away(a["href"]), F.lit(False)))


def discovered(source: Column, host: Column) -> Column:
    """Array of struct(name, href): the first link of a page for each hint. A link
    on return conditions is none to the terms of service."""

    def first(found: Column, name: str, pattern: str) -> Column:
        hay = lambda a: F.lower(F.concat_ws(" ", a["href"], a["text"]))
        other = lambda a: F.contains(hay(a), F.lit("condition")) & F.contains(hay(a), F.lit("return")) if name == "terms-of-service" else F.lit(False)
        hits = F.filter(found, lambda a: hay(a).rlike(pattern) & ~other(a))
        return F.struct(F.lit(name).alias("name"), F.try_element_at(hits, F.lit(1))["href"].alias("href"))

    hinted = lambda found: F.array(*[first(found, n, p) for n, p in LINK_HINTS])
    return F.filter(text.let(page_links(source, host), hinted), lambda x: x["href"].isNotNull())


def link_graph(pages: DataFrame) -> DataFrame:
    """site, path, target: distinct links between paths of a site's ``pages``
    (site, url, html). Query and fragment are no part of a path."""
    path = lambda u: urls.path_of(urls.strip_fragment(u))
    rows = pages.select("site", path("url").alias("path"), F.col("url").alias("base"), F.explode(page_links(F.col("html"), urls.host_of("url"))).alias("a"))
    target = F.when(F.startswith(F.col("a.href"), F.lit("/")), F.col("a.href")).otherwise(urls.resolve(F.col("a.href"), F.col("base")))
    return rows.select("site", "path", path(target).alias("target")).distinct()


def reached(graph: DataFrame, seeds: DataFrame, rounds: int = 10) -> DataFrame:
    """site, path, depth of every path within ``rounds`` links of the ``seeds`` (site,
    path), by the shortest way.

    One join, one distinct and one anti join a round, each round and the graph
    written once, so no round reads pages again, the plan stays small and a lost
    executor costs a round at most; it ends with the first round that finds nothing
    new.
    """
    graph = cut(graph, "graph")
    front = cut(seeds.select("site", "path").distinct().withColumn("depth", F.lit(0)), "round")
    seen = front
    for depth in range(1, rounds + 1):
        found = front.select("site", "path").join(graph, ["site", "path"]).select("site", F.col("target").alias("path")).distinct()
        front = cut(found.join(seen, ["site", "path"], "left_anti").withColumn("depth", F.lit(depth)), "round")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
