"""URLs and hosts as Column expressions."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Second-level labels under which names are registered.
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "edu", "ac", "ne", "or", "go")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_scheme(raw) -> Column:
    t = F.trim(_col(raw))
    return F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def normalize_input(raw) -> Column:
    """struct(scheme, host) of a domain or URL; host in lower case, no port."""
    u = with_scheme(raw)
    host = F.lower(F.regexp_extract(u, r"^https?://(?:[^/@]*@)?([^/:?#\s]+)", 1))
    return F.struct(F.lower(F.regexp_extract(u, "(?i)^(https?)", 1)).alias("scheme"), F.nullif(host, F.lit("")).alias("host"))


def host_of(url) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_col(url), r"(?i)^https?://(?:[^/@]*@)?([^/:?#\s]+)", 1)), F.lit(""))


def strip_www(host) -> Column:
    return F.regexp_replace(_col(host), r"^www\.", "")


def registrable_domain(host) -> Column:
    """The name one registers (last two labels, three under a known second
    level); null for addresses and single labels."""
    h = F.lower(_col(host))
    parts = F.split(h, r"\.")
    n = F.size(parts)
    three = F.element_at(parts, -2).isin(*SECOND_LEVEL) & (n >= 3) & (F.length(F.element_at(parts, -1)) == 2)
    name = F.when(three, F.array_join(F.slice(parts, -3, 3), ".")).when(n >= 2, F.array_join(F.slice(parts, -2, 2), "."))
    return F.when(h.rlike(r"^[\d.]+$") | F.contains(h, F.lit(":")) | (n < 2), F.lit(None)).otherwise(name)


def site_root(url) -> Column:
    root = F.regexp_extract(_col(url), r"(?i)^(https?://[^/?#]+)", 1)
    return F.when(root != "", F.concat(root, F.lit("/")))


def path_of(url) -> Column:
    """Path of an absolute or relative reference, / when empty."""
    rest = F.regexp_replace(_col(url), r"(?i)^https?://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def query_param(url, name: str) -> Column:
    return F.nullif(F.regexp_extract(_col(url), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def strip_fragment(url) -> Column:
    return F.substring_index(_col(url), "#", 1)


def same_host(url, host) -> Column:
    return strip_www(host_of(url)) == strip_www(F.lower(_col(host)))


def norm_url(url) -> Column:
    """Without scheme, www, trailing slash and fragment, for comparison."""
    u = F.regexp_replace(strip_fragment(F.trim(_col(url))), r"(?i)^https?://(www\.)?", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    return F.regexp_replace(F.concat(host, F.regexp_replace(u, r"^[^/?]*", "")), "/+$", "")


def product_handle(url) -> Column:
    """Handle of .../products/HANDLE, or null."""
    h = F.regexp_extract(_col(url), r"/products/([^/?#]+)/?(?:[?#]|$)", 1)
    return F.nullif(h, F.lit(""))


def handle_key(handle) -> Column:
    h = _col(handle)
    return F.lower(F.trim(F.coalesce(F.try_url_decode(h), h), F.lit("/")))


def safe_slug(handle) -> Column:
    return F.substring(F.regexp_replace(_col(handle), r"[^A-Za-z0-9._-]+", "-"), 1, 80)


def is_first_products_page(url) -> Column:
    page = F.coalesce(query_param(url, "page"), F.lit("1"))
    return F.endswith(path_of(url), F.lit("/products.json")) & (page == "1")


@F.pandas_udf(StringType())
def resolve(reference: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute URL of a reference on a page; Spark has no built-in for it."""

    def one(r, b):
        if r is None:
            return None
        try:
            return urllib.parse.urljoin(b or "", r.strip())
        except ValueError:
            return None

    return pd.Series([one(r, b) for r, b in zip(reference, base)], dtype=object)
