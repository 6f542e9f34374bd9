"""Target markets: countries from free text, rule groups, expected languages and
currencies, and the check of language and region annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..plans.staging import cut

#: Country, main languages, currency, in the EU.
COUNTRIES = """
AT de EUR eu | BE nl,fr,de EUR eu | BG bg EUR eu | HR hr EUR eu | CY el EUR eu | CZ cs CZK eu | DK da DKK eu | EE et EUR eu
FI fi,sv EUR eu | FR fr EUR eu | DE de EUR eu | GR el EUR eu | HU hu HUF eu | IE en EUR eu | IT it EUR eu | LV lv EUR eu
LT lt EUR eu | LU fr,de EUR eu | MT en,mt EUR eu | NL nl EUR eu | PL pl PLN eu | PT pt EUR eu | RO ro RON eu | SK sk EUR eu
SI sl EUR eu | ES es EUR eu | SE sv SEK eu
US en USD - | GB en GBP - | CA en,fr CAD - | AU en AUD - | NZ en NZD - | CH de,fr,it CHF - | NO nb,no NOK -
"""
#: Other names of countries.
ALIASES = {
    "UK": "GB", "USA": "US", "ENGLAND": "GB", "BRITAIN": "GB", "GERMANY": "DE", "FRANCE": "FR", "CANADA": "CA", "AUSTRALIA": "AU",
    "美国": "US", "英国": "GB", "德国": "DE", "法国": "FR", "加拿大": "CA", "澳洲": "AU", "澳大利亚": "AU", "欧盟": "EU", "欧洲": "EU",
    "奥地利": "AT", "意大利": "IT", "西班牙": "ES", "荷兰": "NL",
}
#: The country that stands for the EU where one is needed.
EU_DEFAULT = "DE"
#: Wrong language and region codes and what was meant.
BAD_LANGUAGES = {
    "jp": "ja", "cn": "zh", "kr": "ko", "dk": "da", "se": "sv", "gr": "el", "cz": "cs", "ua": "uk", "vn": "vi", "us": "en", "gb": "en", "eng": "en",
}
BAD_REGIONS = {"uk": "gb", "eu": None, "la": None, "en": None}

_ROWS = [entry.split() for line in COUNTRIES.strip().splitlines() for entry in line.split("|")]
KNOWN = {code: (languages.split(","), currency, where == "eu") for code, languages, currency, where in _ROWS}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def norm_country(token: Column) -> Column:
    """Country code of a name or code, null when it is neither."""
    up = F.upper(F.trim(F.coalesce(token, F.lit(""))))
    code = F.coalesce(F.try_element_at(_map(ALIASES), up), up)
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def parse_markets(text: Column) -> Column:
    """Distinct country codes of free text in order; "EU" stays."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\s,;/+]+|和|及|与|\band\b")
    return F.array_distinct(F.array_compact(F.transform(parts, norm_country)))


def groups(countries: Column) -> Column:
    """Rule tokens of countries: DE is DE and EU, GB is UK."""
    european = F.array(*[F.lit(c) for c, (_, _, eu) in KNOWN.items() if eu])
    one = lambda c: F.when(c == "GB", F.array(F.lit("UK"))).when(F.array_contains(european, c), F.array(c, F.lit("EU"))).otherwise(F.array(c))
    return F.array_distinct(F.flatten(F.transform(countries, one)))


def applies(rule_markets: Column, tokens: Column) -> Column:
    """A rule without markets holds everywhere, another where its markets are targeted."""
    return (F.size(rule_markets) == 0) | F.arrays_overlap(rule_markets, tokens)


def languages(country: Column) -> Column:
    """Main languages of a country; none for those not listed."""
    table = F.create_map(*[x for c, (own, _, _) in (KNOWN | {"EU": KNOWN[EU_DEFAULT]}).items() for x in (F.lit(c), F.array(*[F.lit(v) for v in own]))])
    return F.coalesce(F.try_element_at(table, country), F.array().cast("array<string>"))


def currency(country: Column) -> Column:
    return F.try_element_at(_map({c: money for c, (_, money, _) in KNOWN.items()} | {"EU": "EUR"}), country)


def localization_countries(src) -> Column:
    """Country codes that the page's country form offers, in order."""
    form = F.substring(F.regexp_extract(F.coalesce(src, F.lit("")), r'(?is)(<form[^>]+(?:id="localization_form|/localization").*?)(?:</form>|$)', 1), 1, 80000)
    pick = lambda p: F.regexp_extract_all(form, F.lit(p), F.lit(1))
    return F.array_distinct(F.concat(pick(r'(?:data-value|value)="([A-Z]{2})"'), pick(r'data-country(?:-code)?="([A-Z]{2})"')))


def region_of(code: Column) -> Column:
    """Region of a locale such as en-gb; null without one."""
    parts = F.split(F.coalesce(code, F.lit("")), "-")
    last = F.upper(F.element_at(parts, -1))
    region = F.when((F.size(parts) >= 2) & (F.lower(F.element_at(parts, 1)) != "x") & last.rlike("^[A-Z]{2}$"), last)
    return F.when(region == "UK", "GB").otherwise(region)


def hreflang_countries(pairs: Column) -> Column:
    """Region codes of (code, href) annotations, distinct in order."""
    def one(pair):
        parts = F.split(F.coalesce(pair["code"], F.lit("")), "-")
        last = F.upper(F.element_at(parts, -1))
        return F.when((F.size(parts) >= 2) & last.rlike("^[A-Z]{2}$"), F.when(last == "UK", "GB").otherwise(last))

    return F.array_distinct(F.array_compact(F.transform(F.coalesce(pairs, F.array().cast("array<struct<code:string,href:string>>")), one)))


def default_markets(user_text: Column, seen: Column) -> Column:
    """struct(countries, how): the user's markets, else known ones seen on the
    site and the US."""
    chosen = parse_markets(user_text)
    known = F.array(*[F.lit(c) for c in KNOWN])
    own = F.filter(F.array_distinct(F.concat(F.coalesce(seen, F.array().cast("array<string>")), F.array(F.lit("US")))), lambda c: F.array_contains(known, c))
    return F.when(F.size(chosen) > 0, F.struct(chosen.alias("countries"), F.lit("user").alias("how"))).otherwise(
        F.struct(own.alias("countries"), F.lit("site").alias("how"))
    )


def language_markets(markets: Column, seen: Column) -> Column:
    """Countries whose language is expected: the user's, else those annotated and the US."""
    annotated = F.filter(seen, lambda c: F.array_contains(markets["countries"], c))
    return F.when(markets["how"] == "user", markets["countries"]).otherwise(F.array_distinct(F.concat(annotated, F.array(F.lit("US")))))


def language_gaps(countries: Column, page_lang: Column, pairs: Column) -> Column:
    """Countries none of whose languages the page or an annotated version has."""
    main = lambda code: F.element_at(F.split(F.lower(code), "-"), 1)
    have = F.concat(F.array(main(F.coalesce(page_lang, F.lit("en")))), F.transform(pairs, lambda p: main(p["code"])))
    return F.filter(countries, lambda c: (F.size(languages(c)) > 0) & ~F.arrays_overlap(languages(c), have))


def code_problem(code: Column) -> Column:
    """Why an annotation code is wrong; null when it is right."""
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    shape = r"^([a-z]{2,3})(?:-([a-z]{4}))?(?:-([a-z]{2}|\d{3}))?$"
    language, region = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 3)
    meant = F.try_element_at(_map(BAD_LANGUAGES), language)
    fix = F.try_element_at(_map({k: f"->{v}" if v else "" for k, v in BAD_REGIONS.items()}), region)
    return (
        F.when(c == "x-default", F.lit(None))
        .when(~c.rlike(shape), "bad_format")
        .when(meant.isNotNull(), F.concat(F.lit("bad_language:"), language, F.lit("->"), meant))
        .when(fix.isNotNull(), F.concat(F.lit("bad_region:"), region, fix))
    )


def hreflang_problems(versions: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """keys, kind, page, code, detail: what is wrong with the annotations of the
    versions of a site (keys, pos, url, pairs; the home page has pos 0). A site
    whose home page has none gives no row."""
    k = list(keys)
    # every kind of problem reads them: written once, or pages would be made and searched for each
    versions = cut(versions, "versions")
    home = versions.where("pos = 0").select(*k, urls.norm_url("url").alias("home_url"), "pairs").where(F.size("pairs") > 0)
    v = versions.join(home.select(*k, "home_url"), k).withColumn("page", F.col("url"))
    none = v.where(F.size("pairs") == 0).select(*k, F.lit("missing_on_version").alias("kind"), "page", F.lit(None).cast("string").alias("code"), F.lit("").alias("detail"))
    some = v.where(F.size("pairs") > 0)
    p = some.select(*k, "pos", "page", F.posexplode("pairs").alias("at", "p")).select(*k, "pos", "page", "at", "p.code", "p.href")
    p = p.withColumns({"low": F.lower("code"), "norm": urls.norm_url("href"), "why": code_problem(F.col("code"))})
    first = p.groupBy(*k, "pos", "low").agg(F.min_by("href", "at").alias("first_href"), F.min("at").alias("first_at"))
    p = p.join(first, [*k, "pos", "low"])
    two = (F.col("at") > F.col("first_at")) & (urls.norm_url("first_href") != F.col("norm"))
    kinds = F.array(
        F.when(F.col("why").isNotNull(), F.struct(F.lit("invalid_code").alias("kind"), F.col("why").alias("detail"))),
        F.when(~F.coalesce(F.col("href"), F.lit("")).rlike("(?i)^https?://"), F.struct(F.lit("relative_url").alias("kind"), F.lit("").alias("detail"))),
        F.when(two, F.struct(F.lit("duplicate_code").alias("kind"), F.col("first_href").alias("detail"))),
    )
    wrong = p.select(*k, "page", "code", F.explode(F.array_compact(kinds)).alias("x")).select(*k, "x.kind", "page", "code", "x.detail")
    norms = F.transform("pairs", lambda x: urls.norm_url(x["href"]))
    codes = F.transform("pairs", lambda x: F.lower(x["code"]))
    whole = F.array(
        F.when(~F.array_contains(norms, urls.norm_url("url")), F.lit("no_self_reference")), F.when(~F.array_contains(codes, "x-default"), F.lit("no_x_default"))
    )
    whole = some.select(*k, F.explode(F.array_compact(whole)).alias("kind"), "page", F.lit(None).cast("string").alias("code"), F.lit("").alias("detail"))
    # versions that the home page lists must list it too
    listed = p.where("pos = 0").select(*k, "code", "norm")
    back = some.where("pos > 0").select(*k, "page", urls.norm_url("url").alias("norm"), F.array_contains(norms, F.col("home_url")).alias("back"))
    lost = listed.join(back.where("not back"), [*k, "norm"]).select(*k, F.lit("no_return_link").alias("kind"), "page", "code", F.lit("").alias("detail"))
    return none.unionByName(wrong).unionByName(whole).unionByName(lost)


def shown_currency(src) -> Column:
    """The currency a store page says is active."""
    said = F.regexp_extract(F.coalesce(src, F.lit("")), r"Shopify\.currency\s*=\s*(\{[^}]*\})", 1)
    return F.try_variant_get(F.try_parse_json(said), "$.active", "string")


def offered(src) -> Column:
    """Countries seen on a home page: annotated ones, then those of its form."""
    return F.concat(hreflang_countries(html.hreflang(src)), localization_countries(src))
