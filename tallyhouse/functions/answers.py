"""Answers of a questionnaire: choices, amounts, payment routes, market mixes.

What cannot be read is null; ``problem`` columns say why, so that a whole table of
answers can be validated in one pass instead of failing on the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allowed answers by question.
CHOICES = {
    "entity_country": ("CN", "HK", "US", "CA", "UK", "OTHER"),
    "entity_type": ("company", "sole_proprietor", "individual"),
    "payout_account": ("cn_bank", "worldfirst", "payoneer", "pingpong", "lianlian", "airwallex", "mercury", "us_bank", "other", "none"),
    "shopify_plan": ("basic", "grow", "advanced", "plus", "none"),
    "mor": ("no", "shopify_managed_markets", "stripe_managed_payments", "other"),
    "provider": ("shopify_payments", "stripe", "paypal", "airwallex", "card_other", "manual"),
}
#: Other words for the answers (lower case, blanks as underscores).
ALIASES = {
    "entity_country": {
        "china": "CN", "mainland": "CN", "大陆": "CN", "中国": "CN", "中国大陆": "CN", "hongkong": "HK", "hong_kong": "HK", "香港": "HK", "usa": "US", "us_llc": "US",
        "美国": "US", "美国llc": "US", "canada": "CA", "加拿大": "CA", "gb": "UK", "英国": "UK",
    },
    "provider": {
        "shopify": "shopify_payments", "sp": "shopify_payments", "shoppay": "shopify_payments", "card": "card_other", "other": "card_other", "third_party_card": "card_other",
        "credit_card": "card_other", "cod": "manual", "bank_transfer": "manual",
    },
    "shopify_plan": {"shopify": "grow", "starter": "basic"},
    "payout_account": {"bank": "cn_bank", "国内银行": "cn_bank", "万里汇": "worldfirst"},
}
#: Answers in percent, at most 100.
PERCENTS = ("intl_card_share", "fx_share", "refund_rate", "dispute_rate")
YES, NO = ("1", "true", "yes", "y", "是", "有"), ("0", "false", "no", "n", "否", "没有", "无")
ROUTE = r"^\s*([A-Za-z_]+)\s*:\s*([\d.]+)\s*%?(?::\s*([\d.]+)\s*%?\s*(?:\+\s*([\d.]+))?)?(?::\s*([\d.]+))?\s*$"
ROUTE_TYPE = "struct<provider:string,share:decimal(18,6),pct:decimal(18,6),fixed:decimal(18,6),withdraw_fee:decimal(18,6)>"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")).isin("", "unknown")


def choice(question: str, x: Column) -> Column:
    """The allowed answer meant, null for none or an unknown one."""
    said = F.regexp_replace(F.lower(F.trim(x)), "[ -]", "_")
    table = {o.lower(): o for o in CHOICES[question]} | ALIASES.get(question, {})
    return F.when(~blank(x), F.try_element_at(_map(table), said))


def choice_problem(question: str, x: Column) -> Column:
    return F.when(~blank(x) & choice(question, x).isNull(), F.concat(F.lit(f"{question}: not one of the choices: "), x))


def number(question: str, x: Column) -> Column:
    """A non-negative amount; percent signs and thousands commas go."""
    v = F.regexp_replace(F.trim(x), "[,%]", "").try_cast("decimal(18,6)")
    return F.when(~blank(x) & (v >= 0) & ((v <= 100) | F.lit(question not in PERCENTS)), v)


def yes_no(x: Column) -> Column:
    said = F.lower(F.trim(x))
    return F.when(said.isin(*YES), True).when(said.isin(*NO), False)


def route(spec: Column) -> Column:
    """A payment route from provider:share[:pct+fixed[:withdraw_fee]]."""
    part = lambda i: F.nullif(F.regexp_extract(spec, ROUTE, i), F.lit("")).try_cast("decimal(18,6)")
    provider = choice("provider", F.nullif(F.regexp_extract(spec, ROUTE, 1), F.lit("")))
    fixed = F.coalesce(part(4), F.when(part(3).isNotNull(), F.lit(0).cast("decimal(18,6)")))
    return F.when(
        provider.isNotNull(),
        F.struct(provider.alias("provider"), part(2).alias("share"), part(3).alias("pct"), fixed.alias("fixed"), part(5).alias("withdraw_fee")).cast(ROUTE_TYPE),
    )


def market_mix(text: Column) -> Column:
    """Map of market to share from "US:70,CA:30"; one market alone is 100."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[,;]\s*"), lambda p: (F.trim(p) != "") & (p != "unknown"))
    code = lambda p: F.upper(F.trim(F.substring_index(p, ":", 1)))
    share = lambda p: F.when(F.contains(p, F.lit(":")), F.regexp_replace(F.substring_index(p, ":", -1), "[%\\s]", "").try_cast("double")).when(~F.contains(text, F.lit(",")), F.lit(100.0))
    entry = lambda p: F.struct(F.when(code(p) == "GB", "UK").otherwise(code(p)).alias("key"), share(p).alias("value"))
    entries = F.transform(parts, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def scenario(text: Column) -> Column:
    """struct(name, gateways, shopify_plan) from NAME=SPEC;SPEC;plan=PLAN."""
    rest = F.regexp_replace(text, "^[^=]*=", "")
    parts = F.filter(F.transform(F.split(rest, ";"), lambda p: F.trim(p)), lambda p: p != "")
    is_plan = lambda p: F.startswith(F.lower(p), F.lit("plan="))
    plan = F.try_element_at(F.filter(parts, is_plan), F.lit(-1))
    routes = F.array_compact(F.transform(F.filter(parts, lambda p: ~is_plan(p)), route))
    made = F.struct(F.trim(F.substring_index(text, "=", 1)).alias("name"), routes.alias("gateways"), choice("shopify_plan", F.regexp_replace(plan, "(?i)^plan=", "")).alias("shopify_plan"))
    return F.when(F.contains(text, F.lit("=")), made)
