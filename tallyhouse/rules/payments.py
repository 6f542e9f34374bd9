"""Payments readiness: rules over a store's pages and its answers about payments.

Like the launch rules: pages become flags before anything is gathered by site, the
answers are joined to them, and all rules of a site are built in one projection. A
rule may say nothing of a site; its severity counts only where it is an issue.

Inputs: ``stores`` (site, mode, home_result, home_url, home_note, meta_result,
products_result, meta_name, meta_country, base_currency, ships_to), ``pages``
(site, pos, role: home, cart, policy, contact, faq, product; name, result, html,
text), ``products`` (site, desc_chars, n_images) and ``answers`` (site and typed
answers; a site without a row answered nothing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text as T
from ..operators import markets as M
from ..plans.staging import cut
from .engine import choose
from .launch import has

#: Groups, severities and results in their order.
GROUPS, SEVERITIES, RESULTS = "SPMTE", ("P0", "P1", "P2", "P3", "info"), ("issue", "unknown", "ok", "skip")
POLICIES = ("refund-policy", "shipping-policy", "privacy-policy", "terms-of-service", "contact-information")
POLICY_MIN = 200
POLICY_BODY = "shopify-policy__body"
#: Fixed value: the characters outside ASCII that are another case of an ASCII letter.
ODD_CASE = "[\u0130\u0131\u017f\u212a]"
MARKERS = ("cdn.shopify.com", "shopify.theme", "myshopify.com", "shopify-section")
#: Traces of payment services in page source (lower case).
PAYMENT_TRACES = {
    "Stripe": ("js.stripe.com", "m.stripe.network"), "PayPal": ("paypal.com/sdk/js", "paypalobjects.com", "paypal-button"), "Braintree": ("braintreegateway.com", "js.braintreegateway"),
    "Adyen": ("checkoutshopper-live.adyen.com", "adyen.com/checkoutshopper"), "Checkout.com": ("cdn.checkout.com", "frames.checkout.com"), "Airwallex": ("checkout.airwallex.com", "static.airwallex.com"),
    "Klarna": ("klarna.com", "klarnaservices.com", "klarna-placement"), "Afterpay": ("afterpay.com", "afterpay-placement", "static.afterpay"), "Affirm": ("affirm.com/js", "cdn1.affirm.com"),
    "Shop Pay Installments": ("shopify-payment-terms", "shop_pay_installments"),
}
INSTALMENTS = ("Klarna", "Afterpay", "Affirm", "Shop Pay Installments")
#: Traces of apps by kind.
APP_TRACES = {
    "chat": ("gorgias.chat", "gorgias.io", "tidio.co", "tidiochat", "zdassets.com", "zendesk.com/embeddable", "widget.intercom.io", "intercomcdn", "reamaze.com", "reamaze.js", "livechatinc.com", "embed.tawk.to",
             "client.crisp.chat", "wchat.freshchat.com", "freshchat", "shopify-chat", "inbox.shopify.com", "wa.me/", "api.whatsapp.com/send"),
    "subscription": ("rechargecdn.com", "rechargepayments.com", "skio.com", "skio-plan", "sealsubscriptions", "appstle", "bold-subscriptions", "boldsubs"),
    "popup": ("privy.com", "widget.privy", "justuno.com", "optinmonster", "omappapi.com", "static.klaviyo.com/onsite", "klaviyo-form"),
    "currency": ("mlveda", "best-currency-converter", "autocurrencyswitcher"),
}
CARD_ICONS = ("visa", "master", "mastercard", "american-express", "amex", "discover", "diners-club", "diners", "jcb", "unionpay", "maestro", "apple-pay", "google-pay")
CARD_ROUTES = ("shopify_payments", "stripe", "airwallex", "card_other")
DOLLAR_MARKETS = ("US", "CA", "AU", "NZ", "SG", "HK")
EU_UK = ("GB", "UK", "EU", "DE", "FR", "IT", "ES", "NL", "BE", "AT", "IE", "SE", "DK", "FI", "PL", "PT", "CZ", "GR", "RO", "HU")
CURRENCY_CODE = r"\b(USD|CAD|AUD|NZD|HKD|SGD|EUR|GBP|JPY|CNY|RMB)\b"
#: Categories that payment services often restrict.
RESTRICTED = (
    r"cbd|hemp|cannabis|marijuana|大麻|vape|e-?cig|电子烟|烟油|tobacco|烟草|cigar|firearm|gun|ammo|ammunition|weapon|knife|knives|枪|弹药|刀具|武器|adult|sex|erotic|成人|情趣|"
    r"supplement|nutraceutical|保健品|膳食补充|weight loss|减肥|pharma|drug|medicine|prescription|药品|处方|replica|counterfeit|仿牌|高仿|复刻|crypto|nft|虚拟币|加密货币|"
    r"gambl|casino|lottery|赌|彩票|kratom|kava|psychedelic|mushroom spores"
)
#: Wording the rules look for.
PAYMENT_DATA = r"payment (?:information|details|data)|credit card (?:information|details|number)|card details|payment processor|PCI|支付信息|银行卡信息"
STUB = r"\[(?:your |insert |company |store )[^\]]*\]|\{\{|lorem ipsum|YOUR COMPANY NAME|\[STORE NAME\]|xxx company"
REFUND_ITEMS = {
    "cond": r"unworn|unused|original (?:condition|packaging)|tags|undamaged|未使用|原包装",
    "method": r"original (?:form of )?payment|store credit|refund (?:will be )?(?:issued|credited)|原路|退回",
    "ship": r"return shipping|shipping costs? (?:are|is) non-refundable|prepaid (?:return )?label|free returns?|customer (?:is|will be) responsible|退货运费",
    "time": r"within \d+\s*(?:business |working )?days|processed within|\d+\s*-\s*\d+\s*(?:business )?days|处理时间",
}
SHIPPING_ITEMS = {
    "processing": r"processing time|processed within|ships? within|dispatch|handling time|发货", "transit": r"delivery time|transit|arrive|business days|working days|送达",
    "cost": r"free shipping|shipping (?:cost|fee|rate)s?|flat rate|\$\s?\d|运费", "destinations": r"ship (?:to|worldwide)|countries|worldwide|international|united states|canada|地区|国家",
}
US_ONLY = r"only ship (?:within|to) the (?:united states|us\b|u\.s\.)"
WORLDWIDE = r"worldwide|ship (?:to )?(?:all|most) countries|international shipping"
BUYER_PAYS = r"customer (?:is|will be) responsible for (?:paying for )?(?:the )?return shipping|return shipping (?:costs? )?(?:is|are) (?:the customer|non-refundable|paid by)"
STATEMENT = r"(?:appear|show)s? on your (?:credit card |bank |card )?statement|billing descriptor|statement descriptor|charge will (?:appear|show)|账单上显示"
PROMOTION = r"\d{1,2}% off|discount code|use code|promo code|coupon"
PROMOTION_TERMS = r"terms (?:and conditions )?apply|exclusions apply|promotion terms|offer (?:valid|ends|expires)|see details|cannot be combined|one (?:code|use) per"
TRUST = r"secure checkout|ssl secured|guaranteed safe checkout|norton secured|mcafee secure|trustedsite|安全支付"
NOT_MAIL = r"\.(png|jpg|gif|svg|webp)$|sentry|example\.|wixpress|@2x"
PHONE = r"(?:\+\d{1,3}[\s\-.]?)?\(?\d{2,4}\)?[\s\-.]\d{3,4}[\s\-.]\d{3,4}(?!\d)"
STREET = r"\b\d{1,5}\s+[A-Z][A-Za-z ]+(?:Street|St\.|Road|Rd\.|Avenue|Ave\.?|Boulevard|Blvd|Lane|Drive|Way|Suite)\b|\b(?:Room|Rm\.|Unit|Flat|Floor)\s*\d+|[一-鿿]{2,}(?:路|街|大道)\d+号"


def main_source(src: Column) -> Column:
    """Source of a page's main part: the policy body, else main, else article, else
    all; null for plain text. Only pages with the body's name go to Python."""
    marked = has(src, r"<html|<body|<div|<p\b")
    block = lambda tag: F.nullif(F.regexp_extract(src, rf"(?is)<{tag}\b.*?</{tag}>", 0), F.lit(""))
    body = html.balanced_div(F.when(marked & F.contains(src, F.lit(POLICY_BODY)), src), F.lit(POLICY_BODY))
    return F.when(marked, F.coalesce(body, block("main"), block("article"), src))


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (role, src) with what each says: all of a home page, the main part
    of others, plain text as it is; ``plain``: all of a product page. Functions in
    Python take every row, whatever the condition around them, so the parts come
    first and each goes through them once."""
    role, src = F.col("role"), F.col("src")
    parts = pages.withColumns({"part": F.when(role == "home", src).otherwise(main_source(src)), "whole": F.when(role == "product", src)})
    said = F.when(F.col("part").isNull(), F.trim(src)).otherwise(html.to_text("part"))
    return parts.withColumns({"said": said, "plain": F.when(F.col("whole").isNotNull(), html.to_text("whole"))}).drop("part", "whole")


def shop_name(meta_name: Column, src: Column) -> Column:
    """The store's own name, else its site name, else the end of the page title."""
    site = F.try_element_at(html.meta(src), F.lit("og:site_name"))
    return F.coalesce(F.nullif(F.trim(meta_name), F.lit("")), F.trim(site), F.nullif(F.trim(F.element_at(F.split(html.title(src), r"\s[|\-–—]\s"), -1)), F.lit("")))


def payment_icons(src: Column) -> Column:
    """Distinct names of payment icons in page order."""
    low = F.lower(src)
    pattern = F.lit(r"(?:aria-labelledby|id)\s*=\s*[\"']pi-([a-z0-9_\-]+)[\"']|payment-icon--([a-z0-9_\-]+)|icon--payment-([a-z0-9_\-]+)")
    groups = [F.regexp_extract_all(low, pattern, F.lit(i)) for i in (1, 2, 3)]
    named = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.replace(F.concat(a, b), F.lit("_"), F.lit("-")))
    tags = F.transform(F.regexp_extract_all(src, F.lit(r"(?is)<(?:svg|img|li|span|div)\b[^>]*payment[^>]*>"), F.lit(0)), html.attributes)
    told = lambda a: F.coalesce(*[F.try_element_at(a, F.lit(k)) for k in ("aria-label", "title", "alt")])
    classed = F.filter(tags, lambda a: F.contains(F.lower(F.coalesce(F.try_element_at(a, F.lit("class")), F.lit(""))), F.lit("payment")) & told(a).isNotNull() & (F.length(told(a)) <= 40))
    return F.array_distinct(F.concat(named, F.transform(classed, lambda a: F.regexp_replace(F.lower(F.trim(told(a))), r"[\s_]+", "-"))))


def looks_js_rendered(src: Column, said: Column) -> Column:
    """Almost no text in a large page, or a page that only redirects."""
    return (src != "") & ~F.contains(src, F.lit("shopify-policy__body")) & (((F.length(F.trim(said)) < 150) & (F.length(src) > 20000)) | has(said, r"^\s*redirecting"))


def traces(low: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Names whose traces stand in the page source."""
    one = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(low, m))
    return F.array_compact(F.array(*[F.when(one(marks), F.lit(name)) for name, marks in table.items()]))


def identity(markers: Column, home: Column, meta: Column, products: Column, src: Column) -> Column:
    """confirmed by two markers, probable by one; without any the store is on
    another platform only if the pages that would show one were answered."""
    clean = lambda x: F.coalesce(x, F.lit("ok")).isin("ok", "not_found", "not_checked")
    other = (home == "ok") & clean(meta) & clean(products) & has(src, r"<(?:html|head|script|div)\b")
    return F.when(F.size(markers) >= 2, "confirmed").when(F.size(markers) == 1, "probable").when(other, "not_shopify").otherwise("unconfirmed")


def home_marks(src: Column, low: Column) -> list[Column]:
    """What a home page shows of its platform: markers, markup."""
    return [F.filter(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(low, m)).alias("markers"), has(src, r"<(?:html|head|script|div)\b").alias("markup")]


def home_state() -> Column:
    return F.when(F.col("has_home"), "ok").otherwise(F.coalesce(F.nullif("home_result", F.lit("ok")), F.lit("missing")))


def told_identity() -> Column:
    """Identity of a site by mode, its results and what its home pages show."""
    seen = identity(F.col("markers"), home_state(), F.col("meta_result"), F.col("products_result"), F.when(F.col("markup"), "<html").otherwise(""))
    return F.when(F.col("mode") == "offline", "unknown").otherwise(seen)


def identities(stores: DataFrame, pages: DataFrame) -> DataFrame:
    """site, identity as in ``facts``, from home pages alone, written once."""
    home = pages.where("role = 'home'").select("site", F.coalesce("text", "html", F.lit("")).alias("src")).withColumn("low", F.lower("src"))
    marks = home.select("site", (F.col("src") != "").alias("has_src"), *home_marks(F.col("src"), F.col("low")))
    seen = marks.groupBy("site").agg(F.bool_or("has_src").alias("has_home"), F.bool_or("markup").alias("markup"), F.flatten(F.collect_list("markers")).alias("markers"))
    return cut(stores.join(seen, "site", "left").select("site", told_identity().alias("identity")), "pay-identity")


def page_flags(pages: DataFrame) -> DataFrame:
    """One row for each page: flags, names, day counts; no source text. A flag is
    null on pages whose kind the rules do not ask for it: patterns search only
    the pages that count."""
    role, name = F.col("role"), F.col("name")
    p = cut(main_text(pages.withColumn("src", F.coalesce("text", "html", F.lit("")))), "pay-pages")
    p = p.withColumns({"low": F.lower("src"), "odd": F.coalesce(F.concat_ws("", "src", "said", "plain").rlike(ODD_CASE), F.lit(False))})
    src, said, low, plain = F.col("src"), F.col("said"), F.col("low"), F.col("plain")
    # patterns of ASCII letters: the slow comparison is only needed where a text has an odd letter
    seen = lambda x, pattern: F.coalesce(F.when(F.col("odd"), x.rlike("(?iu)" + pattern)).otherwise(x.rlike("(?i)" + pattern)), F.lit(False))
    home, cart, product = role == "home", role == "cart", role == "product"
    policy = lambda *n: (role == "policy") & name.isin(*n)
    refund, shipping, terms = policy("refund-policy"), policy("shipping-policy"), policy("terms-of-service")
    shown, told = role.isin("home", "product", "cart"), role.isin("home", "product", "faq")
    reach = role.isin("home", "contact") | ((role == "policy") & (name != "shipping-policy"))
    mails = F.array_union(F.transform(F.regexp_extract_all(src, F.lit("mailto:([^\"'?>\\s]+)"), F.lit(1)), F.lower), F.filter(F.transform(F.regexp_extract_all(F.when(F.contains(said, F.lit("@")), said).otherwise(""), F.lit(T.EMAIL), F.lit(0)), F.lower), lambda m: ~m.rlike(NOT_MAIL)))
    phones = (F.size(F.regexp_extract_all(src, F.lit(r"tel:([+\d\-\s().]{7,})"), F.lit(1))) > 0) | (seen(said, r"phone|call us|tel[:.]|电话") & said.rlike(PHONE))
    drawn = (role == "policy") & looks_js_rendered(src, said)
    state = F.when(drawn, "js_rendered").when(src != "", "ok").otherwise(F.coalesce("result", F.lit("missing")))
    # contact pages count as names and addresses; the home page does not
    named = reach & ~home
    on = lambda kind, flags: [F.when(kind, x).alias(k) for k, x in flags.items()]
    flags = [
        *on(shown, {"icons": payment_icons(src), "services": traces(low, PAYMENT_TRACES), "apps": traces(low, APP_TRACES)}),
        *on(home, {
            "shown_currency": M.shown_currency("src"), "shop": shop_name(F.lit(None).cast("string"), src), "n_hreflang": F.size(html.hreflang("src")),
            "localization": seen(low, r"id=[\"']localization_form|action=[\"'][^\"']*/localization[\"']"), "promotion": seen(said, PROMOTION), "trust": seen(said, TRUST),
        }),
        *on(cart, {"checkout": seen(low, r"name=[\"']checkout[\"']|href=[\"'][^\"']*/checkout|action=[\"'][^\"']*/checkout"), "empty": seen(low, r"cart is empty|cart--empty|is-empty|empty-cart|your bag is empty|cart-empty")}),
        *on(product, {
            "express": seen(src, r"shopify-payment-button|data-shopify=[\"']payment-button"), "preorder_page": seen(plain, "pre-?order"),
            "dollar": F.coalesce(plain.rlike(r"\$\s?\d"), F.lit(False)), "code": F.coalesce(plain.rlike(CURRENCY_CODE), F.lit(False)),
        }),
        *on(refund, {**{f"refund_{k}": seen(said, v) for k, v in REFUND_ITEMS.items()}, "windows": T.return_windows(said), "buyer_pays": seen(said, BUYER_PAYS)}),
        *on(shipping, {**{f"shipping_{k}": seen(said, v) for k, v in SHIPPING_ITEMS.items()}, "us_only": seen(said, US_ONLY), "worldwide": seen(said, WORLDWIDE)}),
        *on(policy("privacy-policy", "terms-of-service"), {"payment_data": seen(said, PAYMENT_DATA)}), *on(policy(*POLICIES), {"stub": seen(said, STUB)}),
        *on(terms | refund | shipping, {"cancel": seen(said, "cancel"), "preorder_text": seen(said, "pre-?order")}), *on(policy(*POLICIES) | (role == "faq"), {"statement": seen(said, STATEMENT)}),
        *on(home | terms, {"promotion_terms": seen(said, PROMOTION_TERMS)}), *on(told, {"claimed": T.page_return_claims(said), "free_returns": seen(said, "free returns?")}),
        *on(named, {"names": T.legal_names(said), "street": said.rlike(STREET)}), *on(reach, {"mails": mails, "phone": phones, "form": seen(src, r"contact\[email\]|<form[^>]+contact|id=[\"']contact")}),
    ]
    marks = [F.when(home, m).alias(k) for m, k in zip(home_marks(src, low), ("markers", "markup"))]
    return p.select("site", "pos", "role", "name", state.alias("state"), F.length("said").alias("chars"), (src != "").alias("has_src"), *marks, *flags)


def facts(stores: DataFrame, pages: DataFrame, products: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each site with all that the rules ask for, written once."""
    p = page_flags(pages)
    role, name = F.col("role"), F.col("name")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    policy = lambda *n: (role == "policy") & name.isin(*n) & (F.col("state") == "ok")
    names = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    gathered = p.groupBy("site").agg(
        any_((role == "home") & F.col("has_src")).alias("has_home"), any_((role == "home") & F.col("markup")).alias("markup"), F.flatten(F.collect_list("markers")).alias("markers"), names("icons").alias("icons"), names("services").alias("services"), names("apps").alias("apps"),
        F.max("shown_currency").alias("shown_currency"), F.max("shop").alias("shop"), any_((role == "home") & F.col("localization")).alias("localization"), F.max("n_hreflang").alias("n_hreflang"),
        F.max(F.when(role == "cart", F.col("state"))).alias("cart_state"), any_((role == "cart") & F.col("checkout")).alias("checkout"), any_((role == "cart") & F.col("empty")).alias("cart_empty"),
        F.count_if(role == "product").alias("n_product_pages"), F.count_if((role == "product") & F.col("express")).alias("n_express"), any_((role == "product") & F.col("preorder_page")).alias("preorder_page"), any_(F.col("dollar")).alias("dollar"), any_(F.col("code")).alias("code"),
        *[F.max(F.when((role == "policy") & (name == n), F.col("state"))).alias(f"state_{n}") for n in POLICIES], *[any_(policy(n)).alias(f"ok_{n}") for n in POLICIES],
        F.array_sort(F.collect_set(F.when(policy(*POLICIES) & (F.col("chars") < POLICY_MIN), name))).alias("short"), F.array_sort(F.collect_set(F.when(policy(*POLICIES) & F.col("stub"), name))).alias("stubs"),
        any_(policy("privacy-policy", "terms-of-service") & F.col("payment_data")).alias("payment_data"), *[any_(policy("refund-policy") & F.col(f"refund_{k}")).alias(f"refund_{k}") for k in REFUND_ITEMS],
        *[any_(policy("shipping-policy") & F.col(f"shipping_{k}")).alias(f"shipping_{k}") for k in SHIPPING_ITEMS], any_(policy("shipping-policy") & F.col("us_only")).alias("us_only"), any_(policy("shipping-policy") & F.col("worldwide")).alias("worldwide"),
        F.flatten(F.collect_list("windows")).alias("windows"), names("claimed").alias("claimed"), any_(policy("refund-policy") & F.col("buyer_pays")).alias("buyer_pays"), any_(role.isin("home", "product", "faq") & F.col("free_returns")).alias("free_returns"),
        any_(policy("terms-of-service", "refund-policy", "shipping-policy") & F.col("cancel")).alias("cancel"), any_(policy("terms-of-service", "refund-policy", "shipping-policy") & F.col("preorder_text")).alias("preorder_text"),
        any_((policy(*POLICIES) | (role == "faq")) & F.col("statement")).alias("statement"), any_((policy(*POLICIES) | (role == "faq")) & (F.col("chars") > 0)).alias("has_texts"), names(F.when(role == "policy", F.col("names"))).alias("policy_names"), names("names").alias("names"),
        any_(F.col("street")).alias("street"), any_((role == "home") & F.col("promotion")).alias("promotion"), any_(((role == "home") | policy("terms-of-service")) & F.col("promotion_terms")).alias("promotion_terms"), any_((role == "home") & F.col("trust")).alias("trust"),
        names("mails").alias("mails"), any_(F.col("phone")).alias("phone"), any_(F.col("form")).alias("form"), any_(role == "contact").alias("contact_page"),
    )
    stats = products.groupBy("site").agg(F.count(F.lit(1)).alias("n_products"), F.median("desc_chars").alias("desc_median"), F.median("n_images").alias("images_median"))
    out = stores.join(gathered, "site", "left").join(stats, "site", "left").join(answers.withColumn("answered", F.lit(True)), "site", "left")
    flags = [f.name for f in out.schema if f.dataType.simpleString() == "boolean" and f.name not in ("subscription", "preorder")]
    out = out.withColumns({f"{c}": F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in flags})
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("markers", "icons", "services", "apps", "short", "stubs", "policy_names", "names", "mails")})
    routes = F.coalesce(F.transform("gateways", lambda g: g["provider"]), none)
    mix = F.coalesce(F.map_keys("market_mix"), none)
    out = out.withColumns({"routes": routes, "sold_in": mix, "home": home_state(), "shop": F.coalesce(F.nullif(F.trim("meta_name"), F.lit("")), "shop")})
    return cut(out.withColumn("identity", told_identity()), "pay-facts")


def _say(rid: str, cases: list[tuple[Column, str, str, str, Column | str | None]]) -> Column:
    """First case that holds as struct(rule, severity, result, badge, note), null
    when the rule says nothing. A case is (condition, severity, result, badge, note)."""
    made = None
    for cond, severity, result, badge, note in cases:
        one = F.struct(
            F.lit(rid).alias("rule_id"), F.lit(severity if result == "issue" else "info").alias("severity"), F.lit(result).alias("result"), F.lit(badge).alias("badge"),
            (note if isinstance(note, Column) else F.lit(note)).cast("string").alias("note"),
        )
        made = F.when(cond, one) if made is None else made.when(cond, one)
    return made


def findings(f: DataFrame) -> DataFrame:
    """site, rule_id, severity, result, badge, note."""
    c, true = F.col, F.lit(True)
    size = lambda x: F.size(x)
    online = c("mode") != "offline"
    usable = c("home") == "ok"
    known = c("identity").isin("confirmed", "probable")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    meets = lambda a, b: F.arrays_overlap(a, b)
    routes, icons, mix = c("routes"), c("icons"), c("sold_in")
    missing = lambda items: F.array_join(F.array_compact(F.array(*[F.when(~x, F.lit(k)) for k, x in items.items()])), ",")
    ok = lambda n: c(f"`ok_{n}`")
    state = lambda n: c(f"`state_{n}`")
    out = [
        _say("S01", [
            (~online, "P0", "unknown", "not_found", "offline"), (usable & F.startswith(F.coalesce("home_url", F.lit("")), F.lit("https://")), "P0", "ok", "verified", None), (usable, "P0", "issue", "verified", "not_https"),
            (has(F.coalesce("home_note", F.lit("")), "certificate"), "P0", "issue", "verified", "certificate"), (true, "P0", "unknown", "not_found", c("home")),
        ]),
        _say("S02", [(c("identity") == "confirmed", "info", "ok", "verified", "confirmed"), (c("identity") == "probable", "info", "ok", "on_page", "probable"), (c("identity") == "not_shopify", "info", "ok", "inferred", "not_shopify"), (true, "info", "unknown", "not_found", None)]),
        _say("S03", [
            ((c("cart_state") == "ok") & c("checkout"), "P1", "ok", "on_page", None), ((c("cart_state") == "ok") & c("cart_empty"), "P1", "unknown", "not_found", "empty_cart"), (c("cart_state") == "ok", "P1", "unknown", "not_found", "no_button"),
            ((c("cart_state") == "not_found") & F.array_contains("markers", "shopify.theme") & known, "P1", "issue", "not_found", "cart_404"), (true, "P1", "unknown", "not_found", "not_fetched"),
        ]),
        _say("S04", [(size("icons") > 0, "info", "ok", "on_page", F.array_join(F.array_sort("icons"), ",")), (usable, "info", "unknown", "not_found", None)]),
        _say("S05", [(size("services") > 0, "info", "ok", "on_page", F.array_join(F.array_sort("services"), ",")), (usable, "info", "ok", "not_found", None)]),
    ]
    bnpl = F.array_intersect(c("services"), lit(*INSTALMENTS))
    seen = (size("icons") > 0) | (size("services") > 0)
    clash = {
        "card": ~(meets(icons, lit(*CARD_ICONS)) & ~meets(routes, lit(*CARD_ROUTES))), "paypal": ~(F.array_contains(icons, "paypal") & ~F.array_contains(routes, "paypal")),
        "shop_pay": ~(F.array_contains(icons, "shopify-pay") & ~F.array_contains(routes, "shopify_payments")),
        "amex": ~(F.coalesce(c("entity_country") == "CN", F.lit(False)) & meets(icons, lit("american-express", "amex")) & (size(F.array_except(routes, lit("shopify_payments", "stripe", "paypal"))) == 0)),
        "instalments": ~((size(bnpl) > 0) & ~meets(routes, lit("stripe", "shopify_payments", "airwallex"))),
    }
    out += [
        _say("S06", [(seen & (size(routes) == 0), "P1", "unknown", "not_found", "no_routes"), (seen & (missing(clash) != ""), "P1", "issue", "conflicting", missing(clash)), (seen, "P1", "ok", "user_input", None)]),
        _say("S07", [(c("n_express") > 0, "info", "ok", "on_page", c("n_express").cast("string")), (c("n_product_pages") > 0, "info", "ok", "not_found", None)]),
        _say("S08", [((size(bnpl) > 0) & (size(mix) != 1), "P2", "issue", "inferred", F.array_join(F.array_sort(bnpl), ",")), (size(bnpl) > 0, "P2", "ok", "on_page", None)]),
        _say("S09", [((ok("privacy-policy") | ok("terms-of-service")) & c("payment_data"), "P3", "ok", "verified", None), (ok("privacy-policy") | ok("terms-of-service"), "P3", "issue", "not_found", None)]),
    ]
    # a contact page stands in for the platform's own contact policy
    covered = c("contact_page") | (c("identity") == "not_shopify")
    gone = F.array_compact(F.array(*[F.when((state(n) == "not_found") & (~covered if n == "contact-information" else true), F.lit(n)) for n in POLICIES]))
    unread = F.array_compact(F.array(*[F.when(~F.coalesce(state(n).isin("ok", "not_found"), F.lit(False)), F.lit(n)) for n in POLICIES]))
    drawn = F.exists(F.array(*[F.coalesce(state(n) == "js_rendered", F.lit(False)) for n in POLICIES]), lambda x: x)
    lost = F.when(drawn, lit().cast("array<string>")).otherwise(gone)
    unclear = F.when(drawn, F.concat(unread, gone)).otherwise(unread)
    grave = meets(lost, lit("refund-policy", "shipping-policy"))
    out += [
        _say("P01", [(~online, "P0", "unknown", "not_found", "offline"), ((size(lost) > 0) & grave, "P0", "issue", "not_found", F.array_join(lost, ",")), (size(lost) > 0, "P1", "issue", "not_found", F.array_join(lost, ",")), (size(unclear) == 0, "P0", "ok", "verified", None)]),
        _say("P01", [(online & (size(unclear) > 0), "P1", "unknown", "not_found", F.array_join(F.array_sort(unclear), ","))]),
        _say("P02", [(online & ((size("short") > 0) | (size("stubs") > 0)), "P1", "issue", "verified", F.concat(F.array_join("short", ","), F.lit(";"), F.array_join("stubs", ","))), (online & F.exists(F.array(*[ok(n) for n in POLICIES]), lambda x: x), "P1", "ok", "verified", None)]),
    ]
    days = size(F.coalesce("windows", F.array().cast("array<int>"))) > 0
    refund = {"days": days, **{k: c(f"refund_{k}") for k in REFUND_ITEMS}}
    shipping = {k: c(f"shipping_{k}") for k in SHIPPING_ITEMS}
    n_ships = F.coalesce(size("ships_to"), F.lit(-1))
    conflict = choose((c("us_only") & (n_ships > 1), "us_only"), (c("worldwide") & (n_ships == 1), "one_country"), otherwise=None)
    main = F.try_element_at("windows", F.lit(1))
    other = F.array_sort(F.filter(F.coalesce("claimed", F.array().cast("array<int>")), lambda n: n != main))
    free = c("buyer_pays") & c("free_returns")
    plans, early = F.array_contains("apps", "subscription"), c("preorder_page")
    wants_plan, wants_early = plans | F.coalesce(c("subscription"), F.lit(False)), early | F.coalesce(c("preorder"), F.lit(False))
    terms = {"cancel": ~wants_plan | c("cancel"), "preorder": ~wants_early | c("preorder_text")}
    brand = T.norm_legal("shop")
    alike = F.exists("policy_names", lambda n: F.contains(T.norm_legal(n), brand) | F.contains(brand, T.norm_legal(n)))
    differs = (size("policy_names") > 0) & (F.coalesce("shop", F.lit("")) != "") & ~alike
    out += [
        _say("P03", [(online & ok("refund-policy") & ~days, "P1", "issue", "verified", missing(refund)), (online & ok("refund-policy") & (missing(refund) != ""), "P2", "issue", "verified", missing(refund)), (online & ok("refund-policy"), "P1", "ok", "verified", main.cast("string"))]),
        _say("P04", [(online & ok("shipping-policy") & conflict.isNotNull(), "P1", "issue", "conflicting", conflict), (online & ok("shipping-policy") & (missing(shipping) != ""), "P1", "issue", "verified", missing(shipping)), (online & ok("shipping-policy"), "P1", "ok", "verified", None)]),
        _say("P05", [(online & ok("refund-policy") & days & ((size(other) > 0) | free), "P1", "issue", "conflicting", F.concat(F.array_join(other.cast("array<string>"), ","), F.when(free, ";free").otherwise(""))), (online & ok("refund-policy") & days, "P1", "ok", "verified", main.cast("string"))]),
        _say("P06", [(online & (wants_plan | wants_early) & (missing(terms) != ""), "P1", "issue", "not_found", missing(terms)), (online & (wants_plan | wants_early) & (plans | early), "P1", "ok", "on_page", None), (online & (wants_plan | wants_early), "P1", "ok", "user_input", None)]),
        _say("P07", [(online & c("has_texts") & c("statement"), "P2", "ok", "verified", None), (online & c("has_texts"), "P2", "issue", "inferred", F.when(differs, "name_differs"))]),
        _say("P08", [(online & c("promotion") & c("promotion_terms"), "P3", "ok", "verified", None), (online & c("promotion"), "P3", "issue", "inferred", None)]),
    ]
    ships = F.coalesce("ships_to", F.array().cast("array<string>"))
    dollars = F.array_sort(F.array_intersect(F.array_union(mix, ships), lit(*DOLLAR_MARKETS)))
    bare = c("dollar") & ~c("code")
    pages = online & (c("n_product_pages") > 0)
    steps = F.when(c("shown_currency") != c("base_currency"), 1).otherwise(0) + F.when(c("payout_currency") != c("base_currency"), 1).otherwise(0)
    reached = F.array_union(ships, F.when(F.array_contains(ships, "GB"), lit("UK")).otherwise(F.array().cast("array<string>")))
    gap = F.array_sort(F.filter(F.array_except(mix, reached), lambda m: m != "EU"))
    money = online & (c("base_currency").isNotNull() | c("shown_currency").isNotNull())
    out += [
        _say("M01", [(pages & bare & (size(dollars) > 1), "P2", "issue", "verified", F.array_join(dollars, ",")), (pages & bare, "P2", "ok", "verified", "one_market"), (pages, "P2", "ok", "verified", None)]),
        _say("M02", [(money & c("payout_currency").isNotNull(), "info", "ok", "user_input", steps.cast("string")), (money, "info", "ok", "verified", steps.cast("string"))]),
        _say("M03", [(online & F.array_contains("apps", "currency"), "P1", "issue", "on_page", None), (online & c("localization"), "P1", "ok", "on_page", c("n_hreflang").cast("string"))]),
        _say("M04", [(online & (size(mix) > 0) & c("ships_to").isNotNull() & (size(gap) > 0), "P2", "issue", "conflicting", F.array_join(gap, ",")), (online & (size(mix) > 0) & c("ships_to").isNotNull(), "P2", "ok", "verified", None)]),
    ]
    ways = F.array_compact(F.array(F.when(size("mails") > 0, F.lit("email")), F.when(c("phone"), F.lit("phone")), F.when(F.array_contains("apps", "chat"), F.lit("chat"))))
    firms = F.array_distinct(F.transform("names", lambda n: T.norm_legal(n)))
    place = {"name": size("names") > 0, "address": c("street")}
    policies_seen = F.exists(F.array(*[ok(n) for n in POLICIES]), lambda x: x)
    same = (c("entity_country") == c("meta_country")) | ((c("entity_country") == "UK") & (c("meta_country") == "GB"))
    thin = F.coalesce(c("desc_median") < 150, F.lit(False)) | F.coalesce(c("images_median") < 2, F.lit(False))
    both = c("entity_country").isNotNull() & c("meta_country").isNotNull()
    out += [
        _say("T01", [(online & (size(ways) >= 2), "P1", "ok", "verified", F.array_join(ways, ",")), (online & (size(ways) == 1), "P2", "issue", "not_found", F.array_join(ways, ",")), (online & c("form"), "P1", "issue", "not_found", "form"), (online & usable, "P0", "issue", "not_found", None)]),
        _say("T02", [(online & (size(firms) > 1), "P2", "issue", "conflicting", F.array_join(F.array_sort(firms), ",")), (online & (missing(place) == ""), "P2", "ok", "verified", None), (online & policies_seen, "P2", "issue", "not_found", missing(place))]),
        _say("T03", [(online & both & same, "P2", "ok", "verified", None), (online & both, "P2", "issue", "conflicting", F.concat_ws(",", "meta_country", "entity_country"))]),
        _say("T04", [(online & (c("n_products") > 0) & thin, "P2", "issue", "verified", None), (online & (c("n_products") > 0), "P2", "ok", "verified", None)]),
        _say("T05", [(online & c("trust"), "info", "ok", "self_claim", None)]),
    ]
    asked = c("answered")
    mainland = asked & (c("entity_country") == "CN")
    uses = lambda p: F.array_contains(routes, p)
    any_route = asked & (size(routes) > 0)
    kinds = F.array_distinct(F.filter(routes, lambda r: r != "manual"))
    european = F.array_intersect(mix, lit(*EU_UK))
    out += [
        _say("E00", [(~asked, "info", "unknown", "not_found", None)]), _say("E01", [(mainland & uses("shopify_payments"), "P1", "issue", "inferred", None)]), _say("E02", [(mainland & uses("stripe"), "P1", "issue", "conflicting", None)]),
        _say("E03", [(asked & (c("payout_account") == "mercury"), "P2", "issue", "inferred", None)]),
        _say("E04", [(mainland & uses("shopify_payments") & (c("payout_account") != "worldfirst"), "P0", "issue", "conflicting", c("payout_account")), (any_route & (c("payout_account") == "none"), "P0", "issue", "user_input", None),
                     (any_route & c("payout_account").isNotNull(), "P0", "ok", "user_input", c("payout_account")), (any_route, "P0", "unknown", "not_found", None)]),
        _say("E05", [(any_route & (size(kinds) <= 1), "P1", "issue", "inferred", F.array_join(kinds, ",")), (any_route, "P1", "ok", "user_input", F.array_join(F.array_sort(kinds), ","))]),
        _say("E06", [(asked & has(c("category"), RESTRICTED), "P1", "issue", "inferred", c("category")), (asked & c("category").isNotNull(), "P1", "ok", "inferred", c("category"))]),
        _say("E07", [(asked & (size(european) > 0) & F.coalesce(c("mor") == "no", F.lit(True)), "P2", "issue", "inferred", F.array_join(F.array_sort(european), ","))]),
    ]
    return f.select("site", F.explode(F.array_compact(F.array(*out))).alias("x")).select("site", "x.*")


def order(found: DataFrame) -> DataFrame:
    """Findings with their place in a report and, for issues, in the fix list."""
    rank = lambda values, x: F.array_position(F.array(*[F.lit(v) for v in values]), x)
    place = F.struct(rank(list(GROUPS), F.substring("rule_id", 1, 1)).alias("g"), F.col("rule_id").alias("id"), rank(RESULTS, F.col("result")).alias("r"))
    fix = F.when(F.col("result") == "issue", rank(SEVERITIES, F.col("severity"))).when(F.col("result") == "unknown", 9)
    return found.withColumns({"place": place, "fix_rank": fix})


def counts(found: DataFrame) -> DataFrame:
    """site, n_p0 .. n_p3, n_unknown and the first thing to fix."""
    issue = F.col("result") == "issue"
    return order(found).groupBy("site").agg(
        *[F.count_if(issue & (F.col("severity") == s)).alias(f"n_{s.lower()}") for s in SEVERITIES[:4]], F.count_if(F.col("result") == "unknown").alias("n_unknown"), F.min_by("rule_id", F.when(issue, F.struct("fix_rank", "rule_id"))).alias("first_fix"),
    )


def run_status(f: DataFrame) -> DataFrame:
    """site, status: failed without a home page or any policy, partial where
    something was blocked, drawn by scripts, or the platform is not the expected."""
    bad = F.coalesce(F.col("cart_state").isin("blocked", "error"), F.lit(False))
    for n in POLICIES:
        bad = bad | F.coalesce(F.col(f"`state_{n}`").isin("blocked", "error", "js_rendered"), F.lit(False))
    seen = F.exists(F.array(*[F.col(f"`ok_{n}`") for n in POLICIES]), lambda x: x)
    status = choose((F.col("mode") == "offline", "partial"), ((F.col("home") != "ok") & seen, "partial"), (F.col("home") != "ok", "failed"), (bad | F.col("identity").isin("not_shopify", "unconfirmed"), "partial"), otherwise="complete")
    return f.select("site", status.alias("status"))
