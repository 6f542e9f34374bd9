"""Launch readiness: 71 rules over a store's pages, products and claims.

Pages are read once: each gets its flags (regular expressions in the JVM) before
anything moves, and only flags, counts and short strings are gathered by site.
Inputs:

* ``sites``: site, mode (online, paste, manual), platform, password, https_redirect,
  user_markets, ads, currency, name, today (date)
* ``pages``: site, pos, role (home, policy, page, pdp, market_home, market_policy,
  robots, sitemap), name (policy or page role, product handle, market code), url,
  result, html, text (null: read from the html)
* ``products``: site, handle, title, product_type, tags, price, in_stock, virtual,
  has_plan, on_sale

Defined cases: a site without pages is "failed" when online, every rule unknown;
null texts are empty; repeated pages count once where a policy is meant (the
longest text stays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, text as T, urls, wording as W
from ..operators import claims as C
from ..operators import markets as M
from ..plans.staging import cut, once
from .engine import Verdict, choose, dimension, evaluate

#: Id, level, markets, badge, sources, flags.
RULES = """
POL-01 P0 - verified S1,S10 -
POL-02 P0 - verified S2,S5 -
POL-03 P0 - verified S10,S14 -
POL-04 P1 - verified S10 -
POL-05 P0 - verified S1 -
POL-06 P0 DE,AT verified S8 -
POL-07 P1 - verified S10 -
POL-08 P1 - on_page S2,S10 -
CON-01 P1 - verified S1 -
CON-02 P0 - verified S2 -
CON-03 P1 - verified S12 -
CON-04 P1 - verified S2 -
CON-05 P1 EU,UK inferred S5,S6c -
CON-06 P0 - verified S2,S16,S5,S6 -
CON-07 P1 - verified S2 -
CNS-01 P0 - conflicting S2,S1 -
CNS-02 P1 - conflicting S12,S2 -
CNS-03 P1 - conflicting S2 -
CNS-04 P1 - conflicting S2 -
CNS-05 P1 - conflicting S2 -
CNS-06 P2 - conflicting S1 -
CNS-07 P2 - conflicting S5,S6b -
CNS-08 P1 - conflicting S2,S8 -
GMC-01 P0 - verified S1 ads
GMC-02 P0 - verified S1 ads
GMC-03 P1 - on_page S1,S2 ads
GMC-04 P1 - verified S1 ads
GMC-05 P1 - on_page S1 ads
GMC-06 P1 - inferred S2 ads
GMC-07 P1 - on_page S2 ads
GMC-08 P0 - conflicting S1,S2 ads
EU-01 P0 EU inferred S5 -
EU-02 P1 EU inferred S5 -
EU-03 P1 EU inferred S5 -
EU-04 P1 EU inferred S5 -
EU-05 P3 EU verified S7 -
EU-06 P2 EU inferred S9 -
EU-07 P1 EU inferred S10b -
DE-01 P0 DE,AT conflicting S8 -
UK-01 P0 UK inferred S6,S6c -
UK-02 P1 UK inferred S6b -
CA-01 P2 CA inferred S13 -
AU-01 P0 AU inferred S16 -
US-01 P1 US inferred S12 -
PRV-01 P1 - verified S14 -
PRV-02 P2 US inferred S15 -
PRV-03 P1 EU,UK on_page S17 -
PRV-04 P2 EU,UK not_found S17 -
BIZ-01 P1 - conflicting S2 -
BIZ-02 P2 - verified - exp
BIZ-03 P1 - verified S10 -
BIZ-04 P3 - verified - exp
LOC-01 P1 - verified S11 multi
LOC-02 P1 - verified S11 multi
LOC-03 P2 - verified S3,S11 multi
LOC-04 P2 - verified S11 multi
LOC-05 P1 - verified S1,S11 multi
LOC-06 P1 - verified S1 -
LOC-07 P2 - verified - exp
LOC-08 P1 EU,UK,CA,AU verified S2,S5 -
LOC-09 P2 - verified S5,S6 multi
LOC-10 P3 - inferred S11 multi
TRU-01 P0 - verified - exp,p0_ok
TRU-02 P1 - verified - exp
TRU-03 P1 - verified S1 -
TRU-04 P3 - verified - exp
TRU-05 P0 - verified S18 -
TRU-06 P2 - verified - exp
SEO-01 P0 - verified S4 -
SEO-02 P0 - verified S4 -
SEO-03 P2 - verified S4 -
"""
#: The sources of the rules; all are verified.
SOURCES = {s: True for s in ("S1", "S2", "S3", "S4", "S5", "S6", "S6b", "S6c", "S7", "S8", "S9", "S10", "S10b", "S11", "S12", "S13", "S14", "S15", "S16", "S17", "S18")}

#: Wording by which a link or a text is known (case folds).
LINK = {
    "refund-policy": r"refund|return|widerruf|retour|rückgabe|devoluc|退货",
    "shipping-policy": r"shipping|delivery|versand|livraison|envío|运费",
    "privacy-policy": r"privacy|datenschutz|confidentialit|privacidad|隐私",
    "terms-of-service": r"terms|\bagb\b|conditions|cgv|términos",
    "legal-notice": r"impressum|imprint|legal notice|mentions légales|aviso legal",
    "contact": r"contact|kontakt",
}
PLACEHOLDER = (
    r"\[(?:insert|your|company|store|business|email|address|phone|name|date)[^\]]{0,40}\]|"
    r"your store name|\{\{\s*\w+|\bmy store\b|lorem ipsum|xxx@|\[email\]"
)
FINAL = (
    r"all sales (?:are )?final|\bno refunds?\b|\bno returns?\b|"
    r"(?:items?|products?|orders?|purchases?|everything) (?:is|are) (?:final|non-?refundable)|概不退换|不退不换"
)
FAULTY = r"defect|damag|faulty|wrong item|incorrect|quality|not as described|unless|except|质量问题|破损"
EXEMPT = (
    r"gift ?card|personali[sz]|custom(?:ized|-made)|hygiene|underwear|earring|"
    r"shipping (?:fee|cost|charge)|duties|customs|insurance|e-?gift|rejected|forfeit"
)
FREE_MAIL = r"@(gmail|qq|163|126|yeah|outlook|hotmail|live|yahoo|foxmail|sina|aliyun|icloud|protonmail|gmx)\."
NOT_OWN_MAIL = r"shopify|sentry|wixpress|@example\.(com|org)$"
TEMPLATE_INFO = r"\bexample\.(?:com|org|net)\b|123 (?:main|fake) st|\b555[- .]\d{4}\b|your@email|email@example|you@yourstore"
CHINA = r"\bchina\b|shenzhen|guangzhou|yiwu|dongguan|zhejiang|guangdong|中国|深圳|广州|义乌"
PLATFORM_NAMES = r"shopify|google|meta|facebook|paypal|stripe|klarna|apple|amazon|afterpay|microsoft|tiktok|pinterest|klaviyo|^b corp"
HOURS = r"hours|mon|am\b|pm\b|time ?zone|\b(EST|PST|GMT|UTC|CET)\b"
REFUND_ITEMS = {
    "start": r"from the (date|day)|after (you )?receiv|of (delivery|receipt)",
    "condition": r"unused|unworn|original (packaging|condition)|tags|unopened|same condition|resal|unbenutzt|ungetragen|originalverpackung|etikett|neuwertig|non utilis|emballage d.origine|sin usar",
    "how": r"contact|e-?mail|portal|start a return|request|initiate|rma|form|kontakt|retoure|rücksendung|erklärung|formular|formulaire|contacte",
    "refund_time": r"(?s)(refund|erstatt|zurückzuzahlen|rembours|reembols).{0,120}(days|processed|issued|tage|jours|días)|(tagen|days|jours|días).{0,80}(zurückzuzahlen|erstatt|refund|rembours)",
}
SHIPPING_ITEMS = {
    "processing": r"process|handling|dispatch|prepar|ships? within|bearbeitung|versand(?:t|fertig)|verschickt|expédi|preparaci",
    "transit": r"(?s)(deliver|transit|arriv|lieferzeit|zustellung|lieferung|livraison|entrega)\w*.{0,60}\d",
    "rates": r"free (shipping|delivery)|rate|cost|fee|calculated at checkout|versandkosten|kostenlos|frais|gratuit|gastos de env|[$€£]\s?\d",
    "tracking": r"track|sendungsverfolgung|suivi|seguimiento",
}
PRIVACY_ITEMS = {
    "controller_contact": r"contact|e-?mail|@|kontakt|verantwortlich",
    "purposes": r"purpose|we use (your|the|this|personal)|use (of )?(your )?(personal )?information|zweck|finalit|finalidad",
    "recipients": r"share|third[- ]part|service provider|disclos|processor|empfänger|weitergabe|dritte|destinataire|destinatario",
    "transfer": r"transfer|outside (of )?(the )?(eea|eu|european|uk)|international|countries|drittländer|drittland|übermittlung|pays tiers",
    "retention": r"retain|retention|as long as|keep (your )?(personal )?(data|information)|delete|speicherdauer|gespeichert|lösch|conserv",
    "rights": r"right to|your rights|access, correct|delete your|erasure|opt[- ]out|recht auf|ihre rechte|auskunft|droit|derecho",
}
LEGAL_BASIS = r"legal basis|lawful basis|legitimate interest|consent|contract|rechtsgrundlage|art\.? ?6|einwilligung|base légale|base jurídica"
TAX = (
    r"tax(es)? included|incl(uding|\.)? (vat|tax)|inkl\.? mwst|\bttc\b|shipping calculated at checkout|calculated at checkout|tax(es)? and shipping|"
    r"shipping and tax|zzgl\.? versand|excl(uding|\.)? (vat|tax)|plus shipping|\bvat\b|duties"
)
CART = r"name=[\"']add[\"']|add[ -_]?to[ -_]?(cart|bag|basket)|/cart/add|in den warenkorb|ajouter au panier|añadir al carrito|buy now|add_to_cart"
ADDRESS = (
    r"\b\d{1,5}\s+\w+(\s\w+){0,3}\s(street|st\.?|road|rd\.?|avenue|ave\.?|lane|blvd|drive|way)\b|stra(ße|sse)\s*\d|\bstr\.\s*\d|\b\d{5}\s+[A-ZÀ-ÿ][a-z]|"
    r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b|\b[A-Z]\d[A-Z] ?\d[A-Z]\d\b|\b[A-Z]{2}\s\d{5}(-\d{4})?\b|suite \d|room \d|floor|building|district|路|号|室"
)
WITHDRAW_14 = (
    r"(?s)(14|fourteen|vierzehn|quatorze|catorce)[ -]?(day|tage|jours|días|giorni|dagen)\w*.{0,120}(withdraw|widerruf|rétractation|desistimiento|cancel)|"
    r"(withdraw|widerruf|rétractation|desistimiento|right to cancel|cancel).{0,120}(14|fourteen|vierzehn|quatorze|catorce)[ -]?(day|tage|jours|días)"
)
FORM = r"withdrawal form|widerrufsformular|muster-?widerruf|formulaire de rétractation|model (withdrawal|cancellation) form|cancellation form"
ODR = r"ec\.europa\.eu/consumers/odr|online dispute resolution|os-plattform|plateforme (européenne )?de règlement en ligne"
SALE = r"class=\"[^\"]*(compare-at|price--on-sale|price__sale|was-price|old-price|price-compare)"
SAFETY = r"manufacturer|hersteller|fabricant|fabricante|responsible person|eu representative|eu-verantwortlich|gpsr|product safety|produktsicherheit"
UNOPENED = r"only.{0,40}(unopened|unused|sealed)|(unopened|sealed) items? only"
SHIP_TIME = r"ships? within \d+|processing time|\d+\s*(-|to|–)\s*\d+\s*(business |working )?days|within \d+ (business |working )?days"
CANADIAN = r"\bCAD\b|C\$|canadian dollar"
BILLING = r"every \d+|per month|/\s?mo|monthly|billed|cancel any ?time"
TAGS = {
    "meta_pixel": r"connect\.facebook\.net|fbq\(", "tiktok_pixel": r"analytics\.tiktok\.com", "ga4": r"gtag/js\?id=g-|gtag\(['\"]config['\"], ['\"]g-",
    "google_ads": r"gtag/js\?id=aw-", "gtm": r"googletagmanager\.com/gtm\.js", "pinterest_tag": r"s\.pinimg\.com/ct/core\.js|pintrk\(",
    "snap_pixel": r"sc-static\.net/scevent|snaptr\(", "microsoft_uet": r"bat\.bing\.com", "reddit_pixel": r"redditstatic\.com/ads",
}
CONSENT = (
    r"cookiebot|onetrust|cookielaw|cookieyes|usercentrics|iubenda|termly|consentmanager|didomi|complianz|cookie-law-info|cookie-notice|quantcast|trustarc|"
    r"klaro|osano|privacy-banner|shopify-pc__banner|consent-banner|cookie-banner|cookie_consent|cookieconsent|pandectes|consentmo|enzuzo|axeptio|cookiefirst"
)
SELECTOR = r"currency[-_ ]?(selector|switcher|converter|picker)|country[-_ ]?(selector|picker)|localization_form|/localization"
METRIC = r"\b\d+(\.\d+)?\s?(cm|mm|kg|ml)\b"
IMPERIAL = r"\b\d+(\.\d+)?\s?(inch|inches|lbs?|oz|ft)\b|\b\d+(\.\d+)?\s?\"(?=[\s,;)x])"
DUTY = r"dut(y|ies)|customs|import (tax|fee|charge)|\bzoll|douane|\bDDP\b|\bDAP\b|vat included|taxes included|inkl\.? mwst|tax(es)? (are )?included|关税"
SAMPLE_TEXT = (
    r"lorem ipsum|your content here|talk about your brand|use this (text|section) to|share information about your brand|pair text with an image|"
    r"add a description here|write something|tell (your|customers) (brand'?s )?story|this is (a|your) (sample|demo) "
)
SAMPLE_IMAGE = r"<svg[^>]*class=\"[^\"]*placeholder-svg|<img[^>]+src=\"[^\"]*(placeholder|no-image|noimage)"
DEFAULT_NAME = r"^\s*(my store|my shop|store name|shop name)\b"
COPYRIGHT = r"(?:©|&copy;|copyright)\s*(\d{4})(?:\s*[-–]\s*(\d{4}))?"
SOCIAL_HOME = r"^https?://(www\.)?(facebook|instagram|twitter|x|tiktok|youtube|pinterest)\.com/?(shopify/?)?$"
TEST_ITEM = r"\b(test|testing|demo|sample product|dummy|do not buy)\b|测试|样品"
NOT_MERCHANDISE = r"protect|insurance|guarantee|gift[\s-]*card|e-?gift|warranty|shipping|\broute\b|donation|\btips?\b"
SUBSCRIPTION = r"subscri|recurring|auto[- ]?renew|every \d+ (day|week|month)s?|订阅|自动续费"
PAGE_SUBSCRIPTION = r"subscribe (?:&|and) save|subscription plan|auto[- ]?renew|deliver(?:ed|y)? every \d+"
#: The rule that a topic's contradiction fails.
TOPIC_RULE = {
    "return_days": "CNS-01", "delivery_days": "CNS-02", "return_payer": "CNS-03", "free_threshold": "CNS-04", "restocking_fee": "CNS-05", "refund_days": "CNS-07",
}
POLICIES = ("refund-policy", "shipping-policy", "privacy-policy", "terms-of-service", "legal-notice", "subscription-policy", "contact-information")
#: Rules that read the home page, where absence says little if
#: scripts draw it; and those that say nothing of a checkout domain.
HOME_RULES = ("POL-01", "POL-02", "POL-03", "POL-04", "POL-05", "GMC-01", "LOC-01", "TRU-04", "TRU-06", "GMC-06", "BIZ-03")
SHELL_RULES = ("SEO-01", "SEO-02", "SEO-03", "GMC-02", "TRU-02", "LOC-03", "POL-06")
POLICY_SHORT = 200


def has(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike("(?iu)" + pattern), F.lit(False))


def parse(pages: DataFrame) -> DataFrame:
    """Pages with what is read from their source once: said (main text), foot,
    head, foot_text, bar, anchors, edges (text of foot and head), drawn_home. Written
    to the shared folder, as flags and claims both read it. Each step stands in a
    projection of its own, so that what follows does not evaluate it anew."""
    home, unread = F.col("role") == "home", F.col("text").isNull()
    p = pages.withColumns({
        "_part": F.when(unread, html.main_part(F.when(unread, F.col("html")))), "_drawn": F.when(unread | home, html.scripted("html")),
        "foot": F.when(home, html.footer("html")), "head": F.when(home, html.header("html")), "bar": F.when(home, html.announcement("html")), "anchors": F.when(home, html.links("html")),
    })
    p = p.withColumn("_edges", F.when(home, F.concat_ws(" ", "foot", "head")))
    own = F.coalesce("text", F.when(F.col("html").isNotNull(), F.trim(html.to_text("_part"))), F.lit(""))
    p = p.withColumns({"said": own, "foot_text": F.when(home, html.to_text("foot")), "edges": F.when(home, html.to_text("_edges")), "_js": html.js_rendered("_drawn")})
    drawn = unread & (F.length("said") < POLICY_SHORT) & F.col("_js")
    p = p.withColumns({"result": F.when(drawn, "js_rendered").otherwise(F.col("result")), "said": F.when(drawn, "").otherwise(F.col("said")), "drawn_home": home & F.col("_js")})
    return cut(p.drop("_part", "_drawn", "_edges", "_js"), "parsed")


def page_flags(p: DataFrame) -> DataFrame:
    """One row for each parsed page: its flags and short strings, no source text."""
    home = F.col("role") == "home"
    p = p.withColumns({
        "src": F.coalesce("html", F.lit("")), "t": F.when(home, F.concat_ws("\n", "bar", "foot_text", "said")).otherwise(F.col("said")),
        # final-sale wording is read sentence by sentence, on the home page in bar and footer only
        "aside": F.when(home, F.concat_ws("\n", "bar", "foot_text")).otherwise(F.col("said")),
        "linked": F.when(home, F.array_join(F.transform("anchors", lambda a: F.concat_ws(" ", a["text"], a["href"])), "\n")),
    })
    p = p.withColumn("said_low", W.folded("said"))
    p = p.withColumns({
        **{f"{x}_low": F.when(home, W.folded(x)).otherwise(F.col("said_low")) for x in ("t", "aside")}, "linked_low": W.folded("linked"),
        "src_low": F.when(F.col("role").isin("home", "pdp"), W.folded("src")),
    })
    return p.select("site", "pos", "role", "name", "url", "result", *flag_columns())


@once
def flag_columns() -> list[Column]:
    role, name = F.col("role"), F.col("name")
    t, src = F.col("t"), F.col("src")
    policy = lambda *n: (role == "policy") & name.isin(*n)
    info = lambda *n: (role == "page") & name.isin(*n)
    final = W.may("aside_low", FINAL) & F.exists(T.sentences("aside"), lambda s: has(s, FINAL) & ~has(s, FAULTY) & ~has(s, EXEMPT))
    final = final & ~(policy("refund-policy", "terms-of-service") & W.has("said", FAULTY))
    mails = F.array_distinct(F.concat(T.emails(t), F.when(role == "home", F.regexp_extract_all(src, F.lit("mailto:([^\"'?>\\s]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))))
    mails = F.when(~role.isin("market_home", "market_policy", "robots", "sitemap"), mails)
    callable_ = (info("contact") | policy("contact-information"))
    where = lambda pattern: F.when(W.may("linked_low", pattern), F.try_element_at(F.filter("anchors", lambda a: has(a["text"], pattern) | has(a["href"], pattern)), F.lit(1))["href"])
    visible = ~role.isin("market_home", "market_policy", "robots", "sitemap")
    years = F.regexp_extract_all("foot_text", F.lit("(?i)" + COPYRIGHT), F.lit(1))
    ends = F.regexp_extract_all("foot_text", F.lit("(?i)" + COPYRIGHT), F.lit(2))
    last_year = F.coalesce(F.try_element_at(ends, F.lit(-1)).try_cast("int"), F.try_element_at(years, F.lit(-1)).try_cast("int"))
    foot_links = html.links("foot")
    legal = policy("refund-policy", "terms-of-service", "legal-notice") | info("faq")
    duties = policy("shipping-policy", "refund-policy", "terms-of-service") | info("faq") | role.isin("pdp", "home")
    lang = F.lower(F.coalesce(html.html_lang("html"), F.lit("en")))
    pairs = F.when(role.isin("home", "market_home"), html.hreflang("html"))
    code_lang = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), "-"), 1))
    share = T.english_share("said")
    untranslated = F.contains(F.lower(src), F.lit("translation missing")) | F.coalesce(share > 0.3, F.lit(False))
    flags = {
        "has_text": F.col("said") != "", "has_html": src != "", "n_chars": F.length("said"), "sha": F.when(policy("refund-policy") | (role == "market_policy"), T.sha_text(F.trim("said"))),
        "unfilled": (role == "policy") & (F.col("said") != "") & (W.has("said", PLACEHOLDER) | (F.length("said") < POLICY_SHORT)),
        "mails": mails, "phones": F.when(callable_, T.phones("said")).when(role == "home", T.phones("foot_text")),
        "template": visible & W.has("t", TEMPLATE_INFO), "hours": visible & W.has("t", HOURS), "address": visible & (role != "home") & W.has("said", ADDRESS),
        # the footer and the announcement bar are texts of their own beside the home page
        "side_address": (role == "home") & W.has("aside", ADDRESS), "final": (policy("refund-policy", "terms-of-service", "shipping-policy") | info("faq") | role.isin("pdp", "home")) & final,
        **{f"refund_{k}": policy("refund-policy") & W.has("said", v) for k, v in REFUND_ITEMS.items()}, "refund_final": policy("refund-policy") & W.has("said", FINAL),
        **{f"shipping_{k}": policy("shipping-policy") & W.has("said", v) for k, v in SHIPPING_ITEMS.items()},
        **{f"privacy_{k}": policy("privacy-policy") & W.has("said", v) for k, v in PRIVACY_ITEMS.items()}, "privacy_basis": policy("privacy-policy") & W.has("said", LEGAL_BASIS),
        "china": policy("refund-policy") & W.may("said_low", CHINA) & has(T.snippet("said", "(?i)" + CHINA, 90), "return|send|ship|address"),
        "pdp_returns": (role == "pdp") & W.has("said", "restocking|return"), "tax": (role == "pdp") & W.has("said", TAX), "cart": (role == "pdp") & W.has("src", CART),
        "billing": (role == "pdp") & W.has("said", BILLING), "page_subscription": (role == "pdp") & W.has("said", PAGE_SUBSCRIPTION),
        "legal_text": legal,
        **{k: legal & W.has("said", v) for k, v in (("withdraw", WITHDRAW_14), ("form", FORM), ("unopened", UNOPENED), ("faulty", FAULTY))},
        "canadian": F.when(role == "home", W.may("src_low", CANADIAN) & has(F.substring(src, 1, 200000), CANADIAN)).otherwise(legal & W.has("said", CANADIAN)), "odr": visible & (W.has("t", ODR) | ((role == "home") & W.may("src_low", ODR) & has(F.col("foot"), ODR))),
        "sale": (role == "pdp") & W.has("src", SALE), "safety": (role == "pdp") & W.has("said", SAFETY),
        "ship_time": (policy("shipping-policy") | info("faq")) & W.has("said", SHIP_TIME),
        "duty_text": duties,
        "duty": duties & F.when(role == "home", W.may("t_low", DUTY) & has(F.col("foot_text"), DUTY)).otherwise(W.has("said", DUTY)),
        "sample_text": (role.isin("home", "pdp", "page")) & W.has("said", SAMPLE_TEXT), "metric": (role == "pdp") & W.has("said", METRIC), "imperial": (role == "pdp") & W.has("said", IMPERIAL),
        "han": (role == "pdp") & ~lang.rlike("^(zh|ja|ko)") & (F.size(T.han_runs("said")) > 0),
        "legal_mail": policy("legal-notice") & (F.size(T.emails("said")) > 0), "legal_code": policy("legal-notice") & W.has("said", r"\b\d{4,5}\b"),
        **{f"link_{k}": F.when(role == "home", where(v)) for k, v in LINK.items()},
        "visible_contact": (role == "home") & (W.has("linked", LINK["contact"]) | (F.size(T.emails("edges")) > 0) | F.contains(F.concat_ws(" ", "foot", "head"), F.lit("mailto:"))),
        "tags": F.when(role == "home", F.array_compact(F.array(*[F.when(W.may("src_low", v) & has(F.lower(src), v), F.lit(k)) for k, v in TAGS.items()]))), "consent": (role == "home") & W.has("src", CONSENT),
        "selector": (role == "home") & ((F.size(M.localization_countries("src")) > 0) | W.has("src", SELECTOR)), "sample_image": (role == "home") & has(html.main_block("html"), SAMPLE_IMAGE),
        "favicon": (role == "home") & html.has_favicon("html"), "default_title": (role == "home") & has(F.coalesce(html.title("html"), F.lit("")), DEFAULT_NAME),
        "copyright_year": F.when(role == "home", last_year), "social_home": (role == "home") & W.may("src_low", SOCIAL_HOME) & F.exists(foot_links, lambda a: has(a["href"], SOCIAL_HOME)),
        "noindex": (role == "home") & html.noindex("html").isNotNull(), "drawn_home": F.col("drawn_home"), "is_store": (role == "home") & html.is_platform("html"),
        "lang": F.when(role == "home", html.html_lang("html")), "pairs": pairs, "seen": F.when(role == "home", M.offered("html")), "seen_pairs": F.when(role == "home", M.hreflang_countries(html.hreflang("html"))),
        "product_map": (role == "sitemap") & W.has("t", "product"), "canonical": F.when(role == "market_home", html.canonical("html")), "money": F.when(role == "market_home", M.shown_currency("html")),
        "untranslated": (role == "market_home") & (src != "") & ~code_lang.isin("en", "x") & untranslated, "translatable": (role == "market_home") & (src != "") & ~code_lang.isin("en", "x"),
    }
    return [v.alias(k) for k, v in flags.items()]


def texts_of(p: DataFrame) -> DataFrame:
    """site, source, url, text, ord of what claims are read from."""
    part = lambda source, text, at: F.struct(F.lit(source).alias("source"), F.col(text).alias("text"), F.lit(at).alias("part"))
    source = F.when(F.col("role") == "policy", F.concat(F.lit("policy:"), "name")).when(F.col("role") == "pdp", "pdp").otherwise(F.col("name"))
    at = F.when(F.col("role") == "policy", 0).when(F.col("role") == "page", 1).otherwise(2)
    said = F.when(F.col("role") == "home", F.array(part("announcement", "bar", 90), part("footer", "foot_text", 91), part("home", "said", 92))).otherwise(
        F.array(F.struct(source.alias("source"), F.col("said").alias("text"), at.alias("part")))
    )
    rows = p.where(F.col("role").isin("home", "policy", "page", "pdp")).select("site", "url", "name", "pos", F.explode(said).alias("s"))
    return rows.where("s.text <> ''").select("site", "url", "s.source", "s.text", F.struct("s.part", "name", "pos").alias("ord"))


def claim_facts(claims: DataFrame) -> DataFrame:
    """One row for each site: what its claims say for the rules."""
    topic, value, number = F.col("topic"), F.col("value"), F.col("value_num")
    refund = F.col("source") == "policy:refund-policy"
    fee = (topic == "restocking_fee") & (number > 0)
    facts = claims.groupBy("site").agg(
        F.bool_or(refund & (topic == "return_days")).alias("c_window"), F.bool_or(refund & (topic == "return_start")).alias("c_start"), F.bool_or(refund & (topic == "refund_days")).alias("c_refund_time"),
        F.bool_or((topic == "return_start") & (value == "purchase")).alias("c_purchase"), F.bool_or(refund & (fee | ((topic == "return_payer") & (value == "buyer")))).alias("c_fees"),
        F.bool_or(fee).alias("c_restocking"), F.bool_or(topic == "return_payer").alias("c_payer"), F.bool_or(refund & (topic == "return_payer")).alias("c_refund_payer"),
        F.max(F.when((topic == "return_days") & F.col("source").isin("policy:refund-policy", "policy:terms-of-service"), number)).alias("c_days"),
        F.bool_or(topic == "refund_days").alias("c_refund"), F.bool_or((topic == "refund_days") & (number > 14)).alias("c_slow"), F.bool_or(topic == "delivery_days").alias("c_delivery"),
        F.bool_or(topic == "currency_word").alias("c_cny"),
    )
    known = claims.where(~((topic == "entity") & value.rlike("(?i)" + PLATFORM_NAMES)))
    clash = C.conflicts(known, ["ord", "sp", "cp"]).withColumn("topic", F.substring_index("topic", ":", 1))
    clash = clash.groupBy("site").agg(F.collect_set("topic").alias("clashes"))
    return facts.join(clash, "site", "left")


def product_facts(products: DataFrame) -> DataFrame:
    named = F.concat_ws(" ", "title", "tags", "product_type")
    test = has(F.col("title"), TEST_ITEM) | has(F.col("handle"), TEST_ITEM)
    free = (F.col("price") <= 0.01) & ~has(F.col("title"), NOT_MERCHANDISE) & ~F.coalesce("virtual", F.lit(False))
    return products.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_products"), F.count_if(test | F.coalesce(free, F.lit(False))).alias("n_test"),
        F.bool_or(F.coalesce("has_plan", F.lit(False)) | has(named, SUBSCRIPTION)).alias("plans"), F.bool_or(F.coalesce("on_sale", F.lit(False))).alias("any_sale"),
    )


@once
def gathered_columns() -> list[Column]:
    """What the flags of a site's pages come to."""
    role, name = F.col("role"), F.col("name")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    policy = lambda n: (role == "policy") & (name == n)
    pdp = (role == "pdp") & (F.coalesce("result", F.lit("ok")) != "js_rendered")
    region = M.region_of(name)
    market = role.isin("market_home", "market_policy")
    want = M.currency(region)
    wrong_money = (role == "market_home") & F.col("money").isNotNull() & (F.col("money") != want)
    euro = M.groups(F.array(region))
    return [
        any_((role == "home") & F.col("has_html")).alias("has_home"), any_(F.col("has_text") | F.col("has_html")).alias("has_any"), F.max(F.when(role == "home", F.col("url"))).alias("home_url"),
        *[any_(policy(n) & F.col("has_text")).alias(f"text_{n}") for n in POLICIES], *[F.max(F.when(policy(n), F.col("url"))).alias(f"url_{n}") for n in POLICIES],
        *[F.max(F.when(policy(n), F.col("result"))).alias(f"result_{n}") for n in POLICIES], F.count_if(role == "policy").alias("n_policies"),
        any_((role == "policy") & F.col("unfilled")).alias("unfilled"), F.array_distinct(F.flatten(F.collect_list("mails"))).alias("mails"), F.array_distinct(F.flatten(F.collect_list("phones"))).alias("phones"),
        F.min(F.when(((role == "page") & (name == "contact") & F.col("has_text")) | (policy("contact-information") & F.col("has_text")), F.col("url"))).alias("contact_url"),
        *[any_(F.col(c)).alias(c) for c in (
            "template", "hours", "address", "side_address", "final", "refund_final", "china", "pdp_returns", "odr", "sale", "ship_time", "sample_text", "metric", "imperial", "han", "legal_mail", "legal_code",
            "visible_contact", "consent", "selector", "sample_image", "favicon", "default_title", "social_home", "noindex", "drawn_home", "is_store", "product_map", "untranslated", "translatable", "privacy_basis",
            "billing", "page_subscription", "safety", *[f"refund_{k}" for k in REFUND_ITEMS], *[f"shipping_{k}" for k in SHIPPING_ITEMS], *[f"privacy_{k}" for k in PRIVACY_ITEMS],
        )],
        any_(F.col("legal_text") & F.col("has_text")).alias("legal_items"), *[any_(F.col("legal_text") & F.col(c)).alias(f"legal_{c}") for c in ("withdraw", "form", "unopened", "faulty")],
        any_((F.col("legal_text") | (role == "home")) & F.col("canadian")).alias("canadian"), any_(F.col("duty_text") & (F.col("has_text") | (role == "home"))).alias("duty_items"), any_(F.col("duty_text") & F.col("duty")).alias("duty"),
        any_((role.isin("home", "pdp", "page")) & (F.col("has_text") | (role == "home"))).alias("sample_items"), *[F.max(f"link_{k}").alias(f"link_{k}") for k in LINK],
        F.first("tags", ignorenulls=True).alias("tags"), F.max("copyright_year").alias("copyright_year"), F.first("lang", ignorenulls=True).alias("lang"),
        F.first(F.when(role == "home", F.col("pairs")), ignorenulls=True).alias("pairs"), F.first("seen", ignorenulls=True).alias("seen"), F.first("seen_pairs", ignorenulls=True).alias("seen_pairs"),
        F.count_if(pdp).alias("n_pdp"), F.count_if(pdp & F.col("has_html")).alias("n_live_pdp"), F.count_if(pdp & F.col("has_html") & ~F.col("cart")).alias("n_no_cart"),
        any_(pdp & F.col("has_html") & F.col("tax")).alias("tax"), F.count_if(pdp & F.col("has_text")).alias("n_text_pdp"),
        F.count_if(market).alias("n_markets"), any_(wrong_money).alias("wrong_money"), any_((role == "market_home") & F.col("money").isNotNull() & want.isNotNull()).alias("money_seen"),
        any_((role == "market_home") & (urls.norm_url("canonical") != urls.norm_url("url"))).alias("canonical_off"),
        F.collect_set(F.when((role == "market_policy") & F.col("has_text") & F.exists(euro, lambda g: g.isin("EU", "UK")), F.col("sha"))).alias("market_shas"), F.max(F.when(policy("refund-policy"), F.col("sha"))).alias("refund_sha"),
        any_((role == "robots") & F.col("has_text")).alias("robots_read"), F.max(F.when(role == "robots", F.col("result"))).alias("robots_result"),
        any_((role == "sitemap") & F.col("has_text")).alias("sitemap_read"), F.max(F.when(role == "sitemap", F.col("result"))).alias("sitemap_result"),
    ]


def site_facts(sites: DataFrame, pages: DataFrame, products: DataFrame) -> DataFrame:
    """One row for each site with all that the rules ask for, written to the
    shared folder: findings, softening and status read it."""
    parsed = parse(pages)
    told = cut(page_flags(parsed), "flags")
    # pages of a site meet once: the window and the gathering are dealt alike
    flags = told.repartition("site")
    # of several pages for one policy the longest counts, the first of equals
    best = Window.partitionBy("site", "role", "name").orderBy(F.desc("n_chars"), "pos")
    flags = flags.withColumn("best", F.when(F.col("role") == "policy", F.row_number().over(best)).otherwise(1)).where("best = 1")
    role = F.col("role")
    gathered = flags.groupBy("site").agg(*gathered_columns())
    versions = told.where("role in ('home', 'market_home') and has_html").select("site", F.when(role == "home", 0).otherwise(F.col("pos") + 1).alias("pos"), "url", "pairs")
    wrong = M.hreflang_problems(versions).groupBy("site").agg(F.count(F.lit(1)).alias("n_hreflang_problems"))
    blocked = blocks_everything(parsed)
    stock = products.select("site", F.col("handle").alias("name"), "in_stock").groupBy("site", "name").agg(F.bool_or("in_stock").alias("stocked")).where("not stocked")
    live = parsed.where((role == "pdp") & F.col("html").isNotNull() & (F.col("html") != "") & (F.coalesce("result", F.lit("ok")) != "js_rendered")).select("site", "name")
    sold_out = live.join(stock, ["site", "name"]).groupBy("site").agg(F.count(F.lit(1)).alias("n_sold_out"))
    claims = claim_facts(cut(C.extract(texts_of(parsed).withColumnRenamed("ord", "o"), ("site", "o")).withColumnRenamed("o", "ord"), "said"))
    out = sites
    # each part is written before they meet: plans of this width cost more to optimise anew after each shuffle than their few rows to write
    for part, label in ((gathered, "gathered"), (wrong, "annotations"), (blocked, "robots"), (claims, "claims"), (product_facts(products), "products"), (sold_out, "sold-out")):
        out = out.join(cut(part, label), "site", "left")
    flagged = [f.name for f in out.schema if f.dataType.simpleString() == "boolean" and f.name not in ("https_redirect",)]
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flagged})
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_products", "n_test", "n_hreflang_problems", "n_pdp", "n_live_pdp", "n_no_cart", "n_sold_out", "n_text_pdp", "n_markets", "n_policies")})
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("mails", "phones", "tags", "seen", "seen_pairs", "clashes", "market_shas")})
    out = out.withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<code:string,href:string>>")))
    out = out.withColumns({"paste": F.col("mode") == "paste", "chosen": M.default_markets(F.col("user_markets"), F.col("seen")), "platform": F.coalesce("platform", F.when(F.col("is_store"), "shopify").when(F.col("has_home"), "other").otherwise("unknown"))})
    out = out.withColumns({"online": ~F.col("paste") & F.col("has_home"), "tokens": M.groups(F.col("chosen.countries")), "language_countries": M.language_markets(F.col("chosen"), F.col("seen_pairs"))})
    host = urls.host_of("home_url")
    shell = F.coalesce(F.startswith(host, F.lit("checkout.")) | F.contains(host, F.lit(".checkout.")) | F.endswith(host, F.lit("myshopify.com")), F.lit(False))
    failed = (F.col("mode") == "online") & ~F.col("has_home")
    out = out.withColumns({
        "multi": (F.size("language_countries") > 1) | (F.col("n_markets") > 0), "shell": shell, "failed": failed, "locked": F.col("password") & ~F.col("paste"),
        "unread": choose((failed, "homepage_unavailable"), (F.col("password") & ~F.col("paste"), "password_only"), otherwise=None),
        "subscription": F.coalesce("plans", F.lit(False)) | F.col("page_subscription"), "own_mails": F.filter("mails", lambda m: ~m.rlike(NOT_OWN_MAIL)),
        "foreign_langs": F.size(F.array_distinct(F.flatten(F.transform("language_countries", lambda c: F.slice(M.languages(c), 1, 1))))) > 1,
    })
    return cut(out, "facts")


def blocks_everything(pages: DataFrame) -> DataFrame:
    """site, blocks_all of robots files: a rule for every agent forbids "/"."""
    from ..sources import runs

    files = pages.where("role = 'robots' and coalesce(text, html) is not null").select("site", F.coalesce("text", "html").alias("content"))
    return runs.blocks_all(runs.robots_rules(files, keys=("site",)), keys=("site",))


@once
def verdicts() -> dict[str, Verdict]:
    """The verdict of every rule over the columns of ``site_facts``."""
    c = F.col
    online, paste, has_home = c("online"), c("paste"), c("has_home")
    read = has_home | paste
    text = lambda n: c(f"`text_{n}`")
    url = lambda n: c(f"`url_{n}`")
    got = lambda n: c(f"`result_{n}`")
    link = lambda n: c(f"`link_{n}`")
    ok = lambda good, bad="fail": F.when(good, "pass").otherwise(bad)
    target = lambda *g: F.arrays_overlap(c("tokens"), F.array(*[F.lit(x) for x in g]))
    missing = lambda items: F.array_join(F.array_compact(F.array(*[F.when(~cond, F.lit(k)) for k, cond in items.items()])), ",")
    complete = lambda items: F.nullif(missing(items), F.lit("")).isNull()
    clash = lambda t: F.array_contains(c("clashes"), t)
    out: dict[str, Verdict] = {}

    def presence(rid: str, n: str, level: str | None = None) -> Verdict:
        hidden = online & link(n).isNull() & ~F.coalesce(got(n) == "skipped", F.lit(False))
        gone = F.coalesce(got(n) == "not_found", F.lit(True)) | (c("platform") != "shopify")
        result = choose((text(n) & hidden, "fail"), (text(n), "pass"), (paste, "manual"), (~has_home, "unknown"), (link(n).isNotNull(), "unknown"), (gone, "fail"), otherwise="unknown")
        note = choose((text(n) & hidden, "exists_not_in_footer"), (text(n), F.lit(None)), (paste, "not_in_pasted_text"), (~has_home, "homepage_unavailable"), (link(n).isNotNull(), "footer_link_not_read"),
                      (gone, "no_page_no_footer_link"), otherwise=F.concat(F.lit("fetch_"), got(n)))
        evidence = F.when(text(n) & hidden, F.array(F.concat(F.lit(f"{n} ("), F.coalesce(url(n), F.lit("")), F.lit(")"))))
        return Verdict(result, note, F.coalesce(url(n), link(n)), evidence, F.when(text(n) & hidden, "P1"), F.when(~text(n) & paste, "not_found"))

    for rid, n in (("POL-01", "refund-policy"), ("POL-02", "shipping-policy"), ("POL-03", "privacy-policy"), ("POL-04", "terms-of-service")):
        out[rid] = presence(rid, n)
    no_policy = lambda rid, n: F.when(paste | (out[rid].result == "fail"), "skip").otherwise("unknown")
    reach = c("contact_url").isNotNull() | (F.size("mails") > 0) | (online & link("contact").isNotNull())
    out["POL-05"] = Verdict(choose((reach, "pass"), (~read, "unknown"), otherwise="fail"), where=F.coalesce("contact_url", link("contact")), evidence=F.when(reach, F.slice("mails", 1, 2)))
    notice = {"email": c("legal_mail"), "address": c("legal_code"), "footer_link": ~online | link("legal-notice").isNotNull()}
    out["POL-06"] = Verdict(
        choose((~target("DE", "AT"), "skip"), (~text("legal-notice"), F.when(read, "fail").otherwise("unknown")), otherwise=ok(complete(notice))),
        choose((~target("DE", "AT"), F.lit(None)), (~text("legal-notice"), "no_legal_notice"), otherwise=F.nullif(missing(notice), F.lit(""))), url("legal-notice"),
    )
    out["POL-07"] = Verdict(choose((c("unfilled"), "fail"), (c("n_policies") > 0, "pass"), otherwise="unknown"))
    out["POL-08"] = Verdict(choose((~c("subscription"), "skip"), otherwise=ok(text("subscription-policy"))), choose((~c("subscription"), "no_subscription_seen"), (~text("subscription-policy"), "subscription_products_no_policy"), otherwise=None))
    refund = {"window": c("c_window") | c("refund_final"), "start": c("c_start") | c("refund_start"), "condition": c("refund_condition"), "how": c("refund_how"), "refund_time": c("c_refund_time") | c("refund_refund_time")}
    out["CON-01"] = Verdict(F.when(text("refund-policy"), ok(complete(refund))).otherwise(no_policy("POL-01", "refund-policy")), F.when(text("refund-policy"), F.nullif(missing(refund), F.lit(""))).otherwise("no_refund_policy"), url("refund-policy"))
    out["CON-02"] = Verdict(choose((c("c_purchase"), "fail"), (text("refund-policy"), "pass"), otherwise="unknown"))
    shipping = {k: c(f"shipping_{k}") for k in SHIPPING_ITEMS}
    out["CON-03"] = Verdict(F.when(text("shipping-policy"), ok(complete(shipping))).otherwise(no_policy("POL-02", "shipping-policy")), F.when(text("shipping-policy"), F.nullif(missing(shipping), F.lit(""))).otherwise("no_shipping_policy"), url("shipping-policy"))
    out["CON-04"] = Verdict(choose((~c("c_fees"), "pass"), ((c("n_pdp") > 0) & ~paste, ok(c("pdp_returns"))), otherwise="unknown"))
    out["CON-05"] = Verdict(ok(~c("c_restocking")))
    out["CON-06"] = Verdict(ok(~c("final")), level=F.when(target("AU", "EU", "UK"), "P0").otherwise("P1"))
    out["CON-07"] = Verdict(choose((c("china") & ~c("c_refund_payer"), "fail"), (text("refund-policy"), "pass"), otherwise="unknown"))
    for topic, rid in TOPIC_RULE.items():
        out[rid] = Verdict(ok(~clash(topic)))
    out["CNS-06"] = Verdict(ok(~(c("c_cny") & c("currency").isNotNull() & (c("currency") != "CNY"))))
    out["CNS-08"] = Verdict(ok(~clash("entity")))
    out["GMC-01"] = Verdict(F.when(online, ok(c("visible_contact"))).otherwise("unknown"), F.when(~online, "needs_live_site"), F.coalesce("contact_url", link("contact")))
    out["GMC-02"] = Verdict(F.when(online & c("https_redirect").isNotNull(), ok(c("https_redirect"))).otherwise("unknown"))
    live = (c("n_live_pdp") > 0) & ~paste
    out["GMC-03"] = Verdict(F.when(live, ok(c("tax"))).otherwise("unknown"), F.when(~live, "no_product_page"))
    dead = (c("n_no_cart") == c("n_live_pdp")) | (c("n_sold_out") == c("n_live_pdp"))
    out["GMC-05"] = Verdict(F.when(live, ok(~dead)).otherwise("unknown"), F.when(~live, "no_product_page"))
    gaps = M.language_gaps(c("language_countries"), c("lang"), c("pairs"))
    out["GMC-04"] = Verdict(F.when(has_home, ok(F.size(gaps) == 0)).otherwise("unknown"), evidence=gaps)
    address = c("address") | c("side_address")
    out["GMC-06"] = Verdict(choose((address, "pass"), (~read, "unknown"), otherwise="fail"))
    out["GMC-07"] = Verdict(F.when(c("subscription"), ok(c("billing"))).otherwise("skip"), F.when(~c("subscription"), "no_subscription_seen"))
    terms = [rid for t, rid in TOPIC_RULE.items() if t in ("return_days", "return_payer", "refund_days")]
    clashing = F.array_join(F.array_compact(F.array(*[F.when(out[r].result == "fail", F.lit(r)) for r in terms])), ",")
    out["GMC-08"] = Verdict(ok(clashing == ""), F.when(clashing != "", F.concat(F.lit("see "), clashing)))
    right = c("legal_withdraw") | (F.coalesce(c("c_days") >= 14, F.lit(False)) & ~c("c_purchase"))
    untold = F.when(paste | F.coalesce(got("refund-policy") == "not_found", F.lit(False)), "fail").otherwise("unknown")
    items = c("legal_items")
    lawful = lambda cond: F.when(items, ok(cond)).otherwise(untold)
    no_text = F.when(~items, "no_return_text")
    out["EU-01"] = out["UK-01"] = Verdict(lawful(right), no_text)
    out["EU-02"] = Verdict(lawful(c("legal_form")), no_text)
    prompt = c("c_refund") & ~c("c_slow")
    out["EU-03"] = Verdict(lawful(prompt), F.coalesce(no_text, F.when(~c("c_refund"), "not_stated")))
    out["UK-02"] = Verdict(lawful(prompt), no_text)
    out["EU-04"] = Verdict(lawful(c("c_payer")), no_text)
    out["EU-05"] = Verdict(ok(~c("odr")))
    out["EU-06"] = Verdict(F.when(c("sale") | F.coalesce("any_sale", F.lit(False)), "manual").otherwise("pass"))
    out["EU-07"] = Verdict(F.when(c("n_text_pdp") > 0, ok(c("safety"))).otherwise("unknown"), F.when(c("n_text_pdp") == 0, "no_product_page"))
    out["DE-01"] = Verdict(F.when((out["CNS-08"].result == "fail") & text("legal-notice"), "fail").otherwise("same"), same_as="POL-06")
    disclosed = {"phone": F.size("phones") > 0, "address": address, "currency": c("canadian"), "refund_terms": text("refund-policy")}
    out["CA-01"] = Verdict(ok(complete(disclosed)), F.nullif(missing(disclosed), F.lit("")))
    out["AU-01"] = Verdict(ok(~((out["CON-06"].result == "fail") | (c("legal_unopened") & ~c("legal_faulty")))))
    out["US-01"] = Verdict(choose((c("c_delivery") | c("ship_time"), "pass"), (read, "fail"), otherwise="unknown"))
    private = {**{k: c(f"privacy_{k}") for k in PRIVACY_ITEMS}, "legal_basis": c("privacy_basis") | ~target("EU", "UK")}
    out["PRV-01"] = Verdict(F.when(text("privacy-policy"), ok(complete(private))).otherwise(no_policy("POL-03", "privacy-policy")), F.when(text("privacy-policy"), F.nullif(missing(private), F.lit(""))).otherwise("no_privacy_policy"))
    tracked = F.size("tags") > 0
    out["PRV-02"] = Verdict(F.when(online, F.when(tracked, "manual").otherwise("pass")).otherwise("unknown"), evidence=c("tags"))
    out["PRV-03"] = Verdict(F.when(online, ok(~tracked | c("consent"))).otherwise("unknown"), F.when(online & ~tracked, "no_tracking_seen"), c("home_url"))
    out["PRV-04"] = Verdict(F.lit("unknown"), F.lit("needs_browser"))
    out["BIZ-01"] = Verdict(F.lit("same"), same_as="CNS-08")
    free = F.filter("own_mails", lambda m: m.rlike("(?i)" + FREE_MAIL))
    out["BIZ-02"] = Verdict(choose((F.size(free) > 0, "fail"), (F.size("own_mails") > 0, "pass"), otherwise="unknown"), evidence=F.slice(free, 1, 2))
    out["BIZ-03"] = Verdict(choose((c("template"), "fail"), (read, "pass"), otherwise="unknown"), evidence=F.when(c("template"), F.array(F.lit("template text"))))
    local = F.filter("phones", lambda p: ~p.rlike(r"^(\+|00)"))
    chinese = F.filter("phones", lambda p: F.regexp_replace(p, r"[\s.\-()]", "").rlike(r"^(\+86|0086)"))
    out["BIZ-04"] = Verdict(choose(((F.size(local) > 0) & (F.size("chosen.countries") > 1), "fail"), ((F.size(chinese) > 0) & ~c("hours"), "fail"), (F.size("phones") > 0, "pass"), otherwise="skip"), F.when(F.size("phones") == 0, "no_phone"))
    alive = lambda result: F.when(online, result).otherwise("unknown")
    off = F.when(~online, "needs_live_site")
    out["LOC-01"] = Verdict(alive(ok(c("selector"))), off, c("home_url"))
    out["LOC-02"] = Verdict(alive(choose((c("platform") != "shopify", "skip"), (c("wrong_money"), "fail"), (c("money_seen"), "pass"), otherwise="unknown")), F.coalesce(off, F.when(c("platform") != "shopify", "not_shopify")))
    absent = F.size("pairs") == 0
    out["LOC-03"] = Verdict(alive(F.when(absent, ok(~((F.size("language_countries") > 1) & c("foreign_langs")))).otherwise(ok(c("n_hreflang_problems") == 0))), F.coalesce(off, F.when(absent, "no_annotations")), c("home_url"))
    sold_in = c("n_markets") > 0
    out["LOC-04"] = Verdict(alive(choose((c("canonical_off"), "fail"), (sold_in, "pass"), otherwise="skip")), off)
    out["LOC-05"] = Verdict(alive(choose((c("untranslated"), "fail"), (c("translatable"), "pass"), otherwise="skip")), off)
    out["LOC-06"] = Verdict(choose((c("han"), "fail"), (c("n_pdp") > 0, "pass"), otherwise="unknown"))
    us, others = target("US") & c("metric") & ~c("imperial"), target("EU", "UK", "AU", "CA") & c("imperial") & ~c("metric")
    out["LOC-07"] = Verdict(F.when(c("n_pdp") == 0, "unknown").otherwise(ok(~(us | others))), choose((c("n_pdp") == 0, F.lit(None)), (us, "metric_only"), (others, "imperial_only"), otherwise=None))
    out["LOC-08"] = Verdict(choose((c("duty"), "pass"), (c("duty_items"), "fail"), otherwise="unknown"))
    alike = F.array_contains(c("market_shas"), c("refund_sha")) & text("refund-policy")
    # only rules that hold for the targeted markets can leave a legal gap
    gap = ((out["EU-01"].result == "fail") & target("EU")) | ((out["UK-01"].result == "fail") & target("UK"))
    out["LOC-09"] = Verdict(alive(choose((F.coalesce(alike, F.lit(False)) & gap, "fail"), (sold_in, "pass"), otherwise="skip")), off)
    out["LOC-10"] = Verdict(F.when(sold_in, "info").otherwise("skip"))
    out["TRU-01"] = Verdict(choose((c("sample_text"), "fail"), (c("sample_items"), "pass"), otherwise="unknown"))
    out["TRU-02"] = Verdict(alive(ok(~c("sample_image"))), where=c("home_url"), evidence=F.when(c("sample_image"), F.array(F.lit("placeholder image"))))
    out["TRU-03"] = Verdict(choose((c("n_test") > 0, "fail"), (c("n_products") > 0, "pass"), otherwise="unknown"))
    out["TRU-04"] = Verdict(alive(ok(c("favicon"))), where=c("home_url"))
    out["TRU-05"] = Verdict(choose((c("password"), "manual"), (online, "pass"), otherwise="unknown"), F.when(c("password"), "password_page"), c("home_url"))
    stale = F.coalesce(c("copyright_year") < F.year("today") - 1, F.lit(False))
    named = c("default_title") | has(F.coalesce("name", F.lit("")), DEFAULT_NAME)
    worn = F.array_compact(F.array(F.when(named, F.lit("title")), F.when(stale, F.concat(F.lit("copyright "), c("copyright_year").cast("string"))), F.when(c("social_home"), F.lit("social"))))
    out["TRU-06"] = Verdict(alive(ok(F.size(worn) == 0)), F.lit(None), c("home_url"), worn)
    out["SEO-01"] = Verdict(alive(choose((c("robots_read"), ok(~c("blocks_all"))), (c("robots_result") == "not_found", "pass"), otherwise="unknown")),
                            choose((~online, "needs_live_site"), (c("robots_read"), F.lit(None)), (c("robots_result") == "not_found", "no_robots_file"), otherwise=F.concat(F.lit("robots_"), F.coalesce("robots_result", F.lit("None")))))
    out["SEO-02"] = Verdict(alive(ok(~c("noindex"))), off, c("home_url"))
    out["SEO-03"] = Verdict(alive(choose((c("sitemap_read"), ok(c("product_map"))), (c("sitemap_result").isin("not_found", "error"), "fail"), otherwise="unknown")),
                            choose((~online, "needs_live_site"), (c("sitemap_read"), F.when(~c("product_map"), "no_products")), otherwise=F.concat(F.lit("sitemap_"), F.coalesce("sitemap_result", F.lit("None")))))
    # a failed run judges nothing, a password page only that it is there
    return {
        rid: v._replace(
            result=F.when(c("failed"), F.lit(None)).when(c("locked"), F.lit("manual") if rid == "TRU-05" else F.lit(None)).otherwise(v.result),
            note=F.when(c("failed") | (c("locked") & F.lit(rid != "TRU-05")), F.lit(None)).otherwise(v.note if v.note is not None else F.lit(None)),
        )
        for rid, v in out.items()
    }


def soften(findings: DataFrame) -> DataFrame:
    """What is absent from a home page that scripts draw, or from a checkout
    domain, is unknown and not missing; both stand in each finding."""
    fail = F.col("result") == "fail"
    soft = (F.col("shell") & F.col("rule_id").isin(*SHELL_RULES)) | ((F.col("drawn_home") | F.col("shell")) & F.col("rule_id").isin(*HOME_RULES) & (F.size("evidence") == 0))
    soft = soft & fail
    changed = {"note": F.when(soft, "js_home").otherwise(F.col("note")), "badge": F.when(soft, "not_found").otherwise(F.col("badge")), "result": F.when(soft, "unknown").otherwise(F.col("result"))}
    return findings.withColumns(changed).drop("drawn_home", "shell")


def status(facts: DataFrame) -> DataFrame:
    """site, status of the run: failed without a home page, partial when pasted,
    locked, drawn by scripts, on another platform or with key pages blocked."""
    bad = F.lit(False)
    for n in ("refund-policy", "shipping-policy", "privacy-policy"):
        bad = bad | F.coalesce(F.col(f"`result_{n}`").isin("blocked", "error"), F.lit(False))
    out = choose((F.col("failed"), "failed"), ((F.col("mode") != "online") | F.col("password"), "partial"), ((F.col("platform") != "shopify") | F.col("drawn_home"), "partial"), (bad, "partial"), otherwise="complete")
    return facts.select("site", out.alias("status"))


def audit(facts: DataFrame) -> DataFrame:
    """Findings of every rule for every site of ``site_facts``."""
    rules = dimension(facts.sparkSession, RULES, SOURCES)
    # seventy rows for each site: what softening asks of the site goes with them, a join would move all of them
    return soften(evaluate(facts, verdicts(), rules, ("site", "drawn_home", "shell")))
