"""Facts said in texts, and where two sources of a site contradict each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wording as W

#: Wording of the topics, in several languages.
DAY = r"(?:days?|tage[n]?|jours?|d[ií]as|giorni|dagen|天)"
RETURN = r"(?i)\b(?:return|returns|returned|exchange|money[- ]back|retour|rücksend|widerruf|withdraw|cancel)\w*|退货|退换"
WITHDRAW = r"(?i)widerruf|withdraw|right to cancel|cancellation right|rétractation|desistimiento"
REFUND = r"(?i)\brefund\w*|erstatt|zurückzuzahl|zurückzahl|rembours|reembols|退款"
WARRANTY = r"(?i)warrant|guarantee(?!.{0,20}(?:money|refund))|质保|保修"
PROCESS = r"(?i)process|credited|issued|reflect|back to your|appear|zurückzuzahlen|zurückzahl|erstatten|到账"
SHIP = r"(?i)deliver|arriv|transit|shipping time|ship(?:ped|s)? within|versand|lieferzeit|livraison|送达|配送|运输"
HANDLING = r"(?i)process|handling|prepar|dispatch|处理|备货"
FROM_PURCHASE = (
    r"(?i)(?:from|of|after)\s+(?:the\s+)?(?:date\s+of\s+)?(?:your\s+)?(?:purchase|order(?:\s+date)?|ordering|payment|placing)\b|"
    r"bestelldatum|kaufdatum|ab (?:der )?bestellung|date de (?:la )?commande|fecha de (?:la )?compra|下单|购买之?日"
)
FROM_DELIVERY = (
    r"(?i)(?:from|of|after)\s+(?:the\s+)?(?:date\s+of\s+)?(?:your\s+)?(?:deliver\w*|receiv\w*|receipt|arrival)\b|"
    r"签收|收到|in besitz|erhalt|empfang|réception|livraison|recepción|entrega"
)
FREE_SHIPPING = (
    r"(?i)free (?:standard )?(?:shipping|delivery)[^.\n]{0,40}?(?:over|above|from|on orders (?:of |over |above )?)"
    r"\s*([$€£]|USD|EUR|GBP|CAD|AUD|A\$|C\$)?\s?(\d{1,4}(?:[.,]\d{2})?)"
)
FREE_SHIPPING_ZH = r"满\s*([$€£]|USD|EUR)?\s?(\d{1,4})\s*(?:美元)?\s*包邮"
BUYER_PAYS = (
    r"(?i)(?:customer|buyer|you)\w*\s+(?:are|is|will be|shall be)?\s*responsible for\s+(?:the\s+|all\s+)?(?:cost of\s+)?return|"
    r"return shipping (?:costs?|fees?) (?:are|is|will be) (?:paid|covered|borne) by (?:the )?(?:customer|buyer|you)|"
    r"at (?:the )?(?:customer|buyer)'?s? (?:own )?(?:expense|cost)|(?:customer|buyer)s? (?:pay|cover)s? (?:for )?(?:the )?(?:cost of )?return|"
    r"(?<!wir )tragen (?:sie )?die (?:unmittelbaren )?kosten der rücksendung|买家承担|顾客承担"
)
SELLER_PAYS = (
    r"(?i)free returns?|we (?:will )?(?:cover|pay)(?: for)? (?:the )?return|prepaid return label|return shipping is free|"
    r"returns? (?:are|is) free|wir tragen die kosten der rücksendung|kostenlose rücksendung|免费退货"
)
RESTOCKING = r"(?i)(?:(\d{1,2})\s?%\s*restocking fee|restocking fee of\s*(\d{1,2})\s?%)"
NO_RESTOCKING = r"(?i)no restocking fee"
CNY_WORD = r"\b(?:RMB|CNY)\b|人民币"
#: Number words read as digits.
NUMBER_WORDS = {
    "seven": "7", "fourteen": "14", "thirty": "30", "sixty": "60", "ninety": "90", "sieben": "7", "vierzehn": "14", "dreißig": "30",
    "dreissig": "30", "quatorze": "14", "trente": "30", "catorce": "14", "treinta": "30",
}
MAX_SENTENCE, MAX_SNIPPET = 600, 240
TOPICS = ("return_days", "return_start", "refund_days", "delivery_days", "free_threshold", "return_payer", "restocking_fee", "currency_word", "entity", "email")


def _claim(topic: str, value: Column, kind: Column | None = None) -> Column:
    kind = kind if kind is not None else F.lit(None)
    said = value.cast("string")
    return T.let(said, lambda x: F.when(x.isNotNull() & (x != ""), F.struct(F.lit(topic).alias("topic"), x.alias("value"), kind.cast("string").alias("kind"))))


def sentence_claims(s: Column) -> Column:
    """Array of struct(topic, value, kind) of one sentence."""
    told = F.struct(s.rlike(RETURN).alias("ret"), s.rlike(REFUND).alias("ref"), s.rlike(WARRANTY).alias("warranty"), s.rlike(PROCESS).alias("processing"))
    return F.filter(T.let(told, lambda w: _all_claims(s, w)), lambda c: c.isNotNull())


def _all_claims(s: Column, told: Column) -> Column:
    """The claims of each topic, null for none; ``told``: which words are there."""
    ret, ref, warranty, processing = told["ret"], told["ref"], told["warranty"], told["processing"]
    about = (ret | (ref & ~processing)) & ~(warranty & ~ret)
    day = rf"(?i)(\d{{1,3}})\s*[- ]?\s*(?:calendar\s+)?{DAY}(?!.{{0,12}}(?:business|working|werktag))"
    counts = F.transform(F.regexp_extract_all(s, F.lit(day), F.lit(1)), lambda n: n.cast("int"))
    days = F.try_element_at(F.filter(counts, lambda n: (n >= 7) & (n <= 365)), F.lit(1))
    tail = F.substring(F.regexp_extract(s, rf"(?is)\d{{1,3}}\s*[- ]?\s*(?:calendar\s+)?{DAY}(.*)$", 1), 1, 60)
    at_p, at_d = F.regexp_instr(tail, F.lit(FROM_PURCHASE)), F.regexp_instr(tail, F.lit(FROM_DELIVERY))
    start = F.when((at_p > 0) & ((at_d == 0) | (at_p < at_d)), "purchase").when(at_d > 0, "delivery")
    refund = F.regexp_extract(s, rf"(?i)(?:within|up to|in|binnen|innerhalb von|spätestens|sous|dans un délai de|en un plazo de)\s+(\d{{1,3}})\s*(?:business |working )?{DAY}", 1)
    span = rf"(?i)(\d{{1,3}})\s*(?:-|–|—|to|bis|à|a|~|至)\s*(\d{{1,3}})\s*(?:business |working )?{DAY}"
    low, high = F.regexp_extract(s, span, 1).try_cast("int"), F.regexp_extract(s, span, 2).try_cast("int")
    free = lambda p: F.when(F.regexp_extract(s, p, 2) != "", F.concat(F.regexp_extract(s, p, 1), _plain(F.replace(F.regexp_extract(s, p, 2), F.lit(","), F.lit(".")))))
    fee = F.concat(F.regexp_extract(s, RESTOCKING, 1), F.regexp_extract(s, RESTOCKING, 2))
    payer = F.when(s.rlike(BUYER_PAYS), "buyer").when(s.rlike(SELLER_PAYS), "seller")
    one = F.array(
        _claim("return_days", F.when(about & ~(ref & processing), days), F.when(s.rlike(WITHDRAW), "withdrawal")),
        _claim("return_start", F.when(about, start)),
        _claim("refund_days", F.when(ref & processing, F.nullif(refund, F.lit("")))),
        _claim("delivery_days", F.when(s.rlike(SHIP) & ~s.rlike(HANDLING) & ~ret & (low <= high) & (high <= 90), F.concat(low.cast("string"), F.lit("-"), high.cast("string")))),
        _claim("free_threshold", F.coalesce(free(FREE_SHIPPING), free(FREE_SHIPPING_ZH))),
        _claim("return_payer", F.when(ret | F.contains(F.lower(s), F.lit("return")), payer)),
        _claim("restocking_fee", F.when(fee != "", fee).when(s.rlike(NO_RESTOCKING), "0")),
        _claim("currency_word", F.when(s.rlike(CNY_WORD), F.lit("CNY"))),
    )
    firms = F.transform(T.legal_names(s), lambda n: _claim("entity", n))
    return F.concat(one, firms)


def _plain(amount: Column) -> Column:
    return F.when(F.contains(amount, F.lit(".")), F.regexp_replace(amount, r"\.?0+$", "")).otherwise(amount)


#: One of these is in each sentence that makes a claim: all counts of days have a digit.
CLAIMING = (r"\d", FREE_SHIPPING, FREE_SHIPPING_ZH, BUYER_PAYS, SELLER_PAYS, RESTOCKING, NO_RESTOCKING, CNY_WORD, T.LEGAL_ENDS, T.LEGAL_CHINESE)


def extract(texts: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Claims of texts (keys, source, url, text) in order of appearance; e-mail
    addresses of a text come after its sentences. Only texts and sentences that hold
    a literal of some topic are searched for all of them."""
    numbered = W.may("_low", *NUMBER_WORDS)
    t = reduce(lambda c, kv: F.regexp_replace(c, rf"(?i)\b{kv[0]}\b", kv[1]), NUMBER_WORDS.items(), F.col("_raw"))
    rows = texts.withColumn("_raw", F.coalesce("text", F.lit(""))).withColumn("_low", W.folded("_raw")).withColumn("_t", F.when(numbered, t).otherwise(F.col("_raw")))
    # chosen by flags of an outer explosion: a filter would be pushed to where each mention folds the text anew
    some = F.when(numbered | W.may("_low", *CLAIMING), T.sentences("_t"))
    sent = rows.select(*keys, "source", "url", F.posexplode_outer(some).alias("sp", "s")).withColumn("s", F.substring("s", 1, MAX_SENTENCE)).withColumn("_low", W.folded("s"))
    found = sent.select(*keys, "source", "url", "sp", "s", F.posexplode(F.when(W.may("_low", *CLAIMING), sentence_claims(F.col("s")))).alias("cp", "c"))
    found = found.select(*keys, "source", "url", "sp", "cp", "c.topic", "c.kind", "c.value", F.substring("s", 1, MAX_SNIPPET).alias("snippet"))
    mail = rows.where(F.contains("_raw", F.lit("@"))).select(*keys, "source", "url", F.posexplode(T.emails("_t")).alias("cp", "value"))
    mail = mail.select(*keys, "source", "url", F.lit(1 << 30).alias("sp"), "cp", F.lit("email").alias("topic"), F.lit(None).cast("string").alias("kind"), "value", F.col("value").alias("snippet"))
    out = found.unionByName(mail)
    return out.withColumn("value_num", F.regexp_extract("value", r"(\d+(?:\.\d+)?)", 1).try_cast("double"))


def source_group(source: Column) -> Column:
    """Home page, footer and announcement speak as one."""
    return F.when(source.isin("home", "footer", "announcement"), "home").otherwise(source)


def comparable(topic: Column, value: Column) -> Column:
    return F.when(topic == "free_threshold", F.regexp_replace(value, r"[^\d.]", "")).otherwise(F.lower(value))


def overlaps(a: Column, b: Column) -> Column:
    """Closed ranges "low-high" meet."""
    low = lambda x: F.substring_index(x, "-", 1).try_cast("int")
    high = lambda x: F.substring_index(x, "-", -1).try_cast("int")
    return F.coalesce((low(a) <= high(b)) & (low(b) <= high(a)), F.lit(False))


def conflicts(claims: DataFrame, order: list, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row for each topic with the first pair of source groups that
    disagree: different first values, neither also said by the other group,
    names not part of each other, ranges apart."""
    k = list(keys)
    c = claims.withColumns({
        "grp": source_group(F.col("source")), "topic_key": F.concat_ws(":", "topic", "kind"), "norm": comparable(F.col("topic"), F.col("value")),
    })
    first = c.groupBy(*k, "topic", "topic_key", "grp").agg(
        F.min_by(F.struct("value", "norm", "source", "url", "snippet"), F.struct(*order)).alias("f"), F.min(F.struct(*order)).alias("o"), F.collect_set("norm").alias("said")
    )
    a, b = first.alias("a"), first.alias("b")
    on = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in [*k, "topic_key"]] + [F.col("a.o") < F.col("b.o")]
    va, vb = F.col("a.f.norm"), F.col("b.f.norm")
    topic = F.col("a.topic")
    clash = (va != vb) & ~F.array_contains(F.col("b.said"), va) & ~F.array_contains(F.col("a.said"), vb)
    clash = clash & ~((topic == "entity") & (F.contains(va, vb) | F.contains(vb, va))) & ~((topic == "delivery_days") & overlaps(va, vb))
    pairs = a.join(b, on).where(clash)
    best = F.min_by(F.struct(F.col("a.f").alias("a"), F.col("b.f").alias("b")), F.struct(F.col("a.o"), F.col("b.o")))
    return pairs.groupBy(*[F.col(f"a.{x}").alias(x) for x in k], F.col("a.topic_key").alias("topic")).agg(best.alias("pair")).select(
        *k, "topic", F.col("pair.a.source").alias("source_a"), F.col("pair.a.value").alias("value_a"), F.col("pair.b.source").alias("source_b"), F.col("pair.b.value").alias("value_b")
    )


def return_windows(texts: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """keys, days, rank: return windows a text states, the most frequent first."""
    return texts.select(*keys, F.posexplode(T.return_windows("text")).alias("pos", "days")).select(*keys, "days", (F.col("pos") + 1).alias("rank"))
