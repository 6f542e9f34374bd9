"""Files a person pasted or saved by hand: what each is, by its name and then by its
text, and an index of roles as a capture would have written it.

Which of several files for one policy keeps the role is a ranking within the site,
so two files never share it; the ranking's order is total (by name), the result
does not depend on how files were read. Damaged, unreadable and foreign files
stay as rows with their state.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


class Kind(NamedTuple):
    role: str
    handle: str | None
    name: str
    content: str | None


#: File endings that are read, and kinds in the order they are tried.
TEXT_FILE, CSV_FILE = r"(?i)\.(txt|md|html|htm|text)$", r"(?i)\.csv$"
KINDS = (
    Kind("policy", "refund-policy", r"refund|return|退货|退款|widerruf|retour", r"\b(refund|return)s?\b.{0,80}\b(days?|within)\b|退货|退款"),
    Kind("policy", "shipping-policy", r"ship|deliver|运费|物流|发货|versand", r"\b(shipping|delivery|dispatch)\b.{0,80}\b(days?|business)\b|运费|发货"),
    Kind("policy", "privacy-policy", r"privacy|隐私|datenschutz", r"personal (data|information)|privacy|隐私|个人信息"),
    Kind("policy", "terms-of-service", r"terms|tos|条款|agb", r"terms of service|服务条款"),
    Kind("policy", "legal-notice", r"impressum|imprint|legal|法律声明", r"impressum|legal notice"),
    Kind("policy", "subscription-policy", r"subscri|订阅", r"subscription"),
    Kind("policy", "contact-information", r"contact-information", None),
    Kind("page", "contact", r"contact|联系", r"contact us|联系我们|email us"),
    Kind("page", "faq", r"faq|常见问题|questions|help", r"\bfaq\b|frequently asked|常见问题"),
    Kind("page", "about", r"about|关于", r"about us|our story|关于我们"),
    Kind("home", None, r"home|首页|announcement|公告|footer|页脚", None),
)
#: Words of a page's role in a link's text or a path, in their order,
#: and the policy that a page of a role stands in for.
ROLE_WORDS = (
    ("refund", r"refund|return|retour|r[uü]ckgabe|widerruf|devoluci|rembourse"), ("shipping", r"shipping|delivery|versand|lieferung|livraison|env[ií]o"), ("privacy", r"privacy|datenschutz|confidentialit|privacidad"),
    ("terms", r"terms|conditions|\bagb\b|cgv|t[eé]rminos|conditions-generales"), ("legal", r"impressum|imprint|legal[- ]notice|mentions[- ]l[eé]gales|aviso[- ]legal"), ("contact", r"contact|kontakt|contacto"),
    ("faq", r"\bfaq|help|hilfe|aide|ayuda|questions"), ("about", r"about|[uü]ber[- ]uns|qui[- ]sommes|nosotros"),
)
STANDS_FOR = {"refund": "refund-policy", "shipping": "shipping-policy", "privacy": "privacy-policy", "terms": "terms-of-service", "legal": "legal-notice"}
HEAD = 3000


def classify(name: Column, content: Column) -> Column:
    """struct(role, handle) of a text file: by its name, else by its beginning."""
    head = F.substring(F.coalesce(content, F.lit("")), 1, HEAD)
    answers = [(name.rlike(f"(?iu){k.name}"), k) for k in KINDS] + [(head.rlike(f"(?isu){k.content}"), k) for k in KINDS if k.content]
    made = lambda k: F.struct(F.lit(k.role).alias("role"), F.lit(k.handle).cast("string").alias("handle"))
    out = None
    for told, k in answers:
        out = F.when(told, made(k)) if out is None else out.when(told, made(k))
    return out.otherwise(F.struct(F.lit("page").alias("role"), F.lit("other").alias("handle")))


def pasted_files(files: DataFrame) -> DataFrame:
    """site, name, role, handle, key, result, text of ``files`` (site, name, content:
    bytes). Hidden files are none; of several files for one policy the first by
    name keeps it, the others are pages; a table of products has the role products
    and no text (read it with ``runs.read_export``); null content is an error."""
    seen = files.where(~F.startswith("name", F.lit("."))).withColumn("text", T.decode_any("content"))
    head = F.substring_index("text", "\n", 1)
    table = F.col("name").rlike(CSV_FILE) & F.contains(head, F.lit("Handle")) & F.contains(head, F.lit("Title"))
    readable = F.col("name").rlike(TEXT_FILE)
    kind = F.when(table, F.struct(F.lit("products").alias("role"), F.lit(None).cast("string").alias("handle"))).when(readable, classify(F.col("name"), F.col("text"))).otherwise(
        F.struct(F.lit("skipped").alias("role"), F.lit(None).cast("string").alias("handle"))
    )
    rows = seen.withColumn("kind", kind).select("site", "name", "text", "content", "kind.*")
    again = F.row_number().over(Window.partitionBy("site", "role", "handle").orderBy("name")) > 1
    rows = rows.withColumn("again", again & (F.col("role") == "policy"))
    rows = rows.withColumns({"role": F.when(F.col("again"), "page").otherwise(F.col("role")), "handle": F.when(F.col("again"), "other").otherwise(F.col("handle"))})
    role = F.col("role")
    key = F.when(role == "policy", F.concat(F.lit("policy:"), "handle")).when(role == "home", "homepage").when(role.isin("products", "skipped"), role).otherwise(F.concat(F.lit("page:"), "name"))
    result = F.when(role == "skipped", "skipped").when(F.col("content").isNull(), "error").otherwise("ok")
    return rows.select("site", "name", "role", "handle", key.alias("key"), result.alias("result"), F.when(~role.isin("products", "skipped"), F.coalesce("text", F.lit(""))).alias("text"))


def role_of(link_text: Column, path: Column) -> Column:
    """A page's role by its link's text, else by its path; null when neither tells."""
    said = [(F.coalesce(source, F.lit("")).rlike(f"(?iu){words}"), role) for source in (link_text, path) for role, words in ROLE_WORDS]
    out = None
    for told, role in said:
        out = F.when(told, role) if out is None else out.when(told, role)
    return out


def file_role(path: Column) -> Column:
    """struct(role, policy, page_role, code) of a file of a run kept without its
    index, by where it lies; null for files that are no page."""
    parts, last = F.split(path, "/"), F.substring_index(path, "/", -1)
    first, depth = F.element_at(parts, 1), F.size(parts)
    market = F.when(last == "homepage.html", "market_home").when(last == "product.js", "market_product").otherwise("market_policy")
    known = F.regexp_extract(path, r"^(robots|sitemap|products|meta)\.(txt|xml|json)$", 1)
    role = F.when(path == "homepage.html", "home").when(first == "policies", "policy").when(first == "pdp", "pdp").when((first == "markets") & (depth == 3), market).when(known != "", known).otherwise("page")
    code = F.when((first == "markets") & (depth == 3), F.element_at(parts, 2))
    policy = F.when(role == "policy", F.regexp_replace(last, r"(\.page)?\.(html?|txt|md)$", ""))
    page_role = F.when(role == "page", F.coalesce(role_of(F.lit(""), F.concat(F.lit("/"), path)), F.lit("other")))
    made = F.struct(role.alias("role"), policy.alias("policy"), page_role.alias("page_role"), code.alias("code"))
    return F.when(~F.startswith(path, F.lit("_")) & (path != "pages.json"), made)


def assigned(index: DataFrame) -> DataFrame:
    """site, policy, path, chars: the one file that stands for each policy of a site.

    ``index`` has site, path, role, policy, page_role, text. Policy files go before
    pages of the role; among policy files the longest text counts, among pages the
    first path with any text; a file stands for one policy only, as it has one role.
    """
    stand = F.create_map(*[F.lit(x) for kv in STANDS_FOR.items() for x in kv])
    policy = F.coalesce("policy", F.when(F.col("role") == "page", F.try_element_at(stand, F.col("page_role"))))
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    rows = index.withColumns({"policy": policy, "chars": size}).where("policy is not null and (role = 'policy' or chars > 0)")
    own = F.col("role") == "policy"
    rank = F.struct((~(own & (size > 0))).alias("a"), F.when(own, -size).otherwise(F.lit(0)).alias("b"), F.col("path").alias("c"))
    return rows.groupBy("site", "policy").agg(F.min_by(F.struct("path", "chars"), rank).alias("f")).select("site", "policy", "f.path", F.col("f.chars").cast("long").alias("chars"))
