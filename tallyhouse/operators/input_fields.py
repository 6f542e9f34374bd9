"""Rows of input sheets to fields: names by a dictionary of synonyms, values by the
kind of their field. Names nobody knows and values of a wrong kind stay, as rows
with an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money

#: Fixed value: what a name is compared without.
PUNCTUATION = r"[\s():/_\-.（）：]+"
EU_MARKET = r"^EU-[A-Z]{2}$"


def norm(name) -> Column:
    """The form in which names are compared."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), PUNCTUATION, "")


def synonyms(names: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``names`` (keys, name, ord) by their compared form; the first of equal ones
    counts."""
    named = names.withColumn("_norm", norm("name")).where("_norm <> ''")
    return named.groupBy(*([k for k in keys if k == "field"]), "_norm").agg(*[F.min_by(k, "ord").alias(k) for k in keys if k != "field"])


def read_fields(rows: DataFrame, fields: DataFrame, choices: DataFrame) -> DataFrame:
    """``rows`` (product, line, item, value) with key, kind, number, choice, issue.

    ``fields`` (key, kind, name, ord) names each field by all its names; kinds are
    number, money, pct, count, choice, market, currency and text. ``choices`` (field,
    choice, name, ord) has the accepted values of each choice field by all their
    names, those of markets and currencies under the fields market and currency.
    Both are dictionaries of some hundreds of names, which bounds what is
    broadcast. A null or blank value is missing, which is no issue; the issue of an
    unknown name is unknown_field.
    """
    known = F.broadcast(synonyms(fields, ("key", "kind")))
    meant = F.broadcast(synonyms(choices, ("field", "choice"))).withColumnRenamed("_norm", "_value")
    named = rows.withColumn("_norm", norm("item")).join(known, "_norm", "left")
    kind, blank = F.col("kind"), F.trim(F.coalesce("value", F.lit(""))) == ""
    named = named.withColumns({"field": F.when(kind.isin("market", "currency"), kind).otherwise(F.col("key")), "_value": norm("value")})
    out = named.join(meant, ["field", "_value"], "left")
    upper = F.upper(F.trim("value"))
    choice = F.when(kind.isin("choice", "market", "currency"), F.coalesce("choice", F.when((kind == "market") & upper.rlike(EU_MARKET), upper)))
    number = F.when(kind.isin("number", "money", "pct", "count"), money.parse_number("value")["value"])
    out = out.withColumns({"number": number, "choice": choice})
    wrong = (
        F.when(F.col("key").isNull(), "unknown_field").when(blank, F.lit(None)).when(kind.isin("number", "money", "pct", "count") & F.col("number").isNull(), "not_a_number")
        .when(kind.isin("choice", "market", "currency") & F.col("choice").isNull(), "unknown_value").when((kind == "pct") & ~F.col("number").between(0, 100), "percent_range")
        .when(kind.isin("money", "number", "count") & (F.col("number") < 0), "negative").when((kind == "count") & (F.col("number") != F.floor("number")), "not_whole")
    )
    return out.select(*rows.columns, "key", "kind", "number", "choice", wrong.alias("issue"))
