"""JSON that may be wrapped in prose, cut off or replaced by a block page.

``states`` decides with JVM functions alone wherever the text is whole; only what
does not parse goes through the Arrow function that looks for an embedded
document or salvages the complete items of a cut-off array.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_blocked

RECOVERED = "struct<state:string,json:string,items:int>"


def recover(salvage_key: str | None):
    """Arrow function: state, JSON text and number of salvaged items."""

    def one(text: str | None, decoder: json.JSONDecoder):
        if text is None:
            return {"state": "missing", "json": None, "items": None}
        t = text.strip()
        if not t:
            return {"state": "error", "json": None, "items": None}
        start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
        if start >= 0:
            try:
                value, end = decoder.raw_decode(t, start)
                whole = start == 0 and not t[end:].strip()
                if whole or not salvage_key or (isinstance(value, dict) and salvage_key in value):
                    return {"state": "ok" if whole else "extracted", "json": json.dumps(value, ensure_ascii=False), "items": None}
            except ValueError:
                pass
        if salvage_key and (m := re.search(rf'"{re.escape(salvage_key)}"\s*:\s*\[', t)):
            at, items = m.end(), []
            while True:
                while at < len(t) and t[at] in " \t\r\n,":
                    at += 1
                try:
                    value, at = decoder.raw_decode(t, at)
                except ValueError:
                    break
                items.append(value)
            return {"state": "salvaged", "json": json.dumps({salvage_key: items}, ensure_ascii=False), "items": len(items)}
        low = t[:20000].lower()
        html = low.startswith(("<!doctype", "<html")) or any(m in low for m in ("just a moment...", "cf-chl", "captcha", "access denied"))
        return {"state": "blocked" if html else "error", "json": None, "items": None}

    @F.pandas_udf(RECOVERED)
    def run(text: pd.Series) -> pd.DataFrame:
        decoder = json.JSONDecoder()  # it cannot be sent to the executors
        return pd.DataFrame([one(t, decoder) for t in text], columns=["state", "json", "items"])

    return run


def states(files: DataFrame, text_col: str = "content", salvage_key: str | None = None) -> DataFrame:
    """``files`` with state (ok, extracted, salvaged, blocked, error, missing),
    json and salvaged_items."""
    text = F.col(text_col)
    marked = files.withColumn("_ok", F.try_parse_json(text).isNotNull())
    good = marked.where("_ok").select(*files.columns, F.lit("ok").alias("state"), F.trim(text).alias("json"), F.lit(None).cast("int").alias("salvaged_items"))
    found = recover(salvage_key)(text)
    rest = marked.where("not _ok").withColumn("_r", found).select(*files.columns, "_r.state", "_r.json", F.col("_r.items").alias("salvaged_items"))
    return good.unionByName(rest)


def warnings(parsed: DataFrame, file_col: str = "file") -> DataFrame:
    """file, level, message rows for everything that did not parse as it was."""
    level = F.when(F.col("state").isin("extracted", "salvaged"), "warning").when(F.col("state").isin("blocked", "error"), "error")
    said = F.when(F.col("state") == "extracted", F.lit("document taken out of other text")).when(
        F.col("state") == "salvaged", F.format_string("cut off, kept %d whole items", "salvaged_items")
    ).when(F.col("state") == "blocked", F.lit("a block page in place of data")).otherwise(F.lit("cannot be read"))
    return parsed.select(F.col(file_col).alias("file"), level.alias("level"), said.alias("message")).where("level is not null")


def classify_response(kind: str = "json"):
    """Column of ok, not_found, blocked or error from http_status and body."""
    status, body = F.col("http_status"), F.coalesce(F.col("body"), F.lit(""))
    is_json = F.is_variant_null(F.try_parse_json(F.trim(body))).isNotNull()
    html = F.lower(F.trim(F.substring(body, 1, 2000))).rlike(r"^(<!doctype|<html)")
    out = (
        F.when(status == 404, "not_found").when(status.isin(401, 403, 429, 430), "blocked").when(status.isNull() | (status >= 400), "error")
        .when(F.trim(body) == "", "error")
    )
    if kind == "json":
        out = out.when(html, "blocked").when(~F.coalesce(is_json, F.lit(False)), "error")
    else:
        out = out.when((F.length(body) < 30000) & looks_blocked(body) & ~F.contains(F.lower(body), F.lit("shopify")), "blocked")
    return out.otherwise("ok")
