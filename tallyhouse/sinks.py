"""Tables for people and programs: CSV that spreadsheets open safely, JSON lines,
and the shapes of the reports' tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import money

#: Files start with it, so that spreadsheets read them as UTF-8.
BYTE_ORDER_MARK = "﻿"
PRICE_EVENTS = ("price_sitewide_shift", "price_down", "price_up", "promo_started", "promo_ended", "discount_deeper", "discount_shallower", "compare_at_raised")
PRODUCT_EVENTS = ("product_added", "product_removed", "sold_out", "restocked", "variant_added", "variant_removed", "product_republished", "product_handle_changed", "product_relisted", "product_surfaced", "product_missing_unconfirmed")


def safe_cells(df: DataFrame) -> DataFrame:
    """All columns as text that no spreadsheet takes for a formula."""
    return df.select(*[money.csv_safe(money.cell_text(F.col(f"`{c}`"))).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, order: tuple[str | Column, ...] = ()) -> None:
    """CSV with a header and a byte-order mark in every file. With ``order`` the
    files are sorted by range, so that they read on in the order of their names."""
    rows = df.orderBy(*order) if order else df
    cells = safe_cells(rows)
    cells = cells.withColumnRenamed(cells.columns[0], BYTE_ORDER_MARK + cells.columns[0])
    cells.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_csvs(tables: Mapping[str, DataFrame | None], path: str) -> list[str]:
    """Several tables, each in a folder of its name; those that are None are
    left out. The names written."""
    done = []
    for name, df in tables.items():
        if df is not None:
            write_csv(df, f"{path.rstrip('/')}/{name}")
            done.append(name)
    return done


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_outputs(summary: DataFrame, rows: DataFrame, evidence: DataFrame, path: str) -> None:
    """Summary and evidence as JSON lines, product rows as tab-separated cells."""
    write_jsonl(summary, f"{path}/summary")
    cells = rows.select(*[money.tsv_cell(F.col(f"`{c}`")).alias(c) for c in rows.columns])
    cells.write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").csv(f"{path}/products")
    write_jsonl(evidence, f"{path}/evidence")


def product_table(rows: DataFrame, yes: str = "yes", no: str = "no") -> DataFrame:
    """Product rows for people: a date for the time of creation (or, without one,
    of publication), words for availability."""
    made = F.substring(F.coalesce(F.nullif(F.col("created_at"), F.lit("")), F.col("published_at")), 1, 10)
    kept = [c for c in rows.columns if c not in ("created_at", "published_at", "available")]
    return rows.select(*kept, made.alias("created"), F.when(F.col("available"), yes).when(~F.col("available"), no).otherwise("").alias("available"))


def event_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Change events as three tables: products, prices, other."""
    kind = F.col("type")
    return {
        "products": events.where(kind.isin(*PRODUCT_EVENTS)), "prices": events.where(kind.isin(*PRICE_EVENTS)), "other": events.where(~kind.isin(*PRODUCT_EVENTS, *PRICE_EVENTS)),
    }


def fee_table(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Costs and, for each site that could be computed, a row with their totals."""
    yearly = (F.col("monthly") * 12).cast("decimal(18,2)")
    rows = items.select("site", "route", "item", "pct", "share", "monthly", yearly.alias("yearly"), "source_id", "status")
    none = F.lit(None)
    sums = totals.where("status <> 'not_computed'").select(
        "site", F.lit("total").alias("route"), F.lit("").alias("item"), none.cast("decimal(18,6)").alias("pct"), none.cast("decimal(18,6)").alias("share"), F.col("monthly_total").alias("monthly"),
        F.col("yearly_total").alias("yearly"), none.cast("string").alias("source_id"), F.lit("").alias("status"),
    )
    return rows.unionByName(sums)


def fix_table(findings: DataFrame) -> DataFrame:
    """Issues by severity and then what is unknown, with the place of each."""
    return findings.where("fix_rank is not null").select(*[c for c in findings.columns if c not in ("place",)]).orderBy("fix_rank", "rule_id")
