"""Findings from facts: one row of facts for each site, one finding for each rule.

A rule set is a dimension (id, level, markets, badge, sources, flags) and, for
each id, a verdict: Column expressions over the facts. All verdicts of a site are
built in one projection and exploded, so that a rule set costs no shuffle beyond
the one that gathers the facts. The dimension has one row for each rule (under
a hundred), which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markets

#: Levels from the gravest, results that enter the fix list.
LEVELS = ("P0", "P1", "P2", "P3")
IN_FIX_LIST = ("fail", "manual")
MAX_EVIDENCE, MAX_EVIDENCE_CHARS = 3, 300


class Verdict(NamedTuple):
    """What a rule says of a site; null results mean "not evaluated"."""

    result: Column
    note: Column | None = None
    where: Column | None = None
    evidence: Column | None = None
    level: Column | None = None
    badge: Column | None = None
    same_as: str | None = None


def text_or_null(x: Column | None) -> Column:
    return (x if x is not None else F.lit(None)).cast("string")


def choose(*cases, otherwise) -> Column:
    """First value whose condition holds (a null condition does not)."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) or otherwise is None else F.lit(otherwise))


def dimension(spark: SparkSession, table: str, sources: Mapping[str, bool]) -> DataFrame:
    """Rows "id level markets badge sources flags" (- for none) as a DataFrame
    with the rule's place, and whether it may be graver than the second level:
    all its sources are verified and it is no rule of experience."""
    rows = []
    for place, line in enumerate(x for x in table.strip().splitlines() if x.strip()):
        rid, level, where, badge, src, flags = ([] if p == "-" else p.split(",") for p in line.split())
        top = "p0_ok" in flags or ("exp" not in flags and bool(src) and all(sources.get(s) for s in src))
        rows.append((place, rid[0], level[0], where, badge[0], src, "ads" in flags, "multi" in flags, top))
    return spark.createDataFrame(rows, "place int, rule_id string, rule_level string, markets array<string>, rule_badge string, sources array<string>, needs_ads boolean, needs_multi boolean, top_ok boolean")


def demote(level: Column) -> Column:
    """One level less grave, the last stays."""
    out = level
    for now, after in zip(LEVELS, LEVELS[1:]):
        out = F.when(level == now, after).otherwise(out)
    return out


def trim_evidence(x: Column | None) -> Column:
    none = F.array().cast("array<string>")
    if x is None:
        return none
    kept = F.filter(F.coalesce(x, none), lambda e: e.isNotNull() & (e != ""))
    return F.slice(F.transform(kept, lambda e: F.substring(F.trim(F.regexp_replace(e, r"\s+", " ")), 1, MAX_EVIDENCE_CHARS)), 1, MAX_EVIDENCE)


def evaluate(facts: DataFrame, verdicts: Mapping[str, Verdict], rules: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """keys, rule_id, result, level, badge, where, evidence, note, same_as of
    every rule of the dimension.

    ``facts`` has ``tokens`` (rule tokens of the targeted markets), ``ads``,
    ``multi`` and ``paste``, and ``unread``: a note when nothing could be judged.
    A rule without a verdict, or with a null result, is unknown.
    """
    made = [
        F.struct(
            F.lit(rid).alias("rule_id"), v.result.cast("string").alias("result"), text_or_null(v.note).alias("note"), text_or_null(v.where).alias("where"),
            trim_evidence(v.evidence).alias("evidence"), text_or_null(v.level).alias("own_level"), text_or_null(v.badge).alias("own_badge"), F.lit(v.same_as).cast("string").alias("same_as"),
        )
        for rid, v in verdicts.items()
    ]
    k = list(keys)
    said = facts.select(*k, "tokens", "ads", "multi", "paste", "unread", F.explode(F.array(*made)).alias("v")).select(*k, "tokens", "ads", "multi", "paste", "unread", "v.*")
    rows = said.join(F.broadcast(rules), "rule_id")
    return settle(rows, k)


def settle(rows: DataFrame, k: list[str]) -> DataFrame:
    """Applicability, level and badge of recorded verdicts joined to their rules."""
    judged = F.col("result").isin("fail", "manual", "pass", "unknown")
    gate = choose(
        (F.col("needs_ads") & ~F.col("ads"), "no_ads"), (~markets.applies(F.col("markets"), F.col("tokens")), "market_not_targeted"),
        (F.col("needs_multi") & ~F.col("multi"), "single_market"), otherwise=None,
    )
    none = F.col("result").isNull()
    rows = rows.withColumn("gate", F.when(judged, gate))
    result = F.when(none, "unknown").when(F.col("gate").isNotNull(), "skip").otherwise(F.col("result"))
    note = F.when(none, F.coalesce("note", "unread", F.lit("not_evaluated"))).otherwise(F.coalesce("gate", "note"))
    level = F.coalesce("own_level", "rule_level")
    level = F.when(none, F.col("rule_level")).when((level == LEVELS[0]) & ~F.col("top_ok"), demote(level)).otherwise(level)
    rows = rows.withColumns({"level": level, "fact": F.when(F.col("paste"), "self_claim").otherwise("verified")}).withColumns({"result": result, "note": note})
    want = F.col("rule_badge")
    usual = choose(
        (F.col("result") == "unknown", "not_found"), (F.col("result").isin("skip", "same", "info"), F.lit(None)), ((want == "verified") & F.col("paste"), "self_claim"),
        ((want == "conflicting") & (F.col("result") != "fail"), F.col("fact")),
        (want.isin("inferred", "not_found"), F.when(F.col("result") != "pass", "inferred").otherwise(F.col("fact"))), otherwise=want,
    )
    return rows.select(*k, "place", "rule_id", "result", "level", F.coalesce("own_badge", usual).alias("badge"), "where", "evidence", "note", "same_as", "sources")


def reviewed(findings: DataFrame, dropped: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Findings with those of ``dropped`` (keys, rule_id) set to pass after a
    person's review."""
    k = [*keys, "rule_id"]
    marked = findings.join(dropped.select(*k).distinct().withColumn("_hit", F.lit(True)), k, "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("result").isin(*IN_FIX_LIST)
    out = marked.withColumns({"note": F.when(hit, "agent_reviewed").otherwise(F.col("note")), "result": F.when(hit, "pass").otherwise(F.col("result"))})
    return out.select(*findings.columns)


def fix_list(findings: DataFrame) -> DataFrame:
    """What has to be done, with its rank: gravest level first, then the rule's place."""
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return findings.where(F.col("result").isin(*IN_FIX_LIST)).withColumn("ord", level * 1000 + F.col("place"))


def verdict(findings: DataFrame, status: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """keys, n_p0 .. n_p3 (in the fix list) and the verdict: go without a failed
    P0, fix_p0 with one or two, else hold; null for a failed run or a bare
    password page. ``status`` has the keys and the run's status."""
    listed = F.col("result").isin(*IN_FIX_LIST)
    counts = findings.groupBy(*keys).agg(
        *[F.count_if(listed & (F.col("level") == x)).alias(f"n_{x.lower()}") for x in LEVELS],
        F.count_if((F.col("result") == "fail") & (F.col("level") == "P0")).alias("_p0"), F.count_if(F.col("result") == "fail").alias("_fails"),
        F.bool_or((F.col("rule_id") == "TRU-05") & (F.col("result") == "manual")).alias("_password"),
    )
    said = choose(
        ((F.col("status") == "failed") | (F.col("_password") & (F.col("_fails") == 0)), F.lit(None)), (F.col("_p0") == 0, "go"), (F.col("_p0") <= 2, "fix_p0"), otherwise="hold"
    )
    return status.join(counts, list(keys), "left").select(*keys, "status", *[f"n_{x.lower()}" for x in LEVELS], said.alias("verdict"))
