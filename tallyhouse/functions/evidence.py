"""Evidence labels: how far a statement can be trusted, weakest link first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Badge, strength (0 weakest), in display order.
BADGES = (
    ("verified", 4), ("self_claim", 3), ("third_party", 2), ("on_page", 3), ("inferred", 1), ("conflicting", 0), ("not_found", 0),
    ("user_input", 2),
)
#: Evidence level, the safest badge it supports.
LEVELS = (("E1", "verified"), ("E2", "self_claim"), ("E3", "verified"), ("E4", "verified"), ("E5", "third_party"), ("E6", "inferred"))
#: Other spellings of badges.
ALIASES = {"page_shown": "on_page", "store_claim": "self_claim", "conflict": "conflicting"}
STATUSES = ("complete", "partial", "failed")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def badge_key(x) -> Column:
    """Canonical badge, null when unknown."""
    t = F.lower(F.trim(_col(x), F.lit("[] ")))
    t = reduce(lambda c, kv: F.when(t == kv[0], F.lit(kv[1])).otherwise(c), ALIASES.items(), t)
    return F.when(t.isin(*[b for b, _ in BADGES]), t)


def badge_rank(x) -> Column:
    """Order from weakest: strength, then display order."""
    key = badge_key(x)
    out = F.lit(None).cast("int")
    for i, (b, strength) in enumerate(BADGES):
        out = F.when(key == b, F.lit(strength * 100 + i)).otherwise(out)
    return out


def weakest(x) -> Column:
    """Aggregate: the weakest badge of a group, null without any."""
    return F.min_by(badge_key(x), badge_rank(x))


def weakest_of(badges) -> Column:
    """The weakest badge of an array."""
    ranked = F.filter(F.transform(_col(badges), lambda b: F.struct(badge_rank(b).alias("r"), badge_key(b).alias("b"))), lambda s: s["r"].isNotNull())
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["b"]


def badge_for_level(level) -> Column:
    t = F.upper(_col(level).cast("string"))
    return reduce(lambda c, kv: F.when(t == kv[0], F.lit(kv[1])).otherwise(c), LEVELS, F.lit(None).cast("string"))


def combine_status(x) -> Column:
    """Aggregate: all failed is failed, all complete is complete, else partial;
    null when no part is known."""
    s = F.when(_col(x).isin(*STATUSES), _col(x))
    return (
        F.when(F.count(s) == 0, F.lit(None).cast("string"))
        .when(F.bool_and(s == "failed"), "failed")
        .when(F.bool_and(s == "complete"), "complete")
        .otherwise("partial")
    )


def badge_dimension(spark: SparkSession) -> DataFrame:
    rows = [(b, s, i) for i, (b, s) in enumerate(BADGES)]
    return spark.createDataFrame(rows, "badge string, strength int, display int")
