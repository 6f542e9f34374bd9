"""Deterministic samples of a catalogue: spread, price roles, as-of picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import NOT_A_PRODUCT


def spread_sample(rows: DataFrame, n: int, order: list, handle: str = "handle", keys: tuple[str, ...] = ()) -> DataFrame:
    """n rows evenly spaced by ``order``, add-ons left out; all when fewer."""
    pool = rows.where((F.col(handle) != "") & ~F.col(handle).rlike(NOT_A_PRODUCT))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    pool = pool.withColumns({"_i": F.row_number().over(by.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(by)})
    step = F.col("_n") / F.lit(float(n))
    # the k-th pick is row int(k*step + step/2): invert it for the row's k
    k = F.floor(F.col("_i") / step)
    hit = lambda j: (F.floor(j * step + step / 2) == F.col("_i")) & (j >= 0) & (j < n)
    return pool.where((F.col("_n") <= n) | hit(k) | hit(k - 1) | hit(k + 1)).drop("_i", "_n")


def price_roles(pool: DataFrame, keys: tuple[str, ...] = ("site",), rank_col: str = "best_rank") -> DataFrame:
    """premium (dearest), main (best-selling between p25 and p75, else nearest
    the median) and entry (nearest p25) of the real products (handle, price,
    in_stock, best_rank or null); distinct handles; only products in stock
    when there are at least three."""
    k = list(keys)
    counted = pool.groupBy(*k).agg(F.count_if("in_stock").alias("_stocked"))
    base = pool.join(counted, k).where((F.col("_stocked") < 3) | F.col("in_stock"))
    stats = base.groupBy(*k).agg(F.percentile("price", 0.25).alias("p25"), F.percentile("price", 0.5).alias("med"), F.percentile("price", 0.75).alias("p75"))
    rank = F.coalesce(F.col(rank_col).cast("double"), F.lit(1e9))
    joined = base.join(stats, k).withColumns({"_rank": rank, "basis_pool": F.when(F.col("_stocked") >= 3, "in_stock_real_products").otherwise("all_real_products")})
    picked = F.struct("handle", "price")
    top = joined.groupBy(*k).agg(F.min_by(picked, F.struct(-F.col("price"), "_rank", "handle")).alias("premium"))
    rest = joined.join(top, k).where(F.col("handle") != F.col("premium.handle"))
    banded = (F.col("_rank") < 1e9) & F.col("price").between(F.col("p25"), F.col("p75"))
    order = F.struct(F.when(banded, 0).otherwise(1), F.when(banded, F.col("_rank")).otherwise(F.abs(F.col("price") - F.col("med"))), "_rank", "handle")
    main = rest.groupBy(*k).agg(F.min_by(picked, order).alias("main"), F.bool_or(banded).alias("main_banded"))
    rest2 = rest.join(main, k).where(F.col("handle") != F.col("main.handle"))
    entry = rest2.groupBy(*k).agg(F.min_by(picked, F.struct(F.abs(F.col("price") - F.col("p25")), "_rank", "price", "handle")).alias("entry"))
    wide = stats.join(joined.groupBy(*k).agg(F.first("basis_pool").alias("basis_pool")), k).join(top, k, "left").join(main, k, "left").join(entry, k, "left")
    line = lambda role, item, basis, value: F.struct(F.lit(role).alias("role"), item["handle"].alias("handle"), item["price"].alias("price"), basis.alias("basis"), value.alias("basis_value"))
    roles = F.array(
        line("entry", F.col("entry"), F.lit("closest_to_p25"), F.col("p25")),
        line("main", F.col("main"), F.when(F.col("main_banded"), "best_selling_in_p25_p75").otherwise("closest_to_median"), F.col("med")),
        line("premium", F.col("premium"), F.lit("max"), F.col("premium.price")),
    )
    out = wide.select(*k, "basis_pool", F.explode(roles).alias("r")).select(*k, "r.*", "basis_pool")
    return out.where("handle is not null").withColumn("basis_value", F.round("basis_value", 2))


def quarter_picks(rows: DataFrame, price: str, keys: tuple[str, ...] = ("site",), tie: str = "handle") -> DataFrame:
    """Dearest, middle and lower-quarter item by rank, each item once."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_i": F.row_number().over(by.orderBy(price, tie)) - 1, "_n": F.count(F.lit(1)).over(by)})
    role = F.when(F.col("_i") == F.col("_n") - 1, "dearest").when(F.col("_i") == F.floor(F.col("_n") / 2), "middle").when(F.col("_i") == F.floor(F.col("_n") / 4), "quarter")
    return ranked.withColumn("role", role).where("role is not null").drop("_i", "_n")


def cheapest_middle_dearest(rows: DataFrame, price: str, keys: tuple[str, ...] = ("site",), tie: str = "handle") -> DataFrame:
    by = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_i": F.row_number().over(by.orderBy(price, tie)) - 1, "_n": F.count(F.lit(1)).over(by)})
    role = F.when(F.col("_i") == 0, "cheapest").when(F.col("_i") == F.col("_n") - 1, "dearest").when(F.col("_i") == F.floor(F.col("_n") / 2), "middle")
    return ranked.withColumn("role", role).where("role is not null").drop("_i", "_n")


def pick_collection(collections: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """First collection that is not ``all`` and not known to be empty."""
    good = collections.where("handle is not null and handle not in ('', 'all') and coalesce(products_count, 1) > 0")
    return good.groupBy(*keys).agg(F.min_by("handle", "pos").alias("handle"))


def best_sellers(links: DataFrame, handle: str = "handle", pos: str = "pos", n: int = 10, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """First n distinct handles in page order."""
    first = links.groupBy(*keys, handle).agg(F.min(pos).alias(pos))
    return first.withColumn("best_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1).where(F.col("best_rank") < n)


def snapshot_pairs(snaps: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """For each snapshot the earlier one to compare with: the latest complete one,
    else the latest partial one, else the latest. One sort by time for each site
    and a running maximum; snapshots of the same time do not see each other."""
    rank = F.when(F.col("status") == "complete", 0).when(F.col("status") == "partial", 1).otherwise(2)
    before = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col("captured_at_utc").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct((-rank).alias("r"), "captured_at_utc", "snapshot_id")).over(before)
    return snaps.select(*keys, F.col("snapshot_id").alias("to_id"), best["snapshot_id"].alias("from_id")).where("from_id is not null")


def nearest(rows: DataFrame, target: Column, ts: str = "captured", payload: str = "stamp", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Row nearest in time, the earlier text on ties."""
    gap = F.abs(F.unix_timestamp(F.col(ts)) - F.unix_timestamp(target))
    return rows.groupBy(*keys).agg(F.min_by(payload, F.struct(gap, payload)).alias(payload))


def retention(snaps: DataFrame, keep: int, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Snapshots whose raw files may be packed: all but the first and the last
    ``keep`` of each site."""
    by = Window.partitionBy(*keys)
    n = snaps.withColumns({"_a": F.row_number().over(by.orderBy("captured_at_utc", "snapshot_id")), "_d": F.row_number().over(by.orderBy(F.desc("captured_at_utc"), F.desc("snapshot_id")))})
    return n.where((F.col("_a") > 1) & (F.col("_d") > keep)).drop("_a", "_d")


#: The form of a snapshot id: day, number, suffix.
SNAPSHOT_ID = r"^(\d{4}-\d{2}-\d{2})(?:_(\d+))?(-archive|-teardown)?$"


def snapshot_order(snapshot_id: Column) -> Column:
    """struct(day, number, id) that orders snapshot ids; other names come last."""
    day, n = F.regexp_extract(snapshot_id, SNAPSHOT_ID, 1), F.regexp_extract(snapshot_id, SNAPSHOT_ID, 2)
    known = snapshot_id.rlike(SNAPSHOT_ID)
    number = F.when(known, F.coalesce(F.nullif(n, F.lit("")).try_cast("int"), F.lit(1))).otherwise(0)
    return F.struct(F.when(known, day).otherwise("9999").alias("day"), number.alias("number"), snapshot_id.alias("id"))


def list_snapshots(snaps: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Snapshots with their place, oldest first by capture time or, without one,
    by the day of their id; hidden and partial ones are left out."""
    shown = snaps.where(~F.startswith("snapshot_id", F.lit(".")) & ~F.endswith("snapshot_id", F.lit(".partial")))
    order = snapshot_order(F.col("snapshot_id"))
    at = F.coalesce(F.col("captured_at_utc").cast("string"), order["day"])
    return shown.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(at, order)))


def next_snapshot_id(snaps: DataFrame, day: str, suffix: str = "", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """DAY, DAY_2, DAY_3 ... and the suffix: the first id of a day not in use."""
    own = F.regexp_extract("snapshot_id", rf"^{day}(?:_(\d+))?{suffix}$", 1)
    number = F.when(F.col("snapshot_id") == day + suffix, F.lit(1)).when(own != "", own.try_cast("int"))
    used = snaps.groupBy(*keys).agg(F.collect_set(number).alias("_used"))
    free = F.element_at(F.array_except(F.sequence(F.lit(1), F.size("_used") + 1), F.col("_used")), 1)
    return used.select(*keys, F.concat(F.lit(day), F.when(free == 1, "").otherwise(F.concat(F.lit("_"), free.cast("string"))), F.lit(suffix)).alias("next_id"))


def snapshot_index(snaps: DataFrame, earlier: DataFrame | None = None, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row for each site: its snapshots in order, first, last and number;
    reports and cadence of an earlier index stay."""
    listed = list_snapshots(snaps, keys)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "snapshot_id"))), lambda x: x["snapshot_id"])
    out = listed.groupBy(*keys).agg(ids.alias("snapshots")).select(*keys, "snapshots", F.element_at("snapshots", 1).alias("first_id"), F.element_at("snapshots", -1).alias("last_id"), F.size("snapshots").cast("long").alias("n"))
    return out.join(earlier.select(*keys, "report", "next_due", "cadence"), list(keys), "left") if earlier is not None else out


def runs_of_ids(rows: DataFrame, prefix: str, number: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive numbers as runs: A2, A5-A7 (gaps and islands)."""
    by = Window.partitionBy(*keys, prefix).orderBy(number)
    isles = rows.select(*keys, prefix, number).distinct().withColumn("_g", F.col(number) - F.row_number().over(by))
    out = isles.groupBy(*keys, prefix, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last"))
    text = F.when(F.col("first") == F.col("last"), F.concat(prefix, F.col("first").cast("string"))).otherwise(F.concat(F.col(prefix), F.col("first").cast("string"), F.lit("-"), F.col(prefix), F.col("last").cast("string")))
    return out.withColumn("run", text).drop("_g")
