"""Joins with indicators and assets, and risk by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.text import tokens
from tailrace.io import host_key, small

# The lower bounds of risk bands.
BANDS = ((75, "critical"), (50, "high"), (25, "medium"))


def indicator_key(value: Column) -> Column:
    """Indicator values as they are compared: lower case, without outer blanks."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def indicators(ioc: DataFrame) -> DataFrame:
    """One row for each value: (ioc_key, confidence, n_reports), the highest confidence counting."""
    return ioc.select(indicator_key(F.col("ioc_value")).alias("ioc_key"), "confidence").filter("ioc_key is not null").groupBy("ioc_key").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_reports"))


def matches(events: DataFrame, ioc: DataFrame, id_col: str = "_id", raw: str = "_raw") -> DataFrame:
    """(id_col, ioc_key, confidence): indicators that are tokens of an event's text.

    Indicators are broadcast only if they are few by count; else both sides are
    shuffled by token.
    """
    seen = events.select(id_col, F.explode(F.array_distinct(tokens(F.col(raw)))).alias("ioc_key"))
    return seen.join(small(indicators(ioc)), "ioc_key").select(id_col, "ioc_key", "confidence")


def with_matches(events: DataFrame, ioc: DataFrame, column: str) -> DataFrame:
    """Events whose ``column`` is an indicator."""
    keys = small(indicators(ioc).select(F.col("ioc_key").alias("__k")))
    return events.withColumn("__k", indicator_key(F.col(column))).join(keys, "__k", "left_semi").drop("__k")


def with_assets(events: DataFrame, assets: DataFrame, host: str = "host", columns: tuple[str, ...] = ("asset_id", "criticality", "business_unit", "location")) -> DataFrame:
    """``events`` with what is known of their host; hosts are compared as host names
    are.  If several assets have a name, that with the least asset_id counts."""
    named = assets.withColumn("__h", host_key(F.col("hostname"))).filter("__h is not null")
    one = named.groupBy("__h").agg(F.min_by(F.struct(*[F.col(c).alias(f"asset_{c}" if c in events.columns else c) for c in columns]), F.coalesce("asset_id", F.lit(""))).alias("__a"))
    return events.withColumn("__h", host_key(F.col(host))).join(small(one), "__h", "left").select("*", "__a.*").drop("__h", "__a")


def risk(notables: DataFrame, entity: str = "host") -> DataFrame:
    """(entity, risk, n_rules, band): the sum of risk scores by entity, findings without one left out."""
    sums = notables.filter(F.col(entity) != "").groupBy(F.col(entity).alias("entity")).agg(F.coalesce(F.sum("risk_score"), F.lit(0)).cast("bigint").alias("risk"), F.count_distinct("rule_id").alias("n_rules"))
    return sums.withColumn("band", band(F.col("risk")))


def band(score: Column) -> Column:
    chain = F.when(score > BANDS[0][0], BANDS[0][1])
    for bound, name in BANDS[1:]:
        chain = chain.when(score > bound, name)
    return chain.otherwise("low")


def success_after_failures(events: DataFrame, failed: Column, accepted: Column, by: list[str], time: str = "_time", within: str = "1 hour", least: int = 3, id_col: str = "_id") -> DataFrame:
    """Accepted logins with at least ``least`` refused ones of the same ``by`` in the
    time before (``n_refused``); ``id_col`` tells events apart, null ``by`` are left out.

    Refused ones are counted up in slots of ``within``; an accepted one is looked up
    where it is and that long before, so a slot's events are read in order once and
    no list of them is kept.
    """
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {within}"))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    known = events.filter(F.col(time).isNotNull())
    for k in by:
        known = known.filter(F.col(k).isNotNull())
    slot = lambda c: F.floor(c / width).cast("bigint").alias("__slot")
    mark = lambda rows, c, kind: rows.select(*by, F.col(id_col).alias("__id"), c.alias("__at"), slot(c), F.lit(kind).alias("__kind"))
    bad, good = known.filter(F.coalesce(failed, F.lit(False))), known.filter(F.coalesce(accepted, F.lit(False)))
    marks = mark(bad, at, 0).unionByName(mark(good, at, 1)).unionByName(mark(good, at - width, 2))
    group = Window.partitionBy(*by, "__slot")
    is_bad = (F.col("__kind") == 0).cast("bigint")
    earlier = F.coalesce(F.sum(is_bad).over(group.orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = marks.withColumn("__before", earlier).withColumn("__all", F.sum(is_bad).over(group)).filter("__kind > 0")
    n = F.sum(F.when(F.col("__kind") == 1, F.col("__before")).otherwise(F.col("__all") - F.col("__before")))
    enough = counted.groupBy("__id").agg(n.cast("int").alias("n_refused")).filter(F.col("n_refused") >= least)
    return good.join(enough, good[id_col] == enough["__id"]).drop("__id")


def with_identities(events: DataFrame, identities: DataFrame, user: str = "user", columns: tuple[str, ...] = ("full_name", "department", "priority", "risk_score")) -> DataFrame:
    """``events`` with what is known of their user, by name or mail address, letter case
    and outer blanks disregarded; of several identities that with the least username."""
    named = identities.select("*", F.explode(F.array_distinct(F.array(indicator_key(F.col("username")), indicator_key(F.col("email"))))).alias("__u")).filter("__u is not null")
    one = named.groupBy("__u").agg(F.min_by(F.struct(*[F.col(c).alias(f"identity_{c}" if c in events.columns else c) for c in columns]), F.coalesce("username", F.lit(""))).alias("__i"))
    return events.withColumn("__u", indicator_key(F.col(user))).join(small(one), "__u", "left").select("*", "__i.*").drop("__u", "__i")
