"""Campaign labels."""

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.temporal import minutes_between
from .ranking import join_on, range_bucket, running


def host_roles(events: DataFrame, scope="scenario", install=None, internal_prefix=S.INTERNAL_PREFIX) -> DataFrame:
    """Distinct hosts of the install phase per scope, marked internal or not."""
    install = F.col("phase") == 4 if install is None else install
    seen = events.where(install)
    hosts = seen.select(scope, F.col("src_ip").alias("host")).union(seen.select(scope, F.col("dst_ip").alias("host")))
    return (hosts.where(F.col("host").isNotNull()).distinct()
            .withColumn("is_internal", F.col("host").startswith(internal_prefix)))


def label_by_hosts(events: DataFrame, scope="scenario", early=None, always=None, install=None,
                   internal_prefix=S.INTERNAL_PREFIX) -> DataFrame:
    """Set ``campaign_id`` and ``is_campaign_link``.

    Late-phase events always belong to the scope's campaign. An early event belongs to it when
    its source or destination is an internal host of the install phase; two equi-joins, since a
    join on "source or destination" would compare every event with every host.
    """
    early = F.col("phase").isin(1, 2, 3) if early is None else early
    always = F.col("phase").isin(4, 5) if always is None else always
    hosts = host_roles(events, scope, install, internal_prefix).where("is_internal").select(scope, "host")
    rows = events.drop("campaign_id", "is_campaign_link")
    for side in ("src_ip", "dst_ip"):
        known = hosts.select(scope, F.col("host").alias(side), F.lit(True).alias(f"_hit_{side}"))
        rows = rows.join(known, [scope, side], "left")
    hit = F.coalesce("_hit_src_ip", "_hit_dst_ip", F.lit(False))
    member = F.coalesce(always | (early & hit), F.lit(False))
    return rows.withColumns({
        "is_campaign_link": member,
        "campaign_id": F.when(member, F.col(scope)).otherwise(F.lit(S.NO_CAMPAIGN)),
    }).drop("_hit_src_ip", "_hit_dst_ip")


def block_spans(events: DataFrame, day="day", block="source_file", ts_col="timestamp") -> DataFrame:
    return events.groupBy(day, block).agg(F.min(ts_col).alias("start"), F.max(ts_col).alias("end"))


def number_campaigns(spans: DataFrame, day="day", block="source_file", gap_minutes=S.CAMPAIGN_GAP_MINUTES,
                     prefix="cicids2017_") -> DataFrame:
    """Merge the blocks of a day whose start is within the gap of everything before them.

    ``spans`` is read several times; it is one row per block, far smaller than the events.
    """
    order = ["start", block]
    place = range_bucket(spans, [day], order)
    seen = running(spans, [day], place, order, F.col("end"), "_seen_end", "max", inclusive=False)
    opens = F.col("_seen_end").isNotNull() & (minutes_between(F.col("_seen_end"), F.col("start")) > gap_minutes)
    flagged = seen.withColumn("_opens", opens.cast("long"))
    numbered = running(flagged, [day], place, order, F.col("_opens"), "campaign_index", "sum", inclusive=True)
    name = F.concat(F.lit(prefix), F.col(day).cast("string"), F.lit("_c"), F.col("campaign_index").cast("string"))
    return numbered.withColumn("campaign_id", name).drop("_seen_end", "_opens")


def label_by_time_gaps(events: DataFrame, day="day", block="source_file", ts_col="timestamp",
                       gap_minutes=S.CAMPAIGN_GAP_MINUTES, prefix="cicids2017_") -> DataFrame:
    named = number_campaigns(block_spans(events, day, block, ts_col), day, block, gap_minutes, prefix)
    return join_on(events.drop("campaign_id"), named.select(day, block, "campaign_id"), [day, block])


def balance(events: DataFrame, scope="scenario") -> DataFrame:
    """Linked and distractor rows per scope; degenerate when one side is empty."""
    table = events.groupBy(scope).agg(
        F.count_if(F.col("is_campaign_link")).alias("n_linked"),
        F.count_if(~F.col("is_campaign_link")).alias("n_distractor"))
    return table.withColumn("degenerate", (F.col("n_linked") == 0) | (F.col("n_distractor") == 0))


def frequency(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
