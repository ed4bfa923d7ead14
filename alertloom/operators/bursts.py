"""Collapse high-volume groups into one row per time bin."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.temporal import bin_number, epoch_micros, floor_to_bin
from ..functions.text import multi_marker
from ..session import cut_lineage
from .ranking import join_on, number_rows


def volume_log(df: DataFrame, group_cols, threshold=S.BURST_THRESHOLD, bin_seconds=S.BURST_BIN_SECONDS) -> DataFrame:
    """Groups with more than ``threshold`` rows."""
    return (df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("raw_rows"))
            .where(F.col("raw_rows") > threshold)
            .withColumn("bin_seconds", F.lit(bin_seconds).cast("long")))


class BurstRules:
    """How the rows of a large group become one row per time bin.

    The bin keeps its dominant source and a ``MULTI`` marker for the destinations, or the
    mirror image when it has fewer destinations than sources. Other columns come from the
    bin's first row. ``null_cols`` are emptied, ``mode_cols`` take their most frequent value,
    ``bin_id(ordinal)`` builds a new id from the bin's position in its group.

    Rows are counted into cells of (bin, column, value), in one shuffle for all voted columns; the cell of no column
    carries what concerns the bin as a whole. Cells of disjoint rows add up, so a stream can count batch by batch.
    A flood with millions of addresses in one bin is spread over its values. Counting needs numbers only, so Spark hashes
    and no task sorts its rows; whole rows are carried for those that may be a bin's first.
    """

    def __init__(self, schema, group_cols, bin_seconds=S.BURST_BIN_SECONDS, ts_col="timestamp", src_col="src_ip",
                 dst_col="dst_ip", id_col="event_id", null_cols=(), mode_cols=(), bin_id=None):
        self.schema, self.group_cols, self.bin_seconds = schema, list(group_cols), bin_seconds
        self.ts_col, self.src_col, self.dst_col, self.id_col = ts_col, src_col, dst_col, id_col
        self.null_cols, self.mode_cols, self.bin_id = null_cols, mode_cols, bin_id
        self.columns = schema.fieldNames()
        self.has_link = "is_campaign_link" in self.columns
        self.has_campaign = self.has_link and "campaign_id" in self.columns
        self.has_prediction = "predicted_attack_type" in self.columns
        self.voted = [src_col, dst_col, *mode_cols] + (["predicted_attack_type"] if self.has_prediction else [])
        self.keys = ["_bin", *self.group_cols]  # sorts by a number first

    def cells(self, rows: DataFrame) -> DataFrame:
        """``(*keys, k, v, n, first, link, campaign)`` of rows of large groups."""
        whole = self._whole(rows)
        return whole.unionByName(self._votes(rows), allowMissingColumns=True)

    def _binned(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bin", floor_to_bin(F.col(self.ts_col), self.bin_seconds))

    def _votes(self, rows: DataFrame) -> DataFrame:
        """``(*keys, k, v, n)``: rows of a bin with value ``v`` in the voted column ``k``."""
        wide = self._binned(rows).select(*self.keys, *[F.col(c).cast("string").alias(f"_v_{c}") for c in self.voted])
        long = wide.unpivot(self.keys, [f"_v_{c}" for c in self.voted], "k", "v").where("v IS NOT NULL")
        counted = long.groupBy(*self.keys, "k", "v").agg(F.count(F.lit(1)).alias("n"))
        return counted.withColumn("k", F.expr("substring(k, 4)"))

    def _place(self) -> Column:
        """A bigint that never falls along (time, id) inside a bin: microseconds from the bin's start, then as many
        leading bytes of a text id as there is room for."""
        span = self.bin_seconds * 1_000_000
        us = epoch_micros(F.col(self.ts_col))
        size = (63 - span.bit_length()) // 8 if self.schema[self.id_col].dataType.typeName() == "string" else 0
        place = F.coalesce(us - F.floor(us / F.lit(span)).cast("long") * F.lit(span), F.lit(0)).cast("long")
        if size <= 0:
            return place
        lead = F.rpad(F.hex(F.substring(F.col(self.id_col).cast("binary"), 1, size)), 2 * size, "0")
        return place * F.lit(1 << 8 * size) + F.coalesce(F.conv(lead, 16, 10).cast("long"), F.lit(0))

    def _whole(self, rows: DataFrame) -> DataFrame:
        """The cells of no column. The lowest places of a bin are found by numbers, the first among these by time and
        id; whole rows are read for the first only."""
        link = F.coalesce(F.col("is_campaign_link"), F.lit(False)) if self.has_link else F.lit(False)
        placed = self._binned(rows).withColumns({"_place": self._place(), "_link": link})
        # a row per bin, written for its true size
        sizes = cut_lineage(placed.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("_n"), F.max("_link").alias("_any"), F.min("_place").alias("_low"),
            F.min(F.when(F.col("_link"), F.col("_place"))).alias("_low_link")))
        either = lambda low, link: F.explode(F.array_distinct(F.array_compact(F.array(low, link))))
        lowest = sizes.select(*self.keys, "_n", "_any", either("_low", "_low_link").alias("_place"))
        order = F.struct(F.col(self.ts_col).alias("ts"), F.col(self.id_col).alias("id"))
        at = placed.select(*self.keys, "_place", "_link", order.alias("_at"))
        firsts = cut_lineage(join_on(at, lowest, [*self.keys, "_place"]).groupBy(*self.keys).agg(
            F.max("_n").alias("_n"), F.max("_any").alias("_any"), F.min("_at").alias("_first"), F.min(F.when(F.col("_link"), F.col("_at"))).alias("_first_link")))
        firsts = firsts.select(*self.keys, "_n", "_any", either("_first", "_first_link").alias("_at"))
        carried = F.struct(*[F.col(c) for c in self.columns if c not in self.group_cols])
        campaign = F.when(F.col("_link"), F.struct(order.alias("at"), F.col("campaign_id").alias("of"))) if self.has_campaign else F.lit(None).cast("struct<at:int,of:int>")
        few = join_on(placed.withColumn("_at", order), firsts, [*self.keys, "_at"]).select(
            *self.keys, F.col("_n").alias("n"), F.struct(order.alias("at"), carried.alias("row")).alias("first"), F.col("_any").alias("link"), campaign.alias("campaign"))
        return few.groupBy(*self.keys).agg(F.max("n").alias("n"), *self._kept()).select(
            *self.keys, F.lit("").alias("k"), F.lit(None).cast("string").alias("v"), "n", "first", "link", "campaign")

    @staticmethod
    def _kept() -> list:
        return [F.min_by("first", "first.at").alias("first"), F.bool_or("link").alias("link"), F.min_by("campaign", "campaign.at").alias("campaign")]

    def merged(self, cells: DataFrame) -> DataFrame:
        """Cells of all rows from those of several disjoint sets of rows."""
        whole = cells.where("k = ''").groupBy(*self.keys, "k", "v").agg(F.sum("n").alias("n"), *self._kept())
        votes = cells.where("k <> ''").groupBy(*self.keys, "k", "v").agg(F.sum("n").alias("n"))
        return whole.unionByName(votes, allowMissingColumns=True)

    def collapse(self, rows: DataFrame) -> DataFrame:
        """``bins`` of the cells of ``rows``."""
        return self._bins(self._whole(rows), self._votes(rows))

    def bins(self, cells: DataFrame) -> DataFrame:
        """The bins' rows in the columns of the input, ``event_count`` and the prediction's agreement."""
        return self._bins(cells.where("k = ''"), cells.where("k <> ''"))

    def _bins(self, whole: DataFrame, votes: DataFrame) -> DataFrame:
        # the smallest value wins a tie
        elected = votes.groupBy(*self.keys, "k").agg(
            F.count("v").alias("nd"), F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("best"))
        few = whole.drop("k", "v").unionByName(elected, allowMissingColumns=True)
        aggs = [F.max("n").alias("_n"), F.min_by("first", "first.at").alias("_first"),
                F.bool_or("link").alias("_link"), F.min_by("campaign", "campaign.at").alias("_campaign")]
        for c in self.voted:
            mine = F.col("k") == c
            best = F.max(F.when(mine, F.col("best")))
            aggs += [F.max(F.when(mine, F.col("nd"))).alias(f"_nd_{c}"), best["v"].alias(f"_mode_{c}"), (-best["neg"]).alias(f"_top_{c}")]
        bins = few.groupBy(*self.keys).agg(*aggs)
        n_src, n_dst = F.coalesce(f"_nd_{self.src_col}", F.lit(0)), F.coalesce(f"_nd_{self.dst_col}", F.lit(0))
        fans_out = n_src <= n_dst
        new = {
            self.ts_col: F.col("_bin"),
            self.src_col: F.when(fans_out, F.col(f"_mode_{self.src_col}")).otherwise(multi_marker(n_src)),
            self.dst_col: F.when(fans_out, multi_marker(n_dst)).otherwise(F.col(f"_mode_{self.dst_col}")),
            "event_count": F.col("_n"),
        }
        if self.has_link:
            new["is_campaign_link"] = F.col("_link")
        if self.has_campaign:
            new["campaign_id"] = F.coalesce("_campaign.of", F.lit(S.NO_CAMPAIGN))
        if self.has_prediction:
            new["predicted_attack_type"] = F.col("_mode_predicted_attack_type")
            new["predicted_attack_type_agreement"] = F.col("_top_predicted_attack_type") / F.col("_n")
        for c in self.mode_cols:
            new[c] = F.col(f"_mode_{c}")
        for c in self.null_cols:
            new[c] = F.lit(None).cast(self.schema[c].dataType)
        if self.bin_id is not None:
            day = F.floor(bin_number(F.col("_bin"), self.bin_seconds) / F.lit(max(1, 86_400 // self.bin_seconds)))
            bins = number_rows(bins, self.group_cols, day, ["_bin"], "_ord")
            new[self.id_col] = self.bin_id(F.col("_ord") - 1)
        extras = [c for c in ("event_count", "predicted_attack_type_agreement") if c in new and c not in self.columns]
        out = []
        for c in self.columns + extras:
            if c in new:
                out.append(new[c].alias(c))
            elif c in self.group_cols:
                out.append(F.col(c))
            else:
                out.append(F.col(f"_first.row.{c}").alias(c))
        return bins.select(*out)


def aggregate_bursts(df: DataFrame, group_cols, threshold=S.BURST_THRESHOLD, bin_seconds=S.BURST_BIN_SECONDS,
                     ts_col="timestamp", src_col="src_ip", dst_col="dst_ip", id_col="event_id",
                     null_cols=(), mode_cols=(), bin_id=None) -> DataFrame:
    """Groups of at most ``threshold`` rows pass unchanged; larger ones become one row per bin (see ``BurstRules``)."""
    rules = BurstRules(df.schema, group_cols, bin_seconds, ts_col, src_col, dst_col, id_col, null_cols, mode_cols, bin_id)
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_rows"))
    # written for its true size: a few large groups are no reason to shuffle all rows
    large = cut_lineage(sizes.where(F.col("_rows") > threshold).select(*group_cols, F.lit(True).alias("_large")))
    tagged = join_on(df, large, list(group_cols), "left")
    calm = tagged.where(F.col("_large").isNull()).drop("_large")
    flood = tagged.where(F.col("_large")).drop("_large")
    return fill_burst_defaults(calm.unionByName(rules.collapse(flood), allowMissingColumns=True))


def fill_burst_defaults(df: DataFrame) -> DataFrame:
    """Rows that were never collapsed count once and agree with themselves."""
    filled = {"event_count": F.coalesce("event_count", F.lit(1)).cast("long") if "event_count" in df.columns
              else F.lit(1).cast("long")}
    if "predicted_attack_type_agreement" in df.columns:
        filled["predicted_attack_type_agreement"] = F.coalesce("predicted_attack_type_agreement", F.lit(1.0))
    return df.withColumns(filled)
