"""Online forms that equal their batch results: campaign correlation over both addresses, bursts above a threshold.

Both process a stream in micro-batches with state in tables of the shared folder, a folder per batch id. A batch
reads the state of the one before it and overwrites its own, so a batch that is run again after a failure leaves
what it would have left the first time, and rows of any output are named by the batch that wrote them.

The rule's state cannot live in a keyed operator: an event stands under two addresses, and who takes it as a
parent under one takes it away under the other. So the events that a batch makes final are matched among each other
and with the anchors still open, as one distributed job.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.pairs import FEATURE_INPUTS, RULE_INPUTS, rule_decision
from ..operators.bursts import BurstRules, fill_burst_defaults
from ..operators.correlate import chain_roots, match_links
from ..operators.ranking import join_on
from ..session import _file_system, delete_on_exit, shared_dir


class BatchTables:
    """Tables of a stream by name and batch id, below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/{batch}"

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, batch))
        return self.read(name, batch, df.schema)

    def read(self, name: str, batch: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name, batch))

    def batches(self, name: str) -> list:
        fs, where = _file_system(self.spark, f"{self.folder}/{name}")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []

    def read_all(self, name: str, schema) -> DataFrame:
        paths = [self.path(name, b) for b in self.batches(name)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def before(self, name: str, batch: int, schema) -> DataFrame:
        """The table as the batch before this one left it; empty at the beginning."""
        known = [b for b in self.batches(name) if b < batch]
        return self.read(name, known[-1], schema) if known else self.spark.createDataFrame([], schema)

    def drop_before(self, name: str, batch: int) -> None:
        """State that neither this batch nor a repetition of it reads any more."""
        for b in [b for b in self.batches(name) if b < batch][:-1]:
            fs, where = _file_system(self.spark, self.path(name, b))
            fs.delete(where, True)


def new_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    return folder


class RuleCorrelator:
    """Clusters of the shared-address rule as events become final.

    An event is final once the watermark, ``late`` behind the newest event, has passed it; events that come later than
    that are counted in ``late_rows`` and left out. Final events of a batch are matched in time order with each other
    and with the open anchors: events without a successor that the window still reaches. ``close`` makes the rest final.
    """

    def __init__(self, spark: SparkSession, folder: str = None, minutes=S.RULE_WINDOW_MINUTES, window_seconds=S.OPEN_WINDOW_SECONDS,
                 late_seconds=600, carry=FEATURE_INPUTS):
        self.tables = BatchTables(spark, folder or new_folder(spark))
        self.minutes, self.window_seconds, self.late_seconds, self.carry = minutes, window_seconds, late_seconds, list(carry)
        self.spark = spark
        self.clock_schema = "newest timestamp_ntz, late_rows long"

    def _select(self, events: DataFrame) -> DataFrame:
        return events.select("event_id", *self.carry)

    def add(self, events: DataFrame, batch: int) -> None:
        """One micro-batch; what ``foreachBatch`` calls."""
        rows = self._select(events)
        self.schema = rows.schema
        before = self.tables.before("clock", batch, self.clock_schema).first()
        newest, late_rows = (before.newest, before.late_rows) if before else (None, 0)
        fresh = rows.agg(F.max("timestamp").alias("t"), F.count_if(F.col("timestamp") <= self._mark(newest)).alias("n")).first()
        newest = max([t for t in (newest, fresh.t) if t is not None], default=None)
        old_mark = self._mark(before.newest if before else None)
        waiting = self.tables.before("waiting", batch, self.schema)
        usable = waiting.unionByName(rows.where(F.coalesce(F.col("timestamp") > old_mark, F.lit(True))))
        self._advance(usable, F.coalesce(F.col("timestamp") <= self._mark(newest), F.lit(False)), newest, batch)
        clock = self.spark.createDataFrame([(newest, late_rows + fresh.n)], self.clock_schema)
        self.tables.write("clock", batch, clock)
        for name in ("waiting", "open", "clock"):
            self.tables.drop_before(name, batch)

    def _mark(self, newest):
        """The watermark as a column; null before the first event."""
        at = F.lit(newest).cast("timestamp_ntz")
        return at - F.expr(f"INTERVAL '{int(self.late_seconds)}' SECOND")

    def _advance(self, usable: DataFrame, final, newest, batch: int) -> None:
        self.tables.write("waiting", batch, usable.where(~final))
        open_schema = self.spark.createDataFrame([], self.schema).withColumn("cluster_id", F.lit("")).schema
        open_ = self.tables.before("open", batch, open_schema)
        pool = self.tables.write("pool", batch, open_.withColumn("_new", F.lit(False)).unionByName(
            usable.where(final).withColumns({"cluster_id": F.col("event_id"), "_new": F.lit(True)})))
        links = match_links(pool, rule_decision(self.minutes), self.window_seconds, keys=["src_ip", "dst_ip"], carry=RULE_INPUTS, asks=F.col("_new"))
        roots = chain_roots(links).select(F.col("child").alias("event_id"), F.col("root").alias("_root"))
        named = pool.select(F.col("event_id").alias("_root"), F.col("cluster_id").alias("_of"))
        found = pool.join(roots, "event_id", "left").join(named, "_root", "left").withColumn("cluster_id", F.coalesce("_of", "cluster_id"))
        found = self.tables.write("found", batch, found.drop("_root", "_of"))
        self.tables.write("clusters", batch, found.where("_new").select("event_id", "cluster_id"))
        taken = links.select(F.col("parent").alias("event_id"))
        reach = self._mark(newest) - F.expr(f"INTERVAL '{int(self.window_seconds)}' SECOND")
        left = found.drop("_new").join(taken, "event_id", "left_anti").where(F.coalesce(F.col("timestamp") >= reach, F.lit(False)))
        self.tables.write("open", batch, left)
        for name in ("pool", "found"):
            fs, where = _file_system(self.spark, self.tables.path(name, batch))
            fs.delete(where, True)

    def close(self) -> None:
        """No more input: the events that still wait become final."""
        known = self.tables.batches("clock")
        if known:
            waiting = self.tables.read("waiting", known[-1], self.schema)
            newest = self.tables.read("clock", known[-1], self.clock_schema).first().newest
            self._advance(waiting, F.lit(True), newest, known[-1] + 1)

    def clusters(self) -> DataFrame:
        """(event_id, cluster_id) of all final events."""
        return self.tables.read_all("clusters", "event_id string, cluster_id string")

    def late_rows(self) -> int:
        known = self.tables.batches("clock")
        return self.tables.read("clock", known[-1], self.clock_schema).first().late_rows if known else 0


class BurstCollector:
    """Bursts of groups above a threshold, exact after every batch.

    First step: the group totals, which tell the groups that are large now. Second step: rows of a small group are kept
    (never more than the threshold of a group); once a group is large, its kept rows and all later ones are only
    counted into cells, which add up over batches. ``MERGE`` batches' cells are merged into one table.
    """

    MERGE = 8

    def __init__(self, spark: SparkSession, schema, group_cols, threshold=S.BURST_THRESHOLD, folder: str = None, **rules):
        self.tables = BatchTables(spark, folder or new_folder(spark))
        self.rules = BurstRules(schema, group_cols, **rules)
        self.schema, self.group_cols, self.threshold = schema, list(group_cols), threshold
        empty = spark.createDataFrame([], schema)
        self.totals_schema = empty.groupBy(*self.group_cols).agg(F.count(F.lit(1)).alias("rows")).schema
        self.cells_schema = self.rules.cells(empty).schema

    def add(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch; what ``foreachBatch`` calls."""
        fresh = self.tables.write("fresh", batch, rows.select(*self.schema.fieldNames()))
        before = self.tables.before("totals", batch, self.totals_schema)
        counted = fresh.groupBy(*self.group_cols).agg(F.count(F.lit(1)).alias("rows"))
        totals = self.tables.write("totals", batch, before.unionByName(counted).groupBy(*self.group_cols).agg(F.sum("rows").alias("rows")))
        large = totals.where(F.col("rows") > self.threshold).select(*self.group_cols, F.lit(True).alias("_large"))
        kept = self.tables.before("kept", batch, self.schema)
        tagged = join_on(kept.unionByName(fresh), large, self.group_cols, "left")
        self.tables.write("cells", batch, self.rules.cells(tagged.where("_large").drop("_large")))
        self.tables.write("kept", batch, tagged.where("_large IS NULL").drop("_large"))
        if batch % self.MERGE == self.MERGE - 1:
            self._merge(batch)
        for name in ("totals", "kept"):
            self.tables.drop_before(name, batch)
        fs, where = _file_system(fresh.sparkSession, self.tables.path("fresh", batch))
        fs.delete(where, True)

    def _merge(self, batch: int) -> None:
        """All cells up to the batch before as a new base; what went into it is left to be ignored and deleted."""
        base = max([b for b in self.tables.batches("base") if b < batch], default=None)
        self.tables.write("base", batch, self.rules.merged(self._cells(base, batch)))
        for b in [b for b in self.tables.batches("cells") if base is not None and b <= base]:
            fs, where = _file_system(self.tables.spark, self.tables.path("cells", b))
            fs.delete(where, True)

    def _cells(self, base, upto: int) -> DataFrame:
        new = [b for b in self.tables.batches("cells") if b <= upto and (base is None or b > base)]
        tables = ([self.tables.read("base", base, self.cells_schema)] if base is not None else []) + [
            self.tables.read("cells", b, self.cells_schema) for b in new]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def rows(self) -> DataFrame:
        """All rows so far as the batch operator gives them: small groups unchanged, large ones in bins."""
        known = self.tables.batches("kept")
        if not known:
            return fill_burst_defaults(self.tables.spark.createDataFrame([], self.schema))
        base = max(self.tables.batches("base"), default=None)
        bins = self.rules.bins(self.rules.merged(self._cells(base, known[-1])))
        return fill_burst_defaults(self.tables.read("kept", known[-1], self.schema).unionByName(bins, allowMissingColumns=True))


def run_batches(stream: DataFrame, sink, folder: str) -> None:
    """Feed all input there is now to ``sink.add``, batch by batch."""
    query = (stream.writeStream.foreachBatch(lambda df, batch: sink.add(df, batch)).option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
