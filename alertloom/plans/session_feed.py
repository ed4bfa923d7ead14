"""Session captures to unified events: parse, reconcile, label, collapse."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.lookup import map_values
from ..operators import bursts, campaigns, checks
from ..session import cut_lineage
from ..sources import sessions


def parse(spark: SparkSession, root: str, scenarios=S.SCENARIOS) -> DataFrame:
    return sessions.tag_phase(sessions.parse_lines(sessions.read_session_lines(spark, root, scenarios)))


def count_mismatches(spark: SparkSession, root: str, scenarios=S.SCENARIOS) -> DataFrame:
    """Files whose parsed lines and truth alerts differ in number; files without truth are skipped."""
    key = ["scenario", "vantage", "phase"]
    listed = parse(spark, root, scenarios).groupBy(*key).agg(F.count(F.lit(1)).alias("n_list"))
    truth = sessions.count_truth_alerts(spark, root, scenarios)
    # a file without a single record is in no count, so the files present decide
    files = sessions.read_inventory(spark, root).where(F.col("scenario").isin(list(scenarios)))
    files = files.where("list_bytes is not null and truth_xml_bytes is not null")
    files = files.withColumn("vantage", map_values(F.col("vantage"), S.VANTAGE_DIRS)).select(*key)
    return checks.reconcile(listed, truth, key, keys=files)


def label(parsed: DataFrame) -> DataFrame:
    """Campaign of an event: its scenario, when it belongs to the attack chain that got through."""
    return campaigns.label_by_hosts(parsed, "scenario")


def collapse(labelled: DataFrame, threshold=S.BURST_THRESHOLD, bin_seconds=S.BURST_BIN_SECONDS) -> DataFrame:
    name = lambda i: F.concat_ws("_", "scenario", "vantage", F.concat(F.lit("p"), F.col("phase")), F.lit("agg"), i.cast("string"))
    return bursts.aggregate_bursts(
        labelled, ["scenario", "vantage", "phase"], threshold, bin_seconds,
        null_cols=["src_port", "dst_port"], mode_cols=["service"], bin_id=name)


def session_events(spark: SparkSession, root: str, scenarios=S.SCENARIOS) -> DataFrame:
    """The unified event table of all captures below ``root``."""
    # Text is parsed once; labelling and collapsing read the written copies.
    events = collapse(cut_lineage(label(cut_lineage(parse(spark, root, scenarios)))))
    return events.select(*S.UNIFIED_COLUMNS, *S.SESSION_EXTRAS.fieldNames())


def sanity(events: DataFrame) -> DataFrame:
    """Linked against distractor events per scenario; a degenerate scenario has no distractors to reject."""
    return campaigns.balance(events, "scenario")


def capture_problems(spark: SparkSession, root: str) -> DataFrame:
    inventory = sessions.read_inventory(spark, root)
    return checks.inventory_problems(inventory, sessions.expected_captures(inventory))
