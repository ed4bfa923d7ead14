"""Session-list captures: text lines, truth XML, and the file inventory."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.lookup import map_values, phase_attack_type, phase_stage
from ..functions.temporal import parse_session_clock
from ..functions.text import clean_ip, count_marker, optional_number, phase_number, scenario_source

# The fields of a session line, in order, with the pattern each must match.
LINE_FIELDS = {
    "seq": r"\d+", "date": r"\d{2}/\d{2}/\d{4}", "time": r"\d{2}:\d{2}:\d{2}", "duration": r"\d{2}:\d{2}:\d{2}",
    "service": r"\S+", "sport": r"\S+", "dport": r"\S+", "src": r"\S+", "dst": r"\S+", "flag": r"\S+", "extra": r"\S+",
}
LINE_PATTERN = r"^\s*" + r"\s+".join(LINE_FIELDS.values()) + r"\s*$"


def is_session_line(line: Column) -> Column:
    return line.rlike(LINE_PATTERN)


def parse_lines(lines: DataFrame, value="value") -> DataFrame:
    """Unified columns from session lines that carry ``scenario``, ``vantage`` and ``phase``.
    Other lines are skipped, as are lines with a malformed address."""
    # No field holds blanks: one split, in a projection of its own, replaces a regex per field.
    tokens = F.split(F.regexp_replace(F.col(value), r"^\s+", ""), r"\s+")
    split = lines.where(is_session_line(F.col(value))).select("scenario", "vantage", "phase", tokens.alias("_t"))
    f = {name: F.col("_t")[i] for i, name in enumerate(LINE_FIELDS)}
    parsed = split.select(
        F.concat_ws("_", "scenario", "vantage", F.concat(F.lit("p"), F.col("phase")), f["seq"]).alias("event_id"),
        parse_session_clock(f["date"], f["time"]).alias("timestamp"),
        clean_ip(f["src"]).alias("src_ip"), clean_ip(f["dst"]).alias("dst_ip"),
        optional_number(f["sport"]).alias("src_port"), optional_number(f["dport"]).alias("dst_port"),
        f["service"].alias("service"), F.lit("network").alias("tier"), "vantage",
        scenario_source(F.col("scenario")).alias("source_dataset"), "scenario", "phase")
    return parsed.where("src_ip IS NOT NULL AND dst_ip IS NOT NULL")


def rejected_lines(lines: DataFrame, value="value", by=("scenario", "vantage", "phase")) -> DataFrame:
    """How many lines per file are not session lines (including blank and header lines)."""
    return lines.groupBy(*by).agg(F.count_if(~is_session_line(F.col(value))).alias("n_rejected"),
                                  F.count(F.lit(1)).alias("n_lines"))


def tag_phase(events: DataFrame) -> DataFrame:
    return events.withColumns({"kill_chain_stage": phase_stage(F.col("phase")),
                               "attack_type": phase_attack_type(F.col("phase"))})


def _path_columns(df: DataFrame, path: Column, scenarios=None, root=None) -> DataFrame:
    """Scenario, vantage and phase from a file's path."""
    if scenarios is not None:
        scenario = F.regexp_extract(path, "/(" + "|".join(re.escape(s) for s in scenarios) + ")/", 1)
    else:
        scenario = F.regexp_extract(path, re.escape(root.rstrip("/")) + "/([^/]+)/", 1)
    directory = F.regexp_extract(path, r"/data_and_labeling/([^/]+)/[^/]+$", 1)
    return df.withColumns({"scenario": scenario, "directory": directory,
                           "vantage": map_values(directory, S.VANTAGE_DIRS),
                           "phase": phase_number(F.substring_index(path, "/", -1))})


def _read_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
            .select("value", F.col("_metadata.file_path").alias("path")))


def read_session_lines(spark: SparkSession, root: str, scenarios=S.SCENARIOS) -> DataFrame:
    """Raw lines of every ``phase-N.list`` below ``root``; absent directories simply add no rows."""
    lines = _path_columns(_read_tree(spark, root, "phase-*.list"), F.col("path"), scenarios)
    return lines.where((F.col("scenario") != "") & F.col("vantage").isNotNull() & F.col("phase").between(1, 5))


def count_truth_alerts(spark: SparkSession, root: str, scenarios=S.SCENARIOS, marker="<Alert ") -> DataFrame:
    """Alert elements per truth file."""
    text = _path_columns(_read_tree(spark, root, "mid-level-phase-*.xml"), F.col("path"), scenarios)
    return (text.where((F.col("scenario") != "") & F.col("vantage").isNotNull())
            .groupBy("scenario", "vantage", "phase").agg(F.sum(count_marker(F.col("value"), marker)).alias("n_xml")))


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of dump, list and truth file per scenario, capture directory and phase. Only file
    status is read, never content. A directory without phase files does not show up."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length"))
    files = _path_columns(files, F.col("path"), root=root).where(F.col("phase").isNotNull())
    name = F.substring_index("path", "/", -1)
    kind = (F.when(name.contains("-dump"), "dump_bytes")
            .when(name.startswith("mid-level-phase-") & name.endswith(".xml"), "truth_xml_bytes")
            .when(name.endswith(".list"), "list_bytes"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("length"))).alias(k)
    return (files.withColumn("kind", kind).where("kind IS NOT NULL")
            .groupBy("scenario", F.col("directory").alias("vantage"), "phase")
            .agg(pick("dump_bytes"), pick("list_bytes"), pick("truth_xml_bytes")))


def expected_captures(inventory: DataFrame, directories=tuple(S.VANTAGE_DIRS)) -> DataFrame:
    """Every (scenario, capture directory) pair that the inventory should show."""
    return inventory.select("scenario").distinct().withColumn(
        "vantage", F.explode(F.array(*[F.lit(d) for d in directories])))
