"""Flow CSV files: wide scans with explicit or inferred schema, tagged with file and day."""

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from .. import schema as S
from ..functions.lookup import file_day
from ..functions.numeric import clean_number
from ..functions.temporal import parse_mixed
from ..session import _file_system

TEXT_COLUMNS = {"flow_id", "timestamp", "src_ip", "dst_ip", "protocol", "label"}
PORTS = {"src_port", "dst_port"}
CORRUPT = "_corrupt_record"


def flow_schema(columns) -> T.StructType:
    """Schema for a flow header: known text and port columns, all statistics as text-safe strings
    are left to ``clean_features``, since the files hold ``inf`` and blanks."""
    kind = lambda c: T.IntegerType() if c in PORTS else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def csv_files(spark: SparkSession, root: str) -> list:
    """Paths of the CSV files below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    return sorted(r.path for r in found.select("path").collect())


def csv_header(spark: SparkSession, path: str) -> list:
    """Column names in the first line of a file, read through the file system that holds it; no names for an empty file.

    A byte-order mark and blanks around a name do not count; a name that comes again gets its position.
    """
    fs, where = _file_system(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(where), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    names = [n.strip().lstrip("\ufeff").strip() for n in next(csv.reader([line]), [])] if line else []
    return [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]


def header_groups(spark: SparkSession, paths) -> dict:
    """Paths by header. A line of every file is read, whatever its size; files without a header are left out."""
    groups = {}
    for path in paths:
        header = tuple(csv_header(spark, path))
        if header:
            groups.setdefault(header, []).append(path)
    return groups


def read_flow_records(spark: SparkSession, root: str, files="all") -> DataFrame:
    """Every record of the flow files below ``root``, with ``source_file``, ``day`` and ``reason``.

    Files are grouped by their header and each group is one scan with its own columns, joined by name, so files with
    more columns or another order are read right; a column that a file lacks is null there. ``reason`` tells why a
    record is of no use, null for good ones: ``wrong number of fields``, ``blank record``, or ``unlisted file`` where
    ``files`` names others (``None``: those of a known day).
    """
    wanted = list(S.FLOW_FILE_DAY) if files is None else files
    scans = []
    for header, paths in header_groups(spark, csv_files(spark, root)).items():
        schema = flow_schema(header).add(CORRUPT, T.StringType())
        scan = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        scans.append(scan.csv(paths).withColumn("source_file", F.substring_index(F.col("_metadata.file_path"), "/", -1)))
    if not scans:
        empty = flow_schema(["timestamp", CORRUPT, "source_file"])
        scans = [spark.createDataFrame([], empty)]
    rows = scans[0]
    for scan in scans[1:]:
        rows = rows.unionByName(scan, allowMissingColumns=True)
    blank = reduce(lambda x, y: x & y, [F.col(c).isNull() for c in rows.columns if c not in (CORRUPT, "source_file")])
    reason = F.when(F.col(CORRUPT).isNotNull(), "wrong number of fields").when(blank, "blank record")
    if not isinstance(wanted, str):
        reason = F.when(~F.col("source_file").isin(wanted), "unlisted file").otherwise(reason)
    out = rows.withColumns({"reason": reason, "day": file_day(F.col("source_file")), "timestamp": parse_mixed(F.col("timestamp"))}).drop(CORRUPT)
    names = [c for c in out.columns if c not in ("source_file", "day", "reason")]
    return out.select(*names, "source_file", "day", "reason")


def read_flows(spark: SparkSession, root: str, files="all", schema: T.StructType = None) -> DataFrame:
    """The good records of ``read_flow_records``; with a ``schema``, all files have that header and are one scan."""
    if schema is None:
        return read_flow_records(spark, root, files).where("reason IS NULL").drop("reason")
    scan = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.csv").csv(root))
    tagged = scan.withColumn("source_file", F.substring_index(F.col("_metadata.file_path"), "/", -1))
    tagged = tagged.withColumn("day", file_day(F.col("source_file")))
    if files != "all":
        tagged = tagged.where(F.col("source_file").isin(list(S.FLOW_FILE_DAY) if files is None else list(files)))
    return tagged.withColumn("timestamp", parse_mixed(F.col("timestamp")))


def dropped_records(records: DataFrame) -> DataFrame:
    """(source_file, reason, n) of the records that ``read_flows`` leaves out, from ``read_flow_records``."""
    return records.where("reason IS NOT NULL").groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("n"))


def unlisted_rows(spark: SparkSession, root: str, schema: T.StructType = None) -> DataFrame:
    """(source_file, n) of the files below ``root`` that stand for no known day."""
    return rows_per_file(read_flows(spark, root, "all", schema).where(~F.col("source_file").isin(list(S.FLOW_FILE_DAY))))


def attack_files() -> list:
    return [f for f in S.FLOW_FILE_DAY if "benign" not in f]


def benign_files() -> list:
    return [f for f in S.FLOW_FILE_DAY if "benign" in f]


def feature_columns(df: DataFrame, excluded=S.FLOW_LEAKAGE_COLUMNS, also=("source_file", "day")) -> list:
    drop = set(excluded) | set(also)
    return [c for c in df.columns if c not in drop]


def clean_features(df: DataFrame, columns, categorical=("protocol",)) -> DataFrame:
    """Statistics as float32 without infinities or gaps; categories stay text."""
    return df.withColumns({c: clean_number(F.col(c)) for c in columns if c not in categorical})


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def read_second_flows(spark: SparkSession, path: str) -> DataFrame:
    """The second flow dataset. Spark drops a byte-order mark in front of the header."""
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    numeric = [c for c in text.columns if c not in S.SECOND_FLOW_CATEGORICAL + ["attack_cat", "id", "label"]]
    return text.withColumns({c: clean_number(F.col(c)) for c in numeric}
                            | {c: F.col(c).try_cast("int") for c in ("id", "label") if c in text.columns})
