"""Reading back what the library wrote, and the sinks."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from .. import schema as S
from ..functions.temporal import parse_mixed
from ..session import cut_lineage, release

WRITERS = 200
ROWS_PER_WRITER = 1_000_000


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_events_csv(spark: SparkSession, path: str, extras: T.StructType = S.FLOW_EXTRAS) -> DataFrame:
    """Unified events from CSV, with timestamps in mixed formats. "N/A" stays text."""
    fields = [T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
              for f in list(S.UNIFIED) + list(extras)]
    raw = spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
    return raw.withColumn("timestamp", parse_mixed(F.col("timestamp")))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.schema(S.SPLIT).option("header", True).csv(path)
    return spark.read.parquet(path)


def read_confusion_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide confusion matrix (first column: true label) as a long table."""
    wide = spark.read.option("header", True).option("inferSchema", False).csv(path)
    label, predicted = wide.columns[0], wide.columns[1:]
    quoted = {c: c for c in predicted}
    long = wide.withColumnRenamed(label, "true_label").unpivot("true_label", list(quoted), "predicted_label", "n")
    return long.withColumn("n", F.col("n").cast("long"))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_events(df: DataFrame, path: str, rows_per_file=1_000_000, id_col="event_id") -> None:
    """Events by source, repeatably: the sources that ``df`` holds replace what was there, others stay.

    Rows are dealt by ranges of (source, digest of the id), so a source that holds most rows fills many files and
    all files but the last of a source are about equally large; the skewed campaign column is no partition column.
    Above ``WRITERS`` files a task writes several, each of ``rows_per_file`` rows but its last of a source: neither the
    tasks nor the sample that deals the rows grow with the number of files. Writing the same events again gives the same rows.
    """
    n = df.count()
    files = max(1, -(-n // rows_per_file))
    tasks = min(files, max(WRITERS, -(-n // ROWS_PER_WRITER)))
    dealt = df.repartitionByRange(tasks, F.col("source_dataset"), F.xxhash64(id_col)) if tasks > 1 else df.coalesce(1)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_dataset")
    if tasks < files:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def write_table(df: DataFrame, path: str, mode="overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode="overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_reconstruction(events: DataFrame, assignments: dict, path: str) -> None:
    """Events plus one ``<method>_predicted_cluster`` column per method."""
    out = events
    for method, assignment in assignments.items():
        named = assignment.select("event_id", F.col("cluster_id").alias(f"{method}_predicted_cluster"))
        out = out.join(named, "event_id", "left")
    # counted, sampled for its ranges and written: joined once
    joined = cut_lineage(out)
    write_events(joined, path)
    release(joined)


def write_metrics(scores: DataFrame, completeness: DataFrame, path: str, mode="overwrite") -> None:
    """JSON lines: one nested document per method, and one per method and campaign."""
    pairwise = F.struct("tp_pairs", "fp_pairs", "fn_pairs", "precision", "recall", "f1",
                        "n_predicted_pairs", "n_true_pairs")
    document = scores.select("method", "adjusted_rand_index", F.col("n_clusters").alias("n_predicted_clusters"),
                             pairwise.alias("pairwise"))
    write_json(document, f"{path}/scores", mode)
    detail = F.struct("true_stages", "captured_stages", "completeness", "n_true_events",
                      "n_predicted_clusters_touched", "fragmentation")
    write_json(completeness.select("method", "campaign_id", detail.alias("kill_chain_completeness")),
               f"{path}/completeness", mode)


def write_json(df: DataFrame, path: str, mode="overwrite") -> None:
    df.write.mode(mode).json(path)
