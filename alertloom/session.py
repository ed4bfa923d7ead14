"""Session settings the library relies on, and lineage cutting."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS = {}
_COLLECTORS = []

# The JVM leaves methods above 8000 bytes uncompiled, so wide projections in one generated
# method run interpreted. Below that limit Spark falls back to smaller generated pieces.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Settings the plans count on, for a session somebody else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores="*", shuffle_partitions=8, **extra) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("alertloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine; on
    a cluster an unset folder is an error, since other executors could not read it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    local = re.fullmatch(r"local(\[.*\])?", sc.master)
    if named:
        return named
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="alertloom-")
    return _LOCAL_FOLDERS[sc.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative plans stay short and survive lost executors. Unlike a checkpointed RDD, a written
    table has its true size, so Spark plans the next joins by it; estimates carried through a loop
    of joins multiply in every round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuts/{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for made in _COLLECTORS:
        made.append(out)
    return out


@contextmanager
def collect_cuts():
    """List of the tables that ``cut_lineage`` writes inside the block, for ``release`` once their readers are done."""
    made = []
    _COLLECTORS.append(made)
    try:
        yield made
    finally:
        _COLLECTORS[:] = [x for x in _COLLECTORS if x is not made]


def delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)


def read_cuts(cuts) -> DataFrame:
    """Several written tables of one schema as a single scan."""
    return cuts[0].sparkSession.read.schema(cuts[0].schema).parquet(*[c._cut_path for c in cuts])


def release(*cuts: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in cuts:
        if df is not None:
            fs, where = _file_system(df.sparkSession, df._cut_path)
            fs.delete(where, True)


def copy_folder(spark: SparkSession, path: str, to: str) -> None:
    (fs, where), (there, target) = _file_system(spark, path), _file_system(spark, to)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, there, target, False, spark.sparkContext._jsc.hadoopConfiguration())


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
