"""Documents to a training corpus: line cleaning, near-dedup, decontamination, mixing, shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Rows with null or
repeated ids pass through like others; an empty table gives an empty result.
"""

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm import decontaminate, minhash, mixing, quality, sharding
from alertloom.session import collect_cuts, delete_on_exit, release, shared_dir

_OPEN = []


def staged(stage):
    """A stage that first deletes what the one before it wrote for itself: its result has been written by then."""

    @wraps(stage)
    def run_stage(spark, docs, sf_dir):
        release(*[x for x in _OPEN if x.sparkSession is spark])
        with collect_cuts() as made:
            out = stage(spark, docs, sf_dir)
        _OPEN[:] = made
        return out

    return run_stage


@staged
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines leave the texts, rejected documents leave the table; ``n_chars`` follows the text."""
    judged = quality.clean_lines(docs.select(F.struct(*docs.columns).alias("_doc"), "text")).where("kept")
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return judged.select(*[(new[c] if c in new else F.col(f"_doc.{c}")).alias(c) for c in docs.columns])


@staged
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


@staged
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it."""
    return mixing.take_mix(docs)


@staged
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot``."""
    return sharding.assign_shards(docs)


STAGES = [("quality", clean), ("near_dedup", dedup), ("decontaminate", decontaminated), ("mix", mix), ("shard", shard)]

# no SQL: the k-d tree's splits depend on the rows of every level; tests/llm holds the brute-force comparison
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        delete_on_exit(spark, path)
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
