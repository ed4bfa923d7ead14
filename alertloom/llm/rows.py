"""Row identity for tables whose ids may repeat or be null."""

from pyspark.sql import DataFrame, functions as F

from alertloom.session import cut_lineage


def with_row_ids(df: DataFrame) -> DataFrame:
    """``df`` with a unique ``_row``, written to the shared folder so that every later read sees the same ids."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
