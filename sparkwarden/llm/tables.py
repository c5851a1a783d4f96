"""Reading input tables and cutting lineage with written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.session import shared_dir

# Rows and bytes of one Arrow batch between the JVM and Python: very long texts
# come in batches that fit a worker.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounded Arrow batches for the Python stages that this session plans from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to a fresh folder in the shared checkpoint directory and read back.

    Ends the lineage there: a lost executor costs the stages after the table only.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
