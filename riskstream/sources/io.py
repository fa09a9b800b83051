"""A1, A5 helpers: labelled transactions as CSV (declared schema, no
inference) and parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# Training CSV layout (header row).
TRAIN_CSV_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("channel", T.StringType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
])


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: labelled transactions with a declared schema (CSV or parquet);
    adds ``us`` (epoch micros)."""
    if fmt == "csv":
        d = (spark.read.schema(TRAIN_CSV_SCHEMA).option("header", True)
             .option("timestampFormat", TS_FORMAT).csv(path))
    else:
        d = spark.read.parquet(path)
    return d.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))


def write_transactions_csv(txn: DataFrame, path: str) -> None:
    """Write transactions in the training CSV layout."""
    d = txn.withColumn("timestamp", F.timestamp_micros("us"))
    d.select(*[f.name for f in TRAIN_CSV_SCHEMA.fields]).write.mode("overwrite") \
     .option("header", True).option("timestampFormat", TS_FORMAT).csv(path)
