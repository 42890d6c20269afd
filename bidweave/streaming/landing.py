"""Items as they land: a stream without redeliveries, counted by window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.session import shared_folder


def read_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*")


def windowed(items: DataFrame, late: str = "60 days", width: str = "7 days") -> DataFrame:
    """Items by window of extraction and model. A redelivery has its record's number and extraction time, and is dropped
    while the watermark keeps the record."""
    once = items.withWatermark("extracted_at", late).dropDuplicatesWithinWatermark(["seq"])
    return once.groupBy(F.window("extracted_at", width).alias("w"), "model").agg(F.count("*").alias("items"), F.count_if(F.col("verification") == "missing").alias("missing"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what has landed so far and returns its result, written in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(base + "/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", base + "/check").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/out")
