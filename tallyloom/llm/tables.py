"""Reading tables and keeping intermediates in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path: later reads neither compute them
    again nor depend on the executor that made them."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
