"""Scratch tables dealt into buckets by a key, so that later joins on the key move no row of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm.shared import shared_dir


class Buckets:
    """Tables in the shared folder, dealt by ``key`` into ``number`` buckets.

    The session's catalog knows the tables by scratch names until ``close``; their files
    stay in the shared folder like those of all other scratch tables.
    """

    def __init__(self, spark: SparkSession, number: int, key: str):
        self.spark, self.number, self.key, self.names = spark, number, key, []

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The table with its buckets, and as plain files, which outlive the entry of the catalog."""
        path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        self.names.append(f"scratch_{uuid.uuid4().hex}")
        df.write.format("parquet").option("compression", "zstd").bucketBy(self.number, self.key).option("path", path).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1]), self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay
