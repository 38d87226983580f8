"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all text contracts, besides the blank: tab, line feed, vertical tab, form feed, carriage return.
OTHER_SPACE = "\t\n\v\f\r"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local master may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgermill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, read again.

    It cuts the lineage: what follows reads the files, whichever executors are lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(text: Column | str) -> Column:
    """The text with each run of white space replaced by one blank; null becomes empty."""
    one = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in OTHER_SPACE:  # a plain search each, where a character class costs ten times as much
        one = F.replace(one, F.lit(c), F.lit(" "))
    return F.regexp_replace(one, "  +", " ")


def word_count(text: Column | str) -> Column:
    """Number of runs of non-white characters, without building the words."""
    one = F.trim(plain(text))
    return (F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + (one != "").cast("int")).cast("long")
