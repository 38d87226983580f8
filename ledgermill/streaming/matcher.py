"""Matching of newly arriving requests against an indexed catalog, as a stream.

An addition to the batch pipelines: every micro-batch of requests runs the same
coverage search; postings and size of the catalog are read once and kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgermill.functions.text import tokenize
from ledgermill.operators import retrieval


def match_stream(requests: DataFrame, post: DataFrame, n_docs: int, path: str, checkpoint: str, k: int = 3, available_now: bool = True) -> StreamingQuery:
    """Appends (qid, id, score, rank, batch) to Parquet at ``path`` for each arriving (qid, text).

    A batch that is run again after a failure overwrites its own folder only.
    """

    def run(batch: DataFrame, number: int) -> None:
        asked = batch.select("qid", F.explode(F.array_distinct(tokenize("text"))).alias("token"))
        best = retrieval.top_k(retrieval.coverage(asked, post, n_docs), k)
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of (ts, status) per window and status, events later than ``late`` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n"))
