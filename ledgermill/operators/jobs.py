"""A matching job that survives being killed: decided in batches, each a commit.

The job's requests are numbered once; a batch is the next ``size`` numbers, and its
results come in with the same commit that moves the job's mark.  So after a kill no
request is lost or decided twice, of two runners of one job the conflict of versions
lets only one commit each batch, and anyone may read progress or ask the job to stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators.statistics import numbered
from ledgermill.sources.versioned import Commit, Conflict, VersionedTables

KEYS = {"requests": ["place"], "results": [], "state": ["job"]}
_STATE = "job string, done long, total long, state string"


class MatchingJob:
    """The job in the folder ``path``; ``match`` gives (qid, ...) for some of its requests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, VersionedTables(spark, path, KEYS)

    def start(self, requests: DataFrame, order: str = "qid") -> MatchingJob:
        """Requests are decided in ``order``; starting a job that is there changes nothing."""
        if self.tables.latest() == 0:
            rows = numbered(requests, order, ())
            state = self.spark.createDataFrame([("job", 0, requests.count(), "running")], _STATE)
            self.tables.commit(Commit("start").replace("requests", rows).replace("state", state), 0)
        return self

    def progress(self) -> dict:
        """done, total and state: running, cancelled or done."""
        return self.tables.read("state").first().asDict()

    def cancel(self) -> None:
        """The runner stops before its next batch; ``resume`` lets it go on."""
        self._set("cancelled")

    def resume(self) -> None:
        self._set("running")

    def _set(self, state: str) -> None:
        at = self.tables.latest()
        now = self.tables.read("state", at)
        self.tables.commit(Commit(state).upsert("state", now.withColumn("state", F.when(F.col("state") == "done", "done").otherwise(state))), at)

    def run(self, match: Callable[[DataFrame], DataFrame], size: int = 1000) -> dict:
        """Decides batch after batch until all are done or the job is cancelled; goes on where an earlier run ended."""
        while (now := self.progress())["state"] == "running":
            at = self.tables.latest()
            if now["done"] >= now["total"]:
                self._set_done(at, now)
                continue
            batch = self.tables.read("requests", at).where(F.col("place").between(now["done"] + 1, now["done"] + size))
            results = match(batch.drop("place")).withColumn("batch", F.lit(now["done"] // size))
            done = min(now["done"] + size, now["total"])
            commit = Commit(f"batch to {done}").upsert("state", self.spark.createDataFrame([("job", done, now["total"], "running")], _STATE))
            held = self.tables.manifest(at)["tables"]
            try:
                self.tables.commit(commit.append("results", results) if "results" in held else commit.replace("results", results), at)
            except Conflict:
                continue  # cancelled, or another runner was faster: what was decided here does not count
        return self.progress()

    def _set_done(self, at: int, now: dict) -> None:
        self.tables.commit(Commit("done").upsert("state", self.spark.createDataFrame([("job", now["done"], now["total"], "done")], _STATE)), at)

    def results(self) -> DataFrame:
        return self.tables.read("results")
