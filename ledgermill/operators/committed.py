"""Catalog maintenance as commits: products, versions and matches of a source change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators import catalog, workflow
from ledgermill.sources.versioned import Commit, VersionedTables

KEYS = {"products": ["id"], "versions": ["version_id"], "matches": ["qid", "id"]}


class Catalog:
    """(id, version_id, code, name, brand, model, price, active), (version_id, source_id, is_current), (qid, id, score).

    Every change names the version it was made of (the latest when the object was made
    or last changed), so of two writers that started from one version the second is
    refused with ``Conflict``; ``refresh`` takes up the other's changes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.tables = VersionedTables(spark, path, KEYS)
        self.version = self.tables.latest()

    def refresh(self) -> Catalog:
        self.version = self.tables.latest()
        return self

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.tables.read(table, self.version if version is None else version)

    def _commit(self, commit: Commit) -> int:
        self.version = self.tables.commit(commit, self.version)
        return self.version

    def create(self, products: DataFrame, versions: DataFrame, matches: DataFrame) -> int:
        return self._commit(Commit("create").replace("products", products).replace("versions", versions).replace("matches", matches))

    def _changed(self, rows: DataFrame) -> DataFrame:
        """Of ``rows`` of products those that differ from what is stored."""
        return rows.select(*self.read("products").columns).exceptAll(self.read("products"))

    def merge(self, incoming: DataFrame, version_id: int) -> int:
        """A revised list (id, code, name, price) of a version: matched rows take its values and become active, new ones come in."""
        old = self.read("products").where(F.col("version_id") == version_id)
        done = catalog.merge_revision(old, incoming.withColumn("active", F.lit(True))).where("outcome <> 'unmatched_existing'")
        known = old.select("id", "code", "brand", "model")
        fresh = incoming.select("id", F.col("code").alias("new_code"))
        rows = done.join(known, "id", "left").join(fresh, "id", "left")
        rows = rows.select("id", F.lit(version_id).alias("version_id"), F.coalesce("code", "new_code").alias("code"), "name", "brand", "model", "price", "active")
        return self._commit(Commit("merge").upsert("products", self._typed(rows)))

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.read("products").schema])

    def set_active(self, ids: DataFrame, active: bool) -> int:
        """Soft delete or restore."""
        rows = self.read("products").join(ids, "id", "left_semi").withColumn("active", F.lit(active))
        return self._commit(Commit("set active").upsert("products", self._changed(rows)))

    def deactivate_missing(self, incoming: DataFrame, version_id: int) -> int:
        """Products of a version whose code the list (code) lacks become inactive, and matches to them go."""
        gone = self.read("products").where(F.col("version_id") == version_id).join(incoming.select("code").distinct(), "code", "left_anti")
        rows = gone.where("active").withColumn("active", F.lit(False))
        lost = self.read("matches").join(gone.select("id"), "id", "left_semi")
        return self._commit(Commit("deactivate missing").upsert("products", self._typed(rows)).delete("matches", lost))

    def patch(self, ids: DataFrame, **values: Column) -> int:
        """New values of columns for the products ``ids``."""
        rows = self.read("products").join(ids, "id", "left_semi").withColumns(values)
        return self._commit(Commit("patch").upsert("products", self._changed(self._typed(rows))))

    def replace_version(self, version_id: int, incoming: DataFrame) -> int:
        """The version's products are ``incoming``; those it had before go together with all matches to them."""
        old = self.read("products").where(F.col("version_id") == version_id).select("id")
        lost = self.read("matches").join(old, "id", "left_semi")
        change = Commit("replace version").delete("products", old.join(incoming.select("id"), "id", "left_anti")).delete("matches", lost)
        return self._commit(change.upsert("products", self._typed(incoming.withColumn("version_id", F.lit(version_id)))))

    def set_current(self, version_id: int) -> int:
        """Exactly one current version in the source of ``version_id``."""
        rows = workflow.set_current(self.read("versions"), version_id).select(*self.read("versions").columns)
        return self._commit(Commit("set current").upsert("versions", rows.exceptAll(self.read("versions"))))

    def add_product(self, product: DataFrame) -> int:
        """A product added by hand joins the newest current version of the catalog; one row (code, name, price)."""
        held = self.read("products").agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
        home = self.read("versions").where("is_current").agg(F.max("version_id").alias("version_id"))
        rows = product.crossJoin(held).crossJoin(home)  # single rows
        rows = rows.select((F.col("last") + 1).alias("id"), "version_id", "code", "name", F.lit(None).alias("brand"), F.lit(None).alias("model"), "price", F.lit(True).alias("active"))
        return self._commit(Commit("add product").upsert("products", self._typed(rows)))
