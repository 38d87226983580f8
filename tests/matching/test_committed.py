"""Commits: all or nothing, conflicts, older versions, compaction."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgermill.operators.committed import Catalog
from ledgermill.plans.committed import changed_catalog  # noqa: F401  registers its queries
from ledgermill.plans.registry import ORACLES, QUERIES
from ledgermill.sources.versioned import Commit, Conflict, VersionedTables


def test_versions_of_a_table(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), {"a": ["k"], "b": ["k"]})
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert t.latest() == 0 and t.versions() == []
    assert t.commit(Commit("one").replace("a", rows((1, "x"), (2, "y"))).replace("b", rows((9, "z")))) == 1
    t.commit(Commit("two").upsert("a", rows((2, "Y"), (3, None))).delete("b", rows((9, ""))))
    t.commit(Commit("three").delete("a", rows((1, ""), (7, ""))))
    t.commit(Commit("four").upsert("a", rows((1, "again"))))
    state = lambda name, v=None: sorted(map(tuple, t.read(name, v).collect()))
    assert state("a", 1) == [(1, "x"), (2, "y")] and state("a", 2) == [(1, "x"), (2, "Y"), (3, None)]
    assert state("a", 3) == [(2, "Y"), (3, None)] and state("a") == [(1, "again"), (2, "Y"), (3, None)]
    assert state("b", 1) == [(9, "z")] and state("b") == []
    t.compact("a")
    assert state("a") == state("a", 4) and len(t.manifest(5)["tables"]["a"]["parts"]) == 1
    assert [n for _, n in t.history()] == ["one", "two", "three", "four", "compact a"]


def test_second_writer_is_refused(spark, tmp_path):
    keys = {"a": ["k"]}
    one, two = (VersionedTables(spark, str(tmp_path / "t"), keys) for _ in range(2))
    rows = spark.createDataFrame([(1, "x")], "k long, v string")
    one.commit(Commit().replace("a", rows))
    seen = two.latest()
    one.commit(Commit().upsert("a", rows.withColumn("v", F.lit("first"))))
    with pytest.raises(Conflict):
        two.commit(Commit().upsert("a", rows.withColumn("v", F.lit("second"))), seen)
    assert two.read("a").first()["v"] == "first" and two.versions() == [1, 2]


def test_a_failed_commit_shows_nothing(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), {"a": ["k"]})
    rows = spark.createDataFrame([(1, "x")], "k long, v string")
    t.commit(Commit().replace("a", rows))
    broken = rows.withColumn("v", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        t.commit(Commit().upsert("a", rows.withColumn("v", F.lit("y"))).upsert("a", broken))
    assert t.latest() == 1 and t.read("a").first()["v"] == "x"


def test_catalog_changes(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    kind = "id long, version_id int, code string, name string, brand string, model string, price double, active boolean"
    c.create(
        spark.createDataFrame([(1, 1, "A", "a", "b", "m", 1.0, True), (2, 1, "B", "b", None, None, 2.0, True), (3, 2, "A", "other", None, None, 3.0, True)], kind),
        spark.createDataFrame([(1, 7, True), (2, 7, False)], "version_id int, source_id int, is_current boolean"),
        spark.createDataFrame([(10, 1, 0.5), (11, 2, 0.6), (12, 3, 0.7)], "qid long, id long, score double"),
    )
    c.deactivate_missing(spark.createDataFrame([("A",)], "code string"), 1)
    assert {r["id"]: r["active"] for r in c.read("products").collect()} == {1: True, 2: False, 3: True}
    assert {r["qid"] for r in c.read("matches").collect()} == {10, 12}
    c.patch(spark.createDataFrame([(2,)], "id long"), price=F.lit(9.5))
    c.add_product(spark.createDataFrame([("H", "hand made", 4.0)], "code string, name string, price double"))
    c.replace_version(1, spark.createDataFrame([(1, 1, "A", "a2", None, None, 1.5, True), (8, 1, "C", "c", None, None, 1.0, True)], kind))
    c.set_current(2)
    assert {(r["id"], r["name"], r["version_id"]) for r in c.read("products").collect()} == {(1, "a2", 1), (8, "c", 1), (3, "other", 2)}
    assert {r["qid"] for r in c.read("matches").collect()} == {12}
    assert {r["version_id"]: r["is_current"] for r in c.read("versions").collect()} == {1: False, 2: True}
    assert {r["id"] for r in c.read("products", 1).collect()} == {1, 2, 3} and {r["price"] for r in c.read("products", 3).where("id = 2").collect()} == {9.5}
    assert c.read("products", 4).where("code = 'H'").first()["version_id"] == 1


def test_lists_keep_products_of_equal_number_apart(spark, tmp_path):
    """Parts from a million on have the numbers that the revised list gives to its new products."""
    c = duckdb.connect()
    parts = spark.range(1, 2_000_041).where("id % 1000000 between 1 and 40").select(F.col("id").alias("p_partkey"), (F.col("id") % 11).cast("int").alias("p_size"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("p_name"), F.col("id").cast("double").alias("p_retailprice"))
    lines = parts.select((F.col("p_partkey") + 5).alias("l_orderkey"), F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("l_linenumber"))
    for name, rows in (("part", parts), ("lineitem", lines)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("o198_committed_products", "o118_committed_versions", "o201_committed_matches"):
        got = QUERIES[name](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
