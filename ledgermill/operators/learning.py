"""Training pairs from decisions, features, the gradient-boosted match model and its comparison."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions.codes import price_difference
from ledgermill.operators.statistics import roc_auc

FEATURES = ["embedding", "keyword", "fuzzy", "price_difference", "price_available"]


def training_pairs(feedback: DataFrame) -> DataFrame:
    """(feedback_id, qid, id, rank, label) of shown candidates: 1 for the selected one.

    ``feedback``: (feedback_id, qid, selected, candidates array<struct<id, rank, score>>).
    """
    shown = feedback.select("feedback_id", "qid", "selected", F.explode("candidates").alias("c"))
    return shown.select("feedback_id", "qid", F.col("c.id").alias("id"), F.col("c.rank").alias("rank"), F.coalesce(F.col("c.id") == F.col("selected"), F.lit(False)).cast("int").alias("label"))


def features(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """``pairs`` (with price_a, price_b) with the five features; missing sub-scores count as 0."""
    d = price_difference(F.col("price_a"), F.col("price_b"))
    joined = pairs.join(scores.select("qid", "id", "embedding", "keyword", "fuzzy"), ["qid", "id"], "left").fillna(0.0, ["embedding", "keyword", "fuzzy"])
    return joined.withColumns({"price_difference": d["diff"], "price_available": d["available"]})


def stratified_split(rows: DataFrame, key: str, label: str = "label", test: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``is_test``: a fixed share of each label by a seeded hash of the key."""
    order = Window.partitionBy(label).orderBy("__cell")
    cells = rows.withColumn("__cell", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)))
    counts = cells.groupBy(label, "__cell").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(order))
    cut = counts.join(counts.groupBy(label).agg(F.sum("n").alias("all")), label).where(F.col("upto") <= F.col("all") * F.lit(test)).groupBy(label).agg(F.max("__cell").alias("cut"))
    return cells.join(F.broadcast(cut), label, "left").withColumn("is_test", F.coalesce(F.col("__cell") <= F.col("cut"), F.lit(False))).drop("__cell", "cut")


def train(rows: DataFrame, label: str = "label", columns: list[str] | None = None):
    """100 boosted trees of depth 3, seed 42."""
    made = VectorAssembler(inputCols=columns or FEATURES, outputCol="features").transform(rows)
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=100, maxDepth=3, seed=42).fit(made)


def predict(model, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    made = VectorAssembler(inputCols=columns or FEATURES, outputCol="features").transform(rows)
    return model.transform(made).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def compare(rows: DataFrame, baseline: str, gain: float = 0.02, least: int = 500, columns: list[str] | None = None, key: str = "id") -> dict:
    """AUC of the model against a baseline column on the test part, and whether the model earns its place.

    Ends early, with the reason, on too few rows, one class only, or a part without both classes.
    """
    n, classes = rows.count(), {r["label"] for r in rows.select("label").distinct().collect()}
    if n < least:
        return {"reason": "not enough pairs", "deploy": False}
    if len(classes) < 2:
        return {"reason": "one class only", "deploy": False}
    split = stratified_split(rows, key)
    test = split.where("is_test")
    parts = {(r["is_test"], r["label"]) for r in split.select("is_test", "label").distinct().collect()}
    if len(parts) < 4:
        return {"reason": "a part lacks a class", "deploy": False}
    scored = predict(train(split.where("not is_test"), columns=columns), test, columns)
    ours, theirs = roc_auc(scored, "label", "probability").first()["auc"], roc_auc(test, "label", baseline).first()["auc"]
    return {"model_auc": ours, "baseline_auc": theirs, "deploy": ours - theirs >= gain, "reason": "compared"}
