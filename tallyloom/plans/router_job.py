"""The question router as one job: fit both heads, store them, score, choose thresholds, route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import models, router


@dataclass
class RouterJob:
    """Models and tables live under ``root``. The answerability head is fitted on labelled questions, the metric head on
    the answerable ones; thresholds are chosen on the held-out part alone."""

    spark: SparkSession
    root: str

    def fit(self, rows: DataFrame, key: str = "message_id") -> None:
        """``rows``: key, question, label, target_metric and the nine features. Writes the models and the split."""
        split = router.stratified_split(rows, "label", key)
        train, _ = models.parts(split)
        features = models.TextFeatures().fit(train)
        features.save(f"{self.root}/features")
        ready = features.transform(train)
        models.Head("label").fit(ready).save(f"{self.root}/answerable")
        targets = ready.where(F.col("label") == "answerable")
        if models.enough_targets(targets, "target_metric"):
            models.Head("target_metric").fit(targets).save(f"{self.root}/metric")
        split.select(key, "part").write.mode("overwrite").parquet(f"{self.root}/split")

    def _metric_head(self) -> models.Head | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/metric")
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return models.Head.load(f"{self.root}/metric", "target_metric") if there else None

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows with ``p_answerable`` and ``metrics`` of the stored heads."""
        ready = models.TextFeatures.load(self.spark, f"{self.root}/features").transform(rows)
        first = models.Head.load(f"{self.root}/answerable", "label").predict(ready).drop("predicted")
        chance = F.filter("metrics", lambda m: m["name"] == "answerable")
        first = first.withColumn("p_answerable", F.coalesce(F.get(chance, 0)["p"], F.lit(0.0))).drop("metrics")
        head = self._metric_head()
        second = head.predict(first).drop("predicted") if head else first.withColumn("metrics", F.expr("cast(array() as array<struct<name:string,p:double>>)"))
        return second.drop("features")

    def run(self, rows: DataFrame, poison: DataFrame, key: str = "message_id") -> tuple[DataFrame, DataFrame]:
        """(thresholds, routed): scores are stored once; the sweep reads their held-out part, the decisions all."""
        self.score(rows).write.mode("overwrite").parquet(f"{self.root}/scored")
        scored = self.spark.read.parquet(f"{self.root}/scored")
        held = scored.join(self.spark.read.parquet(f"{self.root}/split").where(F.col("part") != "train"), key, "left_semi")
        chosen = router.chosen_thresholds(router.threshold_sweep(held.select("label", "p_answerable")))
        low, high = chosen.first()
        return chosen, router.route(scored.join(poison, key, "left"), low, high)
