"""Spark ML models: question quality, two-headed router, propensity; and the revenue forecast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import NGram, RegexTokenizer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.router import FEATURES, stratified_split
from tallyloom.session import write_and_read

SEED = 42


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Class weights n / (classes * class size); the counts are one row per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    total = counts.agg(F.struct(F.sum("_k").alias("n"), F.count(F.lit(1)).alias("c"))).scalar()
    weights = counts.select(label, F.try_divide(total["n"], total["c"] * F.col("_k")).alias("weight"))
    return rows.join(weights, label)


def sendable(model: PipelineModel) -> PipelineModel:
    """Without the summaries of the training: they hold the session, and one that has observed a write cannot go to tasks."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def quality_model(featured: DataFrame) -> PipelineModel:
    """Balanced logistic regression on the nine features; ``label`` is answerable or noise."""
    rows = balanced(featured.withColumn("y", (F.col("label") == "answerable").cast("double")), "y")
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        LogisticRegression(labelCol="y", weightCol="weight", maxIter=100, regParam=0.01),
    ]
    return sendable(Pipeline(stages=stages).fit(rows))


def p_answerable(model: PipelineModel, featured: DataFrame) -> DataFrame:
    scored = model.transform(featured)
    return scored.withColumn("p_answerable", F.round(vector_to_array("probability")[1], 4))


WIDTH = 1 << 16  # columns of the text part, whatever the vocabulary; grams that hash alike share one
TREE_COLUMNS = 256  # text columns a tree may split on: those the linear model weighs most


def with_terms(rows: DataFrame) -> DataFrame:
    """Words of two letters or more and their pairs."""
    words = RegexTokenizer(inputCol="question", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    out = pairs.transform(words.transform(rows))
    return out.withColumn("terms", F.concat("words", "pairs")).drop("words", "pairs")


def gram_column(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(WIDTH)).cast("int")


def gram_table(rows: DataFrame) -> DataFrame:
    """(gram, column, df): every gram of the questions with the number of questions that hold it. A gram of all
    questions is counted in each task before it is shuffled."""
    grams = with_terms(rows).select(F.explode(F.array_distinct("terms")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).select("gram", gram_column(F.col("gram")).alias("column"), "df")


def gram_weights(rows: DataFrame, key: str, table: DataFrame, questions: Column) -> DataFrame:
    """(key, gram, tf, weight), one row for each gram of a question that the table knows.

    The weight is (1 + ln tf) * (1 + ln((1 + n) / (1 + df))), divided by the length of the question's vector; n, the
    number of questions the table was counted from, is a one-row value. A frequent gram is one row of the table, so
    adaptive execution splits the side of the questions; the sums of a question are as many as it has grams.
    """
    counted = with_terms(rows).select(key, F.explode("terms").alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    raw = (1 + F.ln("tf")) * (1 + F.ln((1 + questions) / (1 + F.col("df"))))
    weighted = counted.join(table.select("gram", "df"), "gram").select(key, "gram", "tf", raw.alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "gram", "tf", (F.col("raw") / length).alias("weight"))


class TextFeatures:
    """Word 1-2-gram counts, damped to 1 + ln(tf), weighted by IDF and brought to length one, next to the nine features.

    Grams are hashed into ``WIDTH`` columns, so neither the driver nor a row holds a vocabulary: the fit brings one
    number for each column to the driver, and the grams themselves stay a table, by which columns get their names.
    Vectors are built sparse, without a shuffle. The smoothed IDF is that of ``gram_weights``; the two differ only
    where grams of one question share a column.
    """

    def fit(self, featured: DataFrame) -> TextFeatures:
        self.grams = write_and_read(gram_table(featured), "grams")
        columns = with_terms(featured).select(F.explode(F.array_distinct(F.transform("terms", gram_column))).alias("column"))
        held = columns.groupBy("column").agg(F.count(F.lit(1)).alias("df")).toPandas()  # at most WIDTH rows
        self._weigh(featured.count(), held)
        return self

    def _weigh(self, questions: int, held: pd.DataFrame) -> None:
        self.questions, self.held = questions, held.sort_values("column")
        df = np.zeros(WIDTH)
        df[held["column"].to_numpy()] = held["df"].to_numpy()
        self.idf = 1 + np.log((1 + questions) / (1 + df))

    def transform(self, featured: DataFrame) -> DataFrame:
        idf = featured.sparkSession.sparkContext.broadcast(self.idf)  # half a megabyte

        @F.pandas_udf(VectorUDT())
        def vector(columns: pd.Series) -> pd.DataFrame:
            indices, values = [], []
            for one in columns:
                at, tf = np.unique(np.asarray(one, np.int32), return_counts=True)
                weights = (1 + np.log(tf)) * idf.value[at]
                indices.append(at)
                values.append(weights / (np.sqrt((weights * weights).sum()) or 1.0))
            return pd.DataFrame({"type": np.zeros(len(columns), np.int8), "size": np.full(len(columns), WIDTH, np.int32), "indices": indices, "values": values})

        ready = with_terms(featured).withColumn("tfidf", vector(F.transform("terms", gram_column)))
        return VectorAssembler(inputCols=["tfidf", *FEATURES], outputCol="features").transform(ready).drop("terms", "tfidf")

    def save(self, path: str) -> None:
        spark = self.grams.sparkSession
        self.grams.write.mode("overwrite").parquet(f"{path}/grams")
        spark.createDataFrame(self.held, "column INT, df BIGINT").write.mode("overwrite").parquet(f"{path}/columns")
        spark.createDataFrame([(self.questions,)], "questions BIGINT").write.mode("overwrite").parquet(f"{path}/size")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextFeatures:
        out = cls()
        out.grams = spark.read.parquet(f"{path}/grams")
        out._weigh(spark.read.parquet(f"{path}/size").first()[0], spark.read.parquet(f"{path}/columns").toPandas())
        return out


class Head:
    """One classifier over the text features."""

    def __init__(self, label: str, trees: bool = False):
        self.label = label
        self.trees = trees

    def fit(self, rows: DataFrame) -> Head:
        self.index = StringIndexer(inputCol=self.label, outputCol="y", stringOrderType="alphabetAsc").fit(rows)
        indexed = balanced(self.index.transform(rows), "y")
        linear = LogisticRegression(labelCol="y", weightCol="weight", maxIter=100, regParam=0.01, family="multinomial")
        self.model = linear.fit(indexed)
        if self.trees:
            size = self.model.numFeatures
            strength = np.abs(self._coefficients()).max(axis=0)
            strength[size - len(FEATURES) :] = np.inf  # the nine features always take part
            best = np.sort(np.lexsort((np.arange(size), -strength))[: TREE_COLUMNS + len(FEATURES)])
            self.slicer = VectorSlicer(inputCol="features", outputCol="sliced", indices=best.tolist())
            boosted = GBTClassifier(labelCol="y", weightCol="weight", featuresCol="sliced", maxIter=10, maxDepth=3, seed=SEED)
            self.model = boosted.fit(self.slicer.transform(indexed))
        return self

    def save(self, path: str) -> None:
        self.index.write().overwrite().save(f"{path}/index")
        self.model.write().overwrite().save(f"{path}/model")
        if self.trees:
            self.slicer.write().overwrite().save(f"{path}/slicer")

    @classmethod
    def load(cls, path: str, label: str, trees: bool = False) -> Head:
        out = cls(label, trees)
        out.index = StringIndexerModel.load(f"{path}/index")
        out.model = (GBTClassificationModel if trees else LogisticRegressionModel).load(f"{path}/model")
        if trees:
            out.slicer = VectorSlicer.load(f"{path}/slicer")
        return out

    def _coefficients(self) -> np.ndarray:
        return self.model.coefficientMatrix.toArray()  # classes x (WIDTH + 9), whatever the rows

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``predicted`` and ``metrics`` (array of struct(name, p) over the classes)."""
        classes = list(self.index.labels)
        names = F.array(*[F.lit(c) for c in classes])
        scored = self.model.transform(self.slicer.transform(rows) if self.trees else rows)
        pairs = F.zip_with(names, vector_to_array("probability"), lambda n, p: F.struct(n.alias("name"), p.alias("p")))
        return scored.withColumns(
            {"predicted": F.element_at(names, F.col("prediction").cast("int") + 1), "metrics": pairs}
        ).drop("rawPrediction", "probability", "prediction", "sliced")

    def top_coefficients(self, features: TextFeatures, n: int = 5) -> DataFrame:
        """(class, place, feature, coefficient): the strongest features per class, ties by name.

        A text column is called by its most frequent gram. A class brings as many columns to the driver as could be
        among its first ``n`` (those at least as strong as the n-th); the names come from the table of grams.
        """
        matrix = self._coefficients()
        used = np.concatenate([np.isin(np.arange(WIDTH), self._columns(features)), np.ones(len(FEATURES), bool)])
        cells = []
        for c, weights in zip(self.index.labels, matrix):
            able = np.where(used, weights, -np.inf)
            for i in np.flatnonzero(able >= np.sort(able)[-min(n, int(used.sum()))]).tolist():
                cells.append((c, i, f"feature:{FEATURES[i - WIDTH]}" if i >= WIDTH else None, round(float(weights[i]), 6)))
        strong = features.grams.sparkSession.createDataFrame(cells, "class STRING, column INT, name STRING, coefficient DOUBLE")
        called = features.grams.groupBy("column").agg(F.min_by("gram", F.struct(-F.col("df"), "gram")).alias("gram"))
        named = strong.join(called, "column", "left").select("class", F.coalesce("name", F.concat(F.lit("term:"), "gram")).alias("feature"), "coefficient")
        place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("coefficient"), "feature"))
        return named.select("class", place.alias("place"), "feature", "coefficient").where(F.col("place") <= n)

    @staticmethod
    def _columns(features: TextFeatures) -> np.ndarray:
        return features.held["column"].to_numpy()


def enough_targets(rows: DataFrame, label: str, min_rows: int = 5) -> bool:
    n, classes = rows.agg(F.count(F.lit(1)), F.countDistinct(label)).first()
    return n >= min_rows and classes >= 2


def parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.where(F.col("part") != "eval"), split.where(F.col("part") != "train")


def propensity(rfm: DataFrame, min_rows: int = 20) -> DataFrame:
    """Repeat-buyer model on recency and spend (frequency defines the label, so it is left out). One
    row: rows, buyers, test AUC; the AUC is NULL when there is too little data or one class."""
    rows = rfm.dropna(subset=["recency_days", "frequency", "monetary"]).select(
        F.concat_ws("|", "customer_id", "country").alias("row_key"),
        F.col("recency_days").cast("double").alias("recency_days"),
        F.col("monetary").cast("double").alias("monetary"),
        (F.col("frequency") > 1).cast("int").alias("label"),
    )
    spark = rfm.sparkSession
    shape = "rows BIGINT, repeat_buyers BIGINT, auc DOUBLE"
    split = stratified_split(rows, "label", "row_key")
    n, buyers, classes = split.agg(F.count(F.lit(1)), F.sum("label"), F.countDistinct("label")).first()
    if n < min_rows or classes < 2:
        return spark.createDataFrame([(n, buyers, None)], shape)
    train, test = parts(split)
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=["recency_days", "monetary"], outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(maxIter=100),
        ]
    ).fit(train)
    auc = BinaryClassificationEvaluator().evaluate(sendable(model).transform(test))
    return spark.createDataFrame([(n, buyers, round(float(auc), 4))], shape)


def forecast(daily: DataFrame, horizon: int = 28, band: float = 1.96) -> DataFrame:
    """Daily revenue for the next days: linear trend, weekday offset, and a band of the residual
    deviation. The daily table has one row per calendar day, and the trend is one aggregate row used
    through scalar subqueries. It is written out first because several of them read it."""
    daily = write_and_read(daily.select("sale_date", "net_revenue"), "daily")
    first = daily.agg(F.min("sale_date")).scalar()
    y = F.col("net_revenue").cast("double")
    x = F.datediff("sale_date", first).cast("double")
    points = daily.select("sale_date", y.alias("y"), x.alias("x"), F.dayofweek("sale_date").alias("dow"))
    line = points.agg(
        F.struct(
            F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"), F.max("sale_date").alias("last")
        )
    ).scalar()
    rest = points.select("dow", (F.col("y") - (line["base"] + line["slope"] * F.col("x"))).alias("r"))
    offsets = rest.groupBy("dow").agg(F.avg("r").alias("shift"), F.sum(F.col("r") * F.col("r")).alias("ss"), F.count("r").alias("n"))
    # squared residuals around the weekday means: sum(r^2) - n * mean^2 per weekday
    spread = offsets.agg(
        F.sqrt(F.try_divide(F.sum(F.col("ss") - F.col("n") * F.col("shift") * F.col("shift")), F.sum("n")))
    ).scalar()
    days = daily.agg(F.max("sale_date").alias("last"), F.min("sale_date").alias("first")).select(
        "first", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("ds")
    )
    value = line["base"] + line["slope"] * F.datediff("ds", "first").cast("double") + F.coalesce("shift", F.lit(0.0))
    return (
        days.withColumn("dow", F.dayofweek("ds"))
        .join(offsets.select("dow", "shift"), "dow", "left")
        .select(
            "ds",
            F.round(value, 2).alias("revenue_forecast"),
            F.round(value - band * spread, 2).alias("revenue_lower"),
            F.round(value + band * spread, 2).alias("revenue_upper"),
        )
    )
