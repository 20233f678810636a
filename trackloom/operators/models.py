"""The pixel baseline: logistic regression over standardised features, in Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_baseline(rows: DataFrame, features: list[str], label: str, penalty: float = 1e-3, rounds: int = 100):
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=penalty, maxIter=rounds)]
    return Pipeline(stages=stages).fit(rows)


def predicted(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array(F.col("probability"))[1]).drop("_raw", "_x", "rawPrediction", "probability", "prediction")
