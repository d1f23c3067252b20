"""Saving and loading trained rankers and routers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_setting(spark: SparkSession, setting: dict, path: str) -> None:
    """Keep the tuned setting of a model next to it, as one JSON row."""
    spark.createDataFrame([setting]).coalesce(1).write.mode("overwrite").json(f"{path}.setting")


def load_setting(spark: SparkSession, path: str, schema: str) -> dict:
    return spark.read.schema(schema).json(f"{path}.setting").first().asDict()
