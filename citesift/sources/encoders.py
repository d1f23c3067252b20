"""The weights of a fitted encoder, kept next to the index that was encoded with them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from citesift.operators.embedding import Encoder, IdfEncoder
from citesift.sources.index_store import saved_encoder

ENCODER_SCHEMA = "dim int, rarity array<double>"


def save_encoder(spark: SparkSession, encoder: IdfEncoder, index_path: str) -> str:
    """A new folder, whose name the index will carry: both become valid at once."""
    name = uuid.uuid4().hex
    row = spark.createDataFrame([(encoder.dim, encoder.rarity)], ENCODER_SCHEMA)
    row.coalesce(1).write.json(f"{index_path}.encoder/{name}")
    return name


def index_encoder(spark: SparkSession, encoder: Encoder, index_path: str) -> Encoder:
    """The encoder of a saved index: an unfitted one gets the saved weights, any other is taken as it is."""
    if not isinstance(encoder, IdfEncoder) or encoder.rarity is not None:
        return encoder
    name = saved_encoder(spark, index_path)
    if name is None:
        raise ValueError(f"{index_path} has no saved encoder: it was encoded by another one")
    saved = spark.read.schema(ENCODER_SCHEMA).json(f"{index_path}.encoder/{name}").first()
    if saved.dim != encoder.dim:
        raise ValueError(f"the encoder saved with {index_path} does not have {encoder.dim} buckets")
    return IdfEncoder(saved.dim, list(saved.rarity))
