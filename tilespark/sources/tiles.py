"""Baked tiles and their manifest on disk.

A layer is a Parquet table partitioned by level and tile, so that a viewport reads the files of its tiles at one level only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import LAYERS
from ..schema import MAP_INDEX
from .store import file_system, put_file


def region_path(root: str, region: str) -> str:
    return f"{root}/map/{region}"


def layer_path(root: str, region: str, layer: str) -> str:
    return f"{region_path(root, region)}/tiles/{layer}"


def index_path(root: str, region: str) -> str:
    return f"{region_path(root, region)}/index.json"


def draft_path(root: str, region: str) -> str:
    """A new folder beside the tiles, on the same store, for what one run needs only."""
    return f"{region_path(root, region)}/_draft-{uuid.uuid4().hex}"


def write_layers(layers: dict[str, DataFrame], root: str, region: str) -> None:
    """Write all layers; tiles that are not among the rows stay as they are. Rows of a tile and level go to few files: the
    hint lets Spark part a tile that is large and put small ones into one task, which a plain repartition does not."""
    for name in LAYERS:
        rows = layers[name].hint("rebalance", "lod", "tile_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1_000_000).partitionBy("lod", "tile_id").parquet(layer_path(root, region, name))


def read_layer(spark: SparkSession, root: str, region: str, layer: str) -> DataFrame:
    rows = spark.read.parquet(layer_path(root, region, layer))
    return rows.withColumn("tile_id", F.col("tile_id").cast("bigint"))


def baked_entities(spark: SparkSession, root: str, region: str) -> DataFrame:
    """(tile_id, lod, layer, bytes_file, bytes) of every stored feature; bytes are those of its file."""
    out = None
    for name in LAYERS:
        rows = spark.read.parquet(layer_path(root, region, name)).select(
            F.col("tile_id").cast("bigint").alias("tile_id"), "lod", F.lit(name).alias("layer"), F.col("_metadata.file_path").alias("bytes_file"), F.col("_metadata.file_size").alias("bytes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def tile_sizes(entities: DataFrame) -> DataFrame:
    """(tile_id, file_size_bytes) over all layers and levels."""
    return entities.select("tile_id", "bytes_file", "bytes").distinct().groupBy("tile_id").agg(F.sum("bytes").alias("file_size_bytes"))


def write_index(index: DataFrame, root: str, region: str) -> str:
    """The one-row index as pretty JSON, put in place at once."""
    path = index_path(root, region)
    document = json.loads(index.select(F.to_json(F.struct(*index.columns), {"ignoreNullFields": "false"})).first()[0])
    put_file(index.sparkSession, path, json.dumps(document, indent=2).encode())
    return path


def index_rows(spark: SparkSession, root: str, region: str) -> DataFrame | None:
    """The tiles of the index, a row each; null if there is no index. One that cannot be read is an error."""
    target, store = file_system(spark, index_path(root, region))
    if not store.exists(target):
        return None
    return spark.read.schema(MAP_INDEX).option("mode", "FAILFAST").json(index_path(root, region), multiLine=True).select(F.explode("tiles").alias("t")).select("t.*")


def read_index(spark: SparkSession, root: str, region: str) -> DataFrame:
    return spark.read.schema(MAP_INDEX).json(index_path(root, region), multiLine=True)
