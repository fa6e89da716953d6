"""GeoJSON FeatureCollection reader (Polygon features).

Read with one explicit schema: schema inference drops ``properties`` when a
file's properties are all empty, and would type numeric style values
differently per file.  Properties are a ``map<string,string>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RING = T.ArrayType(T.ArrayType(T.DoubleType()))
FEATURE_COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.ArrayType(RING)),
        ])),
    ]))),
])


def read_feature_collections(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per file: ``source`` (file name) and the parsed collection."""
    from pyspark.sql import functions as F

    return (spark.read.schema(FEATURE_COLLECTION).option("multiLine", True).json(list(paths))
            .withColumn("source", F.input_file_name()))
