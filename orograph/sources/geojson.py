"""GeoJSON and record files as tables, and tables as GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "type string, properties map<string,string>, geometry string"


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: (file, properties, kind, geometry as JSON).

    A file may hold a collection, one feature or a bare geometry.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("doc"))
    kind = F.get_json_object("doc", "$.type")
    many = F.from_json(F.get_json_object("doc", "$.features"), "array<string>")
    rows = raw.withColumn("feature", F.explode(F.when(kind == "FeatureCollection", many).when(kind == "Feature", F.array("doc")).otherwise(F.array(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), "doc", F.lit("}"))))))
    parsed = rows.select("file", F.from_json("feature", _FEATURE).alias("f"), "feature")
    geometry = F.get_json_object("feature", "$.geometry")
    return parsed.select("file", F.col("f.properties").alias("properties"), F.get_json_object(geometry, "$.type").alias("kind"), geometry.alias("geometry")).where("geometry is not null")


def roads(features: DataFrame, factors: dict[str, float], default: float = 1.2) -> DataFrame:
    """Line features with their class and speed factor.

    Fixed values: the properties that may hold the class, in this order, and the factor of a class without one.
    """
    name = F.lower(F.coalesce(*(F.nullif(F.try_element_at("properties", F.lit(k)), F.lit("")) for k in ("class", "road_class", "highway")), F.lit("")))
    table = F.create_map(*(F.lit(x) for kv in factors.items() for x in kv)) if factors else F.lit(None).cast("map<string,double>")
    lines = features.where(F.col("kind").isin("LineString", "MultiLineString"))
    return lines.select("file", name.alias("road_class"), F.coalesce(F.try_element_at(table, name), F.lit(default)).alias("factor"), "geometry")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON record files, one record each; those that can't be parsed keep their text in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def point_feature(x: Column, y: Column, properties: Column) -> Column:
    """A point feature as JSON text; ``properties`` is a struct."""
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), x.cast("string"), F.lit(","), y.cast("string"), F.lit(']},"properties":'), F.to_json(properties), F.lit("}"))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features, refusing to overwrite; Spark's commit makes the folder whole or absent."""
    features.write.mode("errorifexists").text(path)


def write_masks(masks: DataFrame, path: str) -> None:
    """Masks of stations, a folder each, so that one station's are read alone."""
    masks.repartition("station_id").write.partitionBy("station_id").mode("errorifexists").parquet(path)


def masks_of(spark: SparkSession, path: str, station: int) -> DataFrame:
    """The stored masks of one station; other stations' files are not read."""
    return spark.read.parquet(path).where(F.col("station_id") == station)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
