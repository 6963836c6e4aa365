"""Readers by file extension, and of feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collections import features_in

FEATURE = "type string, geometry string, properties map<string,string>"


#: Given as the properties' names, all of them become columns of their own types.
ALL = "all"


def property_types(lines: DataFrame) -> dict[str, str]:
    """Name to type of the properties of features (value), in the order of names, from all lines.

    The types of a name's values are merged by an aggregate: whole numbers are
    bigint, with other numbers double, true and false boolean; all else, mixed
    and nested values too, is a string, as is a name whose values are all null.
    A row a name reaches the driver.
    """
    spark = lines.sparkSession
    found = lines.select(F.expr("variant_get(try_parse_json(value), '$.properties', 'variant')").alias("p")).filter("p IS NOT NULL")
    each = found.lateralJoin(spark.tvf.variant_explode(F.col("p").outer())).filter("key IS NOT NULL")
    merged = each.groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind")).collect()
    kinds = (("BIGINT", "bigint"), ("DECIMAL", "double"), ("DOUBLE", "double"), ("FLOAT", "double"), ("BOOLEAN", "boolean"))
    return {r.key: next((k for x, k in kinds if r.kind.startswith(x)), "string") for r in sorted(merged, key=lambda r: r.key)}


def read_geojson_lines(spark: SparkSession, path: str, properties: list[str] | str | None = None) -> DataFrame:
    """One feature a line: geometry as GeoJSON text, and properties as a map of strings, as string columns where named, or, for ALL, each as a column of its type.

    Blank lines are skipped. A property called geometry gets underscores.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", FEATURE).alias("f"))
    if properties is None:
        return rows.select("f.geometry", "f.properties")
    if properties != ALL:
        return rows.select("f.geometry", *[F.col("f.properties")[p].alias(p) for p in properties])
    types, taken, out = property_types(lines), {"geometry"}, []
    for name, kind in types.items():
        shown = name
        while shown.lower() in taken:
            shown += "_"
        taken.add(shown.lower())
        out.append(F.try_element_at(F.col("f.properties"), F.lit(name)).try_cast(kind).alias(shown))
    return rows.select("f.geometry", *out)


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature of FeatureCollections of any size: the feature as JSON text, and its file."""
    return features_in(spark, path).select("file", "feature")


def features_of(document: Column) -> Column:
    """The features of a document, each as JSON text."""
    return F.from_json(document, "features array<string>")["features"]


def collection_to_lines(spark: SparkSession, path: str, target: str) -> None:
    """Writes the features of documents one a line."""
    read_feature_collection(spark, path).select("feature").write.mode("overwrite").text(target)


def lines_name(file: Column) -> Column:
    """The name of the file of lines made from a document."""
    return F.regexp_replace(file, r"\.geojson$", "_ndjson.json")


def collections_to_lines(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """All .geojson documents of a folder as lines, in one folder for each name; returns (file, lines_file, features), counted from the lines that were written.

    A folder with a name of that kind holds documents of that name, as Spark writes them. A document without features has no lines.
    """
    named = F.regexp_extract("path", r"([^/=]+\.geojson)(?:/[^/]*)?$", 1)
    rows = features_in(spark, f"{folder}/*.geojson").select(named.alias("name"), "feature")
    rows.select(lines_name(F.col("name")).alias("lines_file"), "feature").write.mode("overwrite").partitionBy("lines_file").text(target)
    lines = spark.read.schema("value string, lines_file string").text(target)
    return lines.groupBy("lines_file").agg(F.count("*").alias("features")).select(F.regexp_replace("lines_file", r"_ndjson\.json$", ".geojson").alias("file"), "lines_file", "features")


def read_by_extension(spark: SparkSession, path: str, header: bool = True, properties: list[str] | str | None = None) -> DataFrame:
    """GeoJSON lines (with the named properties, or all, as columns), Parquet or CSV by the lower-cased extension; anything else is a ValueError."""
    low = path.lower().rstrip("/")
    if low.endswith((".json", ".geojson")):
        return read_geojson_lines(spark, path, properties)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".csv"):
        return spark.read.csv(path, header=header)
    raise ValueError(f"unsupported file type: {path}")


def geometry_column(df: DataFrame) -> str:
    """The first column named geometry in any case."""
    for c in df.columns:
        if c.lower() == "geometry":
            return c
    raise ValueError("No geometry column found")
