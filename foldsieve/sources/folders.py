"""Image folders: labelled by folder name, or plain; bytes, sizes and decoded pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsieve.functions import scalar


def image_files(spark: SparkSession, folder: str, more: bool = False) -> DataFrame:
    """path, filename, length, content, md5 of the image files of a folder; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(scalar.has_image_suffix(F.col("path"), more)).select(
        "path", scalar.basename(F.col("path")).alias("filename"), "length", "content", F.md5("content").alias("md5")
    )


def labelled_images(spark: SparkSession, roots: dict[str, int]) -> DataFrame:
    """image_files of several folders with label."""
    parts = [image_files(spark, folder).withColumn("label", F.lit(label)) for folder, label in roots.items()]
    return reduce(DataFrame.unionByName, parts)


def with_base64(files: DataFrame) -> DataFrame:
    return files.withColumn("base64", scalar.base64_line(F.col("content")))


def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """filename, width, height, aspect, is_jpeg (by extension), filesize."""
    # the two sources spell a local file's address differently
    place = F.regexp_replace(F.col("path"), "^[A-Za-z0-9]+:/+", "/")
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(place.alias("path"), "length")
    pixels = images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    pixels = pixels.withColumn("path", place)
    name = scalar.basename(F.col("path"))
    return sizes.join(pixels, "path").select(
        name.alias("filename"),
        "width",
        "height",
        scalar.aspect(F.col("width"), F.col("height")).alias("aspect"),
        F.lower(name).rlike(r"\.jpe?g$").cast("int").alias("is_jpeg"),
        F.col("length").alias("filesize"),
    )


def resolve(names: DataFrame, first: DataFrame, second: DataFrame, key: str = "filename") -> DataFrame:
    """names with the path in the first root that has the file."""
    a, b = (d.select(key, F.col("path").alias(p)) for d, p in ((first, "path_a"), (second, "path_b")))
    return names.join(a, key, "left").join(b, key, "left").withColumn("path", scalar.first_existing(F.col("path_a"), F.col("path_b"))).drop("path_a", "path_b")
