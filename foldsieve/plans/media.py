"""Registered queries over images: synthetic pixel rows in the shape of Spark's image source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foldsieve.functions import images
from foldsieve.plans.catalog import query
from foldsieve.session import read

IMAGE = "image struct<origin string, height int, width int, nChannels int, mode int, data binary>"


def pixels(seed: int) -> np.ndarray:
    """A deterministic picture: gradients, a box and noise, its size varying with the seed."""
    rng = np.random.default_rng(seed)
    h, w = 40 + seed % 5 * 16, 48 + seed % 7 * 8
    y, x = np.mgrid[:h, :w]
    out = np.stack([(x * 5 + seed) % 256, (y * 7) % 256, (x + y) * 2 % 256], -1) * 0.7 + rng.integers(0, 40, (h, w, 3))
    out[h // 4 : h // 2, w // 4 : w // 2] = rng.integers(0, 256, 3)
    return np.clip(out, 0, 255).astype(np.uint8)


def pictures(spark, sf_dir):
    """One picture per supplier."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for key in frame["s_suppkey"]:
                p = pixels(int(key))
                rows.append({"origin": f"pic/{key}.png", "height": p.shape[0], "width": p.shape[1], "nChannels": 3, "mode": 16, "data": p.tobytes()})
            yield pd.DataFrame({"image": rows})

    # few bytes, much work: dealt out by count, which is not merged again
    keys = read(spark, sf_dir, "supplier").select("s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return keys.mapInPandas(run, IMAGE)


@query()
def image_features(spark, sf_dir):
    """path, number of features, the sum and the sum of squares of each group of them."""
    found = images.extract(pictures(spark, sf_dir))
    columns = []
    for name, begin, n in (("rgb", 1, 512), ("hsv", 513, 512), ("moments", 1025, 9), ("edges", 1034, 3), ("patterns", 1037, 10), ("gradients", 1047, 1296)):
        part = F.slice("features", begin, n)
        columns.append(F.round(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 4).alias(f"{name}_sum"))
        columns.append(F.round(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x), 4).alias(f"{name}_squares"))
    return found.select("path", F.size("features").alias("n"), *columns, "error")


@query()
def phash(spark, sf_dir):
    return images.extract(pictures(spark, sf_dir)).select("path", "phash")


@query("SELECT concat('pic/', s_suppkey, '.png') AS path, 40 + s_suppkey % 5 * 16 AS height, 48 + s_suppkey % 7 * 8 AS width, round((48 + s_suppkey % 7 * 8) / (40 + s_suppkey % 5 * 16), 6) AS aspect FROM supplier")
def image_metadata(spark, sf_dir):
    rows = pictures(spark, sf_dir).select("image.origin", F.col("image.height").cast("long"), F.col("image.width").cast("long"))
    return rows.toDF("path", "height", "width").withColumn("aspect", F.round(F.col("width") / F.col("height"), 6))
