"""Delimited and spreadsheet tables with explicit schemas, and the sinks of the reports."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the released sample and metadata tables.
SAMPLE_SCHEMA = (
    "id string, label int, label_folder int, cluster_id int, is_dedup_rep int, fold_full int, fold_dedup int, "
    "gpt_pred int, claude_pred int, gemini_pred int, clip_zs_b32_piog double, clip_zs_l14_piog double, "
    "clip_zs_b32_pred int, clip_zs_l14_pred int, phash string, md5 string"
)
METADATA_SCHEMA = "id string, width int, height int, aspect double, is_jpeg int, filesize bigint"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; by name. Without a schema every column is a string, never a guess: hex hashes stay text."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as strings, with row_idx; a driver-side read, for label sheets of bounded size."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path.removeprefix("file://")) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(space + "t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        sheet = ET.fromstring(book.read("xl/worksheets/sheet1.xml"))
    rows = []
    for row in sheet.iter(space + "row"):
        cells: dict[str, str | None] = {}
        for cell in row.iter(space + "c"):
            value, column = cell.find(space + "v"), re.sub(r"\d", "", cell.get("r", ""))
            if cell.get("t") == "inlineStr":
                cells[column] = "".join(t.text or "" for t in cell.iter(space + "t"))
            elif value is not None:
                cells[column] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        rows.append(cells)
    header, *body = rows
    schema = "row_idx bigint, " + ", ".join(f"`{name}` string" for name in header.values())
    return spark.createDataFrame([(i, *[r.get(c) for c in header]) for i, r in enumerate(body)], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_once(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet sink does not hold yet; a rerun of a batch adds nothing. Returns the rows added."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def write_json_summary(df: DataFrame, path: str, *keys: str) -> None:
    """Tidy results as JSON lines."""
    df.select(F.to_json(F.struct(*(keys or df.columns))).alias("value")).write.mode("overwrite").text(path)
