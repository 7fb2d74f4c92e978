"""Registered queries about model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsieve.functions import scalar, verdicts
from foldsieve.plans.catalog import query
from foldsieve.session import read


def responses(spark, sf_dir):
    """Synthetic responses in five shapes, one batch of four files per group of four documents."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") / 4).cast("long").alias("batch"))
    name = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".png"))
    verdict = F.when(F.col("doc_id") % 3 == 0, "O").otherwise("X")
    shape = F.col("batch") % 5
    line = (
        F.when(shape == 0, F.concat(F.lit("filename: "), name, F.lit(" judgment: "), verdict))
        .when(shape == 1, F.concat(name, F.lit(": "), verdict))
        .when(shape == 2, F.concat(F.lit("| "), name, F.lit(" | "), verdict, F.lit(" |")))
        .when(shape == 3, F.concat(name, F.lit("\n"), verdict))
        .otherwise(F.concat(F.lit("filename: ["), name, F.lit("] judgment: ["), verdict, F.lit("]")))
    )
    entry = F.struct("doc_id", name.alias("file"), line.alias("line"))
    grouped = rows.groupBy("batch").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return grouped.select("batch", F.array_join("entries.line", "\n").alias("text"), F.col("entries.file").alias("files"))


def _parsed(spark, sf_dir, mode):
    verdicts.register(spark)
    responses(spark, sf_dir).createOrReplaceTempView("foldsieve_responses")
    return spark.sql(
        f"SELECT r.batch, t.filename, t.judgment, t.stage FROM foldsieve_responses r, LATERAL parse_verdicts(r.text, r.files, '{mode}') t"
    )


EXPECTED = (
    "SELECT doc_id // 4 AS batch, concat('a', doc_id, '.png') AS filename, CASE WHEN doc_id % 3 = 0 THEN 'O' ELSE 'X' END AS judgment{} FROM documents"
)


@query(EXPECTED.format(", 1::INT AS stage"))
def parse_verdicts_strict(spark, sf_dir):
    return _parsed(spark, sf_dir, "strict")


@query(EXPECTED.format(", (CASE doc_id // 4 % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 4 END)::INT AS stage"))
def parse_verdicts(spark, sf_dir):
    return _parsed(spark, sf_dir, "compat")


@query(
    "SELECT doc_id // 4 AS batch, count(*) AS files, count(*) FILTER (WHERE doc_id % 7 = 0) AS missing, "
    "coalesce(string_agg(concat('a', doc_id, '.png'), ',' ORDER BY doc_id) FILTER (WHERE doc_id % 7 = 0), '') AS names FROM documents GROUP BY 1"
)
def missing_verdicts(spark, sf_dir):
    """Files of each batch that a response left out."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") / 4).cast("long").alias("batch"))
    name = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".png"))
    entries = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("doc_id", name.alias("f"), (F.col("doc_id") % 7 != 0).alias("ok")))).alias("e"))
    answered = F.transform(F.filter("e", lambda x: x["ok"]), lambda x: F.struct(x["f"], F.lit("O")))
    missing = scalar.missing_names(F.col("e.f"), F.map_from_entries(answered))
    return entries.select("batch", F.size("e").cast("long").alias("files"), F.size(missing).cast("long").alias("missing"), F.array_join(missing, ",").alias("names"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('a', doc_id, '.png') ELSE concat('a', doc_id, '.webp') END AS name, "
    "CASE WHEN doc_id % 3 = 0 THEN 'image/png' ELSE 'image/webp' END AS media, doc_id % 3 = 0 AS is_image FROM documents"
)
def path_functions(spark, sf_dir):
    """Base name, media type and suffix test of paths."""
    end = F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".webp")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s3/x/a"), F.col("doc_id").cast("string"), end).alias("path"))
    path = F.col("path")
    return rows.select("doc_id", scalar.basename(path).alias("name"), scalar.media_type(path).alias("media"), scalar.has_image_suffix(path).alias("is_image"))


@query(
    "SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['5.png'] WHEN 1 THEN ['p1.png', 'p2.png'] ELSE ['1.png', '11.png'] END) AS filename, "
    "CASE WHEN doc_id % 2 = 0 THEN 'O' ELSE 'X' END AS judgment, unnest(CASE doc_id % 3 WHEN 0 THEN [3] WHEN 1 THEN [4, 5] ELSE [2, 6] END)::INT AS stage FROM documents"
)
def parse_later_stages(spark, sf_dir):
    """Responses that only the later stages read: a cell with name and verdict, two names in a line, a name inside another."""
    verdicts.register(spark)
    verdict = F.when(F.col("doc_id") % 2 == 0, "O").otherwise("X")
    shape = F.col("doc_id") % 3
    text = F.when(shape == 0, F.concat(F.lit("| 5.png "), verdict, F.lit(" |"))).when(shape == 1, F.concat(F.lit("p1.png, p2.png "), verdict))
    text = text.otherwise(F.concat(F.lit("11.png?\n\n11.png: "), verdict))
    files = F.when(shape == 0, F.array(F.lit("5.png"))).when(shape == 1, F.array(F.lit("p1.png"), F.lit("p2.png"))).otherwise(F.array(F.lit("1.png"), F.lit("11.png")))
    read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), files.alias("files")).createOrReplaceTempView("foldsieve_later")
    return spark.sql("SELECT r.doc_id, t.filename, t.judgment, t.stage FROM foldsieve_later r, LATERAL parse_verdicts(r.text, r.files, 'compat') t")
