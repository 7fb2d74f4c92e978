"""Registered queries over the readers and writers: what is written is read back, and equals the table."""

from __future__ import annotations

import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from foldsieve.functions import scalar
from foldsieve.operators import metrics, splits
from foldsieve.plans import samples as S
from foldsieve.plans.catalog import MACRO, MACRO_SQL, query, rounded
from foldsieve.session import read, work_path
from foldsieve.sources import matrices, tables
from foldsieve.streaming import collect

SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double"


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def csv_with_schema(spark, sf_dir):
    """A table as CSV with a header, read by an explicit schema."""
    path = work_path(spark, "csv")
    tables.write_csv(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return tables.read_csv(spark, path, SUPPLIER)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def csv_as_strings(spark, sf_dir):
    """Without a schema every column stays text."""
    path = work_path(spark, "csv")
    tables.write_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path)
    return tables.read_csv(spark, path)


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS row_idx, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def spreadsheet(spark, sf_dir):
    """The 25 nations as the first sheet of a workbook, read as strings in sheet order."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    cells = [("n_nationkey", "n_name"), *((str(r[0]), r[1]) for r in rows)]
    sheet = "".join(
        "<row>" + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t>{escape(x)}</t></is></c>' for c, x in zip("AB", row)) + "</row>" for i, row in enumerate(cells, 1)
    )
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    path = work_path(spark, "sheet").removeprefix("file://") + ".xlsx"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData>{sheet}</sheetData></worksheet>')
    return tables.read_xlsx(spark, path)


@query("SELECT event_id, event_type FROM events")
def batch_appends(spark, sf_dir):
    """Batches appended to a sink, one of them twice: every row is there once."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("batch"))
    path = work_path(spark, "appended")
    for batch in (0, 1, 0, 2):
        tables.append_once(rows.where(F.col("batch") == batch), path, "event_id")
    return spark.read.parquet(path).select("event_id", "event_type")


@query("WITH" + S.GROUP_FOLDED + S.long_sql("folded") + " SELECT method, acc_mean, f1_mean FROM macro")
def json_summary(spark, sf_dir):
    """Tidy results as JSON lines."""
    path = work_path(spark, "json")
    found = rounded(metrics.evaluate(S.long_predictions(S.group_folded(spark, sf_dir)), "method"), *MACRO)
    tables.write_json_summary(found, path, "method", "acc_mean", "f1_mean")
    return spark.read.schema("method string, acc_mean double, f1_mean double").json(path)


def _vectors(spark, sf_dir, **options):
    matrices.register(spark)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vec"))
    path = work_path(spark, "matrix")
    ordered = rows.repartitionByRange("row_idx").sortWithinPartitions("row_idx")
    ordered.select("row_idx", F.col("vec").cast("array<double>").alias("vec")).write.format("foldsieve_npy").mode("append").options(path=path, **options).save()
    found = spark.read.format("foldsieve_npy").options(path=path, rowsPerPartition=500, **options).load()
    return found.select("row_idx", F.posexplode("vec").alias("place", "x"))


VECTORS = (
    "SELECT row_idx, i::INT AS place, embedding[i + 1]::DOUBLE AS x "
    "FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row_idx, embedding FROM embeddings), range(64) r(i)"
)


@query(VECTORS)
def npy_matrix(spark, sf_dir):
    """A matrix written as .npy parts and read by row ranges."""
    return _vectors(spark, sf_dir)


@query(VECTORS)
def npz_matrix(spark, sf_dir):
    """The same as compressed archives with a named array."""
    return _vectors(spark, sf_dir, array="vec")


@query("SELECT doc_id, base64(encode(text)) AS body FROM documents")
def base64_bodies(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalar.base64_line(F.col("text").cast("binary")).alias("body"))


@query("WITH" + S.CLUSTERED + ", given AS (SELECT *, (id % 5)::INT AS fold FROM clustered)" + S.long_sql("given") + f" SELECT method, {MACRO_SQL} FROM macro")
def given_folds(spark, sf_dir):
    """Fold columns that come with the samples are taken as they are."""
    rows = S.clustered(spark, sf_dir).withColumn("fold", (F.col("id") % 5).cast("int"))
    return rounded(metrics.evaluate(S.long_predictions(rows), "method"), *MACRO)


POPULATIONS = {"full": S.group_folded, "dedup": S.dedup_folded}


def populations(spark, sf_dir, which: str = "both"):
    """method and macro metrics over the full population, the deduplicated one, or both."""
    parts = [
        metrics.evaluate(S.long_predictions(rows(spark, sf_dir)), "method").withColumn("population", F.lit(name))
        for name, rows in POPULATIONS.items()
        if which in (name, "both")
    ]
    return rounded(parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0], *MACRO)


@query(
    "WITH" + S.GROUP_FOLDED + S.long_sql("folded")
    + S.DEDUP_FOLDED.replace(S.CLUSTERED, "", 1)
    + S.long_sql("dedup").replace("predictions", "predictions_d").replace("counts", "counts_d").replace("rates", "rates_d").replace("per_fold", "per_fold_d").replace("macro", "macro_d")
    + f" SELECT 'full' AS population, method, {MACRO_SQL} FROM macro UNION ALL SELECT 'dedup', method, {MACRO_SQL} FROM macro_d"
)
def both_populations(spark, sf_dir):
    return populations(spark, sf_dir)


class Judge:
    """A provider that answers by the length of the picture."""

    name = "judge"

    def ask(self, prompt, files, images):
        return "\n".join(f"filename: {f} judgment: {'O' if len(i) % 2 else 'X'}" for f, i in zip(files, images))


@query("SELECT concat('p', p_partkey, '.png') AS filename, CASE WHEN octet_length(encode(p_name)) % 2 = 1 THEN 'O' ELSE 'X' END AS judge FROM part")
def collected_verdicts(spark, sf_dir):
    """Batched collection from a provider, written, read back and parsed; asked again, the sink answers."""
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("filename"), F.col("p_name").cast("binary").alias("content"), "p_partkey")
    rows = S.contiguous_index(rows, "p_partkey").drop("p_partkey")
    folder = work_path(spark, "verdicts")
    collect.collect_verdicts(spark, rows, {"judge": Judge}, folder, wait=0)
    return collect.collect_verdicts(spark, rows, {"judge": Judge}, folder, wait=0)


@query(
    "WITH" + S.GROUP_FOLDED + ", turned AS (SELECT id, y, fold FROM folded) "
    "SELECT fold, count(*) AS test, (SELECT count(*) FROM turned) - count(*) AS train FROM turned GROUP BY fold"
)
def fold_sizes(spark, sf_dir):
    """Rows tested and trained on by fold."""
    rows = S.group_folded(spark, sf_dir)
    counts = rows.groupBy("fold").agg(F.count("*").alias("test"))
    total = counts.agg(F.sum("test").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("fold", "test", (F.col("all") - F.col("test")).alias("train"))




@query("SELECT l_orderkey, l_linenumber, round_even((l_orderkey % 16) / 1600.0::DOUBLE * 100 * 12.5, 1) AS pct FROM lineitem")
def half_even_percent(spark, sf_dir):
    """Percentages with one digit; halves go to the even digit."""
    value = (F.col("l_orderkey") % 16) / F.lit(1600.0) * 12.5
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", metrics.percent(value).alias("pct"))


@query(
    "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) "
    "SELECT a.i::BIGINT AS row_idx, c_custkey, o_orderkey FROM a JOIN b ON a.i = b.i"
)
def positional_join(spark, sf_dir):
    """Two files zipped by place: each gets a gapless index, which is the key."""
    left = S.contiguous_index(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    right = S.contiguous_index(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return left.join(right, "row_idx").select(F.col("row_idx").cast("long").alias("row_idx"), "c_custkey", "o_orderkey")


@query(
    "SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE (d.doc_id % 2)::INT END IS NULL AS missing, "
    "CASE WHEN d.doc_id % 3 = 0 THEN 0 ELSE (d.doc_id % 2)::INT END AS pred FROM documents d"
)
def missing_as_negative(spark, sf_dir):
    """A left lookup in a table that lacks some keys: what is missing counts as negative, and is marked."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    known = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("pred"))
    found = docs.join(known, "doc_id", "left").withColumn("missing", F.col("pred").isNull())
    return splits.assert_complete(found, "pred", policy="negative").select("doc_id", "missing", "pred")


@query("WITH" + S.SAMPLES + " SELECT round(100 * avg((pred_a = y)::INT), 6) AS acc, round(100 * 2.0 * count(*) FILTER (WHERE y = 1 AND pred_a = 1) / (count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE pred_a = 1)), 6) AS f1 FROM samples")
def unguarded_metrics(spark, sf_dir):
    """Accuracy over all rows and F1, in percent, without guards."""
    y, p = F.col("y") == 1, F.col("pred_a") == 1
    f1 = 2 * F.count_if(y & p) / (F.count_if(y) + F.count_if(p))
    return S.samples(spark, sf_dir).agg(F.round(F.avg((F.col("pred_a") == F.col("y")).cast("int")) * 100, 6).alias("acc"), F.round(f1 * 100, 6).alias("f1"))


@query("SELECT concat(s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '.bin' ELSE '.dat' END) AS filename, octet_length(encode(s_name)) AS length FROM supplier")
def folder_listing(spark, sf_dir):
    """Files of a folder by name, with their sizes, sorted; the files are written first, one per supplier."""
    folder = work_path(spark, "files")
    rows = read(spark, sf_dir, "supplier")
    name = F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".bin").otherwise(".dat"))
    local = folder.removeprefix("file://")

    def write(frames):
        os.makedirs(local, exist_ok=True)
        for frame in frames:
            for filename, body in zip(frame["filename"], frame["body"]):
                with open(f"{local}/{filename}", "wb") as file:
                    file.write(body)
            yield frame[["filename"]]

    written = rows.select(name.alias("filename"), F.col("s_name").cast("binary").alias("body")).mapInPandas(write, "filename string")
    written.write.format("noop").mode("overwrite").save()
    files = spark.read.format("binaryFile").load(folder)
    return files.select(scalar.basename(F.col("path")).alias("filename"), "length").orderBy("filename")
