"""The evaluation's input tables, derived from the driver's tables, as DataFrames and as SQL.

A labelled document is a sample: quality is the verified class, three fixed
rules stand for the verdicts of three models, and its text gives exact clusters
(equal texts) and 64-bit similarity hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldsieve.functions.hashing import simhash
from foldsieve.operators import ensembles, splits, vectors
from foldsieve.session import read, work_table

PREDICTORS = ("pred_a", "pred_b", "pred_c")


def samples(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """Labelled documents; keyed: with text_key in place of the text, made before the join, so that no text is shuffled."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    if keyed:
        docs = docs.withColumn("text_key", F.md5("text")).drop("text")
    both = docs.join(labels, "doc_id")
    return both.select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("int").alias("y"),
        F.col("n_chars"),
        "lang",
        "source",
        "text_key" if keyed else "text",
        (F.col("n_chars") >= 1000).cast("int").alias("pred_a"),
        F.col("lang").isin("en", "fr").cast("int").alias("pred_b"),
        (F.substring(F.md5(F.concat(F.lit("c:"), F.col("doc_id").cast("string"))), 1, 1) < "8").cast("int").alias("pred_c"),
    )


SAMPLES = """
samples AS (
  SELECT d.doc_id AS id, l.quality::INT AS y, d.n_chars, d.lang, d.source, d.text,
         (d.n_chars >= 1000)::INT AS pred_a, (d.lang IN ('en', 'fr'))::INT AS pred_b,
         (substr(md5(concat('c:', d.doc_id)), 1, 1) < '8')::INT AS pred_c
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with cluster: the smallest id with the same text."""
    rows = samples(spark, sf_dir, keyed=True)
    first = rows.groupBy("text_key").agg(F.min("id").alias("cluster"))
    return rows.join(first, "text_key")


CLUSTERED = (
    SAMPLES
    + """,
clustered AS (
  SELECT s.*, c.cluster FROM (SELECT *, md5(text) AS text_key FROM samples) s
  JOIN (SELECT md5(text) AS text_key, min(id) AS cluster FROM samples GROUP BY 1) c ON s.text_key = c.text_key
), stats AS (
  SELECT cluster, count(*) AS size, sum(y)::BIGINT AS positives, bool_or(y = 1) AS any_pos, bool_or(y = 0) AS any_neg,
         (avg(y) > 0.5)::INT AS majority, bool_or(y = 1) AND bool_or(y = 0) AS mixed
  FROM clustered GROUP BY cluster
)"""
)


def group_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clustered with a fold that keeps clusters whole."""
    rows = clustered(spark, sf_dir)
    return rows.join(splits.group_folds(splits.cluster_stats(rows)), "cluster")


GROUP_FOLDED = (
    CLUSTERED
    + """,
placed AS (
  SELECT cluster, row_number() OVER (PARTITION BY majority ORDER BY size DESC, md5(concat('42:', cluster)), cluster) - 1 AS rn FROM stats
), folded AS (
  SELECT c.*, (CASE WHEN (p.rn // 5) % 2 = 0 THEN p.rn % 5 ELSE 4 - p.rn % 5 END)::INT AS fold
  FROM clustered c JOIN placed p ON c.cluster = p.cluster
)"""
)


def naive_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clustered with stratified folds that ignore clusters."""
    return splits.stratified_folds(clustered(spark, sf_dir), "id")


NAIVE = ",\nnaive AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', id)), id) - 1) % 5)::INT AS fold FROM clustered)"
NAIVE_FOLDED = CLUSTERED + NAIVE


def dedup_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative per cluster, with stratified folds; y is the cluster's majority."""
    rows = clustered(spark, sf_dir)
    reps = splits.representatives(rows, order="id")
    chosen = rows.drop("cluster").join(reps, "id").withColumn("y", F.col("majority"))
    return splits.stratified_folds(chosen, "id")


DEDUP_FOLDED = (
    CLUSTERED
    + """,
reps AS (
  SELECT c.cluster, min(c.id) FILTER (WHERE c.y = s.majority) AS id, any_value(s.majority) AS majority
  FROM clustered c JOIN stats s ON c.cluster = s.cluster GROUP BY c.cluster
), dedup AS (
  SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', id)), id) - 1) % 5)::INT AS fold
  FROM (SELECT c.id, r.majority AS y, c.n_chars, c.lang, c.source, c.pred_a, c.pred_b, c.pred_c, r.cluster FROM clustered c JOIN reps r ON c.id = r.id)
)"""
)

METHODS = {
    "pred_a": F.col,
    "pred_b": F.col,
    "pred_c": F.col,
    "any": lambda _: ensembles.any_of(*PREDICTORS),
    "majority": lambda _: ensembles.majority_of(*PREDICTORS),
    "all_negative": lambda _: ensembles.all_negative(),
}


def long_predictions(folded: DataFrame) -> DataFrame:
    """id, fold, y, method, pred of the fixed predictors and ensembles."""
    return ensembles.long_predictions(folded, {m: make(m) for m, make in METHODS.items()}, "id", "fold", "y")


def long_sql(table: str) -> str:
    """CTEs predictions (method, id, fold, y, pred), per_fold and macro over a folded table."""
    kinds = {
        "pred_a": "pred_a",
        "pred_b": "pred_b",
        "pred_c": "pred_c",
        "any": "(pred_a + pred_b + pred_c >= 1)::INT",
        "majority": "(pred_a + pred_b + pred_c >= 2)::INT",
        "all_negative": "0",
    }
    union = " UNION ALL ".join(f"SELECT '{m}' AS method, id, fold, y, {e} AS pred FROM {table}" for m, e in kinds.items())
    return f",\npredictions AS ({union})" + metrics_sql("predictions", "method")


def metrics_sql(table: str, by: str) -> str:
    """CTEs counts, per_fold and macro of a table with by, fold, y, pred."""
    means = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in ("acc", "prec", "rec", "f1", "spec"))
    return f""",
counts AS (
  SELECT {by}, fold, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn,
         count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn
  FROM {table} GROUP BY {by}, fold
), rates AS (
  SELECT *, (tp + tn) / greatest(tp + tn + fp + fn, 1)::DOUBLE AS acc, tp / greatest(tp + fp, 1)::DOUBLE AS prec,
         tp / greatest(tp + fn, 1)::DOUBLE AS rec, tn / greatest(tn + fp, 1)::DOUBLE AS spec FROM counts
), per_fold AS (
  SELECT *, 2 * prec * rec / greatest(prec + rec, 1e-12) AS f1 FROM rates
), macro AS (SELECT {by}, {means} FROM per_fold GROUP BY {by})"""


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clustered samples with hash, written once: id, y, cluster, hash, row_idx and the rest."""
    rows = samples(spark, sf_dir)
    found = work_table(simhash(rows, "id", "text"), "simhash")
    return group_folded(spark, sf_dir).join(found, "id").withColumn("row_idx", F.col("id"))


_BITS = ",\n         ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS s{b}" for b in range(64))
_HASH = " || ".join(f"CASE WHEN s{b} > 0 THEN '1' ELSE '0' END" for b in range(63, -1, -1))
HASHED = (
    GROUP_FOLDED
    + f""",
words AS (SELECT id, string_split(lower(text), ' ') AS w FROM samples),
grams AS (
  SELECT id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                    ELSE [array_to_string(w, ' ')] END) AS g
  FROM words
), shingles AS (SELECT id, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM grams
), sums AS (SELECT id, {_BITS} FROM shingles GROUP BY id
), hashes AS (SELECT id, ({_HASH})::BIT AS hash FROM sums
), hashed AS (SELECT f.*, f.id AS row_idx, h.hash FROM folded f JOIN hashes h ON f.id = h.id)"""
)


def contiguous_index(rows: DataFrame, order: str, name: str = "row_idx") -> DataFrame:
    """rows with a gapless index in the order of a column, without sorting all rows in one task."""
    ranged = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    placed = work_table(ranged, "ranged")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return placed.withColumn("__rank", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__rank")).drop("__part", "__start", "__rank")


def prompt_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class prototypes of two backbones and three prompt sets, from slices of the embeddings: labels 0-4 are class 0, 5-9 class 1."""
    rows = read(spark, sf_dir, "embeddings")
    split = rows.select(
        F.when(F.col("vec_id") % 2 == 0, "base").otherwise("large").alias("backbone"),
        F.concat(F.lit("set"), (F.col("vec_id") % 3).cast("string")).alias("prompt_set"),
        (F.col("label") >= 5).cast("int").alias("class_idx"),
        F.col("embedding").alias("vec"),
    )
    return vectors.prototypes(split, ["backbone", "prompt_set", "class_idx"], "vec")


PROMPTS = """
unit AS (
  SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'base' ELSE 'large' END AS backbone, 'set' || (vec_id % 3) AS prompt_set,
         (label >= 5)::INT AS class_idx,
         list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z)))) AS v
  FROM embeddings
), spread AS (SELECT backbone, prompt_set, class_idx, unnest(v) AS x, unnest(range(len(v))) AS place FROM unit
), means AS (SELECT backbone, prompt_set, class_idx, place, avg(x) AS x FROM spread GROUP BY ALL
), listed AS (SELECT backbone, prompt_set, class_idx, list(x ORDER BY place) AS m FROM means GROUP BY ALL
), protos AS (
  SELECT backbone, prompt_set, class_idx, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda z: z * z)))) AS vec FROM listed
), scored AS (
  SELECT e.vec_id, (e.label >= 5)::INT AS y, n.backbone, n.prompt_set,
         1 / (1 + exp(100 * (list_dot_product(e.embedding::DOUBLE[], n.vec) - list_dot_product(e.embedding::DOUBLE[], p.vec)))) AS p_pos
  FROM embeddings e JOIN protos n ON n.class_idx = 0
  JOIN protos p ON p.class_idx = 1 AND p.backbone = n.backbone AND p.prompt_set = n.prompt_set
)"""
