"""The registered queries of the evaluation engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsieve.functions import scalar
from foldsieve.operators import ensembles, knn, metrics, simjoin, splits, vectors
from foldsieve.plans import samples as S
from foldsieve.session import read, work_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from foldsieve.plans import learned, media, reports, storage, texts  # noqa: F401  each registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six digits, as the SQL rounds them."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


MACRO = [f"{m}_{k}" for m in metrics.METRICS for k in ("mean", "std")]
MACRO_SQL = ", ".join(MACRO)


@query("WITH" + S.DEDUP_FOLDED + S.long_sql("dedup") + f" SELECT {MACRO_SQL} FROM macro WHERE method = 'all_negative'")
def minimum_slice(spark, sf_dir):
    """Exact clusters, majority representatives, stratified folds, the constant predictor, macro metrics."""
    rows = S.dedup_folded(spark, sf_dir).withColumn("pred", ensembles.all_negative())
    return rounded(metrics.macro(metrics.metrics_by_fold(rows)), *MACRO)


@query("WITH" + S.GROUP_FOLDED + S.long_sql("folded") + " SELECT method, fold, tp, tn, fp, fn FROM counts")
def confusion_by_fold(spark, sf_dir):
    return metrics.confusion_counts(S.long_predictions(S.group_folded(spark, sf_dir)), "method", "fold")


@query(
    "WITH" + S.GROUP_FOLDED + S.long_sql("folded")
    + " SELECT method, fold, round(acc, 6) AS acc, round(prec, 6) AS prec, round(rec, 6) AS rec, round(f1, 6) AS f1, round(spec, 6) AS spec FROM per_fold"
)
def metrics_by_fold(spark, sf_dir):
    return rounded(metrics.metrics_by_fold(S.long_predictions(S.group_folded(spark, sf_dir)), "method"), *metrics.METRICS)


@query("WITH" + S.GROUP_FOLDED + S.long_sql("folded") + f" SELECT method, {MACRO_SQL} FROM macro")
def metrics_macro(spark, sf_dir):
    """Full population: every sample, folds that keep clusters whole."""
    return rounded(metrics.evaluate(S.long_predictions(S.group_folded(spark, sf_dir)), "method"), *MACRO)


@query("WITH" + S.DEDUP_FOLDED + S.long_sql("dedup") + f" SELECT method, {MACRO_SQL} FROM macro")
def metrics_macro_dedup(spark, sf_dir):
    """Deduplicated population: representatives only, stratified folds."""
    return rounded(metrics.evaluate(S.long_predictions(S.dedup_folded(spark, sf_dir)), "method"), *MACRO)


@query("WITH" + S.GROUP_FOLDED + S.long_sql("folded") + " SELECT fold, round(acc, 6) AS acc, round(spec, 6) AS spec, round(f1, 6) AS f1 FROM per_fold WHERE method = 'all_negative'")
def all_negative_baseline(spark, sf_dir):
    rows = S.group_folded(spark, sf_dir).withColumn("pred", ensembles.all_negative())
    return rounded(metrics.metrics_by_fold(rows).select("fold", "acc", "spec", "f1"), "acc", "spec", "f1")


@query("WITH" + S.SAMPLES + " SELECT id, (pred_a + pred_b + pred_c >= 1)::INT AS pred FROM samples")
def or_ensemble(spark, sf_dir):
    return S.samples(spark, sf_dir).select("id", ensembles.any_of(*S.PREDICTORS).alias("pred"))


@query("WITH" + S.SAMPLES + " SELECT id, (pred_a + pred_b + pred_c >= 2)::INT AS pred FROM samples")
def majority_vote(spark, sf_dir):
    return S.samples(spark, sf_dir).select("id", ensembles.majority_of(*S.PREDICTORS).alias("pred"))


@query("WITH" + S.SAMPLES + " SELECT id, ((pred_a = 1) OR (pred_b = 1))::INT AS a_or_b, ((pred_a = 1) OR (pred_c = 1))::INT AS a_or_c FROM samples")
def pairwise_union(spark, sf_dir):
    return S.samples(spark, sf_dir).select("id", ensembles.any_of("pred_a", "pred_b").alias("a_or_b"), ensembles.any_of("pred_a", "pred_c").alias("a_or_c"))


@query("WITH" + S.SAMPLES + " SELECT id, y, CASE CASE WHEN pred_a = 1 THEN 'O' ELSE 'X' END WHEN 'O' THEN 1 WHEN 'X' THEN 0 END AS label FROM samples")
def strict_label_map(spark, sf_dir):
    rows = S.samples(spark, sf_dir).withColumn("verdict", F.when(F.col("pred_a") == 1, "O").otherwise("X"))
    return rows.select("id", "y", scalar.strict_label(F.col("verdict")).alias("label"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def keep_first_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return splits.keep_first(rows, "user_id", "event_id")


@query(
    "SELECT e.vec_id, e.label, l.last_label FROM embeddings e "
    "JOIN (SELECT vec_id % 50 AS name, arg_max(label, vec_id) AS last_label FROM embeddings GROUP BY 1) l ON e.vec_id % 50 = l.name"
)
def last_wins_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("name", F.col("vec_id") % 50)
    last = splits.last_wins(rows, "name", "label", "vec_id").withColumnRenamed("label", "last_label")
    return rows.join(last, "name").select("vec_id", "label", "last_label")


@query("SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def strict_key_join(spark, sf_dir):
    """Total lookup by key: a key without a match raises instead of giving null."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    missing = F.raise_error(F.lit("a key has no match"))
    return joined.select("o_orderkey", "o_custkey", F.when(F.col("c_custkey").isNull(), missing).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@query("WITH" + S.CLUSTERED + " SELECT id, cluster FROM clustered")
def exact_clusters(spark, sf_dir):
    return S.clustered(spark, sf_dir).select("id", "cluster")


@query("WITH" + S.CLUSTERED + " SELECT cluster, size, positives, any_pos, any_neg, mixed, majority FROM stats")
def cluster_stats(spark, sf_dir):
    return splits.cluster_stats(S.clustered(spark, sf_dir)).select("cluster", "size", "positives", "any_pos", "any_neg", "mixed", "majority")


@query("WITH" + S.CLUSTERED + " SELECT count(*) AS clusters, coalesce(sum(size), 0)::BIGINT AS images FROM stats WHERE mixed")
def mixed_clusters(spark, sf_dir):
    stats = splits.cluster_stats(S.clustered(spark, sf_dir)).where("mixed")
    return stats.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("images"))


@query("WITH" + S.CLUSTERED + " SELECT cluster, majority FROM stats")
def majority_label(spark, sf_dir):
    return splits.cluster_stats(S.clustered(spark, sf_dir)).select("cluster", "majority")


@query("WITH" + S.CLUSTERED + " SELECT cluster, min(id) AS id FROM clustered GROUP BY cluster")
def first_member_rep(spark, sf_dir):
    return splits.representatives(S.clustered(spark, sf_dir), order="id", rule="first").select("cluster", "id")


@query("WITH" + S.DEDUP_FOLDED + " SELECT cluster, id, majority FROM reps")
def majority_member_rep(spark, sf_dir):
    return splits.representatives(S.clustered(spark, sf_dir), order="id")


@query("WITH" + S.CLUSTERED + ", roots AS (SELECT DISTINCT cluster FROM clustered) SELECT cluster, (row_number() OVER (ORDER BY cluster) - 1)::BIGINT AS label FROM roots")
def dense_relabel(spark, sf_dir):
    """Clusters numbered from 0 by their smallest member."""
    roots = S.clustered(spark, sf_dir).select("cluster").distinct()
    return S.contiguous_index(roots, "cluster", "label").select("cluster", F.col("label").cast("long").alias("label"))


@query("WITH" + S.DEDUP_FOLDED + " SELECT id, y, fold FROM dedup")
def stratified_folds(spark, sf_dir):
    return S.dedup_folded(spark, sf_dir).select("id", "y", "fold")


@query("WITH" + S.DEDUP_FOLDED + " SELECT fold, count(*) AS n, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg FROM dedup GROUP BY fold")
def fold_balance(spark, sf_dir):
    y = F.sum("y").cast("long")
    return S.dedup_folded(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), y.alias("pos"), (F.count("*") - y).alias("neg"))


@query("WITH" + S.GROUP_FOLDED + " SELECT id, cluster, fold FROM folded")
def group_folds(spark, sf_dir):
    return S.group_folded(spark, sf_dir).select("id", "cluster", "fold")


@query("WITH" + S.GROUP_FOLDED + " SELECT max(n)::BIGINT AS most_folds FROM (SELECT cluster, count(DISTINCT fold) AS n FROM folded GROUP BY cluster)")
def group_purity(spark, sf_dir):
    """The largest number of folds that one cluster touches: 1."""
    spans = S.group_folded(spark, sf_dir).groupBy("cluster").agg(F.countDistinct("fold").alias("n"))
    return spans.agg(F.max("n").alias("most_folds"))


SIGNS = "signs AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings)"


def _signs(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.sign_hash(F.col("embedding")).alias("h"))


@query("WITH " + SIGNS + " SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS dist FROM signs a JOIN signs b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 19")
def hamming_pairs(spark, sf_dir):
    return simjoin.hamming_pairs(_signs(spark, sf_dir), 19, "vec_id", "h")


@query("WITH " + SIGNS + " SELECT dist, count(*) AS pairs FROM (SELECT bit_count(xor(a.h, b.h))::INT AS dist FROM signs a JOIN signs b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 17) GROUP BY dist")
def hamming_histogram(spark, sf_dir):
    return simjoin.hamming_histogram(_signs(spark, sf_dir), 17, "vec_id", "h")


REACH = """,
pairs AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash)) AS dist FROM hashed a JOIN hashed b ON a.id < b.id
          WHERE bit_count(xor(a.hash, b.hash)) <= 15)"""
COMPONENTS = """
WITH RECURSIVE """ + S.HASHED.strip() + REACH + """,
near AS (SELECT a, b FROM pairs WHERE dist <= 10 UNION SELECT b, a FROM pairs WHERE dist <= 10),
reach AS (SELECT id AS a, id AS b FROM hashed UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a"""


@query(COMPONENTS)
def near_dup_components(spark, sf_dir):
    """Single linkage over text hashes at a distance of 10."""
    rows = S.hashed(spark, sf_dir).select("id", "hash")
    edges = work_table(simjoin.hash_edges(rows, 10), "edges")
    return simjoin.cluster(rows, edges, 10)


SWEEP = "WITH RECURSIVE " + S.HASHED.strip() + REACH + """,
ts AS (SELECT unnest([0, 5, 8, 10, 12, 15]) AS t),
near AS (SELECT t, a, b FROM pairs, ts WHERE dist <= t UNION SELECT t, b, a FROM pairs, ts WHERE dist <= t),
reach AS (SELECT t, id AS a, id AS b FROM hashed, ts UNION SELECT r.t, r.a, n.b FROM reach r JOIN near n ON r.b = n.a AND r.t = n.t),
comps AS (SELECT t, a AS id, min(b) AS c FROM reach GROUP BY t, a),
sizes AS (SELECT t, c, bool_or(y = 1) AS p, bool_or(y = 0) AS n FROM comps JOIN hashed USING (id) GROUP BY t, c)
SELECT t::INT AS threshold, count(*) AS clusters, count(*) FILTER (WHERE p) AS with_pos, count(*) FILTER (WHERE n) AS with_neg,
       count(*) FILTER (WHERE p AND n) AS mixed FROM sizes GROUP BY t"""


@query(SWEEP)
def threshold_sweep(spark, sf_dir):
    rows = work_table(S.hashed(spark, sf_dir).select("id", "hash", "y"), "hashed")
    return simjoin.threshold_sweep(rows, (0, 5, 8, 10, 12, 15))


KNN = """,
ranked AS (
  SELECT t.id, t.fold, t.y, r.y AS vote, row_number() OVER (PARTITION BY t.id ORDER BY bit_count(xor(t.hash, r.hash)), r.row_idx) AS rank
  FROM hashed t JOIN hashed r ON t.fold <> r.fold
), knn AS (SELECT id, fold, y, (avg(vote) > 0.5)::INT AS pred FROM ranked WHERE rank <= 3 GROUP BY id, fold, y)"""


@query("WITH" + S.HASHED + KNN + " SELECT id, fold, y, pred FROM knn")
def knn_hamming(spark, sf_dir):
    return knn.knn_predictions(work_table(S.hashed(spark, sf_dir).select("id", "fold", "y", "hash", "row_idx"), "hashed"))


@query("WITH" + S.HASHED + KNN + S.metrics_sql("(SELECT *, 'knn' AS method FROM knn)", "method") + f" SELECT {MACRO_SQL} FROM macro")
def knn_metrics(spark, sf_dir):
    return rounded(metrics.macro(metrics.metrics_by_fold(knn_hamming(spark, sf_dir))), *MACRO)


@query(
    "WITH" + S.HASHED + KNN + S.NAIVE + ", nh AS (SELECT n.id, n.y, n.fold, n.id AS row_idx, h.hash FROM naive n JOIN hashes h ON n.id = h.id), nr AS ("
    "SELECT t.id, t.fold, t.y, r.y AS vote, row_number() OVER (PARTITION BY t.id ORDER BY bit_count(xor(t.hash, r.hash)), r.row_idx) AS rank "
    "FROM nh t JOIN nh r ON t.fold <> r.fold), both_splits AS ("
    "SELECT 'naive' AS split, id, fold, y, (avg(vote) > 0.5)::INT AS pred FROM nr WHERE rank <= 3 GROUP BY id, fold, y "
    "UNION ALL SELECT 'group', id, fold, y, pred FROM knn)" + S.metrics_sql("both_splits", "split")
    + " SELECT round(max(acc_mean) FILTER (WHERE split = 'naive') - max(acc_mean) FILTER (WHERE split = 'group'), 5) AS acc_inflation,"
    " round(max(f1_mean) FILTER (WHERE split = 'naive') - max(f1_mean) FILTER (WHERE split = 'group'), 5) AS f1_inflation FROM macro"
)
def leakage_inflation_knn(spark, sf_dir):
    """Naive minus group folds, for the neighbour vote."""
    base = work_table(S.hashed(spark, sf_dir).select("id", "fold", "y", "hash", "row_idx"), "hashed")
    naive = base.drop("fold").join(S.naive_folded(spark, sf_dir).select("id", "fold"), "id")
    both = knn.knn_predictions(base).withColumn("split", F.lit("group")).unionByName(knn.knn_predictions(naive).withColumn("split", F.lit("naive")))
    found = rounded(metrics.evaluate(both, "split"), *MACRO)

    def gap(m):
        return F.max(F.when(F.col("split") == "naive", F.col(m))) - F.max(F.when(F.col("split") == "group", F.col(m)))

    return found.agg(F.round(gap("acc_mean"), 5).alias("acc_inflation"), F.round(gap("f1_mean"), 5).alias("f1_inflation"))


@query(
    "WITH unit AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z)))) AS v FROM embeddings) "
    "SELECT vec_id, i::INT AS place, round(v[i + 1], 6) AS x FROM unit, range(64) r(i)"
)
def l2_normalize(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(vectors.as_double(F.col("embedding"))).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("place", "x")).withColumn("x", F.round("x", 6))


@query("WITH" + S.PROMPTS + " SELECT backbone, prompt_set, class_idx, i::INT AS place, round(vec[i + 1], 6) AS x FROM protos, range(64) r(i)")
def class_prototypes(spark, sf_dir):
    rows = S.prompt_sets(spark, sf_dir)
    return rows.select("backbone", "prompt_set", "class_idx", F.posexplode("vec").alias("place", "x")).withColumn("x", F.round("x", 6))


def _zero_shot(spark, sf_dir, keep=("vec_id", "y")):
    rows = read(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int")).withColumnRenamed("embedding", "vec")
    return vectors.two_class_scores(rows, S.prompt_sets(spark, sf_dir), ["backbone", "prompt_set"], "vec", list(keep))


@query("WITH" + S.PROMPTS + " SELECT vec_id, backbone, prompt_set, round(p_pos, 6) AS p_pos FROM scored")
def zero_shot_scores(spark, sf_dir):
    return _zero_shot(spark, sf_dir).select("vec_id", "backbone", "prompt_set", F.round("p_pos", 6).alias("p_pos"))


@query("WITH" + S.PROMPTS + " SELECT vec_id, backbone, prompt_set, (p_pos >= 0.5)::INT AS pred FROM scored")
def zero_shot_pred(spark, sf_dir):
    return _zero_shot(spark, sf_dir).select("vec_id", "backbone", "prompt_set", "pred")


GRID = S.PROMPTS + ", flat AS (SELECT backbone || '/' || prompt_set AS method, vec_id % 5 AS fold, y, (p_pos >= 0.5)::INT AS pred FROM scored)" + S.metrics_sql("flat", "method")


def _grid(spark, sf_dir):
    rows = _zero_shot(spark, sf_dir).withColumn("fold", F.col("vec_id") % 5)
    return metrics.evaluate(rows, "backbone", "prompt_set")


@query("WITH" + GRID + " SELECT split_part(method, '/', 1) AS backbone, split_part(method, '/', 2) AS prompt_set, acc_mean, f1_mean FROM macro")
def prompt_grid(spark, sf_dir):
    return rounded(_grid(spark, sf_dir).select("backbone", "prompt_set", "acc_mean", "f1_mean"), "acc_mean", "f1_mean")


@query(
    "WITH" + S.PROMPTS + ", zs AS (SELECT vec_id, vec_id % 5 AS fold, y, max((p_pos >= 0.5)::INT) FILTER (WHERE backbone = 'base') AS base, "
    "max((p_pos >= 0.5)::INT) FILTER (WHERE backbone = 'large') AS large FROM scored WHERE prompt_set = 'set0' GROUP BY ALL), "
    "flat AS (SELECT m AS method, vec_id, fold, y, CASE m WHEN 'base' THEN base WHEN 'large' THEN large WHEN 'either' THEN greatest(base, large) ELSE least(base, large) END AS pred "
    "FROM zs, (SELECT unnest(['base', 'large', 'either', 'both']) AS m))" + S.metrics_sql("flat", "method") + f" SELECT method, {MACRO_SQL} FROM macro"
)
def backbone_comparison(spark, sf_dir):
    """Two backbones under one prompt set, alone and joined."""
    rows = _zero_shot(spark, sf_dir).where("prompt_set = 'set0'").withColumn("fold", F.col("vec_id") % 5)
    wide = rows.groupBy("vec_id", "fold", "y").pivot("backbone", ["base", "large"]).agg(F.max("pred"))
    kinds = {"base": F.col("base"), "large": F.col("large"), "either": F.greatest("base", "large"), "both": F.least("base", "large")}
    return rounded(metrics.evaluate(ensembles.long_predictions(wide, kinds, "fold", "y"), "method"), *MACRO)


@query(
    "WITH" + GRID + " SELECT split_part(method, '/', 1) AS backbone, "
    + ", ".join(f"round({f}({m}_mean), 5) AS {m}_{n}" for m in ("acc", "f1") for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_pop", "std")))
    + " FROM macro GROUP BY 1"
)
def prompt_sensitivity(spark, sf_dir):
    grid = rounded(_grid(spark, sf_dir), "acc_mean", "f1_mean")
    kinds = (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))
    return grid.groupBy("backbone").agg(*[F.round(f(f"{m}_mean"), 5).alias(f"{m}_{n}") for m in ("acc", "f1") for n, f in kinds])


@query("WITH" + S.SAMPLES + " SELECT id FROM samples WHERE y = 1 AND pred_a = 0 AND pred_b = 0 AND pred_c = 0")
def unanimous_misses(spark, sf_dir):
    return S.samples(spark, sf_dir).where("y = 1 and pred_a = 0 and pred_b = 0 and pred_c = 0").select("id")


@query(
    "WITH" + S.SAMPLES + " SELECT count(*) FILTER (WHERE y = 1 AND pred_a = 0 AND pred_b = 0) AS missed, "
    "round(avg(pred_c) FILTER (WHERE y = 1 AND pred_a = 0 AND pred_b = 0), 6) AS recovered FROM samples"
)
def conditional_coverage(spark, sf_dir):
    """How much of what two predictors miss the third finds."""
    missed = (F.col("y") == 1) & (F.col("pred_a") == 0) & (F.col("pred_b") == 0)
    found = metrics.coverage(missed, F.col("pred_c"))
    return S.samples(spark, sf_dir).agg(F.count_if(missed).cast("long").alias("missed"), F.round(found, 6).alias("recovered"))


@query(
    "WITH" + S.SAMPLES + " SELECT m AS method, round(avg(CASE m WHEN 'pred_a' THEN pred_a ELSE pred_b END) FILTER (WHERE y = 1 AND pred_c = 0), 6) AS caught "
    "FROM samples, (SELECT unnest(['pred_a', 'pred_b']) AS m) GROUP BY m"
)
def reverse_coverage(spark, sf_dir):
    """Who catches the probe's misses."""
    rows = ensembles.long_predictions(S.samples(spark, sf_dir), {m: F.col(m) for m in ("pred_a", "pred_b")}, "y", "pred_c")
    missed = (F.col("y") == 1) & (F.col("pred_c") == 0)
    return rows.groupBy("method").agg(F.round(metrics.coverage(missed, F.col("pred")), 6).alias("caught"))


@query("WITH" + S.SAMPLES + " SELECT id FROM samples WHERE y = 1 AND pred_a + pred_b + pred_c = 0 INTERSECT SELECT id FROM samples WHERE n_chars < 500")
def hard_core(spark, sf_dir):
    """Unanimous misses that a further probe misses too."""
    rows = S.samples(spark, sf_dir)
    return rows.where((F.col("y") == 1) & (ensembles.votes(*S.PREDICTORS) == 0)).select("id").intersect(rows.where("n_chars < 500").select("id"))


@query("WITH" + S.GROUP_FOLDED + S.long_sql("folded") + " SELECT method, round(100 * avg(pred) FILTER (WHERE y = 1), 6) AS recall FROM predictions GROUP BY method")
def recall_comparison(spark, sf_dir):
    rows = S.long_predictions(S.group_folded(spark, sf_dir))
    return rows.groupBy("method").agg(F.round(metrics.recall() * 100, 6).alias("recall"))


@query("WITH" + S.SAMPLES + " SELECT round(greatest(avg(y), 1 - avg(y)), 6) AS floor FROM samples")
def majority_floor(spark, sf_dir):
    return S.samples(spark, sf_dir).agg(F.round(metrics.majority_floor(), 6).alias("floor"))


@query("WITH" + S.SAMPLES + " SELECT y, count(*) AS n FROM samples GROUP BY y")
def class_balance(spark, sf_dir):
    return S.samples(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT (p_size, p_brand)) AS pairs, round(100 * avg((p_size > 25)::INT), 6) AS large FROM part")
def distinct_metadata_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    return rows.agg(F.countDistinct("p_size", "p_brand").alias("pairs"), F.round(F.avg((F.col("p_size") > 25).cast("int")) * 100, 6).alias("large"))


@query(
    "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS log_price, round(p_size / p_retailprice, 6) AS ratio, "
    "split_part(p_type, ' ', -1) AS last_word, regexp_matches(lower(p_name), '[aeiou]$') AS vowel FROM part"
)
def metadata_features(spark, sf_dir):
    """log1p, ratio, last path part, case-insensitive suffix."""
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(F.log1p("p_retailprice"), 6).alias("log_price"),
        F.round(scalar.aspect(F.col("p_size"), F.col("p_retailprice")), 6).alias("ratio"),
        F.substring_index("p_type", " ", -1).alias("last_word"),
        F.lower("p_name").rlike("[aeiou]$").alias("vowel"),
    )


@query("WITH" + S.SAMPLES + " SELECT id, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)), 6) AS weight FROM samples")
def balanced_weights(spark, sf_dir):
    return splits.balanced_weights(S.samples(spark, sf_dir)).select("id", F.round("weight", 6).alias("weight"))


@query("SELECT event_id, row_idx, row_idx // 32 AS batch FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS row_idx FROM events)")
def batch_slices(spark, sf_dir):
    rows = S.contiguous_index(read(spark, sf_dir, "events").select("event_id"), "event_id")
    return splits.batches(rows.withColumn("row_idx", F.col("row_idx").cast("long")), "row_idx", 32)


@query("SELECT event_id, row_idx // 10 AS batch FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS row_idx FROM events) WHERE row_idx >= 10")
def resume_offset(spark, sf_dir):
    """What is left from the batch that holds the 17th row on, in batches of 10."""
    rows = S.contiguous_index(read(spark, sf_dir, "events").select("event_id"), "event_id").withColumn("row_idx", F.col("row_idx").cast("long"))
    return splits.batches(rows.where(F.col("row_idx") >= splits.resume_point(17, 10)), "row_idx", 10).select("event_id", "batch")


@query("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def missing_keys(spark, sf_dir):
    """Set difference of keys as an anti join."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    orders = orders.where("o_orderstatus = 'P'")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("WITH" + S.GROUP_FOLDED + S.long_sql("folded") + " SELECT method, printf('%5.1f±%3.1f', acc_mean * 100, acc_std * 100) AS acc, printf('%5.1f±%3.1f', f1_mean * 100, f1_std * 100) AS f1 FROM macro")
def text_report(spark, sf_dir):
    found = rounded(metrics.evaluate(S.long_predictions(S.group_folded(spark, sf_dir)), "method"), *MACRO)
    return found.select("method", *[metrics.report_line(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in ("acc", "f1")])
