"""Representatives, keyed deduplication, folds, batches and resume points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED, FOLDS = 42, 5
#: Hex digits of the shuffle key by which rows are counted before they are numbered.
PREFIX = 3


def majority_label(y: str = "y") -> Column:
    """The larger class as an aggregate; a tie is 0."""
    return (F.avg(F.col(y).cast("double")) > 0.5).cast("int")


def cluster_stats(samples: DataFrame, cluster: str = "cluster", y: str = "y") -> DataFrame:
    """cluster, size, positives, any_pos, any_neg, mixed, majority."""
    return (
        samples.groupBy(cluster)
        .agg(
            F.count("*").alias("size"),
            F.sum(F.col(y).cast("long")).alias("positives"),
            F.bool_or(F.col(y) == 1).alias("any_pos"),
            F.bool_or(F.col(y) == 0).alias("any_neg"),
            majority_label(y).alias("majority"),
        )
        .withColumn("mixed", F.col("any_pos") & F.col("any_neg"))
    )


def representatives(samples: DataFrame, cluster: str = "cluster", y: str = "y", order: str = "row_idx", rule: str = "majority") -> DataFrame:
    """cluster, the order value of its representative, majority.

    rule "majority": the first member with the majority label; "first": the first member.
    Minima per cluster and label, so no cluster is sorted.
    """
    label = F.col(y)
    found = samples.groupBy(cluster).agg(
        majority_label(y).alias("majority"),
        F.min(order).alias("first"),
        F.min(F.when(label == 1, F.col(order))).alias("first_1"),
        F.min(F.when(label == 0, F.col(order))).alias("first_0"),
    )
    chosen = F.col("first") if rule == "first" else F.when(F.col("majority") == 1, F.col("first_1")).otherwise(F.col("first_0"))
    return found.select(cluster, chosen.alias(order), "majority")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the smallest order value."""
    names = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*names), F.col(order)).alias("row")
    return rows.groupBy(key).agg(first).select(key, *[f"row.{c}" for c in names])


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the value with the largest order value."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def shuffle_key(key: str, seed: int = SEED) -> Column:
    """The same pseudo-random sort key on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def numbered(rows: DataFrame, by: str, lead: list[Column], key: str, seed: int, name: str) -> DataFrame:
    """rows with name: their number from 0 within by, ordered by lead, then in the shuffle order of key.

    Counts by a prefix of the shuffle key give each prefix its first number, and
    rows are numbered inside their prefix only, so a class that holds half of
    all rows is not sorted in one task.
    """
    leads = {f"__lead{i}": c for i, c in enumerate(lead)}
    turned = rows.withColumns({"__turn": shuffle_key(key, seed), **leads}).withColumn("__prefix", F.substring("__turn", 1, PREFIX))
    slot = [by, *leads, "__prefix"]
    before = Window.partitionBy(by).orderBy(*leads, "__prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = turned.groupBy(*slot).agg(F.count("*").alias("n")).withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_{c}") for c in slot], "__start")
    inside = F.row_number().over(Window.partitionBy(*slot).orderBy("__turn", key)) - 1
    same = F.lit(True)
    for c in slot:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = turned.withColumn("__inside", inside).join(starts, same)
    return joined.select(*rows.columns, (F.col("__start") + F.col("__inside")).alias(name))


def stratified_folds(rows: DataFrame, key: str, y: str = "y", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """rows with fold; every class is spread so that its fold sizes differ by one at most."""
    placed = numbered(rows, y, [], key, seed, "__place")
    return placed.withColumn("fold", (F.col("__place") % folds).cast("int")).drop("__place")


def group_folds(stats: DataFrame, cluster: str = "cluster", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """cluster, fold: clusters of a majority class, largest first, are laid out to and fro over the folds.

    One row per cluster. No cluster spans folds, sizes and classes stay near even.
    """
    placed = numbered(stats, "majority", [-F.col("size")], cluster, seed, "__place")
    place = F.col("__place")
    lap, step = F.floor(place / folds), place % folds
    return placed.select(cluster, F.when(lap % 2 == 0, step).otherwise(folds - 1 - step).cast("int").alias("fold"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with batch (from 0) by a contiguous order column."""
    return rows.withColumn("batch", F.floor(F.col(order) / size).cast("long"))


def resume_point(start: int, size: int) -> int:
    """First row (from 0) of the batch that holds the start-th row (from 1)."""
    return (start - 1) // size * size


def balanced_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    """rows with weight n / (2 * n of the class); the counts are two rows."""
    counts = rows.groupBy(y).agg(F.count("*").alias("n_class"))
    total = counts.withColumn("n_all", F.sum("n_class").over(Window.partitionBy()))
    weights = total.select(y, (F.col("n_all") / (2 * F.col("n_class"))).alias("weight"))
    return rows.join(F.broadcast(weights), y)


def assert_complete(rows: DataFrame, column: str, policy: str = "error") -> DataFrame:
    """Rows whose verdict is missing: "error" fails, "negative" reads 0, "drop" leaves them out."""
    missing = F.col(column).isNull()
    if policy == "drop":
        return rows.where(~missing)
    other = F.lit(0) if policy == "negative" else F.raise_error(F.lit(f"missing {column}"))
    return rows.withColumn(column, F.when(missing, other).otherwise(F.col(column)))
