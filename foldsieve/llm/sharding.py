"""Sharding by jump consistent hashing, in SQL expressions only.

Lamping and Veach (2014): a key draws a sequence of growing jump targets from a
linear congruential generator; its shard among n is the last target below n.
Going from n to n + 1 shards moves a key only into the new shard, or not at all.

Slots number the rows of a shard from 0 without a gap. A shard is cut into
buckets by a hash of key and content; counts of the buckets (shards x buckets
rows, whatever the input) give each bucket its first slot, and rows are
numbered inside their bucket only. So no task sorts a whole shard.

Defined cases: a null key counts as key 0; a null text has size 16 and the
checksum of no bytes; repeated rows are kept, each with its own slot; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsieve.llm.common import n_bytes
from foldsieve.session import work_table

#: Fixed values of the published algorithm.
MULTIPLIER, INCREMENT = 2862933555777941757, 1
BUCKETS = 1024
#: Steps tried for every row; the few rows that need more go on from there.
SHORT = 10


def _modulus() -> Column:
    return F.lit(str(1 << 64)).cast("decimal(20,0)")


def _walk(state: Column, steps: int, limit: int, n: int) -> Column:
    """Up to steps draws on from state; at_n is the last target below n, at_limit below limit.

    Keys are unsigned 64-bit numbers in decimals: the product stays below
    10**38, so no step needs more than multiply, add and remainder.
    """

    def step(s: Column, _: Column) -> Column:
        key = ((s["key"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(INCREMENT)) % _modulus()).cast("decimal(20,0)")
        draw = (F.call_function("div", key, F.lit(1 << 33)) + F.lit(1)).cast("double")
        target = F.floor((s["target"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        after = F.struct(
            key.alias("key"),
            target.alias("target"),
            F.when(s["target"] < n, s["target"]).otherwise(s["at_n"]).alias("at_n"),
            F.when(s["target"] < limit, s["target"]).otherwise(s["at_limit"]).alias("at_limit"),
        )
        return F.when(s["target"] >= limit, s).otherwise(after)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def _start(key: Column) -> Column:
    zero = F.lit(0).cast("long")
    whole = F.coalesce(key.cast("long"), zero).cast("decimal(20,0)")
    return F.struct(
        F.when(whole < 0, whole + _modulus()).otherwise(whole).cast("decimal(20,0)").alias("key"),
        zero.alias("target"),
        zero.alias("at_n"),
        zero.alias("at_limit"),
    )


def with_shards(docs: DataFrame, key: str, n: int) -> DataFrame:
    """docs with the columns shard and grown_shard (among n + 1)."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    limit = n + 1
    # targets grow by one at least, so limit draws always end the walk
    out = docs.withColumn("__jump", _walk(_start(F.col(key)), min(SHORT, limit), limit, n))
    if limit > SHORT:
        more = _walk(F.col("__jump"), limit - SHORT, limit, n)
        out = out.withColumn("__jump", F.when(F.col("__jump.target") >= limit, F.col("__jump")).otherwise(more))
    return out.withColumns(
        {"shard": F.col("__jump.at_n").cast("int"), "grown_shard": F.col("__jump.at_limit").cast("int")}
    ).drop("__jump")


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard."""
    base = docs.select(
        F.col(key),
        (n_bytes(F.col(text)) + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = with_shards(base, key, shards).withColumn(
        "bucket", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(BUCKETS)).cast("int")
    )
    # narrow rows, so the texts are read once
    placed = work_table(placed, "shards")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("first_slot")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    # at most shards x BUCKETS rows, by construction
    return ranked.join(F.broadcast(starts), ["shard", "bucket"]).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("rank")).alias("slot"),
        "grown_shard",
    )
