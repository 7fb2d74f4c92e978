"""Mixing sources to target weights by weighted fair queueing, in SQL functions only.

Documents of a source queue in an order shuffled by a hash, and are cut into
packets of at most PACKET words (the pipeline's mix takes whole documents as
packets). A packet's virtual finish time is the source's words up to its end
divided by the source's target; a second pass over the source follows the first.
A source's clock stops at 1, so packets that would begin later are not queued.
All packets are range-sorted by finish time over all sources, and the stream is
truncated where its running total reaches the budget, inside the packet that
reaches it. So each source's words are within one packet of its target, and all
words together meet the budget exactly.

In its own queue a source's packets finish in order, so what the truncated
stream holds of a source is a prefix of its queue: one number per source, the
words handed out, tells the words taken of each document.

Running sums take two levels: sums of (source, hash bucket) first, then running
sums inside one bucket, so that a source with a third of all rows is spread
over as many tasks as it has buckets. The stream's running total takes three:
sums of range partitions, of slices of time inside the partition that reaches
the budget, then packet by packet inside that slice.

Defined cases: a null text has no words; a null source is a source and comes
last; a source without words has target 0; repeated rows count as often as they
occur, and are equals in the queue: rows with the same key and text stand next
to each other, and rows equal in every column are interchangeable, so reruns
agree; an empty table gives an empty result; other columns are kept out of the
computation, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsieve.llm.common import BROADCAST_ROWS, bounded, n_words
from foldsieve.session import work_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a packet at most.
PACKET = 256
#: Rows of a bucket of the queue, on average; a bucket is a prefix of the shuffle hash.
BUCKET_ROWS = 4096
#: Slices of virtual time: of the stream's end when it is cut, and of the mix when rows are laid out.
SLICES = 4096


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: its place in code point order, source_size, weight, target.

    The budget, share times all sizes, is divided by weight; what a source
    would get above most times its size is divided anew among the others.
    Sorted by cap over weight, sources are capped up to a first one that is
    not, so one running sum replaces the rounds.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    cap = (F.col("source_size") * most).cast("double")
    ranked = sums.withColumn("place", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", cap)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    ranked = ranked.withColumns(
        {
            "budget": F.sum("source_size").over(everything).cast("double") * share,
            "cap_before": F.coalesce(F.sum("cap").over(earlier), zero),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), zero),
        }
    ).withColumn("full", F.col("weight") * (F.col("budget") - F.col("cap_before")) / F.col("weight_left") >= F.col("cap"))
    capped = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), zero).otherwise(F.col("weight"))).over(everything)
    level = F.col("weight") * (F.col("budget") - capped) / F.greatest(open_weight, F.lit(1e-9))
    return ranked.select("source", "place", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(level).alias("target"))


def queue_key(key: Column, text: Column) -> Column:
    """The shuffle order: the same on every run and machine, of key and whole text."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), digest))


def _bucketed(sized: DataFrame, name: str) -> DataFrame:
    """sized as a table with bucket. Buckets are how the work is laid out; the queue's order does not depend on them."""
    table = work_table(sized, name)
    return table.withColumn("bucket", F.substring("turn", 1, max(1, math.ceil(math.log(max(table.count() / BUCKET_ROWS, 1), 16)))))


def bucket_starts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, bucket, start (words of the source before the bucket), source_size, target, place. A row per source and bucket."""
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").cast("long").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("long").alias("start"))
    return starts.join(targets, starts["s"].eqNullSafe(targets["source"])).select("source", "bucket", "start", "source_size", "target", "place")


def with_queue(sized: DataFrame, starts: DataFrame) -> DataFrame:
    """sized (source, size, bucket, turn, ...) with source_size, target, place and words_before in the source's queue."""
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
    ends = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target", "place")
    joined = rows.join(ends, rows["source"].eqNullSafe(ends["s"]) & (rows["bucket"] == ends["b"]))
    return joined.withColumn("words_before", F.col("start") + F.col("inner")).drop("s", "b", "start", "inner")


def packets(queued: DataFrame, most: int = MOST, packet: int | None = PACKET) -> DataFrame:
    """place, finish, piece (words), end (the source's words up to the packet's) of all packets that begin before their clock stops."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    rows = queued.where("size > 0 AND target > 0").select("place", "target", "size", "source_size", "words_before", passes)
    rows = rows.withColumn("begin", F.col("source_size") * F.col("pass") + F.col("words_before")).where("begin < target")
    if packet is None:
        rows = rows.withColumn("piece", F.col("size"))
    else:
        parts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))
        rows = rows.withColumn("at", F.explode(parts)).withColumn("piece", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("at")))
        rows = rows.withColumn("begin", F.col("begin") + F.col("at")).where("begin < target")
    end = F.col("begin") + F.col("piece")
    return rows.select("place", (end / F.col("target")).alias("finish"), "piece", end.alias("end"))


def truncated(stream: DataFrame, goal: int) -> DataFrame:
    """place, handed: the words of each source in the stream of packets, range-sorted by finish and cut at the goal."""
    ordered = stream.repartitionByRange(F.col("finish"), F.col("place")).withColumn("part", F.spark_partition_id())
    ordered = work_table(ordered, "mix-stream")

    def crossing(rows: DataFrame, by: str, already: int) -> tuple[int | None, int]:
        """The group of rows in which the running total reaches the goal, and the total before it: one row comes to the driver."""
        sums = rows.groupBy(by).agg(F.sum("piece").alias("words"))
        upto = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        found = sums.withColumn("upto", F.sum("words").over(upto) + already).where(F.col("upto") >= goal).orderBy(by).limit(1).collect()
        return (found[0][by], found[0]["upto"] - found[0]["words"]) if found else (None, 0)

    part, before = crossing(ordered, "part", 0)
    whole = ordered if part is None else ordered.where(F.col("part") < part)
    handed = whole.groupBy("place").agg(F.max("end").alias("handed"))
    if part is None:
        return handed
    last = ordered.where(F.col("part") == part)
    low, high = last.agg(F.min("finish"), F.max("finish")).first()
    slice_of = F.floor((F.col("finish") - F.lit(low)) / F.lit(max(high - low, 1e-300)) * SLICES).cast("int")
    last = last.withColumn("slice", slice_of)
    at, before = crossing(last, "slice", before)
    upto = Window.partitionBy("slice").orderBy("finish", "place").rowsBetween(Window.unboundedPreceding, 0)
    edge = last.where(F.col("slice") == at).withColumn("upto", F.sum("piece").over(upto) + before)
    # the packet that reaches the budget is cut inside, later ones are out
    edge = edge.where(F.col("upto") - F.col("piece") < goal).withColumn("end", F.col("end") - F.greatest(F.col("upto") - goal, F.lit(0)))
    parts = handed.unionByName(last.where(F.col("slice") < at).groupBy("place").agg(F.max("end").alias("handed")))
    parts = parts.unionByName(edge.groupBy("place").agg(F.max("end").alias("handed")))
    return parts.groupBy("place").agg(F.max("handed").cast("long").alias("handed"))


def _handed(sized: DataFrame, targets: DataFrame, share: float, most: int, packet: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows in their queues, and a row per source: place, handed."""
    starts = work_table(bucket_starts(sized, targets), "mix-starts")
    queued = work_table(with_queue(sized, starts), "mix-queue")
    total = targets.agg(F.sum("source_size").alias("total")).first()["total"] or 0
    handed = truncated(packets(queued, most, packet), min(math.floor(share * total + 0.5), most * total))
    return queued, work_table(handed, "mix-handed")


def taken_words(most: int = MOST) -> Column:
    """Words taken of a row over all passes, given the words handed out of its source."""
    handed = F.coalesce(F.col("handed"), F.lit(0))
    parts = [
        F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), handed - F.col("source_size") * turn - F.col("words_before")))
        for turn in range(most)
    ]
    return sum(parts[1:], parts[0]).cast("long")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    packet: int | None = PACKET,
) -> DataFrame:
    """One row per document: key, size, source_size, target, taken."""
    sized = docs.select(F.col(key), "source", n_words(F.col("text")).alias("size"), queue_key(F.col(key), F.col("text")).alias("turn"))
    sized = _bucketed(sized, "mix")
    targets = work_table(source_targets(sized, weights, share, most), "mix-targets")
    queued, handed = _handed(sized, targets, share, most, packet)
    return queued.join(handed, "place", "left").select(key, "size", "source_size", "target", taken_words(most).alias("taken"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs' rows as the mix hands them out: whole documents, repeated by pass, in slices of virtual time and by time inside them.

    Packets are whole documents, and a document that the budget cuts is handed
    out whole, so the words pass the budget by less than one document. The
    budget is found on narrow rows. Then each row goes, once, to the slice of
    time in which its bucket of the queue begins; its exact place is summed up
    there. Texts without words stand once, at their place in the first pass. Columns as in docs.
    """
    # the row travels as one value, so that its columns may have any names
    others = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    size, turn = n_words(F.col("text")), F.concat(queue_key(F.col(key), F.col("text")), F.hex(others))
    sized = docs.select(F.struct(*docs.columns).alias("row"), "source", size.alias("size"), turn.alias("turn"))
    narrow = _bucketed(sized.drop("row"), "mix-sizes")
    targets = work_table(source_targets(narrow, weights, share, most), "mix-targets")
    _, handed = _handed(narrow, targets, share, most, None)
    # rows meet a table of their buckets that is small enough to be sent to them
    layout = F.substring("turn", 1, max(1, int(math.log(max(BROADCAST_ROWS / max(targets.count(), 1), 1), 16))))
    sized = sized.withColumn("bucket", layout)
    starts = bucket_starts(narrow.withColumn("bucket", layout), targets).join(handed, "place", "left").withColumn("handed", F.coalesce("handed", F.lit(0)))
    ends = bounded(work_table(starts, "mix-layout")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target", "handed")
    rows = sized.join(ends, sized["source"].eqNullSafe(ends["s"]) & (sized["bucket"] == ends["b"])).drop("s", "b")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    rows = rows.withColumn("start", F.col("source_size") * F.col("pass") + F.col("start")).where("start < handed OR (size = 0 AND pass = 0)")
    clock = F.greatest(F.col("target"), F.lit(1.0))
    rows = rows.withColumn("slice", F.least(F.floor(F.col("start") / clock * SLICES), F.lit(SLICES)).cast("int"))
    rows = rows.repartitionByRange("slice", "bucket")
    inside = Window.partitionBy("slice", "bucket", "source", "pass").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.where("IF(size = 0, pass = 0, begin < handed)").withColumn("time", F.col("begin") / clock)
    return rows.sortWithinPartitions("slice", "time", "turn").select("row.*")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'), ':', md5(coalesce(text, '')))) AS turn
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place, (source_size * 2)::DOUBLE AS cap FROM sums
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM ranked
), filling AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget,
         coalesce(sum(cap) OVER w, 0.0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS weight_left
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, weight * (budget - cap_before) / weight_left >= cap AS is_full FROM filling
), targets AS (
  SELECT source, place, source_size,
         CASE WHEN is_full THEN cap ELSE weight * (budget - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ())
              / greatest(sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER (), 1e-9) END AS target
  FROM marked
), queued AS (
  SELECT doc_id, size, source_size, target, place, row_number() OVER () AS rid,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, source_size * lap + words_before + word AS start, least(256, size - word) AS piece
  FROM (SELECT *, unnest(generate_series(0, size - 1, 256)) AS word FROM queued, (SELECT unnest([0, 1]) AS lap) WHERE size > 0 AND target > 0)
  WHERE source_size * lap + words_before + word < target
), stream AS (
  SELECT *, sum(piece) OVER (ORDER BY (start + piece) / target, place) - piece AS ahead FROM passes
), taken AS (
  SELECT rid, sum(least(piece, greatest(0, (SELECT round(1.5 * sum(source_size)) FROM sums) - ahead)))::BIGINT AS taken FROM stream GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN taken USING (rid)
"""
