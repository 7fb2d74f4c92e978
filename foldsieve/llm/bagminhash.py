"""Near-duplicate documents by BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its shingles of five words. For every shingle, weights
are cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8) ...; each interval has
a Poisson process whose rate is its width, seeded by shingle and interval, and
every event has a register and a position in the interval. A text with the
shingle w times sees the events at positions below w. A register keeps the
earliest event seen, so two texts agree in a register with a probability equal
to their weighted Jaccard similarity (Ertl 2018). Events come in order of time,
so a process stops at the text's largest register, and heavy shingles cost the
logarithm of their count.

Signatures are cut into bands. Texts that agree in a band share a bucket.
Buckets are linked by stars, not by all pairs: first to the smallest text of the
bucket, then one text of every component, drawn by a salted order, to one of the
bucket's largest component. What is left in a bucket that still holds several
components is compared exactly: texts of different components, as pairs in small
buckets, and in large ones block against block inside a task, which gives out
links alone; the largest component's texts meet only those outside it. Texts in
one component need no more comparison, and two texts that share several buckets
are compared in the first alone. Every link is verified on the whole texts.

With BANDS bands of ROWS registers, a pair at similarity 0.8 shares no band with
probability below 1e-4, and less above.

Equal texts are one text throughout, known by 128 bits of their SHA-256 and then
by a number (tk), so groups of copies cost one signature's bands once.

Defined cases: a null text counts as empty; texts without words are linked only
to equal texts; texts of fewer than five words are one shingle; repeated rows
belong to one class; a class's id is its smallest non-null key; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsieve.llm.common import digest_words, text_words
from foldsieve.llm.shingles import Bags, U, mix, multisets, overlaps
from foldsieve.operators.components import connected_components
from foldsieve.session import drop_table, work_table

ROWS, BANDS = 7, 40
SIMILARITY = 0.8
#: Similarity of two signatures under which a pair is not verified: five standard deviations below 0.8.
SKETCH_MARGIN = 5.0
BATCH_BYTES = 1 << 20
#: Buckets up to SMALL texts are compared as pairs, larger ones in blocks of about BLOCK.
SMALL, BLOCK = 16, 256
GOLDEN = U(0x9E3779B97F4A7C15)
#: Times are whole ticks, so that sums do not depend on how events are grouped.
TICKS, NEVER = 2.0**40, np.iinfo(np.int64).max


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(texts: list[bytes], registers: int = ROWS * BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Event times of every text's registers (NEVER without shingles), and whether a text has shingles."""
    n = len(texts)
    out = np.full(n * registers, NEVER)
    hashes, owners, counts = multisets(texts)
    has = np.bincount(owners, minlength=n) > 0
    limits = np.where(has, NEVER, -1)
    # one process per shingle and weight interval that begins below the count
    levels = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64) + 1, 1)
    each = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    width = np.where(level == 0, 1.0, low)
    seed = mix(hashes[each] ^ mix(level.astype(U) * GOLDEN))
    owner, weight = owners[each], counts[each].astype(np.float64)
    time = np.zeros(len(each), np.int64)
    step = 0
    while len(seed):
        # few processes left: several of their events at once
        many = int(max(1, min(256, 32768 // len(seed))))
        events = np.arange(step, step + many, dtype=U) * U(2)
        step += many
        draw = seed[:, None] + events[None, :] * GOLDEN
        waits = (-np.log(_unit(mix(draw))) / width[:, None] * TICKS).astype(np.int64) + 1
        when = time[:, None] + np.cumsum(waits, axis=1)
        draw = mix(draw + GOLDEN)
        register = (draw >> U(32)) * U(registers) >> U(32)
        seen = when < limits[owner][:, None]
        position = low[:, None] + width[:, None] * (draw & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        take = seen & (position < weight[:, None])
        at = (owner[:, None] * registers + register.astype(np.int64))[take]
        np.minimum.at(out, at, when[take])
        time = when[:, -1]
        touched = np.unique(owner)
        limits[touched] = out.reshape(n, registers)[touched].max(axis=1)
        alive = time < limits[owner]
        seed, owner, weight, low, width, time = (x[alive] for x in (seed, owner, weight, low, width, time))
    return out.reshape(n, registers), has


def band_keys(times: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of rows registers."""
    bits = np.ascontiguousarray(times).view(U).reshape(len(times), -1, rows)
    keys = np.broadcast_to(np.arange(bits.shape[1], dtype=U) * GOLDEN, bits.shape[:2]).copy()
    for j in range(rows):
        keys = mix(keys ^ bits[:, :, j]) + GOLDEN
    return keys.view(np.int64)


def sketches(times: np.ndarray) -> np.ndarray:
    """16 bits of every register."""
    return (mix(np.ascontiguousarray(times).view(U)) >> U(48)).astype("<u2")


def signed_documents(docs: DataFrame, key: str, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """key, one and two (128 bits of the text), bands (empty without words), sketch."""
    schema = docs.select(key).schema.add("one", "long").add("two", "long").add("bands", T.ArrayType(T.LongType())).add("sketch", "binary")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(1).cast(pa.binary())
            while at < len(texts):
                run, held = [], 0
                while at + len(run) < len(texts) and held < BATCH_BYTES:
                    run.append(texts[at + len(run)].as_py() or b"")
                    held += len(run[-1])
                times, has = signatures(run, rows * bands)
                keys, marks = band_keys(times, rows), sketches(times)
                offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                ids = digest_words(run)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(run)),
                        pa.array(ids[:, 0]),
                        pa.array(ids[:, 1]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel())),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    names=schema.names,
                )
                at += len(run)

    return docs.select(key, "text").mapInArrow(sign, schema)


def _verified(pairs: DataFrame, sketch: DataFrame, texts: DataFrame, similarity: float, registers: int) -> DataFrame:
    """The pairs (a, b) of text keys whose whole texts overlap by the similarity or more."""
    least = similarity - SKETCH_MARGIN * (similarity * (1 - similarity) / registers) ** 0.5

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
                keep = (a == b).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = sketch.select(F.col("tk").alias("a"), F.col("sketch").alias("sa"))
    two = sketch.select(F.col("tk").alias("b"), F.col("sketch").alias("sb"))
    close = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")
    close = work_table(close, "close-pairs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = ([x or b"" for x in part.column(i).cast(pa.binary()).to_pylist()] for i in (2, 3))
                keep = overlaps(left, right) >= similarity - 1e-12
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("tk").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("tk").alias("b"), F.col("text").alias("tb"))
    return close.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """One row per document: key, one and two (its text), tk (the text's number), class_tk (its class's smallest number)."""
    signed = work_table(signed_documents(docs, key, rows, bands), "signed")
    unique = signed.select("one", "two", "bands", "sketch").dropDuplicates(["one", "two"])
    # numbers of one run; what is returned does not depend on them
    unique = work_table(unique.withColumn("tk", F.monotonically_increasing_id()), "signatures")
    numbered = work_table(signed.select(key, "one", "two").join(unique.select("one", "two", "tk"), ["one", "two"]), "numbered")
    drop_table(signed)
    spread = unique.select("tk", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("tk").alias("a"), F.max("tk").alias("z")).where("a <> z").select("bucket", "a")
    # a table, so that Spark can split the rows of a hot bucket over many tasks
    shared = work_table(shared, "shared-buckets")
    members = work_table(spread.join(shared, "bucket").select("bucket", "a", F.col("tk").alias("b")), "buckets")
    # one row of documents per text that is in a bucket with others
    wanted = members.select(F.col("b").alias("tk")).distinct()
    first = numbered.groupBy("tk", F.col("one").alias("__one"), F.col("two").alias("__two")).agg(F.min(key).alias("__key")).join(wanted, "tk")
    one, two = text_words(F.col("text"))
    rows_of = docs.select(F.col(key).alias("__own"), "text", one.alias("__1"), two.alias("__2"))
    # a text whose every row has a null key is taken by that null
    same = (F.col("__1") == F.col("__one")) & (F.col("__2") == F.col("__two")) & F.col("__own").eqNullSafe(F.col("__key"))
    # repeated rows once; a table, so that Spark can split the rows of a hot hub over many tasks
    texts = work_table(rows_of.join(first, same).select("tk", "text").dropDuplicates(["tk"]), "texts")
    sketch = unique.select("tk", "sketch")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        return work_table(_verified(pairs, sketch, texts, similarity, rows * bands), name)

    tried = work_table(members.where("a <> b").select("a", "b").distinct(), "pairs")
    links = verify(tried, "links")
    for salt in (1, 2):
        held = _held(members, links)
        order = F.xxhash64(F.lit(salt), "tk")
        best = work_table(held.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min_by("tk", order).alias("tk")), "best")
        star = best.groupBy("bucket").agg(F.max_by("tk", F.struct("n", F.xxhash64(F.lit(salt), "component"), "tk")).alias("hub"))
        more = best.join(work_table(star, "hubs"), "bucket").where("tk <> hub").select(F.least("tk", "hub").alias("a"), F.greatest("tk", "hub").alias("b"))
        more = work_table(more.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(more)
        links = links.unionByName(verify(more, "links"))
    held = _held(members, links)
    small = held.where(F.col("size") <= SMALL)
    left = small.select("bucket", F.col("tk").alias("a"), F.col("component").alias("ca"))
    right = small.select("bucket", F.col("tk").alias("b"), F.col("component").alias("cb"))
    rest = left.join(right, "bucket").where("a < b and ca <> cb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    large = _in_blocks(held.where(F.col("size") > SMALL), unique.select("tk", "bands", "sketch"), texts, similarity, rows * bands)
    links = work_table(links.unionByName(verify(rest, "links")).unionByName(large), "links")
    found = connected_components(links, "a", "b")
    out = numbered.join(found, F.col("tk") == F.col("node"), "left")
    return out.select(key, "one", "two", "tk", F.coalesce("component", "tk").alias("class_tk"))


def _in_blocks(held: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float, registers: int) -> DataFrame:
    """Links (a, b) between components of large buckets.

    The texts outside a bucket's largest component are dealt into blocks of
    about BLOCK, and so are those inside it; every block of the former meets
    every block in a task's memory. There, pairs of different components whose
    first common band is this bucket's are compared by sketch, and confirmed on
    whole texts by falling similarity; texts already linked are not compared.
    """
    least = similarity - SKETCH_MARGIN * (similarity * (1 - similarity) / registers) ** 0.5
    parts = held.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    shape = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n_all"))
    outer = F.ceil((F.col("n_all") - F.col("n_major")) / BLOCK).cast("int").alias("outer")
    shape = work_table(shape.select("bucket", "major", outer, F.ceil(F.col("n_major") / BLOCK).cast("int").alias("inner")), "blocks")
    own = held.select("bucket", "tk", "component").join(shape, "bucket")
    block = F.when(F.col("component") == F.col("major"), F.col("outer") + F.pmod(F.xxhash64("tk"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("tk"), F.col("outer")))
    own = own.withColumn("block", block.cast("int"))
    last = F.when(F.col("block") >= F.col("outer"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    cells = own.select("bucket", "tk", "component", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    cells = cells.select("bucket", "tk", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = cells.join(signed, "tk").join(texts, "tk").select("bucket", "i", "j", "block", "tk", "component", "sketch", "text", "bands")

    def links(cell: list[tuple]) -> Iterator[tuple[int, int]]:
        bucket, i, j = cell[0][:3]
        block, tk, group = (np.asarray([r[k] for r in cell]) for k in (3, 4, 5))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return
        marks = np.frombuffer(b"".join(r[6] for r in cell), "<u2").reshape(len(cell), -1)
        keys = np.stack([np.asarray(r[8], np.int64) for r in cell])
        unmet = group[left][:, None] != group[right][None, :]
        if i == j:
            unmet &= tk[left][:, None] < tk[right][None, :]
        for band in range(keys.shape[1]):
            # no pair of the bucket that also shares an earlier band
            if keys[left[0], band] == bucket:
                break
            unmet &= keys[left, band][:, None] != keys[right, band][None, :]
        x, y = np.nonzero(unmet)
        x, y = left[x], right[y]
        alike = np.zeros(len(x))
        for at in range(0, len(x), 8192):
            alike[at : at + 8192] = (marks[x[at : at + 8192]] == marks[y[at : at + 8192]]).mean(axis=1)
        near = np.flatnonzero(alike >= least)
        if not len(near):
            return
        near = near[np.argsort(-alike[near], kind="stable")]
        x, y = x[near], y[near]
        bags, size = Bags([(r[7] or "").encode() for r in cell]), 64
        while len(x):
            # most links come first: short runs of pairs not yet linked, then longer ones
            apart = np.flatnonzero(group[x] != group[y])
            x, y = x[apart], y[apart]
            a, b = x[:size], y[:size]
            linked = bags.similarities(a, b) >= similarity - 1e-12
            for p, q in zip(a[linked], b[linked]):
                if group[p] != group[q]:
                    yield min(tk[p], tk[q]), max(tk[p], tk[q])
                    group[group == group[q]] = group[p]
            x, y, size = x[size:], y[size:], min(2 * size, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            pairs = list(links(cell))
            return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        cell: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if cell and cell[0][:3] != row[:3]:
                    yield flush()
                    cell = []
                cell.append(row)
        if cell:
            yield flush()

    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "a long, b long")


def _held(members: DataFrame, links: DataFrame) -> DataFrame:
    """bucket, tk, component, size of the buckets that still hold several components."""
    found = connected_components(links, "a", "b")
    now = members.join(found, F.col("b") == F.col("node"), "left").select(
        "bucket", F.col("b").alias("tk"), F.coalesce("component", "b").alias("component")
    )
    now = work_table(now, "components")
    mixed = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y")
    # a table, so that Spark can split the rows of a hot bucket over many tasks
    return work_table(now.join(work_table(mixed.select("bucket", "size"), "mixed-buckets"), "bucket"), "held")


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, class_id (smallest key of its class), class_size, n_copies of its text."""
    found = work_table(near_duplicates(docs, key), "classes")
    classes = found.groupBy("class_tk").agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"))
    copies = found.groupBy("tk").agg(F.count("*").alias("n_copies"))
    classes, copies = work_table(classes, "class-sizes"), work_table(copies, "copies")
    return found.join(classes, "class_tk").join(copies, "tk").select(key, "class_id", "class_size", "n_copies")


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with one document of each class, that of the smallest key (of equal keys, the smallest digest); columns as in docs."""
    found = near_duplicates(docs, key)
    kept = found.groupBy("class_tk").agg(F.min(F.struct(key, "one", "two")).alias("kept")).select("kept.*")
    kept = work_table(kept.select(F.col("one").alias("__one"), F.col("two").alias("__two"), F.col(key).alias("__key")), "kept")
    one, two = text_words(F.col("text"))
    rows = docs.withColumns({"__1": one, "__2": two})
    same = (rows["__1"] == kept["__one"]) & (rows["__2"] == kept["__two"]) & rows[key].eqNullSafe(kept["__key"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["__1", "__2", key]).select(*docs.columns)
