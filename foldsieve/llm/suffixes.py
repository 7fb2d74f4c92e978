"""Removal of byte strings that occur more than once, by a logarithmic family of suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts anywhere else,
in the same text or another, is removed. Matches are exact and judged on the
input.

1. Anchors. Among the hashes of the GRAM-byte strings of every LENGTH-byte
   window the smallest is an anchor (all of them, where equal). Equal windows
   have equal anchors at equal offsets, so two equal windows always meet at an
   anchor whose gram occurs twice; about one byte in 75 is an anchor. An anchor
   carries a hash of its context, the bytes of all windows that hold it.
2. Counts by gram and by context, in Spark with partial sums. A context that
   occurs twice is covered whole; a gram that occurs once covers nothing. Only
   contexts that occur once but share their gram with others are open.
3. Open contexts and one copy of each other context of their gram meet by gram
   in an index family: each batch of contexts gets the suffix array of its
   windows, ordered by a 64-bit fingerprint of their first LENGTH bytes together
   with the gram's hash (only equality of whole windows is asked, so any order
   that puts equal windows side by side will do, and integers merge fast). The
   batch's array is merge-scanned against the levels; levels of like size merge,
   so a window is merged about log2(batches) times. A family ends at a gram's
   border once it holds FAMILY_ROWS contexts, so memory is bounded.
4. A gram's contexts are dealt into blocks of about BLOCK, each in a family of
   its own; a gram with few contexts is one block and is done. Where there are
   more blocks, each gives out its distinct windows once (copies inside it are
   marked already), dealt by salts of the window's key, and the blocks' arrays of
   one gram and salt are merged in a second round of families. So no task holds
   more than a block's worth of windows, however hot a gram is, and a window that
   every context holds travels once per block.
5. All windows of an anchor hold its gram, so what its repeated windows cover is
   one interval, from the first to the last of them. Intervals go back to their
   texts, which are cut.

Contexts that are the same in every byte are one entry of the index with a
count: the grouped sums of step 2 are its pre-aggregation, and an entry counted
twice is a match by itself, covered whole.

Texts are known by 128 bits of their SHA-256; equal texts share their intervals.

Defined cases: a null text counts as empty; texts under LENGTH bytes hold no
window and stay whole; repeated rows with LENGTH bytes or more lose every byte;
an empty table gives an empty result; other columns pass through or are not
looked at, as the function says.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsieve.llm.common import digest_words, text_words
from foldsieve.llm.shingles import U, mix
from foldsieve.session import drop_table, release, work_table

LENGTH, GRAM = 200, 48
#: Grams in a window; offsets of an anchor in its windows are 0 to SPAN - 1.
SPAN = LENGTH - GRAM + 1
CONTEXT = LENGTH + SPAN - 1
#: Contexts in a block of one gram: about how many of a hot gram's meet in one family.
BLOCK = 2048
#: Contexts after which a family ends at the next block's border (their windows take some 16 MB), and in one of its batches.
FAMILY_ROWS, FAMILY_BATCH = 8192, 2048
SEGMENT = 1 << 18


@functools.lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte (0 for none), multipliers for doubling, powers and inverse powers."""
    rng = np.random.default_rng(86028157)
    table = np.concatenate([rng.integers(1, 2**64, 256, dtype=U), np.zeros(1, U)])
    doubling = rng.integers(0, 2**64, 16, dtype=U) | U(1)
    base = 0x9E3779B97F4A7C15
    powers = np.asarray([pow(base, i, 1 << 64) for i in range(CONTEXT)], U)
    inverse = pow(base, -1, 1 << 64)
    return table, doubling, powers, np.asarray([pow(inverse, i, 1 << 64) for i in range(CONTEXT)], U)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place on, never 0, by doubling."""
    table, factors, _, _ = _constants()
    parts, hashes, size, at = [], table[data], 1, 0
    while True:
        if GRAM & size:
            parts.append((size, hashes))
        if size * 2 > GRAM:
            break
        hashes = hashes[:-size] * factors[at] + hashes[size:]
        size, at = size * 2, at + 1
    total, begin, n = None, 0, len(data) - GRAM + 1
    for size, hashes in reversed(parts):
        part = hashes[begin : begin + n]
        total = part.copy() if total is None else total * factors[at] + part
        begin, at = begin + size, at + 1
    return mix(total) | U(1)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every run of width values."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _anchors(data: np.ndarray, owner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all windows inside one owner."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    hashes = _gram_hashes(data)
    least = _sliding(hashes, SPAN, np.minimum)
    if owner is not None:
        least[owner[: len(least)] != owner[LENGTH - 1 :]] = 0
    none = np.zeros(SPAN - 1, U)
    reached = _sliding(np.concatenate([none, least, none]), SPAN, np.maximum)
    places = np.flatnonzero(reached == hashes)
    return places, hashes[places]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor of the texts: number of the text, place in it, gram hash, context hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.asarray([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if len(data) <= 2 * SEGMENT:
        places, grams = _anchors(data, np.repeat(np.arange(len(texts), dtype=np.int32), sizes))
    else:
        found = []
        for begin, end in zip(begins, ends):
            for at in range(begin, max(begin + 1, end - LENGTH + 1), SEGMENT):
                p, g = _anchors(data[at : min(end, at + SEGMENT + LENGTH - 1)], None)
                found.append((p + at, g))
        places, grams = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        places, first = np.unique(places, return_index=True)  # a place may serve two segments
        grams = grams[first]
    owners = np.searchsorted(ends, places, "right")
    table, _, powers, _ = _constants()
    contexts = np.zeros(len(places), U)
    span = np.arange(-(SPAN - 1), LENGTH)
    for at in range(0, len(places), 2048):
        p, o = places[at : at + 2048], owners[at : at + 2048]
        index = p[:, None] + span
        inside = (index >= begins[o][:, None]) & (index < ends[o][:, None])
        values = np.where(inside, table[data[np.where(inside, index, 0)]], U(0))
        contexts[at : at + 2048] = mix((values * powers).sum(axis=1, dtype=U))
    return owners, places - begins[owners], grams, contexts


def windows(contexts: list[bytes], lefts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows of every context by the anchor's offset (n x SPAN), and which of them exist."""
    table, _, powers, inverse = _constants()
    n = len(contexts)
    sizes = np.asarray([len(c) for c in contexts], np.int64)
    begin = SPAN - 1 - lefts
    cells = np.full((n, CONTEXT), 256, np.int16)
    column = np.arange(CONTEXT)
    filled = (column >= begin[:, None]) & (column < (begin + sizes)[:, None])
    cells[filled] = np.frombuffer(b"".join(contexts), np.uint8)
    sums = np.zeros((n, CONTEXT + 1), U)
    np.cumsum(table[cells] * powers, axis=1, out=sums[:, 1:])
    start = np.arange(SPAN - 1, -1, -1)  # offset o starts at column SPAN - 1 - o
    keys = (sums[:, start + LENGTH] - sums[:, start]) * inverse[start]
    exists = (start >= begin[:, None]) & (start + LENGTH <= (begin + sizes)[:, None])
    # equal windows have equal anchors at equal offsets; with the offset in the key, a window that
    # holds one gram twice does not meet itself
    return mix((keys ^ mix(grams)[:, None]) + mix(start.astype(U))), exists


class IndexFamily:
    """Levels of suffix arrays (sorted window keys with their place); hits tells of every key added whether it occurs again."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.marks: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, exists: np.ndarray | None = None) -> None:
        """A batch of keys; places count over all batches."""
        where = np.arange(keys.size) if exists is None else np.flatnonzero(exists)
        array = keys.ravel()[where]
        order = np.argsort(array, kind="stable")
        array, where = array[order], where[order] + self.size
        self.size += keys.size
        again = array[1:] == array[:-1]
        self.marks += [where[1:][again], where[:-1][again]]
        first = np.concatenate([[True], ~again]) if len(array) else np.zeros(0, bool)
        array, where = array[first], where[first]
        for level, at in self.levels:
            spot = np.searchsorted(level, array)
            spot[spot == len(level)] = 0
            met = level[spot] == array
            self.marks += [where[met], at[spot[met]]]
            array, where = array[~met], where[~met]
        if not len(array):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(array):
            level, at = self.levels.pop()
            array, where = np.concatenate([level, array]), np.concatenate([at, where])
            order = np.argsort(array, kind="stable")  # merges two sorted runs
            array, where = array[order], where[order]
        self.levels.append((array, where))

    def hits(self) -> np.ndarray:
        out = np.zeros(self.size, bool)
        for places in self.marks:
            out[places] = True
        return out


ID = ["rid", "rid2"]
INTERVAL = "rid long, rid2 long, pos int, most int, least int"


def _anchor_table(docs: DataFrame) -> DataFrame:
    schema = "gram long, context long, rid long, rid2 long, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(0).cast(pa.binary())
            while at < len(texts):
                group, held = [], 0
                while at < len(texts) and held < SEGMENT:
                    group.append(texts[at].as_py() or b"")
                    held += len(group[-1])
                    at += 1
                ids = digest_words(group)
                owners, places, grams, contexts = anchors(group)
                columns = [grams.view(np.int64), contexts.view(np.int64), ids[owners, 0], ids[owners, 1], places.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "context", *ID, "pos"])

    return docs.select("text").mapInArrow(run, schema)


ROW = "gram long, block int, blocks int, rid long, rid2 long, pos int, left int, bytes binary"


def _context_rows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, block, blocks, rid, rid2, pos, left, context bytes of the wanted anchors (gram, blocks, rid, rid2, pos), read from texts (rid, rid2, text)."""
    per_text = wanted.groupBy(*ID).agg(F.collect_set(F.struct("pos", "gram", "blocks")).alias("marks"))
    # a table, so that Spark can split the copies of one text over many tasks
    joined = texts.join(work_table(per_text, "marks"), ID).select(*ID, "text", *[F.col(f"marks.{c}").alias(c) for c in ("pos", "gram", "blocks")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies of one text give the same rows
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        names = ["gram", "block", "blocks", *ID, "pos", "left", "bytes"]
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in kinds)
            for rid, rid2, text, *marks in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), *batch.columns[3:]):
                rid, rid2 = rid.as_py(), rid2.as_py()
                if (rid, rid2) in seen:
                    continue
                seen.add((rid, rid2))
                text = text.as_py()
                for p, gram, blocks in zip(*(m.as_py() for m in marks)):
                    begin = max(0, p - SPAN + 1)
                    row = (gram, (rid2 + p * 0x9E3779B1) % blocks, blocks, rid, rid2, p, p - begin, text[begin : p + LENGTH])
                    for values, value in zip(out, row):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return joined.mapInArrow(run, ROW)


def _intervals(ids: np.ndarray, owners: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """rid, rid2, pos, most, least of the contexts (n x 3 ids) that own a repeated window, by its offset."""
    most, least = np.full(len(ids), -1), np.full(len(ids), SPAN)
    np.maximum.at(most, owners, offsets)
    np.minimum.at(least, owners, offsets)
    found = np.flatnonzero(most >= 0)
    return [ids[found, 0], ids[found, 1], ids[found, 2].astype(np.int32), most[found].astype(np.int32), least[found].astype(np.int32)]


FAMILY = INTERVAL + ", gram long, salt int, windows binary"
#: Salts for each block of a gram, so that a salt's share of a gram's windows is less than what a block holds.
SALTS = 2


def _packed(ids: np.ndarray, keys: np.ndarray, owners: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> bytes:
    """Contexts (n x 3 ids) and windows: key, place of the context, offset, and whether it is known to occur again."""
    head = np.asarray([len(ids), len(keys)], "<u4")
    return b"".join(x.tobytes() for x in (head, ids.astype("<i8"), keys.astype("<u8"), owners.astype("<u4"), offsets.astype("u1"), known.astype("u1")))


def _unpacked(data: bytes) -> list[np.ndarray]:
    n, m = np.frombuffer(data, "<u4", 2)
    out, at = [], 8
    for kind, count in (("<i8", 3 * n), ("<u8", m), ("<u4", m), ("u1", m), ("u1", m)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return [out[0].reshape(-1, 3), *out[1:4], out[4].astype(bool)]


def _by_family(rows: DataFrame) -> DataFrame:
    """Rows of two kinds: intervals of contexts that share a window with another of their block; and, of grams with
    several blocks, a block's distinct windows by salt (windows not null, to be merged over blocks)."""

    def nothing(n: int, kinds: list) -> list[pa.Array]:
        return [pa.nulls(n, k) for k in kinds]

    whole = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    packed = [pa.int64(), pa.int32(), pa.binary()]
    names = ["rid", "rid2", "pos", "most", "least", "gram", "salt", "windows"]

    def one(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A family over whole blocks, rows sorted by gram, block and place."""
        family, shared = IndexFamily(), []
        gram, block, blocks, rid, rid2, pos, left = (part.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        ids = np.stack([rid, rid2, pos.astype(np.int64)], axis=1)
        for at in range(0, len(gram), FAMILY_BATCH):
            cut = slice(at, at + FAMILY_BATCH)
            keys, exists = windows(part.column(7)[cut].to_pylist(), left[cut].astype(np.int64), gram[cut].view(U))
            family.add(keys, exists)
            hot = np.flatnonzero(blocks[cut] > 1)
            if len(hot):
                row, offset = np.nonzero(exists[hot])
                shared.append((keys[hot[row], offset], hot[row] + at, offset))
        hits = family.hits().reshape(-1, SPAN)
        found = _intervals(ids, *np.nonzero(hits))
        yield pa.RecordBatch.from_arrays([*map(pa.array, found), *nothing(len(found[0]), packed)], names=names)
        if shared:
            keys, row, offset = (np.concatenate([x[i] for x in shared]) for i in range(3))
            _, first = np.unique(keys, return_index=True)
            keys, row, offset = keys[first], row[first], offset[first]
            salt = (keys % (blocks[row].astype(U) * U(SALTS))).astype(np.int32)
            order = np.lexsort((salt, gram[row]))
            keys, row, offset, salt = keys[order], row[order], offset[order], salt[order]
            known, of = hits[row, offset], gram[row]
            edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (salt[1:] != salt[:-1])]))
            data = []
            for a, b in zip(edge, [*edge[1:], len(of)]):
                mine, owners = np.unique(row[a:b], return_inverse=True)
                data.append(_packed(ids[mine], keys[a:b], owners, offset[a:b], known[a:b]))
            yield pa.RecordBatch.from_arrays(
                [*nothing(len(edge), whole), pa.array(of[edge]), pa.array(salt[edge]), pa.array(data, pa.binary())], names=names
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FAMILY_ROWS:
                table = _distinct(held)
                edges = _edges(table, ["gram", "block"])
                if len(edges) > 1:
                    yield from one(table.slice(0, edges[-1]))
                    table = table.slice(edges[-1])
                held, size = [table], table.num_rows
        if size:
            yield from one(_distinct(held))

    return rows.repartition("gram", "block").sortWithinPartitions("gram", "block", *ID, "pos").mapInArrow(run, FAMILY)


def _edges(table: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Rows at which a new group of sorted rows begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in by:
        values = table.column(table.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _distinct(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The sorted batches as one, without repeated rows."""
    table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    return table.take(pa.array(_edges(table, ["gram", *ID, "pos"])))


def _over_blocks(shared: DataFrame) -> DataFrame:
    """Intervals of contexts that share a window with one of another block: the blocks' arrays of a gram and salt are merged."""

    def merged(group: list[bytes]) -> Iterator[pa.RecordBatch]:
        family, parts, base = IndexFamily(), [_unpacked(data) for data in group], 0
        for _, keys, *_ in parts:
            family.add(keys)
        ids = np.concatenate([p[0] for p in parts])
        owners = np.concatenate([p[2].astype(np.int64) + (base := base + k) for p, k in zip(parts, [0, *(len(p[0]) for p in parts[:-1])])])
        offsets, known = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
        # what is known inside its block is covered there already
        new = np.flatnonzero(family.hits() & ~known)
        found = _intervals(ids, owners[new], offsets[new].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["rid", "rid2", "pos", "most", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[bytes] = []
        last = None
        for batch in batches:
            for gram, salt, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (gram, salt) != last and group:
                    yield from merged(group)
                    group = []
                last = gram, salt
                group.append(data)
        if group:
            yield from merged(group)

    rows = shared.select("gram", "salt", "windows").repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    return rows.mapInArrow(run, INTERVAL).groupBy(*ID, "pos").agg(F.max("most").alias("most"), F.min("least").alias("least"))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """rid, rid2, intervals (array of pos, most, least): the bytes from pos - most to pos - least + LENGTH are repeated."""
    table = work_table(_anchor_table(docs), "anchors")
    counts = table.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("z"))
    shared = counts.where("n > 1").select("gram", (F.col("a") != F.col("z")).alias("mixed"))
    # a table, so that Spark can split the rows of a hot gram over many tasks
    shared = work_table(shared, "shared-grams")
    release(docs.sparkSession)
    meeting = work_table(table.join(shared, "gram"), "meeting")
    drop_table(shared)
    drop_table(table)
    release(docs.sparkSession)
    whole = F.lit(SPAN - 1).alias("most"), F.lit(0).alias("least")
    mixed = meeting.where("mixed")
    classes = mixed.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct(*ID, "pos")).alias("at"))
    classes = work_table(classes, "contexts")
    twice = mixed.join(classes.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    alike = meeting.where("not mixed").select(*ID, "pos").unionByName(twice.select(*ID, "pos"))
    # by text at once: what follows needs no more of the anchors
    alike = work_table(alike.groupBy(*ID).agg(F.collect_set(F.struct("pos", *whole)).alias("intervals")), "covered")
    open_grams = classes.groupBy("gram").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1")
    open_grams = work_table(open_grams.select("gram", F.ceil(F.col("kinds") / BLOCK).cast("int").alias("blocks")), "open-grams")
    wanted = work_table(classes.join(open_grams, "gram").select("gram", "at.*", "blocks"), "open")
    for done in (meeting, classes, open_grams):
        drop_table(done)
    release(docs.sparkSession)
    one, two = text_words(F.col("text"))
    texts = docs.select(one.alias("rid"), two.alias("rid2"), "text").where(F.octet_length("text") >= LENGTH)
    rows = work_table(_context_rows(texts, wanted), "context-bytes")
    drop_table(wanted)
    release(docs.sparkSession)
    found = work_table(_by_family(rows), "families")
    drop_table(rows)
    release(docs.sparkSession)
    inside = found.where("windows is null").select(*ID, "pos", "most", "least")
    across = _over_blocks(found.where("windows is not null"))
    parts = inside.unionByName(across).groupBy(*ID).agg(F.collect_set(F.struct("pos", "most", "least")).alias("intervals"))
    both = work_table(alike.unionByName(parts).groupBy(*ID).agg(F.flatten(F.collect_list("intervals")).alias("intervals")), "intervals")
    for done in (alike, found):
        drop_table(done)
    release(docs.sparkSession)
    return both


def removed_runs(size: int, pos: np.ndarray, most: np.ndarray, least: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    begin, end = np.maximum(pos - most, 0), np.minimum(pos - least + LENGTH, size)
    order = np.argsort(begin, kind="stable")
    runs: list[tuple[int, int]] = []
    for b, e in zip(begin[order].tolist(), end[order].tolist()):
        if runs and b <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        else:
            runs.append((b, e))
    return runs


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for b, e in runs:
        parts.append(text[at:b])
        at = e
    return b"".join([*parts, text[at:]])


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without bytes of characters that they cut."""
    out = []
    for b, e in runs:
        while b < e and text[b] & 0xC0 == 0x80:
            b += 1
        while e < len(text) and e > b and text[e] & 0xC0 == 0x80:
            e -= 1
        if b < e:
            out.append((b, e))
    return out


def _with_runs(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs, text first, with the arrays pos, most, least of the text's intervals."""
    found = repeated_intervals(docs).select(F.col("rid").alias("__one"), F.col("rid2").alias("__two"), F.col("intervals").alias("__intervals"))
    one, two = text_words(F.col("text"))
    rows = docs.withColumns({"__rid": one, "__rid2": two})
    joined = rows.join(found, (F.col("__rid") == F.col("__one")) & (F.col("__rid2") == F.col("__two")), "left")
    parts = [F.col(f"__intervals.{c}").alias(f"__{c}") for c in ("pos", "most", "least")]
    return joined.select("text", *parts, *columns)


def _runs_of(text: bytes, arrays: list) -> list[tuple[int, int]]:
    if arrays[0] is None:
        return []
    return removed_runs(len(text), *(np.asarray(a, np.int64) for a in arrays))


def removal_digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = docs.select(key).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, *arrays in zip(batch.column(0).cast(pa.binary()), *(batch.column(i) for i in (1, 2, 3))):
                text = text.as_py() or b""
                runs = _runs_of(text, [a.as_py() for a in arrays])
                kept = kept_bytes(text, runs)
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(4), *columns], names=schema.names)

    return _with_runs(docs, [key]).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs' columns, texts without their repeated strings (whole characters only), rows without a word left dropped."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    schema = T.StructType([docs.schema["text"], *[docs.schema[c] for c in others]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for text, *arrays in zip(batch.column(0).cast(pa.binary()), *(batch.column(i) for i in (1, 2, 3))):
                text = text.as_py() or b""
                runs = whole_characters(text, _runs_of(text, [a.as_py() for a in arrays]))
                out.append(kept_bytes(text, runs).decode())
            rows = pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[4:]], names=schema.names)
            yield rows.filter(pa.array([bool(t.split()) for t in out], pa.bool_()))

    return _with_runs(docs, others).mapInArrow(run, schema).select(*columns)
