"""Media columns: signature sniffing, format validation, type correction and carving.

An Aho-Corasick automaton finds every magic number and end mark of every known
format in one pass over the bytes, wherever it stands. A validator per format
then follows the structure from there (chunks, blocks, tables, trailers) and
gives the exact length, or rejects the match. End marks are looked up, and
chains of blocks that were walked once are remembered, so bytes full of magic
numbers take no longer than others. What starts at byte 0 and is valid corrects
the declared type; valid media further in, unless inside another one that was
already carved, are embedded and can be cut out.

Stored media are a Parquet table in the shared folder, and what is computed of
them is read from there.

Defined cases: null or empty bytes have no type and no parts, and declare
nothing; a declared type without a valid format stays, marked as unconfirmed;
truncated media are not confirmed; repeated rows are all returned; an empty
table gives an empty result; other columns pass through, but for columns named
as the new ones, which these replace.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsieve.session import work_path

UNKNOWN = "application/octet-stream"
BLOCK = 64
RATE = 8000


class Marks:
    """End marks of some bytes, by place, and block chains walked so far."""

    def __init__(self, data: bytes, places: dict[bytes, list[int]]):
        self.places = places
        self.chains: dict[int, int] = {}
        #: End of an archive by the place of its first local header.
        self.archives: dict[int, int] = {}
        for p in places.get(ARCHIVE_END, ()):
            if p + 22 <= len(data):
                size, offset, note = struct.unpack_from("<IIH", data, p + 12)
                directory = not size or data[max(p - size, 0) : p - size + 4] == b"PK\x01\x02"
                if p - size - offset >= 0 and directory and p + 22 + note <= len(data):
                    self.archives.setdefault(p - size - offset, p + 22 + note)

    def after(self, mark: bytes, at: int) -> int:
        """The first place of the mark from at on, or -1."""
        found = self.places.get(mark, [])
        i = bisect.bisect_left(found, at)
        return found[i] if i < len(found) else -1


ARCHIVE_END, DOCUMENT_END, DOCUMENT_INDEX = b"PK\x05\x06", b"%%EOF", b"startxref"


def _png(d: bytes, at: int, marks: Marks) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(d):
        (size,) = struct.unpack_from(">I", d, p)
        kind, end = d[p + 4 : p + 8], p + 12 + size
        if end > len(d) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(d[p + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return None


def _gif(d: bytes, at: int, marks: Marks) -> int | None:
    """Logical screen, then blocks with sub-blocks up to the trailer."""
    if at + 13 > len(d):
        return None
    flags, p = d[at + 10], at + 13
    if flags & 0x80:
        p += 3 << (flags & 7) + 1

    def blocks(p: int) -> int | None:
        """Where the chain of sub-blocks from p on ends; len(d) + 1 stands for nowhere."""
        walked, end = [], None
        while end is None:
            end = marks.chains.get(p)
            if end is None:
                walked.append(p)
                end = len(d) + 1 if p >= len(d) else p + 1 if not d[p] else None
                p += 1 + d[p] if end is None else 0
        marks.chains.update(dict.fromkeys(walked, end))
        return end if end <= len(d) else None

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 <= len(d):
            local = 3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0
            p = blocks(p + 11 + local)
        else:
            return None
        if p is None:
            return None
    return None


def _jpeg(d: bytes, at: int, marks: Marks) -> int | None:
    """Marker segments, then scan data with stuffed bytes up to the end marker."""
    p, scanned = at + 2, False
    while p + 4 <= len(d) or p + 2 <= len(d):
        if d[p] != 0xFF:
            return None
        mark = d[p + 1]
        if mark == 0xD9:
            return p + 2 - at if scanned else None
        if mark == 0xFF:
            p += 1
            continue
        if p + 4 > len(d) or mark < 0xC0 or 0xD0 <= mark <= 0xD8:
            return None
        (size,) = struct.unpack_from(">H", d, p + 2)
        if size < 2:
            return None
        p += 2 + size
        if mark == 0xDA:
            scanned = True
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return None
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return None


def _bmp(d: bytes, at: int, marks: Marks) -> int | None:
    """File and information headers that agree about sizes."""
    if at + 34 > len(d):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    good = not reserved and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return size if good and 14 + header <= offset <= size <= len(d) - at else None


def _riff(form: bytes, needed: bytes) -> Callable[[bytes, int, Marks], int | None]:
    def check(d: bytes, at: int, marks: Marks) -> int | None:
        """Chunks that fill the form exactly and include the needed one."""
        if at + 12 > len(d) or d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
        p, found = at + 12, False
        while p + 8 <= end <= len(d):
            found |= d[p : p + 4].startswith(needed)
            size = struct.unpack_from("<I", d, p + 4)[0]
            p += 8 + size + (size & 1)
        return end - at if p == end and found else None

    return check


def _gzip(d: bytes, at: int, marks: Marks) -> int | None:
    """A member that inflates, with the right checksum."""
    inflate = zlib.decompressobj(31)
    p = at
    try:
        while p < len(d) and not inflate.eof:
            inflate.decompress(d[p : p + 65536], 1 << 20)
            while inflate.unconsumed_tail and not inflate.eof:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return None
    return min(p, len(d)) - len(inflate.unused_data) - at if inflate.eof else None


def _zip(d: bytes, at: int, marks: Marks) -> int | None:
    """The first end record whose central directory reaches back to this local header."""
    end = marks.archives.get(at)
    return end and end - at


def _pdf(d: bytes, at: int, marks: Marks) -> int | None:
    """A header, an xref pointer and the end mark."""
    end = marks.after(DOCUMENT_END, at)
    return end + len(DOCUMENT_END) - at if 0 <= marks.after(DOCUMENT_INDEX, at) < end else None


def _ogg(d: bytes, at: int, marks: Marks) -> int | None:
    """Pages, one after the other, from a first to a last one."""
    p = at
    while p + 27 <= len(d) and d[p : p + 5] == b"OggS\0":
        flags, count = d[p + 5], d[p + 26]
        if (p == at) != bool(flags & 2):
            return None
        end = p + 27 + count + sum(d[p + 27 : p + 27 + count])
        if end > len(d):
            return None
        if flags & 4:
            return end - at
        p = end
    return None


#: Magic numbers, media types, places of the magic in the file, validators.
FORMATS: list[tuple[bytes, str, int, Callable[[bytes, int, Marks], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0, _png),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"BM", "image/bmp", 0, _bmp),
    (b"WAVE", "audio/wav", 8, _riff(b"WAVE", b"data")),
    (b"WEBP", "image/webp", 8, _riff(b"WEBP", b"VP8")),
    (b"AVI ", "video/avi", 8, _riff(b"AVI ", b"LIST")),
    (b"\x1f\x8b\x08", "application/gzip", 0, _gzip),
    (b"PK\x03\x04", "application/zip", 0, _zip),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"OggS\0", "audio/ogg", 0, _ogg),
]


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind, place, valid in FORMATS:
        # one character per byte
        found.add_word(magic.decode("latin-1"), (magic, kind, place, valid))
    for mark in (ARCHIVE_END, DOCUMENT_END, DOCUMENT_INDEX):
        found.add_word(mark.decode("latin-1"), (mark, None, 0, None))
    found.make_automaton()
    return found


def carve(data: bytes | None) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each confirmed medium: the one at byte 0 and those embedded, outermost first."""
    data = data or b""
    starts, places = [], {}
    for last, (word, kind, place, valid) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - len(word) - place
        if kind is None:
            places.setdefault(word, []).append(at)
        elif at >= 0:
            starts.append((at, kind, valid))
    found: list[tuple[int, int, str]] = []
    marks, reach = Marks(data, places), 0
    for at, kind, valid in sorted(starts, key=lambda x: x[0]):
        # containers may hold embedded media; another medium inside a carved, embedded one is part of it
        length = valid(data, at, marks) if at >= reach else None
        if length:
            found.append((at, length, kind))
            reach = at + length if at else 0
    return found


PART = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())])


def verdict(data: bytes | None, declared: str | None) -> tuple[str | None, bool, bool, list[dict]]:
    """type (corrected), confirmed, corrected, and the embedded parts of some bytes."""
    parts = carve(data)
    head = next((k for o, _, k in parts if o == 0), None)
    kind = head or declared
    return kind, head is not None, kind != declared, [{"offset": o, "length": n, "type": k} for o, n, k in parts if o]


ADDED = ("type", "confirmed", "corrected", "parts")


def sniff(rows: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """rows with type (corrected), confirmed, corrected, and parts (offset, length, type) of embedded media."""
    others = [c for c in rows.columns if c not in ADDED]
    kept = rows.select(*others, F.col(media).alias("__media"), F.col(declared).alias("__declared"))
    kinds = (T.StringType(), T.BooleanType(), T.BooleanType(), T.ArrayType(PART))
    schema = T.StructType([*kept.schema.fields[:-2], *(T.StructField(n, k) for n, k in zip(ADDED, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [verdict(data.as_py(), said.as_py()) for data, said in zip(*batch.columns[-2:])]
            part = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
            columns = [pa.array([x[i] for x in out], f) for i, f in enumerate((pa.string(), pa.bool_(), pa.bool_(), part))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=schema.names)

    return kept.mapInArrow(run, schema)


def wave(samples: bytes) -> bytes:
    """Samples as a mono file of unsigned 8-bit PCM."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(data: bytes) -> bytes:
    """The samples of a valid wave file, found by its chunks."""
    p = 12
    while data[p : p + 4] != b"data":
        size = struct.unpack_from("<I", data, p + 4)[0]
        p += 8 + size + (size & 1)
    return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]


def store_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media, declared: each text as UTF-8, padded with bytes 0 to whole blocks, as 8-bit samples."""
    schema = docs.select(key).schema.add("n_bytes", "long").add("media", "binary").add("declared", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            media = [wave(t + b"\0" * (-len(t) % BLOCK if t else BLOCK)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(texts))],
                names=schema.names,
            )

    return docs.select(key, "text").mapInArrow(run, schema)


def media_digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts stored as a table of media, read back from it and sniffed: sizes, digests and a feature string.

    feature: type, whether the declared type was corrected, samples, their mean
    over 255, and the embedded media found.
    """
    schema = docs.select(key).schema
    for name, kind in (
        ("n_bytes", "long"),
        ("payload_bytes", "long"),
        ("payload_sha256", "string"),
        ("tail_crc32", "long"),
        ("media_bytes", "long"),
        ("media_sha256", "string"),
        ("feature", "string"),
    ):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out: list[tuple] = []
            for data, declared in zip(batch.column(2), batch.column(3)):
                data = data.as_py()
                kind, _, corrected, parts = verdict(data, declared.as_py())
                if kind != "audio/wav":
                    raise ValueError(f"stored media read back as {kind}")
                payload = samples_of(data)
                mean = np.frombuffer(payload, np.uint8).mean() / 255
                inside = ",".join(f"{p['type']}@{p['offset']}+{p['length']}" for p in parts) or "none"
                feature = f"{kind};corrected={str(corrected).lower()};samples={len(payload)};mean={mean:.6f};embedded={inside}"
                out.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[i] for x in out], f) for i, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    spark, folder = docs.sparkSession, work_path(docs.sparkSession, "media")
    store_texts(docs, key).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder).select(key, "n_bytes", "media", "declared").mapInArrow(run, schema)


def cut_parts(rows: DataFrame, media: str = "media", parts: str = "parts") -> DataFrame:
    """One row per embedded medium of sniffed rows: the row's columns without media and parts, offset, length, type of the part, bytes."""
    others = [F.col(c) for c in rows.columns if c not in (media, parts, "type")]
    one = rows.withColumn("part", F.explode(parts))
    body = F.substring(F.col(media), F.col("part.offset").cast("int") + 1, F.col("part.length").cast("int"))
    return one.select(*others, F.col("part.offset"), F.col("part.length"), F.col("part.type"), body.alias("bytes"))
