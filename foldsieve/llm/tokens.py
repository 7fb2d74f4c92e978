"""Token counts and token-id files for vocabularies read by the tokenizers library.

Both put a text's ids together from those of its words. A text of characters on
which Python and the library agree beyond doubt (PLAIN) and without special
strings is lower-cased and cut by the pattern in the vocabulary file; every
distinct word is encoded by the library once per worker process, many words in
one string, and kept in a table of bounded size. Other texts go to the library
as they are. Long texts are cut at white space first, a boundary that yields no
token, so no call sees more than about BATCH_BYTES, and the texts put together
at once are balanced by bytes, not by rows.

Defined cases: a null text counts as empty and has no tokens; repeated rows are
all returned; null keys are kept (and come first in file order); an empty table
gives an empty result; other columns are not looked at. White space at either
end or doubled makes no token, and special strings inside a text are handled
as the library does by default, since none holds white space.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsieve.session import work_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
END_ID = 2
#: Bytes of text handed to the library at once, and of texts put together at once.
BATCH_BYTES = 1 << 20
#: Distinct words kept per worker process, and the longest word kept.
KEPT_WORDS, KEPT_CHARS = 1_000_000, 48
#: Characters up to U+024F whose lower case lies beyond it.
BEYOND = "".join(c for c in map(chr, range(0xA1, 0x250)) if max(c.lower()) > "\u024f")
#: Printable ASCII, line breaks, and Latin letters but those BEYOND: in normal form, and lower-cased one by one alike everywhere.
PLAIN = r"\t\n\r\x20-\x7e" + "".join(c for c in map(chr, range(0xA1, 0x250)) if c not in BEYOND)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_pattern(pattern: str) -> str:
    """The pattern with classes of letters and numbers spelled out for the characters of PLAIN."""
    for kind in "LN":
        members = "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)
        pattern = pattern.replace(rf"\p{{{kind}}}", members)
    return pattern


class TextEncoder:
    """Ids of texts as little-endian 32-bit bytes, or only their count."""

    def __init__(self, path: str, lengths_only: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths_only = lengths_only
        self.kept: dict[str, int | bytes] = {}
        self.other = re.compile(f"[^{PLAIN}]").search
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.words = None
        steps = [s.get("type") for s in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and splits and splits[0].get("invert") and rules["model"].get("end_of_word_suffix"):
            self.words = re.compile(plain_pattern(splits[0]["pattern"]["Regex"])).findall
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(rules["model"]["end_of_word_suffix"])]] = True

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Keep the results of new words; in one string, each ends with a piece that ends a word."""
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size < BATCH_BYTES // 16):
                size += len(new[end]) + 1
                end += 1
            run = new[at:end]
            at = end
            ids = self._library([" ".join(run)])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(run):
                found = self._library(run)
                self.kept.update(zip(run, [len(f) for f in found] if self.lengths_only else [f.tobytes() for f in found]))
            elif self.lengths_only:
                self.kept.update(zip(run, np.diff(ends, prepend=0).tolist()))
            else:
                data, cuts = ids.tobytes(), (ends * 4).tolist()
                self.kept.update(zip(run, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))

    def __call__(self, texts: list[str]) -> list[int] | list[bytes]:
        """The result of each text, in order. The texts together are of bounded size but for single long ones."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        kept, split = self.kept, []
        for text in texts:
            parts = []
            for part in segments(text):
                simple = self.words and not self.other(part) and not any(x in part for x in self.special)
                parts.append(self.words(part.lower()) if simple else part)
            split.append(parts)
        new = set().union(*[p for parts in split for p in parts if isinstance(p, list)]).difference(kept)
        self._learn(list(new))
        out: list = []
        for parts in split:
            if self.lengths_only:
                out.append(sum(sum(map(kept.__getitem__, p)) if isinstance(p, list) else len(self._library([p])[0]) for p in parts))
            else:
                out.append(b"".join([b"".join(map(kept.__getitem__, p)) if isinstance(p, list) else self._library([p])[0].tobytes() for p in parts]))
        for word in new:
            if len(word) > KEPT_CHARS:
                del kept[word]
        return out


@functools.lru_cache(maxsize=4)
def text_encoder(path: str, lengths_only: bool) -> TextEncoder:
    """One per worker process, which serves many tasks."""
    return TextEncoder(path, lengths_only)


def segments(text: str, most: int = BATCH_BYTES) -> Iterator[str]:
    """A long text cut at white space into parts of about most characters; a part without white space stays whole."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut <= at:
            nexts = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
            if not nexts:
                break
            cut = min(nexts)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def balanced(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BATCH_BYTES, with the place of the first."""
    first, run, held = 0, [], 0
    for i, text in enumerate(texts):
        held += len(text.as_buffer()) if text.is_valid else 0
        run.append(text.as_py() or "")
        if held >= BATCH_BYTES:
            yield first, run
            first, run, held = i + 1, [], 0
    if run:
        yield first, run


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit."""
    path = path or vocabulary_path(VOCABULARY)
    schema = docs.select(key).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path, True)
        for batch in batches:
            for first, texts in balanced(batch.column(1)):
                totals = np.asarray(encode(texts), dtype=np.int64)
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                keys = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([keys, sizes, pa.array(totals), pa.array(totals > limit)], names=schema.names)

    return docs.select(key, "text").mapInArrow(count, schema)


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    key: str = "doc_id",
    end_id: int | None = END_ID,
    partitions: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Write key, part, seq, n_tokens, ids (list<int>) as Parquet in ascending key order over all files.

    Texts are range-partitioned by key before they are encoded, so each is
    encoded once and the shuffle's sampling sees no tokens. Ids repeat within a
    vocabulary of some ten thousand, so they are dictionary-encoded; where a
    dictionary outgrows its page the writer's second format falls back to delta
    packing, as it uses for the ascending key and seq. Row groups and pages are
    small and pages indexed: a reader takes single columns and key ranges.
    """
    path = path or vocabulary_path(VOCABULARY)
    schema = (
        docs.select(key).schema.add("part", "integer").add("seq", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = text_encoder(path, False)
        end = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in balanced(batch.column(1)):
                rows = [x + end for x in ids_of(texts)]
                lengths = np.asarray([len(r) // 4 for r in rows], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"))
                columns = [
                    batch.column(0).slice(first, len(rows)),
                    pa.array(np.full(len(rows), part, np.int32)),
                    pa.array(np.arange(seq, seq + len(rows), dtype=np.int64)),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                seq += len(rows)

    rows = docs.select(key, "text")
    ranged = rows.repartitionByRange(partitions, key) if partitions else rows.repartitionByRange(key)
    # equal keys: shorter text first, so that reruns write the same order
    ordered = ranged.sortWithinPartitions(F.col(key).asc_nulls_first(), F.octet_length("text"), F.crc32(F.col("text").cast("binary")))
    (
        ordered.mapInArrow(encode, schema)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(folder)
    )


def read_token_files(spark, folder: str, key: str = "doc_id") -> DataFrame:
    """The files' rows with start, the number of ids in all rows before: key, start, n_tokens, ids.

    Starts come from the narrow columns alone: sums per file part, running sums
    over the parts (one row each), running sums inside a part.
    """
    files = spark.read.parquet(folder)
    starts = token_starts(files.select("part", "seq", "n_tokens"))
    return files.join(starts.drop("n_tokens"), ["part", "seq"]).select(key, "start", "n_tokens", "ids")


def token_starts(narrow: DataFrame) -> DataFrame:
    """part, seq, n_tokens and start of each row of part, seq, n_tokens."""
    sums = narrow.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).cast("long").alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return (
        narrow.withColumn("local", local).join(bases, "part").select("part", "seq", "n_tokens", (F.col("base") + F.col("local")).cast("long").alias("start"))
    )


def token_file_digests(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """Write the token files, read them back: key, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = work_path(spark, "token-ids")
    write_token_files(docs, folder, path, key)
    files = spark.read.parquet(folder)
    schema = files.select(key, "part", "seq", "n_tokens").schema.add("ids_crc32", "long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
            ends = ids.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.asarray(crcs, dtype=np.int64))], names=[key, "part", "seq", "n_tokens", "ids_crc32"]
            )

    digests = files.select(key, "part", "seq", "n_tokens", "ids").mapInArrow(digest, schema)
    starts = token_starts(files.select("part", "seq", "n_tokens")).drop("n_tokens")
    return digests.join(starts, ["part", "seq"]).select(key, "start", "n_tokens", "ids_crc32")
