"""SentencePiece encoding and decoding over a trie of marked words with shared forward states.

A text is marked (a space before it, spaces as U+2581) and cut into units: runs
of marks with the characters up to the next mark, and the characters that no
longer piece holds. No piece crosses these cuts, so a text's ids are those of
its units. The distinct units of a batch are sorted, which is the depth-first
order of their trie; forward states stand on a stack along the current path, and
a unit computes states only for the characters after its common prefix with the
unit before it.

The forward state of a prefix is, for a vocabulary of merges as the installed
one, the last piece of the prefix's encoding: merges inside two neighbouring
parts go on independently until one crosses their border, so the encoding of a
prefix is that of a shorter prefix plus one piece, and the piece that fits is
the one whose pair with the shorter prefix's last piece encodes to just that
pair. Scores of pieces rank merges here and are not log-probabilities, so the
largest sum of scores, which a unigram model asks for, would give other ids
than the library; the test of the pair takes the place of the maximum.

Defined cases: a null text counts as empty and has no ids; a literal U+2581
reads as a space, as in the library; characters without a piece become byte
pieces; repeated rows are all returned; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldsieve.llm.tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KEPT_UNITS, KEPT_CHARS = 400_000, 64
KEPT_PAIRS = 1_000_000


class PieceModel:
    """The vocabulary of a merge model with byte fallback, and its encoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_id = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                piece = piece.replace(MARK, " ")
                self.ids[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.bytes_of.append(piece.encode())
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        #: Line feeds split units wherever the vocabulary never joins them to anything.
        self.units = re.compile("\n| *[^ \n]+| +" if "\n" not in joined else " *[^ ]+| +").findall
        self.halves: dict[str, tuple[str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, bytes] = {}
        self._automaton()

    def _automaton(self) -> None:
        """The pieces' own trie with failure links: next state by character, and the pieces that end in a state."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, ...]] = [()]
        self.fail = [0]
        ending: dict[int, str] = {}
        for piece in self.ids:
            if len(piece) > 1 and self.merge(piece, 1) != [piece]:
                continue  # the merges never make it
            state = 0
            for c in piece:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                    self.fail.append(0)
                state = self.next[state][c]
            ending[state] = piece
        queue = list(self.next[0].values())
        for state in queue:  # grows as it is read: breadth first
            shorter = self.ends[self.fail[state]]
            self.ends[state] = (ending[state], *shorter) if state in ending else shorter
            for c, after in self.next[state].items():
                self.fail[after] = self._step(self.fail[state], c)
                queue.append(after)

    def _step(self, state: int, c: str) -> int:
        while state and c not in self.next[state]:
            state = self.fail[state]
        return self.next[state].get(c, 0)

    def merge(self, text: str, least: int) -> list[str]:
        """The merges themselves, on a short text, down to least parts: lowest rank first, leftmost on ties."""
        parts, rank = list(text), self.rank
        while len(parts) > least:
            best, at = min((rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _half(self, piece: str) -> tuple[str, str]:
        """The two parts that a piece's last merge joins."""
        found = self.halves.get(piece)
        if found is None:
            found = self.halves[piece] = tuple(self.merge(piece, 2))
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right, one after the other, stay apart.

        Merges are undone from the last one backwards; at each stage the parts
        at the border must have no merge of their own that came before the one
        undone. Pieces of marks only share one rank, so there the merges are
        carried out.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        if "  " in left or "  " in right:
            known = self.merge(left + right, 1) == [left, right]
        else:
            a, b, limit = left, right, float("inf")
            while True:
                if self.rank.get(a + b, float("inf")) < limit:
                    known = False
                    break
                made_a = self.rank[a] if len(a) > 1 else -1.0
                made_b = self.rank[b] if len(b) > 1 else -1.0
                if made_a > made_b:
                    limit, a = made_a, self._half(a)[1]
                elif made_b < 0:
                    known = True
                    break
                else:  # of two equal merges the left one comes first
                    limit, b = made_b + 0.5, self._half(b)[0]
        self.pairs[left, right] = known
        return known

    def encode_sorted(self, units: list[str]) -> Iterator[list[str]]:
        """Pieces of each of the sorted units, states shared along common prefixes."""
        last, states = [""], [0]  # of each prefix: its encoding's last piece, its place in the automaton
        path = ""
        follow, ends, pairs = self.next, self.ends, self.pairs
        for unit in units:
            shared, most = 0, min(len(path), len(unit))
            while shared < most and path[shared] == unit[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, len(unit) + 1):
                c = unit[end - 1]
                state = follow[state].get(c) or self._step(state, c)
                states.append(state)
                for piece in ends[state]:
                    start = end - len(piece)
                    if not start:
                        break
                    before = last[start]
                    known = pairs.get((before, piece))
                    if known or known is None and self.fits(before, piece):
                        break
                else:
                    piece = c  # not in the vocabulary
                last.append(piece)
            path = unit
            pieces, end = [], len(unit)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            pieces.reverse()
            yield pieces

    def ids_of(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for piece in pieces:
            found = self.ids.get(piece)
            if found is None:
                ids += [self.byte_id[b] for b in piece.encode()]
            else:
                ids.append(found)
        return np.asarray(ids, dtype="<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        split = [self.units(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        kept = self.kept
        new = sorted({u for units in split for u in units if u not in kept})
        for unit, pieces in zip(new, self.encode_sorted(new)):
            kept[unit] = self.ids_of(pieces)
        out = [b"".join([kept[u] for u in units]) for units in split]
        for unit in new:
            if len(unit) > KEPT_CHARS:
                del kept[unit]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space put before the text goes."""
        table = self.bytes_of
        found = b"".join([table[i] for i in ids])
        return (found[1:] if found[:1] == b" " else found).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per worker process, which serves many tasks."""
    return PieceModel(path)


def _batches(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about most characters, with the place of the first."""
    first, run, held = 0, [], 0
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        run.append(text)
        held += len(text)
        if held >= most:
            yield first, run
            first, run, held = i + 1, [], 0
    if run:
        yield first, run


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids, array<int>; a column of that name is replaced."""
    docs = docs.drop(ids)
    path = path or vocabulary_path(MODEL)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for first, texts in _batches(batch.column(place)):
                found = model.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, ids]
                )

    return docs.mapInArrow(encode, schema)


def decode_documents(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the column text, decoded from ids; null ids give an empty text; a column of that name is replaced."""
    rows = rows.drop(text)
    path = path or vocabulary_path(MODEL)
    place = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            found = pa.array([model.decode(x.as_py() or []) for x in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, text])

    return rows.mapInArrow(decode, schema)


def encoding_digests(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """Encode and decode every text: key, n_bytes, n_tokens, ids_crc32, decoded_crc32, lossless.

    ids_crc32 is over the ids as little-endian 32-bit numbers; lossless says
    whether decoding gives the text with U+2581 as spaces.
    """
    path = path or vocabulary_path(MODEL)
    schema = docs.select(key).schema
    for name, kind in (("n_bytes", "long"), ("n_tokens", "long"), ("ids_crc32", "long"), ("decoded_crc32", "long"), ("lossless", "boolean")):
        schema = schema.add(name, kind)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for first, texts in _batches(batch.column(1)):
                found = model.encode(texts)
                decoded = [model.decode(np.frombuffer(f, dtype="<i4").tolist()) for f in found]
                columns = [
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(f) // 4 for f in found], pa.int64()),
                    pa.array([zlib.crc32(f) for f in found], pa.int64()),
                    pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()),
                    pa.array([d == t.replace(MARK, " ") for d, t in zip(decoded, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns], names=schema.names)

    return docs.select(key, "text").mapInArrow(digest, schema)
