"""Expressions shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Records handed to Python at once; with texts of a few KB a batch stays at a few MB.
ARROW_ROWS = 2000


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_words(text: Column) -> tuple[Column, Column]:
    """The first 128 bits of the text's SHA-256 as two longs; null counts as empty. With 10^12 distinct texts the chance of any clash is 1e-15."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def digest_words(texts: list[bytes]) -> np.ndarray:
    """The same of many texts: an n x 2 array."""
    return np.frombuffer(b"".join(hashlib.sha256(t).digest()[:16] for t in texts), ">i8").astype(np.int64).reshape(-1, 2)


#: Rows of a table that is sent to every executor at most; with some 200 bytes a row, 13 MB.
BROADCAST_ROWS = 1 << 16


def bounded(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows were counted and are few; else Spark chooses, and splits hot keys."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
