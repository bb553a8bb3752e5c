"""Boundary-aware, overlapping spans of a text as one expression."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from evidence_spark.functions.text import WHITESPACE_CHARS, Text, col

SENTENCE_ENDS = ".?!"
SPAN = "struct<first:int,last:int>"
PIECE = "struct<ordinal:int,text:string>"
_SPACES = frozenset(WHITESPACE_CHARS)

# The function below travels to the workers itself; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def check_sizes(chunk_size: int, overlap: int) -> None:
    if chunk_size <= 0:
        raise ValueError(f"chunk_size must be positive, got {chunk_size}")
    if not 0 <= overlap < chunk_size:
        raise ValueError(f"overlap must be in 0..{chunk_size - 1}, got {overlap}")


def boundary_end(text: str, first: int, limit: int, search: int) -> int:
    """Where a span that may run to ``limit`` should end.

    The last ``search`` characters are looked through backwards: a line end is
    best, then the end of a sentence, then white space; otherwise cut at ``limit``.
    """
    low = max(first + 1, limit - search)
    for kind in ("\n", SENTENCE_ENDS):
        last = max(text.rfind(c, low, limit) for c in kind)
        if last >= 0:
            return last + 1
    return next((i + 1 for i in range(limit - 1, low - 1, -1) if text[i] in _SPACES), limit)


def _cut(text: str, chunk_size: int, overlap: int) -> Iterator[tuple[int, int]]:
    search, size, at = max(1, chunk_size // 4), len(text), 0
    while True:
        limit = min(at + chunk_size, size)
        end = size if limit == size else boundary_end(text, at, limit, search)
        yield at, end
        if end == size:
            return
        at = end - overlap if end - overlap > at else end


def spans(text: Text, chunk_size: int, overlap: int) -> Column:
    """``array<struct<first,last>>`` of half-open, zero-based spans covering the text."""
    check_sizes(chunk_size, overlap)

    @F.arrow_udf(f"array<{SPAN}>")
    def cut(texts: pa.Array) -> pa.Array:
        found = [None if t is None else [{"first": a, "last": b} for a, b in _cut(t, chunk_size, overlap)] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    return cut(col(text))


def chunk_texts(text: Text, chunk_size: int, overlap: int) -> Column:
    """``array<struct<ordinal,text>>``: numbered from 1 before empty pieces are dropped.

    Pieces are cut where the spans are found: Spark's ``substring`` walks over a text from its start for every piece.
    """
    check_sizes(chunk_size, overlap)

    @F.arrow_udf(f"array<{PIECE}>")
    def cut(texts: pa.Array) -> pa.Array:
        ordinals, pieces, ends = [], [], [0]
        for one in texts.to_pylist():
            if one is not None:
                for ordinal, (a, b) in enumerate(_cut(one, chunk_size, overlap), 1):
                    piece = one[a:b].strip(WHITESPACE_CHARS)
                    if piece:
                        ordinals.append(ordinal)
                        pieces.append(piece)
            ends.append(len(pieces))
        found = pa.StructArray.from_arrays([pa.array(ordinals, pa.int32()), pa.array(pieces, pa.string())], ["ordinal", "text"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=texts.is_null())

    return cut(col(text))
