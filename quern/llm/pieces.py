"""Splitting oversized items at natural boundaries.

A token is a maximal run of letters and digits, or any other single character that isn't white space.  The first
characters of all tokens of a batch give its prefix sums of token counts; an item over its limit is cut from left to
right: the last natural boundary (end of a line or sentence, in one sorted array) within the limit is found by binary
search, and the next piece starts ``overlap`` tokens before it.  Where no such boundary lies beyond the overlap, the ends
of clauses are searched, then white space; a piece without any is cut hard at the limit.

Pieces hold the text from their first token up to the token after their last, so that without the overlaps they make up
the item again; the first one starts with the item's first character.  Null and empty items have no pieces and items
within the limit are their own only piece.  Of rows with an equal key each is split; callers keep distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import code_points, token_starts

#: Where a piece may end: after the line breaks, or the closing mark with what closes behind it and a blank.
_BOUNDARY = regex.compile(r"[^\S\r\n]*(?:\r\n|[\n\r\v\f\x85\u2028\u2029])\s*|[.!?…。！？;][\"'»”’)\]]*\s+")


#: Where it may end if there is no such place: after a clause, else at white space.
_CLAUSE, _BLANK = regex.compile(r"[,:;–—|]\s+"), regex.compile(r"\s+")


def cuts(starts: np.ndarray, boundaries: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    """First token and the token after the last one, of each piece.

    ``starts``: first character of each token; ``boundaries``: sorted characters at which a new piece could start, the
    better ones first."""
    n = len(starts)
    if n == 0:
        return []
    # the tokens that boundaries come before
    levels = [np.unique(np.searchsorted(starts, x)) for x in boundaries if len(x)]
    out, first = [], 0
    while True:
        if n - first <= limit:
            out.append((first, n))
            return out
        end = first + limit
        for at in levels:
            k = np.searchsorted(at, first + limit, side="right") - 1
            if k >= 0 and at[k] > first + overlap:
                end = int(at[k])
                break
        out.append((first, end))
        first = end - overlap


def split_text(text: str, starts: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """First character, character after the last, first token and number of tokens of each piece."""
    boundaries = [np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64) for pattern in (_BOUNDARY, _CLAUSE, _BLANK)] if len(starts) > limit else []
    out = []
    for first, end in cuts(starts, boundaries, limit, overlap):
        begin = 0 if first == 0 else int(starts[first])
        stop = len(text) if end == len(starts) else int(starts[end])
        out.append((begin, stop, first, end - first))
    return out


def split(df: DataFrame, key: str, text: str, limit: int, overlap: int = 50, oversized: bool = False, texts: bool = True) -> DataFrame:
    """key, piece (from 0), pieces, first_char, end_char, first_token, n_tokens and, with ``texts``, text of each piece.

    ``oversized``: only of the items over the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "piece", "pieces", "first_char", "end_char", "first_token", "n_tokens", "text"][: 7 + texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                values = part.column(1).to_pylist()
                cps, at = code_points(values)
                places = np.flatnonzero(token_starts(cps))
                bounds = np.searchsorted(places, at)
                rows, cells = [], []
                for row in np.flatnonzero(np.diff(bounds) > (limit if oversized else 0)):
                    own = places[bounds[row] : bounds[row + 1]] - at[row]
                    found = split_text(values[row], own, limit, overlap)
                    for piece, (begin, stop, first, n) in enumerate(found):
                        rows.append(row)
                        cells.append((piece, len(found), begin, stop, first, n, *([values[row][begin:stop]] if texts else [])))
                columns = list(zip(*cells)) if cells else [[]] * (len(names) - 1)
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int32() if i < 6 else pa.string()) for i, c in enumerate(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"key {kind}, piece int, pieces int, first_char int, end_char int, first_token int, n_tokens int" + ", text string" * texts
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
