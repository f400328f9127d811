"""Encoding whole corpora with a public byte-level BPE tokenizer, and decoding again.

The pre-tokeniser of a byte-level BPE never lets a token cross the border before a space that follows a character which
isn't white space.  So each Arrow batch is cut at those borders, the distinct pieces are encoded once with the
``tokenizers`` library, and the ids are gathered back with numpy.  Results equal encoding every text on its own.

Null and empty texts have no ids; blank texts are encoded as they are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 8 << 20
#: Distinct pieces that a worker keeps with their ids; beyond it the table starts anew.
KEPT_PIECES = 400_000


def tokenizer_path(path: str | None = None) -> str:
    """``path``, a name in the folder of public tokenizers, or the default tokenizer there."""
    name = path or TOKENIZER
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes Arrow string arrays; one per worker and tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """The index of each piece in ``flat`` / ``starts``."""
        if len(self.index) > KEPT_PIECES:
            self._forget()
        new = [p for p in pieces if p not in self.index]
        if new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            for k, p in enumerate(new, len(self.index)):
                self.index[p] = k
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return np.fromiter((self.index[p] for p in pieces), dtype=np.int64, count=len(pieces))

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The known index of each piece, and for each text the number of its first piece (with the total at the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data = texts.buffers()[2]
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if data is None or offsets[0] == offsets[-1]:
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        b = np.frombuffer(data, dtype=np.uint8)[lo:hi]
        p, q = b[1:-1], b[:-2]  # the byte before, and the one before that
        blank = (p <= 0x20) | (p == 0x7F) | ((p >= 0x80) & (((q == 0xC2) & ((p == 0x85) | (p == 0xA0))) | (q == 0x80) | (q == 0x81) | (q == 0x9A)))
        cuts = np.flatnonzero((b[2:] == 0x20) & ~blank) + 2 + lo if len(b) > 2 else np.zeros(0, dtype=np.int64)
        border = np.zeros(hi - lo + 1, dtype=bool)
        border[cuts - lo] = True
        border[offsets - lo] = True
        edges = np.flatnonzero(border) + lo
        array = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), data)
        coded = array.dictionary_encode()
        known = self._learn(coded.dictionary.to_pylist())
        return known[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(edges, offsets)

    def _slices(self, texts: pa.Array) -> Iterator[pa.Array]:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        done = 0
        while done < len(texts):
            base = sizes[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
            yield texts.slice(done, upto - done)
            done = upto

    def encode(self, texts: pa.Array) -> pa.ListArray:
        parts = []
        for part in self._slices(texts):
            piece, first = self._pieces(part)
            sizes = self.starts[piece + 1] - self.starts[piece]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            values = self.flat[np.repeat(self.starts[piece] - ends[:-1], sizes) + np.arange(ends[-1])]
            parts.append(pa.ListArray.from_arrays(pa.array(ends[first], pa.int32()), pa.array(values, pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def count(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0, dtype=np.int64)]
        for part in self._slices(texts):
            piece, first = self._pieces(part)
            ends = np.concatenate([[0], np.cumsum(self.starts[piece + 1] - self.starts[piece])])
            out.append(np.diff(ends[first]))
        return np.concatenate(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed: printable bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each id's bytes start."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
    table = byte_of_char()
    by_id = {i: bytes(table[c] for c in t) if i not in special else special[i] for t, i in data["model"]["vocab"].items()} | special
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def decode_batch(ids: pa.ListArray, path: str) -> pa.Array:
    """The texts of lists of ids.  A character may be split over tokens; bytes are joined before they are read as UTF-8.
    Bytes that form no character come out as U+FFFD."""
    flat, starts = token_bytes(path)
    values, offsets = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy(zero_copy_only=False)
    values, offsets = values.astype(np.int64), offsets - offsets[0]
    sizes = starts[values + 1] - starts[values]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = flat[np.repeat(starts[values] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
    at = ends[offsets]
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())


def char_starts(ids: np.ndarray, path: str) -> np.ndarray:
    """The character at which each token starts; one that starts inside a character has that character's place."""
    flat, starts = token_bytes(path)
    sizes = starts[ids + 1] - starts[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = flat[np.repeat(starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inside = np.zeros(len(ids), dtype=np.int64)
    if len(data):
        inside = (data[np.minimum(ends[:-1], len(data) - 1)] & 0xC0 == 0x80).astype(np.int64)
    return (lead[ends[:-1]] - inside).astype(np.int32)


def encode(df: DataFrame, key: str, text: str, tokenizer: str | None = None, offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` of each row; with ``offsets`` also ``starts``, the first character of each token."""
    path = tokenizer_path(tokenizer)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                ids = enc.encode(part.column(1))
                columns = [part.column(0), ids]
                if offsets:
                    begin = [char_starts(np.asarray(x.values.to_numpy(zero_copy_only=False) if x.values is not None else [], dtype=np.int64), path) for x in ids]
                    columns.append(pa.array(begin, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "starts"][: len(columns)])

    schema = f"key {kind}, ids array<int>" + ", starts array<int>" * offsets
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, tokenizer: str | None = None) -> DataFrame:
    """``key`` and ``text`` of each row of ids; null ids decode to null."""
    path = tokenizer_path(tokenizer)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            text = decode_batch(pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_valid(column), text, pa.scalar(None, pa.string()))], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """key, n_ids, same: whether decoding a text's ids gives the text again; null and empty texts have no ids and do."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids = enc.encode(part.column(1))
                given = pc.fill_null(part.column(1), "")
                yield pa.RecordBatch.from_arrays([part.column(0), pc.list_value_length(ids), pc.equal(decode_batch(ids, path), given)], names=["key", "n_ids", "same"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_ids int, same boolean")
    return out.withColumnRenamed("key", key)
