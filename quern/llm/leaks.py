"""Held-out items inside training documents.

A document leaks an item if some ``n`` (13) consecutive words of the item stand in it, in order.

A sketch of a whole item can't vouch for that: a passage of 13 words has nine shingles of five words, so the containment
that must be found is 9 / (size - 4), which no sketch of bounded size tells from nothing for a long item.  So items are
cut into passages of n words, which are one size partition, and every window of n words of a document is a query to it:

1. The MinHash of a passage is the least hash of its five-word shingles.  Neighbouring windows mostly share it.  A document
   keeps the windows whose MinHash is one of the items'; an equal passage has an equal MinHash, so nothing is missed.
2. Of those, it keeps the windows whose own hash is that of a passage.
3. The words themselves are compared: windows and passages meet in a join on hash and words.

Steps 1 and 2 look into bit tables of ``BITS`` bits for each passage, so they filter equally well at any number of items.
Passages are told apart by ranges of their hash; a range has at most ``PASSAGES_MOST`` passages, whose two tables are
broadcast, and the documents are read once for each range.  Passages that stand in very many documents are spread over
several keys of the join.

Null and empty texts and items of fewer than n words have no passages and never match.  Words are compared whatever the
case, accents, punctuation, markup and line breaks.  Rows of one item_id count as one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

N, SHINGLE = 13, 5
#: Bits of each table for a passage, and how many of them answer for a hash: one in eighty foreign hashes passes a table.
BITS, PROBES = 10, 4
#: Passages of one range of hashes: two tables of 40 MB at most.
PASSAGES_MOST = 1 << 24
#: Slices of a table that are built apart; their number is a power of two.
SLICES = 64
#: Rows of one passage beyond which it is spread over several keys.
HOT = 100_000


def passages(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of n words: the row of its text, its place in it, its MinHash and the hash of its words."""
    hashes, starts = W.word_hashes(texts)
    if len(hashes) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    whole = W.shingle_hashes(hashes, n)
    small = W.shingle_hashes(hashes, SHINGLE)
    count = len(whole)
    # the least of k neighbours, doubling the reach: O(log k) passes
    reach, width = 1, n - SHINGLE + 1
    level = small
    while reach * 2 <= width:
        level = np.minimum(level[: len(level) - reach], level[reach:])
        reach *= 2
    least = np.minimum(level[:count], level[width - reach : width - reach + count])
    # a minimum is small: it is mixed again, so that its first bits tell nothing
    least = W.mix(least)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    inside = row[:count] == row[n - 1 :]
    row = row[:count][inside]
    return row, np.flatnonzero(inside) - starts[row], least[inside], whole[inside]


class Table:
    """A set of hashes as bits: ``PROBES`` of them for each hash, all within the slice that its first bits name."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        """``bits``: of a slice, a power of two."""
        self.bits = bits
        self.data = np.zeros(SLICES * bits // 8, dtype=np.uint8) if data is None else data

    @staticmethod
    def slice_of(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SLICES.bit_length() + 1)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The bits of a hash within its slice."""
        second = W.mix(hashes) | np.uint64(1)
        for k in range(PROBES):
            yield ((hashes + np.uint64(k) * second) & np.uint64(self.bits - 1)).astype(np.int64)

    def one_slice(self, hashes: np.ndarray) -> bytes:
        bits = np.zeros(self.bits, dtype=bool)
        for place in self.places(hashes):
            bits[place] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        base = self.slice_of(hashes) * self.bits
        found = np.ones(len(hashes), dtype=bool)
        for place in self.places(hashes):
            at = base + place
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def table(held_out: DataFrame, column: str, count: int) -> Table:
    """The bit table of a column of hashes.  Each slice is built by one task from the hashes of its range, so the driver
    gets every byte of the table once."""
    bits = 1 << max(6, (max(1, count) * BITS // SLICES).bit_length())

    def build(part: pa.Table) -> pa.Table:
        hashes = part.column("h").to_numpy().view(np.uint64)
        return pa.table({"slice": pa.array([int(Table.slice_of(hashes[:1])[0])], pa.int32()), "data": pa.array([Table(bits).one_slice(hashes)], pa.binary())})

    shift = 64 - SLICES.bit_length() + 1
    hashes = held_out.select(F.col(column).alias("h")).distinct().withColumn("slice", F.shiftrightunsigned("h", shift))
    out = Table(bits)
    for row in hashes.groupBy("slice").applyInArrow(build, "slice int, data binary").toLocalIterator():
        out.data[row.slice * bits // 8 : (row.slice + 1) * bits // 8] = np.frombuffer(bytes(row.data), dtype=np.uint8)
    return out


def item_passages(items: DataFrame, n: int = N) -> DataFrame:
    """item_id, minhash, passage and words of each window of n words, once for each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row, at, least, whole = passages(texts, n)
            said = [W.words(t) for t in texts]
            words = [" ".join(said[r][k : k + n]) for r, k in zip(row.tolist(), at.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(least.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(words, pa.string())], names=["item_id", "minhash", "passage", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, minhash long, passage long, words string").distinct()


def windows(documents: DataFrame, minhashes: Table, whole: Table, n: int = N) -> DataFrame:
    """doc_id, passage and words of the documents' windows that both tables know."""
    shared = documents.sparkSession.sparkContext.broadcast((minhashes, whole))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhashes, whole = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts = part.column(1).to_pylist()
                row, at, least, own = passages(texts, n)
                # neighbouring windows share their MinHash: each run is looked up once
                fresh = np.concatenate([[True], least[1:] != least[:-1]]) if len(least) else np.zeros(0, dtype=bool)
                keep = np.flatnonzero(minhashes.has(least[fresh])[np.cumsum(fresh) - 1]) if len(least) else np.zeros(0, dtype=np.int64)
                keep = keep[whole.has(own[keep])]
                row, at = row[keep], at[keep]
                said = {r: W.words(texts[r]) for r in np.unique(row).tolist()}
                words = [" ".join(said[r][a : a + n]) for r, a in zip(row.tolist(), at.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(own[keep].view(np.int64)), pa.array(words, pa.string())], names=["doc_id", "passage", "words"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, passage long, words string")


def leaks(documents: DataFrame, items: DataFrame, n: int = N, checkpoint=lambda df: df, most: int = PASSAGES_MOST, hot: int = HOT) -> DataFrame:
    """Distinct (doc_id, item_id).  ``documents``: doc_id, text; ``items``: item_id, text.

    ``checkpoint`` cuts the lineage of the items' passages and of the windows found, which are read several times."""
    held_out = checkpoint(item_passages(items, n))
    ranges = max(1, -(-held_out.count() // most))
    found = None
    for r in range(ranges):
        # both hashes of a passage are in the range of its MinHash
        own = held_out.where(F.pmod(F.xxhash64("minhash"), F.lit(ranges)) == r) if ranges > 1 else held_out
        size = own.count()
        part = windows(documents, table(own, "minhash", size), table(own, "passage", size), n)
        found = part if found is None else found.unionByName(part)
    found = checkpoint(found.distinct())
    total = found.count()
    left = found.withColumn("salt", F.lit(0))
    right = held_out.select("item_id", "passage", "words").withColumn("salt", F.lit(0))
    if total > hot:
        # at most total / hot passages are so frequent
        frequent = found.groupBy("passage").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("passage", F.ceil(F.col("c") / hot).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        left = found.join(frequent, "passage", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).drop("parts")
        right = right.drop("salt").join(frequent, "passage", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["passage", "words", "salt"]).select("doc_id", "item_id").distinct()
