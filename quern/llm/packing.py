"""Filling containers of fixed capacity with items, by lexical retrieval.

Items are spread over shards by what they are about: the token that tells most about an item (its count times the rarity
of the token in the whole corpus), and in large shards the second one too.  Tokens have at most as many shards as their
counts ask for, rare ones share a shard, and a pair of tokens that very many items share, copies above all, is spread by
the items' keys; so shards are of about ``SHARD_ITEMS`` items whatever the data.

Each shard holds an inverted index with BM25 weights of the whole corpus; tokens that one item in eight has weigh nothing
and are left out.  The largest unused item seeds a container; the index returns its nearest unused neighbours, which fill the
window one by one, nearest first, until a quarter of it is left; of the nearest that fit there, those that fill it best are
taken (a subset sum over the free space, kept as the bits of an integer).  An item is only split if it exceeds the
capacity: full containers first, its rest is an item like others, with the tokens of the rest.  Each shard leaves about one
container partly empty.

Null and empty texts have no tokens and are in no container.  Of rows with an equal key each is an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 2048
#: Items of a shard on average; neighbours that are tried at a time.
SHARD_ITEMS, NEIGHBOURS = 4096, 64
#: Part of the capacity below which the space that is left is filled as well as possible.
LAST_PART = 0.25
#: Terms that such a share of the corpus's items has tell nothing about an item.
COMMON = 0.125
K1, B = 1.2, 0.75


class Index:
    """An inverted index over lists of (term, count), with BM25 weights worked out from the corpus's statistics."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        """``idf`` by term and ``mean`` length are those of the corpus; by default those of the lists."""
        n = len(terms)
        sizes = np.fromiter(map(len, terms), dtype=np.int64, count=n)
        term = np.concatenate(terms).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
        tf = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        item = np.repeat(np.arange(n), sizes)
        length = np.bincount(item, weights=tf, minlength=n)
        if mean is None:
            mean = float(length.mean()) if n else 1.0
        if idf is None:
            idf = rarity(np.bincount(term), n)
        order = np.argsort(term, kind="stable")
        order = order[idf[term[order]] > 0]
        self.vocabulary, self.first = np.unique(term[order], return_index=True)
        self.first = np.concatenate([self.first, [len(order)]])
        self.item = item[order].astype(np.int32)
        self.weight = idf[term[order]] * tf[order] * (K1 + 1) / (tf[order] + K1 * (1 - B + B * length[self.item] / max(mean, 1e-9)))
        self.terms, self.n = terms, n

    def keep(self, items: np.ndarray) -> None:
        """Leaves out the postings of all other items."""
        held = items[self.item]
        self.first = np.concatenate([[0], np.cumsum(held)])[self.first]
        self.item, self.weight = self.item[held], self.weight[held]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every item for the seed's terms."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        at = at[at < len(self.vocabulary)]
        at = at[np.isin(self.vocabulary[at], self.terms[seed])]
        if not len(at):
            return np.zeros(self.n)
        begin, size = self.first[at], self.first[at + 1] - self.first[at]
        spread = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.item[spread], weights=self.weight[spread], minlength=self.n)


def rarity(df: np.ndarray, n: int) -> np.ndarray:
    """The weight of terms that ``df`` of ``n`` items have: it falls to 0 for those that a share COMMON of them has."""
    return np.maximum(np.log((n - df + 0.5) / (df + 0.5)) - np.log(1 / COMMON - 1), 0)


def best_fill(sizes: list[int], space: int) -> list[int]:
    """Which of the sizes add up to the most within ``space``; of equal sums the one of earlier sizes."""
    reach, steps = 1, []
    mask = (1 << (space + 1)) - 1
    for s in sizes:
        steps.append(reach)
        reach |= (reach << s) & mask
        if reach >> space & 1:
            break
    total = reach.bit_length() - 1
    chosen = []
    for k in range(len(steps) - 1, -1, -1):
        if not steps[k] >> total & 1:
            chosen.append(k)
            total -= sizes[k]
    return chosen[::-1]


def fill(sizes: np.ndarray, index: Index, capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """The items of each container, and how near each item is to its seed, as a share of the seed's score for itself."""
    order = np.argsort(-sizes, kind="stable")
    unused = np.ones(len(sizes), dtype=bool)
    nearness = np.full(len(sizes), np.nan)
    left = indexed = len(sizes)
    out = []
    for seed in order:
        if not unused[seed]:
            continue
        if 3 * left < 2 * indexed:
            # used items would be scored for nothing
            index.keep(unused)
            indexed = left
        unused[seed] = False
        box, space = [int(seed)], capacity - int(sizes[seed])
        left -= 1
        score = index.scores(int(seed)) if space and left else None
        while space and left:
            fits = np.flatnonzero(unused & (sizes <= space))
            if not len(fits):
                break
            some = len(fits) > NEIGHBOURS
            near = fits[np.argpartition(-score[fits], NEIGHBOURS)[:NEIGHBOURS]] if some else fits
            near = near[np.lexsort((near, -score[near]))]
            if space > LAST_PART * capacity and some:
                # the nearest, as far as they leave a last part to be filled
                upto = np.cumsum(sizes[near])
                chosen = near[: max(1, int(np.searchsorted(upto, space - LAST_PART * capacity / 2, side="right")))]
            else:
                chosen = near[best_fill(sizes[near].tolist(), space)]
            if not len(chosen):
                break
            unused[chosen] = False
            left -= len(chosen)
            box += chosen.tolist()
            space -= int(sizes[chosen].sum())
            nearness[chosen] = score[chosen] / max(score[seed], 1e-9)
            if not some:
                break
        out.append(box)
    return out, nearness


_MEASURED = "part int, first_token int, n_tokens int, terms binary, counts binary"


def _measure(path: str, capacity: int):
    names = ["key", *(f.split()[0] for f in _MEASURED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids = enc.encode(part.column(1))
                offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.diff(offsets)
                full = size // capacity
                rest = size - full * capacity
                row = np.repeat(np.arange(len(size)), size)
                # terms are the tokens of the text, or of its rest, each with its count; sorted by row
                last = np.arange(len(values)) - offsets[row] >= (full * capacity)[row]
                code, count = np.unique(row[last] << 32 | values[last], return_counts=True)
                bounds = np.searchsorted(code >> 32, np.arange(len(size) + 1))
                rows = np.concatenate([np.repeat(np.arange(len(size)), full), np.flatnonzero(rest)])
                parts = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[rest > 0]])
                n = np.concatenate([np.full(full.sum(), capacity), rest[rest > 0]])
                whole = np.arange(len(rows)) < full.sum()
                none = np.zeros(0, dtype=np.int32)
                terms = [none if w else (code[bounds[r] : bounds[r + 1]] & 0xFFFFFFFF).astype(np.int32) for r, w in zip(rows, whole)]
                counts = [none if w else count[bounds[r] : bounds[r + 1]].astype(np.int32) for r, w in zip(rows, whole)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(parts, pa.int32()), pa.array(parts * capacity, pa.int32()), pa.array(n, pa.int32()), pa.array([t.tobytes() for t in terms], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())],
                    names=names,
                )

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many items each term is, and (as term -1) how many items there are and how long they are together."""
    df, items, length = np.zeros(1, dtype=np.int64), 0, 0
    for batch in batches:
        lists = [b for b in batch.column(0).to_pylist() if b]
        if lists:
            seen = np.bincount(np.frombuffer(b"".join(lists), dtype=np.int32))
            if len(seen) > len(df):
                df, seen = seen, df
            df[: len(seen)] += seen
            items += len(lists)
            length += int(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int32).sum())
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1]]), pa.int32()), pa.array(np.concatenate([df[at], [items]]), pa.int64()), pa.array(np.concatenate([np.zeros(len(at), dtype=np.int64), [length]]), pa.int64())], names=["term", "df", "length"])


def _topics(idf):
    """The two terms that tell most about each item; -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value[0]
        for batch in batches:
            found = np.full((batch.num_rows, 2), -1, dtype=np.int32)
            for n, (t, c) in enumerate(zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())):
                if t:
                    term = np.frombuffer(t, dtype=np.int32)
                    w = np.sqrt(np.frombuffer(c, dtype=np.int32)) * weight[term]
                    first = w.argmax()
                    found[n, 0] = term[first]
                    if len(term) > 1:
                        w[first] = -1
                        found[n, 1] = term[w.argmax()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*batch.schema.names, "topic", "second"])

    return run


def shards_of(topics: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each topic with so many items its first shard and how many it has; rare ones share one."""
    out, shard, held = {}, 0, 0
    for topic in sorted(topics):
        n = topics[topic]
        if n > most:
            if held:
                shard, held = shard + 1, 0
            parts = -(-n // most)
            out[topic] = (shard, parts)
            shard += parts
            continue
        if held + n > most:
            shard, held = shard + 1, 0
        out[topic] = (shard, 1)
        held += n
    return out


def _pack_shard(capacity: int, idf):
    def run(table: pa.Table) -> pa.Table:
        weight, mean = idf.value
        shard = table.column("shard")[0].as_py()
        order = np.lexsort((table.column("part").to_numpy(), table.column("hash").to_numpy()))
        table = table.take(pa.array(order))
        sizes = table.column("n_tokens").to_numpy().astype(np.int64)
        terms = [np.frombuffer(b, dtype=np.int32) for b in table.column("terms").to_pylist()]
        counts = [np.frombuffer(b, dtype=np.int32) for b in table.column("counts").to_pylist()]
        boxes, nearness = fill(sizes, Index(terms, counts, weight, mean), capacity)
        box = np.zeros(len(sizes), dtype=np.int64)
        for k, members in enumerate(boxes):
            box[members] = k
        return pa.table({"container": pa.array((np.int64(shard) << 32) + box), "key": table.column("key"), "part": table.column("part"), "first_token": table.column("first_token"), "n_tokens": table.column("n_tokens"), "nearness": pa.array(nearness, from_pandas=True)})

    return run


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None, shard_items: int = SHARD_ITEMS, checkpoint=lambda x: x, by_content: bool = True) -> DataFrame:
    """container, key, part, first_token, n_tokens, nearness (to the container's seed; null for seeds).

    Only items over ``capacity`` have several parts: all but the last fill a container of their own.  ``checkpoint`` cuts the
    lineage of the measured items, which are read for the statistics, the shards and the containers.  Without
    ``by_content`` items are sharded by chance, for comparison."""
    path = tokens.tokenizer_path(tokenizer)
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    measured = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_measure(path, capacity), f"key {kind}, {_MEASURED}")
    measured = checkpoint(measured.withColumn("hash", F.xxhash64("key")))
    # at most one row for each token of the vocabulary
    stats = measured.select("terms", "counts").mapInArrow(_frequencies, "term int, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).toArrow()
    term, seen = stats["term"].to_numpy(), stats["df"].to_numpy()
    n, length = (int(stats[c].to_numpy()[term < 0].sum()) for c in ("df", "length"))
    df_of = np.zeros(max(int(term.max(initial=0)), 0) + 1, dtype=np.int64)
    df_of[term[term >= 0]] = seen[term >= 0]
    idf = spark.sparkContext.broadcast((rarity(df_of, n), length / max(n, 1)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema.fields)
    told = measured.mapInArrow(_topics(idf), f"{schema}, topic int, second int") if by_content else measured.withColumn("topic", F.lit(0)).withColumn("second", F.pmod("hash", F.lit(1 << 30)).cast("int"))
    pairs = checkpoint(told.groupBy("topic", "second").agg(F.count("*").alias("n")))
    hot = pairs.where(F.col("n") > shard_items)
    some_hot = hot.limit(1).count() > 0
    # pairs of very many items have shards of their own; there is at most one such pair for each shard_items items
    topics = {r.topic: r.n for r in pairs.where(F.col("n") <= shard_items).groupBy("topic").agg(F.sum("n").alias("n")).toLocalIterator()}
    placed = shards_of(topics, shard_items)
    places = spark.createDataFrame([(t, a, b) for t, (a, b) in placed.items()], "topic int, base long, parts int")
    told = told.join(F.broadcast(places), "topic", "left")
    shard = F.col("base") + F.pmod(F.xxhash64("second"), F.col("parts"))
    if some_hot:
        told = told.join(hot.select("topic", "second", F.ceil(F.col("n") / shard_items).alias("own")), ["topic", "second"], "left")
        apart = F.shiftleft(F.lit(1).cast("long"), 30) + F.pmod(F.xxhash64("topic", "second", F.pmod(F.xxhash64("hash"), F.col("own"))), F.lit(1 << 30))
        shard = F.when(F.col("own").isNotNull(), apart).otherwise(shard)
    packed = told.withColumn("shard", shard).select("key", "part", "first_token", "n_tokens", "terms", "counts", "hash", "shard").groupBy("shard").applyInArrow(_pack_shard(capacity, idf), f"container long, key {kind}, part int, first_token int, n_tokens int, nearness double")
    return packed.select("container", F.col("key").alias(key), "part", "first_token", "n_tokens", "nearness")
