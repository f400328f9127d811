"""Most similar vectors for every vector: adaptive scan of rotated dimensions within inverted lists.

Lists are the cells of a k-means in two levels: a few hundred upper centroids are trained on a bounded sample, then each
upper cell trains its own lists where its sample lies, on the executors.  Every vector is indexed.  The number of lists
grows with the vectors, so that lists keep their size and work grows in proportion.  A vector is also sent as a query to
other lists: with a threshold, to those that a neighbour within its distance may lie in, whose centroid is hardly farther
than the nearest one; without, to the ``probes`` nearest lists.  In a list, vectors are rotated by a random orthogonal
matrix and compared by blocks of dimensions; a hypothesis test on the partial distance abandons most candidates after the
first block.  What is left is compared exactly, in double precision.

Vectors that are null, all zero, of another length or hold a null or a number that isn't finite take no part.  Rows with
the same id and vector count once.  Cosines are rounded to ``DIGITS`` places; ties go to the smaller id, by its bytes.  Of
more than ``k + 1`` copies of one vector the first ``k + 1`` are compared; the others' neighbours are those of the first
of them, and itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a list, and of the sample for each list.
LIST_SIZE, SAMPLE_PER_LIST = 4096, 64
#: Vectors of which the upper centroids are trained (on the driver, 8 MB), and those of one upper cell's lists, at most.
ROOT_SAMPLE, CELL_SAMPLE = 32_768, 1 << 17
#: Lists at most (64 MB of centroids on every executor): beyond 10^9 vectors lists grow.
LISTS_MOST = 1 << 18
#: Roots among whose lists a vector's own one is looked for.
ROOTS = 8
#: Lists that a vector without a threshold looks into.
PROBES = 12
#: Candidates of one task; longer lists are cut into blocks.
BLOCK_SIZE = 16_384
#: Reach of the probes and significance of the test, in standard deviations.
PROBE_SIGMAS, TEST_SIGMAS = 2.5, 2.1
#: Share of a tile's pairs that pass the first test beyond which the rest of the tile's dimensions are one product.
DENSE = 0.05
#: Places of a cosine.
DIGITS = 9
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def blocks(dim: int) -> list[int]:
    """Ends of the blocks of dimensions: a quarter, a half, all."""
    return sorted({max(1, dim // 4), max(1, dim // 2), dim})


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), dim)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows can be: finite and not all zero."""
    with np.errstate(all="ignore"):
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(length) & (length > 0)
    return (x / np.where(good, length, 1)[:, None]).astype(np.float32), good


def train(sample: np.ndarray, lists: int, rounds: int = 6, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and the share of the sample in each list.  Spherical k-means."""
    lists = max(1, min(lists, len(sample)))
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(sample, centroids)
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        length = np.linalg.norm(sums, axis=1)
        keep = length > 1e-6
        centroids[found[keep]] = sums[keep] / length[keep, None]
    own = nearest(sample, centroids)
    return centroids, np.bincount(own, minlength=lists) / max(len(sample), 1)


def own_reach(x: np.ndarray, own: np.ndarray, lists: int, k: int, most: float) -> np.ndarray:
    """For each list how far its vectors have to look: ``most``, or less where all of the sampled vectors of the list have
    2 k others nearer than that, as in a dense region.  The true neighbours are nearer still."""
    out = np.full(lists, most)
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(lists + 1))
    for cell in np.flatnonzero(np.diff(bounds) > 4 * k):
        members = x[order[bounds[cell] : bounds[cell + 1]]]
        far = 0.0
        for at in range(0, len(members), 2048):
            d = np.sqrt(np.maximum(2 - 2 * members[at : at + 2048] @ members.T, 0))
            far = max(far, float(np.partition(d, 2 * k, axis=1)[:, 2 * k].max()))
        out[cell] = min(most, far)
    return out


class Lists:
    """Which lists and blocks a vector belongs to and probes."""

    def __init__(self, roots: np.ndarray, of_root: np.ndarray, centroids: np.ndarray, parts: np.ndarray, reach: np.ndarray, sigmas: float, probes: int | None):
        """``of_root``: the root of each list, ascending; ``parts``: its blocks; ``reach``: the distance within which its
        vectors look for neighbours; ``probes``: how many lists they look into instead."""
        self.roots, self.centroids, self.parts, self.probes = roots, centroids, parts, probes
        self.begin = np.searchsorted(of_root, np.arange(len(roots) + 1))
        self.block = np.concatenate([[0], np.cumsum(parts)])
        self.margin = sigmas * reach / math.sqrt(roots.shape[1])
        self.root_gaps = np.sqrt(np.maximum(2 - 2 * roots @ roots.T, 0))

    def _within(self, x: np.ndarray, root: int) -> np.ndarray:
        return x @ self.centroids[self.begin[root] : self.begin[root + 1]].T

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products with the roots, the nearest list in the nearest few roots, and the product with its centroid."""
        near = x @ self.roots.T
        # roots without lists hold no vector
        near[:, np.diff(self.begin) == 0] = -np.inf
        look = self._first(near, ROOTS)
        best, cell = np.full(len(x), -np.inf, dtype=np.float32), np.zeros(len(x), dtype=np.int64)
        for r in np.flatnonzero(look.any(0)):
            rows = np.flatnonzero(look[:, r])
            d = self._within(x[rows], r)
            j = d.argmax(1)
            d = d[np.arange(len(rows)), j]
            better = d > best[rows]
            best[rows[better]], cell[rows[better]] = d[better], self.begin[r] + j[better]
        return near, cell, best

    @staticmethod
    def _first(near: np.ndarray, n: int) -> np.ndarray:
        """True for the n largest of each row, infinite ones aside."""
        n = min(n, near.shape[1])
        return (near >= -np.partition(-near, n - 1, axis=1)[:, n - 1 : n]) & np.isfinite(near)

    def probed(self, x: np.ndarray, near: np.ndarray, cell: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of all lists that the rows look into; their own ones among them."""
        margin = self.margin[cell]
        look = self._first(near, self.probes or ROOTS)
        if self.probes is None:
            top = near.argmax(1)
            look |= near[np.arange(len(x)), top][:, None] - near <= margin[:, None] * self.root_gaps[top]
        rows, cells, nearness = [], [], []
        for r in np.flatnonzero(look.any(0)):
            at = np.flatnonzero(look[:, r])
            d = self._within(x[at], r)
            if self.probes is None:
                gap = np.sqrt(np.maximum(2 - 2 * self.centroids[cell[at]] @ self.centroids[self.begin[r] : self.begin[r + 1]].T, 0))
                probe = best[at][:, None] - d <= margin[at][:, None] * gap
            else:
                probe = self._first(d, self.probes)
            i, j = np.nonzero(probe)
            rows.append(at[i])
            cells.append(self.begin[r] + j)
            nearness.append(d[i, j])
        row, found, d = (np.concatenate(z) for z in (rows, cells, nearness))
        if self.probes is not None:
            order = np.lexsort((-d, row))
            row, found = row[order], found[order]
            first = np.searchsorted(row, np.arange(len(x)))
            keep = np.arange(len(row)) - first[row] < self.probes
            row, found = row[keep], found[keep]
        # the own list is the nearest of a few roots, and need not be among the nearest of all
        missing = np.setdiff1d(np.arange(len(x)), row[found == cell[row]])
        return np.concatenate([row, missing]), np.concatenate([found, cell[missing]])

    def assign(self, x: np.ndarray, hashes: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, block, whether the row is a candidate there, and whether it is a query there."""
        near, own, best = self.own(x)
        q = np.flatnonzero(asks)
        row, cell = self.probed(x[q], near[q], own[q], best[q]) if len(q) else (q, q)
        row = q[row]
        count = self.parts[cell]
        row, cell = np.repeat(row, count), np.repeat(cell, count)
        part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        home = hashes % self.parts[own]
        candidate = (own[row] == cell) & (home[row] == part)
        rest = np.flatnonzero(~asks)
        return (
            np.concatenate([row, rest]),
            np.concatenate([self.block[cell] + part, self.block[own[rest]] + home[rest]]),
            np.concatenate([candidate, np.ones(len(rest), dtype=bool)]),
            np.concatenate([np.ones(len(row), dtype=bool), np.zeros(len(rest), dtype=bool)]),
        )


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([(x[k : k + step] @ centroids.T).argmax(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, dtype=np.int64)


def scan(ids: np.ndarray, x: np.ndarray, candidate: np.ndarray, k: int, least: float | None, rotate: np.ndarray, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, cosine) within one block that are among the k nearest of either, at ``least`` or more.

    ``query``: the rows that ask, by default all; then pairs are only among the k nearest of the query."""
    asking = np.arange(len(x)) if query is None else np.flatnonzero(query)
    wide = x.astype(np.float64)
    wide /= np.sqrt((wide**2).sum(1))[:, None]
    turned = (wide @ rotate).astype(np.float32)
    at = np.flatnonzero(candidate)
    c = turned[at]
    ends = blocks(x.shape[1])
    head = ends[0]
    cut = [(e / x.shape[1]) * (1 + TEST_SIGMAS / math.sqrt(e)) ** 2 for e in ends]
    c_head = (c[:, :head] ** 2).sum(1)
    bound = np.full(len(x), np.inf if least is None else 2 - 2 * least + 1e-5, dtype=np.float32)
    # a first bound: the distance to the 2 k-th of some of the candidates (two rows may have one id, or be the query's)
    some = c[:: max(1, len(at) // (16 * k))]
    if len(some) > 2 * k:
        for q in range(0, len(asking), 4096):
            rows = asking[q : q + 4096]
            bound[rows] = np.minimum(bound[rows], np.partition(2 - 2 * turned[rows] @ some.T, 2 * k, axis=1)[:, 2 * k] + 1e-5)
    rank_of = np.argsort(np.argsort(ids, kind="stable"), kind="stable")

    def best(a: np.ndarray, b: np.ndarray, exact: np.ndarray) -> np.ndarray:
        """The 2 k first of each ``a``, as the same id may stand in two rows; in the order of a, then cosine."""
        if not len(a):
            return np.zeros(0, dtype=np.int64)
        order = np.lexsort((rank_of[b], -exact, a))
        start = np.concatenate([[True], a[order][1:] != a[order][:-1]])
        first = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        return order[np.arange(len(order)) - first < 2 * k]

    def squeeze(held: list) -> tuple[list, int]:
        """Only the nearest so far, and the last of them bounds what may follow."""
        i, j, exact = (np.concatenate(z) for z in zip(*held))
        keep = best(i, j, exact)
        i, j, exact = i[keep], j[keep], exact[keep]
        found, first, count = np.unique(i, return_index=True, return_counts=True)
        full = count == 2 * k
        bound[found[full]] = np.minimum(bound[found[full]], 2 - 2 * exact[first[full] + 2 * k - 1] + 1e-6)
        return [(i, j, exact)], len(i)

    out = []
    for q in range(0, len(asking), 2048):
        rows = asking[q : q + 2048]
        turned_rows = turned[rows]
        q_head = (turned_rows[:, :head] ** 2).sum(1)
        held, size = [], 0
        for t in range(0, len(at), 2048):
            partial = turned_rows[:, :head] @ c[t : t + 2048, :head].T
            # |q - c|² over the first block, against the bound of the query
            limit = (q_head - bound[rows] * cut[0])[:, None] * 0.5
            near = partial >= limit + 0.5 * c_head[None, t : t + 2048]
            dense = np.count_nonzero(near) > DENSE * near.size
            if dense:
                # where the first block abandons little, the rest is one more product
                partial += turned_rows[:, head:] @ c[t : t + 2048, head:].T
                near = 2 - 2 * partial <= bound[rows, None] + 1e-5
            i, j = np.nonzero(near)
            partial = q_head[i] + c_head[j + t] - 2 * partial[i, j]
            i, j = rows[i], j + t
            for b in range(1, 1 if dense else len(ends) - 1):
                partial = partial + ((turned[i, ends[b - 1] : ends[b]] - c[j, ends[b - 1] : ends[b]]) ** 2).sum(1)
                keep = partial <= bound[i] * cut[b]
                i, j, partial = i[keep], j[keep], partial[keep]
            for p in range(0, len(i), 1 << 18):
                a, b = i[p : p + (1 << 18)], at[j[p : p + (1 << 18)]]
                other = ids[a] != ids[b]
                a, b = a[other], b[other]
                exact = np.round(np.einsum("ij,ij->i", wide[a], wide[b]), DIGITS)
                keep = 2 - 2 * exact <= bound[a] + 4e-9
                if least is not None:
                    keep &= exact >= least
                held.append((a[keep], b[keep], exact[keep]))
                size += int(keep.sum())
                if size > 64 * k * len(rows):
                    held, size = squeeze(held)
        if least is None and size:
            held, size = squeeze(held)
        out += held
    if not out or not sum(len(z[0]) for z in out):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    i, j, exact = (np.concatenate(z) for z in zip(*out))
    keep = np.zeros(len(i), dtype=bool)
    keep[best(i, j, exact)] = True
    if query is None:
        keep[best(j, i, exact)] = True
    return i[keep], j[keep], exact[keep]


def index_of(usable: DataFrame, total: int, k: int, dim: int, list_size: int, reach: float, sigmas: float, probes: int | None) -> Lists:
    """Trains the lists.  The driver sees ``ROOT_SAMPLE`` vectors and the centroids; all else stays on the executors."""
    lists = max(1, min(LISTS_MOST, round(total / list_size)))
    wanted = max(4096, lists * SAMPLE_PER_LIST)
    # rows by the hash of their vector, so copies come together
    every = max(1, total // wanted)
    sample = usable.where(F.pmod("h", F.lit(every)) == 0).select("embedding", "h")
    thinner = max(1, wanted // ROOT_SAMPLE)
    drawn = sample.where(F.pmod(F.xxhash64("h"), F.lit(thinner)) == 0).select("embedding").limit(2 * ROOT_SAMPLE).toArrow()["embedding"]
    if len(drawn) == 0:
        sample = usable.select("embedding", "h")
        drawn = sample.select("embedding").limit(ROOT_SAMPLE).toArrow()["embedding"]
    x, good = unit(matrix(drawn.combine_chunks(), dim)) if len(drawn) else (np.zeros((0, dim), dtype=np.float32), np.zeros(0, dtype=bool))
    x = np.unique(x[good], axis=0) if good.any() else np.eye(1, dim, dtype=np.float32)
    roots, _ = train(x, math.ceil(math.sqrt(lists)))
    shared = usable.sparkSession.sparkContext.broadcast(roots)
    per_list = max(1.0, total / every / lists)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = unit(matrix(batch.column(0), dim))
            x = x[good]
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x, shared.value), pa.int32()), packed(x, dim)], names=["root", "vector"])

    def train_cell(table: pa.Table) -> pa.Table:
        x = unpacked(table.column("vector"), dim)
        n = len(x)
        lists = max(1, round(n / per_list))
        x = np.unique(x, axis=0)
        x = x[np.random.default_rng(SEED).permutation(len(x))[:CELL_SAMPLE]]
        centroids, shares = train(x, lists)
        far = own_reach(x, nearest(x, centroids), len(centroids), k, reach)
        return pa.table({"root": pa.array([table.column("root")[0].as_py()] * len(centroids), pa.int32()), "share": pa.array(shares * n), "reach": pa.array(far), "centroid": packed(centroids, dim)})

    found = sample.mapInArrow(spread, "root int, vector binary").groupBy("root").applyInArrow(train_cell, "root int, share double, reach double, centroid binary").toArrow()
    if not found.num_rows:
        return Lists(roots[:1], np.zeros(1, dtype=np.int64), roots[:1], np.ones(1, dtype=np.int64), np.full(1, reach), sigmas, probes)
    found = found.sort_by("root")
    share = found["share"].to_numpy()
    parts = np.maximum(1, np.ceil(share / share.sum() * total / BLOCK_SIZE)).astype(np.int64)
    return Lists(roots, found["root"].to_numpy(), unpacked(found["centroid"], dim), parts, found["reach"].to_numpy(), sigmas, probes)


def packed(x: np.ndarray, dim: int) -> pa.Array:
    data = np.ascontiguousarray(x, dtype=np.float32)
    return pa.Array.from_buffers(pa.binary(dim * 4), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), dim)


def neighbours(vectors: DataFrame, k: int = 10, least: float | None = None, dim: int = 64, list_size: int = LIST_SIZE, sigmas: float = PROBE_SIGMAS, probes: int = PROBES, queries: Column | None = None) -> DataFrame:
    """id, other, cosine, rank: the k most similar other ids of each id, of cosine ``least`` or more if given.

    ``vectors``: id (string), embedding.  ``queries``: a condition on the id; only ids that meet it ask, against all
    vectors.  More ``probes`` find more and cost more."""
    spark = vectors.sparkSession
    usable = vectors.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)).select("id", "embedding")
    usable = usable.withColumn("h", F.xxhash64("embedding"))
    reach = math.sqrt(2 - 2 * least) if least is not None else 2.0
    index = spark.sparkContext.broadcast((index_of(usable, vectors.count(), k, dim, list_size, reach, sigmas, None if least is not None else probes), rotation(dim)))

    # a row delivered again would take the place of another neighbour in the scan
    copies = usable.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h")
    usable = usable.dropDuplicates(["id", "h"]).withColumn("asks", F.lit(True) if queries is None else queries)
    further = None
    if copies.limit(1).count():
        # copies beyond the first k + 1 are no one's neighbours and have those of the first
        of_many = usable.join(copies, "h", "left_semi")
        ranked = of_many.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("n") <= k + 1)
        leaders = ranked.groupBy("h").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n")).where(F.col("n") == k + 1).select("h", "leader", "last")
        further = of_many.where("asks").select("id", "h").join(leaders, "h").where(F.col("id") > F.col("last")).select("id", "leader")
        # the leader's list is needed whether it asks or not
        first = ranked.join(leaders.select(F.col("leader").alias("id"), "h", F.lit(True).alias("leads")), ["id", "h"], "left")
        first = first.select("id", "embedding", "h", (F.col("asks") | F.col("leads").isNotNull()).alias("asks"))
        usable = usable.join(copies, "h", "left_anti").select("id", "embedding", "h", "asks").unionByName(first)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = index.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = matrix(part.column(1), dim)
                x, good = unit(raw)
                asks = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                row, block, candidate, query = lists.assign(x, part.column(2).to_numpy(zero_copy_only=False).view(np.uint64).astype(np.int64) & 0x7FFFFFFF, asks)
                keep = good[row]
                row, block, candidate, query = row[keep], block[keep], candidate[keep], query[keep]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), part.column(0).take(pa.array(row)), pa.array(candidate), pa.array(query), packed(raw, dim).take(pa.array(row))], names=["block", "id", "candidate", "query", "vector"])

    some_ask = queries is not None

    def compare(table: pa.Table) -> pa.Table:
        rotate = index.value[1]
        ids = table.column("id").to_pandas().to_numpy()
        keys = np.array([i.encode() for i in ids], dtype=object)
        i, j, cosine = scan(keys, unpacked(table.column("vector"), dim), table.column("candidate").to_numpy(), k, least, rotate, table.column("query").to_numpy() if some_ask else None)
        if not some_ask:
            # a pair is told from both sides
            i, j, cosine = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cosine, cosine])
        return pa.table({"id": pa.array(ids[i], pa.string()), "other": pa.array(ids[j], pa.string()), "cosine": pa.array(cosine, pa.float64())})

    sent = usable.select("id", "embedding", "h", F.coalesce("asks", F.lit(False)).alias("asks")).mapInArrow(send, "block int, id string, candidate boolean, query boolean, vector binary")
    # blocks are tasks of their own, about one to a partition whatever the session's setting; very many share partitions
    found = sent.repartition(int(min(1 << 15, index.value[0].parts.sum())), "block").groupBy("block").applyInArrow(compare, "id string, other string, cosine double")
    each = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    nearest_first = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    ranked = each.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    if further is not None:
        lists = ranked.select(F.col("id").alias("leader"), "other", "cosine")
        own = further.join(lists, "leader").select("id", "other", "cosine").unionByName(further.select("id", F.col("leader").alias("other"), F.lit(1.0).alias("cosine")))
        own = own.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
        # a leader that wasn't asked for leaves again
        ranked = ranked.unionByName(own)
        ranked = ranked if queries is None else ranked.where(queries)
    return ranked
