"""Ranked channels over a collection, and their fusion.

A ranked list has the columns query_id, channel, doc_id, score and rank (from 1).  Every rank has a full tie-break: equal
scores go by the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first by ``order``.  An upsert whose last writer wins is this over the union."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(df: DataFrame, k: int, by: str = "query_id", score: str = "score", channel: str | None = None) -> DataFrame:
    """The k best rows of each query, with their rank."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), "doc_id")
    out = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("channel", F.lit(channel)) if channel else out


def postings(docs: DataFrame, doc_id: str, text: str, stem=lambda tokens: tokens) -> DataFrame:
    """doc_id, term, tf, length of each document and term: a full-text index as a table.

    Documents without words have no rows; null texts have none."""
    words = docs.select(F.col(doc_id).alias("doc_id"), stem(T.tokens(F.col(text))).alias("words")).withColumn("length", F.size("words"))
    return words.select("doc_id", "length", F.explode("words").alias("term")).groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


#: Pairs of a query and a word that are sent to the executors at a time: two arrays of 32 MB.
SLICE_PAIRS = 1 << 23


def bm25(queries: DataFrame, docs: DataFrame, k: int = 20, digits: int | None = 6, normalise: Callable[[Column], Column] | None = None, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """The k best documents by BM25 for any of a query's words; higher is better.

    ``queries``: query_id, text; ``docs``: doc_id, text.  ``normalise`` makes what is compared of the folded words, such
    as stems.  Words are counted once in a query.  Words in more than half of the documents weigh almost nothing.
    Documents of a null text are in no list and have the length 0.

    Words that every document has would make a join as large as queries times documents.  So queries go to the
    documents, as lists of the queries that hold a word; each batch of documents adds up its scores and keeps the k best
    of each query.  Queries come in slices of about ``slice_pairs`` words, so what is sent is bounded."""
    words_of = lambda c: T.tokens(c) if normalise is None else normalise(T.tokens(c))
    asked = queries.select("query_id", words_of(F.col("text")).alias("words")).select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    total = asked.count()
    slices = max(1, -(-total // slice_pairs))
    # the number of documents, their mean length, and in how many of them a word is: one pass
    vocabulary = asked.select("term").distinct().unionByName(queries.sparkSession.createDataFrame([("",)], "term string"))
    length = F.greatest(F.size("words"), F.lit(0))
    each = F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("words"), F.array().cast("array<string>")))
    df = words.select(length.alias("length"), F.explode(each).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length"))
    size = df.where("term = ''").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("mean"))
    idf = F.when(F.col("n") * 1.0 > 2 * F.col("df"), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).otherwise(1e-6)
    weighted = df.where("term <> ''").join(F.broadcast(size)).select("term", idf.alias("idf"), "mean")
    pairs = asked.join(weighted, "term").select("query_id", "term", "idf", "mean")
    if slices > 1:
        pairs = pairs.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))
    scored = None
    for n in range(slices):
        part = (pairs.where(F.col("slice") == n).drop("slice") if slices > 1 else pairs).toArrow()
        hits = _bm25_slice(part, words, k, digits, asked.schema["query_id"].dataType.simpleString())
        if hits is not None:
            scored = hits if scored is None else scored.unionByName(hits)
    if scored is None:
        kinds = (asked.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
        scored = queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return ranked(scored, k, channel="bm25")


def word_shares(asked: DataFrame, words: DataFrame, k: int, digits: int | None = 6, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """The k documents that hold the largest share of a query's words: query_id, doc_id, score, rank.

    ``asked``: query_id, term, distinct; ``words``: doc_id, words.  The plan is that of ``bm25``."""
    slices = max(1, -(-asked.count() // slice_pairs))
    pairs = asked.select("query_id", "term", F.lit(1.0).alias("idf"), F.lit(0.0).alias("mean"))
    kind, scored = asked.schema["query_id"].dataType.simpleString(), None
    for n in range(slices):
        part = pairs.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == n) if slices > 1 else pairs
        hits = _bm25_slice(part.toArrow(), words, k, digits, kind, share=True)
        if hits is not None:
            scored = hits if scored is None else scored.unionByName(hits)
    if scored is None:
        scored = asked.sparkSession.createDataFrame([], f"query_id {kind}, doc_id {words.schema['doc_id'].dataType.simpleString()}, score double")
    return ranked(scored, k)


def _bm25_slice(pairs: pa.Table, words: DataFrame, k: int, digits: int | None, kind: str, share: bool = False) -> DataFrame | None:
    """Scores of the documents for the queries of ``pairs``: query_id, term, idf, mean.  ``share``: the score is the share
    of the query's words that a document has."""
    if not pairs.num_rows:
        return None
    ids = pairs["query_id"].combine_chunks().dictionary_encode()
    terms = pairs["term"].combine_chunks().dictionary_encode()
    term, query = terms.indices.to_numpy(), ids.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(terms.dictionary) + 1))
    idf = np.zeros(len(terms.dictionary))
    idf[term] = pairs["idf"].to_numpy()
    place = {t: n for n, t in enumerate(terms.dictionary.to_pylist())}
    asked = np.bincount(query, minlength=len(ids.dictionary))
    shared = words.sparkSession.sparkContext.broadcast((place, idf, first, query[order].astype(np.int32), ids.dictionary, float(pairs["mean"][0].as_py() or 0), asked))

    def score(batches):
        place, idf, first, of_term, ids, mean, asked = shared.value
        queries, degree = len(ids), np.diff(first)
        step = max(16, (2 << 20) // max(1, queries))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists, n = part.column(1), part.num_rows
                length = np.maximum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
                coded = lists.flatten().dictionary_encode()
                known = np.array([place.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
                found = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, dtype=np.int64)
                row = np.repeat(np.arange(n), length)
                keep = found >= 0
                cell, tf = np.unique(row[keep] * len(place) + found[keep], return_counts=True)
                row, found = np.divmod(cell, len(place))
                norm = K1 * (1 - B + B * length[row] / mean) if mean else 1.0
                weight = np.ones(len(found)) if share else idf[found] * tf * (K1 + 1) / (tf + norm)
                # each word of a document meets the queries that hold it
                many = degree[found]
                spread = np.repeat(first[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                target = np.repeat(row, many) * queries + of_term[spread]
                s = np.bincount(target, weights=np.repeat(weight, many), minlength=n * queries).astype(np.float64).reshape(n, queries)
                hit = np.zeros(n * queries, dtype=bool)
                hit[target] = True
                hit = hit.reshape(n, queries)
                if share:
                    s /= asked
                if digits is not None:
                    s = np.round(s, digits)
                s[~hit] = -np.inf
                # ties with the k-th best stay in: the final ranking decides
                top = min(k, n)
                kth = np.partition(s, n - top, axis=0)[n - top]
                i, j = np.nonzero((s >= kth) & hit)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(s[i, j])], names=["query_id", "doc_id", "score"])

    return words.mapInArrow(score, f"query_id {kind}, doc_id {words.schema['doc_id'].dataType.simpleString()}, score double")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of arrays of one length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def vector_topk(queries: DataFrame, docs: DataFrame, k: int = 20, block: int = 65_536, digits: int | None = 6, cosine: bool = False, exclude_self: bool = False) -> DataFrame:
    """The k best documents by dot product (or cosine) for each query, exactly.

    ``queries``: query_id, embedding; ``docs``: doc_id, embedding.  Documents are spread over blocks; each block meets
    all queries as matrices and keeps its k best, and the best of those are kept.  Null and empty vectors take no part;
    all-zero ones have the cosine 0.  All vectors must have one length."""
    # fresh names: both sides may come from one table
    docs = docs.where(F.size("embedding") > 0).select(F.col("doc_id").alias("doc_id"), F.col("embedding").alias("d_vector"))
    queries = queries.where(F.size("embedding") > 0).select(F.col("query_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    blocks = max(1, -(-docs.count() // block))
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (docs, "doc_id"))}
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        none = pa.table({"query_id": q["query_id"].slice(0, 0), "doc_id": d["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not q.num_rows or not d.num_rows:
            return none
        d = d.sort_by("doc_id")
        x, y = _vectors(q["q_vector"]), _vectors(d["d_vector"])
        if cosine:
            x, y = (v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1) for v in (x, y))
        qid, did = q["query_id"].to_pandas().to_numpy(), d["doc_id"].to_pandas().to_numpy()
        rows, cols, scores = [], [], []
        for at in range(0, len(x), 1024):
            s = x[at : at + 1024] @ y.T
            if digits is not None:
                s = np.round(s, digits)
            if exclude_self:
                s[qid[at : at + 1024, None] == did[None, :]] = -np.inf
            top = min(k, s.shape[1])
            kth = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
            i, j = np.nonzero((s >= kth[:, None]) & (s > -np.inf))
            # ties with the k-th best in the order of ids, up to k
            order = np.lexsort((j, -s[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(at + i[keep])
            cols.append(j[keep])
            scores.append(s[i[keep], j[keep]])
        return pa.table({"query_id": q["query_id"].take(pa.array(np.concatenate(rows))), "doc_id": d["doc_id"].take(pa.array(np.concatenate(cols))), "score": pa.array(np.concatenate(scores))})

    schema = f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double"
    partial = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(best, schema)
    return ranked(partial, k, channel="cosine")


def best_per_group(hits: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Hits on parts turned into hits on what they belong to, by the best score.  ``groups``: doc_id, group_id."""
    scored = hits.join(groups, "doc_id").groupBy("query_id", "group_id").agg(F.max("score").alias("score"))
    return ranked(scored.withColumnRenamed("group_id", "doc_id"), k)


def cell_search(queries: DataFrame, cells: DataFrame, k: int = 5, least: float = 2.0, allowed: tuple[str, ...] = (), boosts: Mapping[str, float] | None = None, prefix: bool = True, most_terms: int = 10) -> DataFrame:
    """Tables by matching cells: 1 for each cell, 0.5 for each cell of a matching column, ``least`` in all.

    ``queries``: query_id, text; ``cells``: table_id, col_name, cell_value.  A word of a cell matches a term that it
    starts with; a cell counts once however many terms match.  Without ``prefix``, a term counts for each cell that
    contains it, and once for each table with such a column.  ``boosts``: more for some tables that matched."""
    wanted = queries.select("query_id", F.slice(T.terms(F.col("text"), 4, allowed), 1, most_terms).alias("terms")).select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    if prefix:
        wanted = wanted.withColumn("term", T.fold(F.col("term"))).distinct()
        values = cells.groupBy("table_id", F.lit(1.0).alias("worth"), F.col("cell_value").alias("value")).agg(F.count("*").alias("n"))
        columns = cells.groupBy("table_id", F.lit(0.5).alias("worth"), F.col("col_name").alias("value")).agg(F.count("*").alias("n"))
        held = values.unionByName(columns)
        # terms meet the distinct words of the cells, on the first letters of both
        head = lambda c: F.substring(c, 1, 4)
        words = held.select(F.explode(T.tokens(F.col("value"))).alias("word")).distinct()
        keyed = words.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring(F.col("word"), F.lit(1), n)))).alias("k"))
        matched = keyed.join(wanted.select("term", head(F.col("term")).alias("k")).distinct(), "k").where(F.startswith(F.col("word"), F.col("term"))).select("term", "word")
        # queries that hold the same terms of these are one
        sets = wanted.join(matched.select("term").distinct(), "term", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        terms = sets.select("terms").distinct().select("terms", F.explode("terms").alias("term"))
        met = terms.join(matched, "term").join(held.select("table_id", "worth", "value", "n", F.explode(F.array_distinct(T.tokens(F.col("value")))).alias("word")), "word").select("terms", "table_id", "worth", "value", "n").distinct()
        hits = met.select(F.col("terms").alias("query_id"), "table_id", (F.col("worth") * F.col("n")).alias("worth"))
    else:
        value = cells.join(wanted, F.contains(F.lower("cell_value"), F.col("term"))).select("query_id", "table_id", F.lit(1.0).alias("worth"))
        column = cells.select("table_id", "col_name").distinct().join(wanted, F.contains(F.lower("col_name"), F.col("term"))).select("query_id", "term", "table_id").distinct().select("query_id", "table_id", F.lit(0.5).alias("worth"))
        hits = value.unionByName(column)
    scored = hits.groupBy("query_id", "table_id").agg(F.sum("worth").alias("score"))
    if boosts:
        table = F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv))
        scored = scored.withColumn("score", F.col("score") + F.coalesce(F.try_element_at(table, F.col("table_id")), F.lit(0.0)))
    best = ranked(scored.where(F.col("score") >= least).withColumnRenamed("table_id", "doc_id"), k, channel="structured")
    return sets.join(best.withColumnRenamed("query_id", "terms"), "terms").drop("terms") if prefix else best


#: The order of channels, which breaks ties, and their weights.
CHANNELS = ("cosine", "bm25", "structured", "rows", "synthetic", "targeted")
WEIGHTS = {"cosine": 1.0, "bm25": 1.0, "structured": 1.5, "rows": 0.5, "synthetic": 0.5, "targeted": 1.0}


def fuse(hits: DataFrame, k: int = 60, weights: Mapping[str, float] = WEIGHTS, by: tuple[str, ...] = ("query_id",), digits: int = 12) -> DataFrame:
    """Weighted reciprocal rank fusion: score = sum of weight / (k + rank) over the channels.

    Ties go to the document that comes first in the first channel, in the order of CHANNELS.  A channel of weight 0
    still brings its documents in.  A hit's own ``weight``, if there is such a column and it isn't null, comes first."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    place = F.create_map(*(F.lit(x) for kv in ((c, n) for n, c in enumerate(CHANNELS)) for x in kv))
    weight = F.coalesce(*([F.col("weight")] if "weight" in hits.columns else []), F.try_element_at(table, F.col("channel")), F.lit(1.0))
    first = F.struct(F.coalesce(F.try_element_at(place, F.col("channel")), F.lit(len(CHANNELS))).alias("c"), F.col("rank").alias("r"))
    fused = hits.groupBy(*by, "doc_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), digits).alias("score"), F.min(first).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "_first", "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).drop("_first")


def adaptive_k(hits: DataFrame, least_score: float = 0.005, least: int = 3, most: int = 10, buffer: int = 0, by: str = "query_id") -> DataFrame:
    """Cuts each list at its first largest gap: the ``most`` best, those of ``least_score``, then, if more than ``least``
    are left, up to the gap and ``buffer`` more, ``least`` at the fewest."""
    inside = hits.where((F.col("rank") <= most) & (F.col("score") >= least_score))
    order = Window.partitionBy(by).orderBy("rank")
    everything = Window.partitionBy(by)
    gaps = inside.withColumn("_gap", F.col("score") - F.lead("score").over(order)).withColumn("_n", F.count("*").over(everything)).withColumn("_top", F.max("_gap").over(everything))
    cut = F.greatest(F.min(F.when(F.col("_gap") == F.col("_top"), F.col("rank"))).over(everything) + buffer, F.lit(least))
    return gaps.withColumn("_cut", F.when(F.col("_n") <= least, F.col("_n")).otherwise(cut)).where(F.col("rank") <= F.col("_cut")).drop("_gap", "_n", "_top", "_cut")


def ranked_again(hits: DataFrame) -> DataFrame:
    """Ranks without holes, in the order they have."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def drop_pages(hits: DataFrame, where: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits without those on unwanted pages.  ``where``: doc_id, source, page, one row for each id; ``pages``: source,
    page.  Ids that are nowhere, and null pages, stay."""
    bad = where.join(pages, ["source", "page"], "left_semi").select("doc_id").distinct()
    return hits.join(bad, "doc_id", "left_anti")


def first_of(*tables: DataFrame) -> DataFrame:
    """Rows by doc_id from the first of the tables that has the id."""
    parts = [t.withColumn("_p", F.lit(n)) for n, t in enumerate(tables)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return latest(union, "doc_id", F.col("_p")).drop("_p")


def boosted(hits: DataFrame, preferred: Column, factor: float, k: int, digits: int = 4) -> DataFrame:
    """Preferred documents' scores times ``factor``, rounded before ranking; ``fallback`` where none of the k is one.

    Queries without a preferred hit among their k best keep their plain list."""
    plain = hits.withColumn("preferred", preferred)
    w = Window.partitionBy("query_id")
    lifted = plain.withColumn("score", F.round(F.col("score") * F.when(F.col("preferred"), factor).otherwise(1.0), digits)).drop("rank")
    top = ranked(lifted, k).withColumn("_hits", F.sum(F.col("preferred").cast("int")).over(w))
    helped = top.where("_hits > 0").drop("_hits").withColumn("fallback", F.lit(False))
    rest = ranked(plain.withColumn("score", F.round("score", digits)).drop("rank"), k).join(helped.select("query_id").distinct(), "query_id", "left_anti")
    return helped.unionByName(rest.withColumn("fallback", F.lit(True)))


def route(query: Column, rules: Mapping[str, str]) -> Column:
    """The source of the first rule whose words occur in the query; null if none does."""
    low = F.lower(query)
    return F.coalesce(*(F.when(F.contains(low, F.lit(words)), F.lit(source)) for words, source in rules.items()))


def source_filter(docs: DataFrame, part: str) -> DataFrame:
    """Documents whose source contains ``part``, whatever the case; pushed down to the scan's stage."""
    return docs.where(F.contains(F.lower("source"), F.lit(part.lower())))


def channel_overlap(hits: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """For each query how many of the k first ids two channels share, and how many only one has."""
    lists = hits.where((F.col("rank") <= k) & F.col("channel").isin(a, b)).groupBy("query_id").pivot("channel", [a, b]).agg(F.collect_set("doc_id"))
    empty = F.array().cast(lists.schema[a].dataType)
    left, right = F.coalesce(a, empty), F.coalesce(b, empty)
    return lists.select("query_id", F.size(F.array_intersect(left, right)).alias("shared"), F.size(F.array_except(left, right)).alias(f"only_{a}"), F.size(F.array_except(right, left)).alias(f"only_{b}"))
