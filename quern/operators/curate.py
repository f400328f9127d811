"""Cleaning, sampling, splitting and building datasets.

Random choices are ordered by a hash of a seed and the key, so they are the same on every run and partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Values of ``draw``, and the ranges of them that places are counted in; one row for each is broadcast at most.
DRAWS, RANGES = 1 << 60, 1 << 16


def draw(*keys: Column, seed: int = 42) -> Column:
    """A whole number from 0 to 2^60 - 1 that depends on the seed and the keys only: the first digits of an MD5, which
    other engines have as well."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lot(*keys: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    return draw(*keys, seed=seed) / F.lit(float(DRAWS))


def placed(df: DataFrame, key: str, seed: int = 42, size: Column | None = None) -> DataFrame:
    """``_place``: how many rows (or how much ``size``) come before the row in the order of draws, then keys; ``_all``: the
    total.

    Counts of ranges of draws give where each range begins, so no task orders all rows."""
    rows = df.withColumn("_draw", draw(F.col(key), seed=seed)).withColumn("_size", F.lit(1).cast("long") if size is None else size.cast("long"))
    rows = rows.withColumn("_range", F.shiftright("_draw", 44))
    counts = rows.groupBy("_range").agg(F.sum("_size").alias("_c"))
    begins = counts.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    within = Window.partitionBy("_range").orderBy("_draw", key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(begins), "_range").withColumn("_place", F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return out.drop("_range", "_before", "_size")


def exact_duplicates(df: DataFrame, c: Column) -> DataFrame:
    """groups of equal values, the rows beyond the first of each, and their share; nulls aside."""
    groups = df.where(c.isNotNull()).groupBy(F.md5(c).alias("h")).agg(F.count("*").alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.round(F.coalesce(F.sum(F.col("n") - 1) / F.sum("n"), F.lit(0.0)), 6).alias("rate"))


def first_by_priority(df: DataFrame, c: Column, *order: Column) -> DataFrame:
    """One row of each value of ``c``: the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(c).orderBy(*order))).where("_n = 1").drop("_n")


def greedy_unique(df: DataFrame, edges: DataFrame, key: str, checkpoint: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Rows in the order of their keys, without those that a kept earlier one is linked to.

    ``edges``: a, b with a < b.  A removed row removes none.  Each round settles every row whose earlier neighbours are
    settled: one with a kept neighbour goes, one whose neighbours are all gone stays.  The first open row of a group always
    settles, so it ends; the rounds needed are the longest chain of rows that wait for one another."""
    edges = checkpoint(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("k")).unionByName(edges.select(F.col("b").alias("k"))).distinct()
    state = checkpoint(nodes.withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        before = edges.join(state.select(F.col("k").alias("a"), F.col("kept").alias("a_kept")), "a").groupBy(F.col("b").alias("k")).agg(F.bool_or(F.coalesce("a_kept", F.lit(False))).alias("hit"), F.bool_or(F.col("a_kept").isNull()).alias("open"))
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = checkpoint(state.join(before, "k", "left").select("k", settled.alias("kept")))
        if state.where("kept is null").limit(1).count() == 0:
            return df.join(state.where("not kept").select(F.col("k").alias(key)), key, "left_anti")


def similar_pairs(df: DataFrame, key: str, embedding: str, least: float, block: int = 8192) -> DataFrame:
    """a, b, cosine of the pairs of cosine ``least`` or more, a < b, exactly.

    Rows are spread over blocks; each pair of blocks is one task's matrix product.  Work is quadratic: for large
    collections find candidates by an index first."""
    import numpy as np

    rows = df.where(F.size(embedding) > 0).select(F.col(key).alias("k"), F.col(embedding).alias("v"))
    blocks = max(1, -(-rows.count() // block))
    kind = df.schema[key].dataType.simpleString()
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    # a block meets itself and every other one once, in the task named after both
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("k", "v", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        low, high = part["low"].iloc[0], part["high"].iloc[0]
        left, right = part[part["own"] == low], part[part["own"] == high]
        unit = []
        for side in (left, right):
            m = np.stack(side["v"].to_numpy()).astype(np.float64) if len(side) else np.zeros((0, 1))
            n = np.linalg.norm(m, axis=1, keepdims=True)
            unit.append(m / np.where(n > 0, n, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": part["k"].dtype, "b": part["k"].dtype})
        out = []
        a, b = left["k"].to_numpy(), right["k"].to_numpy()
        for at in range(0, len(a), 1024):
            s = unit[0][at : at + 1024] @ unit[1].T
            i, j = np.nonzero(s >= least)
            x, y = a[at + i], b[j]
            keep = x < y if low == high else x != y
            x, y, s = x[keep], y[keep], s[i[keep], j[keep]]
            out.append(pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "cosine": s}))
        return pd.concat(out)

    return spread.groupBy("low", "high").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")


def stratified(df: DataFrame, by: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """About ``total`` rows, from each stratum its share of them but one at least, then cut to ``total``."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_c"))
    everything = sizes.agg(F.sum("_c").alias("_t"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("_c") / F.col("_t")))
    order = Window.partitionBy(by).orderBy(lot(F.col(key), seed=seed), key)
    picked = df.withColumn("_n", F.row_number().over(order)).join(sizes.join(F.broadcast(everything)).select(F.col(by).alias("_s"), quota.alias("_q")), F.col(by).eqNullSafe(F.col("_s"))).where("_n <= _q")
    return picked.orderBy("_n", lot(F.col(key), seed=seed), key).limit(total).select(*df.columns)


def quotas(strata: DataFrame, total: int, shares: Mapping[str, float], least: int = 5, cap: float = 0.5) -> DataFrame:
    """stratum, quota: a class's share of ``total`` spread over its strata by size, between ``least`` and the stratum's
    size times ``cap``.  ``strata``: stratum, class, n."""
    table = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))
    share = F.coalesce(F.try_element_at(table, F.col("class")), F.lit(0.0))
    part = F.col("n") / F.sum("n").over(Window.partitionBy("class"))
    quota = F.least(F.greatest(F.floor(total * share * part), F.lit(least)), F.floor(F.col("n") * cap))
    return strata.select("stratum", "class", "n", quota.cast("long").alias("quota"))


def round_robin(df: DataFrame, stratum: str, group: str, order: list[Column], quota: int) -> DataFrame:
    """From each stratum ``quota`` rows, one of each group in turn."""
    # more than ``quota`` of one group are never picked, so both ranks are cut before they are shuffled
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum, group).orderBy(*order))).where(F.col("turn") <= quota)
    return turn.withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy("turn", group))).where(F.col("pick") <= quota)


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``part``: train for exactly int(n * share) rows, drawn by lot, else val."""
    cut = F.floor(F.col("_all") * F.lit(share))
    return placed(df, key, seed).withColumn("part", F.when(F.col("_place") < cut, "train").otherwise("val")).drop("_draw", "_place", "_all")


def hold_out(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """``part``: eval for the rows of some sources, else train."""
    return df.withColumn("part", F.when(F.col(column).isin(list(values)), "eval").otherwise("train"))


def modes(c: Column, shares: Mapping[str, float], seed: int = 42) -> Column:
    """A mode for each key, drawn by lot in these shares; the last takes the rest."""
    out, upto = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        upto = sum(v for k, v in list(shares.items())[: list(shares).index(name) + 1])
        out = F.when(lot(c, seed=seed) < upto, name).otherwise(out)
    return out


def negatives(questions: DataFrame, passages: DataFrame, n: int = 1, seed: int = 42, page_gap: int | None = None, checkpoint: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """For each question ``n`` passages drawn by lot that aren't on its page (or within ``page_gap`` pages of it).

    ``questions``: query_id, source, page; ``passages``: doc_id, source, page.  Passages lie on a ring in the order of their
    lots; a question takes the first that qualify from a place of its own on.  It looks at a few places; questions that
    found fewer than ``n`` look at twice as many, until all have theirs or have seen the whole ring, so a question has
    fewer than ``n`` only where fewer qualify."""
    ring = checkpoint(placed(passages.select("doc_id", "source", "page"), "doc_id", seed).drop("_draw", "_all"))
    size = ring.count()
    asked = questions.select("query_id", F.col("source").alias("q_source"), F.col("page").alias("q_page"), F.pmod(draw(F.col("query_id"), seed=seed), F.lit(max(size, 1))).alias("_at"))
    off = ~F.col("source").eqNullSafe(F.col("q_source")) | F.coalesce(F.abs(F.col("page") - F.col("q_page")) > (page_gap or 0), F.lit(True))
    first = Window.partitionBy("query_id").orderBy("_step")
    look, done = min(size, n + 4), None
    while True:
        steps = asked.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(max(look - 1, 0))))).withColumn("_place", F.pmod(F.col("_at") + F.col("_step"), F.lit(max(size, 1))))
        found = steps.join(ring, "_place").where(off).withColumn("draw", F.row_number().over(first)).where(F.col("draw") <= n).select("query_id", "doc_id", "draw")
        if look < size:
            found = checkpoint(found)
            full = found.where(F.col("draw") == n).select("query_id")
            found, asked = found.join(full, "query_id", "left_semi"), checkpoint(asked.join(full, "query_id", "left_anti"))
        done = found if done is None else done.unionByName(found)
        if look >= size or not asked.limit(1).count():
            return done
        look = min(size, 2 * look)


def hard_negatives(hits: DataFrame, positives: DataFrame, low: float, high: float, page_gap: int = 2) -> DataFrame:
    """For each query its best hit with a score between ``low`` and ``high`` that lies off the positive's page, else its
    best one up to ``high``.

    ``hits``: query_id, doc_id, score, source, page; ``positives``: query_id, source, page."""
    p = positives.select("query_id", F.col("source").alias("p_source"), F.col("page").alias("p_page"))
    off = (F.col("source") != F.col("p_source")) | (F.abs(F.col("page") - F.col("p_page")) > page_gap)
    found = hits.join(p, "query_id").where(off & (F.col("score") <= high)).withColumn("in_window", F.col("score") >= low)
    w = Window.partitionBy("query_id").orderBy(F.col("in_window").desc(), F.col("score").desc(), "doc_id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", "doc_id", "score", "in_window")


def cloze_pairs(passages: DataFrame, mask: float = 0.9, seed: int = 42, least: int = 20) -> DataFrame:
    """query, passage: a sentence drawn by lot, and its passage with the sentence masked in a share ``mask`` of the rows.

    ``passages``: doc_id, text.  Passages of fewer than two sentences give none."""
    found = passages.withColumn("s", T.sentences(F.col("text"), least)).where(F.size("s") >= 2)
    pick = F.element_at("s", (F.pmod(draw(F.col("doc_id"), seed=seed), F.size("s")) + 1).cast("int"))
    drawn = found.withColumn("query", pick)
    masked = F.trim(F.regexp_replace(F.replace("text", "query", F.lit("")), r"[^\S\n]{2,}", " "))
    return drawn.select("doc_id", "query", F.when(lot(F.col("doc_id"), F.lit("mask"), seed=seed) < mask, masked).otherwise(F.col("text")).alias("passage"))


def identical_pairs(passages: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, query, passage: each text of ``least`` characters with itself, as contrastive training by dropout wants it."""
    said = F.trim("text")
    return passages.where(F.length(said) >= least).select("doc_id", said.alias("query"), said.alias("passage"))


def require_share(made: DataFrame, of: DataFrame, most_skipped: float = 0.3) -> DataFrame:
    """``made``, unless more than a share of the rows of ``of`` gave none; an empty table skips nothing."""
    total, kept = of.count(), made.count()
    if total and (total - kept) / total > most_skipped:
        raise ValueError(f"{total - kept} of {total} rows skipped, more than {most_skipped:.0%}")
    return made


def testable(questions: DataFrame, letter: str = "ans", history: str = "notes", word: str = "retiré") -> DataFrame:
    """Questions with a letter A to F whose history doesn't tell that they were withdrawn."""
    return questions.where(F.upper(F.trim(F.col(letter))).rlike("^[A-F]$") & ~F.contains(F.lower(F.coalesce(F.col(history), F.lit(""))), F.lit(word)))


def by_origin(questions: DataFrame, prefixes: Sequence[str], source: str | None = None) -> DataFrame:
    """Questions whose id begins with one of the prefixes or, with ``source``, whose source is known."""
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.startswith("id", F.lit(p))
    return questions.where(starts | F.col(source).isNotNull() if source else starts)


def batches(df: DataFrame, key: str, size: int = 40, most: int = 5) -> DataFrame:
    """Review batches in the order of the keys, which are distinct: slices of ``size``, the last of ``most`` takes the rest.

    Only the rows of the other slices, ``size * (most - 1)``, are put in order."""
    first = df.select(key).orderBy(key).limit(size * (most - 1)).withColumn("_n", F.row_number().over(Window.orderBy(key)))
    joined = df.join(F.broadcast(first), key, "left")
    return joined.withColumn("batch", F.coalesce(F.floor((F.col("_n") - 1) / size), F.lit(most - 1)).cast("int")).drop("_n")


def keyword_counts(docs: DataFrame, stop: Sequence[str], n: int = 8, least: int = 4) -> DataFrame:
    """doc_id, word, count, rank: the most frequent words; of equal counts the one that comes first."""
    words = docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word")).where((F.length("word") >= least) & ~F.col("word").isin(list(stop)))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.col("count").desc(), "first")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("doc_id", "word", "count", "rank")


def connectors(docs: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """doc_id, kind, sentence: for each paragraph and kind of connector the first sentence with one."""
    parts = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph", "p")).withColumn("s", T.sentences(F.col("p")))

    def first(pattern: str) -> Column:  # a second argument of the lambda would be the sentence's index
        return F.get(F.filter("s", lambda x: x.rlike(pattern)), 0)

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), first(p).alias("sentence")) for k, p in kinds.items()))).alias("x")
    return parts.select("doc_id", "paragraph", each).select("doc_id", "paragraph", "x.*").where("sentence is not null")


def around(docs: DataFrame, pattern: str, radius: int = 2) -> DataFrame:
    """doc_id, pos, sentence: sentences within ``radius`` of one that matches; repeated ones once, where they come first."""
    s = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    near = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-radius, radius)
    kept = s.withColumn("near", F.max(F.col("sentence").rlike(pattern).cast("int")).over(near)).where("near = 1")
    first = Window.partitionBy("doc_id", "sentence").orderBy("pos")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", "pos", "sentence")


def fixed_length(docs: DataFrame, key: str, size: str, length: int) -> DataFrame:
    """Sequence packing: items laid end to end in the order of their lots, each followed by one separator, cut every
    ``length``; the tail is dropped.

    key, sequence, at (place within it), n (units that lie in it)."""
    start = placed(docs.select(F.col(key).alias("key"), (F.col(size) + 1).cast("long").alias("n")), "key", size=F.col("n")).withColumnRenamed("_place", "start")
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)
    cut = start.withColumn("sequence", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("sequence") * length)
    end = F.least(F.col("start") + F.col("n"), (F.col("sequence") + 1) * length)
    return cut.where((F.col("sequence") + 1) * length <= F.col("_all")).select(F.col("key").alias(key), "sequence", (begin - F.col("sequence") * length).alias("at"), (end - begin).alias("n"))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it hasn't."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))
