"""Retrieval and answer metrics, by segment in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difficulty_band(c: Column, low: float = 0.33, high: float = 0.66) -> Column:
    """easy under ``low``, medium under ``high``, else hard; unknown for null."""
    return F.when(c < low, "easy").when(c < high, "medium").when(c.isNotNull(), "hard").otherwise("unknown")


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id and the rank of its first relevant result, 0 without one.

    ``results``: query_id, rank, source, page; ``expected``: query_id, source, page; a query is what ``expected`` names."""
    found = results.join(expected.distinct(), ["query_id", "source", "page"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"))


def recall(ranks: DataFrame, segments: list[str] | None = None, at: tuple[int, ...] = (1, 3, 5, 10), digits: int = 6) -> DataFrame:
    """Recall at each k and mean reciprocal rank, over all queries and by each of the segments.

    ``ranks``: query_id, rank (0: nothing relevant), segments.  Grouping sets: one pass, not one for each segment.
    Without queries there is one row of zeros."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    measures = [mean(((F.col("rank") > 0) & (F.col("rank") <= k)).cast("double")).alias(f"recall_{k}") for k in at]
    measures += [mean(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.count("*").alias("n")]
    if not segments:
        return ranks.agg(*measures)
    cols = [F.col(s) for s in segments]
    grouped = ranks.groupingSets([[], *([c] for c in cols)], *cols).agg(F.grouping_id().alias("_g"), *measures)
    full = (1 << len(segments)) - 1
    name = F.when(F.col("_g") == full, "all")
    value = F.when(F.col("_g") == full, "all")
    for n, s in enumerate(segments):
        mine = F.col("_g") == full - (1 << (len(segments) - 1 - n))
        name, value = name.when(mine, s), value.when(mine, F.coalesce(F.col(s).cast("string"), F.lit("null")))
    return grouped.select(name.alias("segment"), value.alias("value"), *[f"recall_{k}" for k in at], "mrr", "n")


def tolerant_recall(results: DataFrame, expected: DataFrame, k: int = 5, tolerance: int = 0) -> DataFrame:
    """For each query the share of its expected pages that one of the k first results comes within ``tolerance`` of.

    Expected pages are spread over the tolerance, so pages meet in an equi-join.  Queries of no page have the recall 1."""
    wanted = expected.select("query_id", "source", F.col("page").alias("want")).distinct()
    spread = wanted.where("want is not null").withColumn("page", F.explode(F.sequence(F.col("want") - tolerance, F.col("want") + tolerance)))
    met = results.where(F.col("rank") <= k).select("query_id", "source", "page").distinct().join(spread, ["query_id", "source", "page"]).select("query_id", "source", "want").distinct()
    hit = met.groupBy("query_id").agg(F.count("*").alias("met"))
    of = wanted.groupBy("query_id").agg(F.count("want").alias("wanted"))
    return of.join(hit, "query_id", "left").select("query_id", F.when(F.col("wanted") == 0, 1.0).otherwise(F.coalesce("met", F.lit(0)) / F.col("wanted")).alias("recall"))


def prediction_powered(gold: DataFrame, rest: DataFrame, z: float = 1.96, digits: int = 6) -> DataFrame:
    """Mean and confidence interval from few labels and many predictions: mean of the predictions on ``rest`` less their
    mean error on ``gold`` (columns label and predicted), kept within 0 and 1."""
    a = gold.agg(F.avg(F.col("predicted") - F.col("label")).alias("bias"), F.var_samp(F.col("predicted") - F.col("label")).alias("v1"), F.count("*").alias("n1"))
    b = rest.agg(F.avg("predicted").alias("mean"), F.var_samp("predicted").alias("v2"), F.count("*").alias("n2"))
    both = a.join(F.broadcast(b)).withColumn("theta", F.col("mean") - F.col("bias"))
    half = z * F.sqrt(F.coalesce(F.col("v1"), F.lit(0.0)) / F.col("n1") + F.coalesce(F.col("v2"), F.lit(0.0)) / F.col("n2"))
    clip = lambda c: F.when(c.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), digits))
    return both.select(clip(F.col("theta")).alias("theta"), clip(F.col("theta") - half).alias("low"), clip(F.col("theta") + half).alias("high"), "n1", "n2")


def agreement(df: DataFrame, a: str, b: str, digits: int = 4) -> DataFrame:
    """Raw agreement, Cohen's kappa and Gwet's AC1 of two boolean raters; rows with a null don't count.

    Chance agreement of 1 makes kappa 0."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"), F.count("*").alias("n"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    mean = (F.col("pa") + F.col("pb")) / 2
    pg = 2 * mean * (1 - mean)
    return base.select("n", F.round("po", digits).alias("raw"), F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).otherwise(0.0), digits).alias("kappa"), F.round((F.col("po") - pg) / (1 - pg), digits).alias("ac1"))


def entropy(df: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """Shannon entropy of a column's values over its greatest: 1 with one value or less, 0 without rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    out = counts.join(F.broadcast(total)).agg(F.sum(-p * F.log2(p)).alias("h"), F.count("*").alias("n"))
    return out.select(F.col("n").alias("classes"), F.round(F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(F.col("h") / F.log2("n")), digits).alias("entropy"))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, known, total, squares, mean, least, most of each group; nulls aren't known.

    Sums are those of decimals of six places, so the order of addition doesn't matter; variance is squares / known - mean²."""
    exact = F.col(value).cast("decimal(18,6)")
    sums = df.groupBy(by).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.sum(exact).cast("double").alias("total"), F.sum((exact * exact).cast("decimal(28,12)")).cast("double").alias("squares"), F.min(value).alias("least"), F.max(value).alias("most"))
    return sums.select(by, "n", "known", "total", "squares", F.try_divide("total", "known").alias("mean"), "least", "most")


def length_stats(df: DataFrame, length: str, over: tuple[int, ...] = ()) -> DataFrame:
    """min, median (cut to an integer), max and p95 (the value at place 0.95 n of the sorted ones), and counts over
    thresholds.  p95 comes from counts by value, not from one sorted list."""
    from pyspark.sql import Window

    counts = df.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("v")).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    # the element at place k (from 0) is the least value with more than k up to it
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    n = F.col("n")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return run.agg(F.max("n").alias("n"), F.min("v").alias("least"), F.floor(middle).cast("long").alias("median"), F.max("v").alias("most"), at(F.floor(n * 0.95)).alias("p95"), *(F.coalesce(F.sum(F.when(F.col("v") > t, F.col("c"))), F.lit(0)).alias(f"over_{t}") for t in over))


def perplexity(df: DataFrame, loss: str, tokens: str, digits: int = 6) -> DataFrame:
    """exp of the mean loss by token, at most exp(20); rows whose loss isn't finite are left out."""
    good = df.where(~F.isnan(loss) & (F.abs(loss) != float("inf")))
    return good.agg(F.round(F.exp(F.least(F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens), F.lit(20.0))), digits).alias("perplexity"))
