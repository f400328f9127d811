"""Coverage, review and selection of questions and passages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def reverse_synonyms(pairs: DataFrame) -> DataFrame:
    """word, terms: the terms that a word is a synonym of, in order.  ``pairs``: term, synonyms (array)."""
    each = pairs.select("term", F.explode("synonyms").alias("word"))
    return each.groupBy("word").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def expand_queries(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Queries with the synonyms of all terms that they contain, and the terms of all synonyms, appended in order.

    ``queries``: query_id, text; ``pairs``: pos, term, synonyms, a table small enough to be held whole (checked: at most
    10,000 terms).  Repetitions stay, as in a bag of words."""
    rows = pairs.orderBy("pos").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a table of synonyms holds at most 10,000 terms")
    low, empty = F.lower("text"), F.array().cast("array<string>")
    added = []
    for r in rows:
        many = F.array(*map(F.lit, r.synonyms)) if r.synonyms else empty
        added.append(F.when(F.contains(low, F.lit(r.term.lower())), many).otherwise(empty))
        back = [F.lit(s.lower()) for s in r.synonyms or []]
        if back:
            added.append(F.when(F.exists(F.array(*back), lambda s: F.contains(low, s)), F.array(F.lit(r.term))).otherwise(empty))
    return queries.withColumn("expanded", F.concat_ws(" ", "text", F.array_join(F.concat(*added), " ")) if added else F.col("text"))


def coverage(passages: DataFrame, covered: DataFrame, group: str) -> DataFrame:
    """passages and groups that are covered, and their shares.  ``passages``: doc_id, group; ``covered``: doc_id."""
    hit = covered.select("doc_id").distinct().withColumn("_c", F.lit(1))
    joined = passages.join(hit, "doc_id", "left")
    counts = joined.agg(F.count("*").alias("passages"), F.count("_c").alias("covered"), F.count_distinct(group).alias("groups"), F.count_distinct(F.when(F.col("_c") == 1, F.col(group))).alias("covered_groups"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return counts.select("*", share(F.col("covered"), F.col("passages")).alias("share"), share(F.col("covered_groups"), F.col("groups")).alias("group_share"))


def consolidated(batches: DataFrame, actions: Sequence[str] = ("DELETE", "FIX")) -> DataFrame:
    """Totals of review batches (keep, wrong, partial, and results as array of struct of id and action), the share kept
    and whether it is 95 % or more; ``open``: results that ask for an action."""
    wanted = F.size(F.filter("results", lambda r: r["action"].isin(list(actions))))
    sums = batches.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("keep", "wrong", "partial")), F.coalesce(F.sum(F.when(F.col("results").isNotNull(), wanted)), F.lit(0)).alias("open"))
    rate = F.round(F.coalesce(F.try_divide(100.0 * F.col("keep"), F.col("keep") + F.col("wrong") + F.col("partial")), F.lit(0.0)), 2)
    return sums.withColumn("rate", rate).withColumn("passed", F.col("rate") >= 95)


def substantive(passages: DataFrame, least_tokens: int = 50) -> DataFrame:
    """Passages of enough tokens that are neither a short heading nor a line of a table of contents."""
    text = F.trim("text")
    heading = text.rlike(r"^##") & (F.length(text) < 100)
    return passages.where((F.coalesce("tokens", F.lit(0)) >= least_tokens) & ~heading & ~text.rlike(r"\.{3,}\s*\d+$"))


def long_passages(c: Column, gap: str = r"\n\n", least: int = 20) -> Column:
    """The parts of a context with at least so many words."""
    return F.filter(F.split(c, gap), lambda p: F.size(F.split(F.trim(p), r"\s+")) >= least)


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, pos, heading, body: each heading's text up to the next; an empty one takes those of the deeper headings
    that follow it.  ``docs``: doc_id, text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)))
    w = Window.partitionBy("doc_id").orderBy("pos")
    numbered = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("section > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    own = numbered.groupBy("doc_id", "section").agg(F.max("level").alias("level"), F.min("pos").alias("pos"), F.max(F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#+\s*", "")))).alias("heading"), F.trim(body).alias("body"))
    a, b = own.alias("a"), own.alias("b")
    # an empty heading ends where one of its own level or above follows
    s = Window.partitionBy("doc_id").orderBy("section").rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list(F.struct("section", "level", "body")).over(s)
    following = own.withColumn("_later", F.when(F.col("body") == "", later))
    stop = F.coalesce(F.array_min(F.transform(F.filter("_later", lambda x: x["level"] <= F.col("level")), lambda x: x["section"])), F.lit(1 << 30))
    inherited = F.array_join(F.transform(F.filter("_later", lambda x: (x["section"] < stop) & (x["body"] != "")), lambda x: x["body"]), "\n")
    return following.select("doc_id", "pos", "heading", F.when(F.col("body") != "", F.col("body")).otherwise(F.coalesce(inherited, F.lit(""))).alias("body"))


def window_match(answer: Column, text: Column, size: int) -> Column:
    """Some ``size`` consecutive words of the text stand in the answer."""
    ws = T.tokens(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - size + 1, F.lit(1))), lambda k: F.array_join(F.slice(ws, k, size), " "))
    key = F.array_join(T.tokens(answer), " ")
    return F.coalesce((F.size(ws) >= size) & F.exists(runs, lambda r: F.contains(key, r)), F.lit(False))


def drift(hits: DataFrame, current: DataFrame, most: int = 5) -> DataFrame:
    """For each query the rank and score of its current passage among its hits, and the best one: ``moved`` if the
    current one isn't among the ``most`` first.  ``current``: query_id, doc_id."""
    mine = current.select("query_id", F.col("doc_id").alias("mine"))
    of = mine.join(hits, "query_id", "left").groupBy("query_id", "mine").agg(F.min(F.when(F.col("doc_id") == F.col("mine"), F.col("rank"))).alias("rank"), F.max(F.when(F.col("doc_id") == F.col("mine"), F.col("score"))).alias("score"), F.min_by("doc_id", "rank").alias("best"), F.max("score").alias("best_score"))
    return of.withColumn("moved", F.coalesce(F.col("rank") > most, F.lit(True)))


def pick_per_profile(candidates: DataFrame, profiles: Sequence[str], n: int) -> DataFrame:
    """``n`` candidates of each profile, each passage once over all: profiles take their turns in order, a passage goes
    to its first profile, and within it the best score wins.  ``candidates``: id, doc_id, profile, score."""
    place = F.array_position(F.array(*map(F.lit, profiles)), F.col("profile"))
    rows = candidates.withColumn("_p", place).where("_p > 0")
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("_p", F.col("score").desc(), "id"))).where("_n = 1")
    return one.withColumn("pick", F.row_number().over(Window.partitionBy("profile").orderBy(F.col("score").desc(), "id"))).where(F.col("pick") <= n).drop("_p", "_n")


def piecewise(rules: Mapping[str, tuple[Column, float]], most: float = 1.0) -> Column:
    """The sum of the weights of the rules that hold, at most ``most``; a null rule doesn't hold."""
    total = F.lit(0.0)
    for rule, weight in rules.values():
        total = total + F.when(F.coalesce(rule, F.lit(False)), weight).otherwise(0.0)
    return F.least(total, F.lit(most))


def diagnosis(grounded: Column, expected_class: Column, found_class: Column, overlap: Column) -> Column:
    """Why an answer failed: nothing to do, another class, the wrong passage, or too little context."""
    return F.when(grounded != "none", "ok").when(expected_class != found_class, "reclass").when(F.coalesce(overlap, F.lit(0.0)) < 0.2, "chunk").otherwise("context")


def multivector_tables(tables: DataFrame, summaries: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Parents (the whole tables) and children (their summaries) of tables with a summary and at least so many named
    columns.  ``tables``: id, headers, rows, source, page; ``summaries``: id, summary_text."""
    named = F.size(F.filter("headers", lambda h: F.trim(F.coalesce(h, F.lit(""))) != ""))
    kept = tables.where(named >= least).join(summaries.select("id", "summary_text"), "id").where(F.trim("summary_text") != "")
    parents = kept.select("id", T.table_text(F.col("headers"), F.col("rows")).alias("text"), "source", "page")
    return parents, kept.select(F.concat("id", F.lit("-summary")).alias("id"), F.col("id").alias("parent_id"), F.col("summary_text").alias("text"), "source", "page")
