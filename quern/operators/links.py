"""Joins that map questions, answers, tables and chunks to one another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval


def by_pages(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates: chunks on a page of the question whose source contains the question's source name.

    ``questions``: query_id, source_part, pages; ``chunks``: doc_id, source, page.  Names meet first, each once, on three
    letters in a row that both have; then questions meet the chunks of their sources' pages.  A name of fewer than three
    letters meets on what it has."""
    wanted = questions.select("query_id", T.fold(F.col("source_part")).alias("part"), F.explode(F.array_distinct("pages")).alias("page"))
    names = chunks.select("source").where("source is not null").distinct().withColumn("folded", T.fold(F.col("source")))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("folded")), lambda k: F.substring(F.col("folded"), k, F.lit(n)))
    heads = names.select("source", "folded", F.explode(F.array_distinct(F.concat(*(pieces(n) for n in (1, 2, 3)), F.array(F.lit(""))))).alias("head"))
    parts = wanted.select("part").distinct().withColumn("head", F.substring("part", 1, 3))
    met = parts.join(heads, "head").where(F.contains("folded", "part")).select("part", "source").distinct()
    return wanted.join(met, "part").join(chunks.select("doc_id", "source", "page"), ["source", "page"]).select("query_id", "doc_id").distinct()


def by_words(questions: DataFrame, chunks: DataFrame, least: float = 0.2, k: int = 5, digits: int = 6) -> DataFrame:
    """The k chunks that hold most of a question's words (at least a share ``least``).

    ``questions``: query_id, words (array); ``chunks``: doc_id, text.  Questions go to the chunks in bounded slices, so
    words that every chunk has make no large join."""
    asked = questions.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    words = chunks.select("doc_id", T.tokens(F.col("text")).alias("words"))
    return retrieval.word_shares(asked, words, k, digits).where(F.col("score") >= least).select("query_id", "doc_id", "score", "rank")


def by_article(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of a question's article: an equal number (100) before one that it is a prefix of (80), the longest
    number first.

    ``questions``: query_id, text; ``chunks``: doc_id, article_num.  Numbers meet on their first part."""
    head = lambda c: F.split(c, r"\.")[0]
    q = questions.select("query_id", F.explode(T.article_numbers(F.col("text"))).alias("number")).withColumn("head", head(F.col("number")))
    c = chunks.where("article_num is not null").select("doc_id", F.regexp_replace("article_num", r"\.$", "").alias("article")).withColumn("head", head(F.col("article")))
    met = q.join(c, "head").withColumn("score", F.when(F.col("article") == F.col("number"), 100).when(F.startswith(F.col("article"), F.concat("number", F.lit("."))), 80)).where("score is not null")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.length("number").desc(), "doc_id")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", "doc_id", "number", "score")


def article_document(c: Column, rules: Mapping[str, tuple[str, float]]) -> Column:
    """The document and confidence of the first pattern that the reference matches; null without one."""
    return F.coalesce(*(F.when(c.rlike(pattern), F.struct(F.lit(doc).alias("document"), F.lit(conf).alias("confidence"))) for pattern, (doc, conf) in rules.items()))


def additive_score(question_words: Column, question_text: Column, text: Column, section: Column) -> Column:
    """2 for each word the text contains, 5 for each number, 10 for each ``article N``, 3 if the section names a word."""
    low, numbers = T.fold(text), F.array_distinct(F.regexp_extract_all(question_text, F.lit(r"\b(\d+)\b"), F.lit(1)))
    hits = lambda xs, c: F.size(F.filter(xs, lambda x: F.contains(c, x)))
    articles = F.transform(T.article_numbers(question_text), lambda n: F.concat(F.lit("article "), n))
    named = F.exists(question_words, lambda w: F.contains(T.fold(F.coalesce(section, F.lit(""))), w))
    return 2 * hits(question_words, low) + 5 * hits(numbers, text) + 10 * hits(articles, low) + F.when(named, 3).otherwise(0)


def best_of(candidates: DataFrame, by: str = "query_id", score: str = "score", least: float | None = None) -> DataFrame:
    """The candidate of the highest score, the smaller doc_id of equal ones; none under ``least``."""
    rows = candidates if least is None else candidates.where(F.col(score) >= least)
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), "doc_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_phases(siblings: DataFrame, same_document: DataFrame, anywhere: DataFrame, enough: float = 0.8) -> DataFrame:
    """The best candidate: siblings (over 0), the same document (0.5 or more), and anywhere (0.7 or more) only for queries
    whose best so far is under ``enough``.  Of equal scores the earlier phase wins."""
    tagged = [p.select("query_id", "doc_id", "score", F.lit(n).alias("phase")) for n, p in enumerate((siblings.where("score > 0"), same_document.where("score >= 0.5"), anywhere.where("score >= 0.7")))]
    near = tagged[0].unionByName(tagged[1])
    satisfied = near.groupBy("query_id").agg(F.max("score").alias("s")).where(F.col("s") >= enough)
    rows = near.unionByName(tagged[2].join(satisfied, "query_id", "left_anti"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "phase", "doc_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_by_keys(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """``base`` with the first non-null value of each column from itself and the others, in order.

    Each of the others must have distinct keys."""
    out = base
    for n, other in enumerate(others):
        renamed = other.select(*keys, *(F.col(c).alias(f"_{n}_{c}") for c in other.columns if c not in keys))
        out = out.join(renamed, keys, "left")
        for c in other.columns:
            if c not in keys:
                out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{n}_{c}")) if c in out.columns else F.col(f"_{n}_{c}")).drop(f"_{n}_{c}")
    return out


def table_sections(summaries: DataFrame, tables: DataFrame, head: int = 80) -> DataFrame:
    """The section of each summary's table, by source and the first characters of its text; the last of several wins.

    ``summaries``: id, source, raw_table_text; ``tables``: source, raw_text, section, pos."""
    t = tables.groupBy("source", F.substring("raw_text", 1, head).alias("head")).agg(F.max_by("section", "pos").alias("section"))
    return summaries.withColumn("head", F.substring("raw_table_text", 1, head)).join(t, ["source", "head"], "left").drop("head")


def placeholders(docs: DataFrame) -> DataFrame:
    """table_no, doc_id of the first document that holds each table's placeholder.  ``docs``: doc_id, pos, text."""
    found = docs.select("doc_id", "pos", F.explode(F.regexp_extract_all("text", F.lit(r"<!-- TABLE_(\d+) -->"), F.lit(1))).alias("table_no"))
    return found.groupBy(F.col("table_no").cast("int").alias("table_no")).agg(F.min_by("doc_id", "pos").alias("doc_id"))


def full_score(words: DataFrame, articles: DataFrame, existing: DataFrame) -> DataFrame:
    """Pages by three kinds of evidence: 10 for each article hit, 5 times the word overlap, 3 if a chunk exists there.

    Each: query_id, page and articles, overlap; ``existing``: page."""
    both = articles.join(words, ["query_id", "page"], "full").join(existing.select("page", F.lit(3).alias("there")).distinct(), "page", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("query_id", "page", (10 * zero(F.col("articles")) + 5 * zero(F.col("overlap")) + zero(F.col("there"))).alias("score"))
