"""From ranked passages to the contexts that answer a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parent_contexts(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits on children grouped by parent.

    ``hits``: query_id, doc_id, score, rank; ``children``: id, parent_id, text, source, section, page; ``parents``: id,
    text, source, section, page, ids distinct in both.  A context has its parent's text, the best score, and the page of
    the parent or else of its best child with one.  Children of an empty or missing parent are contexts of their own.
    Contexts are ranked by score, then by their first hit."""
    child = children.select(F.col("id").alias("doc_id"), "parent_id", F.col("text").alias("c_text"), F.col("source").alias("c_source"), F.col("section").alias("c_section"), F.col("page").alias("c_page"))
    parent = parents.select(F.col("id").alias("parent_id"), F.col("text").alias("p_text"), F.col("source").alias("p_source"), F.col("section").alias("p_section"), F.col("page").alias("p_page"))
    found = hits.select("query_id", "doc_id", "score", "rank").join(child, "doc_id").join(parent, "parent_id", "left")
    full = F.length(F.trim(F.coalesce("p_text", F.lit("")))) > 0
    found = found.withColumn("kind", F.when(full, "parent").otherwise("child")).withColumn("context_id", F.when(full, F.col("parent_id")).otherwise(F.col("doc_id")))
    best_page = F.min_by(F.col("c_page"), F.when(F.col("c_page").isNotNull(), F.struct(-F.col("score"), F.col("rank"))))
    grouped = found.groupBy("query_id", "kind", "context_id").agg(
        F.max("score").alias("score"),
        F.min("rank").alias("first_rank"),
        F.count("*").alias("matched"),
        F.coalesce(F.first("p_page"), best_page).alias("page"),
        F.first(F.when(full, F.col("p_source")).otherwise(F.col("c_source"))).alias("source"),
        F.first(F.coalesce(F.when(full, F.col("p_section")).otherwise(F.col("c_section")), F.lit(""))).alias("section"),
        F.first(F.when(full, F.col("p_text")).otherwise(F.col("c_text"))).alias("text"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first_rank", "context_id")
    return grouped.withColumn("context_rank", F.row_number().over(w))


def table_contexts(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits on rows turned into hits on their tables, each table once, at its best rank.  ``rows``: doc_id, table_id."""
    w = Window.partitionBy("query_id", "table_id").orderBy("rank")
    return hits.join(rows, "doc_id").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def neighbour_tables(contexts: DataFrame, tables: DataFrame, budget: int = 500) -> DataFrame:
    """Tables on the page of a context or the pages beside it, within a budget of words for each query.

    ``contexts``: query_id, source, page, score; ``tables``: id, text, source, page.  A page holds one injected table:
    that of the smallest id.  Tables are taken by source and page; one that exceeds what is left is passed over, later
    smaller ones may still enter.  The score is half of the query's smallest."""
    around = contexts.where("page is not null").select("query_id", "source", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - 1), F.col("page") + 1)).alias("page")).distinct()
    lowest = contexts.groupBy("query_id").agg((F.min("score") / 2).alias("score"))
    one = tables.groupBy("source", "page").agg(F.min_by(F.struct("id", "text"), "id").alias("t")).select("source", "page", F.col("t.id").alias("id"), F.size(F.split(F.trim(F.col("t.text")), r"\s+")).alias("words"))
    near = around.join(one, ["source", "page"])
    ordered = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("source", "page", "id", "words"))).alias("found"))
    # a fold: what has been taken so far, and its words
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).alias("used"))
    taken = F.aggregate("found", start, lambda s, t: F.when(s["used"] + t["words"] <= budget, F.struct(F.concat(s["ids"], F.array(t["id"])).alias("ids"), (s["used"] + t["words"]).alias("used"))).otherwise(s))
    return ordered.select("query_id", F.posexplode(taken["ids"]).alias("position", "id")).join(lowest, "query_id")


def page_texts(children: DataFrame, order: str = "id", gap: str = "\n\n") -> DataFrame:
    """The texts of each (source, page) joined in order: what an oracle would read."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), gap)
    return children.where("page is not null and text is not null").groupBy("source", "page").agg(joined.alias("text"), F.count("*").alias("passages"))
