"""Hybrid search: five channels, weighted by what each question asks for, fused, filtered and cut.

A collection is a handful of tables; a search is one plan over all questions at once.  Channels are ranked lists, so more
can be added to the union before fusion.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval


@dataclass(frozen=True)
class Collection:
    """``texts``: tables of doc_id, text, each with statistics of its own; ``vectors``, ``rows``, ``targeted``: doc_id,
    embedding, of passages, of rows of tables and of rows of chosen tables; ``cells``: table_id, col_name, cell_value;
    ``places``: doc_id, source, page of whatever may be found, with distinct ids."""

    texts: tuple[DataFrame, ...]
    vectors: DataFrame
    cells: DataFrame
    rows: DataFrame
    targeted: DataFrame
    places: DataFrame


#: An intent under FLOOR weighs nothing; the weights of the two channels for tables grow with it up to a cap.
FLOOR, STRUCTURED, STRUCTURED_MOST, TARGETED_MOST = 0.3, 1.5, 1.5, 1.0


def table_weights(queries: DataFrame, weights: Mapping[str, float], normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, intent, structured, targeted: how much each question asks for a table, and what its channels weigh."""
    intent = T.intent(F.col("text"), weights, normalise or (lambda a: a))
    asked = queries.select("query_id", F.round(intent, 6).alias("intent"))
    by = lambda factor, most: F.when(F.col("intent") < FLOOR, 0.0).otherwise(F.least(F.col("intent") * factor, F.lit(most)))
    return asked.select("query_id", "intent", by(STRUCTURED, STRUCTURED_MOST).alias("structured"), by(1.0, TARGETED_MOST).alias("targeted"))


def lexical(queries: DataFrame, texts: tuple[DataFrame, ...], k: int, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The k best of the k best of each table, by their scores as they are."""
    found = None
    for docs in texts:
        hits = retrieval.bm25(queries, docs, k, normalise=normalise).drop("rank", "channel")
        found = hits if found is None else found.unionByName(hits)
    return retrieval.ranked(found, k, channel="bm25")


def channels(queries: DataFrame, c: Collection, weights: DataFrame, k: int = 10, normalise: Callable[[Column], Column] | None = None, expand: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, channel, doc_id, rank, weight of all lists.  ``queries``: query_id, text, embedding (null: no vectors)."""
    told = queries.select("query_id", (expand(F.col("text")) if expand else F.col("text")).alias("text"))
    vectors = queries.where("embedding is not null").select("query_id", "embedding")
    for_tables = weights.where("intent > 0").select("query_id")
    lists = [
        retrieval.vector_topk(vectors, c.vectors, 2 * k),
        lexical(told, c.texts, 2 * k, normalise),
        retrieval.cell_search(queries.select("query_id", "text").join(for_tables, "query_id", "left_semi"), c.cells, 5),
        retrieval.vector_topk(vectors, c.rows, k).withColumn("channel", F.lit("rows")),
        retrieval.vector_topk(vectors.join(for_tables, "query_id", "left_semi"), c.targeted, k).withColumn("channel", F.lit("targeted")),
    ]
    union = None
    for hits in lists:
        hits = hits.select("query_id", "channel", "doc_id", "rank")
        union = hits if union is None else union.unionByName(hits)
    own = F.when(F.col("channel") == "structured", F.col("structured")).when(F.col("channel") == "targeted", F.col("targeted"))
    return union.join(weights, "query_id").select("query_id", "channel", "doc_id", "rank", own.alias("weight"))


def search(queries: DataFrame, c: Collection, intent: Mapping[str, float], intro: DataFrame, k: int = 10, least_score: float = 0.005, normalise: Callable[[Column], Column] | None = None, expand: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: fused, without the pages ``intro`` (source, page), cut at the largest gap.

    ``normalise`` makes what is compared of words, in texts, questions and ``intent`` alike; ``expand`` adds words to a
    question for the lexical channel.  A question without a vector has the lexical and the cell channel only."""
    hits = channels(queries, c, table_weights(queries, intent, normalise), k, normalise, expand)
    fused = retrieval.drop_pages(retrieval.fuse(hits), c.places, intro)
    return retrieval.adaptive_k(retrieval.ranked_again(fused), least_score, most=k).select("query_id", "doc_id", "score", "rank")
