"""The queries of this subpackage: name -> (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, ship
from . import leaks, packing, pairs, pieces, spam, tokens, truncation, vectors
from .tables import p1_values, p4_vectors, p5_items, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """tbl, id, field of the cut values."""
    ship(spark)
    return truncation.cut_values(p1_values(spark, folder), checkpoint=checkpoint).select("key.tbl", "key.id", "key.field")


def p1_signs(spark: SparkSession, folder: str) -> DataFrame:
    """How many values each set of signs tells."""
    ship(spark)
    cut = truncation.cut_values(p1_values(spark, folder), checkpoint=checkpoint)
    return cut.groupBy("key.tbl", "key.field", F.array_join("signs", "+").alias("signs")).agg(F.count("*").alias("cut_values"))


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """For each source and field the number of ids with a value, how many are cut, and their share."""
    ship(spark)
    values = p1_values(spark, folder)
    cut = truncation.cut_values(values, checkpoint=checkpoint).select("key", F.lit(1).alias("cut"))
    of = values.where("key is not null").select("key", "source").join(cut, "key", "left")
    return of.groupBy("key.tbl", "key.field", "source").agg(F.count("*").alias("ids"), F.count("cut").alias("cut_ids"), F.round(F.count("cut") / F.count("*"), 6).alias("cut_share"))


CHILD_LIMIT, PARENT_LIMIT, OVERLAP = 450, 2048, 50


def _p2_pieces(spark: SparkSession, folder: str, oversized: bool, texts: bool) -> DataFrame:
    ship(spark)
    parts = []
    for name, limit in (("children", CHILD_LIMIT), ("parents", PARENT_LIMIT)):
        cut = pieces.split(table(spark, folder, name), "id", "text", limit, OVERLAP, oversized, texts)
        parts.append(cut.select(F.lit(name).alias("tbl"), *cut.columns))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """tbl, id of the items that come out in more than one piece."""
    return _p2_pieces(spark, folder, True, False).where("piece = 1").select("tbl", "id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized items, in order."""
    return _p2_pieces(spark, folder, True, True).dropDuplicates(["tbl", "id", "piece"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """id, defect of the defective pairs."""
    ship(spark)
    human = table(spark, folder, "human_eval_34q").select("id", F.col("question"), F.col("response_preview").alias("response")).dropDuplicates(["id"])
    values = p1_values(spark, folder).withColumn("key", F.when(F.col("kind") == "response_preview", F.col("key.id")))
    return pairs.defects(human, values, checkpoint=checkpoint, kinds=["response_preview"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """id_a, id_b of the pairs of cosine 0.92 or more of which one is among the 10 most similar of the other."""
    ship(spark)
    near = vectors.neighbours(p4_vectors(spark, folder), 10, 0.92)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """id, other, rank: the 10 most similar other ids of every id whose number is divisible by 100, against all rows."""
    ship(spark)
    asks = F.regexp_extract("id", r"([0-9]{1,18})$", 1).try_cast("long") % 100 == 0
    return vectors.neighbours(p4_vectors(spark, folder), 10, queries=asks).select("id", "other", "rank")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id of the documents that contain a passage of a held-out item."""
    ship(spark)
    return leaks.leaks(table(spark, folder, "documents").select("doc_id", "text"), p5_items(spark, folder), checkpoint=checkpoint)


def p5_items_leaked(spark: SparkSession, folder: str) -> DataFrame:
    """For each leaked item in how many documents it stands."""
    return p5_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of each document."""
    ship(spark)
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p6_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids and the character at which each token starts."""
    ship(spark)
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text", offsets=True)


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, number of ids, and whether the decoded ids equal the text (null as empty)."""
    ship(spark)
    return tokens.round_trip(table(spark, folder, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """container, doc_id, part, first_token, n_tokens: every non-empty document in containers of 2,048 tokens."""
    ship(spark)
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text", checkpoint=checkpoint).drop("nearness")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens, and the share of the space that is used."""
    used = p7_containers(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count("*") * F.lit(packing.CAPACITY)), 6).alias("used"))


def p7_nearness(spark: SparkSession, folder: str) -> DataFrame:
    """How near items are to the seed of their container, as a share of its BM25 score for itself: by content, and with
    items sharded by chance and all else equal."""
    ship(spark)
    out = None
    for name, by_content in (("content", True), ("chance", False)):
        boxes = packing.pack(table(spark, folder, "documents"), "doc_id", "text", checkpoint=checkpoint, by_content=by_content)
        row = boxes.agg(F.lit(name).alias("shards"), F.count("nearness").alias("items"), F.round(F.avg("nearness"), 4).alias("nearness"), F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
        out = row if out is None else out.unionByName(row)
    return out


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of the documents of which more than half is spam."""
    ship(spark)
    return spam.spam_pages(table(spark, folder, "documents"), "doc_id", "text", checkpoint).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_signs, p2_found, p2_pieces, p3_found, p4_found, p4_neighbours, p5_found, p5_items_leaked, p6_ids, p6_offsets, p6_decoded, p7_containers, p7_fill, p7_nearness, p8_found)}

#: The words of a text in SQL, and its runs of 13 of them.
_WORDS = r"list_filter(regexp_split_to_array(strip_accents(lower(regexp_replace(text, '([\p{L}\p{N}\p{M}])[-\x{2010}\x{AD}][\t\v\f\p{Zs}]*(?:\r\n|\n|\r|\x{2028})[\t\v\f\p{Zs}]*([\p{L}\p{N}])', '\1\2', 'g'))), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_RUNS = "unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i + 12], ' ')))"

#: A token of p2 in SQL; white space as Python sees it.
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{Z}\t-\r\x1c-\x20\x{85}]"

ORACLES = {
    "p2_found": f"select distinct tbl, id from (select 'children' as tbl, id, text, {CHILD_LIMIT} as most from children union all select 'parents', id, text, {PARENT_LIMIT} from parents) where len(regexp_extract_all(text, '{_TOKEN}')) > most",
    "p4_found": "with v as (select id, any_value(embedding)::double[] as e from (select id, embedding from children union all select id, embedding from table_summaries) where len(embedding) = 64 group by id), n as (select id, e, sqrt(list_dot_product(e, e)) as n from v where list_dot_product(e, e) > 0), p as (select a.id as a, b.id as b, list_dot_product(a.e, b.e) / (a.n * b.n) as c from n a, n b where a.id <> b.id), r as (select a, b, row_number() over (partition by a order by c desc, b) as r from p where c >= 0.92) select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where r <= 10",
    "p4_neighbours": "with v as (select id, any_value(embedding)::double[] as e from (select id, embedding from children union all select id, embedding from table_summaries) where len(embedding) = 64 group by id), n as (select id, e, sqrt(list_dot_product(e, e)) as n from v where list_dot_product(e, e) > 0), p as (select a.id, b.id as other, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) as c from n a, n b where a.id <> b.id and try_cast(regexp_extract(a.id, '([0-9]{1,18})$', 1) as bigint) % 100 = 0), r as (select id, other, row_number() over (partition by id order by c desc, other) as rank from p) select id, other, rank from r where rank <= 10",
    "p5_found": f"with i as (select item_id, {_WORDS} as w from (select id as item_id, question as text from audit_sample_review union select id, text from jun2023_uvo) where text is not null), d as (select doc_id, {_WORDS} as w from documents where text is not null), x as (select distinct item_id, {_RUNS} as run from i), y as (select distinct doc_id, {_RUNS} as run from d) select distinct doc_id, item_id from x join y using (run)",
}
