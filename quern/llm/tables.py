"""The input tables of the queries, and small helpers that all of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values that may be cut, one for each id and field, and with a null key the texts around them.

    Kinds: ``text`` for questions, ``choices.A`` for all choices, ``response_preview`` for answers and explanations."""
    uvo = table(spark, folder, "jun2023_uvo").select("id", "source", "text", "choices", "explanation").withColumn("a", F.col("choices")["A"]).withColumn("rest", F.map_values(F.map_filter("choices", lambda k, _: k != "A")))
    uvo = uvo.drop("choices").dropDuplicates(["id"])
    human = table(spark, folder, "human_eval_34q").select("id", "source", "question", "response_preview").dropDuplicates(["id"])
    fields = F.explode(F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("t")), F.struct(F.lit("choices.A").alias("kind"), F.col("a").alias("t"))))
    first = uvo.select("id", "source", fields.alias("f")).select(F.struct(F.lit("jun2023_uvo").alias("tbl"), "id", F.col("f.kind").alias("field")).alias("key"), F.col("f.kind").alias("kind"), "source", F.col("f.t").alias("text"))
    second = human.select(F.struct(F.lit("human_eval_34q").alias("tbl"), "id", F.lit("response_preview").alias("field")).alias("key"), F.lit("response_preview").alias("kind"), "source", F.col("response_preview").alias("text"))
    around = uvo.select(F.lit("choices.A").alias("kind"), F.explode("rest").alias("text"))
    around = around.unionByName(uvo.select(F.lit("response_preview").alias("kind"), F.col("explanation").alias("text")))
    around = around.unionByName(human.select(F.lit("text").alias("kind"), F.col("question").alias("text")))
    values = first.unionByName(second)
    nothing = F.lit(None).cast(values.schema["key"].dataType)
    return values.unionByName(around.select(nothing.alias("key"), "kind", F.lit(None).cast("string").alias("source"), "text")).where("text is not null")


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """The held-out items by id; a redelivered row comes with equal content."""
    audit = table(spark, folder, "audit_sample_review").select(F.col("id").alias("item_id"), F.col("question").alias("text"))
    uvo = table(spark, folder, "jun2023_uvo").select(F.col("id").alias("item_id"), "text")
    return audit.unionByName(uvo).where("text is not null")


def p4_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of both tables, which share one space."""
    return table(spark, folder, "children").select("id", "embedding").unionByName(table(spark, folder, "table_summaries").select("id", "embedding"))
