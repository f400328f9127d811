"""Writing collections and datasets in the formats that evaluation tools read.  The shapes are DataFrames of their own,
so they can be queried; write() puts any of them on disk."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, kind: str = "json", mode: str = "overwrite", by: tuple[str, ...] = (), **options) -> None:
    """Parquet, JSON lines or tab-separated text (with a header)."""
    writer = df.write.mode(mode).options(**options)
    if by:
        writer = writer.partitionBy(*by)
    if kind == "tsv":
        writer.option("sep", "\t").option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def store(tables: dict[str, DataFrame], folder: str) -> None:
    """A collection: one Parquet table for each name, rebuilt; cells are laid out by column name for their lookups."""
    for name, df in tables.items():
        write(df, f"{folder}/{name}", "parquet", by=("col_name",) if name == "structured_cells" else ())


def upserted(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of their keys.

    Of several new rows with a key the first by ``order`` stays; without an order they must have distinct keys."""
    rows = _ordered(new, key, *order) if order else new
    return old.join(rows.select(key), key, "left_anti").unionByName(rows.select(*old.columns))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't written yet, by key: right even if earlier items failed."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def _ordered(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def beir(triplets: DataFrame) -> dict[str, DataFrame]:
    """corpus, queries and qrels of triplets (pos, query_id, anchor, doc_id, title, positive).

    The first triplet with a document gives its text, the last one with a query its text; only positives are judged."""
    corpus = _ordered(triplets, "doc_id", F.col("pos")).select(F.col("doc_id").alias("_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("positive").alias("text"))
    queries = _ordered(triplets, "query_id", F.col("pos").desc()).select(F.col("query_id").alias("_id"), F.col("anchor").alias("text"))
    qrels = triplets.select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.lit(1).alias("score")).distinct()
    return {"corpus": corpus, "queries": queries, "qrels": qrels}


def dangling(files: dict[str, DataFrame]) -> DataFrame:
    """side, n: judgements whose query or document is missing."""
    q, c, r = files["queries"], files["corpus"], files["qrels"]
    lost = lambda side, col, of: r.join(of.select(F.col("_id").alias(col)), col, "left_anti").agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return lost("query", "query-id", q).unionByName(lost("corpus", "corpus-id", c))


def ares(triplets: DataFrame) -> DataFrame:
    """Two rows for each triplet: the positive with label 1 and its answer, the negative with label 0 and none."""
    row = lambda doc, answer, label: F.struct(F.col("anchor").alias("Query"), doc.alias("Document"), answer.alias("Answer"), F.lit(label).alias("Context_Relevance_Label"))
    both = F.explode(F.array(row(F.col("positive"), F.coalesce("answer", F.lit("")), 1), row(F.col("negative"), F.lit(""), 0))).alias("r")
    return triplets.select(both).select("r.*").where("Document is not null")


def ragas(triplets: DataFrame) -> DataFrame:
    """question, answer (empty), contexts, ground_truth."""
    return triplets.select(F.col("anchor").alias("question"), F.lit("").alias("answer"), F.array("positive").alias("contexts"), F.coalesce("answer", "positive").alias("ground_truth"))


def metadata(df: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """The core columns and all others that aren't null as one JSON object."""
    rest = [c for c in df.columns if c not in core]
    return df.select(*core, F.to_json(F.struct(*rest)).alias("metadata"))


def chat(df: DataFrame, task: str) -> DataFrame:
    """messages, task_type, source of rows with instruction, answer and source."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.select(F.array(message("user", "instruction"), message("assistant", "answer")).alias("messages"), F.lit(task).alias("task_type"), "source")


def report(metrics: DataFrame, path: str) -> None:
    """A few metric rows (checked: at most 10,000) as one JSON file."""
    rows = metrics.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a report holds at most 10,000 rows")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(True) for r in rows], f, ensure_ascii=False, indent=2, default=str)


def markdown(metrics: DataFrame, title: str, key: str = "recall_5", good: float = 0.8, fair: float = 0.6) -> str:
    """A Markdown report of a few metric rows (checked: at most 10,000) with a decision on the first."""
    rows = [r.asDict() for r in metrics.limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("a report holds at most 10,000 rows")
    if not rows:
        return f"---\ntitle: {title}\nrows: 0\n---\n"
    head = list(rows[0])
    value = rows[0].get(key) or 0.0
    decision = "good" if value >= good else "fair" if value >= fair else "poor"
    body = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[h]) for h in head) + " |" for r in rows)]
    return "\n".join(["---", f"title: {title}", f"rows: {len(rows)}", f"decision: {decision}", "---", "", f"# {title}", "", *body, ""])
